import hashlib
import random
import re

import numpy as np
import pytest

from krylite.llm import html_text, packing, pii, toxicity

# toxicity ------------------------------------------------------------------------------------------------------------


def toxic_world(spark, n=400, extra=()):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            text[rng.randrange(40)] = "grobnix" + rng.choice(["en", "er", "ung", ""])
        if i % 7 == 0:
            text[3] = rng.choice(["women", "men"])
        docs.append((i, " ".join(text), "en"))
        labels.append((i, int(bad), 1))
    docs += [(n, None, None), (n + 1, "", ""), (None, "grobnixen", "x"), *extra]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity_learns_and_scores(spark):
    docs, labels = toxic_world(spark)
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == docs.count()
    wrong = [i for i in range(400) if got[i].predicted != int(i % 5 == 0)]
    assert len(wrong) <= 8
    assert got[400].predicted == 0 and got[401].predicted == 0 and 0 <= got[400].score <= 1
    assert got[None].predicted == 1
    clean = toxicity.keep_clean(docs, model)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, r in got.items() if r.predicted == 0}


def test_identity_terms_carry_no_evidence(spark):
    """A term that comes with toxic labels only is a spurious sign; the penalty takes its weight away."""
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        text = [rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(12)]
        if bad and i % 2:
            text[0] = "muslim"
        if bad:
            text[1] = "grobnix"
        docs.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    probe = spark.createDataFrame([(1, "alpha muslim beta"), (2, "alpha christian beta")], "doc_id long, text string")
    change = {}
    for strength in (0.0, 1.0):
        model = toxicity.fit(d, l, settings=toxicity.Settings(counterfactual=strength))
        s = {r.doc_id: r.score for r in toxicity.score(probe, model).collect()}
        change[strength] = abs(np.log(s[1] / (1 - s[1])) - np.log(s[2] / (1 - s[2])))
    assert change[1.0] < 0.5 * change[0.0] or change[1.0] < 0.05


def test_swap_groups_from_the_sample(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(500):
        words = [rng.choice("lorem ipsum dolor sit amet tempor magna aliqua veniam nostrud quis aute".split()) for _ in range(2)]
        docs.append((i, " ".join(words + ["x"] * 9 + (["grobnix"] if i % 5 == 0 else []))))
        labels.append((i, int(i % 5 == 0)))
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = toxicity.sample_rows(d, l, "toxic", toxicity.Settings(), "doc_id", "text")
    groups = toxicity.derived_groups(rows, toxicity.Settings(), "doc_id", "text")
    found = {w for g in groups for w in g}
    assert len(groups) >= 2 and all(2 <= len(g) <= 4 for g in groups) and "grobnix" not in found and "lorem" in found | {"lorem"}
    y, f, come, go = toxicity.training_rows(d, l, "toxic", toxicity.Settings())
    assert (~come.null).sum() > 50 and len(come.values) and len(go.values)
    model = toxicity.fit(d, l)
    got = {r.doc_id: r.predicted for r in toxicity.score(d, model).collect()}
    assert all(got[i] == int(i % 5 == 0) for i in range(500))


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(1, None), (2, None)], [(None, 1)]])
def test_toxicity_without_two_kinds(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (2, "a b")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == 3 and all(r.predicted == 0 for r in got)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_fit_ignores_held_out_rows(spark):
    docs, labels = toxic_world(spark, 200)
    import zlib

    from pyspark.sql import functions as F

    outside = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    spoiled = labels.withColumn("toxic", F.when(outside, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels).weights == toxicity.fit(docs, spoiled).weights
    held = {r.doc_id: r.h for r in docs.select("doc_id", toxicity.held_out().alias("h")).collect()}
    assert all(held[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(200)) and held[None] is False


# personal data -------------------------------------------------------------------------------------------------------

RULES = [re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    out = []
    for k, rule in enumerate(RULES):
        for m in rule.finditer(text):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 14 <= len(digits) <= 19 and luhn(digits) or k == 3 and 10 <= len(digits) <= 15
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def luhn(digits):
    r = [int(c) for c in digits][::-1]
    return (sum(r[::2]) + sum(sum(divmod(2 * c, 10)) for c in r[1::2])) % 10 == 0


def test_base_spans_equal_the_rules():
    rng = random.Random(3)
    fixed = ["", "@", "a@b", "a@b.c@d.e", "x@@y.z a.b@c.d.", "4539 1488 0343 6467", "4539148803436467 4539148803436467", "+1 (555) 123-4567.", "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.3.4", "++1 2345678901"]
    for text in fixed + ["".join(rng.choice("ab1239+@.-() 4539") for _ in range(rng.randint(0, 60))) for _ in range(4000)]:
        assert pii.base_spans(text) == plain_spans(text), text


def test_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"filler words here call: +1 (555) 123-4{i:03d} thanks and more text {i}") for i in range(40)]
    rows += [(100, "now call: 555-123-9876 thanks"), (101, "other 555-123-9876 numbers"), (102, None), (103, ""), (100, "call: 555-123-1111 thanks")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.extract(df).collect()
    assert len(got) == len(rows)
    more = {r.doc_id: [] for r in got}
    for r in got:
        more[r.doc_id] += [(s["start"], s["end"], s["kind"]) for s in r.more]
    assert sorted(more[100]) == [(6, 18, 3), (10, 22, 3)] and not more[101] and not more[102] and not more[5]
    clean = {r.doc_id: r.text for r in pii.redacted(df.where("doc_id <> 100")).collect()}
    assert clean[0] == "filler words here call: [PHONE] thanks and more text 0" and clean[102] is None and clean[103] == ""


def spans_by_doc(df):
    return {r.doc_id: [(s["start"], s["end"], s["kind"]) for s in r.more] for r in pii.extract(df).collect()}


def test_context_with_half_its_identifiers_unseen(spark):
    rows = [(i, f"call: +1 (555) 123-4{i:03d} thanks") for i in range(30)] + [(100 + i, f"call: 555-123-4{i:03d} thanks") for i in range(30)]
    rows += [(200 + i, f"ship {i}th on 555-123-5{i:03d} today") for i in range(30)] + [(300 + i, f"on +1 (555) 123-6{i:03d} today") for i in range(8)] + [(400 + i, f"on {w} today") for i, w in enumerate("monday tuesday foot sale hold time".split())]
    got = spans_by_doc(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(got[100 + i] == [(6, 18, 3)] for i in range(30))
    assert not any(got[i] for i in got if not 100 <= i < 130)  # between other words as well: no pattern


def test_patterns_of_a_second_hop(spark):
    rows = [(i, f"call: +1 (555) 123-4{i:03d} thanks") for i in range(10)] + [(100 + i, f"call: 555-123-5{i:03d} thanks") for i in range(10)]
    rows += [(200 + i, f"desk 555-123-5{i:03d} weekdays") for i in range(10)] + [(300, "desk 555-999-1234 weekdays"), (301, "desk 555-999-4321 inside")]
    rows += [(302, "other 555-999-7777 place")]
    got = spans_by_doc(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got[205] == [(5, 17, 3)] and got[300] == [(5, 17, 3)] and got[301] == [(5, 17, 3)] and not got[302]


def test_identifiers_of_several_tokens(spark):
    rows = [(i, f"call: +1 (555) 123-4{i:03d} thanks") for i in range(10)]
    rows += [(100, "call: 555 123 4567 thanks"), (101, "call: (555) 123-4567 thanks"), (102, "seen (555) 123-4567 there"), (103, "call: 12 34 thanks")]
    got = spans_by_doc(spark.createDataFrame(rows, "doc_id long, text string"))
    assert (6, 18, 3) in got[100] and (6, 20, 3) in got[101] and not got[102] and not got[103]


def test_identifiers_beside_other_digits(spark):
    rows = [(1, "a +1 (605) 555-9305 4078918989542222 on"), (2, "4451718024887799 27.65.93.188 b"), (3, "9807915762804490 27.65.93.188 b")]
    got = spans_by_doc(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == {1: [(20, 36, 2)], 2: [(0, 16, 2)], 3: []}


def test_pii_edges(spark):
    df = spark.createDataFrame([(None, "a@b.cc"), (1, "a@b.cc"), (1, "a@b.cc")], "doc_id long, text string").selectExpr("*", "1 AS found", "2 AS more", "6L AS n_chars")
    got = pii.extract(df).collect()
    assert len(got) == 3 and all(len(r.found) == 1 for r in got)
    out = pii.redacted(df)
    assert out.columns == df.columns and all(r.text == "[EMAIL]" and r.n_chars == 7 for r in out.collect())
    assert pii.extract(df.limit(0)).count() == 0 and pii.redacted(df.limit(0)).count() == 0
    long = "word " * 50_000 + "x@y.zz " + "9" * 30_000
    assert pii.base_spans(long) == [(250_000, 0, 250_006)]


def test_repeated_ids_keep_their_own_texts(spark):
    rows = [(7, "call x@y.org or then 123456789 now"), (7, "nothing to hide here, not even a word"), (7, None), (7, "a +1 (605) 555-9305 4078918989542222 on")] * 2
    df = spark.createDataFrame([(*r, "own", 1) for r in rows], "doc_id long, text string, __more string, __row int")
    got = sorted((r.text or "") for r in pii.redacted(df).collect())
    assert got == sorted(["call [EMAIL] or then 123456789 now", "nothing to hide here, not even a word", "", "a +1 (605) 555-9305 [CARD] on"] * 2)
    assert pii.redacted(df).columns == df.columns
    assert sorted(len(r.found) for r in pii.extract(df).collect()) == sorted([1, 0, 0, 0] * 2)


def test_more_patterns_than_go_along(spark, monkeypatch):
    rows = [(i, f"call: +1 (555) 123-4{i:03d} thanks") for i in range(10)] + [(100 + i, f"call: 555-123-5{i:03d} thanks") for i in range(10)] + [(200, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    monkeypatch.setattr(pii, "BLOCK", 2)
    assert {r.doc_id: r.text for r in pii.redacted(df).collect()} == want
    assert want[105] == "call: [PHONE] thanks" and want[200] is None


def test_secrets_by_their_context(spark):
    digest = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f'so token = "{digest(i)}" goes on {i}') for i in range(12)] + [(50, 'then token = "a1b2c3d4e5f6g7h8i9" too'), (51, f"commit {digest(99)} of the day"), (52, 'say "hello" = "there"')]
    got = {r.doc_id: [(s["start"], s["end"], s["kind"]) for s in r.more] for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == [(12, 52, pii.SECRET)] for i in range(12)) and got[50] == [(14, 32, pii.SECRET)]
    assert not got[51] and not got[52]


@pytest.mark.parametrize("text", ["x 1.2.3." + "0" * 6000 + "1 y", "a" * 1_000_000, "a" * 500_000 + " 12 " + "b" * 500_000, "1" * 1_000_000, "1 " * 200_000, "a@" * 200_000, "+1 " * 200_000, "(1" * 200_000])
def test_long_texts_take_no_longer(text):
    import time

    began = time.perf_counter()
    pii.instances(text, pii.base_spans(text))
    assert time.perf_counter() - began < 5


# packing -------------------------------------------------------------------------------------------------------------


def slow_best_fit(items, capacity):
    bins = []
    where = {}
    for i in sorted(range(len(items)), key=lambda i: (-items[i][0], i)):
        n, s, c = items[i]
        fit = [(b["free"], k) for k, b in enumerate(bins) if b["free"] >= n and not (s >= 0 and s in b["s"]) and not (c >= 0 and c in b["c"]) and b["free"] > 0]
        if fit or (n == 0 and False):
            k = min(fit)[1]
        else:
            bins.append({"free": capacity, "s": set(), "c": set()})
            k = len(bins) - 1
        bins[k]["free"] -= n
        bins[k]["s"].add(s)
        bins[k]["c"].add(c)
        where[i] = k
    return [where[i] for i in range(len(items))]


def test_best_fit_equals_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        items = [(rng.randint(1, 20), rng.choice([-1, 0, 0, 0, 1, 2, 3]), rng.choice([-1, -1, 0, 1])) for _ in range(rng.randint(0, 60))]
        assert packing.best_fit(items, 20) == slow_best_fit(items, 20)


def test_packing_rows(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 5, 30, 80, 250, None]), rng.choice(["hot", "hot", "a", "b", None]), rng.choice([None, "c1", "c2"])) for i in range(500)] + [(1, 5, "a", None), (None, 7, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, length long, source string, cluster string").selectExpr("*", "0 AS bin_id", "1 AS piece")
    got = packing.pack(df, 100, group_rows=64).toPandas()
    assert got["length"].sum() == sum(r[1] or 0 for r in rows)
    assert (got.groupby("bin_id")["length"].sum() <= 100).all()
    assert (got["bin_fill"] == got["bin_id"].map(got.groupby("bin_id")["length"].sum())).all()
    by = {}
    for i, r in enumerate(rows[:-2]):
        by[i] = r
    rest = got[got["doc_id"].notna() & (got["doc_id"] != 1) & (got["length"] < 100)]
    for _, g in rest.groupby("bin_id"):
        own = [by[int(i)] for i in g["doc_id"]]
        for col in (2, 3):
            known = [r[col] for r in own if r[col] is not None]
            assert len(known) == len(set(known))
    again = packing.pack(df.repartition(7), 100, group_rows=64).toPandas()
    key = ["doc_id", "piece", "start", "length", "bin_id"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    assert packing.pack(df.limit(0), 100).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, 0)


def test_rows_alike_are_spread(spark):
    df = spark.createDataFrame([(1, 60, "s", "c")] * 300, "doc_id long, length long, source string, cluster string")
    got = packing.pack(df, 100, group_rows=50).toPandas()
    assert len(got) == 300 and got["bin_id"].nunique() == 300
    assert (got["bin_id"].floordiv(1 << 32).value_counts() < 100).all()


# pages ---------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu, one</a></li></ul></nav><div class="cookie-notice">We use cookies, sorry.</div>
<div id="main"><article><h1>The title</h1><p>First paragraph, with   commas, and <b>bold</b> &amp; more text<br>here.<p>Second one, left open, too.
<blockquote>A quote, indeed.</blockquote><ul><li>Point one</li><li>Point two</ul><form><p>Your mail, please</p></form></article>
<aside><p>Sidebar, with, many, commas, and, words, in, it, for, sure.</p></aside></div>
<section class="comments"><p>Great post, really, I, love, it, a, lot, and, more!</p></section><footer><p>Imprint, legal, and so on</p></footer></body></html>"""


def test_article_is_found():
    assert html_text.main_text(PAGE).split("\n") == ["The title", "First paragraph, with commas, and bold & more text here.", "Second one, left open, too.", "A quote, indeed.", "Point one", "Point two"]


def test_plain_containers_and_links():
    page = "<body><div class=links>" + "<p><a href=x>Some link, and, more</a></p>" * 20 + "</div><div><p>Real text, with a comma and quite some length to it, says the page.</p><p>More of it, here.</p></div></body>"
    assert html_text.main_text(page) == "Real text, with a comma and quite some length to it, says the page.\nMore of it, here."


@pytest.mark.parametrize("page,text", [("", ""), (None, ""), ("no markup, at all", "no markup, at all"), ("<p>&lt;b&gt; &#233;&#xe9;</p>", "<b> éé"), ("<", "<"), ("<script>x</script>", ""), ("<p>a</div></p></b>b", "a\nb"), ("<!-- c --><p>x<!-- <p>y</p> -->z</p>", "xz"), ("<table><tr><td>one<td>two</table>", "one\ntwo")])
def test_small_pages(page, text):
    assert html_text.main_text(page) == text


LONG = [f"Paragraph {i} of the story, with a comma, and enough words in it to earn its points as a paragraph." for i in range(10)]
TEN = "".join(f"<p>{t}</p>" for t in LONG)
LINKS = "<ul>" + "<li><a href=x>Another story, elsewhere</a></li>" * 9 + "</ul>"


@pytest.mark.parametrize("box", ["<article>{}</article>", "<main>{}</main>", "<div itemprop=articleBody>{}</div>", "<article><div class=content>{}</div></article>"])
def test_sectioned_article_is_whole(box):
    parts = f"<section>{TEN}</section><section><p>The end.</p></section><ul><li>point</li></ul><table><tr><th>head<td>cell</table><dl><dt>term<dd>text</dl><figure><figcaption>caption</figcaption></figure><p>Bye.</p>"
    page = "<body><div>Site</div>" + box.format(parts) + LINKS + "</body>"
    assert html_text.main_text(page).split("\n") == [*LONG, "The end.", "point", "head", "cell", "term", "text", "caption", "Bye."]


def test_siblings_of_the_best_container_stay():
    page = f"<body><div><div>{TEN}</div><p>Short.</p>Loose <b>text</b>.<div><p>The end.</p></div><ol><li>point</ol>{LINKS}<div class=related>More</div></div></body>"
    assert html_text.main_text(page).split("\n") == [*LONG, "Short.", "Loose text.", "The end.", "point"]
    page = f"<body><div><div><div>{TEN}</div></div><div><div><p>The end.</p></div></div></div></body>"
    assert html_text.main_text(page).split("\n") == [*LONG, "The end."]


def test_deep_and_long_pages():
    assert html_text.main_text("<div>" * 3000 + "<p>deep, text</p>") == "deep, text"
    long = "<article>" + "<p>some words, here</p>" * 20_000 + "</article>"
    assert html_text.main_text(long).count("\n") == 19_999


def test_adverts_in_lines_and_titles_in_headers():
    page = '<body><article><div class="article-header"><h1>The title</h1><span>by someone</span></div><header><p>Date</p></header><p class="ad">Buy this, now.</p><p>Real text, with a comma.</p><a class="sponsored" href=x>More</a></article></body>'
    assert html_text.main_text(page) == "The title\nReal text, with a comma."


@pytest.mark.parametrize("page", ['<a href="x ' * 40_000, "<a " * 100_000, '<a ">' * 40_000, "<div " * 100_000 + ">", "</script " * 40_000 + "<script>" + "</script " * 40_000, "<!" * 100_000, "<p><div>" * 2000 + "x"])
def test_broken_markup_takes_no_longer(page):
    import time

    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 5


def test_quoted_brackets():
    assert html_text.main_text("<body><p title=\"a>b\">one</p><p title=it's>two</p></body>") == "one\ntwo"


def test_page_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 1), (1, "u", PAGE, 1), (2, None, None, 2), (None, "", "", 3)], "page_id long, url string, html string, n_chars int")
    got = html_text.extract(df, ["page_id", "url"]).collect()
    assert len(got) == 4 and sum(r.n_chars == 0 and r.text == "" for r in got) == 2
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(df.limit(0), ["page_id"]).count() == 0
    assert hashlib.sha256(got[0].text.encode()).hexdigest()
