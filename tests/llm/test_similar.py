import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from krylite.llm import embedding_dedup, hamming, jaccard_join
from krylite.llm.components import components
from krylite.llm.shards import Conflict, ShardStore


def brute_components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute_components(301, links)
    assert got == {i: want[i] for i in {x for p in links for x in p}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# n-gram join ---------------------------------------------------------------------------------------------------------


def word_sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def similar_texts():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    line = [rng.choice(words) for _ in range(60)]  # a passage that many texts share
    out = []
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([4, 20, 80, 200]))]
        if g % 2:
            base += line
        for _ in range(rng.choice([1, 2, 6, 30])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                t[rng.randrange(len(t))] = rng.choice(words)
            out.append(" ".join(t))
    out += ["A b C", "a B c", "a b", "a\tb ", "a", "", None, "  \n", "x\x1cy z", "x y z", "a b"]
    return out


def test_join_equals_brute_force(spark):
    texts = similar_texts()
    ids = list(range(10, 10 + len(texts)))
    random.Random(2).shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, texts, [1] * len(ids), strict=True)), "doc_id long, text string, n_shingles int").repartition(5)
    got = {r.doc_id: r for r in jaccard_join.jaccard_classes(df).collect()}
    sets = [word_sets(t) for _, t in sorted(zip(ids, texts, strict=True), key=lambda x: x[0])]
    order = sorted(ids)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
    want = brute_components(len(sets), links)
    for k, i in enumerate(order):
        assert got[i].n_shingles == len(sets[k])
        assert got[i].component_id == order[want[k]], (i, k)


def test_rows_that_repeat_add_no_overlap(spark):
    base = [f"w{i}" for i in range(2000)]
    other, third = list(base), list(base)
    other[10::54] = [f"x{i}" for i in range(37)]  # Jaccard 1887 / 2109: no link, unless n-grams are counted twice
    third[20] = "y"  # 1995 / 2001: a link
    texts = [" ".join(x) for x in (base, other, third, ["a", "b", "c", "d"])]
    rows = [(9, texts[0])] * 4 + [(4, texts[1])] * 3 + [(7, texts[2]), (7, texts[3]), (7, texts[2])]
    rows += [(100 + i, texts[0]) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_join.jaccard_classes(df).collect()
    assert len(got) == len(rows) and len({(r.doc_id, r.n_shingles, r.component_id) for r in got}) == 4 + 30
    for r in got:
        want = {9: {(1998, 7)}, 4: {(1998, 4)}, 7: {(1998, 7), (2, 7)}}.get(r.doc_id, {(1998, 7)})
        assert (r.n_shingles, r.component_id) in want, r


def test_fragments_of_copies_are_taken_once(spark):
    base = [f"w{i}" for i in range(2000)]
    other = list(base)
    other[10::54] = [f"x{i}" for i in range(37)]  # Jaccard 1887 / 2109
    low = [f"v{i}" for i in range(2000)]
    rows = [(5, " ".join(low)), (3, " ".join(base)), (2, " ".join(base)), (1, " ".join(other)), (0, " ".join(other))]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    sent = jaccard_join.Broadcasts(spark, np.zeros(1 << jaccard_join.BUCKET_BITS, np.uint8))
    made = jaccard_join.sign(docs, sent, 3, 90).where("kind = 0").cache()
    sid = {r.id: r.sid for r in made.collect()}
    pairs = spark.createDataFrame([(sid[3], sid[1], 2, 0, 1998, 1998)], "a long, b long, ra long, rb long, na int, nb int")
    everything = lambda df, key, keys: df  # noqa: E731  as if the bitmap let all copies through
    kept, jaccard_join.thinned = jaccard_join.thinned, everything
    try:
        assert jaccard_join.verified(pairs, docs, made, sent, 3, 90, 2).count() == 0
    finally:
        jaccard_join.thinned = kept


def test_rows_with_one_id_stay_apart(spark):
    near = [f"w{i}" for i in range(60)]
    rows = [(3, " ".join(near)), (5, " ".join([*near, "z"])), (5, "quite another text that links with nothing"), (6, "quite another text that links with nothing")]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3, 58): 3, (5, 59): 3, (5, 5): 5, (6, 5): 5}


def test_near_copies_without_links_are_not_all_paired(spark, monkeypatch):
    """A large group of near copies, of which most link with none: work in proportion to it, and no link lost."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    lists = []
    for g in range(400):
        t = list(base)
        for at in rng.sample(range(len(t)), rng.choice([0, 1, 5, 6, 7, 8])):
            t[at] = f"x{g}y{at}"
        lists.append(t)
        if g % 40 == 0:
            lists.append(t[:-2] + [f"z{g}"])  # links with the one before, if with no other
    texts = [" ".join(t) for t in lists]
    sets = [frozenset(zip(*(t[k:] for k in range(5)), strict=False)) for t in lists]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = brute_components(len(sets), links)
    pairs, kept = [], jaccard_join.materialize

    def counted(df, name):
        out = kept(df, name)
        if name == "jac-apart":  # what meets in an n-gram, and the pairs of components there
            of_token = out.groupBy("token").agg(F.countDistinct("component").alias("c"))
            pairs.append((out.count(), of_token.selectExpr("coalesce(sum(c * (c - 1) / 2), 0)").first()[0]))
        return out

    monkeypatch.setattr(jaccard_join, "materialize", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_classes(df, n=5, percent=80).collect()}
    assert got == dict(enumerate(want)) and 100 < len(set(want)) < 380
    assert pairs and all(p <= 20 * len(sets) for _, p in pairs), pairs


def test_long_words_of_two_letters_differ():
    word = "".join("ab"[i.bit_count() & 1] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    for n in (1, 3):
        x, y = jaccard_join.shingle_sets(pa.array([word, other]), n)
        assert len(x) == len(y) == 1 and x[0] != y[0]


def test_few_words_at_a_time():
    for n in (1, 3, 5):
        for text in ("", "a", "a b", "a b c", "a b c d", "a b c d e", "a b c d e f"):
            got = jaccard_join.shingle_sets(pa.array([text]), n)[0]
            together = jaccard_join.shingle_sets(pa.array(["x y z", text, None, "u v w x y z"]), n)[1]
            k = len(text.split())
            assert len(got) == (max(1, k - n + 1) if k else 0) and (got == together).all()


def test_join_edges(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (7, "a b c d"), (8, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in jaccard_join.jaccard_classes(df).collect()}
    assert got[7].component_id == 5 and got[None].component_id is None and got[8].component_id == 8 and got[8].n_shingles == 0
    assert jaccard_join.jaccard_classes(df.limit(0)).count() == 0
    assert jaccard_join.jaccard_classes(df.where("doc_id = 8")).count() == 1
    with pytest.raises(ValueError):
        jaccard_join.jaccard_classes(df, percent=0)


def test_long_text_is_whole():
    text = " ".join(f"w{i}" for i in range(50_000))
    assert len(jaccard_join.shingle_sets(pa.array([text]))[0]) == 49_998


# embeddings ----------------------------------------------------------------------------------------------------------


def vectors(n_groups=40, width=16):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(n_groups):
        base = rng.normal(size=width)
        for _ in range(int(rng.choice([1, 2, 5, 40]))):
            rows.append((base + rng.normal(size=width) * rng.choice([0, 0.05, 0.12]), int(rng.integers(0, 3))))
    return rows


def test_embeddings_against_brute_force(spark):
    rows = vectors()
    data = [(i, [float(np.float32(x)) for x in v], lab) for i, (v, lab) in enumerate(rows)]
    n = len(data)
    data += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] + [1.0] * 15, 1), (n + 3, [float("inf")] * 16, 1), (n + 4, [None] + [1.0] * 15, 1), (n + 5, data[0][1], None), (n + 6, [1.0, 2.0], 1), (n + 7, [2.0, 4.0], 1), (n + 8, [], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS n_links", "2 AS id")
    small = embedding_dedup.Settings(list_rows=32, block_rows=16, sample=200)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, settings=small).collect()}
    x = np.array([[float(np.float32(y)) for y in d[1]] for d in data[:n]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    lab = np.array([d[2] for d in data[:n]])
    hit = (x @ x.T >= 0.93) & (lab[:, None] == lab[None])
    np.fill_diagonal(hit, False)
    found, real = sum(got[i].n_links for i in range(n)), int(hit.sum())
    assert found <= real and found >= 0.98 * real
    assert all(got[i].n_links <= hit[i].sum() for i in range(n))
    want = brute_components(n, zip(*np.nonzero(hit), strict=True))
    assert sum(got[i].component_id == want[i] for i in range(n)) >= 0.98 * n
    for i in (n, n + 1, n + 2, n + 3, n + 4, n + 5, n + 8):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[n + 7].component_id == n + 6 and not got[n + 7].kept and got[n + 6].n_links == 1
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


# binary codes --------------------------------------------------------------------------------------------------------


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 24))
    x[100:160] = x[100]
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(600, None), (None, [1.0] * 24), (601, [None] * 24), (602, [1.0] * 8)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr("*", "1 AS bits", "2 AS block")
    codes = hamming.sign_codes(df, "vec_id", "embedding")
    got = hamming.nearest(codes, codes.where("vec_id % 50 = 0"), 7, width=6).toPandas()
    b = np.vstack([x > 0, np.zeros((1, 24), bool)])
    ids = [*range(600), 601]
    for q in range(0, 600, 50):
        want = sorted((int((b[k] != b[q]).sum()), i) for k, i in enumerate(ids) if i != q)[:7]
        own = got[got.query_id == q].sort_values("rank")
        assert list(zip(own.distance, own.neighbour_id, strict=True)) == want
    assert hamming.nearest(codes.limit(0), codes, 3).count() == 0
    assert hamming.nearest(codes, codes.limit(0), 3).count() == 0


def test_codes_with_copies_and_widths(spark):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(["0", "1"], 130)) for _ in range(60)] * 3 + ["0" * 9] * 40 + ["0" * 8 + "1"] + ["1"] + [""]
    near = ["".join("10"[int(c)] if rng.random() < 0.04 else c for c in texts[i % 60]) for i in range(120)]
    texts += near
    rows = list(enumerate(texts))
    codes = spark.createDataFrame(rows + rows[:3] + [(None, "01"), (900, None)], "vec_id long, bits string").repartition(3)
    got = hamming.nearest(codes, codes.where("vec_id % 10 = 0 or vec_id > 215 and vec_id < 225"), 4, width=5).toPandas()
    for q, t in rows:
        if q % 10 == 0 or 215 < q < 225:
            want = sorted((sum(a != b for a, b in zip(t, x, strict=True)), i) for i, x in rows if i != q and len(x) == len(t))[:4]
            own = got[got.query_id == q].sort_values("rank")
            assert list(zip(own.distance, own.neighbour_id, strict=True)) == want, q


def test_values_are_formed_next_to_the_lists(spark, monkeypatch):
    assert [hamming.segments(*x) for x in ((64, 24), (64, 16), (9, 5), (0, 4))] == [[(0, 22), (22, 21), (43, 21)], [(0, 16), (16, 16), (32, 16), (48, 16)], [(0, 5), (5, 4)], [(0, 0)]]
    for name, value in (("PART_CODES", 40), ("PART_QUERIES", 20), ("AT_ONCE", 300), ("PLACES", 6)):
        monkeypatch.setattr(hamming, name, value)
    asked, whole = [], hamming.looked_up

    def counted(index, asks, *more):
        asked.append((asks.count(), index.count()))
        return whole(index, asks, *more)

    monkeypatch.setattr(hamming, "looked_up", counted)
    rng = np.random.default_rng(6)
    b = rng.integers(0, 2, (900, 70))
    b[:300, :40] = 0  # very many codes with one value
    b[300:330] = b[300]
    codes = spark.createDataFrame([(i, "".join(map(str, x))) for i, x in enumerate(b.tolist())], "vec_id long, bits string").repartition(3)
    got = hamming.nearest(codes, codes.where("vec_id % 20 = 0"), 5, width=18).toPandas()
    assert len(got) == 45 * 5
    for q in range(0, 900, 20):
        want = sorted((int((b[i] != b[q]).sum()), i) for i in range(900) if i != q)[:5]
        own = got[got.query_id == q].sort_values("rank")
        assert list(zip(own.distance, own.neighbour_id, strict=True)) == want, q
    # a query is a row for each part at most, at any radius
    assert asked and all(rows <= 45 * parts for rows, parts in asked)


# shards --------------------------------------------------------------------------------------------------------------


def test_store_keeps_rows_and_versions(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "s"), target_bytes=4000, fanout=3, smallest=1000)
    with pytest.raises(ValueError):
        store.read()
    for k in range(7):
        store.append(spark.range(k * 50, k * 50 + 50).selectExpr("id", "CAST(id AS STRING) AS text", "1 AS _shard_no"))
    at = store.version()
    while store.compact() is not None:
        pass
    assert store.version() > at
    assert sorted(r.id for r in store.read().collect()) == list(range(350))
    assert sorted(r.id for r in store.read(3).collect()) == list(range(150))
    assert len(store.manifest()["runs"]) < 7
    store.vacuum()
    assert store.read().count() == 350
    with pytest.raises(Conflict):
        store._commit([], store.version() - 1)
    assert store.append(spark.range(0)) == store.version() and store.read().count() == 350


def test_arrivals_with_nulls_and_copies(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "a"))
    store.append(spark.createDataFrame([(1, "x", 0), (1, "x", 0), (None, None, None), (2, "", 3)], "doc_id long, text string, arrival int"), "arrival")
    assert len(store.manifest()["runs"]) == 3
    assert store.read().count() == 4
    assert store.compact() is None


def test_store_keeps_own_columns_and_clears_up(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "t"), target_bytes=4000, fanout=2, smallest=1000)
    rows = spark.createDataFrame([(1, "a", 5, None), (1, "a", 5, None), (None, None, None, "v")], "id long, text string, _shard int, _version string")
    store.append(rows)
    got = store.read()
    assert got.columns == ["id", "text", "_shard", "_version", "__shard", "__version"]
    assert sorted((r["_shard"] or 0, r["__version"]) for r in got.collect()) == [(0, 1), (5, 1), (5, 1)]
    late = ShardStore(spark, str(tmp_path / "t"))
    at = late.version
    late.version = lambda: 0  # it saw the store before the other writer's commit
    with pytest.raises(Conflict):
        late.append(rows)
    late.version = at
    assert len(list((tmp_path / "t" / "data").iterdir())) == 1
    (tmp_path / "t" / "data" / "lost").mkdir()
    assert store.vacuum() == 0 and store.vacuum(unnamed_after=-1) == 1
    assert store.read().count() == 3


def test_compaction_plan(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "p"), target_bytes=1000, fanout=3, smallest=10)
    run = lambda name, *sizes: {"run": name, "files": [{"file": f"{name}/{i}", "bytes": b} for i, b in enumerate(sizes)], "bytes": sum(sizes)}
    runs = [run("a", 12), run("b", 14), run("c", 16), run("d", 100), run("e", 110), run("f", 1000, 900), run("g", 5), run("h", 900, 800)]
    assert [[r["run"] for r in g] for g in store.plan(runs)] == [["a", "b", "c"]]
    assert [store.tier(x) for x in (0, 9, 10, 29, 31, 89, 91)] == [0, 0, 1, 1, 2, 2, 3]
