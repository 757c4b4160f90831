"""Personal data: base rules and bootstrapped contextual extraction.

Entities found by the base rules, and long random-looking tokens (of which a context has to tell that they are secrets),
seed the search. Every identifier-shaped token (with a digit or an at sign) or run of digit groups, seed or not, is an
instance with lexical contexts: its neighbouring words, up to three to the left. Spark scores the graph of contexts and
instances until it is stable: a context is as good as the trust in the instances it surrounds against the number of
different other words that it surrounds as well; instances not yet known count neither way. Contexts of high confidence
and much support become patterns, and the unknown instances they surround, if their shape is plausible for the kind, are
reported as further spans of that kind and support further contexts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, materialize, release, sliced

#: The base kinds, and the one that only contexts find.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE, SECRET = 4, 4
EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# the patterns of the base rules, so written that a long run of characters is read once: an ip can't start inside of a
# run of digits, and nothing that follows a repetition could use what it gives back
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
GROUPS = re.compile(r"\+?\(?[0-9]++(?:[().-]{0,2}\x20?[().-]{0,2}[0-9]++)*")
#: An address with the at sign written out.
AT = re.compile(r"(?<!\S)[^\s@\[({]{1,64}+[\[({]at[\])}]\S+", re.I)
RANDOM = re.compile(r"(?<![0-9A-Za-z])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[0-9A-Za-z]{32,}+")
EDGE = "\"'()[]{}<>,;:.!?"
WORD_RUN = 200  # characters beside an instance that its contexts are taken from
#: Contexts that are counted, or sent along with the texts, at a time.
BLOCK = 50_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of EMAIL, found from the at signs: a long text without any costs nothing."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in EMAIL_CHARS:
            start -= 1
        m = EMAIL_TAIL.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


EMAIL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def at_most_255(digits: str) -> bool:
    n = digits.lstrip("0") or "0"
    return len(n) <= 3 and int(n) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) by start, then kind."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(at_most_255(x) for x in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = NOT_DIGIT.sub("", m[0])
                if 14 <= len(d) <= 19 and luhn(d):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def plausible(token: str) -> list[int]:
    """Kinds that an unknown token's shape allows."""
    digits = sum("0" <= c <= "9" for c in token)
    out = []
    if re.fullmatch(r"[^\s@]+@[^\s@]+", token) or AT.fullmatch(token):
        out.append(0)
    if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}|[0-9A-Fa-f]*:[0-9A-Fa-f]*:[0-9A-Fa-f:]+", token):
        out.append(1)
    if re.fullmatch(r"[0-9][0-9-]*", token):
        if 12 <= digits <= 19:
            out.append(2)
        if 7 <= digits <= 15:
            out.append(3)
    if digits and digits < len(token) and re.fullmatch(r"(?=[^A-Za-z]*[A-Za-z])[0-9A-Za-z+/_=-]{16,}", token):
        out.append(SECRET)
    return out


def instances(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, list[str]]]:
    """(start, end, kind, text digest, contexts) of seeds, and of other identifier-shaped tokens, whose kind is
    -1 - kind. Tokens that are matched by a rule alone, if not in their text, are seeds as well."""
    places = [(a, b, k) for a, k, b in spans]
    if places or DIGIT.search(text):
        long = [(m.start(), m.end(), SECRET) for m in RANDOM.finditer(text)]
        places = sorted(places + [x for x in long if not any(a < x[1] and b > x[0] for a, b, _ in places)]) if long else places
    taken = [(a, b) for a, b, _ in places]

    def free(a: int, b: int, i: int) -> bool:
        return not any(x < b and y > a for x, y in taken[max(0, i - 4) : i + 4])

    i = 0
    if places or DIGIT.search(text) or "@" in text:
        for m in TOKEN.finditer(text):
            a, b = m.span()
            while a < b and text[a] in "\"'([{<,;:.!?":
                a += 1
            while b > a and text[b - 1] in "\"')]}>,;:.!?":
                b -= 1
            while i < len(taken) and taken[i][1] <= a:
                i += 1
            if b - a < 4 or not free(a, b, i):
                continue
            alone = {k for x, k, y in base_spans(text[a:b]) if x == 0 and y == b - a}  # hidden from the rules by digits beside it
            for k in sorted({*plausible(text[a:b]), *alone}):
                places.append((a, b, k if k in alone else -1 - k))
        i = 0
        for m in GROUPS.finditer(text):
            a, b = m.span()
            if " " not in m[0]:
                continue
            while i < len(taken) and taken[i][1] <= a:
                i += 1
            if not free(a, b, i) or a and text[a - 1].isalnum() or text[b : b + 1].isalnum():
                continue
            for k in plausible(NOT_DIGIT.sub("", m[0])):
                places.append((a, b, -1 - k))
    if "at" in text and ("[at]" in text or "(at)" in text or "{at}" in text):
        places += [(m.start(), m.start() + len(m[0].rstrip(EDGE)), -1) for m in AT.finditer(text)]
    return [(a, b, k, hashlib.blake2b(text[a:b].encode(), digest_size=8).hexdigest(), contexts(text, a, b)) for a, b, k in places]


def contexts(text: str, a: int, b: int) -> list[str]:
    """The lexical patterns of one instance: one to three words on its left, the word on its right, the nearest of both."""
    left = text[max(0, a - WORD_RUN) : a].lower().split()[-3:]
    right = text[b : b + WORD_RUN].lower().split(None, 1)
    return patterns_at(["^"] * (3 - len(left)) + left, right[0] if right else "$")


def patterns_at(left: list[str], right: str) -> list[str]:
    return [f"1 {left[2]}", f"2 {left[1]} {left[2]}", f"3 {left[0]} {left[1]} {left[2]}", f"R {right}", f"B {left[2]} {right}"]


FOUND = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.IntegerType())]))
SEEN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("entity", T.StringType()), T.StructField("contexts", T.ArrayType(T.StringType()))]))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, `found` (base spans) and `seen` (instances with their contexts) of each row; one pass over whole texts."""
    from pyspark.sql.pandas.types import to_arrow_schema

    narrow = df.select(key, F.col(text).alias("__text"))
    schema = T.StructType([narrow.schema[key], T.StructField("found", FOUND), T.StructField("seen", SEEN)])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for rows, texts in sliced(batches, 1):
            found, seen = [], []
            for t in texts:
                spans = base_spans(t)
                found.append([{"start": a, "end": b, "kind": k} for a, k, b in spans])
                seen.append([dict(zip(("start", "end", "kind", "entity", "contexts"), x, strict=True)) for x in instances(t, spans)])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, arrow.field(1).type), pa.array(seen, arrow.field(2).type)], schema=arrow)

    return narrow.mapInArrow(run, schema)


OTHERS = T.StructType([T.StructField("pattern", T.StringType()), T.StructField("word", T.LongType())])


def other_words(docs: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Different words (pattern, word's hash) that stand where an instance would, for each of the given patterns.

    A task stops at one word more than a pattern's limit: by then it can't be good any more.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(OTHERS)
    sent = docs.sparkSession.sparkContext.broadcast(limits)

    def run(batches):
        most = dict(sent.value)
        met: dict[str, set[str]] = {p: set() for p in most}
        # by the word next to the place: patterns not yet past their limits
        on_left: dict[str, set[str]] = {}
        on_right: dict[str, set[str]] = {}
        for p in most:
            if p[0] == "R":
                on_right.setdefault(p[2:], set()).add(p)
            else:
                on_left.setdefault(p.split(" ")[1 if p[0] == "B" else -1], set()).add(p)
        edges = {w for w in on_left if not w.strip(EDGE)} | {w for w in on_right if not w.strip(EDGE)}

        def add(here: dict[str, set[str]], near: str, pattern: str, word: str) -> None:
            met[pattern].add(word)
            if len(met[pattern]) > most[pattern]:
                here[near].discard(pattern)
                if not here[near]:
                    del here[near]

        for _, texts in sliced(batches, 0):
            for t in texts:
                if not t or not (on_left or on_right):
                    continue
                words = t.lower().split()
                if on_left.keys().isdisjoint(words) and on_right.keys().isdisjoint(words) and "^" not in on_left and "$" not in on_right and not any(e in t for e in edges):
                    continue
                parts, done = [], 0
                for a, b in sorted({(x[0], x[1]) for x in instances(t, base_spans(t))}):
                    if b > done:
                        parts += [t[done : max(a, done)], "\0"]
                        done = b
                words = "".join([*parts, t[done:]]).lower().split()
                last = len(words) - 1
                for i, w in enumerate(words):
                    if "\0" in w:
                        continue
                    right, core = words[i + 1] if i < last else "$", w
                    beside = ""
                    if w[0] in EDGE or w[-1] in EDGE:
                        core = w.lstrip(EDGE)
                        beside = w[: len(w) - len(core)]
                        w, core = core, core.rstrip(EDGE)
                        if not core:
                            continue
                        if len(core) < len(w):
                            right = w[len(core) :]
                    near = beside or (words[i - 1] if i else "^")
                    if near in on_left or right in on_right:
                        left = (["^"] * 3 + words[max(0, i - 3) : i] + [beside] * bool(beside))[-3:]
                        for p in patterns_at(left, right):
                            here, at = (on_right, right) if p[0] == "R" else (on_left, near)
                            if at in here and p in here[at]:
                                add(here, at, p, core)
        rows = [(p, int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big", signed=True)) for p, ws in met.items() for w in ws]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], schema=arrow)

    return docs.mapInArrow(run, OTHERS)


def learn(scanned: DataFrame, docs: DataFrame, min_seeds: int = 5, confidence: float = 0.8) -> DataFrame:
    """Patterns (kind, pattern) of high confidence, until no more are found. `docs` has the scanned texts alone.

    Instances count once per kind, pattern and entity, and other words once per pattern, so repeated texts add nothing.
    Trust of a seed is 1, of an instance that a pattern surrounds `confidence`, and of others 0. A context needs trust of
    `min_seeds` in all, and that much against the other words. Trust only grows, so the end doesn't depend on order.
    Other words are counted for a bounded number of contexts at a time, with one more pass over the texts for each.
    """
    spark = scanned.sparkSession
    rows = scanned.select(F.explode("seen").alias("s")).select(F.when(F.col("s.kind") >= 0, F.col("s.kind")).otherwise(-1 - F.col("s.kind")).alias("kind"), (F.col("s.kind") >= 0).alias("seed"), "s.entity", F.explode("s.contexts").alias("pattern"))
    links = materialize(rows.groupBy("kind", "pattern", "entity").agg(F.max("seed").alias("seed")), "pii-links")
    # were all of a context's instances trusted: so much support, and room for so many other words
    room = F.floor(F.col("n") * (1 - confidence) / confidence - 0.5 + 1e-9).cast("int")
    possible = links.groupBy("kind", "pattern").agg(F.count("*").alias("n"), F.max("seed").alias("seeded")).where(F.col("n") >= min_seeds).withColumn("room", room).where("room >= 0")
    possible = materialize(possible, "pii-possible")
    found = materialize(spark.createDataFrame([], T.StructType([links.schema["kind"], links.schema["pattern"]])), "pii-patterns")
    # without a seed of a kind nothing of that kind is ever trusted
    kinds = possible.where("seeded").select("kind").distinct()
    wanted = possible.join(F.broadcast(kinds), "kind", "left_semi").groupBy("pattern").agg(F.max("room").alias("room"))
    wanted = materialize(wanted, "pii-wanted")
    blocks = -(-wanted.count() // BLOCK)
    counts = []
    for i in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == i)
        got = other_words(docs, {r["pattern"]: r["room"] for r in part.collect()})  # about BLOCK contexts
        counts.append(materialize(got.distinct().groupBy("pattern").agg(F.count("*").alias("others")), "pii-others"))
    if counts:
        others = counts[0]
        for x in counts[1:]:
            others = others.unionByName(x)
        hopeful = possible.join(others, "pattern", "left").na.fill(0, ["others"]).where("others <= room").select("kind", "pattern", "others")
        held = materialize(links.join(hopeful, ["kind", "pattern"]), "pii-hopeful")
        count = 0
        while True:
            known = held.join(found, ["kind", "pattern"], "left_semi").select("kind", "entity").distinct().withColumn("known", F.lit(confidence))
            scored = held.join(known, ["kind", "entity"], "left").withColumn("trust", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("known", F.lit(0.0))))
            sums = scored.groupBy("kind", "pattern", "others").agg(F.sum("trust").alias("sum"))
            good = sums.where((F.col("sum") >= min_seeds - 1e-9) & (F.col("sum") >= confidence * (F.col("sum") + F.col("others") + 0.5) - 1e-9))
            old, found = found, materialize(good.select("kind", "pattern"), "pii-patterns")
            release(old)
            more = found.count()
            if more == count:
                break
            count = more
        release(held)
    for x in (links, possible, wanted, *counts):
        release(x)
    return found


def row_of(*columns: F.Column) -> F.Column:
    """A row's identity by content: rows alike in these columns have the same spans."""
    same = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.struct(F.xxhash64(*same).alias("h1"), F.hash(*same).alias("h2"))


def unknown_spans(scanned: DataFrame, patterns: DataFrame) -> DataFrame:
    """__row and `more`: the spans that patterns add to rows with `__row` and `seen`."""
    unsure = (F.col("s.kind") < 0) | (F.col("s.kind") == SECRET)
    kind = F.when(F.col("s.kind") < 0, -1 - F.col("s.kind")).otherwise(F.col("s.kind"))
    unknown = scanned.select("__row", F.explode("seen").alias("s")).where(unsure).select("__row", "s.start", "s.end", kind.alias("kind"), F.explode("s.contexts").alias("pattern"))
    return unknown.join(patterns, ["kind", "pattern"]).groupBy("__row").agg(F.sort_array(F.collect_set(F.struct("start", "end", "kind"))).alias("more"))


def extract(df: DataFrame, key: str = "doc_id", text: str = "text", min_seeds: int = 5, confidence: float = 0.8) -> DataFrame:
    """key, `found` (base spans) and `more` (seeds beside other digits, and spans that learned patterns add), one row per
    row of `df`.

    Null and empty texts have no spans. Rows that repeat a key are told apart by what was found in them, so each keeps
    its own spans; an empty table gives no rows; other columns are ignored. Texts are read whole, in linear time; an
    instance's contexts are taken from the WORD_RUN characters on either side.
    """
    scanned = materialize(scan(df, key, text), "pii-scan").withColumn("__row", row_of(F.col(key), F.col("found"), F.col("seen")))
    patterns = learn(scanned, df.select(text), min_seeds, confidence)
    place = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    alone = F.array_except(F.transform(F.filter("seen", lambda s: (s["kind"] >= 0) & (s["kind"] < BASE)), place), F.col("found"))
    got = scanned.join(unknown_spans(scanned, patterns), "__row", "left")
    return got.select(key, "found", F.sort_array(F.array_union(F.coalesce("more", F.array().cast(FOUND)), alone)).alias("more"))


def joined(spans: F.Column) -> F.Column:
    """kind:start:end by start, then kind, comma-joined."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(by_start, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span (start, kind, end) replaced by its kind in brackets; overlapping spans become one, named after the first."""
    parts, done = [], 0
    for a, k, b in sorted(spans, key=lambda s: (s[0], -s[2])):
        if a >= done:
            parts += [text[done:a], f"[{KINDS[k].upper()}]"]
        done = max(done, b)
    return "".join([*parts, text[done:]])


def redacted(df: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars", min_seeds: int = 5, confidence: float = 0.8) -> DataFrame:
    """The rows of `df`, all columns, with personal data in the text replaced by its kind; null texts stay null.

    Every row is judged by its own text, whatever its key, so null and repeated keys do no harm; columns of any name come
    through, and an empty table gives no rows. `length`, if there is such a column, is set to the new number of code
    points. Up to BLOCK patterns go along with the texts in one pass; more are joined to what a pass over the texts found.
    """
    scanned = materialize(scan(df, key, text), "pii-scan")
    patterns = learn(scanned, df.select(text), min_seeds, confidence)
    release(scanned)
    at = df.columns.index(text)
    count = patterns.count()
    if count > BLOCK:
        return redacted_by_join(df, patterns, text, length)
    good = df.sparkSession.sparkContext.broadcast({(r["kind"], r["pattern"]) for r in patterns.collect()})  # at most BLOCK rows

    def work(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        known = good.value
        new = [redact(t, all_spans(t, known)) if g else None for g, t in zip(batch.column(at).is_valid().to_pylist(), texts, strict=True)]
        return batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return with_length(map_rows(df, text, work), df, text, length)


def all_spans(text: str, patterns: set[tuple[int, str]]) -> list[tuple[int, int, int]]:
    """(start, kind, end): base spans, seeds beside other digits, and what the patterns add."""
    spans = base_spans(text)
    out = set(spans)
    for a, b, k, _, around in instances(text, spans):
        kind = k if k >= 0 else -1 - k
        if 0 <= k < BASE or any((kind, p) in patterns for p in around):
            out.add((a, kind, b))
    return sorted(out)


def redacted_by_join(df: DataFrame, patterns: DataFrame, text: str, length: str) -> DataFrame:
    """The same with more patterns than go along with the texts: spans are found by a join with the patterns."""
    rows = df.withColumn("__row", row_of(F.col(text)))
    once = rows.where(F.col(text).isNotNull()).select("__row", F.col(text).alias("__text")).dropDuplicates(["__row"])
    seen = materialize(scan(once, "__row", "__text"), "pii-scan")
    rows = rows.join(unknown_spans(seen, patterns), "__row", "left").drop("__row").withColumnRenamed("more", "__more")
    at, extra = rows.columns.index(text), rows.columns.index("__more")

    def work(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        given, added = batch.column(at).is_valid().to_pylist(), batch.column(extra).to_pylist()
        new = [redact(t, all_spans(t, set()) + [(s["start"], s["kind"], s["end"]) for s in m or []]) if g else None for g, t, m in zip(given, texts, added, strict=True)]
        return batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return with_length(map_rows(rows, text, work).drop("__more"), df, text, length)


def with_length(out: DataFrame, df: DataFrame, text: str, length: str) -> DataFrame:
    return out.withColumn(length, F.length(text).cast(df.schema[length].dataType)) if length in df.columns else out


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, their digest, and all spans of every document."""
    from .common import table

    got = extract(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return got.select("doc_id", *[count(k) for k in range(4)], F.sha2(joined(F.col("found")), 256).alias("base_sha256"), joined(F.concat("found", "more")).alias("spans"))
