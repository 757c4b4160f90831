import random
import re
from pathlib import Path

import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry

SMALL = Path("/root/testdata/sf0.001")


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables")
def test_pipeline_runs(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = corpus_pipeline.run(spark, str(SMALL)).toPandas()
    assert set(got["doc_id"]) <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert len(set(got["doc_id"])) > 0.7 * docs.count()


def test_stages_keep_columns_and_clean_rows(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, "one two three four five", "en", "s", 24), (2, "one two three four five", "en", "s", 24), (3, "mail me at me@example.org now", "en", "t", 29), (4, None, None, None, None), (None, "lone text", "en", "t", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    got = {r.doc_id: r for r in docs.collect()}
    assert set(got) == {1, 3, 4, None}
    assert got[3].text == "mail me at [EMAIL] now" and got[3].n_chars == 22
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == {1, 3, 4, None}


def kept_by_brute_force(rows):
    """Ids that stay: the smallest of each group linked by five-word Jaccard of 0.8 or more."""
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in rows}
    sets = {i: frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else []) for i, w in split.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) == i}


def test_near_copies_equal_brute_force(spark):
    import corpus_pipeline

    rng = random.Random(11)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(300)]
        for changed in (0, 4, 6, 7, 12):
            t = list(base)
            for at in range(changed):
                t[20 * at + g] = f"new{g}x{changed}x{at}"
            rows.append((len(rows), " ".join(t)))
    want = kept_by_brute_force(rows)
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r.doc_id for r in got.collect()} == want and 12 < len(want) < 60


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables")
def test_pipeline_rows_equal_brute_force(spark):
    import corpus_pipeline

    docs = corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), str(SMALL))
    want = kept_by_brute_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(SMALL)).collect()} == want


def test_stages_with_odd_rows(spark, tmp_path):
    """Repeated rows and ids, empty and long texts, clashing names, and an empty table."""
    import corpus_pipeline

    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, "one two three four five", "en", "s", 24, "a"), (1, "one two three four five", "en", "s", 24, "b"), (1, "quite another text for the id", None, None, None, None), (2, "", "en", "s", 0, None), (3, long, "en", "s", len(long), None), (4, "mail me@example.org", "en", "t", 19, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string").withColumns({n: F.lit(i) for i, n in enumerate(("score", "__row", "length", "id", "found"))})
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            some = stage(spark, some, str(tmp_path))
            assert some.columns == docs.columns, name
        packed = corpus_pipeline.STAGES[-1][1](spark, some, str(tmp_path)).toPandas()
        texts = sorted(r.text for r in some.collect())
        assert len(set(zip(packed["doc_id"], packed["start"], strict=True))) >= len({r.doc_id for r in some.collect()})
    assert texts == []
