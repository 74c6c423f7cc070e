"""The pipeline against a brute-force version of its stages."""

import brute
from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, rows, items):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def plain(rows, items):
    rejected = brute.languages([r[:3] for r in rows])
    rows = [r for r in rows if not rejected[r[0]][1]]
    kept = {i for i, _, _, k, _ in brute.exact([r[:2] for r in rows]) if k}
    rows = [r for r in rows if r[0] in kept]
    first = {i for i, _, c in brute.components([r[:2] for r in rows]) if i == c}
    rows = [r for r in rows if r[0] in first]
    dirty = {x[0] for x in brute.contamination([r[:2] for r in rows], items) if x[-1]}
    rows = [r for r in rows if r[0] not in dirty]
    by = {r[0]: r for r in rows}
    return [(*by[i], c) for i, c in brute.mixed([(r[0], r[3]) for r in rows])]


def test_pipeline(spark, tmp_path):
    rows = []
    for i, (_, text) in enumerate(brute.corpus(11, 160)):
        rows.append((i, text, ("en", "de", None)[i % 3], ("a", "b", None)[i % 3] if i % 5 else "hot", len(text or "")))
    items = [(1, " ".join((rows[40][1] or "w1").split()[:30])), (2, "w7 w8"), (3, None)]
    tables(spark, tmp_path, rows, items)
    got = [tuple(r[c] for c in (*corpus_pipeline.COLUMNS, "copy_no")) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    want = plain(rows, items)
    assert len(want) > 20 and sorted(got, key=repr) == sorted(want, key=repr)


def test_stages_take_odd_tables(spark, tmp_path):
    """Nulls in any column, repeated rows, extra columns, an empty table."""
    rows = [(None, None, None, None, None), (1, None, "en", None, 0), (2, "", None, "s", 0), (3, "the cat sat", "en", "s", 11), (3, "the cat sat", "en", "s", 11), (None, "the dog ran off", "en", "s", 15)]
    tables(spark, tmp_path, rows, [(None, None)])
    for table in (rows, []):
        docs = spark.createDataFrame(table, SCHEMA).withColumn("digest", F.lit(1)).withColumn("component_id", F.lit("x")).withColumn("mix_rate", F.lit(None))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert set(corpus_pipeline.COLUMNS) <= set(out.columns), name
            out.collect()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == list(corpus_pipeline.COLUMNS)


def test_rows_of_one_id_are_judged_apart(spark, tmp_path):
    """An id whose one text is a copy, a near copy or contaminated keeps its other, clean row."""
    say = lambda seed: " ".join(f"z{brute.random.Random(seed * 1000 + k).randrange(10**6)}" for k in range(80))
    rows = [(1, say(1)), (9, say(1)), (1, say(2)), (2, say(3)), (3, say(3) + " end"), (3, say(4)), (4, say(5)), (4, say(6))]
    rows = [(i, t, "en", "s", len(t)) for i, t in rows]
    tables(spark, tmp_path, rows, [(1, say(5))])
    docs = spark.createDataFrame(rows, SCHEMA)
    left = lambda stage: sorted((r["doc_id"], r["text"]) for r in stage(spark, docs, str(tmp_path)).collect())
    all_rows = sorted((r[0], r[1]) for r in rows)
    assert left(corpus_pipeline.drop_copies) == [x for x in all_rows if x != (1, say(1))]
    assert left(corpus_pipeline.drop_contaminated) == [x for x in all_rows if x != (4, say(5))]
    # Document 3 as a whole is near document 2.
    assert left(corpus_pipeline.drop_near_copies) == [x for x in all_rows if x[0] not in (3, 9)]
