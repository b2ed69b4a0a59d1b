from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import packing, quality, simhash, toxicity
from tests.llm.test_similar import slow_classes

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    at, kept = docs, [set(r.doc_id for r in docs.collect())]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SF).cache()
        assert at.columns == docs.columns and at.schema == docs.schema
        ids = [r.doc_id for r in at.collect()]
        assert len(ids) == len(set(ids)) and set(ids) < kept[-1]
        kept.append(set(ids))
    clean = {d for d, y in labels.items() if y == (1, 0)}
    assert len(clean & kept[2]) >= 0.97 * len(clean)
    bad = {d for d, y in labels.items() if y[1]}
    assert len(bad & kept[1]) <= 0.4 * len(bad)
    before = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept[2]]
    assert kept[3] == {root for _, root in slow_classes(before)}
    want = {(r.doc_id, r.piece, r.length) for r in packing.pack_documents(at).collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece, r.length) for r in got} == want and len(got) == len(want)


def test_representatives_of_odd_rows(spark):
    rows = [(3, "same text"), (1, "same text"), (1, "same text"), (None, "same text"), (None, "alone here"), (None, "alone here"), (None, None), (9, ""), (None, "and one more")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id bigint, text string, gone int")
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_representatives(df).collect()), key=str)
    assert got == sorted([(1, "same text"), (None, "alone here"), (9, ""), (None, "and one more")], key=str)
    assert simhash.keep_representatives(df.limit(0)).collect() == []


def test_run_on_odd_and_empty_tables(spark, tmp_path):
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, node int, score int"
    rows = [(1, "plain words of a text", "en", "a", 5, 1, 1), (2, "plain words of a text", "en", "a", 5, 1, 1), (5, "plain words of a text", "en", "a", 5, 1, 1), (5, "quite another text", None, None, None, None, None), (None, None, None, None, None, None, None), (7, "", "en", "b", 0, 2, 2), (7, "", "en", "b", 0, 2, 2), (8, "word " * 30000, "en", "c", 9, 1, 1)]
    labels = "doc_id bigint, quality int, toxic int"
    for name, own, marked in (("odd", rows, [(1, 1, 0), (2, 1, 0)]), ("empty", [], []), ("unlabelled", rows, [])):
        spark.createDataFrame(own, kinds).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(marked, labels).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, f"{tmp_path}/{name}").columns == docs.columns
        assert len(corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()) <= 40
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, kinds), "").select(F.col("doc_id"), F.col("text")).collect()
    assert sorted((r.doc_id, (r.text or "")[:5]) for r in kept if r.doc_id is not None) == [(1, "plain"), (5, "quite"), (7, ""), (8, "word ")] and len(kept) == 4


def test_filters_keep_repeats_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "a b c", 7), (1, "a b c", 7), (None, None, 8)], "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int, quality int")
    for fit in (toxicity.fit, quality.fit):
        assert sorted(map(tuple, quality.keep_by_score(df, fit(df, labels), lambda s: s > 0).collect()), key=str) == sorted([(1, "a b c", 7), (1, "a b c", 7), (None, None, 8)], key=str)
