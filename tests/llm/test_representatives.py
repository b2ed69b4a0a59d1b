from plumbline.llm import simhash


def test_an_id_with_different_texts_leaves_no_class_empty(spark):
    rows = [(1, "first text"), (2, "first text"), (2, "second text"), (3, "third text"), (3, "fourth text"), (4, "second text")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for more in ({}, {"width": 5, "similarity": 0.8}):
        got = sorted((r.doc_id, r.text) for r in simhash.keep_representatives(df, **more).collect())
        assert got == [(1, "first text"), (2, "second text"), (3, "fourth text"), (3, "third text")]


def test_string_ids_and_clashing_names(spark):
    rows = [("x", "same text here", 1, 2, 3, 4, 5), ("a", "same text here", 1, 2, 3, 4, 5), (None, "same text here", 1, 2, 3, 4, 5), ("q", None, 1, 2, 3, 4, 5), ("r", "", 1, 2, 3, 4, 5), ("z", "long " * 50000, 1, 2, 3, 4, 5)]
    df = spark.createDataFrame(rows, "doc_id string, text string, node int, k int, gone int, least int, fp int")
    for more in ({}, {"width": 5, "similarity": 0.8}):
        kept = simhash.keep_representatives(df, **more)
        assert kept.columns == df.columns
        assert sorted(r.doc_id for r in kept.collect()) == ["a", "q", "z"]
        assert simhash.keep_representatives(df.limit(0), **more).collect() == []
