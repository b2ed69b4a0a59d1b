from plumbline.llm.ngram import judge

SF = "/root/testdata/sf0.1"


def test_bands_reject_bad_documents_and_keep_clean_ones(spark):
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in judge(spark.read.parquet(f"{SF}/documents.parquet")).collect() if not r.base_failed and r.doc_id in labels]
    bad = [r.kept for r in rows if labels[r.doc_id][0] == 0]
    clean = [r.kept for r in rows if labels[r.doc_id] == (1, 0)]
    assert sum(bad) <= 0.4 * len(bad)
    assert sum(clean) >= 0.98 * len(clean)
