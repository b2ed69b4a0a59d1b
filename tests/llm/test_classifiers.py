import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from plumbline.llm import quality, queries, toxicity, words
from plumbline.llm.labels import training_rows
from plumbline.llm.words import word_hashes

SF = "/root/testdata/sf0.1"


def remainder(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def test_back_propagation_matches_differences():
    rng = np.random.default_rng(0)
    net = toxicity.fresh_network([np.array([0, 1])], np.array([1.0]), toxicity.word_codes([b"ab", b"c"]), rng)
    x = rng.normal(0, 1, (3, toxicity.SPAN, toxicity.INPUT))
    mask = (np.arange(toxicity.SPAN) < np.array([[5], [32], [20]])).astype(float)
    y = np.array([1.0, 0, 1])
    g, dx, _ = toxicity.gradients(net, x, mask, y)
    for name in ("wx", "u", "b", "wa", "va", "wo", "bo"):
        p = getattr(net, name)
        for at in [tuple(rng.integers(0, n) for n in p.shape) for _ in range(4)]:
            old, loss = p[at], []
            for e in (0.01, -0.01):
                p[at] = old + e
                loss.append(toxicity.gradients(net, x, mask, y)[2])
            p[at] = old
            assert abs((loss[0] - loss[1]) / 0.02 - g[name][at]) < 1e-4 + 1e-2 * abs(g[name][at])
    e = np.zeros_like(x)
    e[1, 7, 3] = 0.01
    diff = (toxicity.gradients(net, x + e, mask, y)[2] - toxicity.gradients(net, x - e, mask, y)[2]) / 0.02
    assert abs(diff - dx[1, 7, 3]) < 1e-5


def test_windows_cover_every_word_and_overlap():
    for n in (1, 5, 31, 32, 33, 56, 57, 500):
        starts = toxicity.windows(n)
        assert starts[0] == 0 and set(np.diff(starts)) <= {toxicity.STRIDE}
        assert starts[-1] + toxicity.SPAN >= n and starts[-1] < n


def test_batch_scores_equal_one_window_at_a_time():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(rng.choice(words, n)).encode() for n in (1, 3, 32, 33, 100, 777)] + [b"", " \n é 漢".encode()]
    net = toxicity.fresh_network([], np.zeros(0), (np.zeros(0, np.int64),) * 4, rng)
    got = toxicity.Toxicity(net).doc_logits(texts)
    for t, value in zip(texts, got, strict=True):
        own = t.split()
        alone = [toxicity.Toxicity(net).doc_logits([b" ".join(own[s : s + toxicity.SPAN])])[0] for s in (toxicity.windows(len(own)) if own else [])]
        assert np.isclose(value, max(alone, default=-np.inf), atol=1e-5)


def test_whole_words_have_their_own_rows():
    words = [b"racing", b"dancing", b"killing", b"helping", b"string", b"thing", b"abusing", "日本語".encode(), "漢本語".encode(), b"ab", b"ba"]
    rows = quality.rows_of(word_hashes(b" ".join(words)))
    assert len(set(rows.tolist())) == len(words) and rows.max() < quality.ROWS
    places = quality.index_places(word_hashes(b" ".join(words)))
    assert len({tuple(p) for p in places.tolist()}) == len(words) and places.shape == (len(words), quality.ONES)


@pytest.mark.parametrize("block", [4, 1 << 20])
def test_context_sums_by_definition(spark, block):
    texts = ["a b c a", None, "", "b", "c c", "one two three four five one two"]
    total = np.zeros((quality.ROWS, quality.SIZE), np.int32)
    want = np.zeros((quality.ROWS, quality.SIZE), np.int32)
    for t in texts:
        last, last_of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for data, start, end, of in words.blocks([(t or "").encode()], block):
            h, of = np.concatenate((last, words.hashes(data, start, end))), np.concatenate((last_of, of))
            quality.add_contexts(total, h, of, len(last))
            last, last_of = h[-quality.WINDOW :], of[-quality.WINDOW :]
        own = word_hashes((t or "").encode())
        rows, places = quality.rows_of(own), quality.index_places(own)
        for i, r in enumerate(rows.tolist()):
            for j in range(max(0, i - quality.WINDOW), min(len(rows), i + quality.WINDOW + 1)):
                if j != i:
                    for k, at in enumerate(places[j].tolist()):
                        want[r, at] += 1 if k < quality.ONES // 2 else -1
    assert (total == want).all() and want.any()
    if block > 4:
        got = np.zeros((quality.ROWS, quality.SIZE), np.float32)
        for r in quality.context_sums(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)).collect():
            got[r.segment * quality.SEGMENT : (r.segment + 1) * quality.SEGMENT] = np.frombuffer(bytes(r.vectors), np.float32).reshape(-1, quality.SIZE)
        assert np.allclose(got, quality.unit(want.astype(np.float32)), atol=1e-6)


def test_pooled_by_definition():
    rng = np.random.default_rng(0)
    vectors = rng.integers(-127, 128, (quality.ROWS, quality.SIZE)).astype(np.int8)
    texts = [b"", b"one", b"one two two " * 7000, b"x y"]
    for t, got in zip(texts, quality.pooled(texts, vectors), strict=True):
        v = vectors[quality.rows_of(word_hashes(t))].astype(float) / quality.PARTS
        want = np.concatenate((v.mean(axis=0), v.std(axis=0), [np.linalg.norm(v.mean(axis=0))])) if len(v) else np.zeros(quality.FEATURES)
        assert np.allclose(got, want, atol=1e-4)


def test_word_vectors_by_definition(spark):
    texts = [("a b c a",), ("one two three",), ("b c one",), (None,)]
    docs = spark.createDataFrame(texts, "text string").repartition(2)
    table = quality.word_vectors(docs)
    total = np.zeros((quality.ROWS, quality.SIZE), np.int32)
    for (t,) in texts:
        h = word_hashes((t or "").encode())
        if len(h):
            quality.add_contexts(total, h, np.zeros(len(h), np.int64))
    seen = total.any(axis=1)
    x = quality.unit(total[seen].astype(np.float32))
    x = x - x.mean(axis=0)
    x = quality.unit(x)
    x = x - x.mean(axis=0)
    assert np.abs(table[seen] - np.clip(x, -1, 1) * quality.PARTS).max() <= 1 and not table[~seen].any()


def test_training_texts_are_bounded(spark):
    texts = [b"", b"short text", b"w" * 70000, b" ".join(b"word%d" % i for i in range(40000))]
    df = spark.createDataFrame([(bytearray(t),) for t in texts], "t binary")
    got = [bytes(r[0]) for r in df.select(toxicity.stretches(F.col("t"))).collect()]
    assert got[:2] == texts[:2] and all(toxicity.TEXT <= len(g) <= toxicity.TEXT + 64 for g in got[2:])
    assert got[3].startswith(b" word0 word1") and got[3].endswith(texts[3][-100:])


def test_a_labelled_id_with_several_texts_teaches_one_and_the_same(spark):
    docs = spark.createDataFrame([(i % 20, f"text {i}") for i in range(400)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, toxic int")
    found = [sorted((r.doc_id, r.label, bytes(r.text)) for r in training_rows(docs.repartition(n), labels, "toxic", 4, 2, 60).collect()) for n in (1, 3, 7)]
    assert found[0] == found[1] == found[2] and len(found[0]) == len({f[0] for f in found[0]})


def test_temperature():
    rng = np.random.default_rng(2)
    logit = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-logit))).astype(float)
    assert 2.5 < quality.best_temperature(3 * logit, y) < 3.6


def test_training_rows(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(200)] + [(3, "again"), (None, "x")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)] + [(4, 1), (5, None), (None, 1), (999, 1)], "doc_id bigint, toxic int")
    rows = training_rows(docs, labels, "toxic", 4, 2, 60).collect()
    assert len(rows) in (59, 60) and len({r.doc_id for r in rows}) == len(rows) and not [r for r in rows if remainder(r.doc_id, 4) == 2]
    assert all(r.label == (1 if r.doc_id == 4 else r.doc_id % 2) for r in rows)


@pytest.mark.parametrize("fit", [toxicity.fit, quality.fit])
def test_odd_tables(spark, fit):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.1), (2, "b", 0.2), (None, "c", 0.3), (5, "long " * 100000, 0.1)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "doc_id bigint, toxic int, quality int")
    for own in (labels, labels.limit(0)):
        model = fit(docs, own)
        rows = quality.score_documents(docs, model, 4, 2).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
        assert quality.keep_by_score(docs, model, lambda s: s >= 0).count() == 5
        assert quality.score_documents(docs.limit(0), model, 4, 2).collect() == []
    assert fit(docs.limit(0), labels) is not None


@pytest.mark.parametrize(("name", "label", "folds", "fold", "least", "recall"), [("op7_toxicity_bigru", "toxic", 4, 2, 0.97, 0.8), ("op9_random_indexing_quality", "quality", 5, 0, 0.96, 0.98)])
def test_held_out_accuracy(spark, name, label, folds, fold, least, recall):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.queries()[name](spark, SF).collect()
    assert len(rows) == 10000 and all(r.held_out == (remainder(r.doc_id, folds) == fold) and r.predicted == (r.score >= 0.3) for r in rows)
    own = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in own]) >= least
    assert np.mean([p for p, y in own if y == 1]) >= recall
