import math

import numpy as np

from plumbline.llm.permutation_index import Shard, nearest_pivots, raised, search

SF = "/root/testdata/sf0.1"


def brute(rows, queries, k):
    """Each different usable (id, vector) of the queries against every row but one that equals it."""
    usable = lambda i, v: i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    own = [(i, tuple(v)) for i, v in rows if usable(i, v)]
    out = []
    for q in sorted({(i, tuple(v)) for i, v in queries if usable(i, v)}):
        others = list(own)
        others.remove(q)
        best = sorted((-sum(a * b for a, b in zip(q[1], v)), i) for i, v in others)[:k]
        out += [(q[0], r, i) for r, (_, i) in enumerate(best, 1)]
    return sorted(out)


def test_footrule_by_definition():
    rng = np.random.default_rng(0)
    x, pivots = rng.normal(size=(60, 5)), rng.normal(size=(12, 6))
    shard = Shard(np.arange(60), x, pivots, 4, 9.0)
    near = nearest_pivots(raised(shard.x, 9.0), pivots, 4)
    q = nearest_pivots(np.concatenate((x[:1], [[0.0]]), axis=1), pivots, 4)[0]
    place = lambda order, p: list(order).index(p) if p in order else 4
    assert shard.footrule(q).tolist() == [sum(abs(place(q, p) - place(v, p)) for p in set(q) | set(v)) for v in near]


def test_odd_rows_exactly(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(80)]
    rows += [(200 + i, [1.0, 2.0, 3.0, 0.0]) for i in range(40)] + [(100, None), (101, [0.0] * 4), (102, [1.0, None, 0.0, 0.0]), (103, [float("nan")] * 4), (104, [float("inf"), 0.0, 0.0, 0.0]), (105, [1.0]), (None, [1.0] * 4), (200, [1.0, 2.0, 3.0, 0.0]), (106, []), (7, [9.0, 9.0, 9.0, 9.0]), (20, [2.0, 9.0, 0.0, 1.0]), (20, [2.0, 9.0, 0.0, 1.0]), (3, [1.0, 0.0, 0.0, 0.0]), (3, [9.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id bigint, embedding array<float>, s int, rank string")
    queries = df.where("vec_id % 20 = 0")
    kept = [r for r in rows if r[1] is None or len(r[1]) == 4]
    want = brute(kept, [r for r in kept if r[0] is not None and r[0] % 20 == 0], 20)
    for shard, block in ((8192, 65536), (30, 3)):
        got = sorted((r.query_id, r["rank"], r.vec_id) for r in search(df, queries, shard=shard, block=block, share=1.0).collect())
        assert got == want
    assert search(df.limit(0), queries).collect() == []
    assert search(df, queries.limit(0)).collect() == []
    few = search(df.where("vec_id in (0, 1, 2)"), queries.where("vec_id = 0")).collect()
    assert sorted((r.query_id, r["rank"]) for r in few) == [(0, 1), (0, 2)]


def test_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.collect()
    x, ids = np.array([r.embedding for r in rows], np.float64), np.array([r.vec_id for r in rows])
    got = search(df, df.where("vec_id % 20 = 0")).collect()
    hits = total = 0
    for q in sorted({r.query_id for r in got}):
        at = int(np.flatnonzero(ids == q)[0])
        score = x @ x[at]
        order = [int(ids[i]) for i in np.lexsort((ids, -score)) if i != at][:20]
        mine = [r for r in got if r.query_id == q]
        assert sorted(r["rank"] for r in mine) == list(range(1, 21))
        hits, total = hits + len(set(order) & {r.vec_id for r in mine}), total + 20
        for r in mine:
            assert abs(r.score - score[int(np.flatnonzero(ids == r.vec_id)[0])]) < 1e-12
    assert total == 20 * sum(ids % 20 == 0) and hits / total >= 0.95
