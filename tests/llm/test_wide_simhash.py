import random

import numpy as np

import corpus_pipeline
from plumbline.llm import simhash
from plumbline.llm.simhash import RING, chained, ring_groups, wide_fingerprint
from plumbline.llm.similar import rings
from plumbline.llm.words import mixed
from tests.llm.test_similar import slow_classes

KINDS = "node bigint, ring binary"


def pairs_of(groups):
    members = {}
    for k, node in groups:
        members.setdefault(k, set()).add(node)
    return {(a, b) for own in members.values() for a in own for b in own if a < b}


def test_a_bit_is_one_if_set_in_over_half():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 300, 1001):
        own = rng.integers(0, 1 << 63, n, np.uint64)
        lanes = mixed(own[:, None] ^ simhash._SALT)
        want = [2 * sum(int(x) >> p & 1 for x in lanes[:, lane]) > n for lane in range(RING // 4) for p in range(64)]
        assert np.unpackbits(np.frombuffer(wide_fingerprint(own), np.uint8), bitorder="little").astype(bool).tolist() == want


def test_pairs_at_the_similarity_meet_and_others_do_not(spark):
    rng = np.random.default_rng(2)
    rows, want = [], set()
    for common, a, b in ((4, 0, 1), (5, 0, 1), (6, 1, 0), (8, 1, 1), (8, 2, 0), (40, 5, 5), (80, 20, 0), (400, 50, 50)):
        for _ in range(60):
            own = rng.integers(0, 1 << 63, common + a + b, np.uint64)
            want.add((len(rows), len(rows) + 1))
            rows += [(len(rows), rings(np.sort(own[: common + a]), 0.8)), (len(rows) + 1, rings(np.sort(np.concatenate((own[:common], own[common + a :]))), 0.8))]
    nodes = spark.createDataFrame(rows, KINDS)
    for cell in (simhash.CELL, 1 << 10):  # one cell a start, and many
        got = [tuple(r) for r in ring_groups(nodes, cell).collect()]
        assert pairs_of(got) == want and len(got) == len({node for _, node in got})
    assert ring_groups(nodes.limit(0)).collect() == []
    assert rings(np.arange(3, dtype=np.uint64), 0.8) == b""


def test_groups_of_a_key_are_those_that_chains_join():
    rng = random.Random(3)
    for many in (1000, 100, 1):  # compared step by step, both ways, one by one
        key, chain = [], []
        for k in range(6):
            heads = [rng.getrandbits(64) for _ in range(5)]
            for _ in range(rng.randint(20, 300)):
                x = rng.choice(heads + chain[-9:])
                for p in rng.sample(range(64), rng.randint(0, 24)):
                    x ^= 1 << p
                key.append(k)
                chain.append(x)
        root = list(range(len(key)))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for i in range(len(key)):
            for j in range(i):
                if key[i] == key[j] and (chain[i] ^ chain[j]).bit_count() <= 15:
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
        assert chained(np.array(key, np.uint16), np.array(chain, np.uint64), many).tolist() == [find(i) for i in range(len(key))]


def test_the_stage_keeps_the_representatives_of_small_and_crowded_sets(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(40):  # four of five shingles are common
        words = [f"w{rng.randrange(10**9)}" for _ in range(9)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[:8]))]
    base = [f"b{i}" for i in range(150)]
    for _ in range(250):  # one clump, by few words
        text = list(base)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((len(rows), " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(kept) == sorted({root for _, root in slow_classes(rows)})
