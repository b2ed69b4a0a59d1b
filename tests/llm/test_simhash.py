import random

import xxhash

from plumbline.llm.simhash import chain_mask, near_duplicates, segments

SF = "/root/testdata/sf0.01"


def slow_fingerprint(text, width=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(n)]
    return sum(1 << p for p in range(64) if 2 * sum(h >> p & 1 for h in hashes) > n)


def slow_classes(rows, radius=2):
    fps = [slow_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(df, **kw):
    return sorted((tuple(r[c] for c in ("doc_id", "fingerprint", "component_id")) for r in near_duplicates(df, **kw).collect()), key=str)


def near_copies(n, seed):
    rng = random.Random(seed)
    base = [rng.choice("abcdefghijklmnop") * rng.randint(1, 5) for _ in range(400)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = "edit%d" % rng.randrange(50)
        out.append(" ".join(w))
    return out


def test_against_all_pairs_with_odd_rows(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "A b", "a B", "one", "one two three", "One Two Three", "\x1c\x1d", "é ß 漢字"] + near_copies(150, 2) + near_copies(60, 3)
    texts += [" ".join(rng.choice("uvwxyz") for _ in range(rng.randint(1, 30))) for _ in range(100)] + ["long " * 30000]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(5, "one"), (5, "one"), (None, "only without id"), (None, "one")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = slow_classes(rows)
    assert got(df, crowded=1) == want
    assert got(df, crowded=16) == want
    assert got(df, crowded=10**9) == want


def test_other_radii(spark):
    texts = near_copies(80, 5) + [f"text {i % 40} of some words {i}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for radius in (1, 3, 5):
        assert got(df, radius=radius) == slow_classes(list(enumerate(texts)), radius)


def test_the_ring_misses_no_pair_within_the_radius():
    rng = random.Random(0)
    for radius in (1, 2, 3, 8):
        ring = segments(radius)
        equal = (len(ring) - 1) // radius
        for _ in range(300):
            diff = 0
            for p in rng.sample(range(64), rng.randint(0, radius)):
                diff |= 1 << p
            assert any(all((diff & chain_mask(ring, i, n)).bit_count() <= n * radius // len(ring) for n in range(equal, len(ring) + 1)) for i in range(len(ring)))


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, fp string, component_id string, fingerprint int")
    assert near_duplicates(df).collect() == []
    df = spark.createDataFrame([(1, "x y", "a", "b", 1)], "doc_id bigint, text string, fp string, component_id string, fingerprint int")
    assert [r.component_id for r in near_duplicates(df).collect()] == [1]


def test_whole_small_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(docs) == slow_classes([(r.doc_id, r.text) for r in docs.collect()])
