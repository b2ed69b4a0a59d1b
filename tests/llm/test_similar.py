import random

import corpus_pipeline
from plumbline.llm.simhash import shingle_hashes
from plumbline.llm.similar import similar_classes

SF = "/root/testdata/sf0.1"


def slow_classes(rows, width=5, least=0.8):
    """Classes of all pairs, found over an inverted list of the shingles."""
    sets = [set(shingle_hashes((t or "").encode(), width)) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    seen, first, counts = {}, {}, {}
    for own in sets:
        for g in own:
            counts[g] = counts.get(g, 0) + 1
    for i, own in enumerate(sets):
        j = first.setdefault(frozenset(own), i)
        if i != j:
            parent[find(i)] = find(j)
            continue
        # a pair this similar shares one of the rarest fifth, and one more, of each set's shingles
        rare = sorted(own, key=lambda g: (counts[g], g))[: len(own) - int(least * len(own)) + 1]
        for j in {j for g in rare for j in seen.get(g, ())}:
            common = len(own & sets[j])
            if common >= least * (len(own) + len(sets[j]) - common) - 1e-9:
                parent[find(i)] = find(j)
        for g in rare:
            seen.setdefault(g, []).append(i)
    names = {}
    for i, (d, _) in enumerate(rows):
        names[find(i)] = min(d, names.get(find(i), d))
    return {(d, names[find(i)]) for i, (d, _) in enumerate(rows)}


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {tuple(r) for r in similar_classes(docs).collect()} == slow_classes(rows)


def test_chains_and_large_groups(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = [(1000, None), (1001, " \n"), (1002, "two words"), (1003, "Two  WORDS")]
    base = [word() for _ in range(120)]
    for _ in range(150):  # near copies, some only reachable over others
        text = list(base)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = word()
        rows.append((len(rows), " ".join(text)))
    chain = [word() for _ in range(200)]
    for i in range(12):
        rows.append((len(rows), " ".join(chain[i * 8 : i * 8 + 100])))
    rows += [(len(rows) + i, " ".join(word() for _ in range(rng.randint(1, 80)))) for i in range(60)]
    got = similar_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {tuple(r) for r in got} == slow_classes(rows) and len(got) == len(rows)


def test_parts_of_a_large_bucket(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(120):
        text = list(base)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(90)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for weight in (500, 3000, 10**6):
        assert {tuple(r) for r in similar_classes(df, weight=weight).collect()} == slow_classes(rows)


def test_stage_finds_similar_texts(spark):
    words = [f"w{i * i}" for i in range(200)]
    texts = [" ".join(words), " ".join([*words[:100], "changed", *words[101:]]), " ".join([*words[:60], *(f"v{i}" for i in range(60)), *words[120:]])]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id bigint, text string, more int")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()) == [0, 2]
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), SF).collect() == []
