import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm.packing import BALANCED, Limits, cut_lengths, pack_documents, place, plan, public_byte_bpe

SF = "/root/testdata/sf0.01"


def check_plan(counts, limits):
    p = plan(counts, limits)
    bins = defaultdict(list)
    for length, n in counts.items():
        if n:
            seq, off = place(p, np.full(n, length), np.arange(n))
            for s, o in zip(seq.tolist(), off.tolist(), strict=True):
                bins[s].append((o, length))
    assert sorted(bins) == list(range(p.sequences))
    for items in bins.values():
        at = 0
        for o, length in sorted(items):
            assert o == at
            at += length
        assert at <= limits.tokens and len(items) <= limits.documents and sum(x * x for _, x in items) <= limits.cost
    return p


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(0, 40)), st.integers(1, 6), st.sampled_from(["norm", "dot"]), st.integers(1024, 1400))
def test_plan_keeps_every_capacity(counts, documents, rule, cost):
    check_plan(counts, Limits(tokens=32, documents=documents, cost=cost, rule=rule))


def test_plan_is_tight():
    rng = np.random.default_rng(0)
    counts = Counter(rng.integers(1, 1025, 20000).tolist())
    p = check_plan(dict(counts), Limits())
    assert p.sequences <= 1.005 * -(-sum(k * v for k, v in counts.items()) // 1024) + 1


def slow_plan(counts, limits):
    """Vector best-fit, a piece at a time."""
    caps = np.array([limits.tokens, limits.documents, limits.cost], float)
    bins = []
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        need = np.array([length, 1, length * length])
        best = None
        for b in bins:
            if (b >= need).all():
                score = float(((b - need) ** 2 / caps**2 * limits.weights).sum()) if limits.rule == "norm" else -float((b * need / caps**2 * limits.weights).sum())
                best = (score, id(b), b) if best is None or score < best[0] else best
        if best is None:
            best = (0, 0, caps.copy())
            bins.append(best[2])
        best[2][:] -= need
    return len(bins)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 16), st.integers(0, 25)), st.integers(1, 6), st.sampled_from(["norm", "dot"]), st.integers(256, 500))
def test_plan_under_binding_limits(counts, documents, rule, cost):
    limits = Limits(tokens=32, documents=documents, cost=cost, rule=rule, longest=16)
    p = check_plan(counts, limits)
    assert p.sequences <= 1.25 * slow_plan(counts, limits) + 2


def test_every_capacity_binds():
    rng = np.random.default_rng(0)
    counts = dict(Counter(np.minimum(1024, rng.geometric(0.004, 20000)).tolist()))
    p = plan(counts, BALANCED)
    bins = defaultdict(list)
    for length, n in counts.items():
        for s in place(p, np.full(n, length), np.arange(n))[0].tolist():
            bins[s].append(length)
    full = Counter("documents" if len(x) == 8 else "cost" if sum(i * i for i in x) > 0.9 * BALANCED.cost else "tokens" if sum(x) > 0.95 * 2048 else "" for x in bins.values())
    assert min(full[c] for c in ("documents", "cost", "tokens")) > 10, full


def test_limits_are_checked():
    for bad in (Limits(tokens=0), Limits(cost=5), Limits(rule="x")):
        with pytest.raises(ValueError):
            plan({1: 1}, bad)


def test_cut_lengths():
    assert cut_lengths(1024, 1024) == [(0, 1024)]
    assert cut_lengths(2048, 1024) == [(0, 1024), (1024, 1024)]
    assert cut_lengths(2050, 1024) == [(0, 2), (2, 1024), (1026, 1024)]


def test_ids_equal_the_tokenizers_library():
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mine = public_byte_bpe()
    for text in ["", " ", "\n\n x", "it's we'll 'S", "a<|endoftext|>b", "é ü ß ÀŸ", "漢字かな", "\x1c x\x85y\xa0 z", "١٢٣ ½", "👍🏽 ok", "é", "a  \t b" * 50, "x" * 3000]:
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def packed(df, **kw):
    return [r.asDict() for r in pack_documents(df, **kw).collect()]


def verify(rows, texts, limits):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_seq, n = defaultdict(list), Counter()
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        n[r["doc_id"]] += 1
    for items in by_seq.values():
        at = 0
        for o, length in sorted(items):
            assert o == at
            at += length
        assert at <= limits.tokens and len(items) <= limits.documents
    want = Counter()
    for d, t in texts:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        for k, (s, length) in enumerate(cut_lengths(len(ids), limits.tokens)):
            want[d, k, s, length, zlib.crc32(np.array(ids[s : s + length], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want


def test_odd_rows(spark):
    texts = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "no id"), (4, "word " * 5000), (5, "tie"), (6, "tie")]
    df = spark.createDataFrame([(d, t, "z") for d, t in texts], "doc_id bigint, text string, rank string")
    for limits in (Limits(), Limits(tokens=64, documents=2, cost=4096)):
        verify(packed(df, limits=limits), texts, limits)
    assert packed(df.limit(0)) == []
    none = packed(df.where("doc_id = 2"), end=None)
    assert [(r["length"], r["sequence_id"]) for r in none] == [(0, None)]


def test_the_same_pieces_under_other_limits(spark):
    texts = [(i, "word " * (i * 37 % 1500)) for i in range(120)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    rows = packed(df, also={"balanced": BALANCED})
    verify(rows, texts, Limits())
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r["balanced_sequence_id"]].append((r["balanced_offset"], r["length"]))
    for items in by_seq.values():
        lengths = [n for _, n in sorted(items)]
        assert [o for o, _ in sorted(items)] == [sum(lengths[:i]) for i in range(len(lengths))]
        assert sum(lengths) <= 2048 and len(lengths) <= 8 and sum(n * n for n in lengths) <= BALANCED.cost
    with pytest.raises(ValueError):
        packed(df, also={"odd": Limits(tokens=64, cost=4096)})


def test_whole_small_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    rows = packed(docs)
    verify(rows, texts, Limits())
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= 1.01 * -(-total // 1024) + 1
