import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm.bpe import Encoder, Lexicon, compile_lexicon, encode_documents, frequent_pieces, piece_counts, public_vocabulary

SF = "/root/testdata/sf0.01"
ODD = ["", " ", "It's WE'LL 'S don't", "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|end", "é É ǅ İ ẞ ß", "Σίσυφος ΟΔΟΣ", "漢字かな交じり", "\x1c x\x85y\xa0 z w", "١٢٣ ½ 12345", "👍🏽 ok!!", "á ë", " ́x", "x" * 300 + "!" * 99, "ab" * 1000, "​zero﻿", "K Å"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def vocabulary():
    return public_vocabulary()


def lexicon(tmp_path, words, ids_of):
    p = tmp_path / "lexicon.bin"
    p.write_bytes(compile_lexicon(words, ids_of))
    return Lexicon(str(p))


def test_automaton_is_a_minimal_map(tmp_path):
    rng = random.Random(0)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))).encode() for _ in range(3000)}
    held = set(rng.sample(sorted(words), 400))
    ids = {w: [rng.randrange(1000) for _ in range(rng.randint(1, 4))] for w in held}
    lex = lexicon(tmp_path, held, ids.__getitem__)
    assert len(lex) == len(held)
    for w in words:
        got = lex.get(w)
        assert (got is None) == (w not in held)
        if got is not None:
            assert np.frombuffer(got, "<u4").tolist() == ids[w]
    below = {w[:i] for w in held for i in range(len(w) + 1)}
    rights = {frozenset(w[len(p) :] for w in held if w.startswith(p)) for p in below}
    assert lex.states == len(rights)  # one state for each set of right contexts


def test_shared_suffixes(tmp_path):
    assert lexicon(tmp_path, [b"walking", b"talking", b"stalking"], lambda w: [1]).states < 12


@pytest.mark.parametrize("held", [[], [b"don", b"it", b"ok", "é".encode()]])
def test_odd_texts(tmp_path, library, vocabulary, held):
    e = Encoder(vocabulary, lexicon(tmp_path, held, vocabulary.merge))
    for text in ODD:
        want = library.encode(text, add_special_tokens=False).ids
        got = e.encode(text.encode())
        assert np.frombuffer(got, "<u4").tolist() == want, text
        assert e.decode(got).decode() == library.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, vocabulary, text):
    class Nothing:
        @staticmethod
        def get(word):
            return None

    assert np.frombuffer(Encoder(vocabulary, Nothing()).encode(text.encode("utf-8", "ignore")), "<u4").tolist() == library.encode(text.encode("utf-8", "ignore").decode(), add_special_tokens=False).ids


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_rows(spark, library):
    texts = [*enumerate(ODD), (3, "twice"), (3, "twice"), (None, "no id"), (99, None), (100, "very long " * 40000)]
    df = spark.createDataFrame([(d, t, 1) for d, t in texts], "doc_id bigint, text string, n_tokens int")
    want = []
    for d, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    got = [tuple(r) for r in encode_documents(df, size=5).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert encode_documents(df.limit(0)).collect() == []


def test_whole_small_table(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    top = frequent_pieces(docs, 50)
    assert 30 <= len(top) <= 50 and b"the" in top
    counts = {bytes(r.piece): r.n for r in piece_counts(docs).collect()}
    assert min(counts[p] for p in top) > max(n for p, n in counts.items() if p not in set(top))
    assert frequent_pieces(docs, 0) == [] and frequent_pieces(docs.limit(0), 9) == []
    got = {r.doc_id: r.ids_sha256 for r in encode_documents(docs, size=2000).collect()}
    want = {r.doc_id: sha(np.array(library.encode(r.text, add_special_tokens=False).ids, "<u4").tobytes()) for r in docs.collect()}
    assert got == want
