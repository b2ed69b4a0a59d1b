"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

Word pieces of the whole corpus are counted; the most frequent become a minimal
acyclic automaton whose states share suffixes. Every edge carries how many words
sort before it below its state, so that a walk that ends in a final state has
summed up the word's rank, and the rank's ids are the output. The automaton is one
file of plain arrays that each worker maps into memory. A piece that it doesn't hold
is merged exactly, by the vocabulary's merge ranks. In front of it a worker keeps the ids
of words and pieces met lately, KEPT of each at most.

Null texts are empty texts, which have no ids and decode to the empty string.
Rows with equal doc_id each get a row; an empty table gives no rows. Very long texts are
encoded whole, one at a time. Other columns have no effect, whatever their names. The lexicon's
size (LEXICON) bounds only the automaton: it changes speed, never ids.
"""

from __future__ import annotations

import atexit
import hashlib
import heapq
import json
import mmap
import re
import struct
import unicodedata
import uuid
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import as_bytes, chunks, removed, shared_dir, stored

#: Words that are compiled, at most.
LEXICON = 65_536
#: Distinct words that a task keeps at a time, with ids (when encoding) or counts (when counting).
MEMO = 300_000
#: Distinct words, and distinct pieces of words, whose ids an encoder keeps at a time.
KEPT = 500_000
#: Symbols from which on a word is merged with a heap.
LONG = 40
#: Fixed value: the split pattern of the public word vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
#: Characters that all Unicode versions and libraries treat alike.
PLAIN = re.compile("[\x21-\x7e\xa1-ɏ]*").fullmatch


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return {b: chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)}


#: Most words: letters of ASCII, and perhaps marks after them.
SIMPLE = re.compile(rb"([A-Za-z]+)([.,;:!?]*)").fullmatch
#: Bits of a symbol in a number of two, and what no pair's rank reaches.
BITS = 20
MASK, NONE = (1 << BITS) - 1, 1 << 3 * BITS


class Vocabulary:
    """What a tokenizers file says: special strings, normal form, split, ids and merges."""

    def __init__(self, json_path: str):
        import regex
        from tokenizers import Tokenizer

        with open(json_path, encoding="utf-8") as f:
            said = json.load(f)
        model = said["model"]
        whole = Tokenizer.from_file(json_path)
        self.normal, self.parts = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        self.split = regex.compile(PATTERN).findall
        ids, end = model["vocab"], model["end_of_word_suffix"]
        chars = byte_characters()
        self.byte_of = {c: b for b, c in chars.items()}
        self.inner = [ids[chars[b]] for b in range(256)]
        self.last = [ids[chars[b] + end] for b in range(256)]
        self.merges = {}  # both symbols in one number: rank and new symbol in one number
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(ids[a] << BITS | ids[b], rank << BITS | ids[a + b])
        self.special = {x["content"]: x["id"] for x in said["added_tokens"]}
        self.cut = re.compile("|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)).encode() or rb"(?!)")
        tokens = {v: k for k, v in ids.items()} | {v: k for k, v in self.special.items()}
        self.tokens = [tokens.get(i, "").encode() for i in range(max(tokens) + 1)]

    def pieces(self, word: bytes) -> list[bytes]:
        """Normalised pieces of a run without ASCII white space, as UTF-8."""
        if simple := SIMPLE(word):  # letters, then marks that stay together
            letters, marks = simple.groups()
            return [letters.lower(), marks] if marks else [letters.lower()]
        text = word.decode("utf-8")
        if PLAIN(text):
            text = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()
            return [p.encode() for p in self.split(text)]
        return [bytes(map(self.byte_of.__getitem__, p)) for p, _ in self.parts(self.normal(text))]

    def merge(self, piece: bytes) -> list[int]:
        """Exact ids: the pair of least rank merges first, the leftmost among equals."""
        symbols = [self.inner[b] for b in piece[:-1]]
        symbols.append(self.last[piece[-1]])
        if len(symbols) >= LONG:
            return self._merge_long(symbols)
        get = self.merges.get
        found = [get(a << BITS | b, NONE) for a, b in zip(symbols, symbols[1:])]
        while found and (best := min(found)) != NONE:
            i = found.index(best)
            symbols[i : i + 2] = [best & MASK]
            del found[i]
            if i < len(found):
                found[i] = get(symbols[i] << BITS | symbols[i + 1], NONE)
            if i:
                found[i - 1] = get(symbols[i - 1] << BITS | symbols[i], NONE)
        return symbols

    def _merge_long(self, symbols: list[int]) -> list[int]:
        get = self.merges.get
        after = [*range(1, len(symbols)), -1]
        before = [*range(-1, len(symbols) - 1)]
        heap = [(m >> BITS, i, m & MASK, symbols[i], symbols[i + 1]) for i in range(len(symbols) - 1) if (m := get(symbols[i] << BITS | symbols[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j] = new, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) >= 0 and (m := get(symbols[left] << BITS | symbols[right], NONE)) != NONE:
                    heapq.heappush(heap, (m >> BITS, left, m & MASK, symbols[left], symbols[right]))
        return [s for s in symbols if s >= 0]


def public_vocabulary() -> Vocabulary:
    import public_tokenizers

    return Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def compile_lexicon(words: Iterable[bytes], ids_of) -> bytes:
    """The automaton's file for distinct words; ids_of(word) gives its ids.

    Sorted words are added one by one; what can't change any more is replaced by an
    equal state that already stands (Daciuk et al., "Incremental construction of
    minimal acyclic finite-state automata").
    """
    words = sorted(set(words))
    states: dict[tuple, int] = {}
    kept: list[tuple] = []
    path: list[list] = [[False, []]]  # final, [(byte, state)] of the last word's states; the last edge is still open
    labels: list[int] = []

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            final, edges = path.pop()
            key = (final, tuple(edges))
            if key not in states:
                states[key] = len(kept)
                kept.append(key)
            path[-1][1].append((labels.pop(), states[key]))

    for word in words:
        same = 0
        while same < len(labels) and same < len(word) and labels[same] == word[same]:
            same += 1
        settle(same)
        for b in word[same:]:
            labels.append(b)
            path.append([False, []])
        path[-1][0] = True
    settle(0)
    kept.append((path[0][0], tuple(path[0][1])))
    size: list[int] = []
    first, label, target, skip = array("i", [0]), bytearray(), array("i"), array("i")
    for final, edges in kept:
        n = int(final)
        for b, to in edges:
            label.append(b)
            target.append(to)
            skip.append(n)
            n += size[to]
        size.append(n)
        first.append(len(label))
    starts, out = array("i", [0]), array("i")
    for word in words:
        out.extend(ids_of(word))
        starts.append(len(out))
    finals = bytes(int(final) for final, _ in kept)
    parts = [first.tobytes(), target.tobytes(), skip.tobytes(), starts.tobytes(), out.tobytes(), bytes(label), finals]
    head = struct.pack("<8q", len(kept), *(len(p) for p in parts))
    return head + b"".join(parts)


class Lexicon:
    """A compiled lexicon, mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n, *lengths = struct.unpack_from("<8q", self.map)
        at, views = struct.calcsize("<8q"), []
        for length in lengths:
            views.append((at, at + length))
            at += length
        whole = memoryview(self.map)
        self.first, self.target, self.skip, self.starts = (whole[a:b].cast("i") for a, b in views[:4])
        self.ids = whole[slice(*views[4])]
        self.label_at, self.finals = views[5][0], whole[slice(*views[6])]
        self.states, self.root = n, n - 1
        self.find = self.map.find

    def __len__(self) -> int:
        return len(self.starts) - 1

    def get(self, word: bytes) -> bytes | None:
        """The word's ids as little-endian uint32 bytes, None if it isn't held."""
        state, rank, base = self.root, 0, self.label_at
        first, find = self.first, self.find
        for i in range(len(word)):
            at = find(word[i : i + 1], base + first[state], base + first[state + 1]) - base
            if at < 0:
                return None
            rank += self.skip[at]
            state = self.target[at]
        if not self.finals[state]:
            return None
        return bytes(self.ids[4 * self.starts[rank] : 4 * self.starts[rank + 1]])


class Encoder(dict):
    """Ids of texts: words by memo, lexicon or exact merging. As a dict: a word's ids, as bytes."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        super().__init__()
        self.vocabulary, self.lexicon, self.parts = vocabulary, lexicon, {}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= KEPT:
            self.clear()
        known = self.parts
        if simple := SIMPLE(word):  # its letters, in lower case, are a word themselves
            letters, marks = simple.groups()
            low = letters.lower()
            found = self._ids(word) if low == word else self[low] + (known.get(marks) or self._piece(marks)) if marks else self[low]
        else:
            found = b"".join([known.get(p) or self._piece(p) for p in self.vocabulary.pieces(word)])
        self[word] = found
        return found

    def _ids(self, piece: bytes) -> bytes:
        return self.lexicon.get(piece) or array("I", self.vocabulary.merge(piece)).tobytes()

    def _piece(self, piece: bytes) -> bytes:
        if len(self.parts) >= KEPT:
            self.parts.clear()
        found = self.parts[piece] = self._ids(piece)
        return found

    def encode(self, text: bytes) -> bytes:
        v = self.vocabulary
        if b"<|" not in text or not v.cut.search(text):
            return b"".join(map(self.__getitem__, text.split()))
        out, at = [], 0
        for m in v.cut.finditer(text):
            out += map(self.__getitem__, text[at : m.start()].split())
            out.append(struct.pack("<I", v.special[m[0].decode()]))
            at = m.end()
        return b"".join([*out, *map(self.__getitem__, text[at:].split())])

    def decode(self, ids: bytes) -> bytes:
        return b" ".join(map(self.vocabulary.tokens.__getitem__, array("I", ids)))


def piece_counts(docs: DataFrame, text_col: str = "text", vocabulary=public_vocabulary) -> DataFrame:
    """(piece, n) over all texts; n counts every occurrence. Each task sums its own before the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, words = vocabulary(), Counter()

        def flush() -> pa.RecordBatch:
            pieces: Counter = Counter()
            for word, n in words.items():
                for p in v.pieces(word):
                    pieces[p] += n
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(pieces.keys(), pa.binary()), pa.array(pieces.values(), pa.int64())], ["piece", "n"])

        for b in chunks(batches):
            for text in b.column(0).to_pylist():
                words.update((v.cut.sub(b" ", text) if b"<|" in text else text).split())
            if len(words) >= MEMO:
                yield flush()
        yield flush()

    partial = docs.select(as_bytes(text_col).alias("data")).mapInArrow(run, "piece binary, n bigint")
    return partial.groupBy("piece").agg(F.sum("n").alias("n"))


def frequent_pieces(docs: DataFrame, size: int, text_col: str = "text", vocabulary=public_vocabulary) -> list[bytes]:
    """The most frequent pieces of all texts, at most `size`, none that occurs once.

    Pieces are taken by classes of count, a sixteenth of a power of two wide, as long
    as whole classes fit. So the driver gets a row a class (some 1,000) and then the
    pieces themselves, and no partition sends more than it holds of these.
    """
    counted = stored(piece_counts(docs, text_col, vocabulary).where("n > 1").withColumn("class", F.floor(F.log2("n") * 16).cast("int")))
    classes = sorted(((r["class"], r["count"]) for r in counted.groupBy("class").count().collect()), reverse=True)
    least, total = None, 0
    for c, n in classes:
        total += n
        if total > size:
            break
        least = c
    if least is None:
        return []
    return sorted(bytes(r.piece) for r in counted.where(F.col("class") >= least).select("piece").collect())


def sent_file(spark: SparkSession, data: bytes) -> str:
    """Leave data as a file in the shared folder, from which every executor gets a copy; returns its name. It goes when the program ends."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = f"{shared_dir(spark).rstrip('/')}/lexicons/{name}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    out.write(data)
    out.close()
    atexit.register(removed, spark, path)
    spark.sparkContext.addFile(path)
    return name


def encode_documents(docs: DataFrame, size: int = LEXICON, id_col: str = "doc_id", text_col: str = "text", vocabulary=public_vocabulary, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs, and with_ids also ids (uint32 bytes) and decoded."""
    v = vocabulary()
    data = compile_lexicon(frequent_pieces(docs, size, text_col, vocabulary), v.merge)
    name = sent_file(docs.sparkSession, data)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(vocabulary(), Lexicon(SparkFiles.get(name)))
        for b in chunks(batches):
            ids = [e.encode(x) for x in b.column(1).to_pylist()]
            decoded = [e.decode(x) for x in ids]
            arrays = [b.column(0), pa.array(np.fromiter(map(len, ids), np.int64, len(ids)) // 4), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in decoded])]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays, names = [*arrays, pa.array(ids, pa.binary()), pa.array([x.decode() for x in decoded])], [*names, "ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), as_bytes(text_col).alias("data")).mapInArrow(run, schema)
