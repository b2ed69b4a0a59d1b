"""N-gram perplexity rule: a modified Kneser-Ney model of word pairs, counted by Spark.

Three passes read the texts. The first counts words and their symbols over all
documents; the VOCABULARY most frequent words become the vocabulary, and the others are
one unknown word, spelled by the model of symbols (see spelling.py). The second counts
all word pairs. The third scores.

The model of pairs grows with the corpus and is never in one place. It lies in the
shared folder as sorted arrays of keys and counts, one for each bucket of a grid: a
pair's row of the grid goes by its first word and its column by its second, so a
frequent word's pairs are spread over a whole row or column. Discounts, the words'
totals and numbers of left contexts are bounded by the vocabulary and are broadcast;
so are the pairs that hold at least a SHARE of all words, of which there are 1 / SHARE
at most. Scoring tasks sum up those themselves. The other pairs, each rarer than that,
are sent to their buckets with the documents that hold them, and sums come back.

A document doesn't vouch for itself: its own pairs are taken off the counts that score
it. Its perplexity is exp(-mean log probability of its words), with an unknown word's
spelling; its spelling perplexity is that of all its words' symbols. Each language has
a band for both: fences of the quartiles over its documents that the base rules keep.
The lower fence of the first stands far off, as copies in the corpus do vouch for each
other. A document outside either band is rejected.

Null texts are empty; a document without words has no perplexity and fails the base
rules. Null languages are one language. Rows with equal doc_id each get a row. An
empty table gives no rows. Columns of docs other than the three named have no effect,
whatever their names. Very long texts are read in blocks. Equal words are told by
64-bit hashes. A repeated task must get its rows in the same order, as it does from
files; store a table whose order may change.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.arrays import Found, packed, packed_sorted, starts, totals, unpacked, unpacked_sorted
from plumbline.llm.common import CONTINUATION, WHITE, as_bytes, buckets_for, chunks, stored
from plumbline.llm.spelling import Spelling, discounts, estimate, grams
from plumbline.llm.words import blocks, hashes, mixed

SYMBOLS = b"#*$%&|<>"
#: Words of the vocabulary at most, and how often each is found at least.
VOCABULARY, LEAST = 1 << 16, 3
#: Numbers of a word that isn't in the vocabulary and of a text's edge; the vocabulary's start after them.
UNKNOWN, BEFORE, WORDS = 0, 1, 2
#: Bits of a word's number in a pair.
WIDE = 17
#: Pairs with this share of all words are scored where the text is.
SHARE = 1 / (1 << 17)
#: Numbers that a task keeps before it sends them on, and documents of a block.
KEEP, DOCUMENTS = 1 << 20, 1 << 16
#: Fences in interquartile ranges below and above the quartiles: of words and of symbols. MARGIN, in log perplexity, is the least such range.
FENCES, MARGIN = {"words": (8.0, 2.0), "symbols": (2.5, 2.5)}, 0.005


def dealt(bucket: np.ndarray, *values: np.ndarray) -> Iterator[tuple[int, ...]]:
    """(bucket, its part of each of the values, in their order) for each bucket found."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    at = starts(bucket)
    values = [v[order] for v in values]
    for lo, hi in zip(at, np.append(at, len(bucket))[1:], strict=True):
        yield int(bucket[lo]), *(v[lo:hi] for v in values)


class Sums:
    """Counts by number, joined now and then."""

    def __init__(self):
        self.keys, self.counts, self.size, self.settled = [], [], 0, 0

    def add(self, keys: np.ndarray) -> None:
        keys = np.sort(keys)
        at = starts(keys)
        self.keys.append(keys[at])
        self.counts.append(np.diff(np.append(at, len(keys))))
        self.size += len(at)
        if self.size > 2 * self.settled + KEEP // 4:
            self.settle()

    def settle(self) -> None:
        if self.keys:
            keys, counts = totals(np.concatenate(self.keys), np.concatenate(self.counts))
            self.keys, self.counts, self.size, self.settled = [keys], [counts], len(keys), len(keys)

    def full(self) -> bool:
        return self.settled >= KEEP

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.settle()
        out = (self.keys[0], self.counts[0]) if self.keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.__init__()
        return out


SENT = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
SENT_SQL = "kind int, bucket int, keys binary, counts binary"


def sent_sums(kind: int, sums: Sums, bucket) -> Iterator[pa.RecordBatch]:
    keys, counts = sums.take()
    rows = [(kind, b, packed_sorted(k), packed(n)) for b, k, n in dealt(bucket(keys), keys, counts)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SENT.types, strict=True)], schema=SENT)


def _joined(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([unpacked_sorted(k) for k in group["keys"].to_pylist()])
    return totals(keys, np.concatenate([unpacked(c) for c in group["counts"].to_pylist()]).astype(np.int64))


def word_and_gram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, key, n): counts of the grams of symbols (0) and, from LEAST on, of the words by their hashes (1)."""
    n = buckets_for(docs)
    bits = np.uint64(64 - (n.bit_length() - 1))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, symbols = Sums(), Sums()
        by_lead = lambda k: (k >> bits).astype(np.int32) if n > 1 else np.zeros(len(k), np.int32)
        for b in chunks(batches):
            for data, start, end, _ in blocks(b.column(0).to_pylist()):
                words.add(hashes(data, start, end))
                symbols.add(grams(data, start, end)[0].astype(np.uint64))
            if words.full():
                yield from sent_sums(1, words, by_lead)
        yield from sent_sums(1, words, by_lead)
        yield from sent_sums(0, symbols, lambda k: (k % np.uint64(n)).astype(np.int32))

    def merge(group: pa.Table) -> pa.Table:
        keys, counts = _joined(group)
        kind = group["kind"][0].as_py()
        if kind:
            keys, counts = keys[counts >= LEAST], counts[counts >= LEAST]
        return pa.table({"kind": pa.array(np.full(len(keys), kind, np.int32)), "key": pa.array(keys.view(np.int64)), "n": pa.array(counts)})

    sent = docs.select(as_bytes(text_col).alias("data")).mapInArrow(run, SENT_SQL)
    return sent.groupBy("kind", "bucket").applyInArrow(merge, "kind int, key bigint, n bigint")


def vocabulary(counts: DataFrame, most: int = VOCABULARY) -> np.ndarray:
    """The hashes, ascending, of the most frequent words: all of a class of counts, or none of it. At most `most`."""
    found = counts.where("kind = 1").withColumn("c", F.floor(F.log2("n") * 16).cast("int"))
    sizes = {r.c: r["count"] for r in found.groupBy("c").count().collect()}  # under 1,024 classes
    least, room = None, most
    for c in sorted(sizes, reverse=True):
        room -= sizes[c]
        if room < 0:
            break
        least = c
    if least is None:
        return np.zeros(0, np.uint64)
    return np.sort(found.where(F.col("c") >= least).select("key").toArrow()["key"].to_numpy().view(np.uint64))


@dataclass
class Vocabulary:
    found: Found

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Number of each word, UNKNOWN for others."""
        at = self.found(h)
        return np.where(at >= 0, at + WORDS, UNKNOWN)

    def __len__(self) -> int:
        return len(self.found.hashes) + WORDS


def pairs(ids: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The pair that ends in each word, of the words of texts one after another."""
    first = np.empty(len(ids), np.int64)
    first[1:] = ids[:-1]
    first[starts(of)] = BEFORE
    return (first << WIDE | ids).astype(np.uint64)


@dataclass
class Grid:
    """Rows by the first word, columns by the second."""

    rows: int
    columns: int

    def __call__(self, key: np.ndarray) -> np.ndarray:
        first, second = key >> np.uint64(WIDE), key & np.uint64((1 << WIDE) - 1)
        return (first % np.uint64(self.rows) * np.uint64(self.columns) + second % np.uint64(self.columns)).astype(np.int32)


def grid_for(docs: DataFrame) -> Grid:
    bits = buckets_for(docs).bit_length() - 1
    return Grid(1 << bits // 2, 1 << (bits - bits // 2))


def pair_counts(docs: DataFrame, words: Vocabulary, grid: Grid, text_col: str = "text") -> DataFrame:
    """(bucket, keys, counts): the sorted arrays of each bucket."""
    known = docs.sparkSession.sparkContext.broadcast(words)  # bounded by VOCABULARY

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for b in chunks(batches):
            parts = [(known.value(hashes(data, start, end)), of) for data, start, end, of in blocks(b.column(0).to_pylist())]
            if parts:
                sums.add(pairs(*(np.concatenate(x) for x in zip(*parts, strict=True))))
            if sums.full():
                yield from sent_sums(0, sums, grid)
        yield from sent_sums(0, sums, grid)

    def merge(group: pa.Table) -> pa.Table:
        keys, counts = _joined(group)
        return pa.table({"bucket": group["bucket"][:1], "keys": pa.array([packed_sorted(keys)], pa.binary()), "counts": pa.array([packed(counts)], pa.binary())})

    sent = docs.select(as_bytes(text_col).alias("data")).mapInArrow(run, SENT_SQL)
    return sent.groupBy("bucket").applyInArrow(merge, "bucket int, keys binary, counts binary")


def sums_of(model: DataFrame, size: int, grid: Grid) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over all pairs: how many occur once to four times; of each first word the total and how many of its pairs occur once, twice, more often; of each second word the number of first words."""
    rows, columns = -(-size // grid.rows), -(-size // grid.columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for bucket, k, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                keys, counts = unpacked_sorted(k), unpacked(c).astype(np.int64)
                first, second = (keys >> np.uint64(WIDE)).astype(np.int64) // grid.rows, (keys & np.uint64((1 << WIDE) - 1)).astype(np.int64) // grid.columns
                of = np.zeros((rows, 4), np.int64)
                np.add.at(of[:, 0], first, counts)
                np.add.at(of, (first, np.minimum(counts, 3)), 1)
                out += [(0, 0, np.bincount(np.minimum(counts, 5), minlength=6)[1:5]), (1, bucket // grid.columns, of.ravel()), (2, bucket % grid.columns, np.bincount(second, minlength=columns))]
            made = [(a, p, packed(x)) for a, p, x in out]
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["kind", "part", "sums"])

    def merge(group: pa.Table) -> pa.Table:
        total = sum(unpacked(x) for x in group["sums"].to_pylist())
        return pa.table({"kind": group["kind"][:1], "part": group["part"][:1], "sums": pa.array([packed(total)], pa.binary())})

    found = model.select("bucket", "keys", "counts").mapInArrow(run, "kind int, part int, sums binary").groupBy("kind", "part").applyInArrow(merge, "kind int, part int, sums binary").collect()  # 1 + rows + columns rows, 5 numbers a word in all
    some, first, second = np.zeros(4, np.int64), np.zeros((size, 4), np.int64), np.zeros(size, np.int64)
    for r in found:
        x = unpacked(bytes(r.sums)).astype(np.int64)
        if r.kind == 0:
            some[:] = x
        elif r.kind == 1:
            own = first[r.part :: grid.rows]
            own[:] = x.reshape(-1, 4)[: len(own)]
        else:
            own = second[r.part :: grid.columns]
            own[:] = x[: len(own)]
    return some, first, second


def frequent(model: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of the pairs found at least `least` times."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys, counts = unpacked_sorted(k), unpacked(c).astype(np.int64)
                own = counts >= least
                yield pa.RecordBatch.from_arrays([pa.array(keys[own].astype(np.int64)), pa.array(counts[own])], ["key", "n"])

    found = model.select("keys", "counts").mapInArrow(run, "key bigint, n bigint").toArrow()
    return found["key"].to_numpy().astype(np.uint64), found["n"].to_numpy()


def discounts_of(some: np.ndarray) -> np.ndarray:
    """Discounts for counts 0 to 3 and more, from the counts of counts."""
    return np.concatenate(([0.0], discounts(np.repeat([1, 2, 3, 4], np.minimum(some, 1 << 20) if some.max() < 1 << 20 else some * (1 << 20) // some.max()))))


@dataclass
class Pairs:
    """What scores a pair with its count; bounded by the vocabulary."""

    discount: np.ndarray
    total: np.ndarray  # of each first word
    left: np.ndarray  # the share of each first word's probability that goes to the lower order
    lower: np.ndarray  # probability of each second word without a context

    def logp(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        first, second = (keys >> np.uint64(WIDE)).astype(np.int64), (keys & np.uint64((1 << WIDE) - 1)).astype(np.int64)
        own = np.maximum(counts - self.discount[np.minimum(counts, 3)], 0) / np.maximum(self.total[first], 1)
        return np.log(own + self.left[first] * self.lower[second])


def estimate_pairs(some: np.ndarray, first: np.ndarray, second: np.ndarray) -> Pairs:
    d = discounts_of(some)
    total = first[:, 0]
    left = np.where(total > 0, first[:, 1:] @ d[1:] / np.maximum(total, 1), 1.0)
    n = [int((second == k).sum()) for k in range(1, 5)]
    e = discounts_of(np.array(n))
    taken = e[np.minimum(second, 3)]
    kinds = max(int(second.sum()), 1)
    spread = taken.sum() / kinds if second.any() else 1.0
    return Pairs(d, total, left, np.maximum(second - taken, 0) / kinds + spread / len(second))


@dataclass
class Model:
    """What every worker holds; all of it bounded (see the module). The pairs themselves are `stored` by the grid's buckets."""

    words: Vocabulary
    spelling: Spelling
    pairs: Pairs
    grid: Grid
    hot: Found
    hot_counts: np.ndarray
    stored: DataFrame | None = None


def fit(docs: DataFrame, text_col: str = "text", most: int = VOCABULARY, share: float = SHARE) -> Model:
    """The model of all documents."""
    counts = stored(word_and_gram_counts(docs, text_col))
    symbols = counts.where("kind = 0").select("key", "n").toArrow()  # 64 ** ORDER rows at most, in practice some 100,000
    words = Vocabulary(Found(vocabulary(counts, most)))
    grid = grid_for(docs)
    model = stored(pair_counts(docs, words, grid, text_col))
    some, first, second = sums_of(model, len(words), grid)
    keys, n = frequent(model, max(1, int(np.ceil(first[:, 0].sum() * share))))
    mix = mixed(keys)
    order = np.argsort(mix)
    return Model(words, estimate(symbols["key"].to_numpy().astype(np.int64), symbols["n"].to_numpy()), estimate_pairs(some, first, second), grid, Found(mix[order]), n[order], model)


def repeated_words(h: np.ndarray, of: np.ndarray, texts: int, width: int = 3) -> np.ndarray:
    """Of each text, the words in windows of `width` words that it holds twice or more, the first included."""
    n = len(h) - width + 1
    if n < 2:
        return np.zeros(texts, np.int64)
    key = mixed(of[:n].astype(np.uint64) + np.uint64(1))
    for i in range(width):
        key = key * np.uint64(0xD6E8FEB86659FD93) + h[i : i + n]
    key = mixed(key)
    own = np.flatnonzero(of[:n] == of[width - 1 :])
    own = own[np.argsort(key[own], kind="stable")]
    key = key[own]
    same = key[1:] == key[:-1]
    again = np.zeros(len(h), bool)
    for part in (own[1:][same], own[:-1][same]):
        for i in range(width):
            again[part + i] = True
    return np.bincount(of[again], minlength=texts)


def base_counts(text: bytes) -> tuple[int, int, int]:
    """word_chars, n_symbols, n_dup_lines."""
    lines = [x for x in text.split(b"\n") if x.strip(WHITE)]
    return len(text.translate(None, WHITE + CONTINUATION)), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines))


class Spelled:
    """Log probabilities of grams, each looked up once."""

    def __init__(self, model: Spelling):
        self.model, self.known = model, np.full(1 << 24, np.nan, np.float32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = self.known[keys]
        fresh = np.isnan(out)
        if fresh.any():
            new = np.unique(keys[fresh])
            self.known[new] = self.model.score(new)
            out = self.known[keys]
        return out.astype(np.float64)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def read_texts(texts: list[bytes], model: Model, spelled: Spelled) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(base counts, pair of each word, text of each word, (spelling of unknown words, spelling of all, symbols) of each text)."""
    held = []
    for data, start, end, of in blocks(texts):
        keys, lo, hi = grams(data, start, end)
        run = np.concatenate(([0.0], np.cumsum(spelled(keys))))
        held.append((hashes(data, start, end), of, run[hi] - run[lo], hi - lo))
    n = len(texts)
    h, of, logp, symbols = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, t) for t in (np.uint64, np.int64, np.float64, np.int64))
    ids = model.words(h)
    counts = np.zeros((n, 5), np.int64)
    counts[:, 0] = np.bincount(of, minlength=n)
    counts[:, 1:4] = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 3)
    counts[:, 4] = repeated_words(h, of, n)
    spelling = np.stack([np.bincount(of, weights=np.where(ids == UNKNOWN, logp, 0), minlength=n), np.bincount(of, weights=logp, minlength=n), np.bincount(of, weights=symbols, minlength=n)], axis=1)
    return counts, pairs(ids, of), of, spelling


PASSED = "kind int, bucket int, block bigint, a binary, b binary, c binary, d binary"
PASSED_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(PASSED_TYPES)], ["kind", "bucket", "block", "a", "b", "c", "d"])


def _message(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


class Block:
    """Some documents whose rare pairs are asked for together."""

    def __init__(self, model: Model, number: int, leave_out: bool):
        self.model, self.number, self.leave_out = model, number, leave_out
        self.facts, self.keys, self.of, self.size, self.words = [], [], [], 0, 0

    def add(self, b: pa.RecordBatch, spelled: Spelled) -> None:
        counts, keys, of, spelling = read_texts(b.column(2).to_pylist(), self.model, spelled)
        self.facts.append((b.column(0), b.column(1), counts, spelling))
        self.keys.append(keys)
        self.of.append(of + self.size)
        self.size += b.num_rows
        self.words += len(keys)

    def sent(self) -> pa.RecordBatch:
        """Rows that ask for the rare pairs, and one with what is known here."""
        model, grid = self.model, self.model.grid
        keys, of = np.concatenate(self.keys), np.concatenate(self.of)
        keys = np.sort(keys << np.uint64(29) | of.astype(np.uint64))  # 2 * WIDE bits of the pair, 29 of the document
        at = starts(keys)
        own = np.diff(np.append(at, len(keys)))
        of, keys = (keys[at] & np.uint64((1 << 29) - 1)).astype(np.int64), keys[at] >> np.uint64(29)
        place = model.hot(mixed(keys))
        near = place >= 0
        here = np.bincount(of[near], weights=own[near] * model.pairs.logp(keys[near], model.hot_counts[place[near]] - own[near] * self.leave_out), minlength=self.size) if near.any() else np.zeros(self.size)
        rows = []
        for bucket, k, d, n in dealt(grid(keys[~near]), keys[~near], of[~near], own[~near]):
            first = starts(k)
            rows.append((1, bucket, self.number, packed_sorted(k[first]), packed(np.diff(np.append(first, len(k)))), packed(d), packed(n)))
        ids, langs = (pa.concat_arrays([f[i] for f in self.facts]) for i in (0, 1))
        counts, spelling = (np.concatenate([f[i] for f in self.facts]) for i in (2, 3))
        fact = pa.RecordBatch.from_arrays([ids, langs, *(pa.array(counts[:, i]) for i in range(5)), pa.array(here), *(pa.array(spelling[:, i]) for i in range(3))], ["doc_id", "lang", *COLUMNS, "here", "unknown", "spelled", "symbols"])
        rows.append((2, (self.number + (self.number >> 32)) % (grid.rows * grid.columns), self.number, _message(fact), None, None, None))
        return _rows(rows)


def measure(docs: DataFrame, model: Model, leave_out: bool = True, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, the base counts, base_failed, log_perplexity and log_spelling of every row of docs.

    leave_out: the model was fitted on these documents, so each one's pairs are taken off.
    """
    table, bare = model.stored, Model(model.words, model.spelling, model.pairs, model.grid, model.hot, model.hot_counts)
    sent = docs.sparkSession.sparkContext.broadcast(bare)
    kinds = [docs.schema[c].dataType.simpleString() for c in (id_col, lang_col)]

    def asking(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled, first = Spelled(sent.value.spelling), TaskContext.get().partitionId() << 32
        block = Block(sent.value, first, leave_out)
        for b in chunks(batches):
            if not b.num_rows:
                continue
            block.add(b, spelled)
            if block.words >= KEEP or block.size >= DOCUMENTS:
                yield block.sent()
                block = Block(sent.value, block.number + 1, leave_out)
        if block.size:
            yield block.sent()

    def answering(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = sent.value.pairs
        sums: dict[int, list] = {}
        held, bucket, keys, counts = 0, None, np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def answers() -> list[tuple]:
            out = []
            for block, parts in sums.items():
                at, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                out.append((1, 0, block, packed_sorted(at), np.bincount(back, weights=np.concatenate([p[1] for p in parts])).tobytes(), None, None))
            return out

        for batch in batches:
            for kind, own, block, a, b, c, d in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if kind == 2:
                    yield _rows([(0, 0, block, a, None, None, None)])
                    continue
                if kind == 0:
                    bucket, keys, counts = own, unpacked_sorted(a), unpacked(b).astype(np.int64)
                    continue
                asked, times = unpacked_sorted(a), unpacked(b).astype(np.int64)
                of, n = unpacked(c).astype(np.int64), unpacked(d).astype(np.int64)
                found = np.zeros(len(asked), np.int64)
                if bucket == own and len(keys):
                    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                    found = np.where(keys[at] == asked, counts[at], 0)
                each = n * score.logp(np.repeat(asked, times), np.repeat(found, times) - n * leave_out)
                at, back = np.unique(of, return_inverse=True)
                sums.setdefault(block, []).append((at, np.bincount(back, weights=each)))
                held += len(at)
                if held >= KEEP:
                    yield _rows(answers())
                    sums, held = {}, 0
        if sums:
            yield _rows(answers())

    def finished(message: bytes, parts: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        b = next(iter(pa.ipc.open_stream(message)))
        col = {n: b.column(n).to_numpy(zero_copy_only=False) for n in b.schema.names[2:]}
        words, total = col["n_words"], col["here"] + col["unknown"]
        for at, values in parts:
            total[unpacked_sorted(at).astype(np.int64)] += np.frombuffer(values)
        failed = (words < 50) | (100 * col["n_repeat_words"] > 50 * words)
        some = words > 0
        means = [pa.array(-np.divide(x, y, out=np.zeros(len(words)), where=some), mask=~some) for x, y in ((total, words), (col["spelled"], col["symbols"]))]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(b.column(c) for c in COLUMNS), pa.array(failed), *means], ["doc_id", "lang", *COLUMNS, "base_failed", "log_perplexity", "log_spelling"])

    def ending(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        message, at, parts = None, None, []
        for batch in batches:
            for kind, block, a, b in zip(*(batch.column(c).to_pylist() for c in ("kind", "block", "a", "b")), strict=True):
                if kind == 0:
                    if message is not None:
                        yield finished(message, parts)
                    message, at, parts = a, block, []
                elif block != at:
                    raise ValueError(f"an answer for block {block} without its documents")
                else:
                    parts.append((a, b))
        if message is not None:
            yield finished(message, parts)

    asked = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), as_bytes(text_col).alias("data")).mapInArrow(asking, PASSED)
    no = F.lit(None).cast("binary")
    held = table.select(F.lit(0).alias("kind"), "bucket", F.lit(0).cast("bigint").alias("block"), F.col("keys").alias("a"), F.col("counts").alias("b"), no.alias("c"), no.alias("d"))
    answered = asked.unionByName(held).repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(answering, PASSED)
    schema = f"doc_id {kinds[0]}, lang {kinds[1]}, " + ", ".join(f"{c} bigint" for c in COLUMNS) + ", base_failed boolean, log_perplexity double, log_spelling double"
    return answered.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(ending, schema)


def bands(measured: DataFrame, fences: dict[str, tuple[float, float]] | None = None, margin: float = MARGIN) -> DataFrame:
    """(lang, lower, upper, spelling_lower, spelling_upper), logarithms. Quartiles are exact, of values rounded to thousandths, so a group's state is bounded."""
    fences = FENCES | (fences or {})
    quartiles = lambda c: F.percentile(F.round(c, 3), F.array(F.lit(0.25), F.lit(0.75)))
    found = measured.where("not base_failed and log_perplexity is not null").groupBy("lang").agg(quartiles("log_perplexity").alias("words"), quartiles("log_spelling").alias("symbols"))
    out = []
    for name, prefix in (("words", ""), ("symbols", "spelling_")):
        q = F.col(name)
        reach = F.greatest(q[1] - q[0], F.lit(margin))
        out += [(q[0] - reach * fences[name][0]).alias(f"{prefix}lower"), (q[1] + reach * fences[name][1]).alias(f"{prefix}upper")]
    return found.select("lang", *out)


#: Rows of bands up to which they are broadcast; more languages are joined by a shuffle.
FEW = 10_000


def judge(docs: DataFrame, fences: dict[str, tuple[float, float]] | None = None, margin: float = MARGIN, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the perplexities with their bands, of every row of docs."""
    measured = stored(measure(docs, fit(docs, text_col), True, id_col, text_col, lang_col))
    limits = bands(measured, fences, margin).withColumnRenamed("lang", "band_lang")
    if limits.count() <= FEW:
        limits = F.broadcast(limits)
    joined = measured.join(limits, measured.lang.eqNullSafe(F.col("band_lang")), "left")
    inside = F.col("log_perplexity").between(F.col("lower"), F.col("upper")) & F.col("log_spelling").between(F.col("spelling_lower"), F.col("spelling_upper"))
    numbers = [F.exp(a).alias(b) for a, b in (("log_perplexity", "perplexity"), ("lower", "lower"), ("upper", "upper"), ("log_spelling", "spelling_perplexity"), ("spelling_lower", "spelling_lower"), ("spelling_upper", "spelling_upper"))]
    return joined.select("doc_id", *COLUMNS, "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"), *numbers)
