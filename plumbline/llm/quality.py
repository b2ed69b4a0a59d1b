"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Every whole word has a fixed sparse random index vector of its own (ONES entries of +1
and -1 at places given by the hash of all its bytes). Its word vector is the sum of
the index vectors of all words within WINDOW words of it, over all documents. Word
vectors lie in a table of ROWS rows by that hash, so that every worker can hold it
however many words there are; rows are then centred and scaled to length one.

A document's features are the mean and the spread of its words' vectors and the
length of the mean. A network with one hidden layer, trained here in numpy on a bounded sample of labelled rows,
gives a logit; a temperature fitted on a part of the sample kept out of training
turns it into a probability.

Null texts are empty; a text without words has features zero and a score like any
other. Without labels of both kinds every score is the labels' mean (0.5 without
any). Rows with equal doc_id each get a row. An empty table gives no rows. Very long
texts are read in blocks, across whose edges words stay neighbours. Other columns of
docs have no effect on scores, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.arrays import packed, packed_sorted, starts, unpacked, unpacked_sorted
from plumbline.llm.common import as_bytes, chunks, give_back, stored
from plumbline.llm.labels import held_out, training_rows
from plumbline.llm.words import blocks, hashes

ROWS, SIZE, ONES, WINDOW = 1 << 18, 64, 4, 2
#: Rows of a segment, in which the sums of tasks are added up.
SEGMENT = 1 << 10
#: Entries of finished vectors are whole parts of this.
PARTS = 127
HIDDEN = 24
#: Mean, spread, and the length of the mean.
FEATURES = 2 * SIZE + 1
#: Labelled rows that the network is fitted on, at most.
SAMPLE = 6_000
#: Words whose vectors are summed at a time.
BATCH = 1 << 13


def rows_of(h: np.ndarray) -> np.ndarray:
    """Row of each word's vector."""
    return (h >> np.uint64(46)).astype(np.int64)


def index_places(h: np.ndarray) -> np.ndarray:
    """The ONES places of each word's index vector: the first half hold +1, the others -1; a place may hold more than one."""
    shifts = np.arange(ONES, dtype=np.uint64) * np.uint64(6)
    return (h[:, None] >> shifts & np.uint64(SIZE - 1)).astype(np.int64)


def add_contexts(total: np.ndarray, h: np.ndarray, of: np.ndarray, done: int = 0) -> np.ndarray:
    """Add to each word's row of total the index vectors of the words around it in its text; returns the rows. Pairs of the first `done` words are left out."""
    rows, places, each = rows_of(h), index_places(h), np.arange(len(h))
    index = np.zeros((len(h), SIZE), np.int8)
    for k in range(ONES):
        index[each, places[:, k]] += 1 if k < ONES // 2 else -1
    around = np.zeros((len(h), SIZE), np.int8)  # within WINDOW * 2 * ONES
    for o in range(1, min(WINDOW, len(h) - 1) + 1):
        own = (of[:-o] == of[o:]) & (each[o:] >= done)
        around[:-o] += index[o:] * own[:, None]
        around[o:] += index[:-o] * own[:, None]
    order = np.argsort(rows, kind="stable")
    at = starts(rows[order])
    total[rows[order[at]]] += np.add.reduceat(around[order], at, axis=0, dtype=np.int32)
    return rows


def context_sums(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(segment, vectors): the summed index vectors of each segment's rows, scaled to length one, over all documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((ROWS, SIZE), np.int32), np.zeros(ROWS, bool)
        for b in chunks(batches):
            last, last_of = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # of a text that goes on in the next block
            for data, start, end, of in blocks(b.column(0).to_pylist()):
                h, of = np.concatenate((last, hashes(data, start, end))), np.concatenate((last_of, of))
                seen[add_contexts(total, h, of, len(last))] = True
                last, last_of = h[-WINDOW:], of[-WINDOW:]
            give_back()
        rows = np.flatnonzero(seen)
        at = starts(rows // SEGMENT)
        for lo, hi in zip(at, np.append(at, len(rows))[1:], strict=True):
            own = total[rows[lo:hi]].ravel()
            own = (own << 1 ^ own >> 31).astype(np.uint32)  # signs go to the last bit
            yield pa.RecordBatch.from_arrays([pa.array([rows[lo] // SEGMENT], pa.int32()), pa.array([packed_sorted(rows[lo:hi])], pa.binary()), pa.array([packed(own)], pa.binary())], ["segment", "rows", "sums"])
        del total, seen
        give_back()

    def merge(group: pa.Table) -> pa.Table:
        segment = group["segment"][0].as_py()
        total = np.zeros((SEGMENT, SIZE), np.int64)
        for r, s in zip(group["rows"].to_pylist(), group["sums"].to_pylist(), strict=True):
            x = unpacked(s)
            total[unpacked_sorted(r).astype(np.int64) - segment * SEGMENT] += ((x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)).reshape(-1, SIZE)
        return pa.table({"segment": group["segment"][:1], "vectors": pa.array([unit(total.astype(np.float32)).tobytes()], pa.binary())})

    sent = docs.select(as_bytes(text_col).alias("data")).mapInArrow(run, "segment int, rows binary, sums binary")
    return sent.groupBy("segment").applyInArrow(merge, "segment int, vectors binary")


def unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The ROWS x SIZE word vectors, in PARTS: rows of length one, centred, scaled and centred again; rows of no word stay zero.

    The driver gets the finished table, 16 MB, and two sums of its rows.
    """
    segments = stored(context_sums(docs, text_col))
    centres: list[np.ndarray] = []

    def rows_in(vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
        x = np.frombuffer(vectors, np.float32).reshape(-1, SIZE).copy()
        seen = x.any(axis=1)
        for i, c in enumerate(centres):
            x[seen] = (unit(x[seen]) if i else x[seen]) - c
        return x, seen

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for v in b.column(0).to_pylist():
                x, seen = rows_in(v)
                own = unit(x[seen]).sum(axis=0, dtype=np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([own.tolist()], pa.list_(pa.float64())), pa.array([int(seen.sum())])], ["sum", "n"])

    def finished(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for segment, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = rows_in(v)[0]
                yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([np.rint(np.clip(x, -1, 1) * PARTS).astype(np.int8).tobytes()], pa.binary())], ["segment", "rows"])

    for _ in range(2):
        got = segments.select("vectors").mapInArrow(sums, "sum array<double>, n bigint").toArrow()  # a row a segment
        n = sum(got["n"].to_pylist())
        centres.append((np.array(got["sum"].to_pylist()).reshape(-1, SIZE).sum(axis=0) / max(n, 1)).astype(np.float32))
    table = np.zeros((ROWS, SIZE), np.int8)
    for r in segments.mapInArrow(finished, "segment int, rows binary").toArrow().to_pylist():
        table[r["segment"] * SEGMENT : (r["segment"] + 1) * SEGMENT] = np.frombuffer(r["rows"], np.int8).reshape(-1, SIZE)
    return table


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each text, texts without words zero."""
    sums = np.zeros((len(texts), 2 * SIZE))
    counts = np.zeros(len(texts), np.int64)
    for data, start, end, of in blocks(texts):
        rows = rows_of(hashes(data, start, end))
        counts += np.bincount(of, minlength=len(texts))
        for lo in range(0, len(rows), BATCH):
            own = of[lo : lo + BATCH]
            at = starts(own)
            x = vectors[rows[lo : lo + BATCH]].astype(np.float32)
            sums[own[at], :SIZE] += np.add.reduceat(x, at, axis=0)
            sums[own[at], SIZE:] += np.add.reduceat(x * x, at, axis=0)
    means = sums / np.maximum(counts, 1)[:, None] / np.repeat([PARTS, PARTS**2], SIZE)
    out = np.zeros((len(texts), FEATURES), np.float32)
    out[:, :SIZE] = means[:, :SIZE]
    out[:, SIZE:-1] = np.sqrt(np.maximum(means[:, SIZE:] - means[:, :SIZE] ** 2, 0))
    out[:, -1] = np.linalg.norm(means[:, :SIZE], axis=1)
    return out


@dataclass
class Network:
    """Standardised inputs, a tanh layer, a logit, and a temperature; constant if it has no weights."""

    constant: float | None = None
    shift: np.ndarray | None = None
    scale: np.ndarray | None = None
    w1: np.ndarray | None = None
    b1: np.ndarray | None = None
    w2: np.ndarray | None = None
    b2: float = 0.0
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.shift) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 60, decay: float = 3e-4, seed: int = 3) -> Network:
    """Adam on cross-entropy over four fifths of the rows; the temperature is fitted on the rest."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    if len(y) < 10 or y.min() == y.max():
        return Network(constant=float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    cal, fit = order[: len(y) // 5], order[len(y) // 5 :]
    net = Network(shift=x[fit].mean(axis=0), scale=x[fit].std(axis=0) + 1e-6)
    z = (x - net.shift) / net.scale
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs) + 1e-5
        order = rng.permutation(fit)
        for lo in range(0, len(order), 64):
            i = order[lo : lo + 64]
            h = np.tanh(z[i] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y[i]) / len(i)
            dh = np.outer(d, p[2]) * (1 - h * h)
            grads = [z[i].T @ dh + decay * p[0], dh.sum(axis=0), h.T @ d + decay * p[2], np.array([d.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = p[0], p[1], p[2], float(p[3][0])
    net.temperature = best_temperature(net.logits(x[cal]), y[cal])
    return net


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least cross-entropy, on a grid from 0.25 to 8."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 81))
    loss = [float(np.mean(np.logaddexp(0, np.where(y > 0, -1, 1) * logits / t))) for t in grid]
    return float(grid[int(np.argmin(loss))])


@dataclass
class Quality:
    """A fitted classifier; its size is fixed by ROWS, SIZE and HIDDEN."""

    vectors: np.ndarray
    network: Network

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return self.network.scores(pooled(texts, self.vectors))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, fold: int = 0, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Quality:
    vectors = word_vectors(docs, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            x = pooled(b.column(2).to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "label", "x"])

    rows = training_rows(docs, labels, label, folds, fold, most, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(run, f"doc_id {kind}, label int, x array<float>").toArrow().sort_by("doc_id")
    x = got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
    return Quality(vectors, fit_network(x, got["label"].to_numpy()))


def score_documents(docs: DataFrame, model, folds: int, fold: int, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs; model has scores(texts)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sent.value.scores(b.column(2).to_pylist()), pa.float64())], ["doc_id", "held_out", "score"])
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col, folds, fold).alias("held_out"), as_bytes(text_col).alias("data")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_by_score(docs: DataFrame, model, keep, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score satisfies keep(scores); read and written once, without a join."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            scores = sent.value.scores([(t or "").encode() for t in b.column(at).to_pylist()])
            yield b.filter(pa.array(keep(scores)))
        give_back()

    return docs.mapInArrow(run, docs.schema)
