"""Vector best-fit packing of tokenised documents into sequences.

Documents are tokenised and cut into pieces (only those longer than a sequence;
the first piece takes the remainder). A bin has three capacities: tokens, documents
and attention cost (the sum of squared lengths). Pieces go in order of falling
length; each goes into the open bin that fits it under every capacity and scores
best, by the weighted norm of what would stay free ("norm") or by the weighted dot
product of need and room ("dot"); where none fits, a bin is opened.

Placement needs only how many pieces have each length, at most `capacity` numbers,
so the plan is made on the driver from that histogram, for all equal bins and equal
pieces at once. It says for each length which ranks go to which bins, as ranges; a
piece's rank among those of its length is its rank in its partition plus the count
in earlier partitions. No task sees more than its own pieces.

Null texts are empty texts: one piece that holds the end token only. Rows with
equal doc_id are packed as documents of their own. An empty table packs nothing. Very
long texts are tokenised whole, one at a time. Other columns have no effect.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import chunks, stored

#: Fixed values of the public tokenizer: its split pattern and its special string with id.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = ("<|endoftext|>", 50256)


class ByteBpe:
    """Ids of the byte-level BPE of a tokenizers file, as little-endian uint32 bytes.

    The same split pattern and vocabulary run in the faster of two public libraries.
    Texts with characters on which the libraries' regular expressions may differ
    (outside Latin, or odd white space) go through the tokenizers library itself, as
    do texts with its special string.
    """

    def __init__(self, json_path: str, ranks_path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.odd = re.compile("[^\t\n\v\f\r\x20-\x7e\xa1-\u024f\u2010-\u2027]").search

    def encode(self, text: str) -> bytes:
        if SPECIAL[0] in text or self.odd(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.plain.encode_ordinary(text)).tobytes()


def public_byte_bpe() -> ByteBpe:
    import public_tokenizers

    return ByteBpe(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence. documents and cost at their defaults never bind below `tokens`; longest, if given, is the longest piece."""

    tokens: int = 1024
    documents: int = 1024
    cost: int = 1024 * 1024
    longest: int | None = None
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-6)
    rule: str = "norm"

    def check(self) -> None:
        if self.tokens < 1 or self.documents < 1 or self.rule not in ("norm", "dot"):
            raise ValueError("capacities must be positive and rule norm or dot")
        if self.cost < self.piece**2 or not 1 <= self.piece <= self.tokens:
            raise ValueError("tokens and cost must admit one piece of full length")

    @property
    def piece(self) -> int:
        return self.tokens if self.longest is None else self.longest


#: Sequences of double length whose attention costs no more than one of a single piece, of few documents: here every capacity binds.
BALANCED = Limits(tokens=2048, documents=8, cost=1024 * 1024, longest=1024)


def cut_lengths(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first takes what is left over."""
    if n <= most:
        return [(0, n)]
    first = n % most or most
    return [(0, first), *((s, most) for s in range(first, n, most))]


@dataclass
class Plan:
    """Ranges of ranks by length: from rank `rank`, `per` consecutive ranks share a sequence, at offsets `offset`, `offset` + length and so on."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    per: np.ndarray
    offset: np.ndarray
    sequences: int


def plan(counts: dict[int, int], limits: Limits) -> Plan:
    """Place counts[length] pieces of each length.

    Equal bins (same free tokens, documents and cost) are handled as one, as runs
    (first sequence, how many). Pieces fill a best bin while it still fits them.
    """
    limits.check()
    caps = np.array([limits.tokens, limits.documents, limits.cost], float)
    weights = np.array(limits.weights)
    runs: dict[tuple[int, int, int], list[list[int]]] = {}
    states = np.zeros((0, 3), np.int64)
    out: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    smallest = min((k for k, v in counts.items() if v), default=0)

    def put(state: tuple[int, int, int], first: int, many: int) -> None:
        nonlocal states
        if state[0] < smallest or state[1] < 1 or state[2] < smallest * smallest:
            return
        if state not in runs:
            runs[state] = []
            states = np.vstack([states, np.array([state], np.int64)])
        runs[state].append([first, many])

    def fits(state, length: int) -> int:
        return int(min(state[0] // length, state[1], state[2] // (length * length)))

    def filled(state, length: int, n: int) -> tuple[int, int, int]:
        return int(state[0] - n * length), int(state[1] - n), int(state[2] - n * length * length)

    full = (limits.tokens, limits.documents, limits.cost)
    for length in sorted((k for k, v in counts.items() if v), reverse=True):
        need = np.array([length, 1, length * length], np.int64)
        left, rank = counts[length], 0
        while left:
            ok = (states >= need).all(axis=1).nonzero()[0]
            if not len(ok):
                per = min(fits(full, length), left)
                many = left // per
                out.append((length, rank, sequences, per, 0))
                put(filled(full, length, per), sequences, many)
                sequences += many
                rank += many * per
                left -= many * per
                continue
            room = states[ok] / caps
            ask = need / caps
            score = ((room - ask) ** 2 * weights).sum(axis=1) if limits.rule == "norm" else -(room * ask * weights).sum(axis=1)
            at = int(ok[int(np.argmin(score))])
            state = tuple(int(x) for x in states[at])
            most = fits(state, length)
            while left and runs[state]:
                first, many = runs[state][-1]
                per = min(most, left)
                take = min(many, left // per)
                out.append((length, rank, first, per, limits.tokens - state[0]))
                if take == many:
                    runs[state].pop()
                else:
                    runs[state][-1] = [first + take, many - take]
                rank += take * per
                left -= take * per
                put(filled(state, length, per), first, take)
            if not runs[state]:
                del runs[state]
                states = np.delete(states, at, axis=0)
    columns = np.array(out, np.int64).reshape(-1, 5)
    columns = columns[np.lexsort((columns[:, 1], columns[:, 0]))]
    return Plan(*[columns[:, i].copy() for i in range(5)], sequences)


def place(p: Plan, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces by length and rank (both from the counts that p was made of)."""
    top = int(p.rank.max(initial=0)) + int(rank.max(initial=0)) + 1
    at = np.searchsorted(p.length * top + p.rank, length * top + rank, side="right") - 1
    past = rank - p.rank[at]
    return p.sequence[at] + past // p.per[at], p.offset[at] + past % p.per[at] * length


def tokenised_pieces(docs: DataFrame, encoder: Callable[[], ByteBpe], most: int, end: int | None, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """A row for each piece, with its partition `part` and its rank `nth` among the partition's pieces of its length."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder().encode
        part, seen = TaskContext.get().partitionId(), [0] * (most + 1)
        tail = b"" if end is None else np.array([end], "<u4").tobytes()
        for b in chunks(batches):
            row, cols = [], [[] for _ in range(6)]
            ids: list[bytes] = []
            for i, text in enumerate(b.column(1).to_pylist()):
                data = encode(text or "") + tail
                for k, (s, n) in enumerate(cut_lengths(len(data) // 4, most)):
                    own = data[4 * s : 4 * (s + n)]
                    row.append(i)
                    for c, v in zip(cols, (k, s, n, zlib.crc32(own), part, seen[n]), strict=True):
                        c.append(v)
                    seen[n] += 1
                    if with_ids:
                        ids.append(own)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            arrays = [b.column(0).take(pa.array(row, pa.int32())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            if with_ids:
                arrays, names = [*arrays, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, limits: Limits = Limits(), encoder: Callable[[], ByteBpe] = public_byte_bpe, end: int | None = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, also: dict[str, Limits] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece (and ids as uint32 bytes if asked for).

    also: the same pieces packed under other limits too, as NAME_sequence_id and NAME_offset.

    A document without tokens (only if end is None) has one piece of length zero
    with sequence_id and offset null.
    """
    every = {"": limits} | {f"{name}_": own for name, own in (also or {}).items()}
    for own in every.values():
        own.check()
        if own.piece != limits.piece:
            raise ValueError("all limits must have the same longest piece")
    pieces = stored(tokenised_pieces(docs, encoder, limits.piece, end, id_col, text_col, with_ids))
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    base = by_part.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most limits.tokens + 1 rows
    made = [plan({k: v for k, v in counts.items() if k}, own) for own in every.values()]
    sent = pieces.sparkSession.sparkContext.broadcast(made)  # ranges by length: as many as kinds of bins, not as pieces
    ranked = pieces.join(base.select("length", "part", "base"), ["length", "part"]).select(*[c for c in pieces.columns if c not in ("part", "nth")], (F.col("base") + F.col("nth")).alias("rank"))
    cols = ranked.columns[:-1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = b.column(b.schema.get_field_index("rank")).to_numpy(zero_copy_only=False)
            some, found = length > 0, []
            for own in sent.value:
                seq, off = np.zeros((2, len(length)), np.int64)
                if some.any():
                    seq[some], off[some] = place(own, length[some], rank[some])
                found += [pa.array(seq, mask=~some), pa.array(off, mask=~some)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), *found], [*cols, *places])

    places = [f"{name}{c}" for name in every for c in ("sequence_id", "offset")]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1]), *(f"{c} bigint" for c in places)])
    return ranked.mapInArrow(run, schema)
