"""SimHash near-duplicate classes with a pigeonring candidate filter.

A document's fingerprint has 64 bits: words of the A-Z-lowered text, shingles of
`width` words (repeats count), XXH64 with seed 42; a bit is 1 if it is set in over
half the hashes. No words: fingerprint zero.

Two fingerprints link if they differ in at most `radius` bits. The 64 bits are a ring
of FINE * radius segments. If the distance is within the radius then, by the
pigeonring principle, the ring has a start from which every chain of l consecutive
segments differs in at most l * radius / segments bits, rounded down. The chains whose
budget is zero are equal bits, which are the join key (28 bits for a radius of two, so
that a bucket holds some tens of 10 ** 10 evenly spread fingerprints); the longer
chains prune a candidate before the full Hamming check.

Equal fingerprints become one node first, so exact copies never form pairs. Clumps of
near copies may crowd a bucket nevertheless. Pairs would be more rows there than the
one-bit neighbours of its nodes outside the equal bits, so for a radius of two every
node names itself and those, and all that name the same value hang on the smallest of
them. Two values within two bits that differ outside the equal bits always share such a
value, and two that share one are within two bits, so this finds the same classes with
a number of rows linear in the bucket. A value has 65 names at most.

A similarity of far less than that, such as a Jaccard similarity of 0.8 of shingle sets, is an
angle at which 15 % of the bits differ: 64 bits then have no chain that is both equal and
selective. ring_groups() takes a ring of RING segments of 16 bits for that, see there.

Null texts are empty texts; very long ones are hashed whole, in blocks. Other columns have no
effect, whatever their names. Rows with equal doc_id each get a row. A null doc_id
takes part, but is never a component's name unless the class has no other id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import LOWER_AZ, as_bytes, chunks, cut, stored
from plumbline.llm.components import connected_components
from plumbline.llm.words import mixed

SEED = 42
#: Segments of the ring for each bit of the radius, and the largest radius.
FINE, WIDEST = 8, 8
#: Nodes of a bucket from which on it names values: a node has 37 of them, and as many pairs in a bucket of 74.
CROWDED = 74
#: Hashes whose bits are counted at a time.
BLOCK = 1 << 16
#: Segments of 16 bits of a wide fingerprint's ring, those of a chain after its start, and the bits in which a chain may differ for each of its segments.
RING, AFTER, SPARE = 160, 4, 3
_SALT = np.random.default_rng(17).integers(0, 1 << 63, RING // 4, np.uint64)
#: Hashes whose wide bits are counted at a time, as many as a byte holds.
ROOM = 255
#: A start of a node: its own segment, the four after it, the node.
START = np.dtype([("key", "<u2"), ("chain", "<u8"), ("node", "<i8")])
#: Bytes of starts that meet in one call, about, and the records of one segment from which on they are gone through one by one.
CELL, MANY = 4 << 20, 1024


def shingle_hashes(data: bytes, width: int = 3) -> list[int]:
    words = data.translate(LOWER_AZ).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], SEED) for s, e in zip(starts[: 1 - width or None].tolist(), ends[width - 1 :].tolist(), strict=True)]


def fingerprint(data: bytes, width: int = 3) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text."""
    hashes = np.array(shingle_hashes(data, width), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = hashes[at : at + BLOCK]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp) with fp a signed long, one row for each row of docs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            fps = [fingerprint(x, width) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), as_bytes(text_col).alias("data")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def segments(radius: int) -> list[tuple[int, int]]:
    """(shift, bits) of the ring's segments."""
    m = FINE * radius
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def chain_mask(ring: list[tuple[int, int]], start: int, length: int) -> int:
    """The bits of a chain of segments, as an unsigned number."""
    return sum(((1 << bits) - 1) << shift for shift, bits in (ring[(start + j) % len(ring)] for j in range(length)))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def links(nodes: DataFrame, radius: int = 2, crowded: int = CROWDED) -> DataFrame:
    """Links (a, b) between different fingerprints; their components are those of all pairs within the radius.

    In crowded buckets, for a radius of two, the links are a spanning subset (see the
    module); elsewhere they are all pairs.
    """
    if not 1 <= radius <= WIDEST:
        raise ValueError(f"the radius must be from 1 to {WIDEST}")
    ring = segments(radius)
    starts = range(len(ring))
    equal = (len(ring) - 1) // radius  # the longest chain with a budget of zero
    masks = [chain_mask(ring, i, equal) for i in starts]
    keys = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)])).alias("s")).select("fp", "s.i", "s.k")
    sizes = keys.groupBy("i", "k").agg(F.count("*").alias("n")).where("n > 1")
    sized = cut(keys.join(sizes, ["i", "k"]))
    few = sized.where(F.col("n") <= crowded) if radius == 2 else sized
    a, b = few.alias("a"), few.alias("b")
    diff = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    longer = F.element_at(F.array(*[F.array(*[F.lit(_signed(chain_mask(ring, i, n))) for n in range(equal + 1, len(ring) + 1)]) for i in starts]), F.col("a.i") + 1)
    budgets = F.array(*[F.lit(n * radius // len(ring)) for n in range(equal + 1, len(ring) + 1)])
    chains = F.forall(F.zip_with(longer, budgets, lambda mask, most: F.bit_count(diff.bitwiseAND(mask)) <= most), lambda ok: ok)
    pairs = a.join(b, (F.col("a.i") == F.col("b.i")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.fp") < F.col("b.fp")) & chains & (F.bit_count(diff) <= radius)).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    if radius != 2:
        return pairs.distinct()
    many = sized.where(F.col("n") > crowded).repartition("fp")
    free = F.array(*[F.array(*[F.lit(_signed(1 << p)) for p in range(64) if not m >> p & 1]) for m in masks])
    named = many.select("fp", "i", F.explode(F.concat(F.array("fp"), F.transform(F.element_at(free, F.col("i") + 1), lambda bit: F.col("fp").bitwiseXOR(bit)))).alias("z"))
    centre = named.groupBy("i", "z").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("i", "z", "b")
    stars = named.join(centre, ["i", "z"]).where("fp <> b")
    return pairs.unionByName(stars.select(F.col("fp").alias("a"), "b")).distinct()


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """The ring of a set of 64-bit hashes: each gives RING * 16 bits, and one of the ring is 1 if it is set in over half of them."""
    ones = np.zeros(RING * 16, np.int64)
    for at in range(0, len(hashes), ROOM):
        bits = mixed(hashes[at : at + ROOM, None] ^ _SALT)
        ones += np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes()


def chained(key: np.ndarray, chain: np.ndarray, many: int = MANY) -> np.ndarray:
    """The first record of each record's group; records of one key (sorted) are joined if their chains are within the budget."""
    most = SPARE * (AFTER + 1)
    root = np.arange(len(key))
    edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    sizes = np.diff(edges)
    at, end, a, b = root, np.repeat(edges[1:], sizes), [], []
    at = at[np.repeat(sizes, sizes) < many]
    for step in range(1, many):
        at = at[at + step < end[at]]
        if not len(at):
            break
        near = at[np.bitwise_count(chain[at] ^ chain[at + step]) <= most]
        a.append(near)
        b.append(near + step)
    if a:
        a, b = np.concatenate(a), np.concatenate(b)
        while len(a):
            least = np.minimum(root[a], root[b])
            np.minimum.at(root, root[a], least)
            np.minimum.at(root, root[b], least)
            while (root[root] != root).any():
                root = root[root]
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
    for i in np.flatnonzero(sizes >= many).tolist():
        left = np.arange(edges[i], edges[i + 1])
        while len(left):
            first, left = left[0], left[1:]
            todo = [first]
            while todo and len(left):
                near = np.bitwise_count(chain[left] ^ chain[todo.pop()]) <= most
                found, left = left[near], left[~near]
                root[found] = first
                todo += found.tolist()
    return root


def ring_groups(nodes: DataFrame, cell: int = CELL) -> DataFrame:
    """(k, node): the groups in which nodes of nodes(node, ring) may be similar, by their least node k; each in one at most.

    Ring is a wide_fingerprint(). By the pigeonring principle two rings within
    SPARE * RING bits (480 of 2560; at a Jaccard similarity of 0.8 some 390 differ, with a
    deviation of 18) have a start from which every chain of l segments differs in at most
    SPARE * l bits. The join key is a start whose own segment is equal; the chain of it and
    the AFTER segments that follow must be within its budget. A start is both with
    probability 0.070 at 0.8, so a pair there has none of the RING starts with
    probability 9e-6, and less above; of unlike pairs 1 in 30 million passes by any start.
    More rings behind the first one take part by their first start only.

    What chains join at any starts is one group, so a clump of near copies, whose nodes
    meet at nearly every start, is so only once. Starts meet in cells of about so many bytes, but none is
    split: a segment that many nodes share costs comparisons in the square of those that no
    chain joins to an earlier one.
    """
    room, parts = nodes.count() * START.itemsize, 1
    while parts < 1 << 16 and room > cell * parts:
        parts *= 2

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks([batch], 1 << 13):
                rings = b.column(1).to_pylist()
                node = np.repeat(b.column(0).to_numpy(), [len(r) // (RING * 2) for r in rings])
                ring = np.frombuffer(b"".join(rings), "<u2").reshape(-1, RING)
                for i in range(RING):
                    if i == 1:
                        first = np.concatenate(([True], node[1:] != node[:-1]))
                        node, ring = node[first], ring[first]
                        ring = np.concatenate((ring, ring[:, :AFTER]), axis=1)
                    start = np.empty(len(node), START)
                    start["key"], start["node"] = ring[:, i], node
                    start["chain"] = np.ascontiguousarray(ring[:, i + 1 : i + 1 + AFTER]).view("<u8").ravel()
                    part = start["key"] & np.uint16(parts - 1)
                    order = np.argsort(part, kind="stable")
                    edges = np.flatnonzero(np.concatenate(([True], np.diff(part[order]) != 0, [True])))
                    start = start[order]
                    cells = i * parts + part[order][edges[:-1]].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array([start[s:e].tobytes() for s, e in zip(edges[:-1], edges[1:])], pa.binary())], ["cell", "starts"])

    def meet(group: pa.Table) -> pa.Table:
        start = np.frombuffer(b"".join(group["starts"].to_pylist()), START)
        start = start[np.argsort(start["key"], kind="stable")]
        node = np.ascontiguousarray(start["node"])
        root = chained(np.ascontiguousarray(start["key"]), np.ascontiguousarray(start["chain"]))
        least = node.copy()
        np.minimum.at(least, root, node)
        among = (np.bincount(root, minlength=len(root)) > 1)[root]
        return pa.table({"k": least[root[among]], "node": node[among]})

    dealt = nodes.mapInArrow(deal, "cell int, starts binary").repartition(1 + room * RING // (2 * cell), "cell")
    met = dealt.groupBy("cell").applyInArrow(meet, "k bigint, node bigint")
    # a node's groups hang on the least of them before any join: a row a node, and one for each two least nodes
    least = met.groupBy("node").agg(F.collect_set("k").alias("all"), F.min("k").alias("b"))
    links = least.select(F.explode(F.array_append("all", F.col("node"))).alias("a"), "b").where("a <> b").distinct()
    roots = cut(connected_components(links).select(F.col("root").alias("k"), "node"))
    return roots.unionByName(roots.select("k", F.col("k").alias("node")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    component_id is the smallest doc_id reachable over links of at most radius
    differing bits, a document's own included. An empty table gives no rows.
    """
    marked = stored(fingerprints(docs, id_col, text_col, width))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(nodes, radius, crowded))
    placed = cut(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = placed.join(names, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Ids up to which those that go are broadcast against the documents; more are joined by a shuffle.
FEW = 500_000
KEY = "__plumbline_key"


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, crowded: int = CROWDED, similarity: float | None = None) -> DataFrame:
    """The rows of docs, all columns, of each near-duplicate class's smallest id; one row where that id repeats.

    With a similarity the classes are those of shingle sets at least so similar (see
    similar.py), without one those of near_duplicates().

    A row goes by its id and a hash of its text, so an id with different texts takes
    part in the class of each. Rows without an id come after all others, so a class
    keeps one of them only if it has no other row. Every class keeps exactly one row.
    Ids are numbers or strings. Null texts are empty, all texts without words are one
    class; very long texts are whole; ties go to the least id and then the least hash of
    the text. An empty table gives no rows. Other columns pass through, whatever their
    names (but for KEY).
    """
    number = F.lit("") if docs.schema[id_col].dataType.simpleString() == "string" else F.lit(0).cast(docs.schema[id_col].dataType)
    key = F.struct(F.col(id_col).isNull().alias("n"), F.coalesce(F.col(id_col), number).alias("id"), F.xxhash64(text_col).alias("text"))
    keyed = docs.select(key.alias("doc_id"), text_col)
    if similarity is None:
        found = near_duplicates(keyed, "doc_id", text_col, width, radius, crowded).select("doc_id", "component_id")
    else:
        from plumbline.llm.similar import similar_classes

        found = similar_classes(keyed, "doc_id", text_col, width, similarity)
    found = stored(found)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    if gone.count() <= FEW:
        gone = F.broadcast(gone)
    kept = docs.withColumn(KEY, key).join(gone, F.col(KEY) == gone.gone, "left_anti")
    if not found.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([KEY])
    return kept.drop(KEY)
