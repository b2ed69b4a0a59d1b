"""Near-duplicate classes by SimHash and the Jaccard similarity of word shingles.

A document is its set of shingles: each `width` words of the A-Z-lowered text, by a
64-bit hash; fewer words are one shingle. Two documents link if their sets' similarity
is at least `least`, checked on the whole sets. Candidates are found by SimHash: chains
of the ring of wide fingerprints (simhash.ring_groups(), with the probability of a miss,
which is made for 0.8 and more). Few shingles make coarse bits, so a set of up to SMALL
also stands there as each set that lacks one of them: of so small sets none is missed.

Equal sets become one node first. Candidates that any starts of the ring join are one
group, and a text is in one only. Its texts meet in one task if they have at most
WEIGHT shingles together; else they are dealt to parts of about that size, and every
two parts meet. A task compares a text with those that no link found there yet joins it
to, and returns links that span what it found: a link inside a component changes
nothing. No group is capped. The rows of a group grow with its nodes times its parts;
a group of very many texts that are alike, but not alike enough, costs comparisons in
the square of its size.

Null texts are empty texts; all texts without words are one class. Very long texts are
whole sets like others, and met one at a time. Repeated rows each get a row. An empty
table gives no rows. Other columns have no effect.
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
from plumbline.llm.simhash import ring_groups, wide_fingerprint
from plumbline.llm.words import mixed, word_hashes

#: Shingles of a set up to which it stands as its parts, too.
SMALL = 8
#: Shingles of a group's texts that meet in one task.
WEIGHT = 1 << 20


def shingles(text: bytes, width: int) -> np.ndarray:
    """The sorted different shingles, hashed."""
    h = word_hashes(text.translate(LOWER_AZ))
    n = len(h) - width + 1
    if not len(h):
        return h
    key = np.zeros(max(n, 1), np.uint64)
    for i in range(min(width, len(h))):
        key = key * np.uint64(0xD6E8FEB86659FD93) + h[i : i + len(key)]
    return np.unique(mixed(key))


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def rings(own: np.ndarray, least: float) -> bytes:
    """The wide fingerprint of a set and, if it is small, of all that lack one shingle; none if only equal sets are similar."""
    if len(own) * (1 - least) < least - 1e-9:
        return b""
    parts = [np.delete(own, i) for i in range(len(own))] if len(own) <= SMALL else []
    return b"".join(map(wide_fingerprint, [own, *parts]))


def marks(docs: DataFrame, id_col: str, text_col: str, width: int, least: float) -> DataFrame:
    """(doc_id, node, n, ring) of every row; node is the hash of its n shingles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            nodes, sizes, ring = [], [], []
            for text in b.column(1).to_pylist():
                own = shingles(text, width)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), 1))
                sizes.append(len(own))
                ring.append(rings(own, least))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_signed(nodes)), pa.array(sizes, pa.int64()), pa.array(ring, pa.binary())], ["doc_id", "node", "n", "ring"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), as_bytes(text_col).alias("data")).mapInArrow(run, f"doc_id {kind}, node bigint, n bigint, ring binary")


def meetings(nodes: DataFrame, weight: int) -> DataFrame:
    """(node, least, at): where each node of nodes(node, least, n, ring) meets others; at has structs (k, i, j, part): a group, the two parts that meet, and the node's own."""
    groups = ring_groups(nodes.select("node", "ring").where("length(ring) > 0"))
    keys = nodes.select("node", "least", "n").join(groups, "node")
    once = cut(keys.groupBy("k").agg(F.sum("n").alias("weight")).select("k", F.ceil(F.col("weight") / weight).cast("int").alias("parts")))
    members = keys.join(once, "k").withColumn("part", F.pmod(F.xxhash64("node"), F.greatest("parts", F.lit(1))).cast("int"))
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.col("parts") - 1, F.lit(0))), lambda j: F.struct(F.col("k"), F.least("part", j).alias("i"), F.greatest("part", j).alias("j"), F.col("part")))
    return members.groupBy("node", "least").agg(F.flatten(F.collect_list(each)).alias("at"))


def spanning_links(sets: list[np.ndarray], part: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links between the numbers of sets, enough to join all that pairs of at least the similarity join; of sets in two parts only pairs across."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel() if sizes.sum() else np.zeros(0, np.int64)
    starts = np.cumsum(sizes) - sizes
    held, root, out = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool), np.arange(len(sets)), []
    across = len(np.unique(part)) > 1
    for x in range(len(sets) - 1):
        near = np.arange(x + 1, len(sets))
        near = near[(root[near] != root[x]) & (np.minimum(sizes[near], sizes[x]) >= least * np.maximum(sizes[near], sizes[x]) - 1e-9) & ((part[near] != part[x]) if across else True)]
        if not len(near):
            continue
        own = ids[starts[x] : starts[x] + sizes[x]]
        held[own] = True
        ends = np.cumsum(sizes[near])
        at = np.repeat(starts[near] - (ends - sizes[near]), sizes[near]) + np.arange(int(ends[-1]))
        common = np.add.reduceat(held[ids[at]].astype(np.int64), ends - sizes[near]) if len(at) else np.zeros(len(near), np.int64)
        held[own] = False
        for y in near[common >= least * (sizes[near] + sizes[x] - common) - 1e-9].tolist():
            if root[y] != root[x]:
                root[root == root[y]] = root[x]
                out.append((x, y))
    return out


def links_where_they_meet(texts: DataFrame, width: int, least: float) -> DataFrame:
    """Links (a, b) of texts(k, i, j, part, node, data), which are sorted by place within partitions."""
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, {}

        def found() -> pa.RecordBatch:
            nodes = list(held)
            pairs = spanning_links([held[n][1] for n in nodes], np.array([held[n][0] for n in nodes]), least)
            return pa.RecordBatch.from_arrays([pa.array([nodes[p[i]] for p in pairs], pa.int64()) for i in (0, 1)], schema=kinds)

        for b in chunks(batches):
            for k, i, j, part, node, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (k, i, j) != place:
                    if len(held) > 1:
                        yield found()
                    place, held = (k, i, j), {}
                if node not in held:
                    held[node] = (part, shingles(data, width))
        if len(held) > 1:
            yield found()

    return texts.mapInArrow(run, "a bigint, b bigint")


#: Nodes that meet others up to which they are broadcast against the documents; more are joined by a shuffle.
FEW = 100_000


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, weight: int = WEIGHT) -> DataFrame:
    """(doc_id, component_id) for every row of docs; component_id is the smallest doc_id reachable over links.

    Of rows with the same id the texts must be the same; see simhash.keep_representatives().
    """
    marked = stored(marks(docs, id_col, text_col, width, least))
    nodes = stored(marked.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("ring").alias("ring")))
    where = stored(meetings(nodes, weight))
    if where.count() <= FEW:
        where = F.broadcast(where)
    texts = docs.select(F.col(id_col).alias("doc_id"), as_bytes(text_col).alias("data")).join(where, F.col("doc_id").eqNullSafe(F.col("least")))
    texts = texts.select(F.explode("at").alias("at"), "node", "data").select("at.k", "at.i", "at.j", "at.part", "node", "data")
    links = links_where_they_meet(texts.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j"), width, least)
    roots = connected_components(links).withColumnRenamed("node", "at")
    placed = cut(nodes.select("node", "least").join(roots, nodes.node == roots["at"], "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.select("doc_id", "node").join(placed.join(names, "root").select("node", "component_id"), "node").select("doc_id", "component_id")
