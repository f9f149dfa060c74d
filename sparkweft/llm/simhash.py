"""SimHash near-dedup with a segment-popcount embedding.

A fingerprint of 64 bits is mapped to the bit counts of its 32 segments of two
bits. The Manhattan distance of two such vectors is a lower bound of the Hamming
distance, so fingerprints that link at `radius` bits lie within that Manhattan
distance. The 32 coordinates are dealt into radius + 3 groups: two vectors within
the radius differ in at most `radius` groups, and so agree in at least three (larger
tables take finer grids: radius + 4 groups, four of them). Each choice of groups is a grid whose cells are the counts in these groups; a
range join looks only inside cells, drops pairs by the Manhattan bound and
verifies the rest bit by bit. No pair is lost, and no pair outside a cell is met.

Equal fingerprints are made one before the join; a cell returns a spanning
forest of its links, never all pairs. Cells pass through tasks in sorted order.

Defined results: null text is the empty text, whose fingerprint is zero and is
linked like any other; a null id is ignored as a smallest id; empty tables
give empty results; rows that repeat stay rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_kind, batches, importable, join_classes, keep_one, materialise, text_or_empty
from .components import components

BITS, EVEN = 64, 0x5555555555555555
#: Rows of a cell up to which neighbours are compared by shifting the sorted column.
SMALL_CELL = 32
#: Shingles of a long text that are counted at once.
AT_ONCE = 1 << 16


def fingerprint(text: str, width: int = 4) -> int:
    """A bit is 1 if more than half of the shingles' hashes have it set."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[:-1])).tolist()
    stops = (ends - 1).tolist()[width - 1 :] if n >= width else [len(joined)]
    digest = xxhash.xxh64_intdigest
    counts, shingles = np.zeros(BITS, np.int64), len(stops)
    for at in range(0, shingles, AT_ONCE):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + AT_ONCE], stops[at : at + AT_ONCE])], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # uint8 sums of up to 255 rows are added without widening every bit.
        for block in range(0, len(bits), 255 * 64):
            part = bits[block : block + 255 * 64]
            full = len(part) // 255 * 255
            if full:
                counts += part[:full].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
            counts += part[full:].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(counts * 2 > shingles, bitorder="little").tobytes(), "little")


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp): the fingerprint of every row's whole text, as a signed long."""
    importable(docs.sparkSession)
    kind, _ = arrow_kind(docs, id_col)
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(_fingerprints(width), f"id {kind}, fp long")


def thermometer(fp: Column) -> Column:
    """The segment counts 0, 1, 2 as the bits 00, 01, 11: Manhattan distances
    become bit counts of a XOR, and a mask chooses coordinates."""
    high = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(high).bitwiseAND(F.lit(EVEN)).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(F.lit(EVEN)), 1))


def grid_masks(radius: int, agree: int = 3) -> list[int]:
    """One mask for each choice of `agree` among radius + agree groups of coordinates."""
    groups = radius + agree
    masks = [sum(3 << (2 * s) for s in range(32) if s * groups // 32 == g) for g in range(groups)]
    signed = [sum(masks[g] for g in chosen) for chosen in combinations(range(groups), agree)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in signed]


def agreement(n: int) -> int:
    """How many groups a cell fixes: 3 (cells of some 14 coordinates), and finer grids,
    with fewer rows in each cell, for more fingerprints. Every grid is exact."""
    return 3 + (n > 1 << 22) + (n > 1 << 29)


def _forest(fp: np.ndarray, warm: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what is connected inside one cell."""
    left, out = np.arange(len(fp)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = left[np.bitwise_count(warm[left] ^ warm[at]) <= radius]
            near = near[np.bitwise_count(fp[near] ^ fp[at]) <= radius]
            if len(near):
                out += [(at, x) for x in near]
                queue += near.tolist()
                left = np.setdiff1d(left, near, assume_unique=True)
    return out


def _cells(radius: int):
    def links(cell: np.ndarray, fp: np.ndarray, warm: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """cell is sorted; every cell is whole."""
        first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        sizes = np.diff(np.append(first, len(cell)))
        large = first[sizes > SMALL_CELL]
        among = np.repeat(sizes <= SMALL_CELL, sizes)
        for shift in range(1, int(min(sizes.max(initial=1), SMALL_CELL))):
            i = np.flatnonzero((cell[shift:] == cell[:-shift]) & among[shift:])
            i = i[np.bitwise_count(warm[i] ^ warm[i + shift]) <= radius]
            i = i[np.bitwise_count(fp[i] ^ fp[i + shift]) <= radius]
            if len(i):
                yield fp[i], fp[i + shift]
        for a in large:
            b = a + sizes[np.searchsorted(first, a)]
            pairs = _forest(fp[a:b], warm[a:b], radius)
            if pairs:
                i, j = np.array(pairs).T
                yield fp[a:b][i], fp[a:b][j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def done(parts):
            for a, b in links(*(np.concatenate(x) for x in zip(*parts))) if parts else ():
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a.view(np.int64), b.view(np.int64))), pa.array(np.minimum(a.view(np.int64), b.view(np.int64)))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column(0).to_numpy()
            fp, warm = (batch.column(k).to_numpy().view(np.uint64) for k in (1, 2))
            if cell[0] != cell[-1] or rest and rest[-1][0][-1] != cell[0]:
                cut = int(np.searchsorted(cell, cell[-1]))
                rest.append((cell[:cut], fp[:cut], warm[:cut]))
                yield from done([x for x in rest if len(x[0])])
                rest = [(cell[cut:], fp[cut:], warm[cut:])]
            else:
                rest.append((cell, fp, warm))
        yield from done(rest)

    return run


def links(distinct: DataFrame, radius: int = 4, agree: int = 3) -> DataFrame:
    """distinct (fp) -> (u, v): links that connect all that lies within the radius."""
    masks = F.array(*[F.lit(m) for m in grid_masks(radius, agree)])
    cells = (
        distinct.select("fp", thermometer(F.col("fp")).alias("warm"))
        .select("fp", "warm", F.posexplode(masks).alias("grid", "mask"))
        .select(F.xxhash64("grid", F.col("warm").bitwiseAND(F.col("mask"))).alias("cell"), "fp", "warm")
    )
    found = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cells(radius), "u long, v long")
    with batches(distinct.sparkSession, 100_000):
        return materialise(found.distinct(), "links")


def _components(rows: DataFrame, radius: int) -> DataFrame:
    """rows (id, fp, ..) -> with component_id, the smallest id reachable, and group, the
    smallest fingerprint reachable."""
    distinct = materialise(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "fingerprint-classes")
    size = distinct.agg(F.count(F.lit(1)).alias("classes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    linked = materialise(components(links(distinct.select("fp"), radius, agreement(size.classes))), "components")
    least = linked.join(distinct, linked.node == distinct.fp).groupBy("component").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "component").select("node", "component_id", F.col("component").alias("group"))
    classes = distinct.join(named, distinct.fp == named.node, "left").select("fp", "n", F.coalesce("group", "fp").alias("group"), F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return join_classes(rows, materialise(classes, "classes"), "fp", "n", size.rows)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id reachable by links."""
    rows = materialise(fingerprints(docs, id_col, text_col, width), "fingerprints")
    return _components(rows, radius).select("id", "fp", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """The rows of docs with one row of each component: that of the smallest id."""
    texts = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("doc")).alias("both"), F.col(text_col))
    rows = materialise(fingerprints(texts, "both", text_col, width).select("id.id", "id.doc", "fp"), "fingerprints")
    return keep_one(docs, _components(rows, radius).select("id", "doc", "group"), id_col, text_col)
