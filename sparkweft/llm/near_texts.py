"""Near-dedup of whole texts: SimHash under the segment-count grid, then an exact check.

A text has PRINTS fingerprints of 64 bits over its distinct words, each from hashes of
its own. Every fingerprint is embedded, joined and checked as in `simhash`: counts of
two-bit segments, grids whose cells fix some groups of them, the Manhattan bound and the
distance in bits. Two texts are candidates if one of their fingerprints lies within
RADIUS bits; no such pair is lost. Replaced words change few of the distinct words,
but five shingles each, so pairs whose shingles are similar at 0.8 are some four bits apart.

Candidates decide nothing: what they connect is gathered, and inside it all pairs that
share a shingle are counted exactly, by lists of the sets that hold each shingle. A
link stands where the Jaccard similarity of the five-word shingles is at least 0.8.

Equal shingle sets are made one before the join. Cells and candidate groups give
spanning forests of their links, never all pairs. Texts are shuffled once.

Defined results: null text is the empty text; a text of fewer words than a shingle
is one shingle; a null id is larger than all others; empty tables give empty
results; of rows that repeat id and text one stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_kind, batches, discard, importable, join_classes, keep_one, materialise, text_or_empty
from .components import components
from .near_dedup import shingles
from .simhash import BITS, EVEN, SMALL_CELL, agreement, grid_masks, thermometer

PRINTS, RADIUS = 6, 4
_draw = np.random.default_rng(64)
FACTORS = _draw.integers(0, 1 << 63, PRINTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words whose bits are counted at once.
AT_ONCE = 1 << 14


def prints(text: str) -> np.ndarray:
    """The fingerprints of the text's distinct words; without words all are zero."""
    words = set(text.encode("utf-8", "surrogatepass").lower().split())
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    counts = np.zeros(PRINTS * BITS, np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        x = hashes[at : at + AT_ONCE, None] * FACTORS
        x ^= x >> np.uint64(32)
        x *= MIX
        x ^= x >> np.uint64(29)
        bits = np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little")
        # uint8 sums of up to 255 rows are added without widening every bit.
        for k in range(0, len(bits), 255):
            counts += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)


def _prints(width: int):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            texts = batch.column(2).to_pylist()
            keys = np.array([xxhash.xxh64_intdigest(shingles(t, width).tobytes()) for t in texts], np.uint64)
            own = np.concatenate([prints(t) for t in texts]) if texts else np.zeros(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * PRINTS), pa.array(own.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys.view(np.int64)), lists], ["id", "doc", "key", "prints"])

    return run


def _warm(fp: np.ndarray) -> np.ndarray:
    """thermometer() of simhash on arrays."""
    even, high = np.uint64(EVEN), fp >> np.uint64(1)
    return ((fp | high) & even) | ((fp & high & even) << np.uint64(1))


def _forest(fp: np.ndarray, warm: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is connected inside one cell: the first row reaches out first."""
    left, out = np.arange(len(fp)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = (np.bitwise_count(warm[left] ^ warm[at]) <= RADIUS) & (np.bitwise_count(fp[left] ^ fp[at]) <= RADIUS)
            out += [(at, x) for x in left[near]]
            queue += left[near].tolist()
            left = left[~near]
    return out


def _near(cell: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates; cell is sorted and every cell is whole."""
    warm = _warm(fp)
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    sizes = np.diff(np.append(first, len(cell)))
    small = np.repeat(sizes <= SMALL_CELL, sizes)
    for shift in range(1, int(min(sizes.max(initial=1), SMALL_CELL))):
        i = np.flatnonzero((cell[shift:] == cell[:-shift]) & small[shift:])
        i = i[np.bitwise_count(warm[i] ^ warm[i + shift]) <= RADIUS]
        i = i[np.bitwise_count(fp[i] ^ fp[i + shift]) <= RADIUS]
        if len(i):
            yield key[i], key[i + shift]
    for a, n in zip(first[sizes > SMALL_CELL], sizes[sizes > SMALL_CELL]):
        pairs = _forest(fp[a : a + n], warm[a : a + n])
        if pairs:
            i, j = np.array(pairs).T
            yield key[a : a + n][i], key[a : a + n][j]


def _whole(found: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by their first column, as tables that hold each of its values whole."""
    rest: list[pa.RecordBatch] = []
    for batch in found:
        if not batch.num_rows:
            continue
        of = batch.column(0).to_numpy()
        cut = int(np.searchsorted(of, of[-1]))
        if rest and (cut or rest[-1].column(0)[0] != batch.column(0)[0]):
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)])
            rest = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest)


def _pairs(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])


def _cells(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _whole(found):
        cell, key, fp = (table.column(k).to_numpy() for k in range(3))
        for u, v in _near(cell, key, fp.view(np.uint64)):
            yield _pairs(u, v)


def linked_sets(sets: list[np.ndarray], fifths: int = 4) -> list[tuple[int, int]]:
    """Links that connect all sets of Jaccard similarity fifths / 5 and more, without
    comparing pairs that share nothing: a set is counted against all others at once."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, value, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    met = held[value] > 1
    owner, value = owner[met], value[met]
    holders, starts = owner[np.argsort(value, kind="stable")], np.append(0, np.cumsum(np.bincount(value, minlength=len(held))))
    at = np.searchsorted(owner, np.arange(len(sets) + 1))
    waiting, out = np.ones(len(sets), bool), []
    for root in range(len(sets)):
        if not waiting[root]:
            continue
        waiting[root] = False
        queue = [root]
        while queue:
            own = queue.pop()
            shared = [holders[starts[v] : starts[v + 1]] for v in value[at[own] : at[own + 1]].tolist()]
            both = np.bincount(np.concatenate(shared), minlength=len(sets)) if shared else np.zeros(len(sets), np.int64)
            near = np.flatnonzero(waiting & (both * 5 >= (sizes + sizes[own] - both) * fifths)).tolist()
            waiting[near] = False
            out += [(own, x) for x in near]
            queue += near
    return out


def _verified(width: int):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(found):
            group, key = table.column(0).to_numpy(), table.column(1).to_numpy()
            first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))).tolist()
            for a, b in zip(first, [*first[1:], len(group)]):
                links = linked_sets([shingles(t, width) for t in table.column(2).slice(a, b - a).to_pylist()])
                if links:
                    i, j = np.array(links).T
                    yield _pairs(key[a:b][i], key[a:b][j])

    return run


def candidates(sets: DataFrame) -> DataFrame:
    """sets (key, prints) -> (u, v): keys that connect all sets of which one fingerprint
    lies within RADIUS bits."""
    masks = F.array(*[F.lit(m) for m in grid_masks(RADIUS, agreement(sets.count()) - 1)])
    cells = (
        sets.select("key", F.posexplode("prints").alias("of", "fp"))
        .select("key", "of", "fp", thermometer(F.col("fp")).alias("warm"), F.posexplode(masks).alias("grid", "mask"))
        .select(F.xxhash64("of", "grid", F.col("warm").bitwiseAND(F.col("mask"))).alias("cell"), "key", "fp")
    )
    with batches(sets.sparkSession, 100_000):
        return materialise(cells.repartition("cell").sortWithinPartitions("cell", "key").mapInArrow(_cells, "u long, v long").distinct(), "near-candidates")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(id, doc, group, component_id): doc is the text's xxhash64, group a number of the
    component, component_id the smallest id reachable by links."""
    spark = docs.sparkSession
    importable(spark)
    kind, _ = arrow_kind(docs, id_col)
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).select("id", F.xxhash64("text").alias("doc"), "text")
    with batches(spark, 1000):
        rows = materialise(texts.mapInArrow(_prints(width), f"id {kind}, doc long, key long, prints array<long>"), "near-prints")
    sets = materialise(rows.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.min("doc").alias("doc"), F.min("prints").alias("prints")), "near-sets")
    tried = candidates(sets.select("key", "prints"))
    near = materialise(components(tried), "near-groups")
    met = sets.select("key", "doc").join(near.select(F.col("node").alias("key"), F.col("component").alias("gathered")), "key")
    read = texts.select("doc", "text").join(met.hint("merge"), "doc").groupBy("gathered", "key").agg(F.min("text").alias("text"))
    with batches(spark, 200):
        links = materialise(read.repartition("gathered").sortWithinPartitions("gathered").select("gathered", "key", "text").mapInArrow(_verified(width), "u long, v long"), "near-links")
    linked = materialise(components(links), "near-components")
    least = linked.join(sets, linked.node == sets.key).groupBy("component").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "component").select("node", "component_id", F.col("component").alias("group"))
    classes = sets.join(named, sets.key == named.node, "left").select("key", "n", F.coalesce("group", "key").alias("group"), F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    classes = materialise(classes, "near-classes")
    discard(sets, tried, near, links, linked)
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return join_classes(rows.select("id", "doc", "key"), classes, "key", "n", total).select("id", "doc", "group", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """The rows of docs with one row of each component: that of the smallest id."""
    return keep_one(docs, near_components(docs, id_col, text_col, width).select("id", "doc", "group"), id_col, text_col)
