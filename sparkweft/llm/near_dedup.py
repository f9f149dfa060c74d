"""Near-dedup by the Jaccard similarity of word shingles.

A text is the set of its hashed shingles of `width` words. MinHash signatures of
80 values in 16 bands of five give candidates: a pair of similarity 0.8 shares a
band with probability 1 - (1 - 0.8^5)^16 = 0.998. Candidates whose signatures
agree in too few values for 0.8 (44 of 80: over five deviations below the mean)
are left out; for all others the shingles of both texts are compared, and a link
stands only at the stated similarity or above. Of each group of linked texts the
row of the smallest id stays.

Equal sets are made one before the join. In a band's cell of up to SMALL_CELL sets
every pair is a candidate. In a larger one a set that agrees almost fully with
another, or has ENOUGH candidates, is first looked at through these alone; then
rounds go over all large cells again, and compare what candidates across the
components found so far were passed over, until none is left. So every candidate
of every cell is either compared or inside one component.

Defined results: null text is the empty text; a text of fewer words than a shingle
is one shingle; a null id is larger than all others; empty tables give empty
results; of rows that repeat id and text one stays.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_kind, batches, importable, join_classes, keep_one, materialise, text_or_empty
from .components import components

BANDS, WITHIN = 16, 5
VALUES = BANDS * WITHIN
_draw = np.random.default_rng(42)
FACTORS = _draw.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _draw.integers(0, 1 << 63, VALUES, dtype=np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Agreeing values below which no pair is a candidate, and from which one set stands for the other.
LOW, HIGH = 44, 74
SMALL_CELL, ENOUGH = 32, 3
#: Pairs of two components that a first round compares; each further round compares so many times more.
ACROSS = 64
AT_ONCE = 1 << 12
#: Hashes of sets that a task keeps at hand while it compares pairs.
HELD = 1 << 21


def shingles(text: str, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, stops = [0, *ends[:-width].tolist()], (ends - 1).tolist()[width - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops)], np.uint64))


def similar(a: np.ndarray, b: np.ndarray, fifths: int = 4) -> bool:
    """Whether the Jaccard similarity is at least fifths / 5."""
    if min(len(a), len(b)) * 5 < max(len(a), len(b)) * fifths:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * 5 >= (len(a) + len(b) - both) * fifths


def signature(found: np.ndarray) -> tuple[bytes, list[int]]:
    """One byte of each MinHash value, and the hashes of the bands."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), AT_ONCE):
        np.minimum(least, (found[at : at + AT_ONCE, None] * FACTORS + TERMS).min(axis=0), out=least)
    bands = least.reshape(BANDS, WITHIN)
    return ((least * MIX) >> np.uint64(56)).astype(np.uint8).tobytes(), [xxhash.xxh64_intdigest(bands[k].tobytes(), k) for k in range(BANDS)]


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, signs, bands = [], [], []
            for text in batch.column(2).to_pylist():
                found = shingles(text, width)
                sign, band = signature(found)
                keys.append(xxhash.xxh64_intdigest(found.tobytes()))
                signs.append(sign)
                bands += band
            n = len(keys)
            values = pa.array(np.array(bands, np.uint64).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(signs, pa.binary()), lists], ["id", "doc", "key", "sign", "bands"])

    return run


def _among(sign: np.ndarray) -> list[tuple[int, int]]:
    """Candidates inside one large cell."""
    left, got, out = np.arange(len(sign)), np.zeros(len(sign), np.int64), []
    queue: list[int] = []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        at = queue.pop()
        agree = (sign[left] == sign[at]).sum(axis=1)
        near = agree >= LOW
        out += [(at, int(x)) for x in left[near]]
        got[left[near]] += 1
        done = (agree >= HIGH) | (near & (got[left] >= ENOUGH))
        queue += left[done].tolist()
        left = left[~done]
    return out


def _across(sign: np.ndarray, group: np.ndarray, most: int) -> tuple[list[tuple[int, int]], bool]:
    """Candidates of a cell between different groups, at most so many for two groups,
    and whether that bound left any out."""
    order = np.argsort(group, kind="stable")
    sign, group = sign[order], group[order]
    stops = np.searchsorted(group, group, side="right")
    met: Counter[tuple[int, int]] = Counter()
    out, more = [], False
    for at, stop in enumerate(stops.tolist()):
        for x in (stop + np.flatnonzero((sign[stop:] == sign[at]).sum(axis=1) >= LOW)).tolist():
            two = (int(group[at]), int(group[x]))
            met[two] += 1
            if met[two] <= most:
                out.append((int(order[at]), int(order[x])))
            else:
                more = True
    return out, more


def _pairs(cell: np.ndarray, key: np.ndarray, sign: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """cell is sorted; every cell is whole."""
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    sizes = np.diff(np.append(first, len(cell)))
    small = np.repeat(sizes <= SMALL_CELL, sizes)
    for shift in range(1, int(min(sizes.max(initial=1), SMALL_CELL))):
        i = np.flatnonzero((cell[shift:] == cell[:-shift]) & small[shift:])
        i = i[(sign[i] == sign[i + shift]).sum(axis=1) >= LOW]
        if len(i):
            yield key[i], key[i + shift]
    for a, n in zip(first[sizes > SMALL_CELL], sizes[sizes > SMALL_CELL]):
        found = _among(sign[a : a + n])
        if found:
            i, j = np.array(found).T
            yield key[a : a + n][i], key[a : a + n][j]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Batches sorted by cell, as arrays that hold every cell whole."""
    rest: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, key, *more = (batch.column(k).to_numpy() for k in range(batch.num_columns) if k != 2)
        rows = (cell, key, np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, VALUES), *more)
        cut = int(np.searchsorted(cell, cell[-1]))
        if cut or rest and rest[-1][0][-1] != cell[0]:
            rest.append(tuple(x[:cut] for x in rows))
            yield tuple(np.concatenate(x) for x in zip(*rest))
            rest = []
        rest.append(tuple(x[cut:] for x in rows))
    if rest:
        yield tuple(np.concatenate(x) for x in zip(*rest))


def _found(u: np.ndarray, v: np.ndarray, flag: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v)), pa.array(np.full(len(u), flag))], ["u", "v", "flag"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, flag): candidates, and with flag the large cells themselves, as u and v."""
    for cell, key, sign in _whole(batches):
        for a, b in _pairs(cell, key, sign):
            yield _found(a, b, False)
        cells, sizes = np.unique(cell, return_counts=True)
        large = cells[sizes > SMALL_CELL]
        yield _found(large, large, True)


def _rounds(most: int):
    """(u, v, flag): candidates between components; flag: some of their cell were left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, key, sign, group in _whole(batches):
            first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            for a, b in zip(first, np.append(first[1:], len(cell))):
                pairs, more = _across(sign[a:b], group[a:b], most)
                if pairs:
                    i, j = np.array(pairs).T
                    yield _found(key[a:b][i], key[a:b][j], more)

    return run


def _verified(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        held = 0

        def of(key: int, text: str) -> np.ndarray:
            nonlocal held
            if key not in known:
                if held > HELD:
                    known.clear()
                    held = 0
                known[key] = shingles(text, width)
                held += len(known[key])
            return known[key]

        for batch in batches:
            u, v, a, b = (batch.column(k).to_pylist() for k in range(4))
            keep = [similar(of(u[k], a[k]), of(v[k], b[k])) for k in range(len(u))]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(sets: DataFrame, texts: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(u, v): the pairs whose texts, one for each set that is in a pair, are similar."""
    met = pairs.select(F.col("u").alias("key")).unionByName(pairs.select(F.col("v").alias("key"))).distinct()
    met = sets.select("key", "doc").join(met.hint("merge"), "key")
    read = texts.select("doc", "text").join(met.hint("merge"), "doc").groupBy("key").agg(F.min("text").alias("text"))
    read = materialise(read, "near-texts")
    both = pairs.hint("merge").join(read.select(F.col("key").alias("v"), F.col("text").alias("b")), "v").hint("merge").join(read.select(F.col("key").alias("u"), F.col("text").alias("a")), "u")
    with batches(pairs.sparkSession, 200):
        return materialise(both.select("u", "v", "a", "b").mapInArrow(_verified(width), "u long, v long"), "near-links")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(id, doc, group, component_id): doc is the text's xxhash64, group a number of the
    component, component_id the smallest id reachable by links of similarity 0.8 and more."""
    spark = docs.sparkSession
    importable(spark)
    kind, _ = arrow_kind(docs, id_col)
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).select("id", F.xxhash64("text").alias("doc"), "text")
    with batches(spark, 1000):
        rows = materialise(texts.mapInArrow(_signatures(width), f"id {kind}, doc long, key long, sign binary, bands array<long>"), "near-signatures")
    sets = materialise(rows.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.min("doc").alias("doc"), F.min("sign").alias("sign"), F.min("bands").alias("bands")), "near-sets")
    cells = sets.select(F.explode("bands").alias("cell"), "key", "sign")
    with batches(spark, 20_000):
        found = materialise(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cells, "u long, v long, flag boolean").distinct(), "near-candidates")
    tried = found.where("NOT flag").select("u", "v")
    links = _links(sets, texts, tried, width)
    linked = materialise(components(links), "near-components")
    open_cells = cells.join(found.where("flag").select(F.col("u").alias("cell")), "cell")
    open_cells = materialise(open_cells, "near-open-cells")
    most, ended = ACROSS, open_cells.isEmpty()
    while not ended:
        named = open_cells.join(linked, open_cells.key == linked.node, "left").select("cell", "key", "sign", F.coalesce("component", "key").alias("group"))
        with batches(spark, 20_000):
            across = materialise(named.repartition("cell").sortWithinPartitions("cell").mapInArrow(_rounds(most), "u long, v long, flag boolean"), "near-candidates")
        fresh = materialise(across.select("u", "v").distinct().join(tried, ["u", "v"], "left_anti"), "near-fresh")
        if not fresh.isEmpty():
            tried, more = tried.unionByName(fresh), _links(sets, texts, fresh, width)
            if not more.isEmpty():
                links = links.unionByName(more)
                linked = materialise(components(links), "near-components")
        ended = across.where("flag").isEmpty()
        most *= ACROSS
    least = linked.join(sets, linked.node == sets.key).groupBy("component").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "component").select("node", "component_id", F.col("component").alias("group"))
    classes = sets.join(named, sets.key == named.node, "left").select("key", "n", F.coalesce("group", "key").alias("group"), F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    classes = materialise(classes, "near-classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return join_classes(rows.select("id", "doc", "key"), classes, "key", "n", total).select("id", "doc", "group", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """The rows of docs with one row of each component: that of the smallest id."""
    return keep_one(docs, near_components(docs, id_col, text_col, width).select("id", "doc", "group"), id_col, text_col)
