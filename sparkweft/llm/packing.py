"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token ids; longer ones than a sequence are cut into pieces.
Pieces that fill a sequence are done. The others are dealt at random into
shards of bounded size, and each shard is packed by best fit in decreasing
order. A shard that meets the lower bound ceil(tokens / capacity) is optimal;
each other shard evolves on several islands. A crossover injects whole
well-filled bins of one parent into the other, removes the bins that hold
duplicates of the injected documents, and places the displaced documents by
best fit. After each round the islands' elites migrate to the next island.

Bins that end loosely filled are emptied and their documents packed again,
together with those of all other shards, level by level: the waste of a shard isn't
the waste of the whole. No task holds more than a shard.

Defined results: null text is the empty text, which is one piece of the end token;
rows that repeat are packed as often as they occur; empty tables give empty
results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import arrow_kind, batches, discard, importable, materialise, text_or_empty

#: Documents of a shard; islands; rounds of migration; generations of a round; genomes of an island.
SHARD, ISLANDS, ROUNDS, GENERATIONS, POPULATION = 4096, 3, 2, 6, 4
#: Bins filled to less than this share are packed again with those of other shards.
TIGHT = 0.995


# -- token pieces ---------------------------------------------------------------


def _cut(path: str, capacity: int, end: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = bpe.encoder(path), np.array([end], "<u4")
        for batch in batches:
            rows = []
            for doc, own in zip(batch.column(0).to_pylist(), encoder.encode_batch(batch.column(1).to_pylist())):
                ids = np.concatenate((own, last))
                rows += [(doc, k, at, len(part := ids[at : at + capacity]), zlib.crc32(part.tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
            columns = list(zip(*rows)) or [()] * 5
            types = (kind, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's token pieces."""
    importable(docs.sparkSession)
    kind, arrow = arrow_kind(docs, id_col)
    named = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return named.mapInArrow(_cut(vocabulary, capacity, end, arrow), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# -- one shard --------------------------------------------------------------------


class Open:
    """Bins by the space they have left; a set bit of mask says that there is one."""

    def __init__(self, capacity: int, space: list[int]):
        self.capacity, self.space, self.mask = capacity, space, 0
        self.having: list[list[int]] = [[] for _ in range(capacity + 1)]
        for b, s in enumerate(space):
            self._add(b, s)

    def _add(self, b: int, s: int) -> None:
        self.having[s].append(b)
        self.mask |= 1 << s

    def place(self, size: int) -> int:
        """The bin that leaves the least space, or a new one."""
        fits = self.mask >> size
        if fits:
            s = size + (fits & -fits).bit_length() - 1
            b = self.having[s].pop()
            if not self.having[s]:
                self.mask ^= 1 << s
        else:
            b, s = len(self.space), self.capacity
            self.space.append(s)
        self.space[b] = s - size
        self._add(b, s - size)
        return b


def best_fit(sizes: np.ndarray, capacity: int, order: np.ndarray) -> np.ndarray:
    bins, genome = Open(capacity, []), np.zeros(len(sizes), np.int32)
    for i in order.tolist():
        genome[i] = bins.place(int(sizes[i]))
    return genome


def fitness(genome: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first; then a few full bins beat many even ones."""
    fill = np.bincount(genome, sizes)
    return -len(fill), float(((fill / capacity) ** 2).mean())


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    fill = np.bincount(a, sizes)
    well = np.argsort(-fill, kind="stable")[: max(1, len(fill) // 2)]
    chosen = rng.choice(well, max(1, len(well) // 2), replace=False)
    injected = np.isin(a, chosen)
    broken = np.unique(b[injected])
    displaced = np.isin(b, broken) & ~injected
    # The loosest bin is opened as well, so that a child can be better than both parents.
    kept = ~injected & ~displaced
    if kept.any():
        of_b = np.bincount(b[kept], sizes[kept], minlength=int(b.max()) + 1)
        loosest = int(np.argmin(np.where(of_b > 0, of_b, np.inf)))
        displaced |= kept & (b == loosest)
        kept &= b != loosest
    child = np.zeros(len(a), np.int32)
    _, child[injected] = np.unique(a[injected], return_inverse=True)
    n = len(chosen)
    if kept.any():
        _, own = np.unique(b[kept], return_inverse=True)
        child[kept] = own + n
    rest = np.flatnonzero(displaced)
    placed = injected | kept
    space = (capacity - np.bincount(child[placed], sizes[placed])).astype(int).tolist()
    bins = Open(capacity, space)
    for i in rest[np.argsort(-sizes[rest], kind="stable")].tolist():
        child[i] = bins.place(int(sizes[i]))
    return child


def evolve(population: list[np.ndarray], sizes: np.ndarray, capacity: int, generations: int, size: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The elite of some generations; it ends when a genome meets the lower bound."""
    least = -(-int(sizes.sum()) // capacity)
    scored = [(fitness(g, sizes, capacity), g) for g in population]
    while len(scored) < size:
        jitter = np.argsort(-(sizes * rng.uniform(0.7, 1.3, len(sizes))), kind="stable")
        g = best_fit(sizes, capacity, jitter)
        scored.append((fitness(g, sizes, capacity), g))
    for _ in range(generations):
        scored.sort(key=lambda x: x[0], reverse=True)
        if -scored[0][0][0] <= least:
            break
        scored = scored[:size]
        for _ in range(size):
            i, j = rng.choice(len(scored), 2, replace=False)
            g = crossover(scored[i][1], scored[j][1], sizes, capacity, rng)
            scored.append((fitness(g, sizes, capacity), g))
    scored.sort(key=lambda x: x[0], reverse=True)
    return [g for _, g in scored[: max(1, size // 2)]]


# -- all shards --------------------------------------------------------------------


def _canonical(items: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    rows, sizes = items.column("row").to_numpy(), items.column("length").to_numpy()
    order = np.lexsort((rows, -sizes))
    return rows[order], sizes[order]


def _placed(rows: np.ndarray, sizes: np.ndarray, shard: int, genome: np.ndarray, done: bool) -> pa.Table:
    fill = np.bincount(genome, sizes)
    order = np.argsort(genome, kind="stable")
    before = np.cumsum(sizes[order]) - sizes[order]
    first = np.concatenate(([0], np.cumsum(fill)[:-1])).astype(np.int64)
    offsets = np.empty(len(sizes), np.int64)
    offsets[order] = before - first[genome[order]]
    n = len(rows)
    return pa.table({"row": rows, "length": sizes, "shard": np.full(n, shard, np.int64), "bin": genome.astype(np.int64), "offset": offsets, "fill": fill[genome].astype(np.int64), "done": np.full(n, done)})


PLACED = "row long, length long, shard long, bin long, offset long, fill long, done boolean"
STATE = "shard long, island int, bins int, fit double, genome binary"


def _first(capacity: int):
    def run(items: pa.Table) -> pa.Table:
        rows, sizes = _canonical(items)
        genome = best_fit(sizes, capacity, np.arange(len(sizes)))
        done = int(genome.max()) + 1 <= -(-int(sizes.sum()) // capacity)
        return _placed(rows, sizes, items.column("shard")[0].as_py(), genome, done)

    return run


def _island(capacity: int, round_no: int):
    def run(items: pa.Table, state: pa.Table) -> pa.Table:
        _, sizes = _canonical(items)
        shard, island = items.column("shard")[0].as_py(), items.column("island")[0].as_py()
        rng = np.random.default_rng([shard, island, round_no])
        known = {g: None for g in sorted(state.column("genome").to_pylist())} if state.num_rows else {}
        population = [np.frombuffer(g, np.int32) for g in known] or [best_fit(sizes, capacity, np.arange(len(sizes)))]
        elite = evolve(population, sizes, capacity, GENERATIONS, POPULATION, rng)
        scores = [fitness(g, sizes, capacity) for g in elite]
        n = len(elite)
        return pa.table({"shard": pa.array([shard] * n, pa.int64()), "island": pa.array([island] * n, pa.int32()), "bins": pa.array([-s[0] for s in scores], pa.int32()), "fit": [s[1] for s in scores], "genome": pa.array([g.astype(np.int32).tobytes() for g in elite], pa.binary())})

    return run


def _last(capacity: int):
    def run(items: pa.Table, best: pa.Table) -> pa.Table:
        rows, sizes = _canonical(items)
        return _placed(rows, sizes, items.column("shard")[0].as_py(), np.frombuffer(best.column("genome")[0].as_py(), np.int32), True)

    return run


#: Tasks of a level at most; each takes several shards beyond that.
TASKS = 10_000


def pack_shards(items: DataFrame, shards: int, level: int, capacity: int) -> DataFrame:
    """items (row, length) -> where each is placed, in bins of its shard.

    The tasks are numbered by shards and islands, not by bytes: these are few, and
    the work on them is long."""
    tasks = min(shards, TASKS)
    dealt = items.select("row", "length", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(shards)).alias("shard"))
    first = materialise(dealt.repartition(tasks, "shard").groupBy("shard").applyInArrow(_first(capacity), PLACED), "packed")
    open_items = first.where("NOT done").select("row", "length", "shard")
    if open_items.isEmpty():
        return first
    tasks = min(shards * ISLANDS, TASKS)
    on_islands = open_items.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))).repartition(tasks, "shard", "island")
    state, before = items.sparkSession.createDataFrame([], STATE), None
    for k in range(ROUNDS):
        arriving = state.unionByName(state.withColumn("island", ((F.col("island") + 1) % ISLANDS).cast("int"))).repartition(tasks, "shard", "island")
        state = materialise(on_islands.groupBy("shard", "island").cogroup(arriving.groupBy("shard", "island")).applyInArrow(_island(capacity, k), STATE), "islands")
        if before is not None:
            discard(before)
        before = state
    best = state.groupBy("shard").agg(F.min_by("genome", F.struct("bins", -F.col("fit"), "island")).alias("genome")).repartition(tasks, "shard")
    evolved = open_items.repartition(tasks, "shard").groupBy("shard").cogroup(best.groupBy("shard")).applyInArrow(_last(capacity), PLACED)
    found = materialise(first.where("done").unionByName(evolved), "packed")
    discard(first, state)
    return found


def pack(items: DataFrame, capacity: int = 4096, shard: int = SHARD) -> DataFrame:
    """items (row long, length long, 1 <= length <= capacity) -> (row, sequence_id, offset).

    The levels end where one shard is left, where the loose bins meet their lower bound
    ceil(tokens / capacity), or where a level saves no bin."""
    full = items.where(F.col("length") == capacity).select("row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out, rest, level, tight_bins, before = [full], items.where(F.col("length") < capacity), 0, 0, None
    while left := rest.count():
        shards = max(1, -(-left // shard))
        placed = pack_shards(rest, shards, level, capacity)
        tight = F.col("fill") >= int(TIGHT * capacity)
        bins = placed.groupBy("shard", "bin").agg(F.max("fill").alias("fill"))
        n = bins.agg(F.count_if(tight).alias("tight"), F.count_if(~tight).alias("loose"), F.coalesce(F.sum(F.when(~tight, F.col("fill"))), F.lit(0)).alias("tokens")).first()
        total = tight_bins + n.tight + n.loose
        final = shards == 1 or n.loose <= -(-n.tokens // capacity) or before is not None and total >= before
        number = F.shiftleft(F.lit(level).cast("long"), 52) + F.shiftleft(F.col("shard"), 20) + F.col("bin")
        out.append(placed.where(F.lit(True) if final else tight).select("row", number.alias("sequence_id"), "offset"))
        if final:
            break
        rest, level, tight_bins, before = placed.where(~tight).select("row", "length"), level + 1, tight_bins + n.tight, total
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, with its place: sequence_id and offset."""
    with batches(docs.sparkSession, 4000):
        cut = materialise(pieces(docs, vocabulary, capacity, end, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pieces")
    placed = pack(cut.select("row", "length"), capacity)
    return cut.join(placed, "row").drop("row")
