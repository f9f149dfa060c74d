"""Language-model scoring with a hashed maximum-entropy model.

A text is the sequence of its words (runs of anything but ASCII white space,
A-Z in lower case) and one end. The probability of a token is factored into
classes of classes: softmaxes of WAYS ways each, given the context, lead to one of the
cells, twice as many as known words (from WAYS**LEVELS up to WAYS**MOST_LEVELS); where
several words meet in a cell, each has its smoothed share of the counts. Cells follow the words' last letters and then their hashes, each suffix with
as many cells as it has mass, so that classes are words of like form and frequent
words have cells of their own; every known word has its place in the tree, and
one fixed mass of 0.1 stands for all words that training never saw. The biases are
the counts: without weights the model is the unigram base.

Features of a context: the class (256 of them) of the last token and that of the one
before it (a skip), each with a row of weights for every node of the upper levels;
the last word and the pair of the last two words (n-grams), at every level, hashed with
the node into a table of the level's own, which grows with the vocabulary up to
2**MOST_BITS rows.

1. Texts are tokenized once into blocks: a dictionary, sorted by the words' 64-bit
   hashes, and numbers. Dictionaries are dealt by ranges of hashes and added up with
   numpy; a word costs one entry per block, however frequent it is. Only the texts
   to learn from give counts, words and masses.
2. Synchronous gradient updates: in each, every task adds up observed and expected
   counts of its blocks for every weight (a block's equal tokens in equal contexts once,
   with their times), as whole numbers, so that the sums, and the weights, don't depend on
   how the table is cut; the sums are added in a tree, in rows of bounded size. The
   first update moves the class rows, whose expectations under the unigram
   need no pass over texts of their own; all others move all weights, from the model's
   expectations over all training texts, until an update raises the objective (log
   probability of these texts under a Gaussian prior of the weights) by less than
   TOLERANCE of it. An update that lowers it is taken back and halved. Steps are scaled
   by the expected counts.
3. Scoring reads the blocks in sparse numpy batches.

Bounded: the tree and the tables of weights (parameters). Growing with the input:
blocks, counts of words, sums.

Defined results: null text is the empty text, whose only token is the end; rows
may repeat; null ids belong to fold 0; with no training rows every count is 0. Two
words of one 64-bit hash would count as one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_kind, batches, discard, materialise, setting, text_or_empty

#: The tree: softmaxes of WAYS ways on LEVELS levels, and on up to MOST_LEVELS where there are more words.
WAYS, LEVELS, MOST_LEVELS = 4, 8, 10
CELLS = WAYS**LEVELS
#: Levels whose nodes have rows for classes; classes are the nodes below them.
UPPER = 4
CLASSES = WAYS**UPPER
#: The class that stands before every text.
START = CLASSES
NODES = [(WAYS**k - 1) // (WAYS - 1) for k in range(MOST_LEVELS + 1)]  # before each level
LEAST_BITS, MOST_BITS = 12, 17
SUFFIXES = 1 << 15
RATE, PRIOR, CLIP = 0.6, 16.0, 1.5
#: Updates end when one raises the objective by less than this part of it.
TOLERANCE = 0.001
#: Expected counts are added as multiples of 1 / UNIT, two of them in a number of 64 bits:
#: a row meets at most two of a token's features, and 2 * AT_ONCE * UNIT is below 2**32.
UNIT, AT_ONCE = 1 << 13, (1 << 18) - 1
BLOCK_TOKENS, BLOCK_DOCS, CHUNK = 1 << 20, 4000, 1 << 15
#: Blocks of one task that sums: a task gives one array, however many blocks it has.
TASK_BLOCKS = 8
#: Dictionary entries of one range of hashes.
RANGE = 2_000_000
FAN_IN = 32
#: Numbers in one row of sums: rows are packed, added and sent one at a time.
PIECE = 1 << 19
#: Bits of a number that sorts a block's events by three words.
KEY_BITS = 64
#: Spark deletes a job's shuffle files at its end, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The end as a word: no word holds a space.
END = b" "


class Numbers(dict):
    """Numbers words by first occurrence."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def planes(numbers: np.ndarray) -> bytes:
    """Numbers as four planes of bytes: the higher planes are almost empty, and
    cost almost nothing on disk and in shuffles."""
    return np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel()


# -- 1. blocks and counts -----------------------------------------------------------

#: A letter's place in the alphabet; other bytes share five numbers behind them.
PLACES = [b - 96 if 97 <= b <= 122 else 27 + b % 5 for b in range(256)]


def suffix(word: bytes) -> int:
    """The last three bytes without punctuation, the very last first: words whose
    ends are alike have neighbouring numbers."""
    end = (word.rstrip(b".,;:!?)\"'") or word)[-3:]
    at = PLACES[end[-1]] << 10
    if len(end) > 1:
        at |= PLACES[end[-2]] << 5
    return at | PLACES[end[-3]] if len(end) > 2 else at


def _blocks(id_type: pa.DataType):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        made = 0
        docs: list = []
        number = Numbers()

        def emit():
            nonlocal docs, number, made
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
            order = np.argsort(hashes, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            tokens = place[np.concatenate([d[2] for d in docs])]
            lengths = np.array([len(d[2]) for d in docs])
            trained = np.bincount(tokens[np.repeat([not d[1] for d in docs], lengths)], minlength=len(order))
            row = {
                "block": pa.array([(context.partitionId() << 32) + made if context else made], pa.int64()),
                "ids": pa.array([[d[0] for d in docs]], pa.list_(id_type)),
                "held": pa.array([[d[1] for d in docs]], pa.list_(pa.bool_())),
                "lengths": pa.array([lengths], pa.list_(pa.int64())),
                "tokens": pa.array([planes(tokens)], pa.binary()),
                "n_words": pa.array([len(order)], pa.int64()),
                "hashes": pa.array([hashes[order].tobytes()], pa.binary()),
                "suffixes": pa.array([np.fromiter(map(suffix, number), np.uint16, len(number))[order].tobytes()], pa.binary()),
                "n_train": pa.array([planes(trained)], pa.binary()),
            }
            docs, number, made = [], Numbers(), made + 1
            return pa.RecordBatch.from_pydict(row)

        size = 0
        for batch in found:
            for doc, held, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words = text.encode("utf-8", "surrogatepass").lower().split()
                words.append(END)
                docs.append((doc, held, np.fromiter(map(number.__getitem__, words), np.int64, len(words))))
                size += len(words)
                if size >= BLOCK_TOKENS or len(docs) >= BLOCK_DOCS:
                    yield emit()
                    size = 0
        if docs:
            yield emit()

    return run


def tokenized(docs: DataFrame, held_out: Column, id_col: str, text_col: str) -> DataFrame:
    kind, arrow = arrow_kind(docs, id_col)
    rows = docs.select(F.col(id_col), held_out, text_or_empty(text_col))
    schema = f"block long, ids array<{kind}>, held array<boolean>, lengths array<long>, tokens binary, n_words long, hashes binary, suffixes binary, n_train binary"
    with batches(docs.sparkSession, 1000):
        return materialise(rows.mapInArrow(_blocks(arrow), schema), "lm-blocks")


def _ranges(parts: int):
    """A block's dictionary in `parts` ranges of hashes."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
        for batch in found:
            for block, hashes, suffixes, n_train in zip(*(batch.column(k).to_pylist() for k in range(4))):
                h, s, n = np.frombuffer(hashes, np.uint64), np.frombuffer(suffixes, np.uint16), from_planes(n_train)
                cut = [0, *np.searchsorted(h, bounds).tolist(), len(h)]
                own = [(k, block, h[a:b].tobytes(), s[a:b].tobytes(), planes(n[a:b])) for k, (a, b) in enumerate(zip(cut, cut[1:])) if a < b]
                columns, types = zip(*own), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["part", "block", "hashes", "suffixes", "n_train"])

    return run


MERGED = "kind int, part int, block long, counts binary, hashes binary, suffixes binary, sums binary"


def _merge(table: pa.Table) -> pa.Table:
    """Of one range: each block's words with their counts in all training texts (kind 0),
    and the known words with the sums of each suffix (kind 1)."""
    parts = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("hashes")]
    hashes = np.concatenate(parts)
    trained = np.concatenate([from_planes(x.as_py()) for x in table.column("n_train")]).astype(np.int64)
    suffixes = np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in table.column("suffixes")])
    order = np.argsort(hashes, kind="stable")
    at = np.flatnonzero(np.concatenate(([True], hashes[order][1:] != hashes[order][:-1])))
    counts = np.add.reduceat(trained[order], at)
    of = np.empty(len(order), np.int64)
    of[order] = np.repeat(counts, np.diff(np.append(at, len(order))))
    ends = np.cumsum([len(p) for p in parts])
    known = counts > 0
    words, ends_of, counts = hashes[order][at][known], suffixes[order][at][known], counts[known]
    sums = np.concatenate((np.bincount(ends_of, counts, SUFFIXES), np.bincount(ends_of, minlength=SUFFIXES))).astype(np.int64)
    n, part = len(parts), table.column("part")[0].as_py()
    return pa.table({
        "kind": pa.array([0] * n + [1], pa.int32()), "part": pa.array([part] * (n + 1), pa.int32()),
        "block": pa.array([*table.column("block").to_pylist(), None], pa.int64()),
        "counts": pa.array([of[b - len(p) : b].tobytes() for p, b in zip(parts, ends)] + [counts.tobytes()], pa.binary()),
        "hashes": pa.array([None] * n + [words.tobytes()], pa.binary()), "suffixes": pa.array([None] * n + [ends_of.tobytes()], pa.binary()),
        "sums": pa.array([None] * n + [sums.tobytes()], pa.binary()),
    })


SUMS = "task int, part int, sums binary"


def _pieces(totals: Iterator[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for task, part, total in totals:
        yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([part], pa.int32()), pa.array([packed(total)], pa.binary())], ["task", "part", "sums"])


def _add(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of each (task, part) among the rows; no more than a batch and the sums are held."""
    totals: dict[tuple[int, int], np.ndarray] = {}
    for batch in found:
        for task, part, sums in zip(*(batch.column(k) for k in range(3))):
            key, own = (task.as_py(), part.as_py()), unpacked(sums.as_py())
            totals[key] = np.add(totals[key], own, out=totals[key]) if key in totals else own
    yield from _pieces((*key, total) for key, total in totals.items())


def packed(sums: np.ndarray) -> bytes:
    """Eight planes of bytes, as in planes(), compressed."""
    data = np.ascontiguousarray(sums.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    found = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd")
    return np.ascontiguousarray(np.frombuffer(found, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def added(found: DataFrame, tasks: int) -> np.ndarray | None:
    """The sum of whole numbers that tasks give as SUMS rows, added in a tree, each part by itself."""
    spark = found.sparkSession
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        found = found.select((F.col("task") % tasks).cast("int").alias("task"), "part", "sums").repartition(tasks * spark.sparkContext.defaultParallelism, "task", "part").mapInArrow(_add, SUMS)
    with setting(spark, CLEANUP, "true"):
        got = sorted((r.part, r.sums) for r in found.collect())
    return np.concatenate([unpacked(sums) for _, sums in got]) if got else None


def summed(rows: DataFrame, of: Callable[[pa.RecordBatch, np.ndarray | None], np.ndarray]) -> np.ndarray | None:
    """The sum over all batches of rows: of(batch, total) adds to the one array that its task has so far."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in found:
            if batch.num_rows:
                total = of(batch, total)
        if total is not None:
            task = TaskContext.get().partitionId()
            yield from _pieces((task, k, total[a : a + PIECE]) for k, a in enumerate(range(0, len(total), PIECE)))

    with one_by_one(rows.sparkSession):
        return added(rows.mapInArrow(run, SUMS), rows.rdd.getNumPartitions())


@contextmanager
def one_by_one(spark: SparkSession) -> Iterator[None]:
    """Rows of megabytes: neither the reader of files nor Arrow takes many at once."""
    with batches(spark, 1), setting(spark, "spark.sql.parquet.columnarReaderBatchSize", "1"):
        yield


def counted(blocks: DataFrame) -> DataFrame:
    """MERGED rows of all ranges; a range has a bounded number of dictionary entries."""
    entries = blocks.agg(F.sum("n_words")).first()[0] or 0
    parts = max(1, -(-entries // RANGE))
    with one_by_one(blocks.sparkSession), setting(blocks.sparkSession, CLEANUP, "true"):
        dealt = blocks.select("block", "hashes", "suffixes", "n_train").mapInArrow(_ranges(parts), "part int, block long, hashes binary, suffixes binary, n_train binary")
        return materialise(dealt.repartition(parts, "part").groupBy("part").applyInArrow(_merge, MERGED), "lm-counts")


def _with_counts(block: pa.Table, found: pa.Table) -> pa.Table:
    order = np.argsort(found.column("part").to_numpy())
    parts = found.column("counts")
    counts = b"".join(parts[int(k)].as_py() for k in order)
    names = ["ids", "held", "lengths", "tokens", "hashes", "suffixes"]
    return pa.table({**{n: block.column(n) for n in names}, "counts": pa.array([counts], pa.binary())})


# -- 2. the model -------------------------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    """Whole numbers of 32 bits, scrambled."""
    x = x * np.uint32(2654435761)
    x ^= x >> np.uint32(15)
    x *= np.uint32(2246822519)
    x ^= x >> np.uint32(13)
    return x


@dataclass
class Tree:
    """The classes: of fixed size, made from counts of training words only."""

    tokens: int
    distinct: int
    start: np.ndarray  # where each suffix begins, and how wide it is, in tokens
    width: np.ndarray
    cell_mass: np.ndarray | None = None
    depth: np.ndarray | None = None
    base: float = 0.0  # log probability of all ways that training tokens take, without weights
    bias: np.ndarray | None = None

    @classmethod
    def of(cls, sums: np.ndarray | None) -> Tree:
        c, n = np.zeros((2, SUFFIXES), np.int64) if sums is None else sums.reshape(2, SUFFIXES)
        width = c + 0.1 * n
        return cls(int(c.sum()), int(n.sum()), np.cumsum(width) - width, width)

    @property
    def mass(self) -> float:
        return self.tokens + 0.1 * (self.distinct + 1)

    @property
    def levels(self) -> int:
        """As many as give every two cells one word."""
        return next((k for k in range(LEVELS, MOST_LEVELS) if WAYS**k >= 2 * self.distinct), MOST_LEVELS)

    def cells(self, hashes: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
        share = (hashes >> np.uint64(11)).astype(np.float64) / 2.0**53
        cells = WAYS**self.levels
        return np.minimum(cells * (self.start[suffixes] + share * self.width[suffixes]) / self.mass, cells - 1).astype(np.uint32)

    def finish(self, sums: np.ndarray | None) -> None:
        levels = self.levels
        c, n = np.zeros((2, WAYS**levels), np.int64) if sums is None else sums.reshape(2, -1)
        self.cell_mass = c + 0.1 * n
        self.cell_mass[-1] += 0.1  # of words that training never saw
        n = n.copy()
        n[-1] += 1
        # A node that holds one word needs no further levels.
        self.depth = np.full(len(n), levels, np.uint8)
        for k in range(levels - 1, 0, -1):
            self.depth[np.repeat(n.reshape(WAYS**k, -1).sum(axis=1) <= 1, WAYS ** (levels - k))] = k
        rows = []
        for k in range(levels):
            of = np.maximum(self.cell_mass.reshape(WAYS**k, WAYS, -1).sum(axis=2), 1e-9)
            rows.append(np.log(of / of.sum(axis=1, keepdims=True)))
            taken = c.reshape(WAYS**k, WAYS, -1).sum(axis=2) * rows[-1]
            self.base += float(taken[self.depth.reshape(WAYS**k, -1).max(axis=1) > k].sum())
        self.bias = np.concatenate(rows).astype(np.float32)


def cell_sums(tree: Tree):
    def of(batch: pa.RecordBatch, total: np.ndarray | None = None) -> np.ndarray:
        size = WAYS**tree.levels
        total = np.zeros((2, size), np.int64) if total is None else total.reshape(2, size)
        for hashes, suffixes, counts in zip(*(batch.column(c).to_pylist() for c in ("hashes", "suffixes", "counts"))):
            cells = tree.cells(np.frombuffer(hashes, np.uint64), np.frombuffer(suffixes, np.uint16))
            total[0] += np.bincount(cells, np.frombuffer(counts, np.int64), size).astype(np.int64)
            total[1] += np.bincount(cells, minlength=size)
        return total.ravel()

    return of


class Encoded:
    """A block's tokens as cells and contexts."""

    def __init__(self, tree: Tree, row: dict):
        hashes, suffixes = np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["suffixes"], np.uint16)
        self.counts = np.frombuffer(row["counts"], np.int64)
        cells = tree.cells(hashes, suffixes)
        self.tokens, self.lengths = from_planes(row["tokens"]), np.array(row["lengths"], np.int64)
        self.held = np.array(row["held"], bool)
        at = np.cumsum(self.lengths) - self.lengths
        own = np.where(self.counts > 0, cells, np.uint32(len(tree.depth) - 1)).astype(np.uint32)
        self.log_counts = np.log(self.counts + 0.1)
        self.log_inside = self.log_counts - np.log(tree.cell_mass[own])
        self.cell = own[self.tokens]
        self.depth = tree.depth[self.cell]
        last = np.empty(len(self.tokens), np.uint32)
        word = mixed(hashes.astype(np.uint32) ^ (hashes >> np.uint64(32)).astype(np.uint32))
        self.word, self.last_class = last, np.empty(len(self.tokens), np.uint32)
        last[1:], self.last_class[1:] = word[self.tokens[:-1]], (cells >> np.uint32(2 * (tree.levels - UPPER)))[self.tokens[:-1]]
        last[at], self.last_class[at] = 0, START
        self.skip_class, before = np.empty_like(last), np.empty_like(last)
        self.skip_class[1:], before[1:] = self.last_class[:-1], last[:-1]
        self.skip_class[at], before[at] = START, 0
        self.pair = mixed(last * np.uint32(3) + before)


class Events:
    """A block's tokens to learn from: each cell in each context of two words once, with its times.
    Those that pass through more levels stand first, so a level's are the first `ends[k]`; then they
    follow the last word and the cell, so that neighbours meet the same rows of weights."""

    def __init__(self, tree: Tree, row: dict):
        hashes, suffixes = np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["suffixes"], np.uint16)
        n = len(hashes)
        cells = tree.cells(hashes, suffixes)
        own = np.where(np.frombuffer(row["counts"], np.int64) > 0, cells, np.uint32(len(tree.depth) - 1)).astype(np.uint32)
        order = np.argsort(own | (MOST_LEVELS - tree.depth[own]).astype(np.uint32) << np.uint32(2 * MOST_LEVELS))
        rank = np.empty(n, np.uint64)
        rank[order] = np.arange(n, dtype=np.uint64)
        own = own[order]
        depth = tree.depth[own]
        tokens, lengths = from_planes(row["tokens"]), np.array(row["lengths"], np.int64)
        keep, at = np.repeat(~np.array(row["held"], bool), lengths), np.cumsum(lengths) - lengths
        last, before = np.empty(len(tokens), np.uint64), np.empty(len(tokens), np.uint64)
        last[1:], last[at] = tokens[:-1], n
        before[1:], before[at] = last[:-1], n
        place, last, before = rank[tokens[keep]], last[keep], before[keep]
        columns = [MOST_LEVELS - depth[place.astype(np.intp)].astype(np.uint64), last, place, before]
        times, (_, last, place, before) = distinct(columns, [MOST_LEVELS, n, n, n])
        self.times = times.astype(np.uint32)
        self.cell = own[place]
        self.ends = [int(np.searchsorted(-depth[place].astype(np.int8), -k, "left")) for k in range(tree.levels)]
        word = np.append(mixed(hashes.astype(np.uint32) ^ (hashes >> np.uint64(32)).astype(np.uint32)), np.uint32(0))
        of_class = np.append(cells >> np.uint32(2 * (tree.levels - UPPER)), np.uint32(START))
        self.word, self.last_class, self.skip_class = word[last], of_class[last], of_class[before]
        self.pair = mixed(self.word * np.uint32(3) + word[before])

    def parts(self, k: int) -> list[tuple[int, int]]:
        """Runs of a level's events, AT_ONCE tokens at most in each."""
        ends, cuts = np.cumsum(self.times[: self.ends[k]], dtype=np.int64), [0]
        while cuts[-1] < len(ends):
            before = ends[cuts[-1] - 1] if cuts[-1] else 0
            cuts.append(int(np.searchsorted(ends, before + AT_ONCE, "right")))
        return list(zip(cuts, cuts[1:]))

    def at(self, tree: Tree, k: int, cut: slice) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Nodes of a level, ways taken and contexts."""
        down = self.cell[cut] >> np.uint32(2 * (tree.levels - 1 - k))
        return down >> np.uint32(2), down & np.uint32(WAYS - 1), [x[cut] for x in (self.last_class, self.skip_class, self.word, self.pair)]


def distinct(columns: list[np.ndarray], most: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
    """How often each distinct row of numbers (0 to `most`) is there, and these rows, sorted; of
    rows that are there more than AT_ONCE times there are several."""
    bits = [np.uint64(m.bit_length()) for m in most]
    packs = sum(map(int, bits)) <= KEY_BITS
    if packs:  # one number a row sorts much faster
        key = columns[0]
        for c, b in zip(columns[1:], bits[1:]):
            key = key << b | c
        key.sort()
        new = key[1:] != key[:-1]
    else:
        key = np.lexsort(columns[::-1])
        columns = [c[key] for c in columns]
        new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    first = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), new)))
    times = np.diff(np.append(first, len(key)))
    if (times > AT_ONCE).any():
        parts = -(-times // AT_ONCE)
        first, times, begin = np.repeat(first, parts), np.repeat(times, parts), np.repeat(np.cumsum(parts) - parts, parts)
        times = np.minimum(AT_ONCE, times - AT_ONCE * (np.arange(len(times)) - begin))
    if not packs:
        return times, [c[first].astype(np.intp) for c in columns]
    key, found = key[first], []
    for b in bits[::-1]:
        found.append((key & (np.uint64(1) << b) - np.uint64(1)).astype(np.intp))
        key = key >> b
    return times, found[::-1]


class Model:
    """Weights of each level: rows for either class feature (upper levels), 2**bits hashed rows."""

    def __init__(self, tree: Tree, weights: np.ndarray | None = None):
        self.tree, self._shared = tree, None
        self.bits = min(MOST_BITS, max(LEAST_BITS, tree.distinct.bit_length()))
        direct = [2 * WAYS**k * (CLASSES + 1) if k < UPPER else 0 for k in range(tree.levels)]
        ends = np.cumsum([n + (1 << self.bits) for n in direct]).tolist()
        #: Each level's rows, and how many of them are of class features.
        self.levels = list(zip([0, *ends], ends, direct))
        self.rows = ends[-1]
        self.weights = np.zeros((self.rows, WAYS), np.float32) if weights is None else weights

    def __reduce__(self):
        return Model, (self.tree, self.weights if self.weights.any() else None)

    def shared(self, spark: SparkSession):
        """The tree, sent once: the files of what is sent stay with the executors until they collect garbage."""
        if self._shared is None:
            self._shared = spark.sparkContext.broadcast(self.tree)
        return self._shared

    def hit(self, k: int, at: np.ndarray, contexts: list[np.ndarray]) -> list[np.ndarray]:
        """The rows of each feature (last class, class before it, last word, last two), counted from the level's first."""
        direct, (last_class, skip_class, *hashed) = self.levels[k][2], contexts
        rows = []
        if direct:
            own = at * np.uint32(CLASSES + 1)
            rows = [(own + last_class).astype(np.intp), (own + (skip_class + np.uint32(direct // 2))).astype(np.intp)]
        salt = (at + np.uint32(NODES[k])) * np.uint32(3266489917)
        for context in hashed:
            x = context ^ salt
            x *= np.uint32(2654435761)
            x >>= np.uint32(32 - self.bits)
            rows.append(np.add(x, np.uint32(direct), dtype=np.intp))
        return rows

    def logits(self, k: int, at: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        """At most 0 + CLIP for each row and update: exp() needs no shift."""
        z = self.tree.bias[NODES[k] : NODES[k + 1]].take(at, axis=0)
        a, b, _ = self.levels[k]
        weights, own = self.weights[a:b], np.empty_like(z)
        for r in rows:
            z += weights.take(r, axis=0, out=own, mode="clip")
        return z

    def penalty(self, k: int) -> float:
        """What the prior takes from a level's log probability."""
        a, b, _ = self.levels[k]
        return PRIOR / 2 * float(np.square(self.weights[a:b], dtype=np.float64).sum())

    def move(self, observed: np.ndarray, expected: np.ndarray, rate: float = RATE) -> None:
        for a, b, _ in self.levels:  # one at a time: less memory
            step = observed[a:b] - expected[a:b] - PRIOR * self.weights[a:b]
            step /= expected[a:b] + PRIOR
            self.weights[a:b] += (rate * np.clip(step, -CLIP, CLIP, out=step)).astype(np.float32)


def over_ways(z: np.ndarray) -> np.ndarray:
    """Sums of rows, added in one order wherever a row stands (a product of matrices is not)."""
    return (z[:, 0] + z[:, 1]) + (z[:, 2] + z[:, 3])


def log_by_text(model: Model, e: Encoded) -> np.ndarray:
    """Each text's natural log probability."""
    out = e.log_inside[e.tokens]
    for k in range(model.tree.levels):
        for a in range(0, len(out), CHUNK):
            own = slice(a, a + CHUNK)
            through = np.flatnonzero(e.depth[own] > k)
            if not len(through):
                continue
            down = e.cell[own].take(through) >> np.uint32(2 * (model.tree.levels - 1 - k))
            at, way = down >> np.uint32(2), down & np.uint32(WAYS - 1)
            z = model.logits(k, at, model.hit(k, at, [x[own].take(through) for x in (e.last_class, e.skip_class, e.word, e.pair)]))
            taken = z.ravel().take(np.arange(len(way)) * WAYS + way)
            np.exp(z, out=z)
            out[own][through] += taken - np.log(over_ways(z))
    return np.add.reduceat(out, np.cumsum(e.lengths) - e.lengths)


def _training(tree: Tree, batch: pa.RecordBatch) -> Iterator[Events]:
    for k in range(batch.num_rows):
        e = Events(tree, {n: batch.column(n)[k].as_py() for n in batch.schema.names if n not in ("ids", "block")})
        if len(e.times):
            yield e


def observed(shared):
    """How often each way was taken with each row."""

    def of(batch: pa.RecordBatch, total: np.ndarray | None = None) -> np.ndarray:
        model: Model = shared.value
        total = np.zeros(model.rows * WAYS, np.int64) if total is None else total
        for e in _training(model.tree, batch):
            for k, (first, end, _) in enumerate(model.levels):
                own = total[first * WAYS : end * WAYS]
                for a in range(0, e.ends[k], CHUNK):
                    cut = slice(a, min(a + CHUNK, e.ends[k]))
                    at, way, contexts = e.at(model.tree, k, cut)
                    times = e.times[cut].astype(np.int64)
                    for r in model.hit(k, at, contexts):
                        r *= WAYS
                        r += way
                        np.add.at(own, r, times)
        return total

    return of


def expected(shared, weights):
    """How often each way but the last should be taken with each row, and at the end the sum of
    the logarithms that the ways' exponentials are divided by, in units of 1 / UNIT."""

    def of(batch: pa.RecordBatch, total: np.ndarray | None = None) -> np.ndarray:
        model = Model(shared.value, weights.value)
        total = np.zeros((WAYS - 1) * model.rows + 1, np.int64) if total is None else total
        sums, low, high = total[:-1].reshape(WAYS - 1, -1), np.uint64(2**32 - 1), np.uint64(32)
        for e in _training(model.tree, batch):
            for k, (first, end, _) in enumerate(model.levels):
                two, third = np.empty(end - first, np.uint64), sums[2, first:end]
                for part, stop in e.parts(k):
                    two[:] = 0
                    for a in range(part, stop, CHUNK):
                        cut = slice(a, min(a + CHUNK, stop))
                        at, _, contexts = e.at(model.tree, k, cut)
                        rows, times = model.hit(k, at, contexts), e.times[cut]
                        z = model.logits(k, at, rows)
                        np.exp(z, out=z)
                        of = over_ways(z)
                        # Whole numbers: their sums don't depend on the order.
                        log = np.log(of)
                        log *= UNIT
                        total[-1] += int((np.rint(log, out=log) * times.astype(np.float64)).sum())
                        flat = z.ravel()
                        flat *= np.repeat(UNIT / of, WAYS)
                        whole = np.rint(flat, out=flat).astype("<u4").view("<u8")
                        pair, rest = whole[::2] * times, (whole[1::2] & low).view(np.int64) * times
                        for r in rows:
                            np.add.at(two, r, pair)
                            np.add.at(third, r, rest)
                    sums[0, first:end] += (two & low).view(np.int64)
                    two >>= high
                    sums[1, first:end] += two.view(np.int64)
        return total

    return of


def hoped(blocks: DataFrame, model: Model, seen: np.ndarray) -> tuple[np.ndarray, float]:
    """Expected counts over all training texts, and the objective. The last way has what
    the others leave of each row's observed tokens."""
    weights = blocks.sparkSession.sparkContext.broadcast(model.weights)
    found = summed(blocks, expected(model.shared(blocks.sparkSession), weights))
    weights.destroy()
    sums, counts, taken = found[:-1].reshape(WAYS - 1, -1), np.zeros((model.rows, WAYS), np.float64), model.tree.base
    for k, (a, b, _) in enumerate(model.levels):  # one at a time: less memory
        np.divide(sums[:, a:b].T, UNIT, out=counts[a:b, :-1])
        np.maximum(seen[a:b].sum(axis=1) - counts[a:b, :-1].sum(axis=1), 0, out=counts[a:b, -1])
        taken += float((seen[a:b] * model.weights[a:b].astype(np.float64)).sum()) - model.penalty(k)
    return counts, taken - found[-1] / UNIT


def trained(blocks: DataFrame, tree: Tree) -> Model:
    """The model after synchronous updates, each from all training texts, until they end."""
    spark, model = blocks.sparkSession, Model(tree)
    blocks = blocks.coalesce(max(spark.sparkContext.defaultParallelism, -(-blocks.count() // TASK_BLOCKS)))
    shared = spark.sparkContext.broadcast(model)
    seen = summed(blocks, observed(shared))
    shared.destroy()
    if seen is None or not seen.any():
        return model
    seen = seen.reshape(-1, WAYS)
    # Class rows belong to one node: its own shares say what the unigram expects.
    start = seen.astype(np.float64)
    for k, (first, _, direct) in enumerate(model.levels[:UPPER]):
        shares = np.exp(tree.bias[NODES[k] : NODES[k + 1]].astype(np.float64))
        own = start[first : first + direct]
        own[:] = np.repeat(np.concatenate((shares, shares)), CLASSES + 1, axis=0) * own.sum(axis=1, keepdims=True)
    model.move(seen, start)
    del start
    rate, best = RATE, None
    while True:
        counts, objective = hoped(blocks, model, seen)
        if best and objective - best[0] < TOLERANCE * abs(best[0]):
            if objective >= best[0]:
                return model
            model.weights[:], rate = best[1], rate / 2
            if rate < RATE * TOLERANCE:
                return model
        else:
            best = objective, model.weights.copy(), counts
        model.move(seen, best[2], rate)


# -- 3. scores ----------------------------------------------------------------------

SCORED = ["id", "held", "n_tokens", "n_known", "log_counts", "score"]


def _scores(shared, weights, id_type: pa.DataType):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value, weights.value)
        types = (id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        for batch in found:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                e = Encoded(model.tree, row)
                at = np.cumsum(e.lengths) - e.lengths  # every text has its end: no run is empty
                known = np.add.reduceat((e.counts[e.tokens] > 0).astype(np.int64), at)
                columns = (row["ids"], row["held"], e.lengths, known, np.add.reduceat(e.log_counts[e.tokens], at) / np.log(10), log_by_text(model, e) / np.log(10))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], SCORED)

    return run


def lm_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every
    row; the model learns from the rows where held_out is false."""
    spark = docs.sparkSession
    kind, arrow = arrow_kind(docs, id_col)
    blocks = tokenized(docs, held_out, id_col, text_col)
    counts = counted(blocks)
    words = counts.where("kind = 1")
    tree = Tree.of(summed(words.select("sums"), lambda batch, total: sum((np.frombuffer(x.as_py(), np.int64) for x in batch.column(0)), 0 if total is None else total)))
    tree.finish(summed(words.select("hashes", "suffixes", "counts"), cell_sums(tree)))
    own = blocks.select(F.col("block").alias("own_block"), "ids", "held", "lengths", "tokens", "hashes", "suffixes")
    schema = f"ids array<{kind}>, held array<boolean>, lengths array<long>, tokens binary, hashes binary, suffixes binary, counts binary"
    placed = counts.where("kind = 0").select("block", "part", "counts")
    with one_by_one(spark), setting(spark, CLEANUP, "true"):
        encoded = materialise(own.groupBy("own_block").cogroup(placed.groupBy("block")).applyInArrow(_with_counts, schema), "lm-encoded")
    discard(blocks, counts)
    model = trained(encoded, tree)
    with one_by_one(spark):
        schema = f"id {kind}, held boolean, n_tokens long, n_known long, log_counts double, score double"
        scored = materialise(encoded.mapInArrow(_scores(model.shared(spark), spark.sparkContext.broadcast(model.weights), arrow), schema), "lm-scores")
    discard(encoded)
    total = float(np.log10(tree.mass))
    return scored.select("id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(tree.tokens).cast("long").alias("train_tokens"), (F.col("log_counts") - F.col("n_tokens") * total).alias("base_score"), "score")
