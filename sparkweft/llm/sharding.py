"""Sharding by a k-d tree over document metadata, in DataFrame functions only.

The dimensions are taken from the text: its size, its bytes per character and
its lines, each scaled to 16 bits. A node that is heavier than SLACK times the target
bytes is split along the dimension in which it is widest, at the median by bytes, until
all leaves reach the target or `most_levels` are made. The median is found by digits: a
histogram of 4096 buckets per node, then one inside the median's bucket, until the bytes
that are left undecided are few. Behind the scaled value the order goes on with
a hash of the text and one of the row, so ties can always be split, while
equal texts stay on one side unless they weigh more than is tolerable.

A row's node is a column, written once a level; histograms, medians and splits are
tables, and only counts come to the driver. Splits are broadcast up to MOST_BROADCAST
nodes, and joined like any table beyond. Slots are numbered inside hashed parts of a
shard, behind the counts of the parts before: no task sees a whole shard.

Defined results: null text has size 1; an empty table gives an empty result;
rows that repeat are rows of their own; null ids are allowed; the operator's columns
replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise

DIGIT, DIGITS = 12, 5
#: Bytes that a split may leave undecided, as a share of a shard's bytes.
TOLERANCE = 0.03
#: Rows of a part in which slots are numbered at once.
PART = 50_000
DIMENSIONS = ("__kd_size", "__kd_dense", "__kd_lines")
#: A leaf may weigh so many times its target.
SLACK = 1.25
MOST_BROADCAST = 100_000
OWN = ("size", "text_crc32", "shard", "slot")


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the text, with size, text_crc32, the dimensions' keys and kd_row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    scaled = {
        "__kd_size": F.log2(size) * 1638,
        "__kd_dense": F.when(F.length(text) > 0, (F.octet_length(text) / F.length(text) - 1) * 21845).otherwise(0),
        "__kd_lines": F.log2(F.length(text) - F.length(F.translate(text, "\n", "")) + 1.0) * 2048,
    }
    # 16 bits of the value, 24 of the text, 20 of the row: 60 bits, five digits.
    tail = F.shiftleft(F.pmod(F.xxhash64(text), F.lit(1 << 24)), 20) + F.pmod(F.xxhash64(F.monotonically_increasing_id(), text), F.lit(1 << 20))
    keys = [(F.shiftleft(F.least(F.greatest(v, F.lit(0.0)), F.lit(65535.0)).cast("long"), 44) + F.col("__kd_tail")).alias(k) for k, v in scaled.items()]
    kept = [c for c in docs.columns if c != text_col and c.lower() not in OWN]
    return docs.withColumn("__kd_tail", tail).select(*kept, size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *keys, F.monotonically_increasing_id().alias("kd_row"))


def _key() -> Column:
    """A row's key along its node's dimension."""
    key = F.lit(None).cast("long")
    for i, dimension in enumerate(DIMENSIONS):
        key = F.when(F.col("dim") == i, F.col(dimension)).otherwise(key)
    return key


def _spread(table: DataFrame, n: int) -> DataFrame:
    return F.broadcast(table) if n <= MOST_BROADCAST else table


def medians(rows: DataFrame, nodes: DataFrame, n: int, tolerable: float) -> DataFrame:
    """nodes (node, dim, w) -> (node, dim, split): the key at which a node's bytes are halved."""
    state = nodes.select("node", "dim", (F.col("w") / 2).alias("half"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    decided = []
    for digit in range(DIGITS):
        shift = DIGIT * (DIGITS - 1 - digit)
        inside = rows.join(_spread(state, n), "node").withColumn("k", _key()).where(F.shiftright("k", shift + DIGIT) == F.col("prefix"))
        histogram = inside.groupBy("node", "dim", "half", "below", F.shiftright("k", shift).alias("b")).agg(F.sum("size").alias("w"))
        upto = F.col("below") + F.sum("w").over(Window.partitionBy("node").orderBy("b"))
        crossed = histogram.withColumn("upto", upto).where((F.col("upto") >= F.col("half")) & (F.col("upto") - F.col("w") < F.col("half")))
        crossed = materialise(crossed.withColumn("below", F.col("upto") - F.col("w")), "medians")
        enough = F.lit(True) if digit == DIGITS - 1 else F.col("w") <= tolerable
        nearer = F.when(F.col("half") - F.col("below") < F.col("upto") - F.col("half"), F.col("b")).otherwise(F.col("b") + 1)
        decided.append(crossed.where(enough).select("node", "dim", F.shiftleft(nearer, shift).alias("split")))
        state = crossed.where(~enough).select("node", "dim", "half", F.col("b").alias("prefix"), "below")
        if state.isEmpty():
            break
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out


def tree(rows: DataFrame, target: float, most_levels: int) -> DataFrame:
    """rows with their node: 1 is the root, and 2 n and 2 n + 1 the halves of n."""
    placed = rows.withColumns({"node": F.lit(1).cast("long"), "open": F.lit(True)})
    written = None
    for _ in range(most_levels):
        bounds = [f(d).alias(f"{name}{i}") for name, f in (("lo", F.min), ("hi", F.max)) for i, d in enumerate(DIMENSIONS)]
        nodes = placed.where("open").groupBy("node").agg(F.sum("size").alias("w"), *bounds).where(F.col("w") > SLACK * target)
        # The widest dimension, of ties the first; where it is a point, of its ties' order.
        widths = [F.struct((F.shiftright(f"hi{i}", 44) - F.shiftright(f"lo{i}", 44)).alias("width"), F.lit(-i).alias("order"), (F.col(f"hi{i}") > F.col(f"lo{i}")).alias("parts")) for i in range(len(DIMENSIONS))]
        nodes = nodes.withColumn("widest", F.greatest(*widths)).where("widest.parts").select("node", "w", (-F.col("widest.order")).alias("dim"))
        nodes = materialise(nodes, "nodes")
        n = nodes.count()
        if not n:
            break
        splits = medians(placed, nodes, n, TOLERANCE * target)
        halved = placed.join(_spread(splits, n), "node", "left").withColumn("open", F.col("split").isNotNull())
        halved = halved.withColumn("node", F.when(F.col("open"), F.col("node") * 2 + (_key() >= F.col("split")).cast("long")).otherwise(F.col("node")))
        placed = materialise(halved.drop("dim", "split"), "tree")
        if written is not None:
            discard(written)
        written = placed
    return placed.drop("open")


def shards(docs: DataFrame, target_bytes: int | None = None, most_levels: int | None = None, id_col: str = "doc_id", text_col: str = "text", part: int = PART) -> DataFrame:
    """docs without the text, with size, text_crc32, shard and slot (from 0, without gaps).

    Shards are the leaves of at most SLACK * target_bytes, numbered in the tree's order.
    Without a target there are eight of them: an eighth of all bytes, three levels."""
    rows = materialise(measured(docs, text_col), "measured")
    known = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    if target_bytes is None:
        target_bytes, most_levels = known.bytes / 8, 3
    parts = max(1, -(-known.n // part))
    placed = tree(rows, target_bytes, 40 if most_levels is None else most_levels).withColumn("__kd_part", F.pmod(F.xxhash64("kd_row"), F.lit(parts))).drop(*DIMENSIONS)
    sizes = materialise(placed.groupBy("node", "__kd_part").agg(F.count(F.lit(1)).alias("n")), "leaves")
    leaves = sizes.select("node").distinct()
    numbered = leaves.select("node", (F.row_number().over(Window.orderBy(F.rpad(F.bin("node"), 64, "0"))) - 1).cast("int").alias("shard"))
    before = F.sum("n").over(Window.partitionBy("node").orderBy("__kd_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("node", "__kd_part", F.coalesce(before, F.lit(0)).alias("before")).join(numbered, "node")
    inside = F.row_number().over(Window.partitionBy("node", "__kd_part").orderBy(F.col(id_col).asc_nulls_last(), "kd_row"))
    out = placed.withColumn("__kd_inside", inside).join(offsets, ["node", "__kd_part"])
    return out.withColumn("slot", F.col("before") + F.col("__kd_inside") - 1).drop("before", "__kd_inside", "__kd_part", "kd_row", "node")
