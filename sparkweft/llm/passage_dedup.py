"""Dedup of passages of whole lines, in DataFrame functions only.

From every line that holds a word a window runs to the first line that makes it
longer than `words` words. A window depends on nothing that stands before it, so
a passage of more than `words` words is met wherever it stands, however many
lines it is spread over and whatever its neighbours are. Of equal windows the
first place (smallest id, then position) stays; lines that any other place covers
are removed, so a passage goes from its first line to its last.

Defined results: lines without words take no part in comparisons, and go with the
removed lines around them; a place that overlaps the first one in the same text is
no copy of it; null text is the empty text; rows that repeat an id with the same
text get the same decision; further columns pass through. Windows are equal if the
SHA-256 of their lines' SHA-256 are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

DOC = "__pd_doc"


def windows(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, DOC, pos, last, hash): one row per line from which a window is long enough."""
    # Texts are dealt by id before they are cut: the lines need no shuffle.
    once = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).groupBy("id", F.xxhash64("text").alias(DOC)).agg(F.min("text").alias("text"))
    lines = once.select("id", DOC, F.posexplode_outer(F.split("text", "\n", -1)).alias("pos", "line")).select("id", DOC, "pos", "line", F.regexp_count("line", F.lit("[^ \\t-\\r]+")).cast("long").alias("n"))
    own = Window.partitionBy("id", DOC).orderBy("pos")
    placed = lines.where("n > 0").select("id", DOC, "pos", "n", F.sha2("line", 256).alias("line"), (F.sum("n").over(own) - F.col("n")).alias("start"))
    # No two lines start at the same word.
    ahead = Window.partitionBy("id", DOC).orderBy("start").rangeBetween(0, words)
    seen = placed.select("id", DOC, "pos", F.max("pos").over(ahead).alias("last"), F.sum("n").over(ahead).alias("n"), F.collect_list("line").over(ahead).alias("lines"))
    return seen.where(F.col("n") > words).select("id", DOC, "pos", "last", F.unhex(F.sha2(F.array_join("lines", ""), 256)).alias("hash"))


def passage_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 50) -> DataFrame:
    """docs with the columns n_lines, removed_passages, removed_lines and clean_text, which
    replace columns of the same name."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "removed_passages", "removed_lines", "clean_text")])
    text = text_or_empty(text_col)
    found = materialise(windows(docs, id_col, text_col, words), "passages")
    place = F.struct(F.col("id").isNull().alias("null_id"), "id", DOC, "pos", "last")
    repeated = found.groupBy("hash").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("hash", "first")
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col(DOC) == F.col("first")[DOC])
    copies = found.join(materialise(repeated, "passage-firsts").hint("merge"), "hash").where(~same | (F.col("pos") > F.col("first.last"))).select("id", DOC, "pos", "last")
    # Places that overlap become one run of lines.
    order = Window.partitionBy("id", DOC).orderBy("pos")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = copies.withColumn("new", F.when(F.col("pos") <= before, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    runs = runs.groupBy("id", DOC, "run").agg(F.min("pos").alias("pos"), F.max("last").alias("last"))
    removed = runs.groupBy(F.col("id").alias("__pd_id"), F.col(DOC).alias("__pd_key")).agg(F.collect_list(F.struct("pos", "last")).alias("__pd_runs"))
    joined = docs.withColumn(DOC, F.xxhash64(text)).hint("merge").join(removed, (F.col(DOC) == F.col("__pd_key")) & F.col(id_col).eqNullSafe(F.col("__pd_id")), "left")
    left = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.exists("__pd_runs", lambda r: (r["pos"] <= i) & (i <= r["last"])))
    lines = F.aggregate("__pd_runs", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["pos"] + 1)
    return joined.select(
        *docs.columns,
        F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__pd_runs"), F.lit(0)).cast("long").alias("removed_passages"),
        F.coalesce(lines, F.lit(0)).cast("long").alias("removed_lines"),
        F.when(F.col("__pd_runs").isNull(), text).otherwise(F.array_join(left, "\n")).alias("clean_text"),
    )
