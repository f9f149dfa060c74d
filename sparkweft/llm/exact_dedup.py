"""Exact dedup by progressive refinement: length, prefix hash, full hash.

A row's text is compared after each run of ASCII white space became one space.
Rows are first grouped by the length of that text; only lengths that occur
twice go on to a hash of a prefix; only rows whose prefix occurs twice are grouped by the
SHA-256 of the whole text. All groupings aggregate before they shuffle, so a
text that fills a third of the table costs one row per task. Joins that bring survivors
and classes back to the rows are salted or broadcast their heavy keys.

Defined results: a null text counts as the empty text; an empty table gives an
empty result; of rows that repeat the smallest id itself exactly one is kept;
a null id sorts after every other id; further columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_classes, materialise, text_or_empty

LENGTH, PREFIX, FULL = "__ed_length", "__ed_prefix", "__ed_full"
SALTS = 32


def normalised(text_col: str = "text") -> Column:
    """One space for each run of white space (single spaces stay as they are)."""
    return F.regexp_replace(text_or_empty(text_col), "[ \\t-\\r]{2,}|[\\t-\\r]", " ")


def _prefix(text: Column, n: int) -> Column:
    return F.xxhash64(F.substring(text, 1, n))


def _full(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def surviving(keys: DataFrame) -> DataFrame:
    """The (length, prefix hash) pairs that two rows or more share."""
    pairs = keys.groupBy(LENGTH, PREFIX).agg(F.count(F.lit(1)).alias("n"))
    lengths = pairs.groupBy(LENGTH).agg(F.sum("n").alias("rows")).where("rows > 1").select(LENGTH)
    return pairs.join(lengths, LENGTH, "left_semi").where("n > 1").select(LENGTH, PREFIX)


def marked(rows: DataFrame, salt: Column, survivors: DataFrame) -> DataFrame:
    """rows with __ed_in: whether length and prefix recur. Salted, so that a hot text is
    spread over tasks, and merged at every size: the survivors' size on disk says
    little of their salted rows."""
    salted = survivors.withColumn("__ed_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("__ed_in", F.lit(True))
    joined = rows.withColumn("__ed_salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(salted.hint("merge"), [LENGTH, PREFIX, "__ed_salt"], "left")
    return joined.drop("__ed_salt").withColumn("__ed_in", F.coalesce("__ed_in", F.lit(False)))


def _order(id_col: str) -> Column:
    return F.struct(F.col(id_col).isNull().alias("null_id"), F.col(id_col).alias("id"), F.col("__ed_row").alias("row"))


def classes_of(survivors: DataFrame, id_col: str) -> tuple[DataFrame, int]:
    """Among the rows that survived: FULL, keep (null_id, id, row), group_size."""
    found = survivors.groupBy(LENGTH, PREFIX, FULL).agg(F.min(_order(id_col)).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    found = materialise(found.select(FULL, "keep", "group_size"), "exact-classes")
    return found, found.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]


def duplicate_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    The digest of every row is part of the report, so texts are read once and hashed
    there; the grouping meets the digests of those rows only whose length and prefix recur."""
    text = F.col("__ed_text")
    keys = materialise(
        docs.select(F.col(id_col).alias("__ed_id"), normalised(text_col).alias("__ed_text"))
        .select("__ed_id", F.length(text).alias(LENGTH), _prefix(text, prefix).alias(PREFIX), _full(text).alias(FULL), F.monotonically_increasing_id().alias("__ed_row")),
        "exact-keys",
    )
    found = materialise(marked(keys, F.xxhash64("__ed_row"), surviving(keys)), "exact-marked")
    again = found.where("__ed_in")
    classes, n = classes_of(again, "__ed_id")
    of_class = join_classes(again, classes, FULL, "group_size", n)
    sha = F.lower(F.hex(FULL)).alias("text_sha256")
    alone = found.where("NOT __ed_in").select(F.col("__ed_id").alias(id_col), F.col("__ed_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    return alone.unionByName(of_class.select(F.col("__ed_id").alias(id_col), F.col("keep.id").alias("keep_id"), "group_size", (F.col("keep.row") == F.col("__ed_row")).alias("kept"), sha))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64) -> DataFrame:
    """The rows of docs that stay, with their own columns.

    The whole text is hashed only in rows whose length and prefix recur. Texts are
    shuffled once, to the join with the survivors; what it gives is written."""
    text = normalised(text_col)
    keyed = docs.withColumns({LENGTH: F.length(text), PREFIX: _prefix(text, prefix)})
    survivors = materialise(surviving(materialise(keyed.select(LENGTH, PREFIX), "exact-prefixes")), "exact-survivors")
    found = marked(keyed, F.xxhash64(id_col, F.monotonically_increasing_id()), survivors)
    found = materialise(found.withColumns({FULL: F.when(F.col("__ed_in"), _full(text)), "__ed_row": F.monotonically_increasing_id()}), "exact-marked")
    classes, _ = classes_of(found.where("__ed_in").select(id_col, LENGTH, PREFIX, FULL, "__ed_row"), id_col)
    # Rows are numbered where they were written: one of each class stays.
    stay = classes.select(F.col("keep.row").alias("__ed_row"))
    return found.where("NOT __ed_in").select(*docs.columns).unionByName(found.where("__ed_in").join(stay, "__ed_row", "left_semi").select(*docs.columns))
