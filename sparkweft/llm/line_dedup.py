"""Line dedup with content-defined chunks, in DataFrame functions only.

Every line gets a hash; a rolling hash over the last three line hashes chooses
the places where a chunk ends, so an inserted line moves only the chunks beside
it. A line of `long_bytes` or more (about fifty words) is a chunk of its own; its
ends are content too, so that a single long passage is found between unlike
neighbours. Chunks of two lines and more, and long lines, are grouped by their
bytes (hash and text are both group keys, counted before the shuffle); of a
chunk that occurs again anywhere the first place (smallest id, then position)
stays and the others are removed.

Defined results: null text is the empty text and has one empty line; rows that
repeat an id with the same text get the same decision; an empty table gives an
empty result; further columns pass through. Chunks whose hashes agree while
their bytes differ are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

DOC, REMOVE = "__ld_doc", "__ld_remove"


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def chunked(docs: DataFrame, text_col: str, modulus: int, long_bytes: int, name: str) -> DataFrame:
    """docs with the array `name` of its chunks, whose lines are parted by "\\nB".

    Arrays are zipped, never indexed: the work is linear in the lines of a text.
    """
    def shifted(column: str, by: int) -> Column:
        zeros = F.transform(F.slice(column, 1, by), lambda _: F.lit(0).cast("long"))
        return F.concat(zeros, F.slice(F.col(column), F.lit(1), F.greatest(F.size(column) - by, F.lit(0))))

    hashed = docs.withColumn("__ld_lines", F.split(text_or_empty(text_col), "\n", -1)).withColumns({
        "__ld_h": F.transform("__ld_lines", line_hash),
        "__ld_long": F.transform("__ld_lines", lambda line: F.octet_length(line) >= long_bytes),
    })
    rolled = F.zip_with(F.zip_with(shifted("__ld_h", 2), shifted("__ld_h", 1), lambda a, b: (a * 961 + b * 31) % 1000003), "__ld_h", lambda a, b: (a + b) % 1000003)
    ended = hashed.withColumn("__ld_ends", F.zip_with(rolled, "__ld_long", lambda r, is_long: (r % modulus == 0) | is_long))
    # A chunk starts at the first line, after an end, and at a long line.
    after = F.concat(F.array(F.lit(True)), F.slice(F.col("__ld_ends"), F.lit(1), F.size("__ld_ends") - 1))
    starts = F.zip_with(after, "__ld_long", lambda e, is_long: e | is_long)
    # No line holds a line feed: "\nA" and "\nB" mark lines without ambiguity.
    marked = F.array_join(F.zip_with("__ld_lines", starts, lambda line, s: F.concat(F.when(s, F.lit("\nA")).otherwise(F.lit("\nB")), line)), "")
    return ended.withColumn(name, F.split(F.substring(marked, 3, 2147483647), "\nA", -1)).select(*docs.columns, name)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 3, long_bytes: int = 200) -> DataFrame:
    """docs with the columns n_lines, removed_chunks, removed_lines and clean_text, which
    replace columns of the same name."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "removed_chunks", "removed_lines", "clean_text")])
    text = text_or_empty(text_col)
    keyed = docs.select(F.col(id_col), F.col(text_col), F.xxhash64(text).alias(DOC))
    # The outer form, as no text is without chunks: for the inner one the optimizer
    # adds a filter on the array's size, which would cut every text twice.
    rows = chunked(keyed, text_col, modulus, long_bytes, "chunks").select(id_col, DOC, F.posexplode_outer("chunks").alias("pos", "chunk"))
    rows = rows.where((F.octet_length("chunk") >= long_bytes) | F.contains("chunk", F.lit("\nB"))).select(id_col, DOC, "pos", "chunk", F.unhex(F.md5("chunk")).alias("hash"))
    same_bytes = rows.groupBy("hash", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id"))
    repeated = same_bytes.groupBy("hash").agg(F.count(F.lit(1)).alias("texts"), F.max("n").alias("n"), F.min("first_id").alias("first_id"))
    repeated = materialise(repeated.where("texts = 1 AND n > 1").select("hash", "first_id"), "line-chunks")
    met = materialise(rows.select(id_col, DOC, "pos", "hash").join(repeated, "hash"), "line-places")
    # Of the places in the document of the smallest id the first is kept.
    kept = met.where(F.col(id_col).eqNullSafe(F.col("first_id"))).groupBy("hash").agg(F.min(F.struct(DOC, "pos")).alias("kept"))
    judged = met.join(kept, "hash", "left").where(
        ~F.col(id_col).eqNullSafe(F.col("first_id")) | (F.col(DOC) != F.col("kept")[DOC]) | (F.col("pos") != F.col("kept.pos")))
    removed = judged.groupBy(F.col(id_col).alias("__ld_id"), F.col(DOC).alias("__ld_key")).agg(F.collect_set("pos").alias(REMOVE))
    # Merged at every size, so that what small tables show holds for large ones.
    joined = docs.withColumn(DOC, F.xxhash64(text)).hint("merge").join(removed, (F.col(DOC) == F.col("__ld_key")) & F.col(id_col).eqNullSafe(F.col("__ld_id")), "left")
    # Texts that lose nothing aren't cut again: the chunks of a null text cost nothing.
    cut = chunked(joined.withColumn("__ld_text", F.when(F.col(REMOVE).isNotNull(), text)), "__ld_text", modulus, long_bytes, "__ld_chunks")
    gone = F.filter("__ld_chunks", lambda _, i: F.array_contains(REMOVE, i))
    left = F.filter("__ld_chunks", lambda _, i: ~F.array_contains(REMOVE, i))
    cut = cut.withColumns({"__ld_gone": F.when(F.col(REMOVE).isNotNull(), gone), "__ld_left": F.when(F.col(REMOVE).isNotNull(), left)})
    lines = F.aggregate("__ld_gone", F.lit(0), lambda a, c: a + F.size(F.split(c, "\nB", -1)))
    return cut.select(
        *docs.columns,
        F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(F.size(REMOVE), F.lit(0)).cast("long").alias("removed_chunks"),
        F.coalesce(lines, F.lit(0)).cast("long").alias("removed_lines"),
        F.when(F.col(REMOVE).isNull(), text).otherwise(F.replace(F.array_join("__ld_left", "\nB"), F.lit("\nB"), F.lit("\n"))).alias("clean_text"),
    )
