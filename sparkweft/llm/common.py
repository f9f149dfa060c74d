"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

ASCII_SPACE = r"[ \t-\r]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, else the
    checkpoint folder that was set on the context. A local session without either
    (tests, one machine) gets a temporary folder; on a cluster that is an error."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkweft-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: the lineage is cut,
    a lost executor costs no more than the tasks it ran."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._sparkweft_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that materialise() wrote and nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._sparkweft_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the jobs run inside."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside give Python at most so many rows at a time (and never more
    bytes than `spark.sql.execution.arrow.maxBytesPerBatch`, 64 MB unless set).
    The session's own setting comes back at the end."""
    importable(spark)
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)):
        yield


def importable(spark: SparkSession) -> None:
    """Workers of a local session find the package where the driver found it. On a
    cluster it is installed, or sent with --py-files."""
    if not spark.sparkContext.master.startswith("local"):
        return
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def id_crc(column: str) -> Column:
    """crc32 of an id as text, which deals rows into folds; null ids go with 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0))


def arrow_kind(df: DataFrame, column: str) -> tuple[str, pa.DataType]:
    """A column's type as Spark and as Arrow name it: ids may be of any type."""
    kind = df.schema[column].dataType
    return kind.simpleString(), to_arrow_type(kind)


#: Classes that hold at least this part of all rows are joined by broadcast: there are no more than so many.
HEAVY = 10_000


def join_classes(rows: DataFrame, classes: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows with the columns of their class (an inner join on key, of which classes has
    each once). weight: how many of the `total` rows the class has.

    A class with a 10,000th of all rows or more is heavy, so there are at most 10,000
    heavy ones, whatever the size of the table: these are broadcast, and their rows stay
    where they are. The others are spread evenly enough for a plain join."""
    heavy = F.col(weight) * HEAVY >= total
    hot = classes.where(heavy)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(classes.where(~heavy), key))


def keep_one(docs: DataFrame, decided: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of each group the row of the smallest id (null last, then by text) stays.

    decided: (id, doc, group) for every row of docs, doc being the xxhash64 of the text.
    Rows are told apart by id and text; of rows that repeat both, one stays."""
    order = F.struct(F.col("id").isNull().alias("null_id"), "id", "doc")
    rows = decided.groupBy("group", "id", "doc").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("group").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("members"), F.max("n").alias("most")).where("members > 1 OR most > 1")
    judged = rows.join(first.select("group", "first"), "group").withColumn("own", F.col("id").eqNullSafe(F.col("first.id")) & (F.col("doc") == F.col("first.doc")))
    judged = materialise(judged.where("NOT own OR n > 1").select(F.col("id").alias("__ko_id"), F.col("doc").alias("__ko_doc"), "own"), "judged")
    same = (F.xxhash64(text_or_empty(text_col)) == F.col("__ko_doc")) & F.col(id_col).eqNullSafe(F.col("__ko_id"))
    kept = docs.join(judged.drop("own").hint("merge"), same, "left_anti").select(*docs.columns)
    again = judged.where("own")
    if again.isEmpty():
        return kept
    once = F.row_number().over(Window.partitionBy("__ko_id", "__ko_doc").orderBy(F.lit(1)))
    return kept.unionByName(docs.join(again, same).withColumn("__ko_n", once).where("__ko_n = 1").select(*docs.columns))
