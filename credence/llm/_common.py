"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a session in one process gets a temporary folder; a cluster gets an error,
    since no folder of one machine would do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="credence-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return "file://" + _OWN[0]


def scratch(spark: SparkSession) -> str:
    """The folder that holds what ``cut`` writes for this application."""
    return f"{shared_dir(spark)}/credence-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: a short lineage that outlives executors.

    The files stay until ``clean``, since frames that read them may still be run.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Deletes all that ``cut`` wrote for this application; frames made before can't be run any more."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def meet(rows: DataFrame, keys: list[str], some: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` of the row of ``some`` that has their keys; rows without one go.

    ``some`` holds a key once. Its rows with ``common`` are broadcast, so that the many rows of a common key
    stay in the tasks where they lie; whoever sets ``common`` bounds how many there can be. The others meet
    by a shuffle.
    """
    common = some.where("common").select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c).alias(f"__{c}") for c in columns])
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    held = rows.join(F.broadcast(common), same, "left")
    hit = F.col(f"__{keys[0]}").isNotNull()
    near = held.where(hit).select(*rows.columns, *[F.col(f"__{c}").alias(c) for c in columns])
    far = held.where(~hit).select(*rows.columns).join(some.where("not common").select(*keys, *columns), keys)
    return near.unionByName(far.select(*rows.columns, *columns))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, so that further columns of the input cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def label_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, per_class: int) -> DataFrame:
    """(doc_id, y, text) of at most ``2 * per_class`` labelled rows outside the held-out fold.

    ``per_class`` is the documented bound on what a classifier is fitted on: of either class the rows with
    the smallest hash of their id. Ids that carry contradicting labels or none are left out. Of several texts
    of one id the least counts, so the order of rows does not matter.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
        .where(crc_mod(F.col("doc_id"), mod) != held)
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"), F.max("y").alias("top"))
        .where("y = top")
        .drop("top")
    )
    part = [
        known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)
    ]
    # At most 2 * per_class rows of two numbers: a bound that makes the broadcast safe.
    bounded = F.broadcast(part[0].unionByName(part[1]))
    return texts(docs).join(bounded, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
