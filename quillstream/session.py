"""Session helpers: table access, checkpoints in the shared folder, salting."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longest side that is sent to all executors, in rows of a few dozen bytes.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a folder that holds one Parquet file or folder for each table."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark context, unless they find it on ``PYTHONPATH``."""
    root = Path(__file__).resolve().parent.parent
    sc = spark.sparkContext
    there = any(p and Path(p).resolve() == root for p in os.environ.get("PYTHONPATH", "").split(os.pathsep))
    if there or getattr(sc, "_quillstream_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="quillstream-")) / "quillstream.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((root / "quillstream").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(target))
    sc._quillstream_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; without that setting a temporary one on a local master, and an error on a cluster."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="quillstream-")
    spark.sparkContext.setCheckpointDir(shared)


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, for files that are written and read again."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}-{name}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that a lost executor costs no recomputation of its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def salted_rank(df: DataFrame, keys: list[str], order: list[Column], name: str, per_salt: int = 50_000) -> DataFrame:
    """Add ``name``: 0-based distinct positions within each group of ``keys``.

    No group is ever sorted in one task: a group of n rows is divided by a hash of its order columns into
    about n / ``per_salt`` parts, which are ranked apart and shifted by the sizes of the parts before them. The
    positions are therefore a seeded permutation of the group, stable for equal input; rows that tie in
    ``order`` get different positions in no defined order. An empty input gives an empty output; null keys are
    a group of their own.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    at = lambda d: [F.col(k).alias(n) for k, n in zip(keys, names)]
    on = lambda left: [left[k].eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    hot = cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > per_salt).select(*at(df), F.ceil(F.col("_n") / per_salt).cast("int").alias("_parts")))
    n_hot = hot.count()
    if not n_hot:
        return df.withColumn(name, F.row_number().over(_window(keys, order)).cast("long") - 1)
    hot = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
    salt = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(*order), F.col("_parts"))).otherwise(0).cast("int")
    salted = df.join(hot, on(df), "left").withColumn("_salt", salt).drop("_parts", *names)
    counts = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = _window(keys, [F.col("_salt")]).rowsBetween(-(2**31), -1)
    shift = counts.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).where("_shift > 0").select(*at(counts), F.col("_salt").alias("_s"), "_shift")
    ranked = salted.withColumn("_pos", F.row_number().over(_window([*keys, "_salt"], order)) - 1)
    both = ranked.join(shift, [*on(ranked), ranked["_salt"] == F.col("_s")], "left")
    return both.withColumn(name, F.col("_pos") + F.coalesce("_shift", F.lit(0))).drop("_salt", "_s", "_shift", "_pos", *names)


def _window(keys: list[str], order: list[Column]):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(*order)
