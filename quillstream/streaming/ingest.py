"""Incremental ingest: micro-batches of records put into a store in buckets, idempotently.

A store is a folder: ``data/v=<version>/bucket=<n>`` has the rows of a bucket as of a version, and a manifest for each version
names the version that each bucket was last written in. A batch rewrites only the buckets it touches. The manifest is written under another
name and then renamed, so that readers see the store before a batch or after it, and a failure leaves the store before it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstream.operators.store import last_wins, upsert

#: Buckets of a new store; a store keeps the number it began with.
BUCKETS = 64
#: Versions whose files stay for readers that began before a batch.
KEPT = 2


def into_store(batches: DataFrame, store: str, checkpoint: str, key: str = "pmid", order: str = "loaded_at", trigger: dict | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep a store up to date with a stream of records: of each key the row with the highest ``order``.

    A batch that is repeated after a failure gives the same store, as the manifest has the last batch of the stream.
    """

    def put_batch(batch: DataFrame, epoch: int) -> None:
        now = manifest(batch.sparkSession, store)
        if now is None or now["stream"] != checkpoint or now["epoch"] < epoch:
            put(last_wins(batch, [key], order).drop("first_ord"), store, key, order, buckets, (checkpoint, epoch))

    return batches.writeStream.foreachBatch(put_batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def put(rows: DataFrame, store: str, key: str = "pmid", order: str | None = None, buckets: int = BUCKETS, batch: tuple[str, int] = ("", -1)) -> None:
    """Put ``rows``, one for each key, into a store; with ``order`` a row that the store has stays if its order is higher. Only the buckets of ``rows`` are rewritten."""
    spark = rows.sparkSession
    now = manifest(spark, store) or {"version": 0, "buckets": {}, "of": buckets, "stream": "", "epoch": -1}
    own = _bucket(F.col(key), now["of"])
    touched = sorted(r.b for r in rows.select(own.alias("b")).distinct().collect())
    if not touched:
        return
    paths = _paths(store, {b: v for b, v in now["buckets"].items() if int(b) in set(touched)})
    new = rows
    if paths:
        base = spark.read.parquet(*paths)
        if order is not None:
            new = last_wins(base.join(rows.select(key), key, "left_semi").unionByName(rows), [key], order).drop("first_ord")
        new = upsert(base, new, key)
    _write(new.select(*rows.columns), store, own, touched, now, batch)


def replace(rows: DataFrame, store: str, key: str = "pmid", buckets: int = BUCKETS) -> None:
    """Make ``rows`` the whole store."""
    now = manifest(rows.sparkSession, store) or {"version": 0, "buckets": {}, "of": buckets, "stream": "", "epoch": -1}
    _write(rows, store, _bucket(F.col(key), now["of"]), list(range(now["of"])), now | {"buckets": {}}, ("", -1))


def _bucket(key: Column, of: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(of)).cast("int")


def _paths(store: str, buckets: dict[str, int]) -> list[str]:
    return [f"{store}/data/v={v}/bucket={b}" for b, v in sorted(buckets.items(), key=lambda x: int(x[0]))]


def _write(rows: DataFrame, store: str, bucket: Column, touched: list[int], now: dict, batch: tuple[str, int]) -> None:
    spark, version = rows.sparkSession, now["version"] + 1
    target = f"{store}/data/v={version}"
    rows.withColumn("bucket", bucket).repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
    there = {n.rpartition("=")[2] for n in _names(spark, target) if n.startswith("bucket=")}
    where = {b: v for b, v in now["buckets"].items() if int(b) not in set(touched)} | dict.fromkeys(sorted(there, key=int), version)
    if not where:  # a store without rows still has columns
        rows.limit(0).write.mode("overwrite").parquet(f"{target}/bucket=0")
        where = {"0": version}
    _publish(spark, store, {"version": version, "buckets": where, "of": now["of"], "stream": batch[0], "epoch": batch[1]})
    _clean(spark, store)


def _fs(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark, folder: str) -> list[str]:
    fs, p = _fs(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _publish(spark, store: str, content: dict) -> None:
    fs, p = _fs(spark, f"{store}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(p, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    _, final = _fs(spark, f"{store}/manifests/{content['version']:012d}.json")
    if fs.exists(final) or not fs.rename(p, final):
        raise FileExistsError(f"another writer has made version {content['version']} of {store}")


def _versions(spark, store: str) -> list[int]:
    return sorted(int(n[:-5]) for n in _names(spark, f"{store}/manifests") if n.endswith(".json") and not n.startswith("."))


def _read(spark, store: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{store}/manifests/{version:012d}.json", wholetext=True).first()[0])


def manifest(spark, store: str) -> dict | None:
    """The manifest that readers use; None before the first batch."""
    versions = _versions(spark, store)
    return _read(spark, store, versions[-1]) if versions else None


def _clean(spark, store: str) -> None:
    """Delete manifests before the last ``KEPT``, and data that none of these names."""
    versions = _versions(spark, store)
    live = {v for k in versions[-KEPT:] for v in _read(spark, store, k)["buckets"].values()}
    for k in versions[:-KEPT]:
        fs, p = _fs(spark, f"{store}/manifests/{k:012d}.json")
        fs.delete(p, False)
    for n in _names(spark, f"{store}/data"):
        if n.startswith("v=") and int(n[2:]) not in live and int(n[2:]) < versions[-1]:
            fs, p = _fs(spark, f"{store}/data/{n}")
            fs.delete(p, True)


def read_store(spark, store: str) -> DataFrame | None:
    """The store as of the last batch."""
    now = manifest(spark, store)
    return None if now is None else spark.read.parquet(*_paths(store, now["buckets"]))
