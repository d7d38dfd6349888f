"""An upsert table in hash buckets: a batch rewrites the buckets it touches, readers read one version.

Rows lie in ``buckets`` folders by the hash of their key. A batch merges its latest row per key with the
buckets that hold these keys and writes them anew; a version file, which lists the folder of every bucket, is put in
place last. Until then readers see the version before, and after a failure the batch writes its folder again. A batch
that the version already holds does nothing. Reading costs the current rows, whatever number of batches there was;
a batch costs its share of the buckets, so their number should make one bucket some hundred megabytes.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.text import col
from ..operators.dedup import latest_per_key

_BUCKET = "_bucket"
_BATCH = "_batch"


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, path: str) -> dict | None:
    """The version with the highest number, if the table has any."""
    jvm, folder, system = _folder(spark, f"{path}/_versions")
    if not system.exists(folder):
        return None
    names = [f.getPath().getName() for f in system.listStatus(folder)]
    numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] not in "._"]
    if not numbers:
        return None
    source = system.open(jvm.org.apache.hadoop.fs.Path(folder, f"{max(numbers):012d}.json"))
    try:
        return json.loads(bytes(source.readAllBytes()).decode())
    finally:
        source.close()


def _publish(spark: SparkSession, path: str, version: dict) -> None:
    jvm, folder, system = _folder(spark, f"{path}/_versions")
    system.mkdirs(folder)
    draft = jvm.org.apache.hadoop.fs.Path(folder, f".{version['number']}.draft")
    target = jvm.org.apache.hadoop.fs.Path(folder, f"{version['number']:012d}.json")
    out = system.create(draft, True)
    out.write(bytearray(json.dumps(version, sort_keys=True).encode()))
    out.close()
    if not system.rename(draft, target):
        raise RuntimeError(f"version {version['number']} of {path} was written by someone else")


def _read(spark: SparkSession, path: str, schema, folders: Sequence[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders])


def merge_batch(batch: DataFrame, batch_id: int, path: str, keys: Sequence[str], order_by: Sequence[str], buckets: int = 64, writer: str = "") -> None:
    """Bring the latest row per key of one batch into the table; of equal versions the later batch counts.

    ``writer`` names who numbers the batches. The number of buckets is that of the table once it has a version.
    """
    spark = batch.sparkSession
    before = current_version(spark, path) or {"number": -1, "buckets": buckets, "folders": {}, "writer": None, "batch": -1}
    if before["writer"] == writer and before["batch"] >= batch_id:
        return
    number, schema = before["number"] + 1, batch.schema
    bucket = F.pmod(F.xxhash64(*[col(k) for k in keys]), F.lit(before["buckets"])).cast("int")
    news = latest_per_key(batch, keys, order_by).withColumns({_BUCKET: bucket, _BATCH: F.lit(1)}).persist()
    try:
        # At most as many values as the table has buckets.
        touched = sorted(str(r[0]) for r in news.select(_BUCKET).distinct().collect())
        if not touched:
            return
        old = _read(spark, path, schema, [before["folders"][b] for b in touched if b in before["folders"]])
        both = news.unionByName(old.withColumns({_BUCKET: bucket, _BATCH: F.lit(0)})).repartition(_BUCKET)
        merged = latest_per_key(both, [_BUCKET, *keys], [*order_by, _BATCH]).drop(_BATCH)
        merged.write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{path}/rows-{number}")
    finally:
        news.unpersist()
    folders = before["folders"] | {b: f"rows-{number}/{_BUCKET}={b}" for b in touched}
    _publish(spark, path, {"number": number, "buckets": before["buckets"], "folders": folders, "writer": writer, "batch": batch_id})


def upsert_buckets(rows: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order_by: Sequence[str], buckets: int = 64, **trigger) -> StreamingQuery:
    """Keep the latest row per key of a stream; by default what has arrived so far, then stop."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # A new checkpoint numbers its batches anew, under another id.
        writer = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        merge_batch(batch, batch_id, path, keys, order_by, buckets, writer)

    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_buckets(spark: SparkSession, path: str, schema) -> DataFrame:
    """The current row of every key."""
    version = current_version(spark, path)
    return _read(spark, path, schema, sorted((version or {"folders": {}})["folders"].values()))


def drop_old_versions(spark: SparkSession, path: str) -> int:
    """Drop the bucket folders that the current version does not use; no reader may still read an older one."""
    version = current_version(spark, path)
    used = set(version["folders"].values()) if version else set()
    _, root, system = _folder(spark, path)
    dropped = 0
    for batch in system.listStatus(root) if system.exists(root) else ():
        if batch.getPath().getName().startswith("rows-"):
            for bucket in system.listStatus(batch.getPath()):
                name = f"{batch.getPath().getName()}/{bucket.getPath().getName()}"
                if bucket.isDirectory() and name not in used:
                    dropped += system.delete(bucket.getPath(), True)
    return dropped
