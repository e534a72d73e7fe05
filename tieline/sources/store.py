"""Sources and sinks in the shared store: candidates, pair blocks, id sets, samples, summaries. Nothing is opened locally."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: First fields that are a header and no id.
HEADERS = ("entity_id", "source1_entity_id", "id")


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and the executors share. Only a local session without one named gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root or tempfile.mkdtemp(prefix='tieline-')}/tieline-{uuid.uuid4().hex}"


def _file(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def modified(spark: SparkSession, path: str) -> int:
    """When a file or folder was last changed, in the store's own milliseconds."""
    fs, where = _file(spark, path)
    return fs.getFileStatus(where).getModificationTime()


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _file(spark, path)
    fs.delete(where, True)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written (by default to a scratch folder) and read again, so that what it was made from can be let go."""
    path = path or scratch(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables of ``written`` that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df._written_to)


def write_json(spark: SparkSession, path: str, body: dict) -> None:
    """A summary as one JSON file in any store that Spark reaches."""
    fs, where = _file(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(json.dumps(body, ensure_ascii=False, indent=1, sort_keys=True).encode()))
    finally:
        out.close()


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def write_by_country(df: DataFrame, path: str) -> None:
    """Candidates by country; countries that ``df`` has replace their old files, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("country").parquet(path)


def read_by_country(spark: SparkSession, path: str, country: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path).withColumn("country", F.col("country").cast("string"))
    return rows if country is None else rows.where(F.col("country") == country)


def write_pairs(pairs: DataFrame, path: str, features: list[str]) -> None:
    """A block of pairs for training: ids, label and features as floats."""
    pairs.select("tgt_id", "s1_id", F.col("label").cast("tinyint").alias("label"), *[F.col(c).cast("float").alias(c) for c in features]).write.mode("append").parquet(path)


def read_pairs(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id): the distinct first fields of a tab-separated file, gzipped or not; header and blank lines are none."""
    first = spark.read.text(path).select(F.trim(F.split("value", "\t", 2)[0]).alias("id"))
    return first.where((F.col("id") != "") & ~F.lower("id").isin(*HEADERS)).distinct()


def read_country_lists(spark: SparkSession, *paths: str) -> DataFrame:
    """(s1, value) of per-country result files, gzipped or not."""
    fields = spark.read.text(list(paths)).select(F.split("value", "\t", -1).alias("v"))
    rows = fields.where(F.size("v") == 2).select(F.trim(F.col("v")[0]).alias("s1"), F.col("v")[1].alias("value"))
    return rows.where(~F.lower("s1").isin(*HEADERS))


def missed_sample(missed: DataFrame, best: DataFrame, targets: DataFrame, anchors: DataFrame, most: int = 3000) -> DataFrame:
    """Up to ``most`` missed links (tgt_id, s1_id), by hash order of the target, with the records of both sides and of the best candidate."""
    some = missed.orderBy(F.md5("tgt_id"), "tgt_id").limit(most)
    side = lambda rows, key, tag: rows.select(F.col("entity_id").alias(key), F.col("business_name").alias(f"{tag}_name"), F.col("business_address").alias(f"{tag}_address"))
    out = some.join(side(targets, "tgt_id", "target"), "tgt_id", "left").join(side(anchors, "s1_id", "true"), "s1_id", "left")
    top = best.select("tgt_id", F.col("s1_id").alias("best_id"))
    return out.join(top, "tgt_id", "left").join(side(anchors, "best_id", "best"), "best_id", "left")
