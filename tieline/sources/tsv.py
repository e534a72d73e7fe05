"""Tab-separated sources and sinks of record linkage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = ["entity_id", "business_name", "business_address", "country"]
#: Whole-field values of a match list that mean none.
NULL_WORDS = ("", "nan", "none", "null", "<null>")


def read_tsv(spark: SparkSession, path: str | list[str], columns: list[str] = RECORD, header: list[str] | None = None) -> DataFrame:
    """All-string columns, quotes literal, rows of another width dropped, '' for null. ``header``: the file's columns in order."""
    schema = ", ".join(f"`{c}` string" for c in header or columns)
    # Column pruning would skip the parse that finds rows of another width, so rows are read as lines.
    lines = spark.read.text(path).select(F.split("value", "\t", -1).alias("v"))
    names = header or columns
    rows = lines.where(F.size("v") == len(names)).select(*[F.coalesce(F.get("v", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(names)])
    assert len(schema.split(",")) == len(names)
    return rows.where(F.col(names[0]) != names[0]).select(*columns)


def stream_tsv(spark: SparkSession, path: str, columns: list[str] = RECORD, files_per_trigger: int = 1) -> DataFrame:
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).select(F.split("value", "\t", -1).alias("v"))
    rows = lines.where(F.size("v") == len(columns)).select(*[F.coalesce(F.get("v", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)])
    return rows.where(F.col(columns[0]) != columns[0])


def countries(anchors: DataFrame) -> DataFrame:
    """(s1_id, country) of every anchor."""
    return anchors.select(F.trim("entity_id").alias("s1_id"), F.trim("country").alias("country"))


def validate(spark: SparkSession, path: str, anchors: DataFrame, candidate_path: str | None = None, value: str = "matched_entity_ids") -> tuple[list[str], DataFrame | None]:
    """(fatal header faults, findings (rule, n, examples, fatal)) of a result file.

    The file must begin with its header and hold rows; with a fatal fault no findings are made. A match that is no
    candidate is only a warning.
    """
    from tieline.operators import metrics

    lines = spark.read.text(path).select(F.split("value", "\t", -1).alias("v"))
    header = ["source1_entity_id", value]
    heads = lines.where(F.col("v") == F.array(*[F.lit(c) for c in header])).count()
    if heads != 1:
        return [f"the header {' '.join(header)} stands {heads} times"], None
    body = lines.where(F.col("v") != F.array(*[F.lit(c) for c in header]))
    if body.isEmpty():
        return ["the file has no rows"], None
    malformed = body.where(F.size("v") != 2).select(F.lit("malformed_row").alias("rule"), F.col("v")[0].alias("id"))
    lists = body.where(F.size("v") == 2).select(F.col("v")[0].alias("s1"), F.col("v")[1].alias("value"))
    found = metrics.findings(lists, anchors.select(F.col("entity_id").alias("s1")))
    few = lambda df: df.groupBy("rule").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("id")), 1, 5).alias("examples"))
    found = found.unionByName(few(malformed)).withColumn("fatal", F.lit(True))
    if candidate_path:
        pairs = [links(rows, s1="s1", matched="value") for rows in (lists, read_tsv(spark, candidate_path, ["source1_entity_id", value]).toDF("s1", "value"))]
        outside = metrics.outside_candidates(*pairs).select(F.lit("no_candidate").alias("rule"), F.col("tgt_id").alias("id"))
        found = found.unionByName(few(outside).withColumn("fatal", F.lit(False)))
    return [], found


def links(truth: DataFrame, anchors: DataFrame | None = None, s1: str = "source1_entity_id", matched: str = "matched_entity_ids") -> DataFrame:
    """(s1_id, tgt_id) of a comma list of matches; with ``anchors`` only those of active anchors."""
    out = truth.select(F.trim(s1).alias("s1_id"), F.explode(F.split(F.coalesce(matched, F.lit("")), ",")).alias("tgt_id")).withColumn("tgt_id", F.trim("tgt_id")).where("tgt_id <> ''")
    return out if anchors is None else out.join(anchors.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi")


def match_lists(rows: DataFrame, s1: str = "source1_entity_id", value: str = "matched_entity_ids") -> DataFrame:
    """(s1_id, ids, n_rows): one row for each anchor, lists of repeated rows united, null words as none."""
    text = F.trim(F.coalesce(value, F.lit("")))
    ids = F.when(F.lower(text).isin(*NULL_WORDS), F.array().cast("array<string>")).otherwise(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""))
    each = rows.select(F.trim(s1).alias("s1_id"), ids.alias("ids"))
    return each.groupBy("s1_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"), F.count("*").alias("n_rows"))


def id_lists(anchors: DataFrame, decided: DataFrame, score: str = "p2") -> DataFrame:
    """One row for each anchor: (source1_entity_id, matched_entity_ids), best score first, '' for none."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col("tgt_id").alias("id"))))
    lists = decided.groupBy("s1_id").agg(F.concat_ws(",", F.transform(ranked, lambda x: x["id"])).alias("m"))
    out = anchors.select(F.col("entity_id").alias("s1_id")).join(lists, "s1_id", "left")
    return out.select(F.col("s1_id").alias("source1_entity_id"), F.coalesce("m", F.lit("")).alias("matched_entity_ids"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)
