"""A portable linkage fixture over the driver's tables: the same SQL runs in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("customer", "part", "nation", "region")

BASE = """
select c_custkey as k, p_name || ' ' || substr(c_mktsegment, 1, 4) || ' ' ||
    case c_custkey % 4 when 0 then 'Pvt Ltd' when 1 then 'LLC' when 2 then 'Inc' else 'Limited' end as business_name,
  cast(100 + (c_custkey * 37) % 9000 as string) || ' ' ||
    case c_custkey % 3 when 0 then 'Oak Road' when 1 then 'Main Street' else 'Hill Avenue' end || ', ' || n_name as business_address,
  r_name as country
from {customer} join {part} on p_partkey = c_custkey % 150 join {nation} on n_nationkey = c_nationkey join {region} on r_regionkey = n_regionkey
"""
ANCHORS = f"select 'S1-' || cast(k as string) as entity_id, business_name, business_address, country from ({BASE})"
S2_TARGETS = f"""
select 'S2-' || cast(k + 100000 as string) as entity_id,
  case k % 5 when 0 then upper(business_name) when 1 then replace(business_name, 'e', 'é') when 2 then replace(business_name, 'LLC', 'L.L.C.')
    when 3 then substr(business_name, 1, 3) || substr(business_name, 5) else replace(business_name, 'Limited', 'Ltd') end as business_name,
  case when k % 30 = 7 then '' else case when k % 6 = 0 then '0' else '' end ||
    upper(replace(replace(replace(business_address, 'Road', 'Rd'), 'Street', 'St'), 'Avenue', 'Ave')) end as business_address, country
from ({BASE}) where k % 18 <> 0
"""
S3_TARGETS = f"""
select 'S3-' || cast(k + 200000 as string) as entity_id, lower(replace(business_name, 'Inc', 'Incorporated')) as business_name, replace(business_address, ',', '') as business_address, country
from ({BASE}) where k % 7 = 3
"""
TARGETS = f"select * from ({S2_TARGETS}) union all select * from ({S3_TARGETS})"
TRUTH = f"""
select 'S1-' || cast(k as string) as s1_id, 'S2-' || cast(k + 100000 as string) as tgt_id from ({BASE}) where k % 18 <> 0
union all select 'S1-' || cast(k as string), 'S3-' || cast(k + 200000 as string) from ({BASE}) where k % 7 = 3
"""


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows over all cores: a table of a million names is one small file, which Spark reads in one task."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "entity_id")


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(spark.sql(ANCHORS, **_tables(spark, sf_dir)))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both target sources as one table."""
    two, three = (spark.sql(q, **_tables(spark, sf_dir)) for q in (S2_TARGETS, S3_TARGETS))
    return _dealt(two.unionByName(three))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TRUTH, **_tables(spark, sf_dir))


def sql(text: str) -> str:
    """The SQL with plain table names, for DuckDB."""
    return text.format(**{t: t for t in TABLES})
