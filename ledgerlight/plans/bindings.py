"""The engine's inputs bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import fiscal_quarter, fiscal_year


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows dealt out by key before long work on each: a few megabytes of a file hold a million rows, and would be one task.
    The number of partitions is given, so that none are put together again for being small."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(company, name, fy, fq, value): order totals per market segment, priority and fiscal quarter, summed exactly."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_totalprice", F.to_date("o_orderdate").alias("d"))
    rows = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.col("c_mktsegment").alias("company"), F.col("o_orderpriority").alias("name"), fiscal_year(F.col("d")).alias("fy"), fiscal_quarter(F.col("d")).alias("fq"), "o_totalprice")
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value")
    return rows.groupBy("company", "name", "fy", "fq").agg(total)


METRICS_SQL = """
  select c_mktsegment as company, o_orderpriority as name, year(o_orderdate + interval 9 month)::int as fy,
    quarter(o_orderdate - interval 3 month)::int as fq, sum(o_totalprice::decimal(18,2))::double as value
  from orders join customer on o_custkey = c_custkey group by all
"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, company, topic, at): events as mentions of a topic."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("company"), F.col("event_type").alias("topic"), F.col("ts").alias("at"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("company"), F.col("lang").alias("kind"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
