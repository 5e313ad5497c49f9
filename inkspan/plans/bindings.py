"""The driver's tables under the names of this domain: events as model calls, documents as texts, orders as reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as model calls: the type is the scene, the user the reference, the value the cost; errors failed, views
    are cache hits, every seventh event belongs to an evaluation run."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("id"),
        F.element_at(F.create_map(*[F.lit(x) for x in ("view", "structure", "click", "match", "error", "diagnose", "purchase", "interview_ask", "signup", "rerank")]), F.col("event_type")).alias("scene"),
        F.when(F.col("user_id") % 2 == 0, "resume").otherwise("session").alias("ref_type"),
        F.col("user_id").alias("ref_id"),
        F.when(F.col("event_id") % 7 == 0, F.lit("run")).alias("run_id"),
        k.alias("token_input"),
        (k * 2).alias("token_output"),
        F.round(F.col("value"), 2).cast("decimal(10,6)").alias("cost"),
        (F.col("event_type") == "view").alias("cache_hit"),
        (F.col("event_type") != "error").alias("success"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("Error code: "), F.element_at(F.array(*[F.lit(c) for c in ("401", "402", "404", "429", "500", "400")]), (F.col("event_id") % 6 + 1).cast("int")), F.lit(" sk-abcdefgh12345"))).alias("error_msg"),
        F.col("ts").alias("created_at"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkspan.operators.spans import lines_with_offsets

    return lines_with_offsets(table(spark, sf_dir, "documents").select("doc_id", "text"))
