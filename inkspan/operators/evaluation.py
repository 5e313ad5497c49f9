"""Evaluation harness: detection, agreement, tiers, layout order and load figures over ground-truth tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.operators.spans import overlaps


def detection(truth: DataFrame, findings: DataFrame) -> DataFrame:
    """Per defect type the share found at its place, and found with the right type. truth: file, defect, char_start, char_end; findings: file, risk_type, char_start, char_end."""
    t = truth.withColumn("_id", F.struct("file", "defect", "char_start"))
    f = findings.select(F.col("file").alias("_f"), "risk_type", F.col("char_start").alias("_s"), F.col("char_end").alias("_e"))
    j = t.join(f, (F.col("file") == F.col("_f")) & overlaps(F.col("char_start"), F.col("char_end"), F.col("_s"), F.col("_e")), "left")
    per = j.groupBy("_id", "defect").agg(F.max(F.col("_f").isNotNull().cast("int")).alias("place"), F.max(F.coalesce(F.col("risk_type") == F.col("defect"), F.lit(False)).cast("int")).alias("kind"))
    return per.groupBy("defect").agg(F.count("*").alias("n"), F.avg("place").alias("by_place"), F.avg("kind").alias("by_type"))


def noise(clean_files: DataFrame, findings: DataFrame) -> DataFrame:
    """Mean number of findings on files without a defect."""
    n = findings.groupBy("file").agg(F.count("*").alias("n"))
    return clean_files.join(n, "file", "left").agg(F.avg(F.coalesce("n", F.lit(0))).alias("noise"))


def agreement(truth: DataFrame, answers: DataFrame, by: str) -> DataFrame:
    """Share of equal statuses per kind and overall (kind null), in one rollup."""
    keys = [c for c in truth.columns if c in answers.columns and c != "status"]
    j = truth.join(answers.withColumnRenamed("status", "_got"), keys, "left")
    return j.rollup(by).agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col("status") == F.col("_got"), F.lit(False)).cast("int")).alias("agreement"))


def tiers(scores: DataFrame) -> DataFrame:
    """Mean per tier, and the mean spread of repeats. scores: question, tier, run, score."""
    spread = scores.groupBy("question", "tier").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"), (F.count_distinct("score") == 1).cast("int").alias("same"))
    return spread.groupBy("tier").agg(F.avg("mean").alias("mean"), F.avg("sd").alias("sd"), F.avg("same").alias("all_equal"))


def tier_order(scores: DataFrame, better: str, worse: str) -> DataFrame:
    """Share of questions whose better tier has the higher mean."""
    m = scores.groupBy("question", "tier").agg(F.avg("score").alias("mean"))
    a, b = m.filter(F.col("tier") == better).select("question", F.col("mean").alias("a")), m.filter(F.col("tier") == worse).select("question", F.col("mean").alias("b"))
    return a.join(b, "question").agg(F.count("*").alias("pairs"), F.avg((F.col("a") > F.col("b")).cast("int")).alias("ordered"))


def adjacent_pairs(truth: DataFrame, output: DataFrame, group: str = "layout") -> DataFrame:
    """Share of true neighbours that are neighbours in the output, per group and in all (group null)."""
    w = Window.partitionBy("file").orderBy("position")
    t = truth.withColumn("next", F.lead("line").over(w)).filter("next IS NOT NULL")
    o = output.withColumn("_next", F.lead("line").over(w)).select("file", "line", "_next")
    j = t.join(o, ["file", "line"], "left")
    return j.rollup(group).agg(F.count("*").alias("pairs"), F.avg(F.coalesce(F.col("next") == F.col("_next"), F.lit(False)).cast("int")).alias("accuracy"))


def layout_figures(truth: DataFrame, output: DataFrame, types: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Per layout and in all (layout null): pairs_ok, pairs, docs_ok, docs, missing, layout_ok, layout_scored.

    A true pair of neighbouring lines is right if the output's next true line is the same; a document is, if all its pairs are.
    truth: file, layout, position, line; output: file, position, line; types: file, layout_type (null: no output); ``expected``
    says which type a layout must get, layouts that are not in it are not scored for it.
    """
    w = Window.partitionBy("file").orderBy("position")
    t = truth.withColumn("next", F.lead("line").over(w))
    o = output.join(truth.select("file", "line"), ["file", "line"], "left_semi").withColumn("_next", F.lead("line").over(w))
    j = t.join(o.select("file", "line", "_next", F.lit(1).alias("_there")), ["file", "line"], "left")
    right = (F.col("next").isNotNull() & F.coalesce(F.col("next") == F.col("_next"), F.lit(False))).cast("long")
    per = j.groupBy("file", "layout").agg(F.sum(right).alias("ok"), (F.count("*") - 1).alias("pairs"), F.count_if(F.col("_there").isNull()).alias("missing"))
    want = F.coalesce(*[F.when(F.col("layout") == k, F.lit(v)) for k, v in expected.items()], F.lit(None).cast("string"))
    per = per.join(types.select("file", "layout_type"), "file", "left").withColumn("_want", want)
    hit = F.coalesce(F.col("layout_type") == F.col("_want"), F.lit(False))
    return per.rollup("layout").agg(F.sum("ok").alias("pairs_ok"), F.sum("pairs").alias("pairs"), F.count_if(F.col("ok") == F.col("pairs")).alias("docs_ok"), F.count("*").alias("docs"), F.sum("missing").alias("missing"), F.count_if(hit).alias("layout_ok"), F.count("_want").alias("layout_scored"))


def load_figures(requests: DataFrame, by: str = "name") -> DataFrame:
    """Count, failures, rate per second, mean and percentiles of latency per request name."""
    p = lambda q: F.percentile("latency_ms", q)
    seconds = F.greatest(F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")) if hasattr(F, "timestamp_diff") else F.lit(1), F.lit(1))
    return requests.groupBy(by).agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("failed"), (F.count("*") / seconds).alias("per_second"), F.avg("latency_ms").alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.max("latency_ms").alias("max"))


def median_by_weight(df: DataFrame, key: str, value: Column, weight: Column) -> DataFrame:
    """Value at the middle of the weights, ordered by value."""
    d = df.select(key, value.alias("_v"), weight.alias("_w")).groupBy(key, "_v").agg(F.sum("_w").alias("_w"))
    w = Window.partitionBy(key).orderBy("_v")
    d = d.withColumn("_run", F.sum("_w").over(w)).withColumn("_all", F.sum("_w").over(Window.partitionBy(key)))
    return d.filter(F.col("_run") > F.floor(F.col("_all") / 2)).groupBy(key).agg(F.min("_v").alias("median"))
