"""Lists that pages show: ownership, paging, children, gates, gaps and top issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GATE = 60.0
SEVERITY = {"high": 0, "medium": 1, "low": 2}
STATUS_RANK = {"miss": 0, "partial": 1, "hit": 2}


def owned(df: DataFrame, user_id: int | Column) -> DataFrame:
    return df.filter((F.col("user_id") == user_id) & ~F.col("is_deleted"))


def visible_jobs(jobs: DataFrame, user_id: int | Column) -> DataFrame:
    return jobs.filter(((F.col("user_id") == user_id) | F.col("is_template")) & ~F.col("is_deleted"))


def order_jobs(jobs: DataFrame) -> DataFrame:
    """Own jobs newest first, then templates oldest first."""
    return jobs.orderBy("is_template", F.when(F.col("is_template"), F.col("id")).otherwise(-F.col("id")))


def visible_findings(findings: DataFrame) -> DataFrame:
    return findings.filter("verify_result IS NULL OR verify_result != 'failed'")


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """One page with the total count on each row; size 1..100."""
    if not 1 <= size <= 100 or number < 1:
        raise ValueError("page number from 1, size 1..100")
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))  # total is one row


WIDEST = 10_000


def deferred(df: DataFrame, key: str, n: int, order: list[Column], narrow: list[str], wide: list[str]) -> DataFrame:
    """The first ``n`` rows in ``order`` with their wide columns, which are read for these rows alone.

    The order is decided on key and ``narrow``; the at most WIDEST keys that win are sent to the scan of the wide
    columns, so no wide value is sorted or shuffled. Keys are unique and not null.
    """
    if not 1 <= n <= WIDEST:
        raise ValueError(f"1 to {WIDEST} rows")
    first = df.select(key, *[c for c in narrow if c != key]).orderBy(*order).limit(n)
    return F.broadcast(first).join(df.select(key, *wide), key).select(key, *[c for c in narrow if c != key], *wide)


def attach_children(parents: DataFrame, children: DataFrame, key: str, order: str, name: str, fields: list[str]) -> DataFrame:
    """Each parent with an array of its children, newest first; empty where it has none."""
    got = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *[f for f in fields if f != order])), asc=False).alias(name))
    return parents.join(got, key, "left").withColumn(name, F.coalesce(name, F.array().cast(got.schema[name].dataType)))


def count_children(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    return parents.join(children.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def latest_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def latest_final(diagnoses: DataFrame) -> DataFrame:
    """Per résumé its latest finished diagnosis, else its latest."""
    done = F.col("status").isin("done", "partial")
    return latest_by(diagnoses, ["resume_id"], done.desc(), F.col("id").desc())


def find_duplicates(uploads: DataFrame, resumes: DataFrame) -> DataFrame:
    """Each upload with the user's own latest undeleted résumé of the same content, or null."""
    kept = latest_by(resumes.filter(~F.col("is_deleted")), ["user_id", "file_hash"], F.col("id").desc()).select("user_id", "file_hash", F.col("id").alias("duplicate_of"))
    return uploads.join(kept, ["user_id", "file_hash"], "left")


def unused(owned: DataFrame, uses: DataFrame, key: str, used_key: str) -> DataFrame:
    """Rows that nothing refers to; rows with a null key are never referred to."""
    return owned.join(uses.select(F.col(used_key).alias("_used")), F.col(key) == F.col("_used"), "left_anti")


def used(owned: DataFrame, uses: DataFrame, key: str, used_key: str) -> DataFrame:
    return owned.join(uses.select(F.col(used_key).alias("_used")), F.col(key) == F.col("_used"), "left_semi")


def passes_gate(overall: Column, threshold: float = GATE) -> Column:
    return F.coalesce(overall >= threshold, F.lit(False))


def stage_of(status: Column) -> Column:
    return F.when(status.isin("pending", "running"), "running").when(status.isin("done", "partial"), "finished").otherwise("failed")


def failure_of(status: Column, error: Column, parse_error: Column) -> Column:
    """Message for a failed application: a parse error's own words, an interruption, or a plain failure."""
    return F.when(status == "failed", F.coalesce(parse_error, F.when(error.startswith("interrupted"), "interrupted, please retry"), F.lit("failed, please retry")))


def intercept_rate(hallucinations: Column, findings: Column) -> Column:
    return F.when(findings > 0, F.round(hallucinations / findings, 3))


def severity_rank(severity: Column) -> Column:
    return F.coalesce(*[F.when(severity == k, F.lit(v)) for k, v in SEVERITY.items()], F.lit(3))


def severity_order() -> list[Column]:
    return [severity_rank(F.col("severity")), F.col("char_start").asc_nulls_last()]


def top_issues(findings: DataFrame, key: str, n: int = 8) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*severity_order(), "finding_id")
    return visible_findings(findings).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def gap_items(items: DataFrame) -> DataFrame:
    """Requirements not met, with their order: heavier first, misses before partial ones, then id."""
    rank = F.coalesce(*[F.when(F.col("status") == k, F.lit(v)) for k, v in STATUS_RANK.items()])
    w = Window.partitionBy("report_id").orderBy(F.col("weight").desc(), rank, "requirement_id")
    return items.filter("status != 'hit'").withColumn("position", F.row_number().over(w))


def first_n(df: DataFrame, keys: list[str], n: int, *order: Column | str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def dedupe_first(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    return first_n(df, keys, 1, *order)


def nonnull_scores(scores: Column) -> Column:
    """A map of scores without its nulls, rounded."""
    return F.transform_values(F.map_filter(scores, lambda _, v: v.isNotNull()), lambda _, v: F.round(v))
