"""What the pages count and list: recent rows, running ones first, numbers over combined lists, hits, ages, tabs, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.operators.listing import first_n, severity_rank

PUBLIC_EVALUATION = ("skipped", "score", "scores", "evidence", "good", "bad", "better_answer", "decision", "low_evidence")
AXIS_STEPS = (1, 2, 3, 4, 5, 6, 8, 10)


def recent(df: DataFrame, key: str, n: int, order: str = "id") -> DataFrame:
    """The newest ``n`` rows of each key."""
    return first_n(df, [key], n, F.col(order).desc())


def live_first(sessions: DataFrame, key: str, n: int, order: str = "id") -> DataFrame:
    """``n`` sessions of each key: those not finished, then the others, newest first in both; ``position`` from 1."""
    w = Window.partitionBy(key).orderBy(F.col("status").isin("created", "in_progress").desc(), F.col(order).desc())
    return sessions.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def hit_counts(items: DataFrame, key: str = "report_id") -> DataFrame:
    return items.groupBy(key).agg(F.count_if(F.col("status") == "hit").alias("hits"), F.count("*").alias("total"))


def apply_tabs(applies: DataFrame, key: str = "user_id") -> DataFrame:
    """Per key how many applications there are, passed and failed; those without a result are in neither tab."""
    done = F.col("status") == "success"
    return applies.groupBy(key).agg(F.count("*").alias("all"), F.count_if(done & F.col("passed")).alias("pass"), F.count_if(done & ~F.col("passed")).alias("fail"))


def in_tab(applies: DataFrame, tab: str) -> DataFrame:
    """Applications of a tab: all, pass or fail."""
    if tab not in ("all", "pass", "fail"):
        raise ValueError(f"unknown tab {tab}")
    return applies if tab == "all" else applies.filter((F.col("status") == "success") & (F.col("passed") == F.lit(tab == "pass")))


def three_lists(gaps: DataFrame, issues: DataFrame, hits: DataFrame) -> DataFrame:
    """Gaps, issues of the résumé and hits of a report as one table: report_id, list, key, tag, color, text, why, note.

    gaps and hits: report_id, requirement_id, status, content, reason, char_start; issues: report_id, finding_id,
    severity, title, evidence_quote, char_start. A color needs a place in the text; missed requirements have none.
    """
    id_, placed, quote = F.col("report_id").cast("string"), F.col("char_start").isNotNull(), F.col("evidence_quote")
    quoted = F.coalesce(quote, F.lit("")) != ""
    key = lambda kind, *parts: F.concat_ws(":", F.lit(kind), *parts)
    miss = F.col("status") == "miss"
    g = gaps.select(
        "report_id", F.lit("gap").alias("list"), key("gap", id_, F.col("requirement_id").cast("string")).alias("key"), F.when(miss, "缺失").otherwise("部分").alias("tag"),
        F.when(~miss & placed, "part").alias("color"), F.col("content").alias("text"), F.col("reason").alias("why"), F.concat(F.lit("部分满足："), "content").alias("note"),
    )
    label = F.element_at(F.array(*[F.lit(x) for x in ("严重", "中等", "轻微", "")]), severity_rank(F.col("severity")) + 1)
    s = issues.select(
        "report_id", F.lit("self").alias("list"), key("finding", F.col("finding_id").cast("string")).alias("key"), label.alias("tag"), F.when(placed, "bad").alias("color"),
        F.when(quoted, F.concat(F.lit("「"), quote, F.lit("」"))).otherwise(F.col("title")).alias("text"), F.when(quoted, F.col("title")).otherwise("针对整份简历").alias("why"), F.col("title").alias("note"),
    )
    h = hits.select(
        "report_id", F.lit("hit").alias("list"), key("hit", id_, F.col("requirement_id").cast("string")).alias("key"), F.lit("满足").alias("tag"),
        F.when(placed, "good").alias("color"), F.col("content").alias("text"), F.col("reason").alias("why"), F.concat(F.lit("满足："), "content").alias("note"),
    )
    return g.unionByName(s).unionByName(h)


def numbered(df: DataFrame, key: str, *order: Column | str, name: str = "number") -> DataFrame:
    """Rows of each key numbered from 1 over the combined list."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def age_text(day: Column, today: Column) -> Column:
    n = F.datediff(today, day)
    return F.when(n <= 0, "今天").when(n == 1, "昨天").otherwise(F.concat(n.cast("string"), F.lit(" 天前")))


def axis_top(v: Column) -> Column:
    """A readable upper end of an axis: the least step times a power of ten that reaches the value; 1 for none."""
    size = F.pow(F.lit(10.0), F.floor(F.log10(v)))
    steps = F.filter(F.array(*[F.lit(float(s)) for s in AXIS_STEPS]), lambda s: v <= s * size * 1.0001)
    return F.when(v > 0, F.coalesce(F.array_min(steps), F.lit(10.0)) * size).otherwise(1.0)


def rank_by_cost(features: DataFrame) -> DataFrame:
    """Features with their rank by cost from 0, equal ones in their own order; a feature table has a fixed few rows."""
    return features.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("cost").desc(), "ordinal")) - 1)


def session_brief(sessions: DataFrame) -> DataFrame:
    """Sessions as shown under an application: the topic counts from 1 while in progress, else 0; results only when ended."""
    ended = F.col("status").isin("finished", "abandoned")
    return sessions.select(
        "id", "mode", "status", "topic_count", F.when(F.col("status") == "in_progress", F.col("current_topic") + 1).otherwise(0).alias("current_topic"),
        F.when(ended, F.col("overall")).alias("overall"), F.when(ended, F.col("verdict")).alias("verdict"),
    )


def public_evaluation(evaluation: Column) -> Column:
    """A JSON evaluation with its public keys only; null and empty stay null."""
    whole = F.from_json(evaluation, "map<string, string>")
    return F.when(F.size(F.coalesce(whole, F.create_map().cast("map<string, string>"))) > 0, F.map_filter(whole, lambda k, _: k.isin(*PUBLIC_EVALUATION)))
