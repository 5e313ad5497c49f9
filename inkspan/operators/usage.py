"""Usage analytics over model-call facts.

Calls: scene, ref_type, ref_id, run_id, token_input, token_output, cost decimal(10,6), cache_hit, success, error_msg,
created_at. A user call has no run_id and a ref_id; everything else counts as "other".
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions.text import redact_keys
from inkspan.operators.ranking import with_position

FEATURES = ("parse", "jd", "diagnose", "match", "advice", "interview", "other")
SCENE_FEATURE = {"structure": "parse", "section": "parse", "jd_parse": "jd", "diagnose": "diagnose", "match": "match", "rewrite": "advice", "gap": "advice", "embed": "interview", "rerank": "interview"}
FAILURES_SHOWN = 20


def feature_of(scene: Column, mapping: dict[str, str] = SCENE_FEATURE) -> Column:
    known = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    return F.coalesce(F.try_element_at(known, scene), F.when(scene.startswith("interview"), "interview"), F.lit("other"))


def failure_reason(message: Column) -> Column:
    """What an administrator reads of a failed call; the first rule that fits decides, null is "other"."""
    # the leftmost of both forms decides
    both = "Error code: (\\d{3})|'(\\d{3}) [A-Z]"
    code = F.nullif(F.concat(F.regexp_extract(message, both, 1), F.regexp_extract(message, both, 2)), F.lit("")).cast("int")
    numbered = lambda text: F.concat(F.lit(f"{text}（"), code.cast("string"), F.lit("）"))
    return (
        F.when(message.contains("提前结束了流式读取"), "页面中途关了或刷新了，没生成完")
        .when(message.contains("限流占位失败"), "排队等名额超时，或者 Redis 连不上")
        .when(code == 402, "余额不足（402）")
        .when(code.isin(401, 403), numbered("密钥无效"))
        .when(code == 429, "请求太快，被服务商限流（429）")
        .when(code == 404, "接口地址或模型名不对（404）")
        .when(code >= 500, numbered("模型服务自己出错了"))
        .when(code.isNotNull(), F.concat(F.lit("请求被拒绝（"), code.cast("string"), F.lit("），多半是模型名不对")))
        .when(message.rlike("(?i)timeout|timed out"), "超时")
        .when(message.rlike("(?i)connect"), "连不上模型服务")
        .otherwise("其他错误")
    )


def user_calls(calls: DataFrame) -> DataFrame:
    return calls.filter("run_id IS NULL AND ref_id IS NOT NULL")


def other_calls(calls: DataFrame) -> DataFrame:
    return calls.filter("run_id IS NOT NULL OR ref_id IS NULL")


def in_days(calls: DataFrame, start: str, end: str) -> DataFrame:
    """Half-open in time: from start 00:00 up to the day after end."""
    return calls.filter((F.col("created_at") >= F.lit(start).cast("timestamp_ntz")) & (F.col("created_at") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")))


def sums() -> list[Column]:
    """calls, cached, failed, token_input, token_output, cost."""
    return [
        F.count("*").alias("calls"),
        F.count_if("cache_hit").alias("cached"),
        F.count_if(~F.col("success")).alias("failed"),
        F.coalesce(F.sum("token_input"), F.lit(0)).cast("long").alias("token_input"),
        F.coalesce(F.sum("token_output"), F.lit(0)).cast("long").alias("token_output"),
        F.coalesce(F.sum("cost"), F.lit(0)).cast("decimal(20,6)").alias("cost"),
    ]


def grouped(calls: DataFrame) -> DataFrame:
    """The one base aggregate: user calls by day, scene and reference."""
    return user_calls(calls).groupBy(F.to_date("created_at").alias("day"), "scene", "ref_type", "ref_id").agg(*sums())


def resum(base: DataFrame, *keys: str | Column, more: tuple[Column, ...] = ()) -> DataFrame:
    return base.groupBy(*keys).agg(*[F.sum(c).cast("decimal(20,6)" if c == "cost" else "long").alias(c) for c in ("calls", "cached", "failed", "token_input", "token_output", "cost")], *more)


def _filled(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit(0)).cast("decimal(20,6)" if c == "cost" else "long") for c in ("calls", "cached", "failed", "token_input", "token_output", "cost")})


def by_day(base: DataFrame, start: str, end: str) -> DataFrame:
    """One row per day of the window, zeros where nothing was called."""
    spark = base.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    return _filled(days.join(resum(base, "day"), "day", "left"))


def by_feature(base: DataFrame) -> DataFrame:
    """Features in their fixed order (ordinal); other only where it has calls."""
    spark = base.sparkSession
    dim = spark.createDataFrame(list(enumerate(FEATURES)), "ordinal int, feature string")
    got = resum(base, feature_of(F.col("scene")).alias("feature"))
    return _filled(F.broadcast(dim).join(got, "feature", "left")).filter("feature != 'other' OR calls > 0")


def by_user(base: DataFrame, owners: DataFrame) -> DataFrame:
    """Per owner with last_used; calls without an owner in one null row. owners: ref_type, ref_id, user_id. rank puts
    the null row last and the others by falling cost."""
    joined = base.join(owners, ["ref_type", "ref_id"], "left")
    got = resum(joined, "user_id", more=(F.max("day").alias("last_used"),))
    placed = with_position(got, F.col("user_id").isNull(), F.col("cost").desc(), F.col("user_id"), name="rank")
    return placed.withColumn("rank", F.col("rank").cast("int"))


def owners_of(*paths: DataFrame) -> DataFrame:
    """(ref_type, ref_id, user_id) over all the ways a reference leads to its owner."""
    out = paths[0]
    for p in paths[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["ref_type", "ref_id"])


def first_day(calls: DataFrame, today: Column) -> DataFrame:
    return calls.agg(F.least(F.coalesce(F.to_date(F.min("created_at")), today), today).alias("first_day"))


def recent_failures(calls: DataFrame, n: int = FAILURES_SHOWN) -> DataFrame:
    """The newest failed user calls with their reason; what looks like a key is hidden."""
    failed = user_calls(calls).filter("NOT success").orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)
    return failed.select("id", "created_at", "scene", failure_reason(F.col("error_msg")).alias("reason"), redact_keys(F.col("error_msg")).alias("error_msg"))


def totals(base: DataFrame, day: str | None = None) -> DataFrame:
    """Sums over the window, or over one day of it; a day that is no date is ignored."""
    if day is not None:
        d = F.try_to_date(F.lit(day)) if hasattr(F, "try_to_date") else F.lit(day).try_cast("date")
        base = base.filter(d.isNull() | (F.col("day") == d))
    return _filled(resum(base))


def registered(users: DataFrame) -> DataFrame:
    """Number of job seekers among the users, one row."""
    return users.filter("role = 'seeker'").agg(F.count("*").alias("registered"))


def side_by_side(*figures: DataFrame) -> DataFrame:
    """One row of several one-row frames."""
    out = figures[0]
    for f in figures[1:]:
        out = out.crossJoin(f)  # aggregates without keys: one row each
    return out


def usage_report(calls: DataFrame, users: DataFrame, start: str, end: str, day: str | None = None) -> DataFrame:
    """One row: sums of the window's user calls (of one day, if given), the window's cost, other calls, registered users."""
    window = in_days(calls, start, end)
    base = grouped(window)
    cost = base.agg(F.coalesce(F.sum("cost"), F.lit(0)).cast("decimal(20,6)").alias("window_cost"))
    other = other_calls(window).agg(F.count("*").alias("other_calls"), F.coalesce(F.sum("cost"), F.lit(0)).cast("decimal(20,6)").alias("other_cost"))
    return side_by_side(totals(base, day), cost, other, registered(users))


def activity(reports: DataFrame, resumes: DataFrame) -> DataFrame:
    """Applications and résumés used per user."""
    return reports.join(resumes.select("resume_id", "user_id"), "resume_id").groupBy("user_id").agg(F.count("*").alias("applies"), F.count_distinct("resume_id").alias("resumes"))


def call_cost(token_input: Column, token_output: Column, price_in: Column, price_out: Column) -> Column:
    """Cost by prices per million tokens, six places."""
    return F.round((token_input * price_in + token_output * price_out) / 1_000_000, 6)
