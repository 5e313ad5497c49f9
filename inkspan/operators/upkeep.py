"""Upkeep of stored tables: interrupted tasks, counters and items written back, item updates, clones and removals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.operators.rules import RESULT_WORDS, run_unit_rules

# Words that state a result in a direction beside the general ones.
OPS_WORDS = ("增加", "涨粉", "增粉", "新增", "转化率", "曝光量", "阅读量", "播放量", "完播率", "点赞量", "互动率", "打开率", "点击率", "留存率", "复购率", "成交额", "销量", "销售额", "GMV", "ROI", "报名人数")
FINANCE_WORDS = ("准确率", "差错率", "零差错", "回款率", "完成率", "收益率", "节税")
#: result words and switched-off rules by direction; an unknown direction is the first one
DIRECTIONS: dict[str, tuple[tuple[str, ...], frozenset[str]]] = {
    "cs": ((), frozenset()),
    "ops": (OPS_WORDS, frozenset()),
    "finance": (FINANCE_WORDS, frozenset()),
    "general": (OPS_WORDS + FINANCE_WORDS, frozenset()),
}
REQUIREMENT_FIELDS = ("content", "req_type", "category", "weight", "skill")


def direction_of(domain: Column) -> Column:
    return F.when(domain.isin(*DIRECTIONS), domain).otherwise("cs")


def run_rules_by_direction(units: DataFrame, directions: dict[str, tuple[tuple[str, ...], frozenset[str]]] = DIRECTIONS) -> DataFrame:
    """Unit rules, each unit under its own direction (column ``domain``); rules stay one pass per direction that differs."""
    out = None
    for key, (words, disabled) in directions.items():
        got = run_unit_rules(units.filter(direction_of(F.col("domain")) == key), disabled, words)
        out = got if out is None else out.unionByName(got)
    return out


def result_words(direction: str) -> str:
    """The pattern of words that state a result in a direction."""
    return "|".join([RESULT_WORDS, *DIRECTIONS.get(direction, DIRECTIONS["cs"])[0]])


def mark_interrupted(tasks: DataFrame, status: str = "status", error: str = "error_msg", running: tuple[str, ...] = ("pending", "running")) -> DataFrame:
    """Tasks that a stopped process left running are failed, with ``interrupted`` as their error."""
    open_ = F.coalesce(F.col(status).isin(*running), F.lit(False))
    return tasks.withColumns({error: F.when(open_, "interrupted").otherwise(F.col(error)), status: F.when(open_, "failed").otherwise(F.col(status))})


def activate(providers: DataFrame, provider_id: int) -> DataFrame:
    """At most one provider is active: the one with this id, or none where no row has it."""
    return providers.withColumn("is_active", F.col("id") == provider_id)


def over_active(providers: DataFrame, key: str) -> DataFrame:
    """Keys with more than one active provider, and how many."""
    return providers.groupBy(key).agg(F.count_if("is_active").alias("active")).filter("active > 1")


def clone_rows(rows: DataFrame, users: int, id_col: str = "id", prefix: str = "lt_") -> DataFrame:
    """Every row once for each of ``users`` temporary accounts: username, source_id, clone_id; no join is needed, as the
    accounts are a range."""
    numbers = F.explode(F.sequence(F.lit(0), F.lit(users - 1))) if users > 0 else F.explode(F.array().cast("array<int>"))
    d = rows.withColumn("_n", numbers)
    name = F.concat(F.lit(prefix), F.lpad(F.col("_n").cast("string"), F.greatest(F.length(F.col("_n").cast("string")), F.lit(3)), F.lit("0")))
    return d.select(name.alias("username"), F.col(id_col).alias("source_id"), F.concat_ws(":", name, F.col(id_col).cast("string")).alias("clone_id"))


def without_users(users: DataFrame, owned: DataFrame, prefix: str = "lt_") -> tuple[DataFrame, DataFrame]:
    """Users whose name lacks the prefix, and the rows of the others removed from a table with user_id."""
    gone = users.filter(F.col("username").startswith(prefix)).select(F.col("id").alias("user_id"))
    return users.filter(~F.coalesce(F.col("username").startswith(prefix), F.lit(False))), owned.join(gone, "user_id", "left_anti")


def replace_in_items(items: Column, wanted: Column, advice: Column) -> Column:
    """Items with the advice of the one whose requirement_id is wanted; the others stay as they are."""
    return F.transform(items, lambda x: F.when(x["requirement_id"] == wanted, x.withField("advice", advice)).otherwise(x))


def saved_advice(tasks: DataFrame, advice: DataFrame, key: str) -> DataFrame:
    """Tasks with the advice already stored for them where it has a text, else null: those are to be asked for."""
    kept = advice.filter("coalesce(text, '') != ''").select(key, F.col("text").alias("saved"))
    return tasks.join(kept, key, "left")


def diagnosis_direction(diagnoses: DataFrame, reports: DataFrame, jobs: DataFrame) -> DataFrame:
    """(diagnosis_id, domain): through the report with the smallest id to its job; the default where either is missing."""
    report = reports.filter("diagnosis_id IS NOT NULL").groupBy("diagnosis_id").agg(F.min_by("job_id", "report_id").alias("job_id"))
    d = diagnoses.select("diagnosis_id").join(report, "diagnosis_id", "left").join(jobs.select("job_id", "domain"), "job_id", "left")
    return d.select("diagnosis_id", direction_of(F.col("domain")).alias("domain"))


def usernames(rows: DataFrame, users: DataFrame) -> DataFrame:
    """Rows with the name of their user_id, null where there is no such user."""
    return rows.join(users.select(F.col("id").alias("user_id"), "username"), "user_id", "left")


def tokens_of(refs: DataFrame, calls: DataFrame) -> DataFrame:
    """refs (ref_type, ref_id) with the tokens of all their calls, 0 where there are none."""
    got = calls.groupBy("ref_type", "ref_id").agg(F.sum("token_input").alias("token_input"), F.sum("token_output").alias("token_output"))
    d = refs.join(got, ["ref_type", "ref_id"], "left")
    return d.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("token_input", "token_output")})


def report_items(items: DataFrame, requirements: DataFrame) -> DataFrame:
    """Match items with the fields of their requirement, so that a report outlives its job; one row per report, its items
    in the order of requirement_id. Fields are null where the requirement is gone."""
    own = [c for c in items.columns if c not in ("report_id", "job_id", *REQUIREMENT_FIELDS)]
    d = items.join(requirements.select("job_id", "requirement_id", *REQUIREMENT_FIELDS), ["job_id", "requirement_id"], "left")
    fields = ["requirement_id", *[c for c in own if c != "requirement_id"], *REQUIREMENT_FIELDS]
    return d.groupBy("report_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("items"))
