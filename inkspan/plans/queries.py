"""One query per operator over the driver's tables, each with the same question in DuckDB SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkspan.functions import dates, text
from inkspan.operators import evaluation, evidence, interview, listing, matching, retrieval, rules, spans, usage
from inkspan.plans.bindings import calls, lines, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


CALLS = """calls AS (SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'structure' WHEN 'click' THEN 'match' WHEN 'error' THEN 'diagnose' WHEN 'purchase' THEN 'interview_ask' WHEN 'signup' THEN 'rerank' END AS scene,
 CASE WHEN user_id % 2 = 0 THEN 'resume' ELSE 'session' END AS ref_type, user_id AS ref_id, CASE WHEN event_id % 7 = 0 THEN 'run' END AS run_id,
 CAST(json_extract(props, '$.k') AS INTEGER) AS token_input, CAST(json_extract(props, '$.k') AS INTEGER) * 2 AS token_output, CAST(round(value, 2) AS DECIMAL(10,6)) AS cost,
 event_type = 'view' AS cache_hit, event_type <> 'error' AS success,
 CASE WHEN event_type = 'error' THEN 'Error code: ' || (['401','402','404','429','500','400'])[CAST(event_id % 6 + 1 AS INTEGER)] || ' sk-abcdefgh12345' END AS error_msg, ts AS created_at FROM events)"""
FEATURE = "CASE WHEN scene IN ('structure','section') THEN 'parse' WHEN scene = 'jd_parse' THEN 'jd' WHEN scene = 'diagnose' THEN 'diagnose' WHEN scene = 'match' THEN 'match' WHEN scene IN ('rewrite','gap') THEN 'advice' WHEN scene IN ('embed','rerank') OR scene LIKE 'interview%' THEN 'interview' ELSE 'other' END"
SUMS = "CAST(count(*) AS BIGINT) AS calls, CAST(count(*) FILTER (cache_hit) AS BIGINT) AS cached, CAST(count(*) FILTER (NOT success) AS BIGINT) AS failed, CAST(sum(token_input) AS BIGINT) AS token_input, CAST(sum(token_output) AS BIGINT) AS token_output, CAST(sum(cost) AS DECIMAL(20,6)) AS cost"
USER = "run_id IS NULL AND ref_id IS NOT NULL"
SEVERITY = "CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END"


# usage analytics


@query(f"WITH {CALLS} SELECT strftime(created_at, '%Y-%m-%d') AS day, scene, ref_type, ref_id, {SUMS} FROM calls WHERE {USER} GROUP BY ALL")
def agg_usage_base(spark: SparkSession, d: str) -> DataFrame:
    return usage.grouped(calls(spark, d)).withColumn("day", F.col("day").cast("string"))


@query(f"""WITH {CALLS}, days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2023-12-28', TIMESTAMP '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS day),
 got AS (SELECT CAST(created_at AS DATE) AS day, {SUMS} FROM calls WHERE {USER} AND created_at >= TIMESTAMP '2023-12-28' AND created_at < TIMESTAMP '2024-02-03' GROUP BY 1)
 SELECT CAST(day AS VARCHAR) AS day, coalesce(calls,0) AS calls, coalesce(cached,0) AS cached, coalesce(failed,0) AS failed, coalesce(token_input,0) AS token_input, coalesce(token_output,0) AS token_output, coalesce(cost,0) AS cost FROM days LEFT JOIN got USING (day)""")
def agg_usage_day(spark: SparkSession, d: str) -> DataFrame:
    return usage.by_day(usage.grouped(usage.in_days(calls(spark, d), "2023-12-28", "2024-02-02")), "2023-12-28", "2024-02-02").withColumn("day", F.col("day").cast("string"))


@query(f"""WITH {CALLS}, dim(ordinal, feature) AS (VALUES (0,'parse'),(1,'jd'),(2,'diagnose'),(3,'match'),(4,'advice'),(5,'interview'),(6,'other')), got AS (SELECT {FEATURE} AS feature, {SUMS} FROM calls WHERE {USER} GROUP BY 1)
 SELECT feature, CAST(ordinal AS INTEGER) AS ordinal, coalesce(calls,0) AS calls, coalesce(cached,0) AS cached, coalesce(failed,0) AS failed, coalesce(token_input,0) AS token_input, coalesce(token_output,0) AS token_output, coalesce(cost,0) AS cost FROM dim LEFT JOIN got USING (feature) WHERE feature <> 'other' OR calls > 0""")
def agg_usage_feature(spark: SparkSession, d: str) -> DataFrame:
    return usage.by_feature(usage.grouped(calls(spark, d)))


OWNERS = "owners AS (SELECT 'resume' AS ref_type, c_custkey AS ref_id, CAST(c_nationkey AS BIGINT) AS user_id FROM customer UNION ALL SELECT 'session', s_suppkey, CAST(s_nationkey AS BIGINT) FROM supplier)"


def _owners(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.lit("resume").alias("ref_type"), F.col("c_custkey").alias("ref_id"), F.col("c_nationkey").cast("long").alias("user_id"))
    s = table(spark, d, "supplier").select(F.lit("session").alias("ref_type"), F.col("s_suppkey").alias("ref_id"), F.col("s_nationkey").cast("long").alias("user_id"))
    return usage.owners_of(c, s)


@query(f"""WITH {CALLS}, {OWNERS}, got AS (SELECT user_id, {SUMS}, max(CAST(created_at AS DATE)) AS last_used FROM calls LEFT JOIN owners USING (ref_type, ref_id) WHERE {USER} GROUP BY 1)
 SELECT * REPLACE (coalesce(user_id, -1) AS user_id, CAST(last_used AS VARCHAR) AS last_used), CAST(row_number() OVER (ORDER BY user_id IS NULL, cost DESC, user_id) AS INTEGER) AS rank FROM got""")
def agg_usage_user(spark: SparkSession, d: str) -> DataFrame:
    got = usage.by_user(usage.grouped(calls(spark, d)), _owners(spark, d))
    return got.withColumns({"user_id": F.coalesce("user_id", F.lit(-1).cast("long")), "last_used": F.col("last_used").cast("string")})


@query(f"WITH {CALLS}, {OWNERS} SELECT id, coalesce(user_id, -1) AS user_id FROM calls LEFT JOIN owners USING (ref_type, ref_id)")
def join_owner(spark: SparkSession, d: str) -> DataFrame:
    return calls(spark, d).join(_owners(spark, d), ["ref_type", "ref_id"], "left").select("id", F.coalesce("user_id", F.lit(-1).cast("long")).alias("user_id"))


@query(f"""WITH {CALLS} SELECT * FROM (SELECT {SUMS} FROM calls WHERE {USER} AND CAST(created_at AS DATE) = DATE '2024-01-05'), (SELECT CAST(sum(cost) AS DECIMAL(20,6)) AS window_cost FROM calls WHERE {USER}),
 (SELECT CAST(count(*) AS BIGINT) AS other_calls, CAST(coalesce(sum(cost),0) AS DECIMAL(20,6)) AS other_cost FROM calls WHERE NOT ({USER})), (SELECT count(*) AS registered FROM customer WHERE c_mktsegment = 'BUILDING')""")
def agg_usage_day_filter(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer").select(F.when(F.col("c_mktsegment") == "BUILDING", "seeker").otherwise("admin").alias("role"))
    return usage.usage_report(calls(spark, d), users, "2024-01-01", "2024-01-31", "2024-01-05")


@query("SELECT CAST(least(coalesce(CAST(min(ts) AS DATE), DATE '2024-06-01'), DATE '2024-06-01') AS VARCHAR) AS first_day FROM events")
def agg_first_day(spark: SparkSession, d: str) -> DataFrame:
    return usage.first_day(calls(spark, d), F.lit("2024-06-01").cast("date")).select(F.col("first_day").cast("string").alias("first_day"))


@query(f"WITH {CALLS} SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(cost) AS DECIMAL(20,6)) AS cost FROM calls WHERE run_id IS NOT NULL OR ref_id IS NULL")
def agg_other(spark: SparkSession, d: str) -> DataFrame:
    return usage.other_calls(calls(spark, d)).agg(F.count("*").alias("n"), F.sum("cost").cast("decimal(20,6)").alias("cost"))


@query(f"WITH {CALLS} SELECT id, scene FROM calls WHERE {USER} AND created_at >= TIMESTAMP '2024-01-03' AND created_at < TIMESTAMP '2024-01-06'")
def flt_time_range(spark: SparkSession, d: str) -> DataFrame:
    return usage.in_days(usage.user_calls(calls(spark, d)), "2024-01-03", "2024-01-05").select("id", "scene")


@query(f"WITH {CALLS} SELECT id, {FEATURE} AS feature FROM calls")
def case_feature(spark: SparkSession, d: str) -> DataFrame:
    return calls(spark, d).select("id", usage.feature_of(F.col("scene")).alias("feature"))


REASON = "CASE regexp_extract(error_msg, 'Error code: (\\d{3})', 1) WHEN '402' THEN '余额不足（402）' WHEN '401' THEN '密钥无效（401）' WHEN '429' THEN '请求太快，被服务商限流（429）' WHEN '404' THEN '接口地址或模型名不对（404）' WHEN '500' THEN '模型服务自己出错了（500）' WHEN '400' THEN '请求被拒绝（400），多半是模型名不对' ELSE '其他错误' END"


@query(f"WITH {CALLS} SELECT id, {REASON} AS reason FROM calls")
def case_failure_reason(spark: SparkSession, d: str) -> DataFrame:
    return calls(spark, d).select("id", usage.failure_reason(F.col("error_msg")).alias("reason"))


@query(f"WITH {CALLS} SELECT id, created_at, scene, {REASON} AS reason, regexp_replace(error_msg, 'sk-[A-Za-z0-9_\\-]{{8,}}', 'sk-***', 'g') AS error_msg FROM calls WHERE {USER} AND NOT success ORDER BY created_at DESC, id DESC LIMIT 20")
def top_failures(spark: SparkSession, d: str) -> DataFrame:
    return usage.recent_failures(calls(spark, d))


@query("SELECT event_id, CAST(round((k * 12.0 + 2 * k * 24.0) / 1000000, 6) AS DECIMAL(12,6)) AS cost FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)")
def agg_estimate_cost(spark: SparkSession, d: str) -> DataFrame:
    c = calls(spark, d)
    return c.select(F.col("id").alias("event_id"), usage.call_cost(F.col("token_input"), F.col("token_output"), F.lit(12.0), F.lit(24.0)).cast("decimal(12,6)").alias("cost"))


# lists


@query("SELECT o_orderkey, c_name, n_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def join_apply_list(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_name", "n_name", "o_totalprice")


@query("SELECT c_custkey, count(o_orderkey) AS applies FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def join_apply_count(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return listing.count_children(table(spark, d, "customer").select("c_custkey"), o, "c_custkey", "applies")


@query("SELECT c_custkey, coalesce((SELECT string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey DESC) FROM orders WHERE o_custkey = c_custkey), '') AS children FROM customer")
def join_children(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    got = listing.attach_children(table(spark, d, "customer").select("c_custkey"), o, "c_custkey", "o_orderkey", "kids", ["o_orderstatus"])
    return got.select("c_custkey", F.array_join(F.transform("kids", lambda k: k["o_orderkey"].cast("string")), ",").alias("children"))


@query("SELECT o_custkey, count(*) AS applies, count(DISTINCT o_orderstatus) AS resumes FROM orders GROUP BY 1")
def join_activity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("applies"), F.count_distinct("o_orderstatus").alias("resumes"))


@query("SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40")
def srt_page(spark: SparkSession, d: str) -> DataFrame:
    return listing.page(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), 3, 20, F.col("o_orderdate").desc(), F.col("o_orderkey").desc())


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def case_latest_final(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("resume_id"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("running").alias("status"))
    return listing.latest_final(o).select(F.col("resume_id").alias("o_custkey"), F.col("id").alias("o_orderkey"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'F' THEN 'finished' ELSE 'failed' END AS stage FROM orders")
def case_stage(spark: SparkSession, d: str) -> DataFrame:
    status = F.element_at(F.create_map(F.lit("P"), F.lit("running"), F.lit("F"), F.lit("done"), F.lit("O"), F.lit("failed")), F.col("o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", listing.stage_of(status).alias("stage"))


def _findings(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as findings of an order."""
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("report_id"), F.struct("l_partkey", "l_suppkey", "l_linenumber").alias("finding_id"), "l_partkey", "l_suppkey", "l_linenumber",
        F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "A", "medium").otherwise("low").alias("severity"),
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity").cast("int")).alias("char_start"), F.when(F.col("l_linestatus") == "F", "failed").otherwise("exact").alias("verify_result"),
    )


@query(f"""SELECT l_orderkey AS report_id, l_partkey, l_suppkey, l_linenumber, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {SEVERITY}, CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_quantity AS INTEGER) END NULLS LAST, l_partkey, l_suppkey, l_linenumber) AS rank
 FROM lineitem WHERE l_linestatus <> 'F') WHERE rank <= 2""")
def top_issues(spark: SparkSession, d: str) -> DataFrame:
    return listing.top_issues(_findings(spark, d), "report_id", 2).select("report_id", "l_partkey", "l_suppkey", "l_linenumber", "rank")


@query("SELECT count(*) AS n FROM lineitem WHERE l_linestatus <> 'F'")
def flt_visible_findings(spark: SparkSession, d: str) -> DataFrame:
    return listing.visible_findings(_findings(spark, d)).agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND c_acctbal >= 0 OR c_mktsegment = 'MACHINERY' AND c_acctbal >= 0")
def flt_visible_jobs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("user_id"), (F.col("c_mktsegment") == "MACHINERY").alias("is_template"), (F.col("c_acctbal") < 0).alias("is_deleted"))
    return listing.visible_jobs(c, 3).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5)")
def flt_in_list(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer").filter("c_nationkey = 5")
    return o.join(c, o.o_custkey == c.c_custkey, "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 100000)")
def join_semi_used(spark: SparkSession, d: str) -> DataFrame:
    """Customers without a large urgent order."""
    return listing.unused(table(spark, d, "customer"), table(spark, d, "orders").filter("o_orderpriority = '1-URGENT' AND o_totalprice > 100000"), "c_custkey", "o_custkey").select("c_custkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def set_dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    return listing.dedupe_first(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT DISTINCT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT ALL SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal < 0")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).exceptAll(table(spark, d, "supplier").filter("s_acctbal < 0").select("s_nationkey").distinct())


@query("SELECT 'c' AS src, c_custkey AS k FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 's', s_suppkey FROM supplier WHERE s_acctbal < 0")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").filter("c_acctbal < 0").select(F.lit("c").alias("src"), F.col("c_custkey").alias("k"))
    return c.unionByName(table(spark, d, "supplier").filter("s_acctbal < 0").select(F.lit("s").alias("src"), F.col("s_suppkey").alias("k")))


# matching and interview scores on order lines

_VALUE = "CASE l_returnflag WHEN 'R' THEN 1.0 WHEN 'A' THEN 0.5 ELSE 0.0 END"
_CATEGORY = "CASE l_linenumber % 4 WHEN 0 THEN 'skill' WHEN 1 THEN 'education' WHEN 2 THEN 'experience' ELSE 'other' END"


def _category() -> Column:
    n = F.col("l_linenumber") % 4
    return F.when(n == 0, "skill").when(n == 1, "education").when(n == 2, "experience").otherwise("other")


def _requirements(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, d, "lineitem").withColumn("rid", F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber")).dropDuplicates(["l_orderkey", "rid"])
    r = li.select(F.col("l_orderkey").alias("report_id"), F.col("rid").alias("requirement_id"), _category().alias("category"), F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.5).alias("weight"))
    i = li.filter("l_returnflag != 'N'").select(F.col("l_orderkey").alias("report_id"), F.col("rid").alias("requirement_id"), F.when(F.col("l_returnflag") == "R", "hit").otherwise("partial").alias("status"))
    return r, i


_SCORE = "CAST(format('{{:.1f}}', 100 * sum(w * v) FILTER ({c}) / nullif(sum(w) FILTER ({c}), 0)) AS DECIMAL(6,1))"
_LINES = f"(SELECT l_orderkey AS report_id, l_partkey, l_suppkey, l_linenumber, {_CATEGORY} AS category, CASE l_linestatus WHEN 'F' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS w, CAST({_VALUE} AS DOUBLE) AS v FROM (SELECT DISTINCT ON (l_orderkey, l_partkey, l_suppkey, l_linenumber) * FROM lineitem))"


@query(f"SELECT report_id, {_SCORE.format(c='true')} AS overall, {', '.join(_SCORE.format(c=f'category = {chr(39)}{x}{chr(39)}') + ' AS ' + x for x in matching.CATEGORIES)}, coalesce(round(100 * sum(w * v) / nullif(sum(w), 0), 1) >= 60, false) AS passed FROM {_LINES} GROUP BY 1")
def agg_match_score(spark: SparkSession, d: str) -> DataFrame:
    got = matching.gate(matching.score_matches(*_requirements(spark, d)))
    return got.withColumns({c: F.col(c).cast("decimal(6,1)") for c in ("overall", *matching.CATEGORIES)})


@query("SELECT l_orderkey AS session_id, l_linenumber AS topic_idx, CAST(round_even(sum(q * w) / sum(w), 0) AS INTEGER) AS topic_score FROM (SELECT *, l_quantity * 2 AS q, CASE l_returnflag WHEN 'A' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM lineitem) GROUP BY 1, 2")
def agg_topic_score(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("topic_idx"), (F.col("l_quantity") * 2).alias("score"), (F.col("l_returnflag") == "A").alias("low_evidence"))
    return interview.topic_scores(t)


@query("SELECT o_orderkey AS session_id, CASE WHEN o_orderpriority = '5-LOW' THEN 'practice' WHEN o_orderstatus = 'P' THEN 'incomplete' WHEN o_totalprice >= 200000 THEN 'pass' ELSE 'fail' END AS verdict FROM orders")
def iv_verdict(spark: SparkSession, d: str) -> DataFrame:
    mode = F.when(F.col("o_orderpriority") == "5-LOW", "practice").otherwise("real")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"), interview.verdict(mode, F.col("o_totalprice"), F.lit(200000), F.col("o_orderstatus") != "P").alias("verdict"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY 1")
def win_last_turn(spark: SparkSession, d: str) -> DataFrame:
    return interview.last_turns(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS turn_no FROM conversations")
def win_turn_no(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("turn_no"))


@query("""SELECT conv_id, turn // 4 AS topic, string_agg('面试官：' || role || chr(10) || '候选人：' || CASE WHEN coalesce(text, '') = '' THEN '（没有回答）' ELSE text END, chr(10) ORDER BY turn)
 || CASE WHEN max(turn) % 2 = 0 THEN chr(10) || '（评分员认为上一答的不足：' || 'short' || CAST(max(turn) AS VARCHAR) || '）' ELSE '' END AS history FROM conversations GROUP BY 1, 2""")
def ctx_ask_history(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    bad = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("short"), F.col("turn").cast("string")))
    turns = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_no"), F.floor(F.col("turn") / 4).alias("topic_idx"), F.col("role").alias("question"), F.col("text").alias("answer"), bad.alias("bad"))
    got = interview.ask_history(turns, turns.select("session_id", "topic_idx").distinct())
    return got.select(F.col("session_id").alias("conv_id"), F.col("topic_idx").alias("topic"), "history")


# texts: lines, offsets, tests on lines

LINES = "ls AS (SELECT doc_id, CAST(unnest(range(0, len(string_split(text, chr(10))))) AS INTEGER) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"
OFFSETS = f"{LINES}, offs AS (SELECT doc_id, line_no, line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS char_start FROM ls)"


@query(f"WITH {OFFSETS} SELECT doc_id, line_no, char_start, CAST(char_start + length(line) AS INTEGER) AS char_end, md5(line) AS line_md5 FROM offs")
def win_offsets(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("doc_id", "line_no", F.col("char_start").cast("int").alias("char_start"), F.col("char_end").cast("int").alias("char_end"), F.md5(F.col("line").cast("binary")).alias("line_md5"))


@query(f"WITH {OFFSETS} SELECT doc_id, p AS at, arg_max(line_no, char_start) AS line_no FROM (SELECT doc_id, CAST(n_chars // 2 AS INTEGER) AS p FROM documents) q JOIN offs USING (doc_id) WHERE char_start <= p GROUP BY 1, 2")
def join_block_locate(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "documents").select("doc_id", F.floor(F.col("n_chars") / 2).cast("int").alias("at"))
    return spans.locate_blocks(points, lines(spark, d), "doc_id", "at", "char_start", ["line_no"]).select("doc_id", "at", F.col("block_line_no").alias("line_no"))


NUMBER_SQL = "(?:^|[^A-Za-z0-9.#+\\-])[0-9]+"


@query(f"WITH {LINES} SELECT doc_id, line_no FROM ls WHERE regexp_matches(line, '{NUMBER_SQL}') AND NOT regexp_matches(line, '^(?:[•·▪■◆●○◦*➢➤►▶✓☑–—-]|[0-9]{{1,2}}[.、)）]|[（(][0-9]{{1,2}}[)）]|[①-⑩])')")
def str_has_number(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).filter(text.has_number(F.col("line")) & ~text.is_bullet(F.col("line"))).select("doc_id", F.col("line_no").cast("int").alias("line_no"))


@query(f"WITH {LINES} SELECT doc_id, line_no FROM ls WHERE length(line) > 120 OR length(line) < 8")
def rule_LENGTH_ANOMALY(spark: SparkSession, d: str) -> DataFrame:  # noqa: N802
    units = lines(spark, d).select(F.col("doc_id").alias("resume_id"), F.col("line_no").cast("string").alias("unit_id"), F.lit("work").alias("unit_type"), "char_start", "char_end", F.col("line").alias("text"))
    return rules.length_anomaly(units).select(F.col("resume_id").alias("doc_id"), F.col("unit_id").cast("int").alias("line_no"))


RESULTS, WEAK = "thought|with|from|avec|para|nicht", "The|And|Les|Der"


@query(f"WITH {LINES} SELECT doc_id, line_no FROM ls WHERE regexp_matches(line, '{RESULTS}') AND NOT regexp_matches(regexp_replace(line, '^(?:[*•-]|[0-9]{{1,2}}[.)])', ' '), '{NUMBER_SQL}')")
def rule_NO_QUANTIFICATION(spark: SparkSession, d: str) -> DataFrame:  # noqa: N802
    units = _units(spark, d)
    return rules.no_quantification(units, RESULTS).select(F.col("resume_id").alias("doc_id"), F.col("unit_id").cast("int").alias("line_no"))


def _units(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select(F.col("doc_id").alias("resume_id"), F.col("line_no").cast("string").alias("unit_id"), F.lit("work").alias("unit_type"), "char_start", "char_end", F.col("line").alias("text"))


@query(f"WITH {LINES} SELECT doc_id, line_no FROM ls WHERE NOT regexp_matches(line, '{RESULTS}') AND NOT regexp_matches(regexp_replace(line, '^(?:[*•-]|[0-9]{{1,2}}[.)])', ' '), '{NUMBER_SQL}')")
def rule_STAR_INCOMPLETE(spark: SparkSession, d: str) -> DataFrame:  # noqa: N802
    return rules.star_incomplete(_units(spark, d), RESULTS).select(F.col("resume_id").alias("doc_id"), F.col("unit_id").cast("int").alias("line_no"))


@query(f"WITH {OFFSETS} SELECT doc_id, line_no, CAST(char_start + length(line) - length(regexp_replace(line, '^[*•-]?\\s*', '')) AS INTEGER) AS char_start FROM offs WHERE regexp_matches(line, '^[*•-]?\\s*(?:{WEAK})')")
def rule_WEAK_VERB(spark: SparkSession, d: str) -> DataFrame:  # noqa: N802
    return rules.weak_verb(_units(spark, d), WEAK).select(F.col("resume_id").alias("doc_id"), F.col("unit_id").cast("int").alias("line_no"), "char_start")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    units = _units(spark, d)
    found = rules.length_anomaly(units).unionByName(rules.no_quantification(units, RESULTS)).unionByName(rules.star_incomplete(units, RESULTS)).unionByName(rules.weak_verb(units, WEAK))
    n = units.groupBy("resume_id").agg(F.count("*").alias("unit_count"))
    return rules.score_findings(found, n, "rule_only")


_NO_NUMBER = f"NOT regexp_matches(regexp_replace(line, '^(?:[*•-]|[0-9]{{1,2}}[.)])', ' '), '{NUMBER_SQL}')"
_PENALTIES = f"""{LINES}, n AS (SELECT doc_id, count(*) AS unit_count,
 sum(CASE WHEN length(line) > 120 OR length(line) < 8 THEN 5 ELSE 0 END + CASE WHEN regexp_matches(line, '^[*•-]?\\s*(?:{WEAK})') THEN 5 ELSE 0 END) AS e,
 sum(CASE WHEN regexp_matches(line, '{RESULTS}') AND {_NO_NUMBER} THEN 25 ELSE 0 END) AS q, sum(CASE WHEN NOT regexp_matches(line, '{RESULTS}') AND {_NO_NUMBER} THEN 12 ELSE 0 END) AS c FROM ls GROUP BY 1),
 s AS (SELECT doc_id, unit_count, {", ".join(f"CAST(format('{{:.1f}}', greatest(0.0::DOUBLE, 100 - {x} * (4.0::DOUBLE / greatest(unit_count, 4)))) AS DOUBLE) AS {name}" for x, name in (("c", "completeness"), ("q", "quantification"), ("e", "expression")))} FROM n)"""


@query(f"WITH {_PENALTIES} SELECT doc_id, CAST(expression AS DECIMAL(5,1)) AS expression, CAST(quantification AS DECIMAL(5,1)) AS quantification FROM s")
def agg_diag_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select(F.col("resume_id").alias("doc_id"), F.col("expression").cast("decimal(5,1)").alias("expression"), F.col("quantification").cast("decimal(5,1)").alias("quantification"))


@query("SELECT doc_id, md5(translate(text, chr(10) || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ' abcdefghijklmnopqrstuvwxyz')) AS norm_md5 FROM documents")
def str_norm_match(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalize_for_match(F.col("text")).cast("binary")).alias("norm_md5"))


@query("SELECT doc_id, length(regexp_replace(text, '\\s+', '', 'g')) AS n FROM documents")
def str_squash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.length(text.squash(F.col("text"))).cast("long").alias("n"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def str_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"))


@query("SELECT doc_id, sha256(text) AS hash, (SELECT max(b.doc_id) FROM documents b WHERE b.source = a.source AND b.text = a.text) AS duplicate_of FROM documents a")
def src_dedup(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", F.col("source").alias("user_id"), F.sha2("text", 256).alias("file_hash"))
    stored = x.select(F.col("doc_id").alias("id"), "user_id", "file_hash", F.lit(False).alias("is_deleted"))
    return listing.find_duplicates(x, stored).select("doc_id", F.col("file_hash").alias("hash"), "duplicate_of")


@query("SELECT item_id, doc_id, CAST(strpos(d, q) - 1 AS BIGINT) AS char_start FROM (SELECT item_id, translate(text, chr(10) || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ' abcdefghijklmnopqrstuvwxyz') AS q0, rtrim(ltrim(q0, ' .'), ' .') AS q FROM benchmark), (SELECT doc_id, translate(text, chr(10) || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ' abcdefghijklmnopqrstuvwxyz') AS d FROM documents) WHERE contains(d, q)")
def ev_locate(spark: SparkSession, d: str) -> DataFrame:
    return evidence.locate_in_corpus(table(spark, d, "benchmark"), table(spark, d, "documents")).select("item_id", "doc_id", "char_start")


# intervals, vectors, evaluation


@query("SELECT o_custkey, CAST(min(a) AS BIGINT) AS a, CAST(max(b) AS BIGINT) AS b FROM (SELECT *, sum(opens) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER (PARTITION BY o_custkey ORDER BY a, b) = 1 THEN 1 ELSE 0 END AS opens FROM (SELECT o_custkey, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS a, a + 30 + o_orderkey % 60 AS b FROM orders))) GROUP BY o_custkey, island")
def win_interval_merge(spark: SparkSession, d: str) -> DataFrame:
    a = F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).cast("long")
    o = table(spark, d, "orders").select("o_custkey", a.alias("a"), (a + 30 + F.col("o_orderkey") % 60).alias("b"))
    return spans.merged_intervals(o, "o_custkey", "a", "b")


_MONTH = "year(o_orderdate) * 12 + month(o_orderdate)"


@query(f"SELECT o_custkey AS report_id, CAST(count(DISTINCT m) AS INTEGER) AS months FROM (SELECT o_custkey, unnest(range({_MONTH}, {_MONTH} + 3 + o_orderkey % 9)) AS m FROM orders) GROUP BY 1")
def agg_exp_years(spark: SparkSession, d: str) -> DataFrame:
    m = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("report_id"), F.struct(m.alias("start"), (m + 3 + F.col("o_orderkey") % 9).cast("int").alias("end")).alias("s"))
    return o.groupBy("report_id").agg(dates.covered_months(F.collect_list("s")).alias("months"))


@query(f"SELECT o_custkey, o_orderkey, CAST(gap AS INTEGER) AS gap FROM (SELECT o_custkey, o_orderkey, {_MONTH} - lag({_MONTH} + 2) OVER (PARTITION BY o_custkey ORDER BY {_MONTH}, o_orderkey) AS gap FROM orders) WHERE gap < 0 OR gap > 3")
def rule_TIMELINE_ANOMALY(spark: SparkSession, d: str) -> DataFrame:  # noqa: N802
    end = F.date_format(F.add_months(F.to_date("o_orderdate"), 2), "yyyy-MM")
    work = table(spark, d, "orders").select(F.col("o_custkey").alias("resume_id"), F.col("o_orderkey").alias("ordinal"), F.lit("work").alias("kind"), F.date_format("o_orderdate", "yyyy-MM").alias("start"), end.alias("end"), F.lit(False).alias("is_present"), F.col("o_orderkey").cast("int").alias("char_start"), F.lit(0).alias("char_end"))
    return rules.timeline_anomaly(work, "2024-01-01").select(F.col("resume_id").alias("o_custkey"), F.col("char_start").cast("long").alias("o_orderkey"), F.col("detail").cast("int").alias("gap"))


@query("SELECT a.vec_id AS query_id, b.vec_id AS idx, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS INTEGER) AS rank FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 20 = 0 QUALIFY rank <= 3")
def top_recall(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("label").alias("session_id"), F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.recall(q, e.select(F.col("label").alias("session_id"), F.col("vec_id").alias("idx"), "embedding"), n=3).select("query_id", "idx", "rank")


@query("SELECT source AS kind, count(*) AS n, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS agreed FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (source)")
def agg_eval_match(spark: SparkSession, d: str) -> DataFrame:
    truth = table(spark, d, "documents").select("doc_id", F.col("source").alias("kind"), F.lit(1).alias("status"))
    got = evaluation.agreement(truth, table(spark, d, "labels").select("doc_id", F.col("quality").alias("status")), "kind")
    return got.select("kind", "n", F.round(F.col("agreement") * F.col("n")).cast("long").alias("agreed"))


@query("SELECT event_type AS name, count(*) AS n, CAST(round(quantile_cont(value, 0.5), 4) AS DECIMAL(12,4)) AS p50, CAST(round(quantile_cont(value, 0.95), 4) AS DECIMAL(12,4)) AS p95, CAST(max(value) AS DECIMAL(12,4)) AS max FROM events GROUP BY 1")
def agg_loadtest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("name"), F.col("value").alias("latency_ms"), "ts", F.lit(True).alias("ok"))
    got = evaluation.load_figures(e)
    return got.select("name", "n", *[F.round(c, 4).cast("decimal(12,4)").alias(c) for c in ("p50", "p95")], F.col("max").cast("decimal(12,4)").alias("max"))


@query("SELECT lang, CAST(min(n_chars) FILTER (run > total // 2) AS BIGINT) AS median FROM (SELECT lang, n_chars, sum(sum(n_chars)) OVER (PARTITION BY lang ORDER BY n_chars) AS run, sum(sum(n_chars)) OVER (PARTITION BY lang) AS total FROM documents GROUP BY lang, n_chars) GROUP BY 1")
def agg_weighted_median_font(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.median_by_weight(table(spark, d, "documents"), "lang", F.col("n_chars"), F.col("n_chars"))


@query("SELECT event_type AS key, time_bucket(INTERVAL 1 MINUTE, ts) AS minute, count(*) AS calls FROM events GROUP BY 1, 2")
def st_ratelimit(spark: SparkSession, d: str) -> DataFrame:
    from inkspan.streaming.operators import rate_windows

    e = table(spark, d, "events").select(F.col("event_type").alias("provider"), F.col("ts").cast("timestamp").alias("ts"))
    return rate_windows(e).select(F.col("provider").alias("key"), F.col("minute").cast("timestamp_ntz").alias("minute"), "calls")


@query("SELECT user_id, min(ts) AS started_at, max(ts) AS last_active_at, count(*) AS n FROM (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS opens FROM events)) GROUP BY user_id, s")
def st_idle_close(spark: SparkSession, d: str) -> DataFrame:
    from inkspan.streaming.operators import idle_sessions

    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    got = idle_sessions(e, "user_id", "6 hours")
    return got.select("user_id", F.col("started_at").cast("timestamp_ntz").alias("started_at"), F.col("last_active_at").cast("timestamp_ntz").alias("last_active_at"), "n")


_ALL = sum(rules.WEIGHTS.values())
_OVERALL = f"((((0.0::DOUBLE + completeness * 0.25::DOUBLE) + quantification * 0.25::DOUBLE) + expression * 0.2::DOUBLE) + 100.0::DOUBLE * 0.2::DOUBLE + 100.0::DOUBLE * 0.1::DOUBLE) / {_ALL!r}::DOUBLE"


@query(f"""WITH {_PENALTIES} SELECT doc_id AS resume_id, unit_count, {", ".join(f"CAST({x} AS DECIMAL(5,1)) AS {x}" for x in ("completeness", "quantification", "expression"))}, CAST(100 AS DECIMAL(5,1)) AS consistency, CAST(100 AS DECIMAL(5,1)) AS ats,
 CAST(format('{{:.1f}}', {_OVERALL}) AS DECIMAL(5,1)) AS overall FROM s""")
def flagship_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    """documents -> lines with offsets -> rule findings with evidence -> score per document."""
    return _scored(spark, d).select("resume_id", "unit_count", *[F.col(c).cast("decimal(5,1)").alias(c) for c in (*rules.CATEGORIES, "overall")])


_FULL = "acc.buf <> '' AND length(acc.buf) + length(p.buf) + 1 > 500"
_BUF = f"CASE WHEN acc.buf = '' OR {_FULL} THEN p.buf ELSE acc.buf || chr(10) || p.buf END"
_EXTRA = f"CAST(greatest(0, ceil((length({_BUF}) - 500) / 420)) AS INTEGER)"


@query(f"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '\\n(\\s*(?:[0-9]+[.、)]|[-*•]|【|#))', chr(1) || '\\1', 'g'), '\\n\\s*\\n|\\x01'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ps FROM documents WHERE text IS NOT NULL),
 r AS (SELECT doc_id, list_reduce(list_transform(ps, lambda x: {{'done': []::VARCHAR[], 'buf': x}}), lambda acc, p: {{'done': list_concat(CASE WHEN {_FULL} THEN list_append(acc.done, acc.buf) ELSE acc.done END, list_transform(range(0, {_EXTRA}), lambda k: substr({_BUF}, k * 420 + 1, 500))), 'buf': substr({_BUF}, {_EXTRA} * 420 + 1)}}, {{'done': []::VARCHAR[], 'buf': ''}}) AS r FROM p),
 c AS (SELECT doc_id, CASE WHEN r.buf <> '' THEN list_append(r.done, r.buf) ELSE r.done END AS cs FROM r)
 SELECT doc_id, CAST(unnest(range(0, len(cs))) AS INTEGER) AS idx, unnest(cs) AS chunk FROM c""")
def str_chunk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(retrieval.chunk(F.col("text"))).alias("idx", "chunk"))
