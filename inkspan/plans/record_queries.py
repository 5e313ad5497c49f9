"""Queries for structure, prompt texts, page lists and upkeep over the driver's tables, with DuckDB SQL.

Orders stand for jobs, reports and applications, line items for their items or findings, conversations for sessions or
sections, documents for résumés.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.functions import masking, replies
from inkspan.operators import context, evidence, interview, listing, matching, pages, sections, structure, upkeep
from inkspan.plans.bindings import calls, lines, table
from inkspan.plans.column_queries import _md5, _pick, _picked
from inkspan.plans.queries import CALLS, OFFSETS, query

ITEM = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem")


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# structure


@query(f"""WITH v AS (SELECT {ITEM}, list_filter([l_partkey % 12, l_suppkey % 12, l_linenumber], lambda x: x BETWEEN 3 AND 8) AS v FROM lineitem)
 SELECT {ITEM}, CASE WHEN len(v) > 0 THEN array_to_string(range(list_min(v), list_max(v) + 1), ',') ELSE 'none' END AS ids FROM v""")
def arr_block_span(spark: SparkSession, d: str) -> DataFrame:
    ids = F.array((F.col("l_partkey") % 12).cast("int"), (F.col("l_suppkey") % 12).cast("int"), F.col("l_linenumber").cast("int"))
    return _items(spark, d).select(*KEY, F.coalesce(F.array_join(structure.block_span(ids, F.lit(3), F.lit(8)), ","), F.lit("none")).alias("ids"))


@query("""WITH t AS (SELECT c_custkey, year(o_orderdate) AS y, month(o_orderdate) AS m, o_orderkey % 4 AS k, o_orderstatus, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey),
 b AS (SELECT c_custkey, n, CASE WHEN k = 0 THEN 'order ' || o_orderstatus WHEN k = 1 THEN y || '.' || m || '-' || (y + 1) || '.' || m || ' Team ' || o_orderstatus WHEN k = 2 THEN 'since ' || y || '.' || m || ' - 至今' ELSE o_orderstatus || ' ' || y || '-' || (y + 2) END AS line FROM t WHERE n <= 3),
 f AS (SELECT *, regexp_extract_all(line, '(19|20)[0-9]{2}') AS ys, regexp_extract_all(line, '(?:19|20)[0-9]{2}\\.([0-9]{1,2})', 1) AS ms FROM b WHERE regexp_matches(line, '(19|20)[0-9]{2}')),
 g AS (SELECT c_custkey, min(n) AS n FROM f GROUP BY 1)
 SELECT c.c_custkey, coalesce(ys[1] || coalesce('-' || lpad(ms[1], 2, '0'), '') || '/' || coalesce(ys[2] || coalesce('-' || lpad(ms[2], 2, '0'), ''), '') || '/' || CASE WHEN line LIKE '%至今%' THEN 'true' ELSE 'false' END, '//false') AS dates
 FROM (SELECT DISTINCT c_custkey FROM b) c LEFT JOIN g USING (c_custkey) LEFT JOIN f ON f.c_custkey = g.c_custkey AND f.n = g.n""")
def arr_dates_in_blocks(spark: SparkSession, d: str) -> DataFrame:
    """A customer's first three orders are the blocks of an entry."""
    from pyspark.sql import Window

    y, m, k, status = F.date_format("o_orderdate", "yyyy"), F.date_format("o_orderdate", "M"), F.col("o_orderkey") % 4, F.col("o_orderstatus")
    later = lambda n: (y.cast("int") + n).cast("string")
    line = F.when(k == 0, F.concat(F.lit("order "), status)).when(k == 1, F.concat(y, F.lit("."), m, F.lit("-"), later(1), F.lit("."), m, F.lit(" Team "), status)).when(k == 2, F.concat(F.lit("since "), y, F.lit("."), m, F.lit(" - 至今"))).otherwise(F.concat(status, F.lit(" "), y, F.lit("-"), later(2)))
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    b = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), n.alias("n"), line.alias("line")).filter("n <= 3")
    blocks = F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])
    got = b.groupBy("c_custkey").agg(blocks.alias("b")).select("c_custkey", structure.first_dates(F.col("b")).alias("f"))
    return got.select("c_custkey", F.concat_ws("/", F.coalesce("f.start", F.lit("")), F.coalesce("f.end", F.lit("")), _text("f.is_present")).alias("dates"))


@query(f"""WITH {OFFSETS}, m AS (SELECT doc_id, max(line_no) AS last FROM offs GROUP BY 1 HAVING max(line_no) >= 1), e AS (SELECT m.*, unnest([0, 1]) AS entry_no FROM m),
 p AS (SELECT *, list_filter(CASE entry_no WHEN 0 THEN [CAST(doc_id % 4 AS INTEGER), 2, 99] ELSE [3, 0] END, lambda x: x BETWEEN 1 AND last) AS v FROM e),
 s AS (SELECT doc_id, entry_no, last, list_min(v) AS lo, list_max(v) AS hi FROM p WHERE len(v) > 0)
 SELECT s.doc_id, entry_no, lo, hi, a.char_start, z.char_end, CASE WHEN last >= 2 THEN md5(h.line) ELSE '' END AS highlight
 FROM s JOIN (SELECT doc_id, line_no, char_start FROM offs) a ON a.doc_id = s.doc_id AND a.line_no = lo JOIN (SELECT doc_id, line_no, CAST(char_start + length(line) AS INTEGER) AS char_end FROM offs) z ON z.doc_id = s.doc_id AND z.line_no = hi
 LEFT JOIN offs h ON h.doc_id = s.doc_id AND h.line_no = 2""")
def struct_extract(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("resume_id"), F.col("text").alias("full_text"))
    blocks = lines(spark, d).select(F.col("doc_id").alias("resume_id"), F.col("line_no").cast("int").alias("block_index"), F.col("line").alias("text"), F.col("char_start").cast("int").alias("char_start"), F.col("char_end").cast("int").alias("char_end"))
    parts = docs.select("resume_id", F.lit(0).alias("section_id"), F.lit("work").alias("type"), F.lit("dict").alias("matched_by"), F.lit(0).alias("block_start"), (F.size(F.split("full_text", "\n", -1)) - 1).alias("block_end"))
    said = F.format_string('```json\n{"entries": [{"name": "a", "role": "b", "block_ids": [%d, 2, 99], "tech_stack": [" x ", ""], "highlights": [{"block_ids": [2]}, {"block_ids": [99]}]}, {"name": "c", "block_ids": [3, 0], "highlights": [{"block_ids": [2]}]}]}\n```', F.col("resume_id") % 4)
    answered = docs.select("resume_id", F.lit(0).alias("section_id"), said.alias("reply"))
    got = structure.extract_entries(answered, structure.section_blocks(parts, blocks), docs)
    return got.select(F.col("resume_id").alias("doc_id"), "entry_no", F.array_min("block_ids").alias("lo"), F.array_max("block_ids").alias("hi"), "char_start", "char_end", F.coalesce(_md5(F.get("highlights", F.lit(0))["text"]), F.lit("")).alias("highlight"))


# evidence


@query(f"""SELECT {ITEM}, CASE WHEN l_linenumber % 3 <> 0 AND l_quantity >= 10 AND l_quantity + 5 <= 40 THEN 'exact' ELSE 'failed' END AS verify_result, CASE WHEN l_linenumber % 3 <> 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS match_score,
 CASE WHEN l_linenumber % 3 <> 0 AND l_quantity >= 10 AND l_quantity + 5 <= 40 THEN CAST(l_quantity AS INTEGER) END AS char_start FROM lineitem""")
def ev_reject_other_unit(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("l_quantity").cast("int")
    span = F.when(F.col("l_linenumber") % 3 != 0, F.struct(at.alias("start"), (at + 5).alias("end"), F.lit(1.0).alias("score"), F.lit("exact").alias("method")))
    got = evidence.judge_in_unit(_items(spark, d).select(*KEY, span.alias("span"), F.lit(10).alias("unit_start"), F.lit(40).alias("unit_end")))
    return got.select(*KEY, "verify_result", "match_score", "char_start")


@query("""WITH f AS (SELECT l_orderkey, list({'n': CAST(l_linenumber AS INTEGER), 'i': l_partkey, 'r': l_returnflag, 's': CAST(l_quantity AS INTEGER), 'e': CAST(l_quantity AS INTEGER) + 10} ORDER BY l_linenumber, l_partkey, l_returnflag, l_quantity) AS fs FROM lineitem WHERE l_linestatus <> 'F' GROUP BY 1),
 k AS (SELECT l_orderkey, unnest(list_reduce(fs, lambda kept, f: CASE WHEN len(list_filter(kept, lambda x: x.r = f[1].r AND x.s < f[1].e AND f[1].s < x.e)) > 0 THEN kept ELSE list_concat(kept, f) END)) AS k FROM (SELECT l_orderkey, list_transform(fs, lambda x: [x]) AS fs FROM f))
 SELECT l_orderkey, k.n AS attempt_no, k.i AS item_no, k.r AS risk_type, k.s AS char_start FROM k""")
def ev_retry_dedupe(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("l_quantity").cast("int")
    rows = _items(spark, d).select("l_orderkey", F.col("l_linenumber").cast("int").alias("attempt_no"), F.col("l_partkey").alias("item_no"), F.col("l_returnflag").alias("risk_type"), at.alias("char_start"), (at + 10).alias("char_end"), F.when(F.col("l_linestatus") == "F", "failed").otherwise("exact").alias("verify_result"))
    return evidence.keep_first_reports(rows, "l_orderkey").select("l_orderkey", "attempt_no", "item_no", "risk_type", "char_start")


@query("""WITH f AS (SELECT l_orderkey, l_partkey * 100 + l_linenumber AS finding_id, l_suppkey % 4 AS category, l_linestatus, l_returnflag, CAST(l_quantity AS INTEGER) AS s, CAST(l_quantity AS INTEGER) + 4 + l_linenumber AS e FROM lineitem),
 b AS (SELECT * FROM f WHERE l_linestatus = 'F' UNION ALL SELECT * FROM f WHERE l_linestatus <> 'F' AND NOT EXISTS (SELECT 1 FROM f r WHERE r.l_linestatus = 'F' AND r.l_orderkey = f.l_orderkey AND r.category = f.category AND least(r.e, f.e) > greatest(r.s, f.s) AND (least(r.e, f.e) - greatest(r.s, f.s)) / least(r.e - r.s, f.e - f.s) >= 0.5))
 SELECT l_orderkey, finding_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, s, finding_id) AS INTEGER) AS position FROM b""")
def diag_merge(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("l_quantity").cast("int")
    f = _items(spark, d).select("l_orderkey", (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("finding_id"), (F.col("l_suppkey") % 4).alias("category"), "l_linestatus", F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "A", "medium").otherwise("low").alias("severity"), at.alias("char_start"), (at + 4 + F.col("l_linenumber")).cast("int").alias("char_end"))
    got = evidence.merge_findings(f.filter("l_linestatus = 'F'"), f.filter("l_linestatus != 'F'"), "l_orderkey")
    return got.select("l_orderkey", "finding_id", "position")


SAID = ("涨粉明显", "准确率变好", "性能提升", "负责开发", "销量增加 30%", "完成率高")
#: what of SAID states a result, by direction
STATED = {"cs": "提升", "ops": "提升|涨粉|销量", "finance": "提升|准确率|完成率", "general": "提升|涨粉|销量|准确率|完成率"}


@query(f"""WITH u AS (SELECT p_partkey, {_picked('p_partkey', SAID)} AS t, {_picked('p_size', ('cs', 'ops', 'finance', 'general', 'other'))} AS domain FROM part)
 SELECT p_partkey, domain FROM u WHERE regexp_matches(t, CASE domain {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in STATED.items())} ELSE '{STATED["cs"]}' END) AND NOT regexp_matches(t, '[0-9]')""")
def rule_registry(spark: SparkSession, d: str) -> DataFrame:
    others = frozenset(("STAR_INCOMPLETE", "WEAK_VERB", "LENGTH_ANOMALY"))
    t, domain = _pick(F.col("p_partkey"), *SAID), _pick(F.col("p_size"), "cs", "ops", "finance", "general", "other")
    units = table(spark, d, "part").select(F.col("p_partkey").alias("resume_id"), domain.alias("unit_id"), domain.alias("domain"), F.lit("work").alias("unit_type"), F.lit(0).alias("char_start"), F.length(t).alias("char_end"), t.alias("text"))
    got = upkeep.run_rules_by_direction(units, {k: (words, others) for k, (words, _) in upkeep.DIRECTIONS.items()})
    return got.select(F.col("resume_id").alias("p_partkey"), F.col("unit_id").alias("domain"))


# prompt texts


@query(f"WITH {OFFSETS} SELECT doc_id, md5(string_agg('[#' || line_no || '] ' || line, chr(10) ORDER BY line_no)) AS listing FROM offs GROUP BY 1")
def ctx_numbered_blocks(spark: SparkSession, d: str) -> DataFrame:
    blocks = lines(spark, d).select("doc_id", F.col("line_no").alias("block_index"), F.col("line").alias("text"))
    return context.numbered_blocks(blocks, "doc_id").select("doc_id", _md5(F.col("listing")).alias("listing"))


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 3 <> 0 ORDER BY turn) AS n FROM conversations)
 SELECT conv_id, coalesce(string_agg(role, '、' ORDER BY turn) FILTER (turn % 3 = 0), '（没有）') AS known,
 md5(string_agg('[#' || n || '] ' || role || chr(10) || '    下面的内容：' || coalesce(nullif(replace(left(coalesce(text, ''), 80), chr(10), ' / '), ''), '（没有内容）'), chr(10) ORDER BY turn) FILTER (turn % 3 <> 0)) AS candidates FROM s GROUP BY 1 HAVING count(*) FILTER (turn % 3 <> 0) > 0""")
def ctx_section_candidates(spark: SparkSession, d: str) -> DataFrame:
    known = F.col("turn") % 3 == 0
    s = table(spark, d, "conversations").select(F.col("conv_id").alias("resume_id"), F.col("turn").alias("block_start"), F.col("role").alias("title"), F.col("text").alias("content"), F.when(known, "dict").otherwise("feature").alias("matched_by"), (~known).alias("needs_llm"))
    return context.section_candidates(s).select(F.col("resume_id").alias("conv_id"), "known", _md5(F.col("candidates")).alias("candidates"))


@query("SELECT l_orderkey, l_returnflag AS unit_id, string_agg('- t' || l_partkey, chr(10) ORDER BY l_linenumber, l_partkey) AS summary FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL")
def ctx_rule_summary(spark: SparkSession, d: str) -> DataFrame:
    f = _items(spark, d).select(F.col("l_orderkey").alias("resume_id"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("unit_id"), F.concat(F.lit("t"), _text("l_partkey")).alias("title"), "l_linenumber", "l_partkey")
    return context.rule_summary(f, "l_linenumber", "l_partkey").withColumnRenamed("resume_id", "l_orderkey")


@query("SELECT l_orderkey AS job_id, string_agg(l_linenumber || '. Part ' || l_partkey, chr(10) ORDER BY l_linenumber, l_linenumber || '. Part ' || l_partkey) AS listing FROM lineitem GROUP BY 1")
def ctx_requirement_list(spark: SparkSession, d: str) -> DataFrame:
    r = _items(spark, d).select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("requirement_id"), F.concat(F.lit("Part "), _text("l_partkey")).alias("text"))
    return context.requirement_list(r)


UNITS = ("work[0]", "work[0].highlights[1]", "work[0].highlights[9]", "work[7]", "summary", "projects[0]")


@query(f"""WITH f AS (SELECT doc_id, text, CAST(length(text) // 2 AS INTEGER) AS h, CAST(length(text) // 3 AS INTEGER) AS spot, doc_id % 7 = 0 AS whole, {_picked('doc_id', UNITS)} AS unit_id FROM documents WHERE text IS NOT NULL),
 r AS (SELECT *, left(text, h) AS w, unit_id LIKE 'work[0]%' AS own, regexp_extract(left(text, spot), '[^\\n]*$') || regexp_extract(substr(text, spot + 1), '^[^\\n]*') AS line FROM f)
 SELECT doc_id, CASE WHEN own THEN '经历：Shop（角色未写）' ELSE '全部工作 / 项目经历' END AS label, md5(CASE WHEN w = '' THEN '（简历里没有工作 / 项目经历）' ELSE w END) AS entry_text,
 md5(coalesce(nullif(CASE WHEN own THEN CASE WHEN unit_id = 'work[0].highlights[1]' THEN substr(text, 4, 6) ELSE w END WHEN NOT whole THEN line ELSE '' END, ''), 'T')) AS sentence,
 coalesce(nullif(CASE WHEN whole THEN '' ELSE substr(text, spot + 1, 5) END, ''), '（针对整份简历）') AS evidence FROM r""")
def ctx_finding_prompt(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text IS NOT NULL").withColumns({"h": F.floor(F.length("text") / 2).cast("int"), "at": F.floor(F.length("text") / 3).cast("int")})
    span = lambda s, e: F.struct(s.alias("char_start"), e.alias("char_end"))
    entry = F.struct(F.lit("Shop").alias("name"), F.lit(None).cast("string").alias("role"), F.lit(0).alias("char_start"), F.col("h").alias("char_end"), F.array(span(F.lit(0), F.lit(3)), span(F.lit(3), F.lit(9))).alias("highlights"))
    work = F.array(entry)
    s = docs.select(F.col("doc_id").alias("resume_id"), F.col("text").alias("masked_text"), work.alias("work"), F.slice(work, 1, 0).alias("projects"))
    placed = F.col("doc_id") % 7 != 0
    f = docs.select(F.col("doc_id").alias("resume_id"), _pick(F.col("doc_id"), *UNITS).alias("unit_id"), F.when(placed, F.col("at")).alias("char_start"), F.when(placed, F.col("at") + 5).alias("char_end"), F.lit("T").alias("title"))
    got = context.finding_context(f, s)
    return got.select(F.col("resume_id").alias("doc_id"), "label", _md5(F.col("entry_text")).alias("entry_text"), _md5(F.col("sentence")).alias("sentence"), "evidence")


KINDS = ("hard", "plus", "soft", "new")


@query(f"""SELECT {ITEM}, CASE {_picked('l_partkey', KINDS)} WHEN 'hard' THEN '必须项' WHEN 'plus' THEN '加分项' WHEN 'soft' THEN '软素质' ELSE '要求' END AS req_type, coalesce(nullif(o_orderpriority, ''), 'c' || l_partkey) AS quote,
 CASE WHEN l_returnflag = 'R' THEN '缺失' ELSE '部分满足' END AS status, CASE WHEN l_linestatus = 'F' THEN '无' ELSE l_linestatus END AS reason
 FROM lineitem LEFT JOIN (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS o_orderpriority, o_custkey % 5 AS k FROM orders) ON o_orderkey = l_orderkey AND k = l_linenumber""")
def ctx_gap_prompt(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d).select("l_partkey", "l_suppkey", F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("long").alias("requirement_id"), F.concat(F.lit("c"), _text("l_partkey")).alias("content"), _pick(F.col("l_partkey"), *KINDS).alias("req_type"), F.when(F.col("l_returnflag") == "R", "miss").otherwise("partial").alias("status"), F.when(F.col("l_linestatus") != "F", F.col("l_linestatus")).alias("reason"))
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_custkey") % 5).alias("requirement_id"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority")).alias("quote"))
    got = context.gap_context(items, asked)
    return got.select(F.col("job_id").alias("l_orderkey"), "l_partkey", "l_suppkey", F.col("requirement_id").cast("int").alias("l_linenumber"), "req_type", "quote", "status", "reason")


@query("""WITH m AS (SELECT conv_id, turn, turn % 3 AS k, 'C' || turn AS code, role, md5(coalesce(text, '')) AS t FROM conversations)
 SELECT conv_id, md5(coalesce(string_agg(code || ' [' || role || '] ' || t || ' —— ' || role, chr(10) ORDER BY turn) FILTER (k = 0), '（无）')) AS requirements,
 md5(coalesce(string_agg(code || ' ' || role || '：' || code || chr(10) || t, chr(10) || chr(10) ORDER BY turn) FILTER (k = 1), '（无）')) AS experiences,
 md5(coalesce(string_agg(code || ' ' || code || ' —— 「' || t || '」', chr(10) ORDER BY turn) FILTER (k = 2), '（无）')) AS findings FROM m GROUP BY 1""")
def ctx_plan_messages(spark: SparkSession, d: str) -> DataFrame:
    code = F.concat(F.lit("C"), _text("turn"))
    m = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), _pick(F.col("turn"), "requirement", "experience", "finding").alias("source"), F.col("turn").alias("position"), code.alias("code"), F.col("role").alias("kind"), code.alias("name"), _md5(F.coalesce("text", F.lit(""))).alias("text"), F.col("role").alias("status"))
    got = context.plan_context(m)
    return got.select(F.col("session_id").alias("conv_id"), *[_md5(F.col(c)).alias(c) for c in ("requirements", "experiences", "findings")])


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '简历里的' || coalesce(k, '经历') || '：' || p_name || chr(10) || p_type WHEN 1 THEN '岗位要求（' || coalesce(k, '') || '）：' || p_type || chr(10) || '初筛判定：miss' || CASE WHEN p_size % 2 = 0 THEN '（' || p_brand || '）' ELSE '' END
 ELSE '简历原文：「' || p_brand || '」' || chr(10) || '初筛发现的问题：' || p_name || '——' || p_type END AS said FROM (SELECT *, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END AS k FROM part)""")
def ctx_describe_source(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct(F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("kind"), F.col("p_name").alias("name"), F.col("p_type").alias("text"), F.lit("miss").alias("status"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("reason"), F.col("p_brand").alias("quote"))
    return table(spark, d, "part").select("p_partkey", context.describe_source(_pick(F.col("p_partkey"), "project", "requirement", "finding"), item).alias("said"))


@query("""SELECT conv_id, md5(string_agg('[话题 ' || (turn // 2 + 1) || CASE WHEN turn % 2 > 0 THEN ' · 追问' ELSE '' END || '] 问：' || role || chr(10) || '答：' || CASE WHEN turn % 5 = 4 THEN '（跳过了）' ELSE left(coalesce(text, ''), 300) || chr(10) || '得分 ' || (turn * 10) || '；好在：' || CASE WHEN turn % 2 = 0 THEN '无' ELSE 'g' || turn END || '；不足：无' END, chr(10) || chr(10) ORDER BY turn)) AS turns FROM conversations GROUP BY 1""")
def ctx_summary_turns(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("turn")
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), n.alias("turn_no"), F.floor(n / 2).alias("topic_idx"), (n % 2).alias("depth"), F.col("role").alias("question"), F.col("text").alias("answer"), (n % 5 == 4).alias("skipped"), (n * 10).alias("score"), F.when(n % 2 == 1, F.concat(F.lit("g"), _text(n))).alias("good"), F.lit("").alias("bad"))
    return context.summary_turns(t).select(F.col("session_id").alias("conv_id"), _md5(F.col("turns")).alias("turns"))


# page lists

STATUS = "CASE o_orderstatus WHEN 'P' THEN 'in_progress' WHEN 'F' THEN 'finished' ELSE 'abandoned' END"


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "in_progress").when(F.col("o_orderstatus") == "F", "finished").otherwise("abandoned")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", status.alias("status"), F.col("o_orderpriority").alias("mode"), F.col("o_totalprice").alias("overall"), F.col("o_orderstatus").alias("verdict"), (F.col("o_orderkey") % 5).cast("int").alias("current_topic"), F.lit(5).alias("topic_count"))


@query("SELECT o_custkey, o_orderkey AS id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 3")
def ui_recent(spark: SparkSession, d: str) -> DataFrame:
    return pages.recent(_sessions(spark, d), "o_custkey", 3).select("o_custkey", "id")


@query("SELECT o_custkey, o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'P', o_orderkey DESC) AS INTEGER) AS position FROM orders QUALIFY position <= 2")
def ui_live_first(spark: SparkSession, d: str) -> DataFrame:
    return pages.live_first(_sessions(spark, d), "o_custkey", 2).select("o_custkey", "id", "position")


@query("SELECT l_orderkey AS report_id, count(*) FILTER (l_returnflag = 'R') AS hits, count(*) AS total FROM lineitem GROUP BY 1")
def ui_hits_total(spark: SparkSession, d: str) -> DataFrame:
    return pages.hit_counts(_items(spark, d).select(F.col("l_orderkey").alias("report_id"), F.when(F.col("l_returnflag") == "R", "hit").otherwise("miss").alias("status")))


@query(f"SELECT {ITEM}, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS number FROM lineitem")
def ui_numbering(spark: SparkSession, d: str) -> DataFrame:
    return pages.numbered(_items(spark, d), "l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey").select(*KEY, "number")


@query("""SELECT o_orderkey, CASE WHEN n <= 0 THEN '今天' WHEN n = 1 THEN '昨天' ELSE n || ' 天前' END AS age, CASE WHEN v > 0 THEN coalesce(list_min(list_filter([1.0, 2, 3, 4, 5, 6, 8, 10]::DOUBLE[], lambda s: v <= s * g * 1.0001)), 10.0) * g ELSE 1.0 END AS top
 FROM (SELECT o_orderkey, datediff('day', CAST(o_orderdate AS DATE), DATE '1997-06-01') AS n, v, pow(10.0::DOUBLE, floor(log10(CASE WHEN v > 0 THEN v ELSE 1 END))) AS g FROM (SELECT *, o_totalprice - 20000 AS v FROM orders))""")
def ui_age(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", pages.age_text(F.to_date("o_orderdate"), F.lit("1997-06-01").cast("date")).alias("age"), pages.axis_top(F.col("o_totalprice") - 20000).alias("top"))


@query("""WITH i AS (SELECT l_orderkey AS report_id, l_partkey AS k, l_returnflag, l_linestatus, CASE WHEN l_linenumber % 2 = 0 THEN 1 END AS spot FROM lineitem)
 SELECT report_id, 'gap' AS list, 'gap:' || report_id || ':' || k AS key, CASE WHEN l_linestatus = 'F' THEN '缺失' ELSE '部分' END AS tag, CASE WHEN l_linestatus <> 'F' AND spot IS NOT NULL THEN 'part' END AS color, 'c' || k AS text, l_linestatus AS why, '部分满足：c' || k AS note FROM i WHERE l_returnflag = 'R'
 UNION ALL SELECT report_id, 'self', 'finding:' || k, CASE l_linestatus WHEN 'F' THEN '严重' ELSE '轻微' END, CASE WHEN spot IS NOT NULL THEN 'bad' END, CASE WHEN spot IS NOT NULL THEN '「q' || k || '」' ELSE 't' || k END, CASE WHEN spot IS NOT NULL THEN 't' || k ELSE '针对整份简历' END, 't' || k FROM i WHERE l_returnflag = 'A'
 UNION ALL SELECT report_id, 'hit', 'hit:' || report_id || ':' || k, '满足', CASE WHEN spot IS NOT NULL THEN 'good' END, 'c' || k, l_linestatus, '满足：c' || k FROM i WHERE l_returnflag = 'N'""")
def ui_three_lists(spark: SparkSession, d: str) -> DataFrame:
    k = _text("l_partkey")
    named = lambda letter: F.concat(F.lit(letter), k)
    i = _items(spark, d).select(
        "l_returnflag", F.col("l_orderkey").alias("report_id"), F.col("l_partkey").alias("requirement_id"), F.col("l_partkey").alias("finding_id"), F.when(F.col("l_linestatus") == "F", "miss").otherwise("partial").alias("status"), F.when(F.col("l_linestatus") == "F", "high").otherwise("low").alias("severity"),
        named("c").alias("content"), F.col("l_linestatus").alias("reason"), named("t").alias("title"), F.when(F.col("l_linenumber") % 2 == 0, named("q")).alias("evidence_quote"), F.when(F.col("l_linenumber") % 2 == 0, 1).alias("char_start"),
    )
    return pages.three_lists(*[i.filter(F.col("l_returnflag") == flag) for flag in "RAN"])


@query("""SELECT o_custkey AS user_id, count(*) AS "all", count(*) FILTER (o_orderstatus <> 'O' AND o_totalprice >= 150000) AS pass, count(*) FILTER (o_orderstatus <> 'O' AND o_totalprice < 150000) AS fail FROM orders GROUP BY 1""")
def flt_apply_tab(spark: SparkSession, d: str) -> DataFrame:
    return pages.apply_tabs(table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("success").alias("status"), (F.col("o_totalprice") >= 150000).alias("passed")))


@query(f"SELECT o_orderkey AS id, o_orderpriority AS mode, {STATUS} AS status, 5 AS topic_count, CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderkey % 5 + 1 AS INTEGER) ELSE 0 END AS current_topic, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS overall, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS verdict FROM orders")
def proj_brief(spark: SparkSession, d: str) -> DataFrame:
    return pages.session_brief(_sessions(spark, d))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'decision=next,score=' || c_nationkey ELSE '' END AS shown FROM customer")
def proj_public_eval(spark: SparkSession, d: str) -> DataFrame:
    told = F.when(F.col("c_custkey") % 3 == 1, F.format_string('{"score": %d, "decision": "next", "prompt": "hidden"}', "c_nationkey")).when(F.col("c_custkey") % 3 == 2, '{"cost": 3}')
    shown = pages.public_evaluation(told)
    listed = F.array_join(F.transform(F.sort_array(F.map_entries(shown)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return table(spark, d, "customer").select("c_custkey", F.coalesce(listed, F.lit("none")).alias("shown"))


@query("""SELECT feature, CAST(row_number() OVER (ORDER BY cost DESC, ordinal) - 1 AS INTEGER) AS rank FROM (SELECT event_type AS feature, sum(event_id) AS cost, min(event_id) AS ordinal FROM events GROUP BY 1)""")
def win_rank_cost(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "events").groupBy(F.col("event_type").alias("feature")).agg(F.sum("event_id").alias("cost"), F.min("event_id").alias("ordinal"))
    return pages.rank_by_cost(f).select("feature", "rank")


# upkeep


@query("SELECT o_orderkey, coalesce(c_name, 'none') AS username FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def join_usernames(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))
    return upkeep.usernames(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id")), users).select("o_orderkey", F.coalesce("username", F.lit("none")).alias("username"))


@query(f"WITH {CALLS} SELECT c_custkey AS ref_id, CAST(coalesce(sum(token_input), 0) AS BIGINT) AS token_input, CAST(coalesce(sum(token_output), 0) AS BIGINT) AS token_output FROM customer LEFT JOIN calls ON ref_type = 'resume' AND ref_id = c_custkey GROUP BY 1")
def agg_tokens_ref(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "customer").select(F.lit("resume").alias("ref_type"), F.col("c_custkey").alias("ref_id"))
    return upkeep.tokens_of(refs, calls(spark, d)).drop("ref_type")


@query("""WITH r AS (SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS p, count(*) AS n FROM orders GROUP BY 1)
 SELECT c_custkey AS diagnosis_id, CASE WHEN n IS NULL OR CAST(floor(p) AS BIGINT) % 6 NOT IN (1, 2, 3) THEN 'cs' ELSE (['ops', 'finance', 'general'])[CAST(floor(p) AS BIGINT) % 6] END AS domain FROM customer LEFT JOIN r ON o_custkey = c_custkey""")
def join_diag_domain(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k = (F.floor("o_totalprice") % 6).cast("int")
    reports = o.select(F.col("o_custkey").alias("diagnosis_id"), F.col("o_orderkey").alias("report_id"), F.col("o_orderkey").alias("job_id"))
    jobs = o.select(F.col("o_orderkey").alias("job_id"), _pick(k, "cs", "ops", "finance", "general", "other", "gone").alias("domain")).filter("domain != 'gone'")
    return upkeep.diagnosis_direction(table(spark, d, "customer").select(F.col("c_custkey").alias("diagnosis_id")), reports, jobs)


@query("""SELECT o_orderkey, array_to_string(list_transform([0, 1, 2], lambda k: k || ':' || CASE WHEN k = o_custkey % 4 THEN 'new' ELSE 'old' END), ',') AS items FROM orders""")
def upd_json_item(spark: SparkSession, d: str) -> DataFrame:
    items = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: F.struct(k.alias("requirement_id"), F.lit("old").alias("advice")))
    new = upkeep.replace_in_items(items, F.col("o_custkey") % 4, F.lit("new"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(new, lambda x: F.concat(x["requirement_id"].cast("string"), F.lit(":"), x["advice"])), ",").alias("items"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'ask' END AS saved FROM customer")
def upd_saved_once(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    stored = c.filter("c_custkey % 3 != 1").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise("").alias("text"))
    return upkeep.saved_advice(c.select("c_custkey"), stored, "c_custkey").select("c_custkey", F.coalesce("saved", F.lit("ask")).alias("saved"))


REPAIRED = "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'failed' WHEN 'F' THEN 'success' ELSE 'failed' END AS status, CASE o_orderstatus WHEN 'P' THEN 'interrupted' WHEN 'O' THEN 'other' ELSE '' END AS error FROM orders"


@query(REPAIRED)
def mnt_repair(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    tasks = table(spark, d, "orders").select("o_orderkey", F.when(s == "P", "running").when(s == "F", "success").otherwise("failed").alias("status"), F.when(s == "O", "other").otherwise("").alias("error"))
    return upkeep.mark_interrupted(tasks, "status", "error")


@query(REPAIRED.replace("AS status", "AS parse_status").replace("AS error", "AS parse_error"))
def st_interrupted(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    tasks = table(spark, d, "orders").select("o_orderkey", F.when(s == "P", "parsing").when(s == "F", "success").otherwise("failed").alias("parse_status"), F.when(s == "O", "other").otherwise("").alias("parse_error"))
    return upkeep.mark_interrupted(tasks, "parse_status", "parse_error", ("pending", "parsing"))


@query("SELECT s_nationkey AS nation, count(*) FILTER (s_acctbal > 0) AS active, CAST(count(*) FILTER (s_suppkey = 7) AS BIGINT) AS after FROM supplier GROUP BY 1 HAVING count(*) FILTER (s_acctbal > 0) > 1")
def mnt_single_active(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), (F.col("s_acctbal") > 0).alias("is_active"))
    after = upkeep.activate(p, 7).groupBy("nation").agg(F.count_if("is_active").alias("after"))
    return upkeep.over_active(p, "nation").join(after, "nation")


@query("SELECT 'lt_' || lpad(CAST(n AS VARCHAR), 3, '0') AS username, s_suppkey AS source_id, 'lt_' || lpad(CAST(n AS VARCHAR), 3, '0') || ':' || s_suppkey AS clone_id FROM supplier, range(12) r(n)")
def mnt_clone(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.clone_rows(table(spark, d, "supplier"), 12, "s_suppkey")


@query("SELECT o_orderkey, o_custkey AS user_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0)")
def mnt_prefix_delete(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(_pick(F.col("c_custkey"), "lt_", "ltx", "l", "", "LT_"), "c_name").alias("username"))
    return upkeep.without_users(users, table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id")))[1]


@query("""WITH q AS (SELECT o_orderkey AS j, o_custkey % 5 AS k, o_orderpriority AS content FROM orders)
 SELECT l_orderkey AS report_id, string_agg(l_linenumber || '/' || l_partkey || '/' || coalesce(content, 'gone'), ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS items FROM lineitem LEFT JOIN q ON j = l_orderkey AND k = l_linenumber GROUP BY 1""")
def snk_match(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d).select(F.col("l_orderkey").alias("report_id"), F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("long").alias("requirement_id"), "l_partkey", "l_suppkey")
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_custkey") % 5).alias("requirement_id"), F.col("o_orderpriority").alias("content"), F.lit("hard").alias("req_type"), F.lit("skill").alias("category"), F.lit(1.0).alias("weight"), F.lit(None).cast("string").alias("skill"))
    got = upkeep.report_items(items, asked)
    return got.select("report_id", F.array_join(F.transform("items", lambda x: F.concat_ws("/", x["requirement_id"].cast("string"), x["l_partkey"].cast("string"), F.coalesce(x["content"], F.lit("gone")))), ",").alias("items"))


# masks, replies and model answers

CONTACTS = ("电话 13812345678 ok", "write to a.b@xy.org now", "order 123456789", "")
HIDDEN = ("电话 XXXXXXXXXXX ok", "write to *.*@**.*** now", "order 123456789", "")


@query(f"SELECT p_partkey, {_picked('p_partkey', HIDDEN)} || ' / ' || repeat('某', length(p_name)) AS masked FROM part")
def str_mask_pii(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(_pick(F.col("p_partkey"), *CONTACTS), F.lit(" / "), "p_name")
    return table(spark, d, "part").select("p_partkey", masking.mask_personal(said, F.col("p_name")).alias("masked"))


@query("SELECT p_partkey, 'sold ' || CASE WHEN p_size = p_partkey THEN CAST(p_size AS VARCHAR) ELSE '【数值】' END || ' of ' || p_partkey || ' 【7】' AS text, CASE WHEN p_size = p_partkey THEN 0 ELSE 1 END AS replaced FROM part")
def str_mask_new_numbers(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("sold "), _text("p_size"), F.lit(" of "), _text("p_partkey"), F.lit(" 【7】"))
    return table(spark, d, "part").withColumn("m", masking.mask_new_numbers(said, _text("p_partkey"))).select("p_partkey", "m.text", "m.replaced")


@query("SELECT p_partkey, p_size || ' 【问题】' || p_size || ' x【改成】' || CASE WHEN p_size = p_partkey THEN CAST(p_size AS VARCHAR) ELSE '【数值】' END || ' y' AS text, CASE WHEN p_size = p_partkey THEN 0 ELSE 1 END AS replaced FROM part")
def str_fix_numbers(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(_text("p_size"), F.lit(" 【问题】"), _text("p_size"), F.lit(" x【改成】"), _text("p_size"), F.lit(" y"))
    return table(spark, d, "part").withColumn("m", masking.fix_numbers(said, F.lit("改成"), _text("p_partkey"))).select("p_partkey", "m.text", "m.replaced")


REPLIES = ('{"items": [{"id": 1, "type": "work"}]}', '```json\n{"items": [{"id": 2, "type": "none"}]}\n```', "sorry, no", "", '{"other": 1}')
REPLY_ERRORS = ("1work", "2none", "not JSON", "empty reply", "schema mismatch")


@query(f"SELECT p_partkey, {_picked('p_partkey', REPLY_ERRORS)} AS said FROM part")
def json_parse_validate(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("r", replies.parse_reply(_pick(F.col("p_partkey"), *REPLIES), replies.SECTIONS))
    first = F.get("r.value.items", F.lit(0))
    return p.select("p_partkey", F.coalesce("r.error", F.concat(first["id"].cast("string"), first["type"])).alias("said"))


@query(f"SELECT {ITEM}, l_returnflag = 'R' OR l_returnflag = 'A' AS status_ok, l_linenumber <= 5 AND l_partkey % 7 <= 5 AND l_suppkey % 7 <= 5 AS scores_ok FROM lineitem")
def json_enum_checks(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "R", "hit").when(F.col("l_returnflag") == "A", "miss").when(F.col("l_linestatus") == "F", "maybe")
    scores = F.struct(F.col("l_linenumber").alias("correctness"), (F.col("l_partkey") % 7).alias("depth"), (F.col("l_suppkey") % 7).alias("clarity"))
    return _items(spark, d).select(*KEY, replies.valid_status(status).alias("status_ok"), replies.valid_scores(scores).alias("scores_ok"))


@query("SELECT event_id, 'event: ' || event_type || chr(10) || 'data: ' || props || chr(10) || chr(10) AS frame FROM events")
def json_event_fmt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", replies.event_frame(F.col("event_type"), F.col("props")).alias("frame"))


@query(f"""SELECT {ITEM}, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber % 2 = 0 AND NOT (l_quantity < 30 AND l_quantity + 5 > 10) THEN 'partial' WHEN l_returnflag = 'R' THEN 'hit' ELSE 'miss' END AS status FROM lineitem""")
def match_recheck(spark: SparkSession, d: str) -> DataFrame:
    rid = F.concat_ws("/", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    at = F.col("l_quantity").cast("int")
    li = _items(spark, d).select(*KEY, F.col("l_orderkey").alias("report_id"), rid.alias("requirement_id"), F.when(F.col("l_returnflag") == "R", "hit").otherwise("miss").alias("status"), F.when(F.col("l_linestatus") == "F", "llm").otherwise("dict").alias("matched_by"), at.alias("char_start"), (at + 5).alias("char_end"))
    listed = li.filter("l_linenumber % 2 = 0").select("report_id", "requirement_id", F.lit("partial").alias("status")).distinct()
    entries = li.select("report_id", F.lit(10).alias("char_start"), F.lit(30).alias("char_end")).distinct()
    return matching.recheck_listed_only(li, listed, entries).select(*KEY, "status")


@query("""WITH q AS (SELECT conv_id AS session_id, turn AS turn_no, turn % 6 AS a, conv_id % 6 AS b, 3 AS c, turn % 7 = 6 AS skipped, coalesce(length(text), 0) >= 12 AND turn % 3 <> 2 AS found FROM conversations)
 SELECT session_id, turn_no, NOT found AND NOT skipped AS low_evidence, CAST(CASE WHEN skipped THEN 0 WHEN NOT found THEN 60 ELSE round_even((a + b + c) / 3 * 20, 0) END AS INTEGER) AS score FROM q""")
def iv_evidence(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("turn")
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), n.alias("turn_no"), F.col("text").alias("answer"), (n % 6).alias("correctness"), (F.col("conv_id") % 6).alias("depth"), F.lit(3).alias("clarity"), (n % 7 == 6).alias("skipped"))
    said = F.when(F.col("turn_no") % 3 == 2, "q#9").otherwise(F.when(F.length("answer") >= 12, F.substring("answer", 1, 12)))
    quotes = c.select("session_id", "turn_no", F.lit(0).alias("ordinal"), said.alias("quote")).filter("quote IS NOT NULL")
    return interview.score_turns(c, quotes).select("session_id", "turn_no", "low_evidence", "score")


@query(f"""WITH r AS (SELECT l_orderkey AS session_id, 'requirement' AS source, 'R' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS code, 'c' || l_partkey AS text FROM lineitem WHERE l_returnflag <> 'N' AND l_linestatus = 'F'),
 f AS (SELECT l_orderkey AS session_id, 'finding' AS source, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity * 100000 + l_partkey) AS n, 't' || l_partkey AS text FROM lineitem WHERE l_linestatus = 'O')
 SELECT * FROM r UNION ALL SELECT session_id, source, 'F' || n, text FROM f WHERE n <= 6 UNION ALL SELECT o_orderkey, 'experience', 'P1', o_orderpriority FROM orders""")
def iv_materials(spark: SparkSession, d: str) -> DataFrame:
    li = _items(spark, d).withColumnRenamed("l_orderkey", "session_id")
    asked = li.filter("l_linestatus = 'F'").select("session_id", F.struct("l_linenumber", "l_partkey").alias("requirement_id"), F.when(F.col("l_returnflag") == "N", "education").otherwise("skill").alias("category"), F.lit("hard").alias("req_type"), F.concat(F.lit("c"), _text("l_partkey")).alias("content"))
    entries = table(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderpriority").alias("name"), F.lit(0).alias("char_start"))
    found = li.select("session_id", F.concat(F.lit("t"), _text("l_partkey")).alias("title"), F.col("l_linenumber").alias("severity_rank"), (F.col("l_quantity") * 100000 + F.col("l_partkey")).alias("char_start"), F.when(F.col("l_linestatus") == "O", "exact").otherwise("failed").alias("verify_result"))
    return interview.materials(asked, entries, found)


_JOB_ASKS = f"""d AS (SELECT doc_id, text, translate(text, chr(10) || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ' abcdefghijklmnopqrstuvwxyz') AS t, length(text) AS n FROM documents WHERE length(text) >= 40),
 a AS (SELECT doc_id, t, o, ['hard', 'plus', 'soft'][o % 3 + 1] AS req_type, CASE o WHEN 3 THEN 'q#9~' WHEN 4 THEN md5(CAST(doc_id AS VARCHAR)) ELSE substr(text, (doc_id * 7 + o * 13) % (n - 30) + 1, 30) END AS quote, CASE WHEN o IN (0, 5) THEN 'want ' || doc_id % 3 ELSE 'WANT ' || o % 2 END AS content, CASE WHEN o % 2 = 1 THEN ['the', 'de', 'und'][CAST(doc_id % 3 + 1 AS INTEGER)] END AS skill FROM d, range(0, 6) r(o)),
 s AS (SELECT *, trim(translate(quote, chr(10) || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ' abcdefghijklmnopqrstuvwxyz'), ' .' || chr(34) || chr(39)) AS q FROM a)"""


@query(f"""WITH {_JOB_ASKS}, k AS (SELECT *, strpos(t, q) - 1 AS s FROM s WHERE length(q) >= 2 AND contains(t, q) AND (skill IS NULL OR contains(lower(t), skill))),
 u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(content) ORDER BY o) AS again FROM k)
 SELECT doc_id AS job_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) AS INTEGER) AS requirement_id, content, req_type, CASE req_type WHEN 'hard' THEN 1.0 WHEN 'plus' THEN 0.5 ELSE 0.3 END AS weight, CAST(s AS INTEGER) AS char_start FROM u WHERE again = 1""")
def jd_verify(spark: SparkSession, d: str) -> DataFrame:
    """Six asks of each job text: quotes from places of their own, two made up; contents that differ in case; skills that may not occur."""
    doc, n = F.col("doc_id"), F.length("text")
    jobs = table(spark, d, "documents").filter(n >= 40).select(doc.alias("job_id"), F.col("text").alias("raw_text"))
    o = F.col("ordinal")
    pick = lambda at, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (at + 1).cast("int"))
    key, size = F.col("job_id"), F.length("raw_text")
    quote = F.when(o == 3, "q#9~").when(o == 4, F.md5(key.cast("string").cast("binary"))).otherwise(F.substr("raw_text", ((key * 7 + o * 13) % (size - 30) + 1).cast("int"), F.lit(30)))
    content = F.when(o.isin(0, 5), F.concat(F.lit("want "), key % 3)).otherwise(F.concat(F.lit("WANT "), o % 2))
    found = jobs.withColumn("ordinal", F.explode(F.sequence(F.lit(0), F.lit(5))))
    found = found.select("job_id", "ordinal", pick(o % 3, "hard", "plus", "soft").alias("req_type"), F.lit("skill").alias("category"), content.alias("content"), F.when(o % 2 == 1, pick(key % 3, "the", "de", "und")).alias("skill"), quote.alias("quote"))
    return matching.verify_requirements(found, jobs).select("job_id", "requirement_id", "content", "req_type", "weight", "char_start")


@query(f"SELECT {ITEM}, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_quantity AS INTEGER) END NULLS LAST, l_partkey, l_suppkey, l_linenumber) AS INTEGER) AS position FROM lineitem")
def srt_severity(spark: SparkSession, d: str) -> DataFrame:
    f = _items(spark, d).select(*KEY, F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "A", "medium").otherwise("low").alias("severity"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity").cast("int")).alias("char_start"))
    return pages.numbered(f, "l_orderkey", *listing.severity_order(), "l_partkey", "l_suppkey", "l_linenumber", name="position").select(*KEY, "position")


@query(f"SELECT {ITEM}, CASE WHEN l_linenumber % 2 = 0 THEN 'a=' || CAST(l_partkey AS VARCHAR) || ',' ELSE '' END || 'b=' || CAST(l_linenumber AS VARCHAR) AS shown FROM lineitem")
def dim_scores_nonnull(spark: SparkSession, d: str) -> DataFrame:
    scores = F.create_map(F.lit("a"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey") + 0.3), F.lit("b"), F.col("l_linenumber") + 0.2)
    shown = F.transform(F.map_entries(listing.nonnull_scores(scores)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("long").cast("string")))
    return _items(spark, d).select(*KEY, F.array_join(shown, ",").alias("shown"))


TITLES = ("工作经历", "教育背景", "专业技能", "no heading at all", "项目经历", "Awards", "Work Experience", "Self-made", "自我评价", "Research")
TITLE_TYPES = ("work", "education", "skills", None, "projects", "awards", "work", None, "summary", "projects")


@query(f"""WITH k(alias, kind) AS (VALUES {", ".join(f"('{re.sub('[^0-9a-z一-鿿]', '', t.lower())}', '{k}')" for t, k in zip(TITLES, TITLE_TYPES, strict=True) if k)}), w AS (SELECT p_partkey, {list(TITLES)!r} AS w, p_name, p_partkey % 6 AS form FROM part),
 t AS (SELECT p_partkey, form, w[CAST(p_partkey % 10 + 1 AS INTEGER)] AS a, w[CAST(p_partkey // 10 % 10 + 1 AS INTEGER)] AS b, p_name FROM w),
 s AS (SELECT *, CASE form WHEN 0 THEN a WHEN 1 THEN (p_partkey % 20 + 1) || '. ' || a WHEN 2 THEN '【' || upper(a) || '】' WHEN 3 THEN a || ' & ' || b WHEN 4 THEN a || ' ' || p_name ELSE p_name END AS title FROM t),
 n AS (SELECT *, lower(regexp_replace(title, '^[0-9]{{1,2}}\\. ', '')) AS bare FROM s), p AS (SELECT *, list_transform(string_split(bare, ' & '), lambda x: regexp_replace(x, '[^0-9a-z一-鿿]', '', 'g')) AS parts, regexp_replace(bare, '[^0-9a-z一-鿿]', '', 'g') AS whole FROM n)
 SELECT p_partkey, title, coalesce(k.kind, CASE WHEN y.alias IS NOT NULL THEN z.kind END, CASE WHEN len(parts) = 2 AND k1.kind IS NOT NULL AND k2.kind IS NOT NULL THEN k1.kind END, 'none') AS section FROM p LEFT JOIN k ON k.alias = whole LEFT JOIN k k1 ON k1.alias = parts[1] LEFT JOIN k k2 ON k2.alias = parts[2]
  LEFT JOIN k z ON z.alias = regexp_replace(whole, '[^一-鿿]', '', 'g') LEFT JOIN k y ON y.alias = regexp_replace(whole, '[^a-z]', '', 'g') AND length(y.alias) + length(z.alias) = length(whole)""")
def str_heading_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Headings plain, numbered, framed, joined in pairs and followed by a part's name; names alone are none."""
    key = F.col("p_partkey")
    word = lambda at: F.element_at(F.array(*[F.lit(t) for t in TITLES]), (at % 10 + 1).cast("int"))
    a, b, form = word(key), word(F.floor(key / 10)), key % 6
    title = F.when(form == 0, a).when(form == 1, F.concat(key % 20 + 1, F.lit(". "), a)).when(form == 2, F.concat(F.lit("【"), F.upper(a), F.lit("】"))).when(form == 3, F.concat(a, F.lit(" & "), b)).when(form == 4, F.concat(a, F.lit(" "), "p_name")).otherwise(F.col("p_name"))
    got = sections.lookup(table(spark, d, "part").select("p_partkey", title.alias("title")), "title")
    return got.select("p_partkey", "title", F.coalesce("section_type", F.lit("none")).alias("section"))
