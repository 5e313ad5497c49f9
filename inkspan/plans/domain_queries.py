"""Queries for matching, interviews, pages of lines, usage figures, caches and sinks, with DuckDB SQL.

An order is a report, a résumé, a file or a page; its line items, numbered within it, are requirements, mentions, lines or findings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkspan.operators import evaluation, interview, layout, matching, retrieval, rules, skills, usage
from inkspan.plans.bindings import calls, table
from inkspan.plans.queries import CALLS, USER, _owners, query
from inkspan.plans.queries import OWNERS, SUMS
from inkspan.sources import io, staged

_L = "l AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS r FROM lineitem)"


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, d, "lineitem").withColumn("r", F.row_number().over(w))


# matching. Requirements: every line; a skill by part, its text plain or long; degrees and years by remainders of the part

_REQ = f"""{_L}, req AS (SELECT l_orderkey AS report_id, r AS requirement_id, CASE l_partkey % 4 WHEN 0 THEN 'education' WHEN 1 THEN 'experience' ELSE 'skill' END AS category, l_partkey % 30 AS skill_id, l_suppkey % 2 = 0 AS plain,
  CASE WHEN l_partkey % 3 = 0 THEN 4 WHEN l_partkey % 3 = 1 THEN 2 END AS level, CAST(l_quantity AS INTEGER) % 6 + 1 AS years, round(l_tax * 10 + 0.1, 1) AS weight FROM l),
 men AS (SELECT l_orderkey AS report_id, l_suppkey % 30 AS skill_id, l_linestatus = 'O' AS used, r * 10 AS a FROM l), mb AS (SELECT report_id, skill_id, bool_or(used) AS used, coalesce(min(a) FILTER (used), min(a)) AS a FROM men GROUP BY 1, 2),
 edu AS (SELECT l_orderkey AS report_id, r AS ordinal, CASE WHEN l_returnflag = 'R' THEN 4 WHEN l_returnflag = 'A' THEN 3 ELSE 0 END AS level FROM l WHERE r <= 2), best AS (SELECT report_id, max(level) AS level FROM edu WHERE level > 0 GROUP BY 1),
 yrs AS (SELECT o_orderkey AS report_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(format('{{:.1f}}', (o_orderkey % 80) / 12) AS DOUBLE) END AS y FROM orders),
 ru AS (SELECT q.*, CASE category WHEN 'skill' THEN CASE WHEN mb.used THEN 'hit' WHEN mb.used IS NOT NULL THEN 'partial' END WHEN 'education' THEN CASE WHEN q.level IS NULL OR best.level IS NULL THEN NULL WHEN best.level >= q.level THEN 'hit' ELSE 'miss' END
  ELSE CASE WHEN coalesce(y, 0) >= years THEN 'hit' WHEN coalesce(y, 0) >= years / 2 THEN 'partial' ELSE 'miss' END END AS rule FROM req q LEFT JOIN mb ON mb.report_id = q.report_id AND mb.skill_id = q.skill_id AND category = 'skill' LEFT JOIN best ON best.report_id = q.report_id LEFT JOIN yrs ON yrs.report_id = q.report_id),
 st AS (SELECT *, CASE WHEN category = 'skill' AND NOT (rule = 'hit' AND plain) THEN NULL ELSE rule END AS strict FROM ru),
 ans AS (SELECT l_orderkey AS report_id, r AS requirement_id, CASE l_suppkey % 3 WHEN 0 THEN 'hit' WHEN 1 THEN 'partial' ELSE 'other' END AS said, CASE WHEN l_suppkey % 5 <> 0 THEN r * 10 END AS pos FROM l WHERE l_suppkey % 7 <> 0),
 j AS (SELECT st.*, CASE WHEN said IN ('hit', 'partial') AND pos IS NOT NULL THEN said ELSE 'miss' END AS model, pos FROM st LEFT JOIN ans USING (report_id, requirement_id))"""


def requirement_inputs(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    n = _numbered(spark, d)
    part, supp, r = F.col("l_partkey"), F.col("l_suppkey"), F.col("r")
    report = F.col("l_orderkey").alias("report_id")
    name = F.concat(F.lit("skill"), part % 30)
    category = F.when(part % 4 == 0, "education").when(part % 4 == 1, "experience").otherwise("skill")
    degree = F.when(part % 3 == 0, "博士学历").when(part % 3 == 1, "本科及以上").otherwise("学历不限")
    content = F.when(part % 4 == 0, degree).when(part % 4 == 1, F.concat((F.col("l_quantity").cast("int") % 6 + 1).cast("string"), F.lit("年以上工作经验"))).otherwise(F.when(supp % 2 == 0, F.concat(F.lit("会"), name)).otherwise(F.concat(F.lit("用过"), name, F.lit("并且带过一个完整的线上项目团队"))))
    req = n.select(report, r.alias("requirement_id"), category.alias("category"), (part % 30).alias("skill_id"), name.alias("skill"), content.alias("content"), F.lit("").alias("quote"), F.round(F.col("l_tax") * 10 + 0.1, 1).alias("weight"))
    mentions = n.select(report, (supp % 30).alias("skill_id"), F.when(F.col("l_linestatus") == "O", "work").otherwise("skills").alias("section_type"), (r * 10).alias("char_start"), (r * 10 + 4).alias("char_end"))
    level = F.when(F.col("l_returnflag") == "R", "博士").when(F.col("l_returnflag") == "A", "硕士研究生").otherwise("高中")
    education = n.filter("r <= 2").select(report, r.alias("ordinal"), level.alias("degree"), (r * 3).alias("char_start"), (r * 3 + 2).alias("char_end"))
    k = F.col("o_orderkey")
    end = F.date_format(F.add_months(F.lit("2010-01-01").cast("date"), (k % 80).cast("int")), "yyyy-MM")
    work = table(spark, d, "orders").select(k.alias("report_id"), F.when(k % 5 == 0, "campus").otherwise("work").alias("kind"), F.lit("2010-01").alias("start"), end.alias("end"), F.lit(False).alias("is_present"))
    said = F.when(supp % 3 == 0, "hit").when(supp % 3 == 1, "partial").otherwise("other")
    at = F.when(supp % 5 != 0, r * 10)
    answers = n.filter("l_suppkey % 7 != 0").select(report, r.alias("requirement_id"), said.alias("status"), at.alias("char_start"), (at + 2).alias("char_end"))
    entries = n.filter("l_linestatus = 'F'").select(report, (r * 10).alias("char_start"), (r * 10 + 1).alias("char_end"))
    return {"requirements": req, "mentions": mentions, "education": education, "work": work, "answers": answers, "entries": entries}


@query(f"WITH {_REQ} SELECT report_id, requirement_id, strict AS status FROM st WHERE strict IS NOT NULL")
def match_strict(spark: SparkSession, d: str) -> DataFrame:
    i = requirement_inputs(spark, d)
    got = matching.match_by_rules(i["requirements"], i["mentions"], i["education"], i["work"], "2024-01-01", strict=True)
    return got.select("report_id", "requirement_id", "status")


@query(f"""WITH {_REQ}, back AS (SELECT DISTINCT report_id, requirement_id FROM j JOIN l ON l_orderkey = report_id AND l_linestatus = 'F' AND r * 10 < pos + 2 AND r * 10 + 1 > pos)
 SELECT 'dict_only' AS mode, report_id, requirement_id, coalesce(rule, 'miss') AS status FROM j UNION ALL SELECT 'llm_fulltext', report_id, requirement_id, model FROM j
 UNION ALL SELECT 'hybrid', j.report_id, j.requirement_id, CASE WHEN strict IS NOT NULL THEN strict WHEN model = 'hit' AND category = 'skill' AND rule = 'partial' AND back.report_id IS NULL THEN 'partial' ELSE model END FROM j LEFT JOIN back USING (report_id, requirement_id)""")
def match_modes(spark: SparkSession, d: str) -> DataFrame:
    i = requirement_inputs(spark, d)
    got = matching.match_in_modes(i["requirements"], i["mentions"], i["education"], i["work"], i["answers"], "2024-01-01", entries=i["entries"])
    return got.select("mode", "report_id", "requirement_id", "status")


@query(f"WITH {_REQ} SELECT report_id, requirement_id, category, coalesce(rule, 'miss') AS status FROM ru")
def join_req_item(spark: SparkSession, d: str) -> DataFrame:
    i = requirement_inputs(spark, d)
    items = matching.match_by_rules(i["requirements"], i["mentions"], i["education"], i["work"], "2024-01-01")
    return matching.items_of(i["requirements"], items).select("report_id", "requirement_id", "category", "status")


@query(f"WITH {_REQ} SELECT report_id, CAST(max(level) AS INTEGER) AS level, arg_max(ordinal, (level, -ordinal)) AS ordinal FROM edu WHERE level > 0 GROUP BY 1")
def agg_highest_degree(spark: SparkSession, d: str) -> DataFrame:
    return matching.highest_degree(requirement_inputs(spark, d)["education"]).select("report_id", "level", "ordinal")


@query(f"""WITH {_REQ}, s AS (SELECT report_id, sum(weight * CASE rule WHEN 'hit' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END) AS v, sum(weight) AS w FROM ru GROUP BY 1),
 dg AS (SELECT o_orderkey AS apply_id, CASE o_orderkey % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'partial' WHEN 2 THEN 'failed' ELSE 'done' END AS status FROM orders)
 SELECT apply_id, status AS diagnosis_status, CAST(format('{{:.1f}}', 100 * v / w) AS DOUBLE) >= 60 AS passed FROM dg JOIN s ON report_id = apply_id WHERE status <> 'running'""")
def apply_gate(spark: SparkSession, d: str) -> DataFrame:
    i = requirement_inputs(spark, d)
    items = matching.match_by_rules(i["requirements"], i["mentions"], i["education"], i["work"], "2024-01-01")
    scores = matching.score_matches(i["requirements"], items).withColumnRenamed("report_id", "apply_id")
    k = F.col("o_orderkey")
    diagnoses = table(spark, d, "orders").select(k.alias("apply_id"), F.when(k % 5 == 0, "running").when(k % 5 == 1, "partial").when(k % 5 == 2, "failed").otherwise("done").alias("status"))
    return matching.apply_gate(diagnoses, scores).select("apply_id", "diagnosis_status", "passed")


# diagnosis


@query(f"""WITH {_L}, f AS (SELECT l_orderkey AS k, r, CASE l_partkey % 3 WHEN 0 THEN 'expression' WHEN 1 THEN 'consistency' ELSE 'ats' END AS c, r * 10 AS a, r * 10 + 4 + l_suppkey % 14 AS b, l_linestatus = 'F' AS rule, l_returnflag = 'N' AS bad FROM l),
 u AS (SELECT * FROM f x WHERE NOT rule AND NOT bad), s AS (SELECT * FROM u x WHERE NOT EXISTS (SELECT 1 FROM f y WHERE y.rule AND y.k = x.k AND y.c = x.c AND greatest(least(x.b, y.b) - greatest(x.a, y.a), 0) / least(x.b - x.a, y.b - y.a) >= 0.5))
 SELECT 'rule_only' AS mode, k AS resume_id, r AS finding FROM f WHERE rule UNION ALL SELECT 'llm_only', k, r FROM u UNION ALL SELECT 'hybrid', k, r FROM f WHERE rule UNION ALL SELECT 'hybrid', k, r FROM s""")
def diag_modes(spark: SparkSession, d: str) -> DataFrame:
    part, r = F.col("l_partkey"), F.col("r")
    f = _numbered(spark, d).select(F.col("l_orderkey").alias("resume_id"), r.alias("finding"), F.when(part % 3 == 0, "expression").when(part % 3 == 1, "consistency").otherwise("ats").alias("category"), (r * 10).alias("char_start"), (r * 10 + 4 + F.col("l_suppkey") % 14).alias("char_end"), F.when(F.col("l_returnflag") == "N", "failed").otherwise("exact").alias("verify_result"), F.col("l_linestatus"))
    by_rule, by_model = f.filter("l_linestatus = 'F'").drop("l_linestatus"), f.filter("l_linestatus != 'F'").drop("l_linestatus")
    out = None
    for mode in ("rule_only", "llm_only", "hybrid"):
        got = rules.findings_in_mode(by_rule, by_model, "resume_id", mode).select(F.lit(mode).alias("mode"), "resume_id", "finding")
        out = got if out is None else out.unionByName(got)
    return out


@query(f"""WITH {_L}, s AS (SELECT l_orderkey AS k, r, 'tool' || (l_partkey % 40) AS name, CASE WHEN l_partkey % 2 = 0 THEN l_partkey % 40 END AS skill_id FROM l), m AS (SELECT l_orderkey AS k, l_suppkey % 40 AS skill_id FROM l WHERE l_returnflag <> 'N'),
 t AS (SELECT l_orderkey AS k, string_agg('Used tool' || (l_suppkey % 40) || ';', ' ' ORDER BY r) AS text FROM l WHERE l_orderkey % 6 <> 0 GROUP BY 1),
 x AS (SELECT s.*, row_number() OVER (PARTITION BY s.k ORDER BY r) AS n FROM s JOIN t USING (k) WHERE CASE WHEN skill_id IS NULL THEN NOT contains(lower(text), lower(name)) ELSE NOT EXISTS (SELECT 1 FROM m WHERE m.k = s.k AND m.skill_id = s.skill_id) END)
 SELECT k AS resume_id, name, CAST(r * 10 AS INTEGER) AS char_start FROM x WHERE n <= 5""")
def rule_SKILL_PROJECT_MISMATCH(spark: SparkSession, d: str) -> DataFrame:  # noqa: N802
    n = _numbered(spark, d)
    part, supp, r = F.col("l_partkey"), F.col("l_suppkey"), F.col("r")
    doc = F.col("l_orderkey").alias("resume_id")
    listed = n.select(doc, r.alias("ordinal"), F.concat(F.lit("tool"), part % 40).alias("name"), F.when(part % 2 == 0, part % 40).alias("skill_id"), (r * 10).alias("char_start"), (r * 10 + 5).alias("char_end"))
    mentions = n.select(doc, (supp % 40).alias("skill_id"), F.when(F.col("l_returnflag") == "N", "skills").otherwise("projects").alias("section_type"))
    said = F.sort_array(F.collect_list(F.struct("r", F.concat(F.lit("Used tool"), supp % 40, F.lit(";")).alias("t"))))
    text = n.filter("l_orderkey % 6 != 0").groupBy("l_orderkey").agg(F.array_join(F.transform(said, lambda x: x["t"]), " ").alias("text")).withColumnRenamed("l_orderkey", "resume_id")
    got = rules.skill_mismatch(listed, mentions, text)
    return got.select("resume_id", F.col("detail").cast("string").alias("name"), "char_start")


# interviews and retrieval


@query(f"""WITH {_L}, t AS (SELECT l_orderkey AS session_id, r AS topic_idx, CASE l_partkey % 3 WHEN 0 THEN 'project' WHEN 1 THEN 'requirement' ELSE 'finding' END AS source, upper('x' || (l_suppkey % 5)) AS ref FROM l),
 m AS (SELECT DISTINCT l_orderkey AS session_id, CASE l_suppkey % 3 WHEN 0 THEN 'project' WHEN 1 THEN 'requirement' ELSE 'finding' END AS source, 'X' || (l_partkey % 5) AS ref FROM l)
 SELECT session_id, topic_idx, t.source, t.ref, m.ref IS NOT NULL AS found, m.source || ' ' || m.ref AS material FROM t LEFT JOIN m USING (session_id, source, ref)""")
def join_material_ref(spark: SparkSession, d: str) -> DataFrame:
    n = _numbered(spark, d)
    source = lambda c: F.when(F.col(c) % 3 == 0, "project").when(F.col(c) % 3 == 1, "requirement").otherwise("finding").alias("source")
    topics = n.select(F.col("l_orderkey").alias("session_id"), F.col("r").alias("topic_idx"), source("l_partkey"), F.concat(F.lit(" x"), F.col("l_suppkey") % 5).alias("ref"))
    held = n.select(F.col("l_orderkey").alias("session_id"), source("l_suppkey"), F.concat(F.lit("X"), F.col("l_partkey") % 5).alias("code")).distinct()
    got = interview.topics_with_sources(topics, held.withColumn("text", F.concat_ws(" ", "source", "code")))
    return got.select("session_id", "topic_idx", "source", "ref", "found", "material")


@query(f"""WITH {_L}, x AS (SELECT l_orderkey AS query_id, r AS idx, r AS rank, CASE WHEN l_partkey % 4 <> 0 THEN l_suppkey % 10 END AS score FROM l WHERE r <= 10)
 SELECT * FROM (SELECT query_id, idx, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, rank) AS INTEGER) AS rank FROM x) WHERE rank <= 3""")
def top_rerank(spark: SparkSession, d: str) -> DataFrame:
    n = _numbered(spark, d).filter("r <= 10")
    recalled = n.select(F.col("l_orderkey").alias("query_id"), F.col("r").alias("idx"), F.col("r").alias("rank"))
    scores = n.filter("l_partkey % 4 != 0").select(F.col("l_orderkey").alias("query_id"), F.col("r").alias("idx"), (F.col("l_suppkey") % 10).alias("score"))
    return retrieval.rerank(recalled, scores, 3).select("query_id", "idx", "rank")


# pages of lines


@query(f"""WITH {_L}, ln AS (SELECT l_orderkey AS k, r, r % 3 + 1 AS page, CASE l_partkey % 5 WHEN 0 THEN 'Page ' || (r % 3 + 1) WHEN 1 THEN CAST(r % 3 + 1 AS VARCHAR) WHEN 2 THEN 'Confidential ' || l_returnflag ELSE 'text ' || l_partkey END AS text, CASE l_suppkey % 3 WHEN 0 THEN 20.0 + r % 2 WHEN 1 THEN 400.0 + r ELSE 810.0 END AS y0 FROM l),
 x AS (SELECT *, y0 + 12 <= 0.06 * 842 OR y0 >= 0.94 * 842 AS edge, round_even(y0 / 4, 0) AS yb FROM ln), a AS (SELECT k, text, yb FROM x WHERE edge GROUP BY ALL HAVING count(DISTINCT page) >= 2)
 SELECT k AS resume_id, r AS line_no, text FROM x WHERE NOT (edge AND (regexp_full_match(text, '(Page )?[0-9]+') OR (k, text, yb) IN (SELECT (k, text, yb) FROM a)))""")
def lay_headers(spark: SparkSession, d: str) -> DataFrame:
    part, r = F.col("l_partkey"), F.col("r")
    page = (r % 3 + 1).cast("int")
    text = F.when(part % 5 == 0, F.concat(F.lit("Page "), page)).when(part % 5 == 1, page.cast("string")).when(part % 5 == 2, F.concat(F.lit("Confidential "), "l_returnflag")).otherwise(F.concat(F.lit("text "), part))
    y0 = F.when(F.col("l_suppkey") % 3 == 0, 20.0 + r % 2).when(F.col("l_suppkey") % 3 == 1, 400.0 + r).otherwise(810.0)
    d_ = _numbered(spark, d).select(F.col("l_orderkey").alias("resume_id"), page.alias("page_no"), r.alias("line_no"), text.alias("text"), y0.alias("y0"), (y0 + 12).alias("y1"))
    pages = d_.select("resume_id", "page_no", F.lit(842.0).alias("height")).distinct()
    return layout.drop_headers(d_, pages).select("resume_id", "line_no", "text")


@query(f"""WITH {_L}, s AS (SELECT l_orderkey AS k, r // 4 AS line_no, 'p' || l_partkey AS text, CAST(r * 50 AS DOUBLE) AS x0, 9.0 + l_suppkey % 3 AS size, l_returnflag = 'R' AS bold FROM l), z AS (SELECT k, line_no, size, sum(length(text)) AS n FROM s GROUP BY 1, 2, 3)
 SELECT k AS resume_id, CAST(s.line_no AS INTEGER) AS line_no, string_agg(text, '' ORDER BY x0) AS text, min(x0) AS x0, max(x0) + 45 AS x1, 2 * coalesce(sum(length(text)) FILTER (bold), 0) > sum(length(text)) AS is_bold, any_value(font) AS font_size
 FROM s JOIN (SELECT k, line_no, arg_max(size, (n, size)) AS font FROM z GROUP BY 1, 2) USING (k, line_no) GROUP BY 1, 2""")
def src_pdf_line(spark: SparkSession, d: str) -> DataFrame:
    x0 = (F.col("r") * 50).cast("double")
    spans = _numbered(spark, d).select(F.col("l_orderkey").alias("resume_id"), F.lit(1).alias("page_no"), F.floor(F.col("r") / 4).cast("int").alias("line_no"), F.concat(F.lit("p"), "l_partkey").alias("text"), x0.alias("x0"), F.lit(10.0).alias("y0"), (x0 + 45).alias("x1"), F.lit(22.0).alias("y1"), (F.lit(9.0) + F.col("l_suppkey") % 3).alias("font_size"), (F.col("l_returnflag") == "R").alias("is_bold"))
    return layout.merge_spans(spans).select("resume_id", "line_no", "text", "x0", "x1", "is_bold", "font_size")


_LAYOUTS = "['single', 'double', 'sidebar', 'table', 'timeline']"


@query(f"""WITH {_L}, t AS (SELECT l_orderkey AS file, {_LAYOUTS}[CAST(l_orderkey % 5 + 1 AS INTEGER)] AS layout, r AS position, l_partkey * 100000 + l_suppkey * 1000 + r AS line FROM l),
 o AS (SELECT l_orderkey AS file, CASE WHEN l_orderkey % 3 = 0 THEN -r WHEN l_orderkey % 3 = 1 AND r = 2 THEN 99 ELSE r END AS position, l_partkey * 100000 + l_suppkey * 1000 + r AS line FROM l WHERE l_suppkey % 11 <> 0 OR l_orderkey % 2 = 0),
 tn AS (SELECT *, lead(line) OVER (PARTITION BY file ORDER BY position) AS nx FROM t), onx AS (SELECT *, lead(line) OVER (PARTITION BY file ORDER BY position) AS nx FROM o),
 p AS (SELECT tn.file, layout, count(*) FILTER (tn.nx IS NOT NULL AND tn.nx = onx.nx) AS ok, count(*) - 1 AS pairs, count(*) FILTER (onx.line IS NULL) AS missing FROM tn LEFT JOIN onx ON onx.file = tn.file AND onx.line = tn.line GROUP BY 1, 2),
 w AS (SELECT p.*, CASE layout WHEN 'timeline' THEN NULL ELSE layout END AS want, CASE WHEN file % 7 = 0 THEN NULL WHEN file % 4 = 0 THEN 'single' ELSE layout END AS got FROM p)
 SELECT coalesce(layout, 'all') AS layout, CAST(sum(ok) AS BIGINT) AS pairs_ok, CAST(sum(pairs) AS BIGINT) AS pairs, count(*) FILTER (ok = pairs) AS docs_ok, count(*) AS docs, CAST(sum(missing) AS BIGINT) AS missing, count(*) FILTER (got = want) AS layout_ok, count(want) AS layout_scored FROM w GROUP BY ROLLUP (layout)""")
def agg_eval_layout(spark: SparkSession, d: str) -> DataFrame:
    n = _numbered(spark, d)
    kinds = ("single", "double", "sidebar", "table", "timeline")
    k, r = F.col("l_orderkey"), F.col("r")
    kind = F.element_at(F.array(*[F.lit(x) for x in kinds]), (k % 5 + 1).cast("int"))
    line = F.col("l_partkey") * 100_000 + F.col("l_suppkey") * 1000 + r
    truth = n.select(k.alias("file"), kind.alias("layout"), r.alias("position"), line.alias("line"))
    place = F.when(k % 3 == 0, -r).when((k % 3 == 1) & (r == 2), 99).otherwise(r)
    output = n.filter("l_suppkey % 11 != 0 OR l_orderkey % 2 = 0").select(k.alias("file"), place.alias("position"), line.alias("line"))
    types = n.select(k.alias("file"), F.when(k % 7 == 0, F.lit(None)).when(k % 4 == 0, "single").otherwise(kind).alias("layout_type")).distinct()
    got = evaluation.layout_figures(truth, output, types, {x: x for x in kinds if x != "timeline"})
    return got.withColumn("layout", F.coalesce("layout", F.lit("all")))


# usage, caches, sinks


@query("SELECT count(*) AS registered FROM customer WHERE c_mktsegment = 'BUILDING'")
def agg_registered(spark: SparkSession, d: str) -> DataFrame:
    return usage.registered(table(spark, d, "customer").select(F.when(F.col("c_mktsegment") == "BUILDING", "seeker").otherwise("admin").alias("role")))


@query(f"WITH {CALLS} SELECT * FROM (SELECT {SUMS} FROM calls WHERE {USER}), (SELECT count(*) AS registered FROM customer WHERE c_mktsegment <> 'BUILDING'), (SELECT CAST(least(min(CAST(ts AS DATE)), DATE '2024-06-01') AS VARCHAR) AS first_day FROM events)")
def join_cross_kpi(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer").select(F.when(F.col("c_mktsegment") != "BUILDING", "seeker").otherwise("admin").alias("role"))
    first = usage.first_day(calls(spark, d), F.lit("2024-06-01").cast("date")).select(F.col("first_day").cast("string").alias("first_day"))
    return usage.side_by_side(usage.totals(usage.grouped(calls(spark, d))), usage.registered(users), first)


@query(f"""WITH {CALLS}, {OWNERS}, got AS (SELECT user_id, CAST(sum(cost) AS DECIMAL(20,6)) AS cost FROM calls LEFT JOIN owners USING (ref_type, ref_id) WHERE {USER} GROUP BY 1)
 SELECT CAST(row_number() OVER (ORDER BY user_id IS NULL, cost DESC, user_id) AS INTEGER) AS place, coalesce(CAST(user_id AS VARCHAR), 'nobody') AS owner FROM got""")
def srt_users(spark: SparkSession, d: str) -> DataFrame:
    got = usage.by_user(usage.grouped(calls(spark, d)), _owners(spark, d))
    return got.select(F.col("rank").alias("place"), F.coalesce(F.col("user_id").cast("string"), F.lit("nobody")).alias("owner"))


@query("""WITH p AS (SELECT event_id AS prompt_id, 'llm:match:m:v1:' || sha256(event_type || CAST(user_id % 40 AS VARCHAR)) AS k FROM events),
 c AS (SELECT 'llm:match:m:v1:' || sha256(event_type || CAST(user_id % 50 AS VARCHAR)) AS k, ts, 'reply ' || event_id AS reply FROM events WHERE user_id % 2 = 0 AND ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY), n AS (SELECT k, arg_max(reply, ts) AS reply FROM c GROUP BY 1)
 SELECT prompt_id, reply AS reply_text, reply IS NOT NULL AS cache_hit FROM p LEFT JOIN n USING (k)""")
def src_kv_cache(spark: SparkSession, d: str) -> DataFrame:
    from inkspan.functions.replies import prompt_key

    e = table(spark, d, "events")
    key = lambda n: prompt_key(F.lit("match"), F.lit("m"), F.lit("v1"), F.concat("event_type", (F.col("user_id") % n).cast("string")))
    prompts = e.select(F.col("event_id").alias("prompt_id"), key(40).alias("prompt_key"))
    cache = e.filter("user_id % 2 = 0").select(key(50).alias("prompt_key"), F.col("ts").alias("created_at"), F.concat(F.lit("reply "), "event_id").alias("reply_text"))
    return retrieval.cached_replies(prompts, cache, "2024-01-20 00:00:00").select("prompt_id", "reply_text", "cache_hit")


@query("""SELECT row_number() OVER (ORDER BY p_partkey) AS id, p_name || ' ' || p_partkey AS canonical_name, p_type AS category, concat_ws('|', p_brand, CASE WHEN p_size % 2 = 0 THEN 'tool' || p_size END) AS aliases FROM part""")
def src_csv_dict(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a dictionary file; an alias that is the name in capitals, and an empty one, are dropped on reading."""
    path = staged.new_place(spark, "skills")
    name = F.concat_ws(" ", "p_name", "p_partkey")
    rows = table(spark, d, "part").select("p_partkey", name.alias("canonical_name"), F.col("p_type").alias("category"), F.concat_ws("|", "p_brand", F.upper(name), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("tool"), "p_size")), F.lit(" ")).alias("aliases"))
    rows.coalesce(1).sortWithinPartitions("p_partkey").drop("p_partkey").write.option("header", True).csv(path)
    got = skills.load_dictionary(spark, path)
    return got.select("id", "canonical_name", "category", F.array_join("aliases", "|").alias("aliases"))


@query(f"WITH {CALLS} SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, scene, count(*) AS calls, count(*) FILTER (NOT success) AS failed FROM calls GROUP BY 1, 2")
def snk_audit(spark: SparkSession, d: str) -> DataFrame:
    """Calls are appended in two runs and read back by day."""
    path = staged.new_place(spark, "audit")
    c = calls(spark, d).select("id", "scene", "success", "created_at")
    io.append_audit(c.filter("success"), path)
    io.append_audit(c.filter("NOT success"), path)
    return spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day"), "scene").agg(F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("failed"))


@query(f"""WITH {CALLS}, {_L}, f AS (SELECT l_orderkey AS k, r, l_returnflag = 'N' AS rule, l_linenumber % 2 = 1 AS first, l_linestatus = 'F' AS failed FROM l),
 g AS (SELECT k, count(*) FILTER (rule) AS rc, count(*) FILTER (NOT rule AND first) AS lc, count(*) FILTER (NOT rule AND first AND failed) AS hc, count(*) FILTER (NOT failed) AS shown FROM f GROUP BY 1),
 t AS (SELECT ref_id, sum(token_input) AS ti FROM calls WHERE ref_type = 'resume' GROUP BY 1)
 SELECT o_orderkey AS diagnosis_id, coalesce(rc, 0) AS rule_count, coalesce(lc, 0) AS llm_count, coalesce(hc, 0) AS hallucination_count, CASE WHEN o_orderkey % 6 > 3 THEN 'partial' ELSE 'done' END AS status, CAST(coalesce(ti, 0) AS BIGINT) AS token_input,
 CAST(CASE WHEN o_orderkey % 4 = 0 THEN 50 ELSE 70 END AS INTEGER) AS overall_score, coalesce(shown, 0) AS shown FROM orders LEFT JOIN g ON k = o_orderkey LEFT JOIN t ON ref_id = o_orderkey""")
def snk_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    """All diagnoses are written with a score of 70, a quarter of them again with 50; what readers then see."""
    path = staged.new_place(spark, "diagnoses")
    f = _numbered(spark, d).select(F.col("l_orderkey").alias("diagnosis_id"), "r", F.when(F.col("l_returnflag") == "N", "rule").otherwise("llm").alias("source"), (2 - F.col("l_linenumber") % 2).alias("attempt_no"), F.when(F.col("l_linestatus") == "F", "failed").otherwise("exact").alias("verify_result"))
    f = f.withColumn("shown", F.col("verify_result") != "failed")
    k = F.col("o_orderkey")
    cases = table(spark, d, "orders").select(k.alias("diagnosis_id"), F.col("o_custkey").alias("resume_id"), F.lit(6).alias("units_total"), F.greatest(k % 6 - 3, F.lit(0)).alias("units_skipped"), F.lit(70).alias("overall_score"))
    spent = calls(spark, d).filter("ref_type = 'resume'").withColumn("ref_type", F.lit("diagnosis"))
    io.write_diagnoses(f, None, cases, spent, path)
    again = "diagnosis_id % 4 = 0"
    io.write_diagnoses(f.filter(again), None, cases.filter(again).withColumn("overall_score", F.lit(50)), spent, path)
    shown = staged.read_current(spark, f"{path}/findings").filter("shown").groupBy("diagnosis_id").agg(F.count("*").alias("shown"))
    got = staged.read_current(spark, f"{path}/diagnoses").join(shown, "diagnosis_id", "left")
    return got.select("diagnosis_id", "rule_count", "llm_count", "hallucination_count", "status", "token_input", "overall_score", F.coalesce("shown", F.lit(0)).alias("shown"))
