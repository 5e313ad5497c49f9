"""Queries for the column functions, span joins, matching, interview and evaluation operators, with DuckDB SQL.

The driver's texts are Latin-script prose, so inputs are bound in such a way that every branch of an operator occurs: list
marks, labels, degrees, years and dates are put in front of or around columns of the tables, on both sides alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.functions import dates, text
from inkspan.functions.numeric import round_exact
from inkspan.operators import evaluation, interview, listing, matching, retrieval, rules, spans, usage
from inkspan.plans.bindings import calls, lines, table
from inkspan.plans.queries import CALLS, LINES, OFFSETS, USER, query


def _pick(n: Column, *values: str) -> Column:
    """One of the values by n modulo their number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _picked(n: str, values: tuple[str, ...]) -> str:
    return f"({_list(values)})[CAST(({n}) % {len(values)} + 1 AS INTEGER)]"


def _md5(c: Column) -> Column:
    return F.md5(c.cast("binary"))


MARKS = ("", "- ", "12. ", "(3) ", "• ", "3.14 ", "Title: ", "http://x: ", "7", "Page 3 of 9", "本科 ", "mail@x.org 硕士 ", "大学 ", "上海大学 ")
MARKED = f"marked AS (SELECT doc_id, line_no, {_picked('doc_id + line_no', MARKS)} || CASE WHEN (doc_id + line_no) % 14 IN (8, 9) THEN '' ELSE line END AS line FROM ls)"


def _marked(spark: SparkSession, d: str) -> DataFrame:
    ls = lines(spark, d)
    n = F.col("doc_id") + F.col("line_no")
    return ls.select("doc_id", F.col("line_no").cast("int").alias("line_no"), F.concat(_pick(n, *MARKS), F.when(F.pmod(n, F.lit(14)).isin(8, 9), "").otherwise(F.col("line"))).alias("line"))


# text functions


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(translate(text, chr(9), ' '), '[\\x00-\\x08\\x0b-\\x1f\\x7f]', '', 'g'), '^\\s+|\\s+$', '', 'g')) AS h FROM documents")
def str_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", _md5(text.clean(F.col("text"))).alias("h"))


@query("""SELECT doc_id, md5(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), chr(10)), lambda x: trim(translate(x, chr(9), ' '))), chr(10)), '^\\n+|\\n+$', '', 'g')) AS h FROM documents""")
def str_norm_jd(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", _md5(text.normalize_job_text(F.col("text"))).alias("h"))


TITLES = ("", "1. ", "(2) ", "Part 3 ", "12)", "  ")


@query(f"SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(t)), '^(?:[0-9]{{1,2}}[.)]|[(][0-9]+[)]|part\\s*[0-9]+)', ''), '[^0-9a-z]', '', 'g') AS title FROM (SELECT p_partkey, {_picked('p_partkey', TITLES)} || p_name || '!' AS t FROM part)")
def str_norm_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.normalize_title(F.concat(_pick(F.col("p_partkey"), *TITLES), "p_name", F.lit("!"))).alias("title"))


@query("""SELECT doc_id, md5(coalesce(list_reduce(list_filter(string_split(text, chr(10)), lambda x: length(x) > 0), lambda a, x: a || CASE WHEN regexp_matches(a, '[\\x21-\\x7e]$') AND regexp_matches(x, '^[\\x21-\\x7e]') THEN ' ' ELSE '' END || x), '')) AS h
 FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[^\\n]')""")
def str_join_wrap(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter(F.col("text").rlike("[^\\n]"))
    return t.select("doc_id", _md5(text.join_wrapped(F.split("text", "\n", -1))).alias("h"))


HALF = "CAST(length(text) // 2 AS INTEGER)"


def _half() -> Column:
    return F.floor(F.length("text") / 2).cast("int")


@query(f"""SELECT doc_id, CAST(p - strpos(reverse(chr(10) || left(text, p)), chr(10)) + 1 AS INTEGER) AS line_start, CAST(p + strpos(substr(text, p + 1) || chr(10), chr(10)) - 1 AS INTEGER) AS line_end FROM (SELECT doc_id, text, {HALF} AS p FROM documents WHERE text IS NOT NULL)""")
def str_line_at(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("text is not null")
    return t.select("doc_id", text.line_start(F.col("text"), _half()).cast("int").alias("line_start"), text.line_end(F.col("text"), _half()).cast("int").alias("line_end"))


@query(f"""WITH p AS (SELECT doc_id, text, {HALF} AS p FROM documents WHERE length(text) >= 4), b AS (SELECT *, p - strpos(reverse(chr(10) || left(text, p)), chr(10)) + 1 AS a, p + 2 + strpos(substr(text, p + 3) || chr(10), chr(10)) - 1 AS z FROM p),
 c AS (SELECT *, CASE WHEN z - a > 80 THEN greatest(a, p - 40) ELSE a END AS lo FROM b)
 SELECT doc_id, CAST(lo AS INTEGER) AS lo, CAST(greatest(CASE WHEN z - a > 80 THEN least(z, lo + 80) ELSE z END, p + 2) AS INTEGER) AS hi FROM c""")
def str_line_around(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter(F.length("text") >= 4)
    return t.withColumn("s", text.line_around(F.col("text"), _half(), _half() + 2)).select("doc_id", F.col("s.start").cast("int").alias("lo"), F.col("s.end").cast("int").alias("hi"))


@query(f"""WITH p AS (SELECT doc_id, text, {HALF} AS p FROM documents WHERE text IS NOT NULL), c AS (SELECT *, p - length(regexp_extract(left(text, p), '([^，。；;,\\n]*)$', 1)) AS a, p + length(regexp_extract(substr(text, p + 1), '^([^，。；;,\\n]*)', 1)) AS z FROM p)
 SELECT doc_id, CAST(a + length(regexp_extract(substr(text, a + 1, z - a), '^( *)', 1)) AS INTEGER) AS lo, CAST(z AS INTEGER) AS hi FROM c""")
def str_clause_around(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("text is not null")
    return t.withColumn("s", text.clause_around(F.col("text"), _half())).select("doc_id", F.col("s.start").cast("int").alias("lo"), F.col("s.end").cast("int").alias("hi"))


_PREFIX = "^(?:[•·▪■◆●○◦*➢➤►▶✓☑–—-]|[0-9]{{1,2}}[、)）]|[0-9]{{1,2}}\\.|[（(][0-9]{{1,2}}[)）]|[①-⑩])?\\s*"


@query(f"""WITH {LINES}, {MARKED}, b AS (SELECT doc_id, line_no, line, CASE WHEN regexp_matches(line, '^[0-9]{{1,2}}\\.[0-9]') THEN 0 ELSE length(regexp_extract(line, '{_PREFIX.format()}')) END AS a FROM marked)
 SELECT doc_id, line_no, CAST(a AS INTEGER) AS lo, CAST(a + least(length(regexp_extract(substr(line, a + 1), '^([^。；;\\n]*)', 1)), 60) AS INTEGER) AS hi FROM b""")
def str_first_sentence(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).withColumn("s", text.first_sentence(F.col("line"))).select("doc_id", "line_no", F.col("s.start").cast("int").alias("lo"), F.col("s.end").cast("int").alias("hi"))


@query(f"WITH {LINES}, {MARKED} SELECT doc_id, line_no FROM marked WHERE regexp_matches(line, '^(?:[•·▪■◆●○◦*➢➤►▶✓☑–—-]|[0-9]{{1,2}}[.、)）]|[（(][0-9]{{1,2}}[)）]|[①-⑩])')")
def str_is_bullet(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).filter(text.is_bullet(F.col("line"))).select("doc_id", "line_no")


@query(f"WITH {LINES}, {MARKED} SELECT doc_id, line_no FROM marked WHERE regexp_matches(line, '^[^\\s：:，。、,；;()（）]{{2,16}}[：:]') AND NOT regexp_matches(line, '^[0-9]+[：:]') AND NOT regexp_matches(line, '^[A-Za-z]+://')")
def str_is_label(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).filter(text.is_label(F.col("line"))).select("doc_id", "line_no")


@query(f"WITH {LINES}, {MARKED} SELECT doc_id, line_no FROM marked WHERE regexp_matches(lower(line), '^\\s*(?:第?\\s*[0-9]+\\s*页?|[0-9]+\\s*/\\s*[0-9]+|-\\s*[0-9]+\\s*-|page\\s*[0-9]+(?:\\s*of\\s*[0-9]+)?)\\s*$')")
def str_is_pageno(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).filter(text.is_page_number(F.col("line"))).select("doc_id", "line_no")


@query(f"WITH {LINES}, {MARKED} SELECT doc_id, line_no FROM marked WHERE regexp_matches(line, '(?i)[一-鿿]{{2,}}(?:大学|学院)|本科|硕士|博士|研究生|专科|大专|学士|university|college') AND NOT regexp_matches(line, '@|[0-9]{{3}}[- ]?[0-9]{{4}}[- ]?[0-9]{{4}}|现居|所在地|居住地|住址|地址|籍贯')")
def str_edu_hint(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).filter(text.looks_like_education(F.col("line"))).select("doc_id", "line_no")


KINDS = ("Intern at ", "实习 ", "Campus ", "学生会 ", "Activities of ", "Engineer ", "Leadership ")


@query(f"SELECT p_partkey, CASE WHEN contains(t, '实习') OR contains(t, 'intern') THEN 'internship' WHEN regexp_matches(t, '校园|在校|校内|学生|社团|实践|campus|activit|leadership') THEN 'campus' ELSE 'work' END AS kind FROM (SELECT p_partkey, lower({_picked('p_partkey', KINDS)} || p_name) AS t FROM part)")
def str_work_kind(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.work_kind(F.concat(_pick(F.col("p_partkey"), *KINDS), "p_name")).alias("kind"))


DEGREE_TEXTS = ("本科及以上", "Master or PhD", "硕士研究生", "博士研究生", "大专", "none", "Bachelor", "本科或硕士")
DEGREE_WORDS = ("本科", "MASTER", "研究生", "博士研究生", "大专", "none", "Bachelor", "硕士", "Ph.D", "学士", "专科")


def _asks(a: str, b: str) -> Column:
    """A part's name with two words of the list, one chosen by each key, and its type."""
    word = lambda k: F.element_at(F.array(*[F.lit(w) for w in DEGREE_WORDS]), (F.col(k) % len(DEGREE_WORDS) + 1).cast("int"))
    return F.concat_ws(" ", "p_name", word(a), F.lit("或"), word(b), F.col("p_type"))


_ASKS = lambda a, b: f"p_name || ' ' || ({list(DEGREE_WORDS)!r})[CAST({a} % {len(DEGREE_WORDS)} + 1 AS INTEGER)] || ' 或 ' || ({list(DEGREE_WORDS)!r})[CAST({b} % {len(DEGREE_WORDS)} + 1 AS INTEGER)] || ' ' || p_type"
_FOUND_LEVELS = lambda t: f"list_filter([CASE WHEN regexp_matches({t}, '博士|(?i:ph\\.?d)') THEN 4 END, CASE WHEN regexp_matches(replace({t}, '博士研究生', ''), '硕士|研究生|(?i:master)') THEN 3 END, CASE WHEN regexp_matches({t}, '本科|学士|(?i:bachelor)') THEN 2 END, CASE WHEN regexp_matches({t}, '大专|专科') THEN 1 END], lambda x: x IS NOT NULL)"


@query(f"WITH t AS (SELECT p_partkey, {_ASKS('p_partkey', 'p_size')} AS said FROM part) SELECT p_partkey, said, array_to_string({_FOUND_LEVELS('said')}, ',') AS levels FROM t")
def str_degree_levels(spark: SparkSession, d: str) -> DataFrame:
    said = _asks("p_partkey", "p_size")
    levels = F.array_join(F.transform(text.degree_levels(said), lambda x: x.cast("string")), ",")
    return table(spark, d, "part").select("p_partkey", said.alias("said"), levels.alias("levels"))


@query(f"WITH t AS (SELECT p_partkey, {_ASKS('p_partkey', 'p_partkey')} AS said, {_ASKS('p_size', 'p_partkey')} AS quoted FROM part) SELECT p_partkey, CAST(coalesce(list_min({_FOUND_LEVELS('said')}), list_min({_FOUND_LEVELS('quoted')}), 0) AS INTEGER) AS level FROM t")
def agg_min_degree(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.required_degree(_asks("p_partkey", "p_partkey"), _asks("p_size", "p_partkey")).alias("level"))


YEAR_TEXTS = ("3 年以上经验", "3-5年", "2023 年毕业", "20年", "1 至 3 年", "no years", "15年")


@query("""WITH t AS (SELECT p_partkey, p_name || ' ' || CASE p_partkey % 5 WHEN 0 THEN p_size || ' 年以上经验' WHEN 1 THEN p_size || '-' || (p_size + 2) || '年' WHEN 2 THEN '20' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '年毕业' WHEN 3 THEN p_size || ' years' ELSE p_size || ' 至 ' || (p_size + 9) || ' 年' END AS said FROM part),
 n AS (SELECT *, TRY_CAST(regexp_extract(said, '(^|[^0-9])([0-9]{1,2})(\\s*[-至]\\s*[0-9]{1,2})?\\s*年', 2) AS INTEGER) AS y FROM t) SELECT p_partkey, said, CASE WHEN y BETWEEN 1 AND 15 THEN y END AS years FROM n""")
def str_years_req(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey") % 5, F.col("p_size")
    form = F.when(k == 0, F.concat(n, F.lit(" 年以上经验"))).when(k == 1, F.concat(n, F.lit("-"), n + 2, F.lit("年"))).when(k == 2, F.concat(F.lit("20"), F.lpad(n.cast("string"), 2, "0"), F.lit("年毕业"))).when(k == 3, F.concat(n, F.lit(" years"))).otherwise(F.concat(n, F.lit(" 至 "), n + 9, F.lit(" 年")))
    said = F.concat_ws(" ", "p_name", form)
    return table(spark, d, "part").select("p_partkey", said.alias("said"), text.required_years(said, F.lit("")).alias("years"))


@query("SELECT p_partkey, length(regexp_replace(replace(lower(p_name || ' ' || p_brand), lower(p_name), ''), '\\s+', '', 'g')) <= 6 AS plain FROM part")
def str_plain_skill(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.is_plain_skill(F.concat_ws(" ", "p_name", "p_brand"), F.col("p_name")).alias("plain"))


@query(f"WITH {CALLS} SELECT id, regexp_replace(error_msg, 'sk-[A-Za-z0-9_-]{{8,}}', 'sk-***', 'g') AS shown, CASE WHEN length(error_msg) >= 12 THEN left(error_msg, 3) || '…' || right(error_msg, 4) ELSE '…' END AS hint FROM calls WHERE error_msg IS NOT NULL")
def str_redact_key(spark: SparkSession, d: str) -> DataFrame:
    return calls(spark, d).filter("error_msg is not null").select("id", text.redact_keys(F.col("error_msg")).alias("shown"), text.key_hint(F.col("error_msg")).alias("hint"))


@query("SELECT p_partkey, CASE WHEN q IS NULL OR q = '' OR contains(p_name, q) THEN p_name ELSE p_name || '（' || q || '）' END AS asked FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN left(p_name, 5) WHEN 2 THEN '' END AS q FROM part)")
def str_requirement_query(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey") % 4
    q = F.when(n == 0, F.col("p_brand")).when(n == 1, F.left("p_name", F.lit(5))).when(n == 2, "")
    return table(spark, d, "part").select("p_partkey", text.requirement_query(F.col("p_name"), q).alias("asked"))


@query("SELECT page_id, CASE WHEN t = '' THEN '简历' ELSE t END AS title FROM (SELECT page_id, left(trim(regexp_replace(regexp_replace(url, '^.*[/\\\\]', ''), '(?i)\\.pdf$', '')), 200) AS t FROM (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '/' ELSE '' END AS url FROM pages))")
def str_display_title(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id") % 3
    return table(spark, d, "pages").select("page_id", text.display_title(F.concat("url", F.when(n == 0, ".PDF").when(n == 1, "/").otherwise(""))).alias("title"))


# dates and numbers


_DATED = """said AS (SELECT *, o_orderdate + INTERVAL 400 DAY AS later, o_orderstatus || o_orderpriority || CASE WHEN o_custkey % 2 = 0 THEN ' joined in ' ELSE ' ' END AS head FROM orders),
 form AS (SELECT *, CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y.') || month(o_orderdate) || ' - ' || strftime(later, '%Y/%m') WHEN 1 THEN strftime(o_orderdate, '%Y年') || month(o_orderdate) || '月至今' WHEN 2 THEN strftime(o_orderdate, '%Y.%m') || '~' || year(later) WHEN 3 THEN strftime(o_orderdate, '%b %Y')
  WHEN 4 THEN strftime(o_orderdate, '%b %Y') || ' to present' WHEN 5 THEN CAST(year(o_orderdate) AS VARCHAR) ELSE year(o_orderdate) || ' 到 ' || year(later) END AS dates FROM said), dated AS (SELECT *, head || dates || ' ' || o_custkey || 'x' AS line FROM form)"""
# months of a year and the year, read from the text: numbers after a year, or the name before it
_MONTHED = """ys AS (SELECT *, regexp_extract_all(dates, '(19|20)[0-9]{2}') AS ys, regexp_extract_all(dates, '(?:19|20)[0-9]{2}[./年]([0-9]{1,2})', 1) AS ms, list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(regexp_extract(dates, '[A-Z][a-z]{2}'))) AS named, regexp_matches(dates, '至今|present') AS present FROM dated),
 m AS (SELECT *, coalesce(lpad(ms[1], 2, '0'), lpad(CAST(named AS VARCHAR), 2, '0')) AS m1, lpad(ms[2], 2, '0') AS m2, len(ys) = 1 AND NOT present AND named IS NULL AND ms[1] IS NULL AS bare FROM ys)"""


@query(f"""WITH {_DATED}, {_MONTHED} SELECT o_orderkey, CASE WHEN bare THEN NULL WHEN m1 IS NOT NULL AND (present OR len(ys) = 1 OR m2 IS NOT NULL) THEN ys[1] || '-' || m1 ELSE ys[1] END AS start_, CASE WHEN len(ys) < 2 THEN NULL WHEN m1 IS NOT NULL AND m2 IS NOT NULL THEN ys[2] || '-' || m2 ELSE ys[2] END AS end_,
 CASE WHEN bare THEN NULL ELSE present END AS is_present, CASE WHEN bare THEN NULL ELSE CAST(strpos(line, dates) - 1 AS INTEGER) END AS lo, CASE WHEN bare THEN NULL ELSE CAST(strpos(line, dates) - 1 + length(dates) AS INTEGER) END AS hi FROM m""")
def dt_find_range(spark: SparkSession, d: str) -> DataFrame:
    """Seven ways to write dates, behind heads of many lengths."""
    r = dates.find_date_range(_dated_line())
    return table(spark, d, "orders").withColumn("r", r).select("o_orderkey", F.col("r.start").alias("start_"), F.col("r.end").alias("end_"), F.col("r.is_present").alias("is_present"), F.col("r.span_start").cast("int").alias("lo"), F.col("r.span_end").cast("int").alias("hi"))


def _dated_form() -> Column:
    a, b, k = F.col("o_orderdate"), F.date_add(F.to_date("o_orderdate"), 400), F.col("o_orderkey") % 7
    said = F.when(k == 0, F.concat(F.date_format(a, "yyyy.M"), F.lit(" - "), F.date_format(b, "yyyy/MM"))).when(k == 1, F.concat(F.date_format(a, "yyyy年M月"), F.lit("至今"))).when(k == 2, F.concat(F.date_format(a, "yyyy.MM"), F.lit("~"), F.date_format(b, "yyyy"))).when(k == 3, F.date_format(a, "MMM yyyy"))
    return said.when(k == 4, F.concat(F.date_format(a, "MMM yyyy"), F.lit(" to present"))).when(k == 5, F.date_format(a, "yyyy")).otherwise(F.concat(F.date_format(a, "yyyy"), F.lit(" 到 "), F.date_format(b, "yyyy")))


def _dated_line() -> Column:
    head = F.concat("o_orderstatus", "o_orderpriority", F.when(F.col("o_custkey") % 2 == 0, " joined in ").otherwise(" "))
    return F.concat(head, _dated_form(), F.lit(" "), "o_custkey", F.lit("x"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST((year(b) - year(o_orderdate)) * 12 + month(b) - month(o_orderdate) AS INTEGER) END AS months FROM (SELECT *, o_orderdate + INTERVAL (o_orderkey % 900) DAY AS b FROM orders)")
def dt_months_between(spark: SparkSession, d: str) -> DataFrame:
    b = F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 900).cast("int"))
    later = F.when(F.col("o_orderkey") % 5 == 0, F.date_format(b, "yyyy")).otherwise(F.date_format(b, "yyyy-MM"))
    return table(spark, d, "orders").select("o_orderkey", dates.months_between(F.date_format("o_orderdate", "yyyy-MM"), later).alias("months"))


@query(f"WITH {_DATED}, l AS (SELECT o_orderkey, dates, dates || ' ' || o_orderpriority || CASE WHEN o_custkey % 3 = 0 THEN '' ELSE ' ' || o_custkey || o_orderstatus END AS line FROM form) SELECT o_orderkey, line FROM l WHERE 2 * length(dates) >= length(line) AND NOT regexp_full_match(dates, '[0-9]{{4}}')")
def dt_is_date_line(spark: SparkSession, d: str) -> DataFrame:
    more = F.when(F.col("o_custkey") % 3 == 0, "").otherwise(F.concat(F.lit(" "), "o_custkey", "o_orderstatus"))
    line = F.concat(_dated_form(), F.lit(" "), "o_orderpriority", more)
    return table(spark, d, "orders").filter(dates.is_date_line(line)).select("o_orderkey", line.alias("line"))


@query("SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) - 29, '%Y-%m-%d') AS start FROM orders")
def dt_window_start(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", dates.window_start(F.to_date("o_orderdate"), 30).cast("string").alias("start"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(format('{:.1f}', x) AS DECIMAL(12,1)) AS r1, CAST(format('{:.2f}', x) AS DECIMAL(12,2)) AS r2 FROM (SELECT *, l_extendedprice / 32 AS x FROM lineitem)")
def math_round(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("l_extendedprice") / 32
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", round_exact(x, 1).cast("decimal(12,1)").alias("r1"), round_exact(x, 2).cast("decimal(12,2)").alias("r2"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(CASE WHEN w > 0 THEN greatest(least(a + 20, b + w) - greatest(a, b), 0) / w ELSE 0 END, 6) AS DECIMAL(9,6)) AS shared FROM (SELECT *, CAST(l_quantity AS INTEGER) AS a, l_linenumber * 6 AS b, least(20, l_linenumber * 3 - 3) AS w FROM lineitem)")
def math_overlap_1d(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("l_quantity").cast("int"), F.col("l_linenumber") * 6
    w = F.least(F.lit(20), F.col("l_linenumber") * 3 - 3)
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(spans.overlap_ratio(a, a + 20, b, b + w), 6).cast("decimal(9,6)").alias("shared"))


@query("SELECT a.vec_id, CAST(round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS DECIMAL(9,6)) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def math_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", F.round(retrieval.cosine(F.col("embedding"), F.col("other")), 6).cast("decimal(9,6)").alias("similarity"))


# spans

_SPANS = "s AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS q, l_returnflag AS category, CAST(l_quantity AS INTEGER) AS a, CAST(l_quantity AS INTEGER) + l_linenumber * 2 AS b, l_linestatus = 'F' AS rule FROM lineitem)"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("l_quantity").cast("int")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("q"), F.col("l_returnflag").alias("category"), a.alias("char_start"), (a + F.col("l_linenumber") * 2).alias("char_end"), (F.col("l_linestatus") == "F").alias("rule"))


@query(f"WITH {_SPANS} SELECT x.k, x.n, x.p, x.q, y.n AS m, y.p AS p2, y.q AS q2 FROM s x JOIN s y ON x.k = y.k AND x.n < y.n AND x.a < y.b AND y.a < x.b")
def join_overlap(spark: SparkSession, d: str) -> DataFrame:
    x = _spans(spark, d)
    y = x.select(F.col("k"), F.col("n").alias("m"), F.col("p").alias("p2"), F.col("q").alias("q2"), F.col("char_start").alias("s"), F.col("char_end").alias("e"))
    return x.join(y, "k").filter((F.col("n") < F.col("m")) & spans.overlaps(F.col("char_start"), F.col("char_end"), F.col("s"), F.col("e"))).select("k", "n", "p", "q", "m", "p2", "q2")


@query(f"WITH {_SPANS} SELECT k, n, p, q FROM s x WHERE NOT rule AND NOT EXISTS (SELECT 1 FROM s y WHERE y.rule AND y.k = x.k AND y.category = x.category AND greatest(least(x.b, y.b) - greatest(x.a, y.a), 0) >= 0.5 * least(x.b - x.a, y.b - y.a))")
def join_anti_dup(spark: SparkSession, d: str) -> DataFrame:
    s = _spans(spark, d)
    return spans.drop_duplicates_of(s.filter("not rule"), s.filter("rule"), "k").select("k", "n", "p", "q")


@query(f"WITH {_SPANS} SELECT o_orderkey, coalesce((SELECT arg_min(category, (a, n, p, q)) FROM s WHERE k = o_orderkey AND a <= o_orderkey % 50 AND o_orderkey % 50 < b), 'other') AS type FROM orders")
def join_section_at(spark: SparkSession, d: str) -> DataFrame:
    per = _spans(spark, d).groupBy(F.col("k").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct("char_start", "n", "p", "q", "char_end", F.col("category").alias("type")))).alias("sections"))
    o = table(spark, d, "orders").select("o_orderkey").join(per, "o_orderkey", "left")
    return o.select("o_orderkey", F.coalesce(spans.section_at(F.col("sections"), F.col("o_orderkey") % 50), F.lit("other")).alias("type"))


@query("""WITH c AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), r AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM c)
 SELECT conv_id, CAST(run AS BIGINT) AS run, min(turn) AS first, max(turn) AS last, count(*) AS n, min(role) AS role FROM r GROUP BY 1, 2""")
def win_runs(spark: SparkSession, d: str) -> DataFrame:
    return spans.runs(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role")


@query(f"WITH {OFFSETS} SELECT doc_id, line_no, char_start, CAST(char_start + length(line) AS INTEGER) AS char_end FROM offs")
def win_offsets_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(spark, d).select("doc_id", "line_no", "line")
    return spans.offsets_by_window(rows, "doc_id", "line_no", "line").select("doc_id", F.col("line_no").cast("int").alias("line_no"), F.col("char_start").cast("int").alias("char_start"), F.col("char_end").cast("int").alias("char_end"))


# lists


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 7 AND c_acctbal >= 0")
def flt_owned(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("user_id"), (F.col("c_acctbal") < 0).alias("is_deleted"))
    return listing.owned(c, 7).select("c_custkey")


@query(f"WITH {CALLS} SELECT id FROM calls WHERE {USER}")
def flt_user_calls(spark: SparkSession, d: str) -> DataFrame:
    return usage.user_calls(calls(spark, d)).select("id")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN coalesce(p, CASE WHEN o_orderkey % 2 = 0 THEN 'interrupted, please retry' END, 'failed, please retry') END AS message FROM (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN 'scanned' END AS p FROM orders)")
def case_failure(spark: SparkSession, d: str) -> DataFrame:
    error = F.when(F.col("o_orderkey") % 2 == 0, "interrupted by restart").otherwise("timeout")
    status = F.when(F.col("o_orderstatus") == "O", "failed").otherwise("done")
    return table(spark, d, "orders").select("o_orderkey", listing.failure_of(status, error, F.when(F.col("o_orderkey") % 5 == 0, "scanned")).alias("message"))


@query("SELECT l_orderkey, CAST(CASE WHEN n > 0 THEN round(h / n, 3) END AS DECIMAL(5,3)) AS rate FROM (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS h, count(*) FILTER (l_linestatus = 'F') AS n FROM lineitem GROUP BY 1)")
def case_intercept_rate(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("h"), F.count_if(F.col("l_linestatus") == "F").alias("n"))
    return g.select("l_orderkey", listing.intercept_rate(F.col("h"), F.col("n")).cast("decimal(5,3)").alias("rate"))


@query("SELECT o_orderkey, coalesce(x >= 60, false) AS passed FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice / 5000 END AS x FROM orders)")
def case_gate(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice") / 5000)
    return table(spark, d, "orders").select("o_orderkey", listing.passes_gate(x).alias("passed"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def win_cap(spark: SparkSession, d: str) -> DataFrame:
    return listing.first_n(table(spark, d, "orders"), ["o_custkey"], 3, F.col("o_totalprice").desc(), "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY t, CASE WHEN t THEN c_custkey ELSE -c_custkey END) AS BIGINT) AS place FROM (SELECT c_custkey, c_mktsegment = 'MACHINERY' AS t FROM customer) ORDER BY place LIMIT 100")
def srt_jobs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_mktsegment") == "MACHINERY").alias("is_template"))
    first = listing.order_jobs(c).limit(100)  # one page of a list
    return first.select(F.col("id").alias("c_custkey"), "is_template").withColumn("place", F.expr("row_number() over (order by is_template, if(is_template, c_custkey, -c_custkey))").cast("long")).drop("is_template")


@query("SELECT l_orderkey AS report_id, l_linenumber, l_partkey, l_suppkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY w DESC, r, id) AS INTEGER) AS position FROM (SELECT *, CASE l_linestatus WHEN 'F' THEN 1.0 ELSE 0.5 END AS w, CASE l_returnflag WHEN 'N' THEN 0 ELSE 1 END AS r, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS id FROM lineitem WHERE l_returnflag <> 'R')")
def srt_gaps(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "R", "hit").when(F.col("l_returnflag") == "A", "partial").otherwise("miss")
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("report_id"), "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_linenumber").cast("long") * 1000000000000 + F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("requirement_id"), F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.5).alias("weight"), status.alias("status"))
    return listing.gap_items(i).select("report_id", "l_linenumber", "l_partkey", "l_suppkey", "position")


@query("SELECT o_custkey AS user_id, count(*) AS applies, count(DISTINCT o_orderkey) AS resumes FROM orders GROUP BY 1")
def join_activity_users(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return usage.activity(o.select(F.col("o_orderkey").alias("resume_id")), o.select(F.col("o_orderkey").alias("resume_id"), F.col("o_custkey").alias("user_id")))


# matching


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Requirements of orders: skills (part numbers), degrees, years, others."""
    n = F.col("l_linenumber") % 4
    category = F.when(n == 0, "skill").when(n == 1, "education").when(n == 2, "experience").otherwise("other")
    content = F.when(n == 1, _pick(F.col("l_suppkey"), *DEGREE_TEXTS)).when(n == 2, _pick(F.col("l_suppkey"), *YEAR_TEXTS)).otherwise("skill")
    rid = F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("report_id"), rid.alias("requirement_id"), category.alias("category"), content.alias("content"), F.lit("").alias("quote"), (F.col("l_partkey") % 7).alias("skill_id"), F.lit("skill").alias("skill")).dropDuplicates(["report_id", "requirement_id"])


_ASKED = "asked AS (SELECT DISTINCT l_orderkey AS report_id, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS requirement_id, l_linenumber % 4 AS kind, l_suppkey, l_partkey % 7 AS skill_id FROM lineitem)"
_NEED = f"CAST(({['2', '3', '3', '4', '1', None, '2', '2']!r})[CAST(l_suppkey % 8 + 1 AS INTEGER)] AS INTEGER)".replace("None", "NULL")


@query(f"""WITH {_ASKED}, m AS (SELECT l_orderkey AS report_id, l_suppkey % 7 AS skill_id, l_returnflag = 'R' AS used, CAST(l_quantity AS INTEGER) AS a FROM lineitem), b AS (SELECT report_id, skill_id, bool_or(used) AS used, coalesce(min(a) FILTER (used), min(a)) AS a FROM m GROUP BY 1, 2)
 SELECT report_id, requirement_id, CASE WHEN used THEN 'hit' ELSE 'partial' END AS status, a AS char_start FROM asked JOIN b USING (report_id, skill_id) WHERE kind = 0""")
def match_skill(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("l_quantity").cast("int")
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("report_id"), (F.col("l_suppkey") % 7).alias("skill_id"), F.when(F.col("l_returnflag") == "R", "work").otherwise("skills").alias("section_type"), a.alias("char_start"), (a + 3).alias("char_end"))
    return matching.match_skills(_asked(spark, d), m).select("report_id", "requirement_id", "status", "char_start")


def _degrees(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter("o_orderkey % 5 != 0").select(F.col("o_orderkey").alias("report_id"), F.lit(0).alias("ordinal"), _pick(F.col("o_orderkey"), "大专", "本科", "硕士", "高中").alias("degree"), F.lit(3).alias("char_start"), F.lit(9).alias("char_end"))


@query(f"""WITH {_ASKED} SELECT report_id, requirement_id, CASE WHEN o_orderkey % 4 + 1 >= {_NEED} THEN 'hit' ELSE 'miss' END AS status FROM asked JOIN orders ON o_orderkey = report_id WHERE kind = 1 AND o_orderkey % 5 <> 0 AND o_orderkey % 4 <> 3 AND {_NEED} IS NOT NULL""")
def match_education(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_education(_asked(spark, d), _degrees(spark, d)).select("report_id", "requirement_id", "status")


@query("SELECT o_custkey AS report_id, CAST(format('{:.1f}', count(DISTINCT m) / 12) AS DECIMAL(6,1)) AS years FROM (SELECT o_custkey, unnest(range(year(o_orderdate) * 12 + month(o_orderdate), year(o_orderdate) * 12 + month(o_orderdate) + 5)) AS m FROM orders WHERE o_orderpriority <> '5-LOW') GROUP BY 1")
def match_years_of_work(spark: SparkSession, d: str) -> DataFrame:
    return matching.experience_years(_work(spark, d), "2024-01-01").select("report_id", F.col("years").cast("decimal(6,1)").alias("years"))


def _work(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    end = F.date_format(F.add_months(F.to_date("o_orderdate"), 5), "yyyy-MM")
    return o.select(F.col("o_custkey").alias("report_id"), F.when(F.col("o_orderpriority") == "5-LOW", "campus").otherwise("work").alias("kind"), F.date_format("o_orderdate", "yyyy-MM").alias("start"), end.alias("end"), F.lit(False).alias("is_present"))


@query("SELECT o_orderkey AS report_id, CASE WHEN y >= n THEN 'hit' WHEN y >= n / 2 THEN 'partial' ELSE 'miss' END AS status FROM (SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 6 <> 0 THEN (o_orderkey % 40) / 10 END, 0.0) AS y, ([3, 3, NULL, NULL, 1, NULL, 15])[CAST(o_orderkey % 7 + 1 AS INTEGER)] AS n FROM orders) WHERE n IS NOT NULL")
def match_years(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    asked = o.select(F.col("o_orderkey").alias("report_id"), F.lit(1).alias("requirement_id"), F.lit("experience").alias("category"), _pick(F.col("o_orderkey"), *YEAR_TEXTS).alias("content"), F.lit("").alias("quote"))
    years = o.filter("o_orderkey % 6 != 0").select(F.col("o_orderkey").alias("report_id"), ((F.col("o_orderkey") % 40) / 10).alias("years"))
    return matching.match_years(asked, years).select("report_id", "status")


@query("SELECT o_orderkey AS report_id, CASE WHEN o_orderkey % 3 <> 2 AND o_orderkey % 4 <> 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'hit' ELSE 'partial' END ELSE 'miss' END AS status, CAST(CASE WHEN o_orderkey % 3 <> 2 AND o_orderkey % 4 <> 0 THEN 7 END AS INTEGER) AS char_start FROM orders")
def join_req_judge(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), F.lit(1).alias("requirement_id"))
    k = F.col("report_id")
    answers = o.filter(k % 3 != 2).select("*", F.when(k % 3 == 0, "hit").otherwise("partial").alias("status"), F.when(k % 4 != 0, F.lit(7)).alias("char_start"), F.when(k % 4 != 0, F.lit(9)).alias("char_end"))
    return matching.apply_judgements(o, answers).select("report_id", "status", "char_start")


# interview


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round_even((a + b + c) / 3 * 20, 0) AS INTEGER) AS score FROM (SELECT *, l_linenumber % 6 AS a, l_partkey % 6 AS b, l_suppkey % 6 AS c FROM lineitem)")
def agg_turn_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", interview.turn_score(F.col("l_linenumber") % 6, F.col("l_partkey") % 6, F.col("l_suppkey") % 6).alias("score"))


@query("SELECT c_custkey AS session_id, CAST(coalesce(round_even(avg(s), 0), 0) AS INTEGER) AS overall, count(s) AS reached FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey % 101 AS s FROM orders) ON o_custkey = c_custkey GROUP BY 1")
def agg_overall_score(spark: SparkSession, d: str) -> DataFrame:
    topics = table(spark, d, "orders").select(F.col("o_custkey").alias("session_id"), (F.col("o_orderkey") % 101).alias("topic_score"))
    return interview.overall_scores(table(spark, d, "customer").select(F.col("c_custkey").alias("session_id")), topics)


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'finish' WHEN o_orderkey % 7 <> 0 AND o_orderstatus = 'O' AND o_orderkey % 4 < 2 THEN 'followup' ELSE 'next' END AS action FROM orders")
def iv_policy(spark: SparkSession, d: str) -> DataFrame:
    decision = F.when(F.col("o_orderstatus") == "O", "followup").otherwise("next")
    return table(spark, d, "orders").select("o_orderkey", interview.decide(F.col("o_orderkey") % 7 == 0, decision, F.col("o_orderkey") % 4, F.lit(2), F.col("o_totalprice"), F.lit(300000)).alias("action"))


def _topics(spark: SparkSession, d: str) -> DataFrame:
    """Turn numbers of a conversation as topics of a session."""
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("topic_idx"), F.when(F.col("turn") % 2 == 0, "finding").otherwise("experience").alias("source"))


@query("SELECT c.conv_id, c.turn FROM conversations c LEFT JOIN (SELECT conv_id, max(turn) AS far FROM conversations WHERE role = 'user' AND turn < 3 GROUP BY 1) f ON f.conv_id = c.conv_id WHERE c.conv_id % 3 = 0 OR c.turn <= coalesce(far, -1)")
def flt_reached_topics(spark: SparkSession, d: str) -> DataFrame:
    plan = _topics(spark, d)
    turns = table(spark, d, "conversations").filter("role = 'user' AND turn < 3").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("topic_idx"))
    sessions = plan.select("session_id").distinct().withColumn("status", F.when(F.col("session_id") % 3 == 0, "finished").otherwise("in_progress"))
    return interview.reached_topics(plan, turns, sessions).select(F.col("session_id").alias("conv_id"), F.col("topic_idx").alias("turn"))


@query("SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 OR conv_id % 5 = 0 THEN role END AS evaluation FROM conversations")
def flt_hide_eval(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("conv_id") % 3 == 0, "finished").otherwise("in_progress")
    mode = F.when(F.col("conv_id") % 5 == 0, "practice").otherwise("real")
    return table(spark, d, "conversations").select("conv_id", "turn", interview.shown_evaluation(status, mode, F.col("role")).alias("evaluation"))


@query("SELECT user_id FROM (SELECT user_id, max(ts) AS t FROM events GROUP BY 1) WHERE user_id % 3 <> 0 AND t < TIMESTAMP '2024-01-30 12:00:00'")
def flt_idle(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_active_at"), F.min("ts").alias("created_at"))
    s = s.withColumn("status", F.when(F.col("user_id") % 3 == 0, "finished").when(F.col("user_id") % 3 == 1, "created").otherwise("in_progress"))
    return interview.idle_sessions(s, "2024-01-31 12:00:00").select("user_id")


@query("SELECT conv_id AS session_id, turn AS topic_idx FROM conversations WHERE turn % 2 = 0 AND (conv_id * 7 + turn * 13) % 100 < 60")
def iv_links(spark: SparkSession, d: str) -> DataFrame:
    t = _topics(spark, d)
    scores = t.select("session_id", "topic_idx", ((F.col("session_id") * 7 + F.col("topic_idx") * 13) % 100).alias("topic_score"))
    return interview.weak_links(t, scores).select("session_id", "topic_idx")


@query("SELECT session_id, source, ref, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ordinal) - 1 AS INTEGER) AS topic_idx FROM (SELECT *, row_number() OVER (PARTITION BY session_id, source, ref ORDER BY ordinal) AS n FROM (SELECT conv_id AS session_id, turn AS ordinal, CASE WHEN turn % 2 = 0 THEN 'finding' ELSE 'experience' END AS source, 'F' || (turn // 3) AS ref FROM conversations) WHERE ref <> 'F1') WHERE n = 1 QUALIFY topic_idx < 2")
def iv_plan_verify(spark: SparkSession, d: str) -> DataFrame:
    t = _topics(spark, d).select("session_id", F.col("topic_idx").alias("ordinal"), "source", F.concat(F.lit("F"), F.floor(F.col("topic_idx") / 3).cast("string")).alias("ref"))
    m = t.filter("ref != 'F1'").select("session_id", "source", F.col("ref").alias("code")).distinct()
    return interview.verify_plan(t, m, 2).select("session_id", "source", "ref", "topic_idx")


# rules and evaluation


@query("""SELECT l_orderkey AS resume_id, 'ats' AS category, 'low' AS severity FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'R' AND l_quantity > 40) + count(*) FILTER (l_tax > 0.07) + count(*) FILTER (l_discount > 0.09 AND l_linestatus = 'F') > 0""")
def rule_ATS_UNFRIENDLY(spark: SparkSession, d: str) -> DataFrame:  # noqa: N802
    """A page's line items are its drawn objects: pictures, text boxes and drawings by their figures."""
    drawn = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("resume_id"))
    s = drawn.agg(F.nullif(F.count_if((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40)), F.lit(0)).alias("images"), F.count_if(F.col("l_tax") > 0.07).alias("textboxes"), F.count_if((F.col("l_discount") > 0.09) & (F.col("l_linestatus") == "F")).alias("drawings"))
    return rules.ats_unfriendly(s).select("resume_id", "category", "severity")


@query("SELECT doc_id, line_no, skipped FROM (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n, CAST(greatest(count(*) OVER (PARTITION BY doc_id) - 3, 0) AS BIGINT) AS skipped FROM (SELECT doc_id, CAST(unnest(range(0, len(string_split(text, chr(10))))) AS INTEGER) AS line_no FROM documents)) WHERE n <= 3")
def diag_plan(spark: SparkSession, d: str) -> DataFrame:
    u = lines(spark, d).select(F.col("doc_id").alias("resume_id"), F.concat(F.lit("work["), F.col("line_no").cast("string"), F.lit("]")).alias("unit_id"), "line_no", "char_start")
    got = rules.affordable_units(u, budget=0.0095, unit_cost=0.002, reserve=1.5)
    return got.select(F.col("resume_id").alias("doc_id"), F.col("line_no").cast("int").alias("line_no"), F.col("skipped").cast("long").alias("skipped"))


@query("""WITH f AS (SELECT l_orderkey AS k, l_returnflag = 'N' AS rule, l_linenumber % 2 = 1 AS first, l_linestatus = 'F' AS failed FROM lineitem), g AS (SELECT k, count(*) FILTER (rule) AS r, count(*) FILTER (NOT rule AND first) AS l, count(*) FILTER (NOT rule AND first AND failed) AS h FROM f GROUP BY 1)
 SELECT o_orderkey AS diagnosis_id, coalesce(r, 0) AS rule_count, coalesce(l, 0) AS llm_count, coalesce(h, 0) AS hallucination_count, CASE WHEN o_orderkey % 6 > 3 THEN 'partial' ELSE 'done' END AS status FROM orders LEFT JOIN g ON k = o_orderkey""")
def agg_diag_counters(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("diagnosis_id"), F.when(F.col("l_returnflag") == "N", "rule").otherwise("llm").alias("source"), (2 - F.col("l_linenumber") % 2).alias("attempt_no"), F.when(F.col("l_linestatus") == "F", "failed").otherwise("exact").alias("verify_result"))
    skipped = table(spark, d, "orders").select(F.col("o_orderkey").alias("diagnosis_id"), F.greatest(F.col("o_orderkey") % 6 - 3, F.lit(0)).alias("units_skipped"))
    return rules.diagnosis_counters(f, skipped).drop("units_skipped")


@query("""WITH t AS (SELECT o_orderkey AS file, o_orderstatus AS defect, CAST(o_orderkey % 40 AS INTEGER) AS a, CAST(o_orderkey % 40 AS INTEGER) + 6 AS b FROM orders), f AS (SELECT l_orderkey AS file, CASE l_returnflag WHEN 'N' THEN 'O' WHEN 'R' THEN 'F' ELSE 'P' END AS kind, CAST(l_quantity AS INTEGER) AS a, CAST(l_quantity AS INTEGER) + 4 AS b FROM lineitem),
 j AS (SELECT t.file, t.defect, max(CASE WHEN f.file IS NOT NULL THEN 1 ELSE 0 END) AS place, max(CASE WHEN f.kind = t.defect THEN 1 ELSE 0 END) AS kind FROM t LEFT JOIN f ON t.file = f.file AND t.a < f.b AND f.a < t.b GROUP BY 1, 2)
 SELECT defect, count(*) AS n, CAST(round(avg(place), 6) AS DECIMAL(9,6)) AS by_place, CAST(round(avg(kind), 6) AS DECIMAL(9,6)) AS by_type FROM j GROUP BY 1""")
def agg_eval_diag(spark: SparkSession, d: str) -> DataFrame:
    a = (F.col("o_orderkey") % 40).cast("int")
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("file"), F.col("o_orderstatus").alias("defect"), a.alias("char_start"), (a + 6).alias("char_end"))
    s = F.col("l_quantity").cast("int")
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.when(F.col("l_returnflag") == "N", "O").when(F.col("l_returnflag") == "R", "F").otherwise("P").alias("risk_type"), s.alias("char_start"), (s + 4).alias("char_end"))
    return evaluation.detection(t, f).select("defect", "n", *[F.round(c, 6).cast("decimal(9,6)").alias(c) for c in ("by_place", "by_type")])


@query("""WITH s AS (SELECT o_custkey, o_orderstatus AS tier, avg(o_orderkey % 11) AS mean, CASE WHEN count(DISTINCT o_orderkey % 11) = 1 THEN 1 ELSE 0 END AS same FROM orders GROUP BY 1, 2)
 SELECT tier, CAST(round(avg(mean), 6) AS DECIMAL(9,6)) AS mean, CAST(round(avg(same), 6) AS DECIMAL(9,6)) AS all_equal FROM s GROUP BY 1""")
def agg_eval_interview(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("question"), F.col("o_orderstatus").alias("tier"), (F.col("o_orderkey") % 11).cast("double").alias("score"))
    return evaluation.tiers(s).select("tier", *[F.round(c, 6).cast("decimal(9,6)").alias(c) for c in ("mean", "all_equal")])


@query("""WITH t AS (SELECT conv_id, role, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nx, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn % 4, turn) AS got FROM conversations)
 SELECT role AS layout, count(*) AS pairs, CAST(round(avg(CASE WHEN nx = got THEN 1 ELSE 0 END), 6) AS DECIMAL(9,6)) AS accuracy FROM t WHERE nx IS NOT NULL GROUP BY ROLLUP (role)""")
def win_adjacent_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("file"), F.col("role").alias("layout"), F.col("turn").alias("line"), F.col("turn").alias("position"))
    out = c.select("file", "line", (F.col("line") % 4 * 1000 + F.col("line")).alias("position"))
    return evaluation.adjacent_pairs(c, out).select("layout", "pairs", F.round("accuracy", 6).cast("decimal(9,6)").alias("accuracy"))
