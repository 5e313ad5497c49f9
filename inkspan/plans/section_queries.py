"""Queries of the section chain over documents, with DuckDB SQL.

A line is a block. Every third line is cut to its first letters, so that it may be a heading; the headings that count are
the benchmark's words, each of the type that its length says. Sizes, weights and gaps follow from document and line number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.operators import sections
from inkspan.plans.bindings import lines, table
from inkspan.plans.queries import LINES, query

TYPES = ("education", "work", "projects", "skills", "awards", "summary", "other")
DECISIONS = ("none", "skills", "bogus", "summary")
_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"


def spellings(spark: SparkSession, d: str) -> DataFrame:
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    w = table(spark, d, "benchmark").select(words.alias("alias")).filter(F.length("alias") >= 3).distinct()
    return w.select("alias", F.element_at(F.array(*[F.lit(t) for t in TYPES]), F.length("alias") % 7 + 1).alias("section_type"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    n, doc = F.col("line_no"), F.col("doc_id")
    body = F.concat(F.when((n <= 2) & (doc % 4 == 0), F.when(doc % 8 == 0, "university @ ").otherwise("university ")).otherwise("text "), F.md5(F.col("line").cast("binary")))
    text = F.when(n % 3 == 0, F.regexp_extract("line", "[A-Za-z]+", 0)).otherwise(body)
    d = lines(spark, d).select("doc_id", "line_no", text.alias("text"), F.when((doc + n) % 5 == 0, 12.0).otherwise(10.5).alias("font_size"), ((doc + n) % 4 == 0).alias("is_bold"))
    y0 = (n % 40) * 18.0 + F.when(n % 4 == 0, 6.0).otherwise(0.0)
    d = d.select(doc.alias("resume_id"), n.cast("int").alias("block_index"), (F.floor(n / 40) + 1).cast("int").alias("page_no"), F.lit(0).alias("column_index"), y0.alias("y0"), (y0 + 12.0).alias("y1"), "text", "font_size", "is_bold")
    from inkspan.operators.spans import offsets_by_window

    d = offsets_by_window(d, "resume_id", "block_index", "text")
    return d.withColumns({c: F.col(c).cast("int") for c in ("char_start", "char_end")})


_BLOCKS = f"""{LINES}, t0 AS (SELECT doc_id, line_no, CASE WHEN line_no % 3 = 0 THEN regexp_extract(line, '[A-Za-z]+') ELSE CASE WHEN line_no <= 2 AND doc_id % 4 = 0 THEN CASE WHEN doc_id % 8 = 0 THEN 'university @ ' ELSE 'university ' END ELSE 'text ' END || md5(line) END AS text,
  CASE WHEN (doc_id + line_no) % 5 = 0 THEN 12.0 ELSE 10.5 END AS font, (doc_id + line_no) % 4 = 0 AS bold, line_no // 40 + 1 AS page, (line_no % 40) * 18.0 + CASE WHEN line_no % 4 = 0 THEN 6.0 ELSE 0.0 END AS y0 FROM ls),
 blocks AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cs, cs + length(text) AS ce FROM t0),
 sp AS (SELECT DISTINCT w AS alias, {_LIST(TYPES)}[length(w) % 7 + 1] AS kind FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) WHERE length(w) >= 3),
 fs AS (SELECT doc_id, font, sum(length(text)) AS n FROM blocks GROUP BY 1, 2), fb AS (SELECT doc_id, min(font) FILTER (run > total // 2) AS body FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY font) AS run, sum(n) OVER (PARTITION BY doc_id) AS total FROM fs) GROUP BY 1),
 feat AS (SELECT b.*, body, coalesce(body > 0 AND font >= body * 1.1, false) AS large, (CASE WHEN body > 0 AND font >= body * 1.1 THEN 1 ELSE 0 END) + (CASE WHEN bold THEN 1 ELSE 0 END) + (CASE WHEN length(text) <= 12 THEN 1 ELSE 0 END)
  + (CASE WHEN lag(page) OVER w IS NULL OR lag(page) OVER w <> page OR y0 - (lag(y0) OVER w + 12.0) >= 0.6 * 12.0 THEN 1 ELSE 0 END) AS score FROM blocks b JOIN fb USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
 k AS (SELECT f.*, sp.kind FROM feat f LEFT JOIN sp ON sp.alias = lower(f.text) AND length(f.text) <= 30),
 st AS (SELECT DISTINCT doc_id, font, bold FROM k WHERE kind IS NOT NULL AND NOT (font = body AND NOT bold)),
 cand AS (SELECT k.*, max(CASE WHEN kind IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY k.doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, st.doc_id IS NOT NULL AS styled FROM k LEFT JOIN st ON st.doc_id = k.doc_id AND st.font = k.font AND st.bold = k.bold),
 head AS (SELECT doc_id, line_no, coalesce(kind, 'other') AS section_type, least(1.0, (CASE WHEN kind IS NOT NULL THEN score + 3 ELSE score END) / 5) AS confidence, text AS title,
  CASE WHEN kind IS NOT NULL THEN 'dict' WHEN seen = 1 AND length(text) <= 12 AND score >= 3 AND large THEN 'feature' WHEN seen = 1 AND length(text) <= 12 AND styled THEN 'style' END AS matched_by FROM cand),
 heads AS (SELECT * FROM head WHERE matched_by IS NOT NULL)"""


def _built(heads: str) -> str:
    """Sections of the headings in ``heads``: each to the next one, what stands before the first, documents without any."""
    return f"""edge AS (SELECT doc_id, min(line_no) AS first, bool_or(section_type = 'education') AS edu FROM {heads} GROUP BY 1), last AS (SELECT doc_id, max(line_no) AS n FROM blocks GROUP BY 1),
 pre AS (SELECT b.doc_id, b.line_no, e.first, NOT e.edu AND b.text LIKE '%university%' AND b.text NOT LIKE '%@%' AND NOT regexp_matches(b.text, '[0-9]{{11}}') AS fits FROM blocks b JOIN edge e USING (doc_id) WHERE b.line_no < e.first),
 cut AS (SELECT doc_id, first, coalesce(max(line_no) FILTER (NOT fits) + 1, 0) AS from_ FROM pre GROUP BY 1, 2),
 spans AS (SELECT doc_id, section_type AS type, title, line_no AS lo, coalesce(lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) - 1, n) AS hi, round(confidence, 2) AS confidence, matched_by FROM {heads} JOIN last USING (doc_id)
  UNION ALL SELECT doc_id, 'basics', '', 0, from_ - 1, 0.6, 'implicit' FROM cut WHERE from_ > 0 UNION ALL SELECT doc_id, 'education', '', from_, first - 1, 0.5, 'implicit' FROM cut WHERE from_ < first
  UNION ALL SELECT doc_id, 'other', '', 0, n, 0.0, 'implicit' FROM last WHERE doc_id NOT IN (SELECT doc_id FROM edge)),
 built AS (SELECT s.doc_id AS resume_id, type, title, CAST(lo AS INTEGER) AS block_start, CAST(hi AS INTEGER) AS block_end, CAST(a.cs AS INTEGER) AS char_start, CAST(z.ce AS INTEGER) AS char_end, confidence, matched_by, matched_by IN ('feature', 'style') AS needs_llm,
  CAST(CASE WHEN matched_by = 'implicit' THEN a.cs WHEN hi > lo THEN c.cs ELSE z.ce END AS INTEGER) AS content_start FROM spans s JOIN blocks a ON a.doc_id = s.doc_id AND a.line_no = lo JOIN blocks z ON z.doc_id = s.doc_id AND z.line_no = hi LEFT JOIN blocks c ON c.doc_id = s.doc_id AND c.line_no = lo + 1)"""


SPAN = ("resume_id", "type", "title", "block_start", "block_end", "char_start", "char_end", "content_start", "confidence", "matched_by", "needs_llm")


def _headings(spark: SparkSession, d: str) -> DataFrame:
    return sections.find_headings(blocks(spark, d), spellings(spark, d))


@query(f"WITH {_BLOCKS} SELECT doc_id AS resume_id, CAST(line_no AS INTEGER) AS block_index, CAST(body AS DOUBLE) AS body_size, large, CAST(score AS INTEGER) AS score FROM feat")
def sec_features(spark: SparkSession, d: str) -> DataFrame:
    return sections.heading_features(blocks(spark, d)).select("resume_id", "block_index", F.col("body_size").cast("double").alias("body_size"), "large", F.col("score").cast("int").alias("score"))


@query(f"WITH {_BLOCKS} SELECT doc_id AS resume_id, CAST(line_no AS INTEGER) AS block_index, section_type, CAST(confidence AS DOUBLE) AS confidence, matched_by, title FROM heads")
def sec_find(spark: SparkSession, d: str) -> DataFrame:
    return _headings(spark, d).withColumn("confidence", F.col("confidence").cast("double"))


@query(f"WITH {_BLOCKS} SELECT doc_id AS resume_id, count(*) FILTER (matched_by <> 'dict') AS candidates, CAST(min(line_no) FILTER (matched_by <> 'dict') AS INTEGER) AS first_candidate, CAST(min(line_no) FILTER (matched_by = 'dict') AS INTEGER) AS first_heading FROM heads GROUP BY 1")
def win_first_heading(spark: SparkSession, d: str) -> DataFrame:
    """Candidates stand behind the first heading of the dictionary only."""
    h, known = _headings(spark, d), F.col("matched_by") == "dict"
    return h.groupBy("resume_id").agg(F.count(F.when(~known, 1)).alias("candidates"), F.min(F.when(~known, F.col("block_index"))).alias("first_candidate"), F.min(F.when(known, F.col("block_index"))).alias("first_heading"))


@query(f"WITH {_BLOCKS}, {_built('heads')} SELECT {', '.join(SPAN)} FROM built".replace("confidence, matched_by, needs_llm FROM built", "CAST(confidence AS DOUBLE) AS confidence, matched_by, needs_llm FROM built"))
def sec_build(spark: SparkSession, d: str) -> DataFrame:
    return sections.build_sections(blocks(spark, d), _headings(spark, d)).select(*SPAN).withColumn("confidence", F.col("confidence").cast("double"))


@query(f"WITH {_BLOCKS}, {_built('heads')} SELECT resume_id, block_start, block_end, block_end - block_start + 1 AS n_blocks FROM built WHERE matched_by <> 'implicit'")
def win_sections(spark: SparkSession, d: str) -> DataFrame:
    """Each heading reaches to the one before the next."""
    got = sections.build_sections(blocks(spark, d), _headings(spark, d)).filter("matched_by != 'implicit'")
    return got.select("resume_id", "block_start", "block_end", (F.col("block_end") - F.col("block_start") + 1).alias("n_blocks"))


@query(f"""WITH {_BLOCKS}, dec AS (SELECT *, {_LIST(DECISIONS)}[CAST((doc_id + line_no) % 4 + 1 AS INTEGER)] AS said FROM heads),
 dh AS (SELECT doc_id, line_no, title, confidence, CASE WHEN matched_by = 'dict' OR said NOT IN ('skills', 'summary') THEN section_type ELSE said END AS section_type, CASE WHEN matched_by = 'dict' OR said NOT IN ('skills', 'summary') THEN matched_by ELSE 'llm' END AS matched_by
  FROM dec WHERE matched_by = 'dict' OR (said <> 'none' AND NOT (matched_by = 'style' AND said = 'bogus'))), {_built('dh')} SELECT {', '.join(SPAN)} FROM built""".replace("confidence, matched_by, needs_llm FROM built", "CAST(confidence AS DOUBLE) AS confidence, matched_by, needs_llm FROM built"))
def sec_llm_merge(spark: SparkSession, d: str) -> DataFrame:
    """Every heading is answered, also those that were not asked about; answers go by document and line."""
    h = _headings(spark, d)
    said = F.element_at(F.array(*[F.lit(x) for x in DECISIONS]), ((F.col("resume_id") + F.col("block_index")) % 4 + 1).cast("int"))
    merged = sections.apply_decisions(h, h.select("resume_id", "block_index", said.alias("type")))
    return sections.build_sections(blocks(spark, d), merged).select(*SPAN).withColumn("confidence", F.col("confidence").cast("double"))


# basics: a customer is a résumé of ten blocks

_TEL = "['138-0000-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0'), '+86 139 1111 ' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0'), '1.38001380000', '86-15812345678']"
_CITY = "['上海', '湖南长沙', '北京市海淀区', 'Berlin', '广州']"
_PLACE = f"['现居地：' || city, '项目地址：' || city, '地址：' || city || ' 12 号', '籍贯 ' || city || ' 民族', '籍贯' || city]"
_PII = f"""c AS (SELECT *, {_CITY}[c_nationkey % 5 + 1] AS city, {_TEL}[c_custkey % 4 + 1] AS tel FROM customer),
 b AS (SELECT c_custkey, unnest(range(0, 10)) AS i, unnest(['个人简历', CASE WHEN c_custkey % 3 = 0 THEN 'Anna ' || c_mktsegment ELSE '王小' || chr(CAST(19968 + c_custkey % 500 AS INTEGER)) END, CASE c_custkey % 5 WHEN 0 THEN '姓名：李' || chr(CAST(20000 + c_custkey % 300 AS INTEGER)) || ' 性别 女' ELSE 'Max ' || c_mktsegment END,
  'tel ' || tel, 'mail ' || lower(c_mktsegment) || c_custkey || '@mail-' || c_nationkey || '.example.com', {_PLACE}[c_custkey % 5 + 1], 'text', 'text', '现居地：' || city, 'other' || c_custkey || '@late.example.org']) AS text,
  unnest([20.0, 14.0, CASE WHEN c_custkey % 2 = 0 THEN 14.0 ELSE 15.0 END, 10.0, 10.0, 10.0, 10.0, 10.0, 10.0, 10.0]) AS font, c_acctbal FROM c),
 h AS (SELECT * FROM b WHERE CASE WHEN c_acctbal > 5000 THEN i <= 3 WHEN c_acctbal > 4000 THEN i BETWEEN 0 AND 9 ELSE i < 8 END), w AS (SELECT c_custkey, string_agg(text, chr(10) ORDER BY i) AS t, arg_max(text, (font, -i)) FILTER (regexp_full_match(text, '[A-Za-z][A-Za-z.''-]*( [A-Za-z][A-Za-z.''-]*)+') OR (regexp_full_match(text, '[一-鿿]{{2,4}}') AND text <> '个人简历')) AS best FROM h GROUP BY 1)"""


def basics_blocks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    key = F.col("c_custkey")
    pick = lambda at, *v: F.element_at(F.array(*v), (at + 1).cast("int"))
    lit = F.lit
    last4 = F.lpad((key % 10000).cast("string"), 4, "0")
    city = pick(F.col("c_nationkey") % 5, *[lit(x) for x in ("上海", "湖南长沙", "北京市海淀区", "Berlin", "广州")])
    tel = pick(key % 4, F.concat(lit("138-0000-"), last4), F.concat(lit("+86 139 1111 "), last4), lit("1.38001380000"), lit("86-15812345678"))
    place = pick(key % 5, F.concat(lit("现居地："), city), F.concat(lit("项目地址："), city), F.concat(lit("地址："), city, lit(" 12 号")), F.concat(lit("籍贯 "), city, lit(" 民族")), F.concat(lit("籍贯"), city))
    wide = lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("int")), 4, "0")), "UTF-16BE")
    first = F.when(key % 3 == 0, F.concat(lit("Anna "), "c_mktsegment")).otherwise(F.concat(lit("王小"), wide(19968 + key % 500)))
    second = F.when(key % 5 == 0, F.concat(lit("姓名：李"), wide(20000 + key % 300), lit(" 性别 女"))).otherwise(F.concat(lit("Max "), "c_mktsegment"))
    mail = F.concat(lit("mail "), F.lower("c_mktsegment"), key, lit("@mail-"), "c_nationkey", lit(".example.com"))
    texts = (lit("个人简历"), first, second, F.concat(lit("tel "), tel), mail, place, lit("text"), lit("text"), F.concat(lit("现居地："), city), F.concat(lit("other"), key, lit("@late.example.org")))
    fonts = (lit(20.0), lit(14.0), F.when(key % 2 == 0, 14.0).otherwise(15.0), *[lit(10.0)] * 7)
    c = table(spark, d, "customer")
    rows = F.array(*[F.struct(t.alias("text"), f.alias("font_size")) for t, f in zip(texts, fonts, strict=True)])
    b = c.select(key.alias("resume_id"), F.posexplode(rows).alias("block_index", "b")).select("resume_id", "block_index", "b.*")
    rich = F.col("c_acctbal")
    s = c.filter(rich > 4000).select(key.alias("resume_id"), lit("basics").alias("type"), lit(0).alias("block_start"), F.when(rich > 5000, 3).otherwise(9).alias("block_end"))
    return b, s.unionByName(c.filter(rich <= 100).select(key.alias("resume_id"), lit("work").alias("type"), lit(0).alias("block_start"), lit(3).alias("block_end")))


@query(f"""WITH {_PII} SELECT c_custkey AS resume_id, coalesce(nullif(regexp_extract(t, '姓名：(李[一-鿿]) ', 1), ''), best) AS name, nullif(regexp_extract(t, '[a-z0-9]+@[a-z0-9-]+\\.example\\.(com|org)'), '') AS email,
 nullif(regexp_replace(regexp_extract(t, '(^|[^0-9.])((\\+?86[- ]?)?1[3-9][0-9][- ]?[0-9]{{4}}[- ]?[0-9]{{4}})([^0-9.]|$)', 2), '[- ]', '', 'g'), '') AS phone,
 coalesce(nullif(regexp_extract(t, '(现居地|籍贯)[:：]([一-鿿A-Za-z]{{2,15}})', 2), ''), nullif(regexp_extract(t, chr(10) || '地址：([一-鿿][一-鿿A-Za-z]+)', 1), ''), nullif(regexp_extract(t, '籍贯 ([一-鿿]{{2,15}}) ', 1), '')) AS location FROM w""")
def pii_basics(spark: SparkSession, d: str) -> DataFrame:
    return sections.extract_basics(*basics_blocks(spark, d))


@query("""WITH l AS (SELECT l_orderkey AS resume_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS n, l_partkey % 3 AS points, CAST(l_suppkey % 20 AS INTEGER) AS s FROM lineitem),
 e AS (SELECT *, CASE WHEN n % 2 = 0 THEN 'work' ELSE 'projects' END AS kind, n // 2 AS i FROM l),
 u AS (SELECT resume_id, kind || '[' || i || ']' AS unit_id, kind AS unit_type, 'entry ' || n AS entry_name, s AS char_start, s + 30 AS char_end FROM e WHERE points = 0
  UNION ALL SELECT resume_id, kind || '[' || i || '].highlights[' || j || ']', kind, 'entry ' || n, s + CAST(j AS INTEGER) * 5, s + CAST(j AS INTEGER) * 5 + 4 FROM e, range(0, 2) t(j) WHERE j < points
  UNION ALL SELECT o_orderkey, 'summary', 'summary', NULL, 3, 12 FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem))
 SELECT resume_id, unit_id, unit_type, entry_name, char_start, char_end, substr(repeat(md5(CAST(resume_id AS VARCHAR)), 3), char_start + 1, char_end - char_start) AS text FROM u""")
def arr_iter_units(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    s = (F.col("l_suppkey") % 20).cast("int")
    span = lambda a, b: F.struct(a.alias("char_start"), b.alias("char_end"))
    points = F.transform(F.slice(F.array(F.lit(0), F.lit(1)), F.lit(1), (F.col("l_partkey") % 3).cast("int")), lambda j: span(s + j * 5, s + j * 5 + 4))
    n = F.row_number().over(w) - 1
    e = table(spark, d, "lineitem").select("l_orderkey", n.alias("n"), F.struct(F.concat(F.lit("entry "), n).alias("name"), s.alias("char_start"), (s + 30).alias("char_end"), points.alias("highlights")).alias("e"))
    ordered = lambda odd: F.transform(F.sort_array(F.collect_list(F.when(F.col("n") % 2 == odd, F.struct("n", "e")))), lambda x: x["e"])
    g = e.groupBy("l_orderkey").agg(ordered(0).alias("work"), ordered(1).alias("projects"))
    summary = F.when(F.col("l_orderkey") % 4 == 0, span(F.lit(3), F.lit(12)))
    text = F.repeat(F.md5(F.col("l_orderkey").cast("string").cast("binary")), F.lit(3))
    return sections.review_units(g.select(F.col("l_orderkey").alias("resume_id"), text.alias("full_text"), "work", "projects", summary.alias("summary")))
