"""Queries that write and read back, merge seeds, read wide columns late and sweep marks, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.operators import listing, spans
from inkspan.plans.bindings import lines, table
from inkspan.plans.queries import OFFSETS, query
from inkspan.sources import io, staged


@query(f"""WITH {OFFSETS} SELECT doc_id AS resume_id, CAST(line_no AS INTEGER) AS block_index, md5(line) AS hash FROM offs WHERE doc_id % 3 <> 0
 UNION ALL SELECT doc_id, CAST(line_no AS INTEGER), md5(line || '!') FROM offs WHERE doc_id % 3 = 0 AND line_no % 2 = 0""")
def snk_parse(spark: SparkSession, d: str) -> DataFrame:
    """Every document's lines are stored; a third of the documents is parsed again into other, fewer lines; the newest version is read."""
    path = staged.new_place(spark, "parsed")
    first = lines(spark, d).select(F.col("doc_id").alias("resume_id"), F.col("line_no").cast("int").alias("block_index"), F.md5(F.col("line").cast("binary")).alias("hash"))
    again = lines(spark, d).filter("doc_id % 3 = 0 AND line_no % 2 = 0")
    again = again.select(F.col("doc_id").alias("resume_id"), F.col("line_no").cast("int").alias("block_index"), F.md5(F.concat("line", F.lit("!")).cast("binary")).alias("hash"))
    staged.replace_by_key(first, path, "resume_id", buckets=16)
    staged.replace_by_key(again, path, "resume_id")
    return staged.read_current(spark, path)


@query("""WITH s AS (SELECT c_custkey AS id, c_name AS title, 'v1 ' || c_mktsegment AS raw_text, c_custkey % 11 = 0 AS is_deleted, c_nationkey < 20 AS is_template FROM customer),
 n AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'New ' || c_name ELSE c_name END AS title, 'v2 ' || c_mktsegment AS raw_text FROM customer WHERE c_custkey % 2 = 1 AND c_nationkey < 20),
 m AS (SELECT s.id, coalesce(s.title, n.title) AS title, s.raw_text AS old, n.raw_text AS new, s.is_deleted, s.is_template, s.title IS NOT NULL AS here, n.title IS NOT NULL AS listed FROM (SELECT * FROM s WHERE is_template) s FULL JOIN n ON s.title = n.title)
 SELECT CASE WHEN here THEN id ELSE (SELECT max(id) FROM s) + row_number() OVER (PARTITION BY here ORDER BY title COLLATE "C") END AS id, title, CASE WHEN listed THEN new ELSE old END AS raw_text, CASE WHEN listed THEN false ELSE true END AS is_deleted, is_template,
 CASE WHEN here AND listed THEN 'updated' WHEN listed THEN 'inserted' WHEN NOT is_deleted THEN 'deleted' ELSE 'kept' END AS change FROM m UNION ALL SELECT id, title, raw_text, is_deleted, is_template, 'kept' FROM s WHERE NOT is_template""".replace(' COLLATE "C"', ""))
def snk_seed_upsert(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    stored = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.concat(F.lit("v1 "), "c_mktsegment").alias("raw_text"), (F.col("c_custkey") % 11 == 0).alias("is_deleted"), (F.col("c_nationkey") < 20).alias("is_template"))
    new = c.filter("c_custkey % 2 = 1 AND c_nationkey < 20")
    new = new.select(F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("New "), "c_name")).otherwise(F.col("c_name")).alias("title"), F.concat(F.lit("v2 "), "c_mktsegment").alias("raw_text"))
    return io.merge_seed(stored, new, "title", scope=F.col("is_template"))


@query("SELECT doc_id, source, n_chars, md5(text) AS hash FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100")
def proj_defer(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    got = listing.deferred(docs, "doc_id", 100, [F.col("n_chars").desc(), F.col("doc_id")], ["source", "n_chars"], ["text"])
    return got.select("doc_id", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("hash"))


@query(f"""WITH {OFFSETS}, b AS (SELECT doc_id, char_start, CAST(char_start + length(line) AS BIGINT) AS char_end FROM offs WHERE length(line) > 0),
 m AS (SELECT doc_id, i AS ordinal, (doc_id * 7 + i * 37) % n AS s, least(n, (doc_id * 7 + i * 37) % n + i * 53 % 211) AS e, i % 3 AS priority, 'm' || i AS mark FROM (SELECT doc_id, length(text) AS n FROM documents WHERE text <> ''), range(0, 12) t(i)),
 c AS (SELECT doc_id, char_start, char_end, char_start AS pos FROM b UNION SELECT doc_id, char_start, char_end, char_end FROM b UNION SELECT b.doc_id, char_start, char_end, unnest([greatest(s, char_start), least(e, char_end)]) FROM b JOIN m ON m.doc_id = b.doc_id AND s < char_end AND e > char_start),
 p AS (SELECT doc_id, pos AS s0, lead(pos) OVER (PARTITION BY doc_id, char_start ORDER BY pos) AS e0 FROM c)
 SELECT p.doc_id, s0 AS start, e0 AS "end", arg_max(mark, (priority, -ordinal)) AS mark, coalesce(string_agg(mark, ',' ORDER BY ordinal), '') AS marks FROM p LEFT JOIN m ON m.doc_id = p.doc_id AND m.s < e0 AND m.e > s0 WHERE e0 IS NOT NULL GROUP BY 1, 2, 3""")
def arr_segments_under_marks(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long")))
    docs = table(spark, d, "documents").filter("text != ''").select("doc_id", n.alias("n"), i.alias("ordinal"))
    start = (F.col("doc_id") * 7 + F.col("ordinal") * 37) % F.col("n")
    marks = docs.select("doc_id", "ordinal", start.alias("mark_start"), F.least(F.col("n").cast("long"), start + F.col("ordinal") * 53 % 211).alias("mark_end"), (F.col("ordinal") % 3).alias("priority"), F.concat(F.lit("m"), "ordinal").alias("mark"))
    got = spans.segments_under_marks(lines(spark, d), marks, "doc_id", chunk=500)
    return got.withColumn("marks", F.array_join("marks", ","))
