"""Queries for skills, sections and quotes over whole documents, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.functions.text import normalize_for_match
from inkspan.operators import evidence, skills
from inkspan.plans.bindings import table
from inkspan.plans.queries import query

# skills: the dictionary is every word of the benchmark with the word behind it; its id says where it stands


def dictionary(spark: SparkSession, d: str) -> DataFrame:
    runs = F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+|[^A-Za-z0-9]+"), F.lit(0))
    r = table(spark, d, "benchmark").select("item_id", runs.alias("r"))
    r = r.select("item_id", F.posexplode("r").alias("i", "run"), "r").filter("run RLIKE '^[A-Za-z0-9]'")
    pair = F.concat("run", F.lit(" "), F.get("r", F.col("i") + 2))
    name = F.when((F.get("r", F.col("i") + 1) == " ") & (F.get("r", F.col("i") + 2).isNotNull()), pair).otherwise(F.col("run"))
    return r.select((F.col("item_id") * 100_000 + F.col("i")).alias("id"), name.alias("canonical_name"), F.lit("word").alias("category"), F.array("run").alias("aliases"))


_RUNS = "unnest(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+')) AS run, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+'), 1) AS i"
_WORDS = f"""br AS (SELECT item_id, {_RUNS} FROM benchmark), bp AS (SELECT *, lead(run) OVER w AS sep, lead(run, 2) OVER w AS nxt FROM br WINDOW w AS (PARTITION BY item_id ORDER BY i)),
 dict AS (SELECT item_id * 100000 + i - 1 AS id, unnest([run, CASE WHEN sep = ' ' AND nxt IS NOT NULL THEN run || ' ' || nxt ELSE run END]) AS word FROM bp WHERE regexp_matches(run, '^[A-Za-z0-9]')),
 words AS (SELECT CASE WHEN length(word) <= 2 THEN word ELSE lower(word) END AS word, length(word) <= 2 AS exact, min(id) AS id FROM dict GROUP BY 1, 2)"""
_TAGS = f"""{_WORDS}, dr AS (SELECT doc_id, {_RUNS} FROM documents WHERE text <> ''), dp AS (SELECT *, sum(length(run)) OVER (PARTITION BY doc_id ORDER BY i) - length(run) AS s, lead(run) OVER w AS sep, lead(run, 2) OVER w AS nxt FROM dr WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 k AS (SELECT dp.*, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, p.id AS pair, coalesce(f.id, e.id) AS single FROM dp LEFT JOIN words p ON NOT p.exact AND sep = ' ' AND p.word = lower(run || ' ' || nxt)
  LEFT JOIN words f ON NOT f.exact AND f.word = lower(run) LEFT JOIN words e ON e.exact AND e.word = run WHERE regexp_matches(run, '^[A-Za-z0-9]')),
 g AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id, pair IS NULL ORDER BY n) AS island FROM k),
 c AS (SELECT *, pair IS NOT NULL AND (row_number() OVER (PARTITION BY doc_id, pair IS NULL, island ORDER BY n)) % 2 = 1 AS taken FROM g),
 t AS (SELECT *, coalesce(lag(taken) OVER (PARTITION BY doc_id ORDER BY n), false) AS covered FROM c),
 tags AS (SELECT doc_id, pair AS skill_id, run || ' ' || nxt AS surface, s FROM t WHERE taken UNION ALL SELECT doc_id, single, run, s FROM t WHERE NOT taken AND NOT covered AND single IS NOT NULL)"""


@query(f"""WITH {_TAGS} SELECT doc_id, skill_id, surface, CAST(s AS INTEGER) AS char_start, CAST(s + length(surface) AS INTEGER) AS char_end,
 CASE WHEN s < length(text) // 3 THEN 'skills' WHEN s < 2 * (length(text) // 3) THEN 'projects' ELSE 'other' END AS section_type, 'dict' AS matched_by FROM tags JOIN documents USING (doc_id)""")
def tag_skills(spark: SparkSession, d: str) -> DataFrame:
    third = F.floor(F.length("text") / 3).cast("int")
    part = lambda a, b, name: F.struct(F.lit(name).alias("type"), a.alias("char_start"), b.alias("char_end"))
    docs = table(spark, d, "documents").select("doc_id", "text", F.array(part(F.lit(0), third, "skills"), part(third, 2 * third, "projects")).alias("sections"))
    return skills.annotate(docs, dictionary(spark, d), "doc_id", "text")


@query(f"WITH {_TAGS} SELECT doc_id, skill_id, surface, CAST(s AS INTEGER) AS char_start, CAST(s + length(surface) AS INTEGER) AS char_end FROM tags")
def arr_longest_first_alt(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary in automata of 500 spellings: what overlaps is decided over the hits of all of them."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return skills.tag(docs, dictionary(spark, d), "doc_id", "text", spellings=500)


@query(f"""WITH {_WORDS}, n AS (SELECT doc_id, unnest([regexp_extract(text, '[A-Za-z0-9]+'), regexp_extract(text, '[A-Za-z0-9]+ [A-Za-z0-9]+')]) AS name FROM documents)
 SELECT doc_id, name, coalesce(e.id, f.id) AS skill_id FROM n LEFT JOIN words e ON e.exact AND e.word = name LEFT JOIN words f ON NOT f.exact AND f.word = lower(name)""")
def tag_lookup(spark: SparkSession, d: str) -> DataFrame:
    one, two = (F.regexp_extract("text", x, 0) for x in ("[A-Za-z0-9]+", "[A-Za-z0-9]+ [A-Za-z0-9]+"))
    names = table(spark, d, "documents").select("doc_id", F.explode(F.array(one, two)).alias("name"))
    return skills.lookup(names, dictionary(spark, d)).select("doc_id", "name", "skill_id")


# quotes: up to four of each document of 200 characters or more. An exact one whose hint is too short for it, two with a letter
# replaced in their middle (hint around it; no hint), one that is made up; the edited ones begin with 20 characters that
# stand once in the text, so that they have one place

MARK = "§"
_NORM = "translate({}, chr(10) || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ' abcdefghijklmnopqrstuvwxyz')"
_TRIM = "trim({}, ' .' || chr(34) || chr(39))"


def _first(text: str, left: str, right: str) -> str:
    """DuckDB: characters before the first place where left, any character, right stand; null if nowhere."""
    parts = f"string_split({text}, {left})"
    hit = f"list_filter(range(2, len({parts}) + 1), lambda k: substr({parts}[k], 2, length({right})) = {right})[1]"
    return f"CASE WHEN {hit} IS NOT NULL THEN CAST(list_sum(list_transform({parts}[1:{hit} - 1], lambda x: length(x))) AS BIGINT) + ({hit} - 2) * length({left}) END"


@query(f"""WITH d AS (SELECT doc_id, text, {_NORM.format("text")} AS t, length(text) AS n FROM documents WHERE length(text) >= 200),
 q AS (SELECT *, 0 AS kind, {_TRIM.format("substr(t, n // 4 + 1, 40)")} AS a, '' AS b, 0 AS lo, 20 AS hi FROM d
 UNION ALL SELECT *, 1, ltrim(substr(t, n // 2 + 11, 20), ' .' || chr(34) || chr(39)), rtrim(substr(t, n // 2 + 32, 19), ' .' || chr(34) || chr(39)), n // 2, n // 2 + 60 FROM d
 UNION ALL SELECT *, 2, ltrim(substr(t, n // 3 + 1, 20), ' .' || chr(34) || chr(39)), rtrim(substr(t, n // 3 + 22, 19), ' .' || chr(34) || chr(39)), 0, n FROM d
 UNION ALL SELECT *, 3, repeat('{MARK}', 12), '', 0, n FROM d),
 f AS (SELECT doc_id, kind, a, b, CASE WHEN kind = 3 THEN NULL WHEN kind = 0 THEN strpos(t, a) - 1
 ELSE lo + {_first("substr(t, lo + 1, hi - lo)", "a", "b")} END AS s, CASE kind WHEN 0 THEN length(a) ELSE length(a) + 1 + length(b) END AS m FROM q WHERE kind IN (0, 3) OR length(replace(t, a, '')) = n - length(a))
 SELECT doc_id, kind, CAST(s AS INTEGER) AS char_start, CAST(s + m AS INTEGER) AS char_end, CASE WHEN s IS NULL THEN NULL WHEN kind = 0 THEN 1.0 ELSE round((m - 1) / m, 3) END AS score,
 CASE WHEN s IS NULL THEN NULL WHEN kind = 0 THEN 'exact' ELSE 'fuzzy' END AS method FROM f""")
def join_quote_text(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    docs = table(spark, d, "documents").filter(n >= 200)
    at = lambda start, size: F.substr("text", start.cast("int") + 1, F.lit(size))
    half, third, quarter = F.floor(n / 2), F.floor(n / 3), F.floor(n / 4)
    edited = lambda start: F.concat(at(start, 20), F.lit(MARK), at(start + 21, 19))
    kinds = [(at(quarter, 40), F.lit(0), F.lit(20)), (edited(half + 10), half, half + 60), (edited(third), F.lit(None), F.lit(None)), (F.lit(MARK * 12), F.lit(None), F.lit(None))]
    asked = F.array(*[F.struct(F.lit(k).alias("kind"), q.alias("quote"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi")) for k, (q, lo, hi) in enumerate(kinds)])
    left = normalize_for_match(F.regexp_replace(F.substring("q.quote", 1, 20), "^[ .\n\"']+", ""))
    once = F.length(F.replace(normalize_for_match(F.col("text")), left, F.lit(""))) == n - F.length(left)
    rows = docs.select("doc_id", "text", F.explode(asked).alias("q")).filter(F.col("q.kind").isin(0, 3) | once).select("doc_id", "text", "q.*")
    found = evidence.locate(rows, "quote", "text", "lo", "hi")
    return found.select("doc_id", "kind", F.col("span.start").alias("char_start"), F.col("span.end").alias("char_end"), "span.score", "span.method")


@query()
def ev_locate_similar(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items with two letters replaced, sought in all documents; tests/test_text_chain.py compares with all pairs."""
    n = F.length("text")
    piece = lambda a, b: F.substr("text", a + 1, b - a)
    third = F.floor(n / 3).cast("int")
    items = table(spark, d, "benchmark").select("item_id", F.concat(piece(F.lit(0), third), F.lit(MARK), piece(third + 1, 2 * third), F.lit(MARK), piece(2 * third + 1, n)).alias("text"))
    # the texts are dealt out, as a file may hold all of them in one piece, which is one task
    docs = table(spark, d, "documents").select("doc_id", "text").repartition(4 * spark.sparkContext.defaultParallelism, "doc_id")
    return evidence.locate_in_corpus(items, docs, similar=True)
