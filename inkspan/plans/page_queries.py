"""Queries over boxes on pages, with DuckDB SQL: an order is a page with a table, its line items are the table's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.operators import tables
from inkspan.plans.bindings import table
from inkspan.plans.queries import query

_BOXES = "SELECT p_partkey, p_size, CAST(p_partkey * 37 % 500 AS DOUBLE) AS x0, CAST(p_partkey * 101 % 700 AS DOUBLE) AS y0, x0 + 10 + p_partkey % 90 AS x1, y0 + 8 + p_partkey % 50 AS y1 FROM part"


@query(f"""WITH b AS ({_BOXES}) SELECT l.p_size, l.p_partkey AS a_id, r.p_partkey AS b_id, (least(l.x1, r.x1) - greatest(l.x0, r.x0)) * (least(l.y1, r.y1) - greatest(l.y0, r.y0)) AS area
 FROM b l JOIN b r ON l.p_size = r.p_size AND l.p_partkey < r.p_partkey AND least(l.x1, r.x1) > greatest(l.x0, r.x0) AND least(l.y1, r.y1) > greatest(l.y0, r.y0)""")
def math_overlap_2d(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    x0, y0 = (p * 37 % 500).cast("double"), (p * 101 % 700).cast("double")
    part = table(spark, d, "part")
    box = lambda n: part.select("p_size", p.alias(f"{n}_id"), x0.alias(f"{n}_x0"), y0.alias(f"{n}_y0"), (x0 + 10 + p % 90).alias(f"{n}_x1"), (y0 + 8 + p % 50).alias(f"{n}_y1"))
    return tables.overlapping(box("a"), box("b"), ["p_size"]).filter("a_id < b_id").select("p_size", "a_id", "b_id", "area")


# rows 20 high from y = 120; columns 40-130, 130-280, 280-400. In every third order the first cell of row 1 is merged with
# that of row 2. Every fifth part's last cell holds two lines; some first cells are empty; a date may overflow its cell

_CELLS = """o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem), n AS (SELECT l_orderkey, max(r) AS rows FROM o GROUP BY 1),
 cells AS (SELECT l_orderkey, r, c, 100.0 + 20 * r AS y0, CASE WHEN l_orderkey % 3 = 0 AND r = 1 AND c = 0 AND rows > 1 THEN 140.0 + 20 * r ELSE 120.0 + 20 * r END AS y1, [40.0, 130.0, 280.0][c + 1] AS x0, [130.0, 280.0, 400.0][c + 1] AS x1, rows
  FROM o JOIN n USING (l_orderkey), range(3) t(c) WHERE NOT (l_orderkey % 3 = 0 AND r = 2 AND c = 0)),
 lines AS (SELECT l_orderkey, r, 0 AS k, CASE WHEN l_quantity > 25 THEN 'Returned ' || l_returnflag ELSE l_returnflag || l_linestatus END AS text, 42.0 AS x0, 42.0 + 5 * length(text) AS x1, 104.0 + 20 * r AS y0, 114.0 + 20 * r AS y1 FROM o WHERE l_partkey % 4 <> 0
  UNION ALL SELECT l_orderkey, r, 1, strftime(l_shipdate, '%Y-%m-%d'), 132.0, CASE WHEN l_suppkey % 2 = 0 THEN 300.0 ELSE 190.0 END, 104.0 + 20 * r, 114.0 + 20 * r FROM o
  UNION ALL SELECT l_orderkey, r, 2, 'part ' || l_partkey, 282.0, 330.0, 101.0 + 20 * r, 109.0 + 20 * r FROM o
  UNION ALL SELECT l_orderkey, r, 3, 'of ' || l_suppkey, CASE WHEN l_partkey % 5 = 0 THEN 282.0 ELSE 335.0 END, CASE WHEN l_partkey % 5 = 0 THEN 320.0 ELSE 390.0 END, CASE WHEN l_partkey % 5 = 0 THEN 111.0 ELSE 101.0 END + 20 * r, CASE WHEN l_partkey % 5 = 0 THEN 119.0 ELSE 109.0 END + 20 * r FROM o WHERE l_partkey % 7 <> 0
  UNION ALL SELECT l_orderkey, 0, 0, 'order ' || l_orderkey, 40.0, 120.0, 20.0, 30.0 FROM n)"""


def _page(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    o = table(spark, d, "lineitem").withColumn("r", F.row_number().over(w)).withColumn("rows", F.count("*").over(Window.partitionBy("l_orderkey")))
    top = 100.0 + 20 * F.col("r")
    number = lambda c: F.lit(c).cast("double")
    merged = F.col("l_orderkey") % 3 == 0
    cells = o.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(2)))).filter(~(merged & (F.col("r") == 2) & (F.col("c") == 0)))
    pick = lambda *v: F.element_at(F.array(*[number(x) for x in v]), F.col("c") + 1)
    bottom = top + F.when(merged & (F.col("r") == 1) & (F.col("c") == 0) & (F.col("rows") > 1), 40.0).otherwise(20.0)
    frame = {"t_x0": number(40), "t_y0": number(120), "t_x1": number(400), "t_y1": 120.0 + 20 * F.col("rows")}
    page = [F.col("l_orderkey").alias("resume_id"), F.lit(1).alias("page_no")]
    cells = cells.select(*page, F.lit(0).alias("table_no"), F.col("r").alias("row_no"), F.col("c").alias("cell_no"), pick(40, 130, 280).alias("x0"), top.alias("y0"), pick(130, 280, 400).alias("x1"), bottom.alias("y1"), *[v.alias(k) for k, v in frame.items()])
    two = F.col("l_partkey") % 5 == 0
    flag = F.when(F.col("l_quantity") > 25, F.concat(F.lit("Returned "), "l_returnflag")).otherwise(F.concat("l_returnflag", "l_linestatus"))
    line = lambda no, text, x0, x1, y0, y1, there=F.lit(True): F.struct(no.alias("line_no"), text.alias("text"), x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"), there.alias("there"))
    of_row = lambda k, text, x0, x1, y0, y1, there=F.lit(True): line(F.col("r") * 10 + k, text, x0, x1, top + y0, top + y1, there)
    lines = o.select(*page, F.explode(F.array(
        of_row(0, flag, number(42), 42.0 + 5 * F.length(flag), 4.0, 14.0, F.col("l_partkey") % 4 != 0),
        of_row(1, F.date_format("l_shipdate", "yyyy-MM-dd"), number(132), F.when(F.col("l_suppkey") % 2 == 0, 300.0).otherwise(190.0), 4.0, 14.0),
        of_row(2, F.concat(F.lit("part "), "l_partkey"), number(282), number(330), 1.0, 9.0),
        of_row(3, F.concat(F.lit("of "), "l_suppkey"), F.when(two, 282.0).otherwise(335.0), F.when(two, 320.0).otherwise(390.0), F.when(two, 11.0).otherwise(1.0), F.when(two, 19.0).otherwise(9.0), F.col("l_partkey") % 7 != 0),
        line(F.lit(0), F.concat(F.lit("order "), "l_orderkey"), number(40), number(120), number(20), number(30), F.col("r") == 1),
    )).alias("l")).select("resume_id", "page_no", "l.*").filter("there").drop("there")
    return lines, cells


@query(f"""WITH {_CELLS}, hit AS (SELECT l.l_orderkey, l.r AS lr, l.k, arg_max((c.r, c.c), (least(l.x1, c.x1) - greatest(l.x0, c.x0)) * (least(l.y1, c.y1) - greatest(l.y0, c.y0))) AS cell FROM lines l JOIN cells c ON c.l_orderkey = l.l_orderkey
  AND least(l.x1, c.x1) > greatest(l.x0, c.x0) AND least(l.y1, c.y1) > greatest(l.y0, c.y0) AND (l.x0 + l.x1) / 2 BETWEEN 40 AND 400 AND (l.y0 + l.y1) / 2 BETWEEN 120 AND 120 + 20 * c.rows GROUP BY 1, 2, 3),
 ok AS (SELECT l_orderkey FROM (SELECT l_orderkey, count(DISTINCT cell) AS f FROM hit GROUP BY 1) JOIN (SELECT l_orderkey, count(*) AS m FROM cells GROUP BY 1) USING (l_orderkey) WHERE f >= 4 AND 2 * f >= m),
 t AS (SELECT h.l_orderkey, h.cell[1] AS r, h.cell[2] AS c, l.text, l.x0, l.y0 FROM hit h JOIN ok USING (l_orderkey) JOIN lines l ON l.l_orderkey = h.l_orderkey AND l.r = h.lr AND l.k = h.k),
 v AS (SELECT l_orderkey, r, c, y0, string_agg(text, ' ' ORDER BY x0) AS text FROM t GROUP BY 1, 2, 3, 4), p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, r, c ORDER BY y0) AS line FROM v),
 w AS (SELECT l_orderkey, r, max(line) AS most, list(text ORDER BY c, y0) AS texts, list(c ORDER BY c, y0) AS cs FROM p GROUP BY 1, 2),
 g AS (SELECT w.*, len(texts) AS n, most = 1 AND len(texts) >= 2 AND cs[1] = 0 AND length(texts[1]) <= 8 AND ((len(texts) = 2 AND length(texts[2]) > length(texts[1])) OR (w.l_orderkey % 3 = 0 AND w.r = 1 AND rows > 1)) AS label FROM w JOIN n USING (l_orderkey)),
 b AS (SELECT l_orderkey, r, CASE WHEN most > 1 THEN list_transform(texts, lambda x: ('line', x)) WHEN label THEN [('label', texts[1]), ('row', array_to_string(texts[2:], ' '))] ELSE [('row', array_to_string(texts, ' '))] END AS parts FROM g),
 u AS (SELECT l_orderkey, r, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS part_no FROM b)
 SELECT l_orderkey, CAST(r AS INTEGER) AS row_no, CAST(part_no AS INTEGER) AS part_no, part[1] AS kind, part[2] AS text FROM u
 UNION ALL SELECT l.l_orderkey, CAST(l.r AS INTEGER), CAST(l.k AS INTEGER), 'outside', l.text FROM lines l WHERE l.r = 0 OR NOT EXISTS (SELECT 1 FROM hit h JOIN ok USING (l_orderkey) WHERE h.l_orderkey = l.l_orderkey AND h.lr = l.r AND h.k = l.k)""")
def lay_tables(spark: SparkSession, d: str) -> DataFrame:
    lines, cells = _page(spark, d)
    outside, held = tables.take_tables(lines, cells)
    blocks = tables.read_rows(held).select(F.col("resume_id").alias("l_orderkey"), "row_no", "part_no", "kind", "text")
    rest = outside.select(F.col("resume_id").alias("l_orderkey"), F.floor(F.col("line_no") / 10).cast("int").alias("row_no"), (F.col("line_no") % 10).alias("part_no"), F.lit("outside").alias("kind"), "text")
    return blocks.unionByName(rest)
