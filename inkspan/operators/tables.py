"""Bordered tables on pages: a binned overlap join of boxes, lines taken into cells, rows read out as blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: filled cells of a real table, longest label, tolerance at the table's left edge
LEAST_FILLED, LABEL_LONGEST, LEFT_EDGE = 4, 8, 1.0
BOX = ("x0", "y0", "x1", "y1")


def overlap_area(a: str, b: str) -> Column:
    """Shared area of two boxes whose columns are named a_x0 .. a_y1 and b_x0 .. b_y1; 0 if they only touch."""
    w = F.least(f"{a}_x1", f"{b}_x1") - F.greatest(f"{a}_x0", f"{b}_x0")
    h = F.least(f"{a}_y1", f"{b}_y1") - F.greatest(f"{a}_y0", f"{b}_y0")
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def _bins(df: DataFrame, name: str, size: float) -> DataFrame:
    """A row for each grid square that a box touches."""
    at = lambda c: F.floor(F.col(f"{name}_{c}") / size).cast("int")
    return df.withColumn("_gx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("_gy", F.explode(F.sequence(at("y0"), at("y1"))))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], a: str = "a", b: str = "b", size: float = 64.0) -> DataFrame:
    """Pairs of boxes of one key that share an area, with ``area``.

    An equi-join on key and grid square, so boxes are compared with their neighbours only and a key with many boxes (one huge
    page) is dealt out by squares: into as many partitions as the session shuffles to, however few bytes the boxes have, as the
    work is in their pairs. A pair that meets in several squares counts in the one that holds the corner of its
    shared area. ``size`` (in the boxes' unit) should be about a box's longer side: smaller squares copy boxes, larger ones
    compare more pairs. Empty and null boxes meet nothing; right columns that are no keys must have names of their own.
    """
    whole = lambda n: (F.col(f"{n}_x1") > F.col(f"{n}_x0")) & (F.col(f"{n}_y1") > F.col(f"{n}_y0"))
    square = [*keys, "_gx", "_gy"]
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of its own is not coalesced
    dealt = lambda df, n: _bins(df.filter(whole(n)), n, size).repartition(parts, *square)
    pairs = dealt(left, a).join(dealt(right, b), square)
    corner = lambda c: F.floor(F.greatest(f"{a}_{c}", f"{b}_{c}") / size).cast("int")
    first = (F.col("_gx") == corner("x0")) & (F.col("_gy") == corner("y0"))
    return pairs.filter(first).withColumn("area", overlap_area(a, b)).filter("area > 0").drop("_gx", "_gy")


def visual_rows(lines: Column) -> Column:
    """Rows of an array of line structs (y0, x0, x1, y1, text) sorted by y0, x0: a line joins the last row if it shares half of
    the lower height with the row's first line. Gives array<struct<y0, y1, items>>, items sorted by x0."""
    last = lambda rows: F.element_at(rows, -1)
    height = lambda s: s["y1"] - s["y0"]

    def step(rows: Column, line: Column) -> Column:
        shared = F.least(last(rows)["y1"], line["y1"]) - F.greatest(last(rows)["y0"], line["y0"])
        joins = (F.size(rows) > 0) & (shared >= 0.5 * F.least(height(last(rows)), height(line)))
        more = F.struct(last(rows)["y0"].alias("y0"), last(rows)["y1"].alias("y1"), F.concat(last(rows)["items"], F.array(line)).alias("items"))
        new = F.struct(line["y0"].alias("y0"), line["y1"].alias("y1"), F.array(line).alias("items"))
        return F.when(joins, F.concat(F.slice(rows, F.lit(1), F.size(rows) - 1), F.array(more))).otherwise(F.concat(rows, F.array(new)))

    line = "struct<y0:double,x0:double,x1:double,y1:double,text:string>"
    start = F.array().cast(f"array<struct<y0:double,y1:double,items:array<{line}>>>")
    rows = F.aggregate(F.array_sort(lines), start, step)
    across = lambda i: F.transform(F.array_sort(F.transform(i, lambda s: F.struct(s["x0"].alias("x0"), s.alias("line")))), lambda s: s["line"])
    return F.transform(rows, lambda r: F.struct(r["y0"].alias("y0"), r["y1"].alias("y1"), across(r["items"]).alias("items")))


def take_tables(lines: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines outside of tables, cells with their lines).

    A line whose middle lies in a table belongs to the cell it shares most area with (on ties the first by row and cell). A
    table with fewer than four filled cells, or less than half filled, is none, and its lines stay outside. lines: resume_id,
    page_no, line_no, box, text; cells: resume_id, page_no, table_no, row_no, cell_no, box and the table's box t_x0 .. t_y1.
    The tables of a page must not overlap.

    One join by page, then aggregates and windows inside pages: lines and cells are shuffled once, and not at all where
    they are partitioned by page already. A line meets the cells of its own page only.
    """
    page, place = ["resume_id", "page_no"], ["table_no", "row_no", "cell_no"]
    a = lines.select(*page, "line_no", F.struct(*[F.col(f"`{c}`") for c in lines.columns]).alias("_line"))
    b = cells.withColumn("_all", F.count("*").over(Window.partitionBy(*page, "table_no")))
    b = b.select(*[F.col(c).alias(f"_{c}") for c in page], F.struct(*[F.col(f"`{c}`") for c in cells.columns]).alias("_cell"), "_all")
    line, cell = ({c: F.col(f"{n}.{c}").cast("double") for c in BOX} for n in ("_line", "_cell"))
    shared = lambda lo, hi: F.least(line[hi], cell[hi]) - F.greatest(line[lo], cell[lo])
    whole = lambda box: (box["x1"] > box["x0"]) & (box["y1"] > box["y0"])
    inside = lambda lo, hi: ((line[lo] + line[hi]) / 2).between(F.col(f"_cell.t_{lo}"), F.col(f"_cell.t_{hi}"))
    w, h = shared("x0", "x1"), shared("y0", "y1")
    same = (F.col("resume_id") == F.col("_resume_id")) & (F.col("page_no") == F.col("_page_no"))
    met = a.join(b, same & whole(line) & whole(cell) & (w > 0) & (h > 0) & inside("x0", "x1") & inside("y0", "y1"), "left")
    best = F.max_by(F.struct("_cell", "_all"), F.struct(w * h, *[-F.col(f"_cell.{c}") for c in place]))
    d = met.groupBy(*page, "line_no", "_line").agg(best.alias("_c")).select(*page, "_line", "_c._cell", "_c._all", *[F.col(f"_c._cell.{c}").alias(c) for c in place])
    table = Window.partitionBy(*page, "table_no")
    d = d.withColumn("_nth", F.dense_rank().over(table.orderBy("row_no", "cell_no"))).withColumn("_filled", F.max("_nth").over(table))
    real = F.col("table_no").isNotNull() & (F.col("_filled") >= LEAST_FILLED) & (2 * F.col("_filled") >= F.col("_all"))
    outside = d.filter(~F.coalesce(real, F.lit(False))).select("_line.*")
    item = F.struct(*[F.col(f"_line.{c}").cast("double").alias(c) for c in ("y0", "x0", "x1", "y1")], F.col("_line.text").alias("text"))
    held = d.filter(real).groupBy(*page, *place).agg(F.collect_list(item).alias("lines"), F.first("_cell").alias("_cell"))
    return outside, held.select(*page, *place, "lines", *[F.col(f"_cell.`{c}`").alias(c) for c in cells.columns if c not in (*page, *place)])


def read_rows(cells: DataFrame) -> DataFrame:
    """Blocks of tables in reading order: resume_id, page_no, table_no, row_no, part_no, kind, text, y0, y1.

    A row whose cells hold one printed line each is one block (kind row), its texts joined by a space; a label in its
    first cell stands alone before it (kind label): at the table's left edge, at most eight characters, and either shorter than the only
    other text or in a cell half as high again as all others. A row with a cell of several lines gives its lines cell by
    cell (kind line). ``cells`` as :func:`take_tables` gives them; one row is an array of its few cells.
    """
    text = lambda r: F.array_join(F.transform(r["items"], lambda i: i["text"]), " ")
    printed = F.transform(visual_rows(F.col("lines")), lambda r: F.struct(text(r).alias("text"), r["y0"].alias("y0"), F.array_max(F.transform(r["items"], lambda i: i["y1"])).alias("y1")))
    c = cells.withColumn("printed", printed)
    c = c.groupBy("resume_id", "page_no", "table_no", "row_no").agg(F.array_sort(F.collect_list(F.struct("x0", "cell_no", (F.col("y1") - F.col("y0")).alias("height"), "printed"))).alias("c"), F.min("t_x0").alias("left"))
    n, first = F.size("c"), F.col("c")[0]
    several = F.exists("c", lambda x: F.size(x["printed"]) > 1)
    heads = F.transform("c", lambda x: x["printed"][0])
    longer = (n == 2) & (F.length(F.col("heads")[1]["text"]) > F.length(F.col("heads")[0]["text"]))
    higher = F.forall(F.slice("c", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda x: first["height"] > 1.5 * x["height"])
    label = (n >= 2) & (F.length(F.col("heads")[0]["text"]) <= LABEL_LONGEST) & (first["x0"] - F.col("left") <= LEFT_EDGE) & (longer | higher)
    block = lambda kind, some: F.struct(F.lit(kind).alias("kind"), F.array_join(F.transform(some, lambda h: h["text"]), " ").alias("text"), F.array_min(F.transform(some, lambda h: h["y0"])).alias("y0"), F.array_max(F.transform(some, lambda h: h["y1"])).alias("y1"))
    each = F.flatten(F.transform("c", lambda x: F.transform(x["printed"], lambda h: block("line", F.array(h)))))
    split = F.array(block("label", F.slice("heads", 1, 1)), block("row", F.slice("heads", F.lit(2), n - 1)))
    c = c.withColumn("heads", heads)
    parts = F.when(several, each).when(label, split).otherwise(F.array(block("row", F.col("heads"))))
    return c.select("resume_id", "page_no", "table_no", "row_no", F.posexplode(parts).alias("part_no", "p")).select("resume_id", "page_no", "table_no", "row_no", "part_no", "p.*")
