"""Interval work on character spans: line offsets, as-of lookup, containment, overlap, merging, marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def overlap_ratio(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Shared length over the shorter span's; 0 for empty spans."""
    shared = F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0))
    shorter = F.least(a_end - a_start, b_end - b_start)
    return F.when(shorter > 0, shared / shorter).otherwise(F.lit(0.0))


STRIDE = 256


def running_starts(sizes: Column) -> Column:
    """Sum of all earlier elements, for each element of an array of longs.

    Folds run over stretches of STRIDE elements and then over the stretches' totals, so that a long array is not copied
    once for each of its elements.
    """
    grown = lambda a: F.aggregate(a, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    once = lambda value, f: F.transform(F.array(value), f)[0]
    stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / STRIDE).cast("int")), lambda k: grown(F.slice(sizes, k * STRIDE + 1, F.lit(STRIDE))))

    def placed(parts: Column) -> Column:
        base = grown(F.transform(parts, lambda p: F.element_at(p, -1)))
        return F.flatten(F.transform(parts, lambda p, k: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: x + F.get(base, k))))

    return F.when(F.size(sizes) == 0, F.array().cast("array<bigint>")).otherwise(once(stretches, placed))


def lines_with_offsets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, line, char_start, char_end): text[char_start:char_end] == line. Offsets come from a scan inside the
    row, so no line is shuffled."""
    d = docs.select(F.col(id_col).alias(id_col), F.split(F.col(text_col), "\n", -1).alias("lines"))
    starts = running_starts(F.transform("lines", lambda x: (F.length(x) + 1).cast("long")))
    out = d.withColumn("starts", starts).select(id_col, F.posexplode(F.arrays_zip("lines", "starts")).alias("line_no", "z"))
    start = F.col("z.starts").cast("int")
    return out.select(id_col, "line_no", F.col("z.lines").alias("line"), start.alias("char_start"), (start + F.length("z.lines")).alias("char_end"))


def offsets_by_window(blocks: DataFrame, key: str, order: str, text_col: str) -> DataFrame:
    """char_start and char_end of blocks that already stand in rows, one line break between neighbours."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text_col) + 1).over(before), F.lit(0))
    return blocks.withColumn("char_start", start).withColumn("char_end", start + F.length(text_col))


def locate_blocks(points: DataFrame, blocks: DataFrame, key: str, at: str, start: str, fields: list[str]) -> DataFrame:
    """As-of join: each point with the last block that begins at or before it; points before all blocks get the first.

    A union sorted per key and one window, so a key with many blocks costs a sort, not a product.
    """
    value = F.struct(start, *fields)
    left = points.select("*", F.lit(None).cast(blocks.select(value.alias("v")).schema["v"].dataType).alias("_block"), F.col(at).alias("_at"), F.lit(1).alias("_kind"))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != key else F.col(key) for f in points.schema.fields]
    right = blocks.select(*empty, value.alias("_block"), F.col(start).alias("_at"), F.lit(0).alias("_kind"))
    w = Window.partitionBy(key).orderBy("_at", "_kind")
    both = left.unionByName(right)
    seen = F.last("_block", ignorenulls=True).over(w)
    first = F.first("_block", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    out = both.withColumn("_found", F.coalesce(seen, first)).filter("_kind = 1")
    return out.select(*points.columns, *[F.col(f"_found.{c}").alias(f"block_{c}") for c in (start, *fields)])


def section_at(sections: Column, at: Column) -> Column:
    """Type of the first section that holds an offset; other if none does. sections: array of structs."""
    hit = F.get(F.filter(sections, lambda s: (s["char_start"] <= at) & (at < s["char_end"])), F.lit(0))
    return F.coalesce(hit["type"], F.lit("other"))


def drop_duplicates_of(findings: DataFrame, rules: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """Model findings without those that a rule finding of the same category covers by half of the shorter span."""
    r = rules.select(F.col(key).alias("_k"), F.col("category").alias("_c"), F.col("char_start").alias("_s"), F.col("char_end").alias("_e"))
    same = (F.col(key) == F.col("_k")) & (F.col("category") == F.col("_c")) & (overlap_ratio(F.col("char_start"), F.col("char_end"), F.col("_s"), F.col("_e")) >= least)
    return findings.join(r, same, "left_anti")


def merged_intervals(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Union of each key's intervals: gaps and islands over the running maximum of the ends."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    marked = df.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(w))
    return marked.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def runs(df: DataFrame, key: str, order: str, flag: str) -> DataFrame:
    """Consecutive rows of equal flag: key, run number, first and last order value, length, flag."""
    w = Window.partitionBy(key).orderBy(order)
    change = F.when(F.lag(flag).over(w).eqNullSafe(F.col(flag)), 0).otherwise(1)
    return df.withColumn("_c", change).withColumn("run", F.sum("_c").over(w)).groupBy(key, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), F.first(flag).alias(flag))


def segments_under_marks(blocks: DataFrame, marks: DataFrame, key: str, chunk: int = 4096) -> DataFrame:
    """Blocks cut at every mark border: key, start, end, mark (the one of highest priority over the piece, on ties the first
    by ordinal; null if none) and marks (all over it, by ordinal).

    A sweep over the sorted borders of each stretch of ``chunk`` characters, with the marks that are open; stretches of one
    key are swept apart, so a key with many marks is split. A cut that only a stretch's border made begins no piece: a piece ends
    where its block's next one begins, or with its block.
    blocks: key, char_start, char_end, not overlapping; marks: key, ordinal (unique in a key), mark_start, mark_end, priority, mark. An
    empty mark cuts, but covers nothing; marks outside of blocks and empty blocks leave nothing.
    """
    mark = F.struct("ordinal", "priority", "mark")
    none = F.lit(None).cast(marks.select(mark.alias("m")).schema["m"].dataType)
    held = "struct<start:bigint,end:bigint>"
    block = F.struct(F.col("char_start").cast("long").alias("start"), F.col("char_end").cast("long").alias("end"))

    def events(df: DataFrame, lo: str, hi: str, opens: int, value: Column, whole: Column) -> DataFrame:
        at = lambda c: F.floor(F.col(c) / chunk)
        d = df.withColumn("_c", F.explode(F.sequence(at(lo), F.greatest(at(hi), at(lo)))))
        start, end = F.greatest(F.col(lo), F.col("_c") * chunk), F.least(F.col(hi), (F.col("_c") + 1) * chunk)
        # what is empty here only cuts: kind 4
        event = lambda pos, kind, real: F.struct(pos.cast("long").alias("at"), F.when(end > start, kind).otherwise(4).alias("kind"), real.alias("real"), whole.cast(held).alias("block"), value.alias("mark"))
        return d.select(key, "_c", F.explode(F.array(event(start, opens, start == F.col(lo)), event(end, opens - 2, end == F.col(hi)))).alias("e"))

    both = events(blocks.filter("char_end > char_start"), "char_start", "char_end", 2, none, block)
    both = both.unionByName(events(marks, "mark_start", "mark_end", 3, mark, F.lit(None)))
    swept = both.groupBy(key, "_c").agg(F.array_sort(F.collect_list("e"), lambda a, b: F.when(a["at"] != b["at"], F.signum(a["at"] - b["at"]).cast("int")).otherwise(F.signum(a["kind"] - b["kind"]).cast("int"))).alias("_e"))
    m = marks.select(mark.alias("m")).schema["m"].dataType.simpleString()
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("real"), F.lit(None).cast(held).alias("block"), F.array().cast(f"array<{m}>").alias("open"), F.array().cast(f"array<struct<start:bigint,block:{held},open:array<{m}>>>").alias("out"))

    def step(s: Column, e: Column) -> Column:
        on = e["at"] > s["at"]
        piece = F.struct(s["at"].alias("start"), s["block"].alias("block"), s["open"].alias("open"))
        return F.struct(
            e["at"].alias("at"),
            (e["real"] | (~on & s["real"])).alias("real"),
            F.when(e["kind"] == 2, e["block"]).when(e["kind"] == 0, F.lit(None)).otherwise(s["block"]).alias("block"),
            F.when(e["kind"] == 3, F.concat(s["open"], F.array(e["mark"]))).when(e["kind"] == 1, F.filter(s["open"], lambda x: x["ordinal"] != e["mark"]["ordinal"])).otherwise(s["open"]).alias("open"),
            F.when(on & s["real"] & s["block"].isNotNull(), F.concat(s["out"], F.array(piece))).otherwise(s["out"]).alias("out"),
        )

    pieces = swept.select(key, F.explode(F.aggregate("_e", zero, step, lambda s: s["out"])).alias("p")).select(key, "p.*")
    # what is sorted by block holds the names of the marks and not the marks
    best = F.array_sort(F.transform("open", lambda x: F.struct((-x["priority"]).alias("p"), x["ordinal"].alias("o"), x["mark"].alias("mark"))))
    named = F.array_sort(F.transform("open", lambda x: F.struct(x["ordinal"].alias("o"), x["mark"].alias("mark"))))
    got = pieces.select(key, "start", F.col("block.start").alias("_from"), F.col("block.end").alias("_to"), F.get(best, F.lit(0))["mark"].alias("mark"), F.transform(named, lambda x: x["mark"]).alias("marks"))
    after = F.lead("start").over(Window.partitionBy(key, "_from").orderBy("start"))
    return got.select(key, "start", F.coalesce(after, F.col("_to")).alias("end"), "mark", "marks")
