"""Staged tables, seed merges, positions, late columns, swept marks, boxes and sections against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from inkspan.operators import listing, sections, spans, tables
from inkspan.operators.ranking import with_position
from inkspan.sources import io, staged

BLOCK = "resume_id string, block_index int, text string"


def stored(spark, path, version=None):
    return sorted(map(tuple, staged.read_current(spark, path, version).collect()), key=str)


def test_replacing_by_key_shows_old_or_new_rows(spark, tmp_path):
    path = f"file://{tmp_path}/blocks"
    first = [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z"), (None, 0, "n"), *[(f"k{i}", 0, "t") for i in range(50)]]
    assert staged.replace_by_key(spark.createDataFrame(first, BLOCK), path, "resume_id", buckets=8) == 1
    assert stored(spark, path) == sorted(first, key=str)
    again = [("a", 0, "new"), (None, 5, "m"), ("b", None, None)]  # b leaves no rows behind
    assert staged.replace_by_key(spark.createDataFrame(again, BLOCK), path, "resume_id") == 2
    want = sorted([r for r in first if r[0] not in ("a", "b", None)] + again[:2], key=str)
    assert stored(spark, path) == want and stored(spark, path, 1) == sorted(first, key=str)
    assert staged.replace_by_key(spark.createDataFrame([], BLOCK), path, "resume_id") == 3 and stored(spark, path) == want
    assert staged.clean_up(spark, path) >= 0 and stored(spark, path) == want and staged.versions(spark, path) == [3]


def test_an_unfinished_write_is_not_seen_and_a_second_writer_fails(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/blocks"
    staged.replace_by_key(spark.createDataFrame([("a", 0, "x")], BLOCK), path, "resume_id")
    with monkeypatch.context() as m:
        m.setattr(staged, "_commit", lambda *a: (_ for _ in ()).throw(OSError("died")))
        with pytest.raises(OSError):
            staged.replace_by_key(spark.createDataFrame([("a", 0, "lost")], BLOCK), path, "resume_id")
    assert stored(spark, path) == [("a", 0, "x")]
    with pytest.raises(RuntimeError):
        staged._commit(spark, path, 1, {})
    assert staged.clean_up(spark, path) == 1 and stored(spark, path) == [("a", 0, "x")]
    with pytest.raises(FileNotFoundError):
        staged.read_current(spark, f"{path}-none")


def test_a_seed_list_keeps_ids_and_marks_what_is_gone(spark):
    schema = "id long, title string, raw_text string, is_deleted boolean, is_template boolean"
    old = [(1, "A", "a", False, True), (2, "B", "b", True, True), (3, "C", "c", False, True), (4, "D", "d", True, True), (7, "A", "mine", False, False), (8, None, "t", False, True)]
    new = spark.createDataFrame([("B", "b2"), ("A", "a2"), ("E", "e"), ("Da", "da"), (None, "ignored")], "title string, raw_text string")
    got = io.merge_seed(spark.createDataFrame(old, schema), new, "title", scope=F.col("is_template")).collect()
    assert sorted(map(tuple, got)) == [
        (1, "A", "a2", False, True, "updated"), (2, "B", "b2", False, True, "updated"), (3, "C", "c", True, True, "deleted"), (4, "D", "d", True, True, "kept"),
        (7, "A", "mine", False, False, "kept"), (8, None, "t", False, True, "kept"), (9, "Da", "da", False, None, "inserted"), (10, "E", "e", False, None, "inserted"),
    ]
    fresh = io.merge_seed(spark.createDataFrame([], schema), new, "title").select("id", "title").collect()
    assert sorted(map(tuple, fresh)) == [(1, "A"), (2, "B"), (3, "Da"), (4, "E")]


def test_positions_are_those_of_one_sort(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(50), i) for i in range(3000)]
    got = with_position(spark.createDataFrame(rows, "a int, b int").repartition(7), F.col("a").desc(), "b").collect()
    want = {r: i for i, r in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1)}
    assert {(r["a"], r["b"]): r["position"] for r in got} == want
    assert with_position(spark.createDataFrame([], "a int"), "a").collect() == []


def test_wide_columns_are_read_late(spark, tmp_path):
    path = f"file://{tmp_path}/docs"
    spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") * 37 % 101).alias("n"), F.repeat(F.lit("w"), F.lit(50)).alias("text")).write.parquet(path)
    got = listing.deferred(spark.read.parquet(path), "doc_id", 5, [F.col("n").desc(), F.col("doc_id")], ["n"], ["text"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "FileScan" in x]
    assert len(scans) == 2 and ["text" in s.split("ReadSchema")[1] for s in scans].count(True) == 1
    sorted_part = plan[plan.index("TakeOrderedAndProject") :].split("\n")[0]
    assert "text" not in sorted_part and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(sorted(range(500), key=lambda i: (-(i * 37 % 101), i))[:5])
    with pytest.raises(ValueError):
        listing.deferred(got, "doc_id", 0, [F.col("n")], ["n"], ["text"])


def test_running_starts_of_long_arrays(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        sizes = [i % 7 for i in range(n)]
        got = spark.createDataFrame([(sizes,)], "a array<bigint>").select(spans.running_starts(F.col("a")).alias("s")).first()["s"]
        assert got == [sum(sizes[:i]) for i in range(n)]


def cut_up(blocks, marks):
    out = []
    for k, s, e in blocks:
        mine = [m for m in marks if m[0] == k and m[2] < e and m[3] > s]
        points = sorted({s, e} | {max(m[2], s) for m in mine} | {min(m[3], e) for m in mine})
        for a, b in zip(points, points[1:], strict=False):
            over = [m for m in mine if m[2] < b and m[3] > a]
            top = min(over, key=lambda m: (-m[4], m[1]))[5] if over else None
            out.append((k, a, b, top, [m[5] for m in sorted(over, key=lambda m: m[1])]))
    return sorted(out, key=str)


def test_marks_swept_in_stretches_cut_as_if_whole(spark):
    rng = random.Random(4)
    blocks, marks = [], []
    for k in ("a", "b", None):
        at = 0
        for _ in range(12):
            e = at + rng.randrange(0, 60)
            if e > at:
                blocks.append((k, at, e))
            at = e + rng.randrange(0, 3)
        if k is not None:
            marks += [(k, i, s := rng.randrange(0, 320), s + rng.choice([0, 1, 5, 40, 200]), rng.randrange(3), f"m{i}") for i in range(40)]
    b = spark.createDataFrame(blocks, "doc string, char_start int, char_end int")
    m = spark.createDataFrame(marks, "doc string, ordinal int, mark_start int, mark_end int, priority int, mark string")
    for chunk in (16, 50, 4096):
        assert sorted(map(tuple, spans.segments_under_marks(b, m, "doc", chunk).collect()), key=str) == cut_up(blocks, marks)
    assert all(r["mark"] is None for r in spans.segments_under_marks(b, m.limit(0), "doc").collect()) and spans.segments_under_marks(b.limit(0), m, "doc").collect() == []


def test_boxes_meet_once_whatever_the_squares(spark):
    rng = random.Random(6)
    made = lambda n: [(i % 3, i, x := rng.uniform(0, 300), y := rng.uniform(0, 300), x + rng.choice([0, 5, 80]), y + rng.choice([3, 120])) for i in range(n)]
    left, right = made(40), made(50)
    want = {}
    for ka, i, ax0, ay0, ax1, ay1 in left:
        for kb, j, bx0, by0, bx1, by1 in right:
            w, h = min(ax1, bx1) - max(ax0, bx0), min(ay1, by1) - max(ay0, by0)
            if ka == kb and w > 0 and h > 0:
                want[i, j] = round(w * h, 6)
    frame = lambda rows, n: spark.createDataFrame(rows, f"page int, {n}_id int, {n}_x0 double, {n}_y0 double, {n}_x1 double, {n}_y1 double")
    for size in (7.0, 64.0, 1000.0):
        got = tables.overlapping(frame(left, "a"), frame(right, "b"), ["page"], size=size).collect()
        assert len(got) == len(want) and {(r["a_id"], r["b_id"]): round(r["area"], 6) for r in got} == want


def read_table(spark, lines, cells):
    page = lambda rows: [(1, 1, *r) for r in rows]
    box = "x0 double, y0 double, x1 double, y1 double"
    l_ = spark.createDataFrame(page(lines), f"resume_id long, page_no int, line_no int, {box}, text string")
    c = spark.createDataFrame(page(cells), f"resume_id long, page_no int, table_no int, row_no int, cell_no int, {box}, t_x0 double, t_y0 double, t_x1 double, t_y1 double")
    outside, held = tables.take_tables(l_, c)
    return [r["text"] for r in outside.orderBy("line_no").collect()], [(r["kind"], r["text"]) for r in tables.read_rows(held).orderBy("row_no", "part_no").collect()]


def grid(rows, widths, merged=()):
    xs = [40.0]
    for w in widths:
        xs.append(xs[-1] + w)
    frame = (40.0, 100.0, xs[-1], 100.0 + 20 * len(rows))
    lines, cells = [], []
    for r, row in enumerate(rows):
        for c, text in enumerate(row):
            if text is None:
                continue
            bottom = 120.0 + 20 * r + (20 if (r, c) in merged else 0)
            cells.append((0, r, c, xs[c], 100.0 + 20 * r, xs[c + 1], bottom, *frame))
            for k, part in enumerate(text.split("\n") if text else []):
                lines.append((len(lines), xs[c] + 2, 102.0 + 20 * r + 9 * k, xs[c] + 4 + 7 * len(part), 110.0 + 20 * r + 9 * k, part))
    return lines, cells


def test_tables_are_read_row_by_row(spark):
    lines, cells = grid([["时间", "学校", "专业"], ["2022.09-2026.06", "江城大学", "计算机"]], [170, 180, 165])
    lines.append((99, 40.0, 20.0, 100.0, 30.0, "above the table"))
    assert read_table(spark, lines, cells) == (["above the table"], [("row", "时间 学校 专业"), ("row", "2022.09-2026.06 江城大学 计算机")])
    lines, cells = grid([["教育背景", "2022.09-2026.06", "江城大学"], [None, "2019.09", "江城一中"], ["获奖情况", "2024 年蓝桥杯省二等奖", None]], [90, 165, 160], merged={(0, 0)})
    assert read_table(spark, lines, cells)[1] == [("label", "教育背景"), ("row", "2022.09-2026.06 江城大学"), ("row", "2019.09 江城一中"), ("label", "获奖情况"), ("row", "2024 年蓝桥杯省二等奖")]
    lines, cells = grid([["项目经历", "订单系统\n负责支付"], ["技能", "Java"]], [90, 300])
    assert read_table(spark, lines, cells)[1] == [("line", "项目经历"), ("line", "订单系统"), ("line", "负责支付"), ("label", "技能"), ("row", "Java")]
    lines, cells = grid([["only", "", ""], ["three", "", "words"]], [90, 90, 90])  # half filled but under four cells: no table
    assert read_table(spark, lines, cells) == (["only", "three", "words"], [])


def layout_of(spark, rows):
    """(text, size, bold, white above) as blocks."""
    at, y, out = 0, 40.0, []
    for i, (text, size, bold, gap) in enumerate(rows):
        y += gap
        out.append((1, i, 1, 0, y, y + size, text, float(size), bold, at, at + len(text)))
        y, at = y + size + 2, at + len(text) + 1
    return spark.createDataFrame(out, "resume_id long, block_index int, page_no int, column_index int, y0 double, y1 double, text string, font_size double, is_bold boolean, char_start int, char_end int")


def built(blocks, headings):
    return [(r["type"], r["title"], r["block_start"], r["block_end"], r["matched_by"]) for r in sections.build_sections(blocks, headings).orderBy("block_start").collect()]


BODY = ("负责接口的设计与实现，并且编写了全部单元测试用例。", 10.5, False, 2)


def test_candidates_wait_for_decisions(spark):
    blocks = layout_of(spark, [("张三", 10.5, False, 0), ("教育背景", 10.5, True, 12), BODY, ("技术沉淀", 10.5, True, 12), BODY, ("校园二手平台", 10.5, True, 12), BODY, ("开源贡献", 14, True, 20), BODY])
    h = sections.find_headings(blocks)
    assert built(blocks, h) == [("basics", "", 0, 0, "implicit"), ("education", "教育背景", 1, 2, "dict"), ("other", "技术沉淀", 3, 4, "style"), ("other", "校园二手平台", 5, 6, "style"), ("other", "开源贡献", 7, 8, "feature")]
    said = spark.createDataFrame([(1, 3, "skills"), (1, 5, "none"), (1, 1, "work"), (1, 7, "basics")], "resume_id long, block_index int, type string")
    merged = sections.apply_decisions(h, said)
    assert built(blocks, merged) == [("basics", "", 0, 0, "implicit"), ("education", "教育背景", 1, 2, "dict"), ("skills", "技术沉淀", 3, 6, "llm"), ("other", "开源贡献", 7, 8, "feature")]
    unsaid = sections.apply_decisions(h, said.limit(0))  # candidates by style alone fall to the section before
    assert built(blocks, unsaid)[1:] == [("education", "教育背景", 1, 6, "dict"), ("other", "开源贡献", 7, 8, "feature")]


@pytest.mark.parametrize(("line", "cut"), [("江城大学 计算机 本科 2022.09-2026.06", True), ("江城大学 本科 电话 13800000000", False), ("现居：江城市大学城 18 栋", False)])
def test_education_at_the_end_of_the_header(spark, line, cut):
    rows = [("张三", 20, True, 0), (line, 10.5, False, 4), ("项目经历", 12, True, 20), BODY]
    blocks = layout_of(spark, rows)
    types = [x[0] for x in built(blocks, sections.find_headings(blocks))]
    assert types == (["basics", "education", "projects"] if cut else ["basics", "projects"])


def test_basics_come_from_the_head(spark):
    rows = [("个人简历", 20, True, 0), ("李四", 16, True, 2), ("电话：138 0000-1111 邮箱 li@example.com", 10.5, False, 2), ("籍贯 湖南长沙 民族 汉族", 10.5, False, 2), ("项目地址：上海", 10.5, False, 2), *[BODY] * 5, ("late@example.com", 10.5, False, 2)]
    got = sections.extract_basics(layout_of(spark, rows)).first()
    assert tuple(got)[1:] == ("李四", "li@example.com", "13800001111", "湖南长沙")
    labelled = sections.extract_basics(layout_of(spark, [("王五", 20, True, 0), ("姓名：赵六 性别 男", 10, False, 2)])).first()
    assert labelled["name"] == "赵六" and labelled["email"] is None and labelled["phone"] is None
    none = spark.createDataFrame([(1, "basics", 0, 0)], "resume_id long, type string, block_start int, block_end int")
    assert sections.extract_basics(layout_of(spark, rows), none).first()["email"] is None
