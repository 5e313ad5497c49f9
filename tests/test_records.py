"""Golden cases of structure extraction, prompt texts, page lists and upkeep."""

import pytest
from pyspark.sql import functions as F

from inkspan.operators import context, evidence, pages, structure, upkeep

FULL = "Work\nShop A 2021.03-2022.05\nBuilt a cart\nSkills\nPython, Spark"
BLOCKS = [(1, 0, "Work", 0, 4), (1, 1, "Shop A 2021.03-2022.05", 5, 27), (1, 2, "Built a cart", 28, 40), (1, 3, "Skills", 41, 47), (1, 4, "Python, Spark", 48, 61)]


@pytest.fixture()
def resume(spark):
    blocks = spark.createDataFrame(BLOCKS, "resume_id int, block_index int, text string, char_start int, char_end int")
    sections = spark.createDataFrame([(1, 0, "work", "dict", 0, 2), (1, 1, "skills", "dict", 3, 4), (1, 2, "awards", "dict", 3, 3)], "resume_id int, section_id int, type string, matched_by string, block_start int, block_end int")
    return structure.section_blocks(sections, blocks), spark.createDataFrame([(1, FULL)], "resume_id int, full_text string")


def test_entries_take_text_and_dates_from_the_source(spark, resume):
    replies = spark.createDataFrame(
        [(1, 0, '{"entries": [{"name": "Shop A", "block_ids": [2, 1, 77], "tech_stack": [" Spark ", ""], "highlights": [{"block_ids": [2]}, {"block_ids": [0]}]}, {"name": "made up", "block_ids": [9]}]}'), (1, 1, "no json"), (1, 2, None)],
        "resume_id int, section_id int, reply string",
    )
    got = structure.extract_entries(replies, *resume).collect()
    assert len(got) == 1
    e = got[0]
    assert (e.name, e.block_ids, e.char_start, e.char_end, e.tech_stack) == ("Shop A", [1, 2], 5, 40, ["Spark"])
    assert (e.start, e.end, e.is_present) == ("2021-03", "2022-05", False)
    assert [(h.text, h.block_ids) for h in e.highlights] == [("Built a cart", [2])]


def test_skills_must_stand_in_the_claimed_block(spark, resume):
    items = '{"items": [{"name": "Spark", "level": "good", "block_id": 4}, {"name": "spark", "block_id": 4}, {"name": "Java", "block_id": 4}, {"name": "Python", "block_id": 1}, {"name": " ", "block_id": 4}]}'
    got = structure.extract_skills(spark.createDataFrame([(1, 1, items)], "resume_id int, section_id int, reply string"), *resume).collect()
    assert [(s.name, s.level, FULL[s.char_start : s.char_end]) for s in got] == [("Spark", "good", "Spark")]


def test_block_span_edges(spark):
    rows = spark.createDataFrame([([5, 3],), ([],), (None,), ([1],), ([4, 4, None],)], "ids array<int>")
    assert [r[0] for r in rows.select(structure.block_span(F.col("ids"), F.lit(2), F.lit(6))).collect()] == [[3, 4, 5], None, None, None, [4]]


def test_a_kept_problem_is_not_kept_again(spark):
    rows = [(1, 1, 0, "vague", 0, 10, "exact"), (1, 2, 0, "vague", 5, 20, "exact"), (1, 2, 1, "vague", 15, 30, "fuzzy"), (1, 3, 0, "incoherent", 5, 8, "exact"), (1, 3, 1, "vague", 40, 50, "failed"), (2, 1, 0, "vague", None, None, None)]
    f = spark.createDataFrame(rows, "unit int, attempt_no int, item_no int, risk_type string, char_start int, char_end int, verify_result string")
    got = sorted((r.unit, r.attempt_no, r.item_no) for r in evidence.keep_first_reports(f, "unit").collect())
    assert got == [(1, 1, 0), (1, 2, 1), (1, 3, 0)]  # the second overlaps the first; the third overlaps only a dropped one


def test_a_quote_of_another_unit_fails(spark):
    rows = spark.createDataFrame([((3, 6, 1.0, "exact"), 0, 10), ((3, 6, 0.9, "fuzzy"), 5, 10), (None, 0, 10)], "span struct<start: int, end: int, score: double, method: string>, unit_start int, unit_end int")
    assert [(r.verify_result, r.match_score, r.char_start) for r in evidence.judge_in_unit(rows).collect()] == [("exact", 1.0, 3), ("failed", 0.9, None), ("failed", 0.0, None)]


def test_empty_texts_say_so(spark):
    s = spark.createDataFrame([(1, 0, "Notes", None, "style", True), (2, 0, "Work", "x", "dict", False)], "resume_id int, block_start int, title string, content string, matched_by string, needs_llm boolean")
    assert [tuple(r) for r in context.section_candidates(s).collect()] == [(1, "（没有）", "[#1] Notes\n    下面的内容：（没有内容）")]
    t = spark.createDataFrame([(1, 0, 0, 0, None, "a" * 400, False, None, None, "")], "session_id int, turn_no int, topic_idx int, depth int, question string, answer string, skipped boolean, score int, good string, bad string")
    assert context.summary_turns(t).collect()[0].turns == "[话题 1] 问：\n答：" + "a" * 300 + "\n得分 None；好在：无；不足：无"


def test_axis_tops_and_ages(spark):
    d = spark.createDataFrame([(0.0, "2024-01-02"), (7.0, "2024-01-01"), (0.031, "2023-12-30"), (1000.0, None), (None, "2024-01-05")], "v double, day string")
    got = d.select(pages.axis_top(F.col("v")), pages.age_text(F.to_date("day"), F.lit("2024-01-02").cast("date"))).collect()
    assert [(round(r[0], 6), r[1]) for r in got] == [(1, "今天"), (8, "昨天"), (0.04, "3 天前"), (1000, None), (1, "今天")]


def test_tabs_and_unknown_tab(spark):
    a = spark.createDataFrame([(1, "success", True), (1, "success", False), (1, "running", None), (2, "success", None)], "user_id int, status string, passed boolean")
    assert sorted(tuple(r) for r in pages.apply_tabs(a).collect()) == [(1, 3, 1, 1), (2, 1, 0, 0)]
    assert [pages.in_tab(a, t).count() for t in ("all", "pass", "fail")] == [4, 1, 1]
    with pytest.raises(ValueError):
        pages.in_tab(a, "none")


def test_upkeep_of_odd_rows(spark):
    tasks = spark.createDataFrame([(1, "running", None), (2, None, "x"), (3, "success", None)], "id int, status string, error_msg string")
    assert [(r.status, r.error_msg) for r in upkeep.mark_interrupted(tasks).collect()] == [("failed", "interrupted"), (None, "x"), ("success", None)]
    users = spark.createDataFrame([(1, "lt_001"), (2, "ltx"), (3, None)], "id int, username string")
    left, rows = upkeep.without_users(users, spark.createDataFrame([(1, 7), (2, 8), (None, 9)], "user_id int, row int"))
    assert sorted(r.id for r in left.collect()) == [2, 3] and sorted(r.row for r in rows.collect()) == [8, 9]
    assert upkeep.clone_rows(tasks, 0).count() == 0 and upkeep.clone_rows(tasks, 1001).filter("username = 'lt_1000'").count() == 3
