"""Golden cases of the domain operators."""

import datetime

import pytest
from pyspark.sql import functions as F

from inkspan.functions import dates, masking, replies, text
from inkspan.operators import evidence, interview, layout, listing, matching, retrieval, sections, skills, spans, usage
from inkspan.streaming import operators as streaming


def one(spark, expression, **values):
    d = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return d.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("line", "start", "end", "present"),
    [
        ("2023.09-至今", "2023-09", None, True),
        ("2023.9-2024", "2023", "2024", False),
        ("2021-2023", "2021", "2023", False),
        ("支撑 2000 名用户同时在线", None, None, None),
    ],
)
def test_date_range(spark, line, start, end, present):
    got = one(spark, dates.find_date_range(F.col("t")), t=line)
    if start is None:
        assert got is None
    else:
        assert (got["start"], got["end"], got["is_present"]) == (start, end, present)


def test_months_between(spark):
    assert one(spark, dates.months_between(F.col("a"), F.col("b")), a="2023-09", b="2024-01") == 4
    assert one(spark, dates.months_between(F.col("a"), F.col("b")), a="2023", b="2024-01") is None


@pytest.mark.parametrize("line", ["电话 13800138000 谢谢", "邮箱 someone@example.com", "138 0013 8000", "身份证 11010519491231002X"])
def test_mask_hides_and_keeps_length(spark, line):
    got = one(spark, masking.mask_personal(F.col("t")), t=line)
    assert got != line and len(got) == len(line)


@pytest.mark.parametrize("line", ["版本 1.2.3.4 发布", "项目 https://example.com/a/b", ""])
def test_mask_leaves_other_text(spark, line):
    assert one(spark, masking.mask_personal(F.col("t")), t=line) == line


def test_mask_order_and_names(spark):
    got = one(spark, masking.mask_personal(F.col("t"), F.lit(" 王小明 ")), t="王小明 现居：北京市 | a.b@c.com 13812345678")
    assert got == "某某某 现居：某某某 | *.*@*.*** XXXXXXXXXXX"
    assert one(spark, masking.mask_personal(F.col("t"), F.lit("王")), t="王 a") == "王 a"
    assert one(spark, masking.mask_personal(F.col("t")), t=None) is None


def test_new_numbers_become_placeholders(spark):
    got = one(spark, masking.mask_new_numbers(F.col("t"), F.lit("3 个")), t="提升30%，3 个，【12】，C++11 v2.5")
    assert (got.text, got.replaced) == ("提升【数值】%，3 个，【12】，C++11 v2.5", 1)
    got = one(spark, masking.mask_new_numbers(F.col("t"), F.lit(None).cast("string"), F.lit(True)), t="5 与 50")
    assert (got.text, got.replaced) == ("5 与 【数值】", 1)
    got = one(spark, masking.fix_numbers(F.col("t"), F.lit("改成"), F.lit("7")), t="9【改成】7 到 8【问题】8")
    assert (got.text, got.replaced) == ("9【改成】7 到 【数值】【问题】8", 1)
    assert tuple(one(spark, masking.mask_new_numbers(F.col("t"), F.lit("")), t=None)) == (None, 0)


def test_heading_lookup(spark):
    known = {"教育背景": "education", "二、工作经历": "work", "项目经历 Project Experience": "projects", "技能与证书": "skills", "竞赛经历": "awards", "个人信息": "basics", "Java 项目": None, "": None, "负责项目的整体设计": None, "过往": None}
    d = spark.createDataFrame([(t,) for t in known], "title string")
    assert {r.title: r.section_type for r in sections.lookup(d).collect()} == known
    own = spark.createDataFrame([("过往", "work"), ("教育背景", "other")], "alias string, section_type string")
    assert {r.title: r.section_type for r in sections.lookup(d, headings=own).collect()} == known | {"过往": "work", "教育背景": "other"}


def _line(page, x0, y0, text, width=200, size=10.0):
    return (1, page, float(x0), float(y0), float(x0 + width), float(y0 + size), text, size, False)


def test_reading_order_of_two_columns_and_of_a_timeline(spark):
    schema = "resume_id long, page_no int, x0 double, y0 double, x1 double, y1 double, text string, font_size double, is_bold boolean"
    pages = spark.createDataFrame([(1, 1, 600.0, 800.0)], "resume_id long, page_no int, width double, height double")
    columns = [_line(1, x, 100 + 12 * k, f"{side}{k} text of a column") for k in range(5) for x, side in ((40, "l"), (340, "r"))]
    got = layout.analyze(spark.createDataFrame(columns, schema), pages).orderBy("block_index").collect()
    assert [c for b in got for c in ("l", "r") if c + "0" in b.text] == ["l", "r"] and {b.layout_type for b in got} == {"double"}
    dated = [_line(1, 40, 100 + 12 * k, f"20{10 + k}.01", 60) for k in range(5)] + [_line(1, 340, 100 + 12 * k, f"task {k}", 60) for k in range(5)]
    got = layout.analyze(spark.createDataFrame(dated, schema), pages).orderBy("block_index").collect()
    assert [b.text for b in got] == [f"20{10 + k}.01 task {k}" for k in range(5)] and {b.layout_type for b in got} == {"single"}


def test_normal_form_keeps_length(spark):
    line = "Ａ，Ｂ。“Ｃ”　— ok"
    got = one(spark, text.normalize_for_match(F.col("t")), t=line)
    assert len(got) == len(line) and got == "a,b.\"c\" - ok"


@pytest.mark.parametrize(("line", "found"), [("提升 30%", True), ("版本 v2", False), ("无数字", False), ("", False)])
def test_has_number(spark, line, found):
    assert one(spark, text.has_number(F.col("t")), t=line) is found


@pytest.mark.parametrize(("content", "level"), [("博士优先", 4), ("本科及以上", 2), ("大专", 1), ("不限", None)])
def test_degree(spark, content, level):
    assert one(spark, text.degree_level(F.col("t")), t=content) in ({level, 0} if level is None else {level})


def test_skill_lookup_prefers_longest(spark):
    entries = (("java", False, 1), ("javascript", False, 2), ("Go", True, 3))
    assert skills.find("JavaScript and Java", entries) == [(2, 0, 10), (1, 15, 19)]
    assert skills.find("Google", entries) == [] and skills.find("use Go, go", entries) == [(3, 4, 6)]


def test_similar_part_finds_small_edits():
    body = "前言。负责订单系统的重构与性能优化，吞吐提升三倍。结尾"
    got = evidence.similar_part("负责订单系统的重构和性能优化，吞吐提升三倍", body)
    assert got is not None and body[got[0] : got[1]].startswith("负责订单") and got[2] > 0.8
    assert evidence.similar_part("主导了火星登陆项目的整体架构设计与落地工作", body) is None


def test_locate_in_corpus_reports_every_place(spark):
    quotes = spark.createDataFrame([(1, "One two three four five."), (2, "absent words in any text at all")], "item_id long, text string")
    docs = spark.createDataFrame([(10, "x one two three four five y"), (11, None), (12, "")], "doc_id long, text string")
    assert [tuple(r) for r in evidence.locate_in_corpus(quotes, docs).collect()] == [(1, 10, 2, 25, 1.0, "exact")]


def test_overlaps(spark):
    ratio = lambda *x: one(spark, spans.overlap_ratio(*[F.lit(v) for v in x]))
    assert ratio(0, 10, 5, 15) == pytest.approx(0.5)
    assert ratio(0, 10, 10, 20) == 0


def test_line_offsets_give_slices_back(spark):
    body = "ab\n\ncdé\n"
    got = spans.lines_with_offsets(spark.createDataFrame([(1, body), (2, ""), (3, None)], "doc_id long, text string")).collect()
    assert all(body[r["char_start"] : r["char_end"]] == r["line"] for r in got if r["doc_id"] == 1)
    assert sum(r["doc_id"] == 1 for r in got) == 4


@pytest.mark.parametrize(
    ("mode", "score", "done", "found"),
    [("practice", 90.0, True, "practice"), ("real", 90.0, False, "incomplete"), ("real", 60.0, True, "pass"), ("real", 59.0, True, "fail")],
)
def test_verdict(spark, mode, score, done, found):
    assert one(spark, interview.verdict(F.lit(mode), F.lit(score), F.lit(60), F.lit(done))) == found


def test_topic_score_halves_weak_evidence(spark):
    t = spark.createDataFrame([(1, 0, 80.0, False), (1, 0, 20.0, True)], "session_id long, topic_idx int, score double, low_evidence boolean")
    assert interview.topic_scores(t).first()["topic_score"] == 60


def test_match_score_and_gate(spark):
    r = spark.createDataFrame([(1, "a", "skill", 1.0), (1, "b", "skill", 1.0), (2, "a", "skill", 1.0)], "report_id long, requirement_id string, category string, weight double")
    i = spark.createDataFrame([(1, "a", "hit"), (1, "b", "partial")], "report_id long, requirement_id string, status string")
    got = {x["report_id"]: (float(x["overall"]), x["passed"]) for x in matching.gate(matching.score_matches(r, i)).collect()}
    assert got == {1: (75.0, True), 2: (0.0, False)}


def test_failure_reasons(spark):
    assert one(spark, usage.failure_reason(F.col("t")), t="Error code: 429 - slow") == "请求太快，被服务商限流（429）"
    assert one(spark, text.redact_keys(F.col("t")), t="key sk-abcdefgh12345") == "key sk-***"


def test_reply_with_fence(spark):
    got = one(spark, replies.parse_reply(F.col("t"), "struct<a: int>"), t="```json\n{\"a\": 3}\n```")
    assert got["value"]["a"] == 3 and got["error"] is None
    assert one(spark, replies.parse_reply(F.col("t"), "struct<a: int>"), t="no json")["error"] == "not JSON"


def test_chunks_overlap(spark):
    body = "".join(chr(97 + i % 26) for i in range(1200))
    got = one(spark, retrieval.chunk(F.col("t")), t=body)
    assert all(c in body and len(c) <= 500 for c in got) and got[0][-80:] == got[1][:80]


def test_page_and_latest(spark):
    d = spark.range(45)
    got = listing.page(d, 2, 20, F.col("id").desc()).collect()
    assert [r["id"] for r in got] == list(range(24, 4, -1)) and got[0]["total"] == 45


def test_stream_gives_the_batch_result(spark, tmp_path):
    rows = [("a", datetime.datetime(2024, 1, 1, 0, 0, s)) for s in range(5)] + [("b", datetime.datetime(2024, 1, 1, 0, 1, 1)), ("a", datetime.datetime(2024, 1, 1, 2, 0))]
    batch = spark.createDataFrame(rows, "provider string, ts timestamp")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = streaming.rate_windows(stream, limit=3).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    key = lambda x: (str(x["minute"]), x["provider"])
    assert sorted(map(tuple, spark.table("rates").collect()), key=str) == sorted(map(tuple, streaming.rate_windows(batch, limit=3).collect()), key=str)
    assert {key(x): x["limited"] for x in spark.table("rates").collect()}[("2024-01-01 00:00:00", "a")] is True


def test_ask_history_holds_whole_turns_of_the_topic(spark):
    long = "why " * 40
    turns = [(1, 2, 0, long, "", "too short"), (1, 1, 0, "first", long, "vague"), (1, 3, 1, "other topic", "yes", None)]
    got = interview.ask_history(spark.createDataFrame(turns, "session_id int, turn_no int, topic_idx int, question string, answer string, bad string"), spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "session_id int, topic_idx int"))
    found = {r["topic_idx"]: r["history"] for r in got.collect()}
    assert found[0] == f"面试官：first\n候选人：{long}\n面试官：{long}\n候选人：（没有回答）\n（评分员认为上一答的不足：too short）"
    assert found[1] == "面试官：other topic\n候选人：yes" and found[2] is None


def test_clause_around_a_long_clause_costs_its_length(spark):
    """A clause of 500,000 characters before the sought one: a pattern tried at each of its places takes minutes."""
    import time

    long = "ab " * 166_667
    d = spark.createDataFrame([(long + ",  the clause; more", len(long) + 5), ("no end at all", 4), ("  a。 b", 4), ("a,b", 1), ("", 0)], "t string, at int")
    began = time.monotonic()
    got = [tuple(r["s"]) for r in d.select(text.clause_around(F.col("t"), F.col("at")).alias("s")).collect()]
    assert got == [(len(long) + 3, len(long) + 13), (0, 13), (5, 6), (0, 1), (0, 0)]
    assert time.monotonic() - began < 20


def test_candidates_name_the_windows_to_try():
    """Each quote that may be similar comes with few starts, the right one among them; a quote of other words is none."""
    quote = "".join(f"word{i * i} " for i in range(30)).strip()
    edited = quote[:60] + "#" + quote[61:120] + "#" + quote[121:]
    pool = evidence._Quotes((quote, "quite another sentence, of which nothing stands there"))
    body = "".join(f"filler{i * 7} " for i in range(200))
    got = pool.candidates(body + edited + " " + body)
    assert list(got) == [0] and len(body) in got[0] and len(got[0]) < len(body) / 4
    assert evidence.similar_part(quote, body + edited + " " + body, got[0]) == evidence.similar_part(quote, body + edited + " " + body) == (len(body), len(body) + len(quote), 100.0 * (len(quote) - 2) / len(quote))
    assert 0 in pool.candidates(edited[12:] + " " + body)  # clipped at the text's begin
