"""Texts that are put before a model: numbered blocks, candidates, summaries of rules, requirements, gaps and turns.

Every function aggregates within one section, unit, report or session, in a stated order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Lengths and words that the texts are defined by.
PREVIEW, ANSWER_PREVIEW = 80, 300
REQUIREMENT_KINDS = {"hard": "必须项", "plus": "加分项", "soft": "软素质"}
ENTRY_KINDS = {"projects": "项目", "work": "经历"}


def _joined(line: Column, *order: str, between: str = "\n") -> Column:
    """Lines of a group in order, as one text; null lines are left out."""
    kept = F.sort_array(F.collect_list(F.when(line.isNotNull(), F.struct(*order, line.alias("_line")))))
    return F.array_join(F.transform(kept, lambda x: x["_line"]), between)


def _or(c: Column, instead: str) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", instead).otherwise(c)


def _named(c: Column, names: dict[str, str], instead: str) -> Column:
    return F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in names.items()], F.lit(instead))


def numbered_blocks(blocks: DataFrame, *keys: str) -> DataFrame:
    """Per group the lines ``[#number] text`` by number; a null text is empty."""
    line = F.concat(F.lit("[#"), F.col("block_index").cast("string"), F.lit("] "), F.coalesce("text", F.lit("")))
    return blocks.groupBy(*keys).agg(_joined(line, "block_index").alias("listing"))


def section_candidates(sections: DataFrame) -> DataFrame:
    """Per document the headings to be classified, numbered from 1 with the start of their content, and the known titles.

    sections: resume_id, block_start, title, content, matched_by, needs_llm. Documents without a candidate have no row.
    """
    preview = _or(F.replace(F.left(F.coalesce("content", F.lit("")), F.lit(PREVIEW)), F.lit("\n"), F.lit(" / ")), "（没有内容）")
    ask = F.sort_array(F.collect_list(F.when(F.col("needs_llm"), F.struct("block_start", "title", preview.alias("preview")))))
    known = _joined(F.when(F.col("matched_by") == "dict", F.col("title")), "block_start", between="、")
    got = sections.groupBy("resume_id").agg(ask.alias("ask"), _or(known, "（没有）").alias("known")).filter("size(ask) > 0")
    line = lambda x, i: F.concat(F.lit("[#"), (i + 1).cast("string"), F.lit("] "), x["title"], F.lit("\n    下面的内容："), x["preview"])
    return got.select("resume_id", "known", F.array_join(F.transform("ask", line), "\n").alias("candidates"))


def rule_summary(findings: DataFrame, *order: str) -> DataFrame:
    """Per document and unit the titles of its rule findings, one line each; findings of no unit are left out."""
    return findings.filter("unit_id IS NOT NULL").groupBy("resume_id", "unit_id").agg(_joined(F.concat(F.lit("- "), F.col("title")), *order).alias("summary"))


def requirement_list(requirements: DataFrame, key: str = "job_id") -> DataFrame:
    """Per job the lines ``id. text``, in the order of the ids."""
    return requirements.groupBy(key).agg(_joined(F.concat(F.col("requirement_id").cast("string"), F.lit(". "), F.col("text")), "requirement_id").alias("listing"))


def _cut(text: Column, start: Column, end: Column) -> Column:
    return F.when(start.isNotNull() & end.isNotNull(), F.substring(text, start + 1, end - start)).otherwise("")


def finding_context(findings: DataFrame, structure: DataFrame) -> DataFrame:
    """Each finding with the entry it belongs to: label, entry_text, sentence, evidence.

    findings: resume_id, unit_id, char_start, char_end, title. structure: resume_id, masked_text, work and projects
    (arrays of name, role, char_start, char_end, highlights). A unit reads ``work[0].highlights[2]``; one that names no
    entry gets all entries and the line around its start; a missing highlight gets the whole entry.
    """
    part = lambda i: F.regexp_extract(F.coalesce("unit_id", F.lit("")), r"^(work|projects)\[(\d+)\](?:\.highlights\[(\d+)\])?$", i)
    d = findings.join(structure, "resume_id").withColumns({"_kind": part(1), "_i": F.try_to_number(part(2), F.lit("999999999")).cast("int"), "_h": F.try_to_number(part(3), F.lit("999999999")).cast("int")})
    none = F.array().cast(structure.schema["work"].dataType)
    work, projects, text = F.coalesce("work", none), F.coalesce("projects", none), F.col("masked_text")
    d = d.withColumn("_e", F.get(F.when(F.col("_kind") == "work", work).when(F.col("_kind") == "projects", projects), F.col("_i")))
    own = {c: F.coalesce(F.get("_e.highlights", F.col("_h"))[c], F.col(f"_e.{c}")) for c in ("char_start", "char_end")}
    at = F.col("char_start")
    before, after = F.substring_index(F.substring(text, F.lit(1), at), "\n", -1), F.substring_index(F.substring(text, at + 1, F.length(text)), "\n", 1)
    sentence = F.when(F.col("_e").isNotNull(), _cut(text, own["char_start"], own["char_end"])).when(at.isNotNull(), F.concat(before, after))
    every = F.array_join(F.transform(F.concat(work, projects), lambda e: _cut(text, e["char_start"], e["char_end"])), "\n")
    label = F.concat(_named(F.col("_kind"), ENTRY_KINDS, ""), F.lit("："), _or(F.col("_e.name"), "未命名"), F.lit("（"), _or(F.col("_e.role"), "角色未写"), F.lit("）"))
    return d.select(
        *[F.col(c) for c in findings.columns],
        F.when(F.col("_e").isNull(), "全部工作 / 项目经历").otherwise(label).alias("label"),
        _or(F.when(F.col("_e").isNull(), every).otherwise(_cut(text, F.col("_e.char_start"), F.col("_e.char_end"))), "（简历里没有工作 / 项目经历）").alias("entry_text"),
        F.coalesce(F.when(sentence != "", sentence), "title").alias("sentence"),
        _or(_cut(text, at, F.col("char_end")), "（针对整份简历）").alias("evidence"),
    )


def gap_context(items: DataFrame, requirements: DataFrame) -> DataFrame:
    """Each unmet item with its kind, the job's own words (its content where the requirement is gone or has none), state
    and reason. items: job_id, requirement_id, content, req_type, status, reason; requirements: job_id, requirement_id, quote."""
    d = items.join(requirements.select("job_id", "requirement_id", "quote"), ["job_id", "requirement_id"], "left")
    return d.select(
        *[c for c in items.columns if c not in ("req_type", "status", "reason")], _named(F.col("req_type"), REQUIREMENT_KINDS, "要求").alias("req_type"),
        F.coalesce(F.when(F.col("quote") != "", F.col("quote")), "content").alias("quote"), F.when(F.col("status") == "miss", "缺失").otherwise("部分满足").alias("status"), _or(F.col("reason"), "无").alias("reason"),
    )


def plan_context(materials: DataFrame) -> DataFrame:
    """Per session three texts: requirements, experiences (a blank line between them) and findings.

    materials: session_id, source, position, code, kind, name, text, status.
    """
    line = {
        "requirement": F.concat("code", F.lit(" ["), "kind", F.lit("] "), "text", F.lit(" —— "), "status"),
        "experience": F.concat("code", F.lit(" "), "kind", F.lit("："), "name", F.lit("\n"), "text"),
        "finding": F.concat("code", F.lit(" "), "name", F.lit(" —— 「"), "text", F.lit("」")),
    }
    texts = [_or(_joined(F.when(F.col("source") == s, c), "position", between="\n\n" if s == "experience" else "\n"), "（无）").alias(f"{s}s") for s, c in line.items()]
    return materials.groupBy("session_id").agg(*texts)


def describe_source(source: Column, item: Column) -> Column:
    """The material of a topic as text, by kind of source; item: struct of kind, name, text, status, reason, quote; its
    null fields are empty."""
    f = lambda name: F.coalesce(item[name], F.lit(""))
    why = F.when(f("reason") == "", "").otherwise(F.concat(F.lit("（"), f("reason"), F.lit("）")))
    project = F.concat(F.lit("简历里的"), F.coalesce(item["kind"], F.lit("经历")), F.lit("："), f("name"), F.lit("\n"), f("text"))
    requirement = F.concat(F.lit("岗位要求（"), f("kind"), F.lit("）："), f("text"), F.lit("\n初筛判定："), f("status"), why)
    finding = F.concat(F.lit("简历原文：「"), f("quote"), F.lit("」\n初筛发现的问题："), f("name"), F.lit("——"), f("text"))
    return F.when(source == "project", project).when(source == "requirement", requirement).otherwise(finding)


def summary_turns(turns: DataFrame) -> DataFrame:
    """Per session its turns as text, a blank line between them: the question, the first 300 characters of the answer
    (that length is the feature), score, good and bad points; skipped turns say so.

    turns: session_id, turn_no, topic_idx, depth, question, answer, skipped, score, good, bad.
    """
    head = F.concat(F.lit("[话题 "), (F.col("topic_idx") + 1).cast("string"), F.when(F.col("depth") > 0, " · 追问").otherwise(""), F.lit("] 问："), F.coalesce("question", F.lit("")), F.lit("\n答："))
    score = F.concat(F.lit("\n得分 "), F.coalesce(F.col("score").cast("string"), F.lit("None")), F.lit("；好在："), _or(F.col("good"), "无"), F.lit("；不足："), _or(F.col("bad"), "无"))
    said = F.when(F.coalesce("skipped", F.lit(False)), "（跳过了）").otherwise(F.concat(F.left(F.coalesce("answer", F.lit("")), F.lit(ANSWER_PREVIEW)), score))
    return turns.groupBy("session_id").agg(_joined(F.concat(head, said), "turn_no", between="\n\n").alias("turns"))
