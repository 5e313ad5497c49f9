"""Model replies as input columns: code fences, JSON, schema and range checks, event framing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FINDINGS = "struct<findings: array<struct<risk_type: string, severity: string, evidence_quote: string, reason: string, suggestion: string>>>"
RESULTS = "struct<results: array<struct<id: int, status: string, evidence_quote: string, reason: string>>>"
REQUIREMENTS = "struct<requirements: array<struct<req_type: string, category: string, skill: string, quote: string, content: string>>>"
SECTIONS = "struct<items: array<struct<id: int, type: string>>>"
TOPICS = "struct<topics: array<struct<source: string, ref: string, label: string, intent: string>>>"
EVALUATION = "struct<scores: struct<correctness: int, depth: int, clarity: int>, evidence: array<string>, good: string, bad: string, better_answer: string, decision: string>"


def strip_fence(reply: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), "(?i)^```(?:json)?\\s*", ""), "\\s*```$", ""))


def parse_reply(reply: Column, schema: str) -> Column:
    """struct(value, error): the reply by schema, or what was wrong with it."""
    text = strip_fence(reply)
    value = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    empty = F.coalesce(text, F.lit("")) == ""
    broken = F.get_json_object(text, "$").isNull()
    hollow = F.to_json(value).isin("{}") | value.isNull()
    error = F.when(empty, "empty reply").when(broken, "not JSON").when(hollow, "schema mismatch")
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def valid_scores(scores: Column) -> Column:
    return F.coalesce(scores["correctness"].between(0, 5) & scores["depth"].between(0, 5) & scores["clarity"].between(0, 5), F.lit(False))


def valid_status(status: Column) -> Column:
    return F.coalesce(status.isin("hit", "partial", "miss"), F.lit(False))


def valid_requirement(r: Column) -> Column:
    return F.coalesce(r["req_type"].isin("hard", "plus", "soft") & r["category"].isin("skill", "education", "experience", "other"), F.lit(False))


def event_frame(name: Column, data: Column) -> Column:
    """A server-sent event."""
    return F.format_string("event: %s\ndata: %s\n\n", name, data)


def prompt_key(scene: Column, model: Column, version: Column, prompt: Column) -> Column:
    return F.concat_ws(":", F.lit("llm"), scene, model, version, F.sha2(prompt, 256))
