"""Requirement matching: skill, education and years rules, model answers, recheck, weighted scores, gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions.binding import once
from inkspan.functions.dates import covered_months, month_number
from inkspan.functions.numeric import round_exact
from inkspan.functions.text import degree_level, is_plain_skill, required_degree, required_years
from inkspan.operators.evidence import locate_each
from inkspan.operators.spans import overlaps

STATUS_VALUE = {"hit": 1.0, "partial": 0.5, "miss": 0.0}
REQUIREMENT_WEIGHT = {"hard": 1.0, "plus": 0.5, "soft": 0.3}
CATEGORIES = ("skill", "education", "experience", "other")
MAX_REQUIREMENTS = 25


def status_value(status: Column) -> Column:
    return F.coalesce(*[F.when(status == k, F.lit(v)) for k, v in STATUS_VALUE.items()], F.lit(0.0))


def _best_mentions(mentions: DataFrame) -> DataFrame:
    used = F.col("section_type").isin("work", "projects")
    best = F.max_by(F.struct("char_start", "char_end", used.alias("used")), F.struct(used, -F.col("char_start")))
    return mentions.groupBy("report_id", "skill_id").agg(best.alias("m"))


def match_skills(requirements: DataFrame, mentions: DataFrame) -> DataFrame:
    """Skill requirements with a known skill: hit if mentioned in work or projects, partial if elsewhere; the first such
    mention is the evidence. requirements and mentions share report_id."""
    got = requirements.filter("category = 'skill' AND skill_id IS NOT NULL").join(_best_mentions(mentions), ["report_id", "skill_id"])
    return got.select("report_id", "requirement_id", F.when(F.col("m.used"), "hit").otherwise("partial").alias("status"), F.lit("dict").alias("matched_by"), F.col("m.char_start").alias("char_start"), F.col("m.char_end").alias("char_end"))


def match_education(requirements: DataFrame, education: DataFrame) -> DataFrame:
    """Hit or miss by the highest degree against the lowest one the requirement names; undecided rows are left out."""
    best = highest_degree(education).select("report_id", F.struct("level", "char_start", "char_end").alias("e"))
    r = requirements.filter("category = 'education'").withColumn("_need", required_degree(F.col("content"), F.col("quote"))).filter("_need > 0")
    got = r.join(best, "report_id")
    return got.select("report_id", "requirement_id", F.when(F.col("e.level") >= F.col("_need"), "hit").otherwise("miss").alias("status"), F.lit("profile").alias("matched_by"), F.col("e.char_start").alias("char_start"), F.col("e.char_end").alias("char_end"))


def experience_years(work: DataFrame, today: str, key: str = "report_id") -> DataFrame:
    """Length of the union of work spans in years; campus entries and incomplete spans do not count."""
    end = F.when(F.col("is_present"), F.lit(today[:7])).otherwise(F.col("end"))
    d = work.filter("kind != 'campus'").withColumn("_s", F.struct(month_number(F.col("start")).alias("start"), month_number(end).alias("end"))).filter("_s.start IS NOT NULL AND _s.end IS NOT NULL")
    return d.groupBy(key).agg(round_exact(covered_months(F.collect_list("_s")) / 12).alias("years"))


def match_years(requirements: DataFrame, years: DataFrame) -> DataFrame:
    r = requirements.filter("category = 'experience'").withColumn("_need", required_years(F.col("content"), F.col("quote"))).filter("_need IS NOT NULL")
    have = F.coalesce("years", F.lit(0.0))
    status = F.when(have >= F.col("_need"), "hit").when(have >= F.col("_need") / 2, "partial").otherwise("miss")
    null = F.lit(None).cast("int")
    return r.join(years, "report_id", "left").select("report_id", "requirement_id", status.alias("status"), F.lit("profile").alias("matched_by"), null.alias("char_start"), null.alias("char_end"))


def ruled(requirements: DataFrame, mentions: DataFrame, education: DataFrame, work: DataFrame, today: str) -> DataFrame:
    """Every requirement with what the rules say, null where they leave it open: report_id, requirement_id, category, plain,
    status, matched_by, char_start, char_end.

    One pass: what the texts ask for is read first, so that no text is shuffled; joins by report come before the one by skill.
    """
    asks = lambda kind, value: F.when(F.col("category") == kind, value)
    r = requirements.select(
        "report_id", "requirement_id", "category", asks("skill", F.col("skill_id")).alias("skill_id"),
        asks("skill", is_plain_skill(F.col("content"), F.col("skill"))).alias("plain"),
        asks("education", required_degree(F.col("content"), F.col("quote"))).alias("_degree"),
        asks("experience", required_years(F.col("content"), F.col("quote"))).alias("_years"),
    )
    best = highest_degree(education).select("report_id", F.struct("level", "char_start", "char_end").alias("e"))
    d = r.join(best, "report_id", "left").join(experience_years(work, today), "report_id", "left").join(_best_mentions(mentions), ["report_id", "skill_id"], "left")
    skill, degree, have = F.col("m").isNotNull(), (F.col("_degree") > 0) & F.col("e").isNotNull(), F.coalesce("years", F.lit(0.0))
    return d.select(
        "report_id", "requirement_id", "category", "plain",
        F.when(skill, F.when(F.col("m.used"), "hit").otherwise("partial"))
        .when(degree, F.when(F.col("e.level") >= F.col("_degree"), "hit").otherwise("miss"))
        .when(F.col("_years").isNotNull(), F.when(have >= F.col("_years"), "hit").when(have >= F.col("_years") / 2, "partial").otherwise("miss")).alias("status"),
        F.when(skill, "dict").when(degree | F.col("_years").isNotNull(), "profile").alias("matched_by"),
        *[F.when(skill, F.col(f"m.{c}")).when(degree, F.col(f"e.{c}")).alias(c) for c in ("char_start", "char_end")],
    )


#: what counts in strict mode: a skill result only if it is a hit on a plain skill requirement
_STRICT = "status IS NOT NULL AND (category != 'skill' OR (status = 'hit' AND plain))"


def match_by_rules(requirements: DataFrame, mentions: DataFrame, education: DataFrame, work: DataFrame, today: str, strict: bool = False) -> DataFrame:
    """All rule results; in strict mode a skill result counts only if it is a hit on a plain skill requirement."""
    return ruled(requirements, mentions, education, work, today).filter(_STRICT if strict else "status IS NOT NULL").drop("category", "plain")


def apply_judgements(pending: DataFrame, answers: DataFrame) -> DataFrame:
    """Model answers for requirements that rules left open: answers without a located quote and missing answers are misses.

    answers: report_id, requirement_id, status, char_start, char_end (null where the quote was not found).
    """
    a = answers.select("report_id", "requirement_id", "status", "char_start", "char_end")
    d = pending.select("report_id", "requirement_id").join(a, ["report_id", "requirement_id"], "left")
    found = F.col("char_start").isNotNull() & F.col("status").isin("hit", "partial")
    return d.select("report_id", "requirement_id", F.when(found, F.col("status")).otherwise("miss").alias("status"), F.lit("llm").alias("matched_by"), F.when(found, F.col("char_start")).alias("char_start"), F.when(found, F.col("char_end")).alias("char_end"))


def recheck_listed_only(items: DataFrame, rule_items: DataFrame, entries: DataFrame) -> DataFrame:
    """A model's hit on what rules found only listed counts as partial unless its evidence lies in work or projects."""
    listed = rule_items.filter("status = 'partial'").select("report_id", "requirement_id", F.lit(True).alias("_listed"))
    e = entries.select(F.col("report_id").alias("_r"), F.col("char_start").alias("_s"), F.col("char_end").alias("_e"))
    inside = items.join(e, (F.col("report_id") == F.col("_r")) & overlaps(F.col("char_start"), F.col("char_end"), F.col("_s"), F.col("_e")), "left_semi").select("report_id", "requirement_id", F.lit(True).alias("_inside"))
    d = items.join(listed, ["report_id", "requirement_id"], "left").join(inside, ["report_id", "requirement_id"], "left")
    down = (F.col("status") == "hit") & (F.col("matched_by") == "llm") & F.col("_listed").isNotNull() & F.col("_inside").isNull()
    return d.withColumn("status", F.when(down, "partial").otherwise(F.col("status"))).drop("_listed", "_inside")


MODES = ("dict_only", "llm_fulltext", "hybrid")


def _answered(answers: DataFrame, entries: DataFrame | None) -> DataFrame:
    """Answers that count, with ``_inside``: whether the evidence lies in one of the report's entries. An answer sees the entries
    that begin before its end, and the furthest end of these decides, so a report costs a sort and not a product."""
    found = F.col("char_start").isNotNull() & F.col("status").isin("hit", "partial")
    a = answers.select("report_id", "requirement_id", *[F.when(found, F.col(c)).alias(n) for c, n in (("status", "_said"), ("char_start", "_start"), ("char_end", "_end"))])
    if entries is None:
        a = a.withColumn("_inside", F.lit(True))
    else:
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in a.schema.fields[1:]]
        e = entries.filter("char_end IS NOT NULL").select("report_id", *none, F.col("char_start").alias("_at"), F.col("char_end").alias("_far"), F.lit(True).alias("_entry"))
        both = a.withColumns({"_at": F.col("_end"), "_far": F.lit(None).cast(e.schema["_far"].dataType), "_entry": F.lit(False)}).unionByName(e.filter("_at IS NOT NULL"))
        w = Window.partitionBy("report_id").orderBy("_at", "_entry").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        a = both.withColumn("_inside", F.coalesce(F.max("_far").over(w) > F.col("_start"), F.lit(False))).filter("NOT _entry").drop("_at", "_far", "_entry")
    # what does not depend on the answers is given once where there are several
    return a.withColumn("_n", F.row_number().over(Window.partitionBy("report_id", "requirement_id").orderBy("_start")))


def match_in_modes(requirements: DataFrame, mentions: DataFrame, education: DataFrame, work: DataFrame, answers: DataFrame, today: str, modes: tuple[str, ...] = MODES, entries: DataFrame | None = None) -> DataFrame:
    """:func:`match_in_mode` for several modes at once, with ``mode``: rules and answers meet each requirement once."""
    if not set(modes) <= set(MODES):
        raise ValueError(f"mode must be one of {MODES}")
    key = ["report_id", "requirement_id"]
    if set(modes) == {"llm_fulltext"}:
        d = requirements.select(*key, *[F.lit(None).cast(t).alias(c) for c, t in (("category", "string"), ("plain", "boolean"), ("status", "string"), ("matched_by", "string"), ("char_start", "int"), ("char_end", "int"))])
    else:
        d = ruled(requirements, mentions, education, work, today)
    if set(modes) == {"dict_only"}:
        d = d.withColumns({"_said": F.lit(None).cast("string"), "_start": F.lit(None).cast("int"), "_end": F.lit(None).cast("int"), "_inside": F.lit(True), "_n": F.lit(1)})
    else:
        d = d.join(_answered(answers, entries), key, "left")
    once = F.coalesce("_n", F.lit(1)) == 1
    item = lambda mode, *v: F.struct(F.lit(mode).alias("mode"), *[x.alias(n) for x, n in zip(v, ("status", "matched_by", "char_start", "char_end"), strict=True)])
    by_rule = [F.col(c) for c in ("status", "matched_by", "char_start", "char_end")]
    listed = (F.col("category") == "skill") & (F.col("status") == "partial")
    said = F.coalesce("_said", F.lit("miss"))
    rechecked = F.when((said == "hit") & F.coalesce(listed, F.lit(False)) & ~F.col("_inside"), "partial").otherwise(said)
    judged = lambda status: [status, F.lit("llm"), F.col("_start"), F.col("_end")]
    certain = F.coalesce(F.expr(_STRICT), F.lit(False))
    made = {
        "dict_only": F.when(once, item("dict_only", F.coalesce("status", F.lit("miss")), *by_rule[1:])),
        "llm_fulltext": item("llm_fulltext", *judged(said)),
        "hybrid": F.when(~certain | once, item("hybrid", *[F.when(certain, r).otherwise(j) for r, j in zip(by_rule, judged(rechecked), strict=True)])),
    }
    return d.select(*key, F.explode(F.array(*[made[m] for m in modes])).alias("i")).filter("i IS NOT NULL").select("i.mode", *key, "i.status", "i.matched_by", "i.char_start", "i.char_end")


def match_in_mode(requirements: DataFrame, mentions: DataFrame, education: DataFrame, work: DataFrame, answers: DataFrame, today: str, mode: str = "hybrid", entries: DataFrame | None = None) -> DataFrame:
    """Items of all requirements in one of the MODES: report_id, requirement_id, status, matched_by, char_start, char_end.

    dict_only: rules alone, what they leave open is a miss; llm_fulltext: the model alone; hybrid: rules where they are
    certain (strict), else the model, whose hits on skills that are only listed are taken back to partial (``entries``:
    spans of work and projects). answers: see :func:`apply_judgements`.
    """
    return match_in_modes(requirements, mentions, education, work, answers, today, (mode,), entries).drop("mode")


def items_of(requirements: DataFrame, items: DataFrame) -> DataFrame:
    """Every requirement with its item; without one it is a miss that nothing matched."""
    key = ["report_id", "requirement_id"]
    i = items.select(*key, "status", "matched_by", "char_start", "char_end")
    return requirements.join(i, key, "left").withColumn("status", F.coalesce("status", F.lit("miss")))


def apply_gate(diagnoses: DataFrame, scores: DataFrame, threshold: float = 60.0) -> DataFrame:
    """Applications both of whose branches have ended: apply_id, diagnosis_status, overall_match, passed.

    diagnoses: apply_id, status (done, partial or failed count as ended); scores: apply_id, overall (null: nothing was asked, so
    not passed). An application with one branch alone is not there yet.
    """
    ended = diagnoses.filter(F.col("status").isin("done", "partial", "failed")).select("apply_id", F.col("status").alias("diagnosis_status"))
    d = ended.join(scores.select("apply_id", "overall"), "apply_id")
    return d.select("apply_id", "diagnosis_status", F.col("overall").alias("overall_match"), F.coalesce(F.col("overall") >= threshold, F.lit(False)).alias("passed"))


def highest_degree(education: DataFrame) -> DataFrame:
    """The entry with the highest degree of each report, the first of equal ones; entries that name none are left out."""
    best = education.withColumn("level", degree_level(F.col("degree"))).filter("level > 0")
    best = best.groupBy("report_id").agg(F.max_by(F.struct("level", "ordinal", "char_start", "char_end"), F.struct("level", -F.col("ordinal"))).alias("e"))
    return best.select("report_id", "e.*")


def score_matches(requirements: DataFrame, items: DataFrame) -> DataFrame:
    """Per report: overall score and one per category, 0..100, null where nothing is asked; requirements without item are misses."""
    d = requirements.select("report_id", "requirement_id", "category", "weight").join(items.select("report_id", "requirement_id", "status"), ["report_id", "requirement_id"], "left")
    d = d.withColumn("_v", F.col("weight") * status_value(F.coalesce("status", F.lit("miss"))))
    ratio = lambda c: round_exact(100 * F.sum(F.when(c, F.col("_v"))) / F.nullif(F.sum(F.when(c, F.col("weight"))), F.lit(0)))
    return d.groupBy("report_id").agg(ratio(F.lit(True)).alias("overall"), *[ratio(F.col("category") == c).alias(c) for c in CATEGORIES])


def verify_requirements(found: DataFrame, jobs: DataFrame) -> DataFrame:
    """Model requirements whose quote stands in the job text and whose skill occurs there; first of equal ones, weighted,
    numbered from 1, at most 25 per job. found: job_id, ordinal, req_type, category, content, skill, quote; jobs: job_id, raw_text."""
    asks = found.groupBy("job_id").agg(F.collect_list(F.struct("ordinal", "req_type", "category", "content", "skill", "quote")).alias("_asks"))
    # a job's text meets all its asks in one row
    d = locate_each(asks.join(jobs.select("job_id", "raw_text"), "job_id"), F.transform("_asks", lambda a: a["quote"]), "raw_text", "_spans")
    named = once(F.lower("raw_text"), lambda t: F.transform("_asks", lambda a: a["skill"].isNull() | t.contains(F.lower(a["skill"]))))
    d = d.select("job_id", F.explode(F.arrays_zip("_asks", "_spans", named.alias("_named"))).alias("a")).filter("a._spans IS NOT NULL AND a._named")
    d = d.select("job_id", "a._asks.*", F.col("a._spans").alias("span"))
    first = Window.partitionBy("job_id", F.lower("content")).orderBy("ordinal")
    d = d.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    d = d.withColumn("requirement_id", F.row_number().over(Window.partitionBy("job_id").orderBy("ordinal"))).filter(F.col("requirement_id") <= MAX_REQUIREMENTS)
    weight = F.coalesce(*[F.when(F.col("req_type") == k, F.lit(v)) for k, v in REQUIREMENT_WEIGHT.items()])
    return d.select("job_id", "requirement_id", "req_type", "category", "content", "skill", weight.alias("weight"), "quote", F.col("span.start").alias("char_start"), F.col("span.end").alias("char_end"))


def gate(scores: DataFrame, threshold: float = 60.0) -> DataFrame:
    return scores.withColumn("passed", F.coalesce(F.col("overall") >= threshold, F.lit(False)))
