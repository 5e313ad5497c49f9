"""Rule findings with verbatim evidence, and the weighted score over them.

Units: resume_id, unit_id, unit_type, entry_name, char_start, char_end, text. Every rule is a function from units or
other facts to findings; evidence is always a slice of the full text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions.dates import month_number
from inkspan.functions.numeric import round_exact
from inkspan.functions.text import LINE_PREFIX, clause_around, first_sentence, has_number

# Words and limits that the rules are defined by.
RESULT_WORDS = "提升|提高|降低|减少|缩短|节省|节约|增长|达到|降至|升至|支撑|保障|上线|获得|解决了|避免|稳定运行"
WEAK_VERBS = "参与|协助|了解|学习|接触|帮助|配合|跟随|辅助"
MAX_LENGTH, MIN_LENGTH, MAX_PAGES, MAX_GAP, MAX_SKILLS = 120, 8, 2, 3, 5
CATEGORIES = ("completeness", "quantification", "expression", "consistency", "ats")
PENALTY = {"high": 25, "medium": 12, "low": 5}
WEIGHTS = {"completeness": 0.25, "quantification": 0.25, "expression": 0.20, "consistency": 0.20, "ats": 0.10}
REFERENCE_UNITS = 4
ACTIVE = {"rule_only": CATEGORIES, "llm_only": ("expression", "consistency"), "hybrid": CATEGORIES}


def _finding(df: DataFrame, code: str, category: str, severity: str, start: Column, end: Column, detail: Column | None = None, unit: Column | None = None) -> DataFrame:
    return df.select(
        "resume_id",
        F.lit(code).alias("rule_code"),
        F.lit(category).alias("category"),
        F.lit(severity).alias("severity"),
        (unit if unit is not None else F.lit(None)).cast("string").alias("unit_id"),
        start.cast("int").alias("char_start"),
        end.cast("int").alias("char_end"),
        (detail if detail is not None else F.lit(None)).cast("string").alias("detail"),
        F.lit("exact").alias("verify_result"),
        F.lit("rule").alias("source"),
    )


def experience(units: DataFrame) -> DataFrame:
    return units.filter("unit_type IN ('work', 'projects')")


def no_quantification(units: DataFrame, results: str = RESULT_WORDS) -> DataFrame:
    word = F.regexp_extract("text", f"({results})", 1)
    u = experience(units).withColumn("_word", word).filter((F.col("_word") != "") & ~has_number(F.col("text")))
    span = clause_around(F.col("text"), F.instr("text", F.col("_word")) - 1)
    return _finding(u, "NO_QUANTIFICATION", "quantification", "high", F.col("char_start") + span["start"], F.col("char_start") + span["end"], F.col("_word"), F.col("unit_id"))


def star_incomplete(units: DataFrame, results: str = RESULT_WORDS) -> DataFrame:
    u = experience(units).filter(~F.col("text").rlike(results) & ~has_number(F.col("text")))
    span = first_sentence(F.col("text"))
    return _finding(u, "STAR_INCOMPLETE", "completeness", "medium", F.col("char_start") + span["start"], F.col("char_start") + span["end"], None, F.col("unit_id"))


def weak_verb(units: DataFrame, verbs: str = WEAK_VERBS) -> DataFrame:
    """Once per unit, at its first line that begins with a weak verb."""
    lines = F.split("text", "\n", -1)
    body = f"(?:{LINE_PREFIX})(?:{verbs})"
    hit = F.get(F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"].rlike(body)), F.lit(0))
    u = experience(units).withColumn("_hit", hit).filter("_hit IS NOT NULL")
    before = F.coalesce(F.aggregate(F.slice(lines, F.lit(1), F.col("_hit.i")), F.lit(0), lambda acc, x: acc + F.length(x) + 1), F.lit(0))
    at = before + F.length(F.regexp_extract("_hit.x", f"({LINE_PREFIX})", 1))
    u = u.withColumn("_at", at)
    verb = F.regexp_extract(F.substring("text", F.col("_at") + 1, F.length("text")), f"^({verbs})", 1)
    return _finding(u, "WEAK_VERB", "expression", "low", F.col("char_start") + F.col("_at"), F.col("char_start") + clause_around(F.col("text"), F.col("_at"))["end"], verb, F.col("unit_id"))


def length_anomaly(units: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Last lines over 120 or under 8 characters; documents (resume_id, page_count) of more than two pages."""
    body = F.length(F.substring_index("text", "\n", -1))
    u = experience(units).withColumn("_n", body)
    span = first_sentence(F.col("text"))
    long = _finding(u.filter(F.col("_n") > MAX_LENGTH), "LENGTH_ANOMALY", "expression", "low", F.col("char_start") + span["start"], F.col("char_start") + span["end"], F.col("_n"), F.col("unit_id"))
    short = _finding(u.filter(F.col("_n") < MIN_LENGTH), "LENGTH_ANOMALY", "expression", "low", F.col("char_start"), F.col("char_end"), F.col("_n"), F.col("unit_id"))
    out = long.unionByName(short)
    if pages is not None:
        out = out.unionByName(_finding(pages.filter(F.col("page_count") > MAX_PAGES), "LENGTH_ANOMALY", "expression", "low", F.lit(None), F.lit(None), F.col("page_count")))
    return out


def skill_mismatch(skills: DataFrame, mentions: DataFrame, experience_text: DataFrame, limit: int = MAX_SKILLS) -> DataFrame:
    """Listed skills that no work or project text mentions, the first five per document.

    skills: resume_id, ordinal, name, skill_id?, char_start, char_end; mentions: resume_id, skill_id, section_type;
    experience_text: resume_id, text (documents without experience are left out).
    """
    used = mentions.filter("section_type IN ('work', 'projects')").select("resume_id", "skill_id").distinct()
    with_text = skills.join(experience_text.select("resume_id", F.lower("text").alias("_text")), "resume_id")
    known = with_text.filter("skill_id IS NOT NULL").join(used, ["resume_id", "skill_id"], "left_anti")
    unknown = with_text.filter("skill_id IS NULL").filter(~F.col("_text").contains(F.lower("name")))
    w = Window.partitionBy("resume_id").orderBy("ordinal")
    cut = known.unionByName(unknown.select(known.columns)).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit)
    return _finding(cut, "SKILL_PROJECT_MISMATCH", "consistency", "medium", F.col("char_start"), F.col("char_end"), F.col("name"))


def timeline_anomaly(work: DataFrame, today: str) -> DataFrame:
    """Overlaps and gaps of more than three months between neighbouring work entries with month-precise ends.

    work: resume_id, ordinal, kind, start, end, is_present, char_start, char_end, first_line_end?.
    """
    now = F.lit(today[:7])
    d = work.withColumn("_end", F.when(F.col("is_present"), now).otherwise(F.col("end")))
    d = d.filter("kind IN ('work', 'internship')").withColumn("_a", month_number(F.col("start"))).withColumn("_b", month_number(F.col("_end"))).filter("_a IS NOT NULL AND _b IS NOT NULL")
    w = Window.partitionBy("resume_id").orderBy("_a", "ordinal")
    d = d.withColumn("_gap", F.col("_a") - F.lag("_b").over(w)).filter((F.col("_gap") < 0) | (F.col("_gap") > MAX_GAP))
    end = F.coalesce(F.col("first_line_end"), F.col("char_end")) if "first_line_end" in work.columns else F.col("char_end")
    return _finding(d, "TIMELINE_ANOMALY", "consistency", "medium", F.col("char_start"), end, F.col("_gap"))


def ats_unfriendly(signals: DataFrame) -> DataFrame:
    """signals: resume_id, images, textboxes, drawings."""
    bad = signals.filter("coalesce(images, 0) > 0 OR coalesce(textboxes, 0) > 0 OR coalesce(drawings, 0) > 0")
    return _finding(bad, "ATS_UNFRIENDLY", "ats", "low", F.lit(None), F.lit(None))


#: unit rules by code; a direction may switch some off and add result words
UNIT_RULES: dict[str, Callable[..., DataFrame]] = {"NO_QUANTIFICATION": no_quantification, "STAR_INCOMPLETE": star_incomplete, "WEAK_VERB": weak_verb, "LENGTH_ANOMALY": length_anomaly}


def run_unit_rules(units: DataFrame, disabled: frozenset[str] = frozenset(), result_words: tuple[str, ...] = ()) -> DataFrame:
    """Findings of all unit rules that the direction leaves on."""
    results = "|".join([RESULT_WORDS, *("\\Q" + w + "\\E" for w in result_words)])
    out = None
    for code, rule in UNIT_RULES.items():
        if code not in disabled:
            got = rule(units, results) if rule in (no_quantification, star_incomplete) else rule(units)
            out = got if out is None else out.unionByName(got)
    return out if out is not None else _finding(units.limit(0), "", "", "", F.lit(0), F.lit(0))


def score_findings(findings: DataFrame, units: DataFrame, mode: str = "hybrid") -> DataFrame:
    """Per document: one score per category (null where the mode does not check it) and the weighted overall score.

    units: resume_id, unit_count, one row per document. Findings that failed verification do not count.
    """
    penalty = F.coalesce(*[F.when(F.col("severity") == s, F.lit(p)) for s, p in PENALTY.items()], F.lit(0))
    got = findings.filter("verify_result IS NULL OR verify_result != 'failed'").groupBy("resume_id").pivot("category", list(CATEGORIES)).agg(F.sum(penalty))
    d = units.select("resume_id", "unit_count").join(got, "resume_id", "left")
    scale = F.lit(REFERENCE_UNITS) / F.greatest(F.col("unit_count"), F.lit(REFERENCE_UNITS))
    active = ACTIVE[mode]
    scores = {c: round_exact(F.greatest(F.lit(0.0), 100 - F.coalesce(c, F.lit(0)) * scale)) if c in active else F.lit(None).cast("double") for c in CATEGORIES}
    d = d.select("resume_id", "unit_count", *[v.alias(c) for c, v in scores.items()])
    overall = sum((F.col(c) * WEIGHTS[c] for c in active), F.lit(0.0)) / sum(WEIGHTS[c] for c in active)
    return d.withColumn("overall", round_exact(overall))


def findings_in_mode(rule_findings: DataFrame, model_findings: DataFrame, key: str, mode: str = "hybrid") -> DataFrame:
    """The findings a mode shows: rules alone, the model's verified ones alone, or both without those that a rule covers."""
    from inkspan.operators.spans import drop_duplicates_of

    if mode not in ACTIVE:
        raise ValueError(f"mode must be one of {tuple(ACTIVE)}")
    good = model_findings.filter("coalesce(verify_result, 'failed') != 'failed'")
    if mode == "rule_only":
        return rule_findings
    return good if mode == "llm_only" else rule_findings.unionByName(drop_duplicates_of(good, rule_findings, key))


def diagnosis_counters(findings: DataFrame, skipped: DataFrame) -> DataFrame:
    """Per diagnosis: first-round counts, hallucinations (first round failed), and done or partial. skipped: diagnosis_id, units_skipped."""
    first = F.col("attempt_no") == 1
    got = findings.groupBy("diagnosis_id").agg(
        F.count_if((F.col("source") == "rule")).alias("rule_count"),
        F.count_if((F.col("source") == "llm") & first).alias("llm_count"),
        F.count_if((F.col("source") == "llm") & first & (F.col("verify_result") == "failed")).alias("hallucination_count"),
    )
    d = skipped.join(got, "diagnosis_id", "left")
    d = d.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("rule_count", "llm_count", "hallucination_count")})
    return d.withColumn("status", F.when(F.col("units_skipped") > 0, "partial").otherwise("done"))


def affordable_units(units: DataFrame, budget: float = 0.05, unit_cost: float = 0.002, reserve: float = 1.5) -> DataFrame:
    """The units that the budget pays for, in the order of the document, and how many were skipped."""
    n = int(budget / (unit_cost * reserve))
    w = Window.partitionBy("resume_id")
    ranked = units.withColumn("_n", F.row_number().over(w.orderBy("char_start", "unit_id"))).withColumn("skipped", F.greatest(F.count("*").over(w) - n, F.lit(0)))
    return ranked.filter(F.col("_n") <= n).drop("_n")
