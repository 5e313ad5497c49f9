"""Text functions on columns. Offsets are code points, 0-based and half-open, as everywhere in this package."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkspan.functions.binding import once

# What the reference behaviour is defined by.
BULLETS = "•·▪■◆●○◦*➢➤►▶✓☑\\-–—"
BULLET = f"^(?:[{BULLETS}]|\\d{{1,2}}[.、)）]|[（(]\\d{{1,2}}[)）]|[①-⑩])\\s*"
LABEL = "^(?!\\d+[：:])(?![A-Za-z]+://)[^\\s：:，。、,；;()（）]{2,16}[：:]"
PAGE_NO = "(?i)^\\s*(?:第?\\s*\\d+\\s*页?|\\d+\\s*/\\s*\\d+|-\\s*\\d+\\s*-|Page\\s*\\d+(?:\\s*of\\s*\\d+)?)\\s*$"
LINE_PREFIX = f"^(?:[{BULLETS}]|\\d{{1,2}}[.、)）](?!\\d)|[（(]\\d{{1,2}}[)）]|[①-⑩])?\\s*"
NUMBER = "(?<![A-Za-z\\d.#+\\-])\\d+(?:\\.\\d+)?"
NUMBERING = "^(?:[一二三四五六七八九十]+[、.．]|\\d{1,2}[、.．)）]|[（(][一二三四五六七八九十\\d]+[)）]|part\\s*\\d+)"
DEGREES = ((4, "(?i)博士|ph\\.?d"), (3, "(?i)硕士|(?<!博士)研究生|master"), (2, "(?i)本科|学士|bachelor"), (1, "大专|专科"))
YEARS = "(?<!\\d)(\\d{1,2})(?:\\s*[-–—~～至到]\\s*\\d{1,2})?\\s*年"
MAX_YEARS, MAX_PLAIN_EXTRA = 15, 6
EDU_HINT = "(?i)[一-鿿]{2,}(?:大学|学院)|本科|硕士|博士|研究生|专科|大专|学士|university|college"
BASICS_ONLY = "@|\\d{3}[- ]?\\d{4}[- ]?\\d{4}|现居|所在地|居住地|住址|地址|籍贯"
CAMPUS = ("校园", "在校", "校内", "学生", "社团", "实践", "campus", "activit", "leadership")
CLAUSE_ENDS = "，。；;,\n"
QUOTE_WRAPPERS = " \t\r\n\"'“”‘’「」『』…."
_PUNCTUATION = {"　": " ", "\n": " ", "\t": " ", "\r": " ", " ": " ", "。": ".", "、": ",", "“": '"', "”": '"', "‘": "'", "’": "'", "【": "[", "】": "]", "《": "<", "》": ">", "—": "-", "–": "-", "～": "~", "·": "."}


def match_map() -> dict[str, str]:
    """One-to-one map under which quotes are compared: full-width forms, CJK punctuation, white space, ASCII case."""
    table = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | _PUNCTUATION
    for c in range(ord("A"), ord("Z") + 1):
        table[chr(c)] = table[chr(c + 0xFEE0)] = chr(c + 32)
    return table


def clean(c: Column) -> Column:
    """Characters outside the basic plane become U+FFFD, controls and zero-width ones go, odd spaces become spaces; trimmed."""
    c = F.regexp_replace(c, "[\\x{10000}-\\x{10FFFF}]", "�")
    c = F.regexp_replace(c, "[\\x00-\\x08\\x0b-\\x1f\\x7f​-‏﻿]", "")
    return F.regexp_replace(F.translate(c, "\t 　", "   "), "(?U)^\\s+|\\s+$", "")


def normalize_job_text(c: Column) -> Column:
    """Every line cleaned, outer blank lines dropped."""
    return F.regexp_replace(F.array_join(F.transform(F.split(c, "\r\n|\r|\n"), clean), "\n"), "^\\n+|\\n+$", "")


def normalize_for_match(c: Column) -> Column:
    """Length-preserving normal form for quote matching."""
    table = match_map()
    return F.translate(c, "".join(table), "".join(table.values()))


def strip_quotes(c: Column) -> Column:
    return F.trim(c, F.lit(QUOTE_WRAPPERS))


def normalize_title(c: Column) -> Column:
    """Lower case, numbering prefix dropped, only [0-9a-z] and CJK ideographs left."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "(?i)" + NUMBERING, ""), "[^0-9a-z一-鿿]", "")


def squash(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)\\s+", "")


def join_wrapped(lines: Column) -> Column:
    """Wrapped lines as one text, with a space only between two ASCII neighbours."""
    ascii_end, ascii_start = "[\\x21-\\x7e]$", "^[\\x21-\\x7e]"
    return F.aggregate(
        F.filter(lines, lambda x: F.length(x) > 0),
        F.lit(""),
        lambda acc, x: F.when(acc == "", x).when(acc.rlike(ascii_end) & x.rlike(ascii_start), F.concat(acc, F.lit(" "), x)).otherwise(F.concat(acc, x)),
    )


def line_start(text: Column, at: Column) -> Column:
    """Offset of the first character of the line that holds offset ``at``."""
    head = F.substring(text, F.lit(1), at)
    return F.length(head) - F.length(F.substring_index(head, "\n", -1))


def line_end(text: Column, at: Column) -> Column:
    """Offset after the last character of the line that holds offset ``at``."""
    return at + F.length(F.substring_index(F.substring(text, at + 1, F.length(text)), "\n", 1))


def slice_of(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def line_around(text: Column, start: Column, end: Column, limit: int = 80) -> Column:
    """(start, end) of the line around a span, cut to ``limit`` characters around its start if longer."""
    a, b = line_start(text, start), line_end(text, end)
    long = b - a > limit
    lo = F.when(long, F.greatest(a, start - limit // 2)).otherwise(a)
    hi = F.when(long, F.least(b, lo + limit)).otherwise(b)
    return F.struct(lo.alias("start"), F.greatest(hi, end).alias("end"))


def clause_around(text: Column, at: Column) -> Column:
    """(start, end) of the clause that holds offset ``at``: between , ; 。 and the like; leading spaces left out."""
    # one mark for all ends, then plain searches: a pattern tied to the end of a long clause would start anew at each of its places
    same = F.translate(text, CLAUSE_ENDS, "\n" * len(CLAUSE_ENDS))
    start, end = line_start(same, at), line_end(same, at)
    clause = slice_of(text, start, end)
    lead = F.length(clause) - F.length(F.ltrim(clause))
    return F.struct((start + lead).alias("start"), end.alias("end"))


def first_sentence(text: Column, limit: int = 60) -> Column:
    """(start, end) of the first sentence of the last line, without its bullet, at most ``limit`` characters."""
    last = F.substring_index(text, "\n", -1)
    start = F.length(text) - F.length(last) + F.length(F.regexp_extract(last, f"({LINE_PREFIX})", 1))
    body = F.substring(text, start + 1, F.length(text))
    return F.struct(start.alias("start"), (start + F.least(F.length(F.regexp_extract(body, "^([^。；;\\n]*)", 1)), F.lit(limit))).alias("end"))


def has_number(text: Column) -> Column:
    """A quantity in some line that is not glued to letters, digits, . # + -; a list number at its head does not count."""
    return F.exists(F.split(text, "\n"), lambda x: _body(x).rlike(NUMBER))


def _body(line: Column) -> Column:
    """A line without its list mark; a mark that would be glued to a number stays as one sign, for the look-behind."""
    prefix = F.regexp_extract(line, f"({LINE_PREFIX})", 1)
    glued = F.when(prefix.rlike("[+#.\\-]$"), F.lit("-")).otherwise(F.lit(""))
    return F.concat(glued, F.substring(line, F.length(prefix) + 1, F.length(line)))


def is_bullet(c: Column) -> Column:
    return c.rlike(BULLET)


def is_label(c: Column) -> Column:
    return c.rlike(LABEL)


def is_page_number(c: Column) -> Column:
    return c.rlike(PAGE_NO)


def looks_like_education(c: Column) -> Column:
    return c.rlike(EDU_HINT) & ~c.rlike(BASICS_ONLY)


def work_kind(title: Column) -> Column:
    t = F.lower(title)
    campus = F.lit(False)
    for word in CAMPUS:
        campus |= t.contains(word)
    return F.when(t.contains("实习") | t.contains("intern"), "internship").when(campus, "campus").otherwise("work")


def degree_levels(c: Column) -> Column:
    """Levels named in a text: 4 doctor, 3 master, 2 bachelor, 1 college."""
    found = F.array(*[F.when(c.rlike(p), F.lit(n)) for n, p in DEGREES])
    return F.filter(found, lambda x: x.isNotNull())


def degree_level(c: Column) -> Column:
    return F.coalesce(F.array_max(degree_levels(c)), F.lit(0))


def required_degree(content: Column, quote: Column) -> Column:
    """The lowest level that the requirement names; its quote counts only where the content names none."""
    return F.coalesce(F.array_min(degree_levels(content)), F.array_min(degree_levels(quote)), F.lit(0))


def required_years(content: Column, quote: Column) -> Column:
    found = F.regexp_extract(F.concat_ws(" ", content, quote), YEARS, 1)
    return once(found, lambda t: once(F.when(t != "", t.cast("int")), lambda n: F.when(n.between(1, MAX_YEARS), n)))


def is_plain_skill(content: Column, skill: Column) -> Column:
    """Whether the requirement says little more than the skill's name."""
    rest = F.when(F.length(skill) > 0, F.replace(F.lower(content), F.lower(skill), F.lit(""))).otherwise(F.lower(content))
    return F.length(squash(rest)) <= MAX_PLAIN_EXTRA


def redact_keys(c: Column) -> Column:
    return F.regexp_replace(c, "sk-[A-Za-z0-9_\\-]{8,}", "sk-***")


def key_hint(c: Column) -> Column:
    """First three and last four characters of a long key, else nothing."""
    return F.when(F.length(c) >= 12, F.concat(F.substring(c, 1, 3), F.lit("…"), F.substring(c, -4, 4))).otherwise(F.lit("…"))


def requirement_query(content: Column, quote: Column) -> Column:
    return F.when(quote.isNull() | (quote == "") | content.contains(quote), content).otherwise(F.concat(content, F.lit("（"), quote, F.lit("）")))


def display_title(c: Column, default: str = "简历") -> Column:
    name = F.regexp_replace(F.regexp_replace(c, "^.*[/\\\\]", ""), "[\\x00-\\x1f\\x7f]", "")
    name = F.substring(F.trim(F.regexp_replace(name, "(?i)\\.pdf$", "")), 1, 200)
    return F.when(name.isNull() | (name == ""), F.lit(default)).otherwise(name)


def fill_template(template: str, values: dict[str, str]) -> str:
    """[[name]] placeholders filled on the driver; a missing name is an error."""
    import re

    return re.sub(r"\[\[(\w+)\]\]", lambda m: values[m[1]], template)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)
