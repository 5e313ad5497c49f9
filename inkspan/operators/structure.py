"""Structured entries from model replies: block numbers are checked, texts come from the source, skills must be there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions.dates import find_date_range
from inkspan.functions.replies import parse_reply
from inkspan.operators.evidence import locate

EXPERIENCE = "struct<entries: array<struct<name: string, role: string, block_ids: array<int>, tech_stack: array<string>, highlights: array<struct<block_ids: array<int>>>>>>"
SKILLS = "struct<items: array<struct<name: string, level: string, block_id: int>>>"


def block_span(ids: Column, first: Column, last: Column) -> Column:
    """All block numbers from the smallest to the largest valid one; valid is first..last. Null where none is valid,
    where the numbers are null, and where a section has no blocks."""
    valid = F.filter(ids, lambda i: i.between(first, last))
    return F.when(F.size(valid) > 0, F.sequence(F.array_min(valid), F.array_max(valid)))


def first_dates(texts: Column) -> Column:
    """The first date range in an array of texts, as struct(start, end, is_present); without one, nulls and false."""
    found = F.get(F.filter(F.transform(texts, find_date_range), lambda r: r.isNotNull()), F.lit(0))
    return F.struct(found["start"].alias("start"), found["end"].alias("end"), F.coalesce(found["is_present"], F.lit(False)).alias("is_present"))


def section_blocks(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """(resume_id, section_id, type, first, last, blocks): the content blocks of each section, without its heading.

    sections: resume_id, section_id, type, matched_by, block_start, block_end. The blocks of a section lie in one row,
    as a résumé's section is a page or two; sections without content are left out.
    """
    first = F.col("block_start") + F.when(F.col("matched_by") == "implicit", 0).otherwise(1)
    s = sections.select("resume_id", "section_id", "type", first.alias("first"), F.col("block_end").alias("last"))
    b = blocks.select("resume_id", "block_index", "text", "char_start", "char_end")
    inside = s.join(b, "resume_id").filter("block_index BETWEEN first AND last")
    packed = F.sort_array(F.collect_list(F.struct("block_index", "text", "char_start", "char_end"))).alias("blocks")
    return inside.groupBy("resume_id", "section_id").agg(F.first("type").alias("type"), F.min("block_index").alias("first"), F.max("block_index").alias("last"), packed)


def _slice(full_text: Column, blocks: Column, first: Column, ids: Column) -> Column:
    start, end = F.get(blocks, F.array_min(ids) - first)["char_start"], F.get(blocks, F.array_max(ids) - first)["char_end"]
    return F.struct(ids.alias("block_ids"), start.alias("char_start"), end.alias("char_end"), F.substring(full_text, start + 1, end - start).alias("text"))


def extract_entries(replies: DataFrame, sections: DataFrame, texts: DataFrame) -> DataFrame:
    """One row per entry of the replies that names a valid block.

    replies: resume_id, section_id, reply. sections: as from section_blocks. texts: resume_id, full_text. Entries and
    highlights without a valid block go; the numbers between the smallest and the largest are filled in; texts are
    slices of the source, dates are the first ones in the entry's blocks. A reply that is no JSON of the schema gives no row.
    """
    said = replies.select("resume_id", "section_id", F.posexplode(parse_reply(F.col("reply"), EXPERIENCE)["value"]["entries"]).alias("entry_no", "e"))
    d = said.join(sections, ["resume_id", "section_id"]).join(texts.select("resume_id", "full_text"), "resume_id")
    d = d.withColumn("ids", block_span(F.col("e.block_ids"), F.col("first"), F.col("last"))).filter("ids IS NOT NULL")
    here = lambda ids: _slice(F.col("full_text"), F.col("blocks"), F.col("first"), ids)
    spans = F.transform(F.coalesce("e.highlights", F.array().cast("array<struct<block_ids: array<int>>>")), lambda h: block_span(h["block_ids"], F.col("first"), F.col("last")))
    own = F.transform(F.slice("blocks", F.array_min("ids") - F.col("first") + 1, F.size("ids")), lambda b: b["text"])
    tech = F.filter(F.transform(F.coalesce("e.tech_stack", F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != "")
    d = d.withColumn("s", here(F.col("ids"))).withColumn("dates", first_dates(own))
    return d.select(
        "resume_id", "section_id", "entry_no", "type", F.col("e.name").alias("name"), F.col("e.role").alias("role"), tech.alias("tech_stack"), "dates.start", "dates.end", "dates.is_present",
        "s.block_ids", "s.char_start", "s.char_end", F.transform(F.filter(spans, lambda i: i.isNotNull()), here).alias("highlights"),
    )


def extract_skills(replies: DataFrame, sections: DataFrame, texts: DataFrame) -> DataFrame:
    """(resume_id, section_id, name, level, block_id, char_start, char_end): named skills that stand in the block that
    the reply claims; of a name in any case the first stays, blank names go."""
    said = replies.select("resume_id", "section_id", F.posexplode(parse_reply(F.col("reply"), SKILLS)["value"]["items"]).alias("item_no", "e"))
    d = said.select("resume_id", "section_id", "item_no", F.trim("e.name").alias("name"), "e.level", "e.block_id").filter("name != ''").join(sections.select("resume_id", "section_id", F.explode("blocks").alias("b")), ["resume_id", "section_id"])
    d = d.filter("block_id = b.block_index").join(texts.select("resume_id", "full_text"), "resume_id").withColumns({"lo": F.col("b.char_start"), "hi": F.col("b.char_end")})
    found = locate(d, "name", "full_text", "lo", "hi").filter("span.start >= lo AND span.start < hi")
    best = found.groupBy("resume_id", "section_id", F.lower("name").alias("_k")).agg(F.min_by(F.struct("name", "level", "block_id", F.col("span.start").alias("char_start"), F.col("span.end").alias("char_end")), "item_no").alias("r"))
    return best.select("resume_id", "section_id", "r.*")
