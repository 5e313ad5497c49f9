"""Document fingerprints: threshold-scaled sketches of word shingles, in column expressions alone.

A sketch keeps every five-word shingle whose 64-bit hash lies in the lowest ``1 / scale`` of the hash range, so its size
grows with the text and the sketch of a union is the union of the sketches: the share of a small text inside a huge one can
be estimated as well as the likeness of two equals. Where no shingle is kept, the least one stands in, marked.

The next document of each (by descending id) is found without one sort in one task: bounds taken from a bounded sample
of the ids deal the rows into bins, one shuffle brings a bin together, a window looks one row ahead, and only the last
row of each bin takes its neighbour from the next bin. The sample decides how even the bins are, never a result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.llm.common import cut, drop_cut, fields
from inkspan.llm.quality_llr import _joined, words_of

SCALE = 4
#: sampled ids for each bin, and bins for each shuffle partition
SAMPLED, BINS = 50, 4


def shingle_hashes(text: Column) -> Column:
    """64-bit hashes of the five-word shingles (A-Z lower-cased); fewer words are one shingle, no word is none."""
    words = words_of(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))

    def of(h: Column) -> Column:
        fours = _joined(_joined(h, 1), 2)
        n = F.greatest(F.size(h) - 4, F.lit(0))
        fives = F.zip_with(F.slice(fours, F.lit(1), n), F.slice(h, F.lit(5), n), lambda x, y: F.xxhash64(x, y))
        return F.when(F.size(h) >= 5, fives).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return _bound(F.transform(words, lambda w: F.xxhash64(w)), of)


def _bound(value: Column, f) -> Column:  # noqa: ANN001
    """f(value), with the value computed once."""
    return F.transform(F.array(value), f)[0]


def sketch_of(text: Column, scale: int = SCALE) -> Column:
    """struct<least: boolean, hashes: array<bigint>>: the low 32 bits of the kept shingle hashes, distinct and sorted."""
    top = F.lit(-(1 << 63) + (1 << 64) // scale)

    def of(all_hashes: Column) -> Column:
        kept = F.filter(all_hashes, lambda h: h < top)
        least = (F.size(kept) == 0) & (F.size(all_hashes) > 0)
        chosen = F.when(least, F.array(F.array_min(all_hashes))).otherwise(kept)
        low = F.transform(chosen, lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)))
        return F.struct(least.alias("least"), F.array_sort(F.array_distinct(low)).alias("hashes"))

    return _bound(shingle_hashes(text), of)


def as_string(sketch: Column) -> Column:
    """Eight hex digits a hash, in order; ``~`` before a hash that only stands in."""
    digits = F.transform(sketch["hashes"], lambda h: F.lpad(F.lower(F.hex(h)), 8, "0"))
    return F.concat(F.when(sketch["least"], "~").otherwise(""), F.array_join(digits, ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; 1 for two empty sketches."""
    common = F.size(F.array_intersect(a["hashes"], b["hashes"]))
    whole = F.size(a["hashes"]) + F.size(b["hashes"]) - common
    return F.when(whole == 0, F.lit(1.0)).otherwise(common.cast("double") / whole)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that are in b too; 1 for an empty a."""
    n = F.size(a["hashes"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a["hashes"], b["hashes"])).cast("double") / n)


def merged(a: Column, b: Column) -> Column:
    """The sketch of both texts' shingles together: kept hashes unite, a stand-in goes where the other one keeps any."""
    own = [F.when(x["least"] & ~y["least"] & (F.size(y["hashes"]) > 0), F.array().cast("array<bigint>")).otherwise(x["hashes"]) for x, y in ((a, b), (b, a))]
    hashes = F.array_sort(F.array_union(*own))
    both = (a["least"] | (F.size(a["hashes"]) == 0)) & (b["least"] | (F.size(b["hashes"]) == 0))
    return F.struct((both & (F.size(hashes) > 0)).alias("least"), hashes.alias("hashes"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE) -> DataFrame:
    """One row per document: id, sketch, fingerprint. Null text: empty (empty fingerprint); every row for itself."""
    d = fields(docs, id=id_col, text=text_col).select("id", sketch_of(F.coalesce("text", F.lit("")), scale).alias("sketch"))
    return d.select(F.col("id").alias(id_col), "sketch", as_string(F.col("sketch")).alias("fingerprint"))


def _bin(ids: DataFrame, bins: int) -> tuple[Column, Column]:
    """How many bounds lie before ``id`` in descending order, without and with those equal to it."""
    n = ids.count()
    share = min(1 << 30, (SAMPLED * bins << 30) // max(n, 1) + 1)
    drawn = ids.filter((F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(1 << 30)) < share) & F.col("id").isNotNull())
    ranked = drawn.agg(F.sort_array(F.collect_list("id"), asc=False).alias("ids"))  # about SAMPLED * bins ids
    at = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: F.get("ids", F.floor(i * F.size("ids") / bins).cast("int")))
    bounds = [x for x in ranked.select(at.alias("at")).first()["at"] if x is not None]
    held = F.array(*[F.lit(x) for x in bounds]).cast(f"array<{ids.schema['id'].dataType.simpleString()}>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))]).cast("array<int>")

    def before(test) -> Column:  # noqa: ANN001
        return F.aggregate(steps, F.lit(0), lambda lo, s: F.when((lo + s <= len(bounds)) & test(F.get(held, lo + s - 1)), lo + s).otherwise(lo))

    return before(lambda x: x > F.col("id")), before(lambda x: x >= F.col("id"))


def _with_next(d: DataFrame, scale: int) -> DataFrame:
    """What is asked of each row with text, sketch, next_text, next_sketch."""
    n = F.col("n_chars")
    third = F.floor(n / 3).cast("int")
    d = d.withColumn("n_chars", F.length("text").cast("long"))
    d = d.withColumn("edited", F.concat(F.substr("text", F.lit(1), (n - third).cast("int")), F.substr("next_text", F.lit(1), third)))
    d = d.withColumn("edited_sketch", sketch_of(F.col("edited"), scale))
    own, edited, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    found = {
        "edited_sha256": F.sha2(F.col("edited").cast("binary"), 256),
        "fingerprint": as_string(own),
        "edited_fingerprint": as_string(edited),
        "near_edited": likeness(own, edited),
        "near_next": likeness(own, following),
        "in_edited": containment(own, edited),
        "in_next": containment(own, following),
    }
    return d.withColumns(found)


COLUMNS = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "in_edited", "in_next")


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE) -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, in_edited, in_next.

    The next document is that with the next smaller id, after the last the first; rows with one id follow each other by the
    64-bit hash of their text, then by the text; null ids come last. The edited text has its last third of code points
    (rounded down) replaced by the first as many of the next document. near_* are estimated Jaccard similarities, in_* the
    estimated share of the document's shingles in the other text. Null text: empty. A table of one row follows itself; an
    empty table gives an empty table. A hot id, or null, is spread over bins by the hash of its texts.
    """
    spark = docs.sparkSession
    d = fields(docs, id=id_col, text=text_col)
    bins = max(2, BINS * int(spark.conf.get("spark.sql.shuffle.partitions")))
    lo, hi = _bin(d.select("id"), bins)
    d = d.select("id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("hash", F.xxhash64("text"))
    share = F.col("hash") / F.lit(2.0**64) + 0.5  # of the hash range below this hash
    spread = F.when(F.col("id").isNull(), bins + F.floor(share * bins)).otherwise(lo + F.least(F.floor(share * (hi - lo + 1)), hi - lo))
    d = d.withColumn("bin", spread.cast("int")).withColumn("sketch", sketch_of(F.col("text"), scale))
    order = Window.partitionBy("bin").orderBy(F.col("id").desc_nulls_last(), "hash", "text")
    d = d.withColumns({"next_text": F.lead("text").over(order), "next_sketch": F.lead("sketch").over(order), "first": F.lag("bin").over(order).isNull()})
    d = d.withColumn("last", F.col("next_text").isNull())
    edge = F.col("first") | F.col("last")
    held = {"edge_text": F.when(edge, F.col("text")), "edge_sketch": F.when(edge, F.col("sketch"))}
    d = cut(_with_next(d, scale).withColumns(held).select("id", "bin", "first", "last", *held, *COLUMNS), "neighbours")
    # one row a bin from here on
    firsts = d.filter("first").select(F.col("bin").alias("next_bin"), F.col("edge_text").alias("next_text"), F.col("edge_sketch").alias("next_sketch"))
    ahead = firsts.select(F.col("next_bin").alias("bin"), F.lead("next_bin").over(Window.orderBy("next_bin")).alias("ahead"), F.min("next_bin").over(Window.partitionBy()).alias("again"))
    ahead = ahead.select("bin", F.coalesce("ahead", "again").alias("next_bin"))
    lasts = d.filter("last").select("id", "bin", F.col("edge_text").alias("text"), F.col("edge_sketch").alias("sketch"))
    lasts = _with_next(lasts.join(ahead, "bin").join(firsts, "next_bin"), scale)
    out = d.filter("not last").select("id", *COLUMNS).unionByName(lasts.select("id", *COLUMNS))
    out = cut(out.select(F.col("id").alias(id_col), *COLUMNS), "fingerprints")
    drop_cut(d)
    return out
