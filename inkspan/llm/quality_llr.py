"""Quality rules: exact counting rules, then a hashed n-gram log-likelihood ratio between two multinomials.

Everything on this path is a built-in column expression. Long texts stay one row: windows are hashed
inside arrays, so no document is blown up into a shuffle, and the two multinomials are aggregated per
bucket with map-side combining, so the model has a fixed number of buckets whatever the corpus size.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import cut, fields

BUCKETS = 16_384
WINDOW = 8


def words_of(text: Column) -> Column:
    """Maximal runs of characters outside space and U+0009..U+000D; null and blank texts have none."""
    text = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " ", -1), "")


def _joined(a: Column, gap: int) -> Column:
    """Hash of each element with the one ``gap`` places on; shorter by ``gap``, empty for short arrays."""
    n = F.greatest(F.size(a) - gap, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(gap + 1), n), lambda x, y: F.xxhash64(x, y))


def count_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exact counts per text: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    A null text counts as empty (no word, base_failed). Repeated rows are counted one by one.
    """
    d = fields(docs, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    return cut(_counted(d).drop("words", "hashes", "pairs").withColumnRenamed("id", id_col), "counts")


def _counted(d: DataFrame) -> DataFrame:
    d = d.select("id", "text", words_of(F.col("text")).alias("words"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    d = d.select(
        "id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    d = d.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    # hashes of 1, 2, 4 and 8 words in turn; each level is a column of its own, so it is computed once
    d = d.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    d = d.withColumn("pairs", _joined(F.col("hashes"), 1))
    d = d.withColumn("fours", _joined(F.col("pairs"), 2))
    # eight words that occur twice begin with four that do: other texts need no windows
    d = d.withColumn("windows", F.when(F.size(F.array_distinct("fours")) < F.size("fours"), _joined(F.col("fours"), 4))).drop("fours")
    w = F.col("windows")
    # only texts in which some window occurs twice pay for the sort that finds where
    ranked = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    repeated = F.filter(
        F.transform(
            F.col("ranked"),
            lambda x, k: F.when(
                (F.get(F.col("ranked"), k + 1)["h"] == x["h"]) | (F.get(F.col("ranked"), k - 1)["h"] == x["h"]), x["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    d = d.withColumn("ranked", F.when(F.size(F.array_distinct(w)) < F.size(w), ranked)).drop("windows")
    d = d.withColumn("hits", F.when(F.col("ranked").isNotNull(), F.array_sort(repeated))).drop("ranked")
    # union of the covered intervals [i, i + 8)
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).cast("long").alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    d = d.withColumn("n_repeat_words", F.coalesce(F.when(F.col("hits").isNotNull(), covered), F.lit(0).cast("long"))).drop("hits")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return d.withColumn("base_failed", failed)


THIRD = BUCKETS // 4


def _bucket(h: Column, n: int, at: int) -> Column:
    return (F.pmod(h, F.lit(n)) + at).cast("int")


def buckets_at(word: Column, following: Column) -> list[Column]:
    """Buckets of the n-grams that begin at a word: itself, it with the word that follows (null: none), its last three characters."""
    h = F.xxhash64(word)
    pair = F.when(following.isNotNull(), _bucket(F.xxhash64(h, F.xxhash64(following)), THIRD, THIRD))
    return [_bucket(h, THIRD, 0), pair, _bucket(F.xxhash64(F.substring(word, -3, 3)), 2 * THIRD, 2 * THIRD)]


def log_ratio(ratio: Column, words: Column, hashes: Column, pairs: Column) -> Column:
    """Sum of the log ratios of a text's n-grams, in the buckets of :func:`buckets_at`."""
    total = F.aggregate(hashes, F.lit(0.0), lambda acc, h: acc + F.get(ratio, _bucket(h, THIRD, 0)))
    total = F.aggregate(pairs, total, lambda acc, h: acc + F.get(ratio, _bucket(h, THIRD, THIRD)))
    return F.aggregate(words, total, lambda acc, w: acc + F.get(ratio, _bucket(F.xxhash64(F.substring(w, -3, 3)), 2 * THIRD, 2 * THIRD)))


def fit_ratio(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good_col: str = "quality", max_trusted: int = 20_000) -> list[float]:
    """log(p_target / p_raw) per bucket, add-one smoothed.

    The raw multinomial counts every document. The trusted-target one counts the texts of at most ``max_trusted``
    labelled rows with good_col = 1, the first by hash of their id: a bounded, deterministic sample of labels, so
    the flag is joined without moving any text. Without trusted rows every ratio is 0.
    """
    good = fields(labels, id=id_col, good=good_col).filter("good = 1 and id is not null").select("id").distinct()
    good = good.orderBy(F.xxhash64("id"), "id").limit(max_trusted).select(F.col("id"), F.lit(1).alias("trusted"))
    d = fields(docs, id=id_col, text=text_col).filter("text is not null")
    d = d.join(F.broadcast(good), "id", "left").select("trusted", words_of(F.col("text")).alias("words"))
    # a row per word instead of functions over arrays: everything from here to the partial counts is generated code.
    # explode_outer: the filter that explode() infers would be pushed down and evaluate the arrays twice
    following = F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0)))
    d = d.select("trusted", F.explode_outer(F.arrays_zip("words", following.alias("next"))).alias("at")).filter("at.words IS NOT NULL")
    d = d.select("trusted", F.explode_outer(F.array(*buckets_at(F.col("at.words"), F.col("at.next")))).alias("bucket"))
    rows = d.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted").alias("target")).collect()  # at most BUCKETS + 1 rows
    rows = [r for r in rows if r["bucket"] is not None]
    raw, target = [1.0] * BUCKETS, [1.0] * BUCKETS
    for r in rows:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    if not any(r["target"] for r in rows):
        return [0.0] * BUCKETS
    at, ar = sum(target), sum(raw)
    return [math.log(t / at) - math.log(r / ar) for t, r in zip(target, raw, strict=True)]


def quality_filter(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    good_col: str = "quality",
    min_ratio: float = -0.25,
    max_trusted: int = 20_000,
) -> DataFrame:
    """One row per document: the exact counts, base_failed, llr (mean log ratio over its n-grams) and kept.

    kept is false where base_failed, else llr >= min_ratio. Null text: no words, base_failed. A text without any
    n-gram has llr 0. Repeated rows are judged alike, one by one; an empty table gives an empty result.
    """
    ratio = F.from_json(F.lit(json.dumps(fit_ratio(docs, labels, id_col, text_col, good_col, max_trusted))), "array<double>")
    d = fields(docs, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    d = _counted(d)
    n = F.size("hashes") + F.size("pairs") + F.size("words")
    total = log_ratio(ratio, F.col("words"), F.col("hashes"), F.col("pairs"))
    d = d.withColumn("llr", F.when(n > 0, total / n).otherwise(F.lit(0.0)))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= min_ratio))
    d = d.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")
    return cut(d, "quality")  # a caller's filter pushed below would evaluate the nested arrays again and again
