"""Substring dedup: by paragraphs (MinHash bands tuned for high recall, exact Jaccard of what collides, one survivor per
component), then by passages of equal words in what is left.

A paragraph is a line of at least ``min_words`` words. Of each component of similar paragraphs, over all documents and
within one, the first by document id and place stays; the others are cut out of their documents. Runs of at least
``min_words`` equal words that then still repeat, inside longer lines or over short ones, are cut by ``passages``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import cut, fields, marked
from inkspan.llm.minhash_dedup import near_duplicates
from inkspan.llm.passages import remove_passages


def duplicate_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(id, place): the paragraphs to remove, place counted from 0 over all lines of the document.

    Rows with a null id or text have none; of equal paragraphs the one with the smallest (id, place) stays.
    """
    d = fields(docs, id=id_col, text=text_col).filter("id is not null and text is not null")
    lines = d.select("id", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    lines = lines.filter(F.length("line") >= 2 * min_words - 1)  # shorter lines cannot hold so many words
    found = near_duplicates(lines.select(F.struct("id", "place").alias("at"), "line"), "at", "line", shingle, percent, min_words=min_words, miss=1e-6, join_same_id=False)
    return found.filter("not kept").select("at.id", "at.place").distinct()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, shingle: int = 5, percent: int = 80, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row: id, n_lines, n_removed (repeated lines and passages), the text without them, and ``carry``.

    Null texts stay null with no line; rows with a null id lose nothing; rows that share an id are one document and
    lose the same places. A removed line goes with its line break; the other lines stay as they are, in order.
    """
    gone = duplicate_paragraphs(docs, id_col, text_col, min_words, shingle, percent)
    gone = cut(gone.groupBy("id").agg(F.collect_set("place").alias("places")), "repeats")  # at most the lines of one document
    d = fields(docs, id=id_col, text=text_col, **{f"c{i}": c for i, c in enumerate(carry)})
    # texts that lose nothing are not shuffled
    d = marked(d, "id", gone)
    hit = d.filter("marked").join(gone, "id", "left").withColumn("lines", F.split("text", "\n", -1))
    # array_except would drop equal lines: the places that stay are taken instead
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "places"), lambda i: F.get("lines", i))
    hit = hit.withColumn("kept_lines", F.when(F.col("places").isNull(), F.col("lines")).otherwise(stay))
    shaped = lambda x, text, n, lost: x.select(
        "id",
        text.alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), 0).otherwise(lost).cast("long").alias("n_gone"),
        *[F.col(f"c{i}") for i in range(len(carry))],
    )
    hit = cut(shaped(hit, F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join("kept_lines", "\n")), F.size("lines"), F.size("lines") - F.size("kept_lines")), "shortened")
    rest = shaped(d.filter("not marked"), F.col("text"), F.size(F.split("text", "\n", -1)), F.lit(0))
    out = remove_passages(hit.unionByName(rest), min_words)
    return out.select(
        F.col("id").alias(id_col),
        "n_lines",
        (F.col("n_gone") + F.col("n_cut")).alias("n_removed"),
        F.col("text").alias(text_col),
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)],
    )
