"""Repeated passages wherever they stand: runs of at least ``min_words`` equal words, inside long lines and over short ones.

1. Winnowing picks about one in seven word n-grams so that every run of ``min_words`` words holds a picked one; n-grams
   seen twice are candidates.
2. Only around candidates, every window of ``min_words`` words is hashed; the first by document id and place stays.
3. Windows that repeat an earlier one, not overlapping it, are joined into passages and cut out of their documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import cut, drop_cut, marked, tidy
from inkspan.llm.sketch import chunks, mix, powers, word_hashes

STEP = 0xD1342543DE82EF95  # odd, and not the base of the words' own hashes
INVERSE = pow(STEP, -1, 1 << 64)
_WORD = re.compile(rb"\S+")


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every run of k words, from the words' hashes."""
    if len(h) < k:
        return np.empty(0, np.int64)
    run = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(STEP, len(h)), out=run[1:])
    return mix((run[k:] - run[:-k]) * powers(INVERSE, len(h) - k + 1)).view(np.int64)


def picked(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash of every ``window`` neighbours."""
    n, found = len(hashes) - window + 1, []
    for at in range(0, n, BLOCK):  # argmin copies the windows it looks at
        some = np.lib.stride_tricks.sliding_window_view(hashes[at : at + BLOCK + window - 1], window)
        found.append(np.unique(some.argmin(axis=1) + np.arange(at, at + len(some))))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def covered(places: np.ndarray, n: int, width: int) -> list[tuple[int, int]]:
    """(first word, end) of the joined windows of ``width`` words at these places, among n words."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, places, 1)
    np.add.at(step, places + width, -1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(step) > 0).astype(np.int8)])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """``text`` without these runs of words; a passage of whole lines goes with its last line break, one inside a line with
    one gap between words."""
    at = [m.span() for m in _WORD.finditer(text)]
    for a, b in reversed(runs):
        left, right = text[: at[a][0]], text[at[b - 1][1] :].lstrip(b" \t")
        if not left.rstrip(b" \t") or left.rstrip(b" \t").endswith(b"\n"):
            right = right.removeprefix(b"\r").removeprefix(b"\n")
            left = left.removesuffix(b"\n") if not right else left
        elif not right or right[:1] in b"\r\n":
            left = left.rstrip(b" \t")
        text = left + right
    return text


BLOCK = 8192
LISTS = pa.list_(pa.int32()), pa.list_(pa.int64())


def _hashed(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, words, hashes of its runs of k words) of every row of ``batch``; the text is its second column."""
    texts = batch.column(1).cast(pa.binary()).to_pylist()
    for some in chunks(texts):
        h, begin = word_hashes(texts[some])
        for i, (a, b) in enumerate(zip(begin.tolist(), begin[1:].tolist(), strict=False)):
            yield some.start + i, b - a, window_hashes(h[a:b], k)


def _spots(gram: int, window: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, found = [], []
            for _, _, h in _hashed(batch, gram):
                p = picked(h, window)
                places.append(p)
                found.append(h[p])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, LISTS[0]), pa.array(found, LISTS[1])], ["id", "places", "hs"])

    return run


def _windows(gram: int, min_words: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = np.arange(min_words - gram + 1)
        for batch in batches:
            places, found, spots = [], [], batch.column(2).to_pylist()
            for i, _, h in _hashed(batch, min_words):
                p = np.unique(np.array(spots[i], np.int64)[:, None] - before)
                p = p[(p >= 0) & (p < len(h))]
                places.append(p)
                found.append(h[p])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, LISTS[0]), pa.array(found, LISTS[1])], ["id", "places", "hs"])

    return run


def _cutter(min_words: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, all_places, all_hs = batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            texts, counts = [], []
            for i, n, h in _hashed(batch, min_words):
                p, wanted = np.array(all_places[i], np.int64), np.array(all_hs[i], np.int64)
                inside = p < len(h)  # rows that share an id can have other words there
                p, wanted = p[inside], wanted[inside]
                runs = covered(p[h[p] == wanted], n, min_words)
                texts.append(without(raw[i], runs).decode() if raw[i] is not None else None)
                counts.append(len(runs))
            rest = [batch.column(i) for i in range(4, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), *rest], ["id", "text", "n_cut", *batch.schema.names[4:]])

    return run


def _rows(found: DataFrame) -> DataFrame:
    return found.select("id", F.explode(F.arrays_zip("places", "hs")).alias("x")).select("id", F.col("x.places").alias("place"), F.col("x.hs").alias("h"))


def repeated_windows(docs: DataFrame, min_words: int) -> DataFrame:
    """(id, places, hs): per document the windows of ``min_words`` words that repeat an earlier one; docs: id, text."""
    gram = max(1, min_words // 2)
    named = docs.filter("id is not null and text is not null").select(F.col("id").cast("long").alias("id"), "text")
    held = cut(named.mapInArrow(tidy(_spots(gram, min_words - gram + 1)), "id long, places array<int>, hs array<long>"), "spots")
    # the counts are cut, so that a join with a hot key can be dealt over more tasks
    twice = cut(_rows(held).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "twice")
    spots = cut(_rows(held).join(twice, "h").groupBy("id").agg(F.collect_set("place").alias("spots")), "candidates")
    drop_cut(held, twice)
    some = marked(named, "id", spots).filter("marked").select("id", "text").join(spots, "id").select("id", "text", "spots")
    around = cut(some.mapInArrow(tidy(_windows(gram, min_words)), "id long, places array<int>, hs array<long>"), "windows")
    drop_cut(spots)
    windows = _rows(around)
    firsts = windows.groupBy("h").agg(F.min(F.struct("id", "place")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = cut(firsts.select("h", F.col("first.id").alias("first_id"), F.col("first.place").alias("first_place")), "firsts")
    again = windows.join(firsts, "h").filter((F.col("first_id") < F.col("id")) | ((F.col("first_id") == F.col("id")) & (F.col("place") - F.col("first_place") >= min_words)))
    again = again.groupBy("id").agg(F.collect_set(F.struct("place", "h")).alias("again"))
    out = cut(again.select("id", F.col("again.place").alias("places"), F.col("again.h").alias("hs")), "passages")
    drop_cut(around, firsts)
    return out


def remove_passages(docs: DataFrame, min_words: int) -> DataFrame:
    """``docs`` (id, text and more) with the text without its repeated passages, and n_cut, the number of them."""
    found = repeated_windows(docs, min_words)
    rest = [c for c in docs.columns if c not in ("id", "text")]
    d = marked(docs, "id", found)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    hit = d.filter("marked").drop("marked").withColumn("_key", F.col("id").cast("long")).join(found.withColumnRenamed("id", "_key"), "_key", "left")
    none = F.array().cast("array<int>"), F.array().cast("array<long>")
    hit = hit.select("id", "text", F.coalesce("places", none[0]).alias("places"), F.coalesce("hs", none[1]).alias("hs"), *rest)
    hit = hit.mapInArrow(tidy(_cutter(min_words)), f"id {kinds['id']}, text string, n_cut long" + "".join(f", {c} {kinds[c]}" for c in rest))
    return cut(hit, "without").unionByName(d.filter("not marked").drop("marked").withColumn("n_cut", F.lit(0).cast("long")))
