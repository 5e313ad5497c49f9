"""Retrieval: chunks, exact cosine, top-k recall inside a session, rerank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructField, StructType

CHUNK, OVERLAP, RECALL, RERANK = 500, 80, 20, 3
PARAGRAPH = "\n\\s*\n|\n(?=\\s*(?:\\d+[.、)]|[-*•]|【|#))"


def chunk(text: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Chunks of a text: paragraphs merged up to ``size`` characters, longer ones cut with ``overlap``."""
    paragraphs = F.filter(F.transform(F.split(text, PARAGRAPH, -1), lambda p: F.regexp_replace(p, "(?U)^\\s+|\\s+$", "")), lambda p: p != "")
    step = size - overlap

    def add(acc: Column, p: Column) -> Column:
        full = (acc["buf"] != "") & (F.length(acc["buf"]) + F.length(p) + 1 > size)
        done = F.when(full, F.concat(acc["done"], F.array(acc["buf"]))).otherwise(acc["done"])
        buf = F.when(full | (acc["buf"] == ""), p).otherwise(F.concat(acc["buf"], F.lit("\n"), p))
        extra = F.greatest(F.lit(0), F.ceil((F.length(buf) - size) / step)).cast("int")
        cut = F.when(extra > 0, F.transform(F.sequence(F.lit(0), extra - 1), lambda k: F.substring(buf, k * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.concat(done, cut).alias("done"), F.substring(buf, extra * step + 1, F.length(buf)).alias("buf"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))
    return F.aggregate(paragraphs, start, add, lambda acc: F.when(acc["buf"] != "", F.concat(acc["done"], F.array(acc["buf"]))).otherwise(acc["done"]))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


#: queries and chunks that meet at once; parts that a session's queries and chunks are dealt to
QUERIES, CHUNKS, QUERY_PARTS, PARTS = 512, 2048, 8, 32


def _blocks(df: DataFrame, key: str, name: str, size: int, parts: int) -> DataFrame:
    """(key, _part, block): a part's rows of id, vector and length in blocks of ``size`` at most, each in the order of ids."""
    e = F.col("embedding")
    if not isinstance(df.schema["embedding"].dataType.elementType, (FloatType, DoubleType)):
        e = e.cast("array<double>")
    row = F.struct(F.col(name).alias("id"), e.alias("vector"), F.sqrt(dot(e, e)).alias("length"))
    d = df.filter(F.col(key).isNotNull()).select(key, F.pmod(F.xxhash64(name), F.lit(parts)).cast("int").alias("_part"), row.alias("_row"))
    nth = F.row_number().over(Window.partitionBy(key, "_part").orderBy("_row.id"))
    d = d.withColumn("_nth", F.floor((nth - 1) / size))
    return d.groupBy(key, "_part", "_nth").agg(F.sort_array(F.collect_list("_row")).alias("block")).drop("_nth")


def _by_size(lengths: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, vectors and lengths of those with a length, by number of elements."""
    there = np.flatnonzero(lengths.is_valid().to_numpy(zero_copy_only=False))
    sizes = pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False)[there]
    found = {}
    for size in np.unique(sizes).tolist():
        at = there[sizes == size]
        some = pa.array(at)
        found[size] = (at, vectors.take(some).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size), lengths.take(some).to_numpy(zero_copy_only=False))
    return found


@np.errstate(all="ignore")
def _best(queries: pa.Array, chunks: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the ``n`` best chunks of each query, with similarity and whether there is one.

    One product of matrices says which may be among them: all that its error leaves open. Those are computed anew, element by
    element in the order of :func:`dot`, so similarities and ties are the same whatever block a chunk is in.
    """
    (_, qv, ql), (_, cv, cl) = queries.flatten(), chunks.flatten()
    rest, near = _by_size(ql, qv), _by_size(cl, cv)
    found = []
    for size, (at, a, al) in rest.items():
        to, b, bl = near.get(size, (np.zeros(0, np.int64), np.zeros((0, size)), np.zeros(0)))
        plain, known = ((x > 1e-100) & (x < 1e100) for x in (al, bl))  # pairs of others are computed anew in any case
        rough = (a / al[:, None]) @ (b / bl[:, None]).T
        rough[~plain] = rough[:, ~known] = -np.inf
        least = np.partition(rough, len(to) - n, axis=1)[:, len(to) - n] if len(to) > n else np.full(len(at), -np.inf)
        open_ = rough >= (least - (size + 8) * 1e-15)[:, None]
        open_[:, ~known] = True
        i, j = np.nonzero(open_)
        total = np.zeros(len(i))
        for x in range(size):
            total += a[i, x] * b[j, x]
        both = al[i] * bl[j]
        found.append((at[i], to[j], total / both, both != 0))
    # no similarity: the first chunks by id come last
    for size, at in [(s, x[0]) for s, x in rest.items()] + [(None, np.flatnonzero(ql.is_null().to_numpy(zero_copy_only=False)))]:
        none = np.setdiff1d(np.arange(len(chunks)), near[size][0] if size in near else [])[:n]
        found.append((np.repeat(at, len(none)), np.tile(none, len(at)), np.zeros(len(at) * len(none)), np.zeros(len(at) * len(none), bool)))
    i, j, value, there = (np.concatenate(x) for x in zip(*found, strict=True))
    kind = np.where(there, np.where(np.isnan(value), 0, 1), 2)  # as Spark sorts: NaN is above all numbers
    order = np.lexsort((j, -np.where(kind == 1, value, 0.0), kind, i))
    i, j, value, there = i[order], j[order], value[order], there[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < n
    return i[keep], j[keep], value[keep], there[keep]


def recall(queries: DataFrame, chunks: DataFrame, key: str = "session_id", n: int = RECALL) -> DataFrame:
    """The nearest chunks of the same session for each query: query_id, idx, similarity, rank. Exact: every query meets
    every chunk of its session. Blocks of both meet by session and part, so that a large session is no single task, and
    leave ``n`` chunks a query; lengths are computed once a vector, before the join."""
    q = _blocks(queries, key, "query_id", QUERIES, QUERY_PARTS).select(key, F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part"), F.col("block").alias("_q"))
    d = q.join(_blocks(chunks, key, "idx", CHUNKS, PARTS).withColumnRenamed("block", "_c"), [key, "_part"])
    schema = StructType([queries.schema[key], queries.schema["query_id"], chunks.schema["idx"], StructField("similarity", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q, c = (batch.column(k).slice(row, 1).flatten() for k in (1, 2))
                i, j, value, there = _best(q, c, n)
                keys = batch.column(0).take(pa.array(np.full(len(i), row)))
                yield pa.RecordBatch.from_arrays([keys, q.flatten()[0].take(pa.array(i)), c.flatten()[0].take(pa.array(j)), pa.array(value, mask=~there)], schema.names)

    d = d.select(key, "_q", "_c").mapInArrow(run, schema)
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc_nulls_last(), "idx")
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def rerank(recalled: DataFrame, scores: DataFrame | None, n: int = RERANK) -> DataFrame:
    """The best of the recalled by reranker scores (query_id, idx, score), recall order where there is none."""
    if scores is None:
        return recalled.filter(F.col("rank") <= n)
    d = recalled.join(scores, ["query_id", "idx"], "left")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "rank")
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def cached_replies(prompts: DataFrame, cache: DataFrame, now: str, days: int = 7) -> DataFrame:
    """Prompts with the cached reply of their key that is younger than ``days``, and whether there was one."""
    fresh = cache.filter((F.col("created_at") > F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")))
    newest = fresh.groupBy("prompt_key").agg(F.max_by("reply_text", "created_at").alias("reply_text"))
    return prompts.join(newest, "prompt_key", "left").withColumn("cache_hit", F.col("reply_text").isNotNull())
