"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosine checks, distributed components.

Equal vectors are collapsed first. A bucket of one table with more vectors than a block is compared block against
block, each pair of blocks being a task's group of bounded size; a pair of vectors counts in the first table where it
collides. Inside a task only per-vector link counts and a spanning forest of the links are kept, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import cut, fields, numbered, settled, tidy
from inkspan.llm.components import connected_components

TABLES, BITS = 20, 16  # a pair at cosine 0.98 shares some bucket with probability above 0.9997
BLOCK = 512


def _hash_signs(seed: int):  # noqa: ANN202
    planes: dict[int, np.ndarray] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(BITS, dtype=np.int64)
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            keys = []
            for v in vectors:
                d = len(v)
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((TABLES * BITS, d))
                x = np.asarray(v, np.float64)
                keys.append(((planes[d] @ (x / np.abs(x).max()) > 0).reshape(TABLES, BITS) @ weights).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int32()))], ["vertex", "keys"])

    return run


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of n positions over links a-b."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _compare(cosine: float):  # noqa: ANN202
    def group(t: pa.Table) -> pa.RecordBatch | None:
        # i == j: all pairs of one block; else pairs across the two blocks
        vertex, copies, side = t["vertex"].to_numpy(), t["copies"].to_numpy(), t["block"].to_numpy()
        order = np.argsort(vertex)
        vertex, copies, side = vertex[order], copies[order], side[order]
        x = np.array(t["vector"].to_pylist(), np.float64)[order]
        keys = np.array(t["keys"].to_pylist(), np.int32)[order][:, : t["pos"][0].as_py()]
        x /= np.abs(x).max(axis=1, keepdims=True)  # keeps squares of very large or small components finite
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        p, q = np.flatnonzero(side == i), np.flatnonzero(side == j)
        a, b = np.nonzero(x[p] @ x[q].T >= cosine)
        a, b = p[a], q[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        if not len(a):
            return None
        seen = np.zeros(len(a), bool)
        for at in range(0, len(a), 65536):
            part = slice(at, at + 65536)
            seen[part] = (keys[a[part]] == keys[b[part]]).any(axis=1)
        links = np.zeros(len(vertex), np.int64)
        np.add.at(links, a[~seen], copies[b[~seen]])
        np.add.at(links, b[~seen], copies[a[~seen]])
        low = _components(len(vertex), a, b)
        linked = np.unique(np.concatenate([a, b]))
        return pa.RecordBatch.from_arrays([pa.array(vertex[linked]), pa.array(links[linked]), pa.array(vertex[low[linked]])], ["vertex", "links", "low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            key = np.stack([t[c].to_numpy() for c in ("pos", "h", "label", "dim", "i", "j")], axis=1)
            ends = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()] if len(key) else [0]
            yield from (r for x, y in zip(ends, ends[1:], strict=False) if (r := group(t.slice(x, y - x))) is not None)
            rest = t.slice(ends[-1])
        if rest is not None and rest.num_rows and (r := group(rest)) is not None:
            yield r

    return run


@settled
def embedding_components(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = 0.98,
    seed: int = 7,
) -> DataFrame:
    """One row per vector: id, n_links (other vectors linked directly), component_id, kept (it names its component).

    Vectors of equal, non-null label and equal length are linked at ``cosine`` or more, in double precision. Vectors
    that are null, empty, zero or hold a null or non-finite component link with nothing; so do rows with a null id,
    whose component is null and which are kept. Rows that share an id and vector count as copies of each other;
    rows that share an id are one vertex. An empty table gives an empty result.
    """
    v = fields(vectors, vertex=id_col, vector=vector_col, label=label_col)
    v = v.select(F.col("vertex").cast("long").alias("vertex"), F.col("vector").cast("array<double>").alias("vector"), F.col("label").cast("long").alias("label"))
    usable = F.col("vertex").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0)
    usable &= F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) <= 1.7976931348623157e308)) & F.exists("vector", lambda x: x != 0)
    good = v.filter(usable)
    reps = good.groupBy("label", "vector").agg(F.min("vertex").alias("rep"), F.count("*").alias("copies"))
    reps = numbered(reps, "vectors")
    hashed = reps.select("uid", "vector").mapInArrow(tidy(_hash_signs(seed)), "vertex long, keys array<int>")
    hashed = cut(hashed.join(reps.select(F.col("uid").alias("vertex"), "label", F.size("vector").alias("dim")), "vertex"), "signs")
    keys = hashed.select("vertex", "label", "dim", F.posexplode("keys").alias("pos", "h"))
    bucket = ["pos", "h", "label", "dim"]
    full = keys.groupBy(*bucket).agg(F.count("*").alias("n")).filter("n > 1")
    nb = F.ceil(F.col("n") / BLOCK)
    rows = keys.join(full, bucket).select(*bucket, "vertex", F.pmod(F.xxhash64("vertex"), nb).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), nb - 1)).alias("other"))
    rows = rows.select(*bucket, "vertex", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rows = rows.join(hashed.select("vertex", "keys"), "vertex").join(reps.select(F.col("uid").alias("vertex"), "vector", "copies"), "vertex")
    rows = rows.select(*bucket, "i", "j", "block", "vertex", "copies", "keys", "vector").repartition(*bucket, "i", "j").sortWithinPartitions(*bucket, "i", "j")
    found = cut(rows.mapInArrow(tidy(_compare(cosine)), "vertex long, links long, low long").groupBy("vertex", "low").agg(F.sum("links").alias("links")), "links")
    counts = found.groupBy("vertex").agg(F.sum("links").alias("links"))
    ids = reps.select("uid", "rep")
    named = found.filter("vertex != low").select("vertex", "low").distinct()
    named = named.join(ids.select(F.col("uid").alias("vertex"), F.col("rep").alias("src")), "vertex").join(ids.select(F.col("uid").alias("low"), F.col("rep").alias("dst")), "low")
    twice = good.join(reps.select("label", "vector", "rep"), ["label", "vector"]).groupBy("vertex").agg(F.min("rep").alias("dst"), F.max("rep").alias("src")).filter("src != dst")
    groups = connected_components(named.select("src", "dst").union(twice.select("src", "dst")))
    told = reps.join(counts.withColumnRenamed("vertex", "uid"), "uid", "left").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    told = told.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    alone = v.filter(~F.coalesce(usable, F.lit(False))).select("vertex", F.lit(0).cast("long").alias("n_links"), F.col("vertex").alias("component"))
    out = good.join(told, ["label", "vector"]).select("vertex", "n_links", "component").unionByName(alone)
    return out.select(F.col("vertex").alias(id_col), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("vertex") == F.col("component"), F.lit(True)).alias("kept"))
