"""MinHash near-dedup: banded candidates, sequential Bayesian pruning on further hashes, exact check of the survivors.

1. Equal word sequences share a 128-bit digest; one representative each goes on, so copies cost one row.
2. Every document is paired with the first document of each of its buckets, one pair where they are the same.
3. Buckets whose members still lie in different components are searched for every remaining pair of different
   components, in blocks of bounded size; what does not belong to the bucket's largest component is compared with all
   members, so a large group of near copies costs its size, not its square.
4. Pairs are pruned after each batch of hashes by the posterior of their similarity; survivors are checked on the full
   shingle sets of their whole texts. A bitmap of fixed size keeps the texts of other documents out of that shuffle.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import cut, drop_cut, fields, marked, numbered, settled, tidy
from inkspan.llm.components import connected_components
from inkspan.llm.sketch import N_CHECK, SKETCH_SCHEMA, least_matches, shingle_set, sketcher, survivors, tune_bands

BLOCK = 512
KEY = ("pos", "h", "i", "j")


def _matrix(column: pa.Array) -> np.ndarray:
    """Verification hashes of a binary signature column, one row each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, N_CHECK)


def _prune_pairs(steps: list[tuple[int, int]]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = survivors(_matrix(batch.column("sa")), _matrix(batch.column("sb")), steps)
                yield batch.select(["a", "b", "ra", "rb"]).take(pa.array(rows))

    return run


def _search_blocks(steps: list[tuple[int, int]]):  # noqa: ANN202
    """Rows sorted by block -> one row per block that has surviving pairs of a left row and a right row (one row may be both) of another
    component: the block's key and the pairs as two arrays."""

    def pairs(block: pa.Table) -> list[pa.RecordBatch]:
        left = np.array(block["left"].to_pylist(), bool)
        vertex, comp = block["vertex"].to_numpy(), block["comp"].to_numpy()
        check, at = _matrix(block["sig"]), block["pos"][0].as_py()
        bands = np.array(block["bands"].to_pylist(), np.int64)[:, :at]
        others = np.flatnonzero(np.array(block["right"].to_pylist(), bool))
        out_a, out_b = [], []
        for i in np.flatnonzero(left):
            js = others[comp[others] != comp[i]]
            js = js[survivors(check[i], check[js], steps)]
            js = js[~(bands[js] == bands[i]).any(axis=1)]  # an earlier band has the pair
            out_a += [max(vertex[i], v) for v in vertex[js]]
            out_b += [min(vertex[i], v) for v in vertex[js]]
        if not out_a:
            return []
        longs = pa.list_(pa.int64())
        return [pa.RecordBatch.from_arrays([*[pa.array([block[c][0].as_py()], block[c].type) for c in KEY], pa.array([out_a], longs), pa.array([out_b], longs)], [*KEY, "a", "b"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            key = np.stack([t[c].to_numpy() for c in KEY], axis=1)
            ends = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()] if len(key) else [0]
            for x, y in zip(ends, ends[1:], strict=False):
                yield from pairs(t.slice(x, y - x))
            rest = t.slice(ends[-1])
        if rest is not None and rest.num_rows:
            yield from pairs(rest)

    return run


def _similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, both not empty."""
    if not len(p) or not len(q) or 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= percent * (len(p) + len(q) - both)


def _verify_blocks(k: int, percent: int):  # noqa: ANN202
    """Per block, its row of pairs and then one row per document in them, sorted so -> links that span what the full
    sets connect; a pair that other links of the block already connect is not compared."""

    def links(pairs: tuple[list[int], list[int]], sets: dict[int, list[np.ndarray]]) -> Iterator[tuple[int, int]]:
        root = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        for a, b in zip(*pairs, strict=True):
            x, y = find(a), find(b)
            if x != y and any(_similar(p, q, percent) for p in sets.get(a, ()) for q in sets.get(b, ())):
                root[max(x, y)] = min(x, y)
                yield a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pairs, sets = None, ([], []), {}
        for batch in batches:
            out = []
            for *at, a, b, vertex, text in zip(*[batch.column(n).to_pylist() for n in (*KEY, "a", "b", "vertex")], batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if at != key:
                    out += links(pairs, sets)
                    key, pairs, sets = at, ([], []), {}
                if a is not None:
                    pairs = (a, b)
                else:
                    sets.setdefault(vertex, []).append(shingle_set(text, k))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["src", "dst"])
        out = list(links(pairs, sets))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["src", "dst"])

    return run


def _verify(k: int, percent: int):  # noqa: ANN202
    """(a, b, text_a, text_b) -> (a, b, ok): 100 * intersection >= percent * union of the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = OrderedDict()

        def shingles(text: bytes) -> np.ndarray:
            found = recent.get(text)
            if found is None:
                found = recent[text] = shingle_set(text, k)
                if len(recent) > 64:
                    recent.popitem(last=False)
            return found

        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist(), strict=True):
                ok.append(_similar(shingles(x), shingles(y), percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    return run


@settled
def near_duplicates(
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    miss: float = 1e-4,
    recall: float = 0.9995,
    min_words: int = 0,
    join_same_id: bool = True,
) -> DataFrame:
    """One row per input row of ``min_words`` words or more: id, n_shingles, component_id (smallest id reachable by links) and kept.

    Two texts are linked where 100 * intersection >= percent * union of their word-shingle sets. Bands are tuned to
    ``recall`` at the threshold; a pair at the threshold is pruned with probability about ``miss``. Ids may be of any
    type that can be ordered, structs included. Null, empty and blank texts have no shingle and link with nothing. Rows
    that share an id are one document; without ``join_same_id`` each of their different texts is one, under that id. A
    null id belongs to no group: component_id null, kept true. An empty table gives an empty result.
    """
    bands, rows = tune_bands(percent / 100, recall)
    steps = least_matches(percent / 100, miss)
    texts = fields(items, vertex=id_col, text=text_col)
    kind = texts.schema["vertex"].dataType.simpleString()
    whole = cut(texts.mapInArrow(tidy(sketcher(shingle, bands, rows, min_words)), SKETCH_SCHEMA.format(kind=kind)), "sketches")
    worded = whole.filter("n > 0 and vertex is not null")
    # one row per word sequence: copies are collapsed by partial aggregation, before any shuffle
    once = worded.groupBy("d1", "d2").agg(F.min("vertex").alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    reps = numbered(once, "representatives")
    copies = reps.select("d1", "d2", "uid", "rep")
    sketches = cut(whole.select("vertex", "d1", "d2", "n"), "digests")
    drop_cut(whole)
    keys = reps.select("uid", F.posexplode("bands").alias("pos", "h"))
    # most buckets hold one document: only the others go on, with their first one
    hubs = keys.groupBy("pos", "h").agg(F.min("uid").alias("hub"), F.max("uid").alias("top")).filter("hub != top").drop("top")
    keys = cut(keys.join(hubs, ["pos", "h"]), "buckets")
    sig = reps.select("uid", "rep", "sig")

    def linked(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sig.select(F.col("uid").alias("a"), F.col("rep").alias("ra"), F.col("sig").alias("sa")), "a")
        both = both.join(sig.select(F.col("uid").alias("b"), F.col("rep").alias("rb"), F.col("sig").alias("sb")), "b")
        left = both.select("a", "b", "ra", "rb", "sa", "sb").mapInArrow(tidy(_prune_pairs(steps)), f"a long, b long, ra {kind}, rb {kind}")
        return cut(_exact(left, texts, shingle, percent), "links")

    def mixed_buckets(groups: DataFrame) -> DataFrame:
        """Members of the buckets that hold different components: pos, h, uid, comp, main (the component of most of them), n of all, m outside of main."""
        placed = keys.join(groups.withColumnRenamed("id", "uid"), "uid", "left").select("pos", "h", "uid", F.coalesce("component", "uid").alias("comp"))
        held = placed.groupBy("pos", "h", "comp").agg(F.count("*").alias("held"))
        most = F.max(F.struct("held", "comp"))
        mixed = held.groupBy("pos", "h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), most["comp"].alias("main"), F.sum("held").alias("n"), (F.sum("held") - F.max("held")).alias("m"))
        return cut(placed.join(mixed.filter("lo != hi").drop("lo", "hi"), ["pos", "h"]), "mixed")

    links = linked(keys.filter("uid != hub").select(F.col("uid").alias("a"), F.col("hub").alias("b")).distinct())
    if join_same_id:
        links = links.union(_rows_of_one_id(sketches.filter("n > 0 and vertex is not null"), copies))
    groups = cut(connected_components(links), "groups")
    rest = mixed_buckets(groups)
    drop_cut(keys)
    n_left, n_right = F.ceil(F.col("m") / BLOCK), F.ceil(F.col("n") / BLOCK)
    rest = rest.select("pos", "h", "uid", "comp", (F.col("comp") != F.col("main")).alias("aside"), n_left.alias("nl"), n_right.alias("nr"))
    own = lambda n: F.pmod(F.xxhash64("uid"), n)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    place = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    row, column = own(F.col("nl")), own(F.col("nr"))
    # one row for each block that a member belongs to; what lies aside is in a row of blocks and in a column, and once where they cross
    down = F.transform(upto(F.col("nl")), lambda i: place(i, column))
    across = F.when(F.col("aside"), F.transform(upto(F.col("nr")), lambda j: place(row, j))).otherwise(F.array().cast("array<struct<i:bigint,j:bigint>>"))
    dealt = rest.select("pos", "h", "uid", "comp", "aside", row.alias("row"), column.alias("column"), F.explode(F.array_union(down, across)).alias("at"))
    left, right = F.col("aside") & (F.col("at.i") == F.col("row")), F.col("at.j") == F.col("column")
    dealt = dealt.select("pos", "h", "at.i", "at.j", left.alias("left"), right.alias("right"), "uid", "comp")
    blocks = dealt.join(reps.select("uid", "sig", "bands"), "uid").select("pos", "h", "i", "j", "left", "right", F.col("uid").alias("vertex"), "comp", "sig", "bands")
    blocks = blocks.repartition("pos", "h", "i", "j").sortWithinPartitions("pos", "h", "i", "j")
    more = cut(blocks.mapInArrow(tidy(_search_blocks(steps)), "pos int, h long, i long, j long, a array<long>, b array<long>"), "blocks")
    inside = more.select(*KEY, F.explode(F.array_distinct(F.concat("a", "b"))).alias("uid"))
    # each document's text is fetched once, however many blocks it stands in
    named = cut(copies.join(inside.select("uid").distinct(), "uid").select("uid", F.col("rep").alias("vertex")), "inside")
    theirs = inside.join(named.join(_texts_of(texts, named.select("vertex").distinct()), "vertex").drop("vertex"), "uid")
    none = F.lit(None)
    rows = more.select(*KEY, "a", "b", none.cast("long").alias("vertex"), none.cast("string").alias("text")).unionByName(
        theirs.select(*KEY, none.cast("array<long>").alias("a"), none.cast("array<long>").alias("b"), F.col("uid").alias("vertex"), "text")
    )
    rows = rows.repartition(*KEY).sortWithinPartitions(*KEY, F.col("a").isNull())
    second = cut(rows.mapInArrow(tidy(_verify_blocks(shingle, percent)), "src long, dst long").distinct(), "links")
    renamed = second.join(groups.select(F.col("id").alias("src"), F.col("component").alias("x")), "src", "left").join(groups.select(F.col("id").alias("dst"), F.col("component").alias("y")), "dst", "left")
    renamed = renamed.select(F.coalesce("x", "src").alias("src"), F.coalesce("y", "dst").alias("dst"))
    merged = connected_components(renamed)
    final = groups.withColumnRenamed("id", "uid").join(merged.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "full_outer")
    final = final.select(F.coalesce("uid", "component").alias("uid"), F.coalesce("to", "component").alias("to"))
    # a merged component may be named by an id that is no vertex of the first round, or by one that is
    final = final.groupBy("uid").agg(F.min("to").alias("group"))
    # a group is named by the smallest id in it; documents that link with nothing never meet the groups
    members = cut(copies.select("uid", "rep").join(final, "uid"), "members")
    names = members.join(members.groupBy("group").agg(F.min("rep").alias("name")), "group").select("uid", "name")
    named = copies.join(names, "uid", "left").select("d1", "d2", F.coalesce("name", "rep").alias("component"))
    out = sketches.join(named, ["d1", "d2"], "left")
    component = F.when(F.col("vertex").isNotNull(), F.coalesce("component", "vertex"))
    return out.select(F.col("vertex").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("vertex") == component, F.lit(True)).alias("kept"))


def _rows_of_one_id(worded: DataFrame, copies: DataFrame) -> DataFrame:
    """(src, dst) links between the word sequences of rows that share an id."""
    seen = worded.groupBy("vertex").agg(*[f(c).alias(f"{c}_{f.__name__}") for c in ("d1", "d2") for f in (F.min, F.max)])
    seen = seen.filter("d1_min != d1_max or d2_min != d2_max").select("vertex")
    several = worded.join(seen, "vertex").join(copies, ["d1", "d2"]).select("vertex", "uid").distinct()
    least = several.groupBy("vertex").agg(F.min("uid").alias("dst"))
    return several.join(least, "vertex").filter("uid != dst").select(F.col("uid").alias("src"), "dst")


def _exact(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(src, dst) of the pairs whose full sets are similar enough; moves the texts of candidate documents only."""
    pairs = cut(pairs, "candidates")
    some = _texts_of(texts, pairs.select(F.explode(F.array("ra", "rb")).alias("vertex")).distinct())
    both = pairs.join(some.select(F.col("vertex").alias("ra"), F.col("text").alias("ta")), "ra").join(some.select(F.col("vertex").alias("rb"), F.col("text").alias("tb")), "rb")
    checked = both.select("a", "b", "ta", "tb").mapInArrow(tidy(_verify(shingle, percent)), "a long, b long, ok boolean")
    return checked.filter("ok").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def _texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(vertex, text) of the wanted vertices, each listed once; the bitmap keeps most other texts out of the shuffle."""
    some = marked(texts.filter("vertex is not null and text is not null"), "vertex", wanted).filter("marked").select("vertex", "text")
    # not a semi-join: the optimizer would push that below the bitmap, and every text would be shuffled
    return some.join(wanted, "vertex")
