"""Fill-in-middle transformation over ropes.

A text becomes a balanced tree whose leaves hold a few KB of it and cache how many line ends, code points and bytes they
hold; inner nodes cache the sums. Two splits by line rank give prefix, middle and suffix, which share their leaves with
the tree they came from; the output is these subtrees joined with the sentinels in another order. The inverse reads the
output into a tree again, splits it at its sentinels and joins the parts in reading order. No part is copied until the
leaves of a result are written. All rows are independent, so the work stays in the partitions of the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import fields, tidy
from inkspan.llm.sketch import chunks

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
LEAF = 4096  # bytes
LINES, CHARS, BYTES = range(3)  # the cached counts


class Rope:
    """A leaf (``leaf`` holds its bytes) or an inner node (``left`` and ``right``); ``counts`` are cached in both."""

    __slots__ = ("counts", "leaf", "left", "right")

    def __init__(self, leaf: bytes | None, left: Rope | None = None, right: Rope | None = None) -> None:
        self.leaf, self.left, self.right = leaf, left, right
        if leaf is not None:
            chars = len(leaf) if leaf.isascii() else int(np.count_nonzero(_begins(leaf)))
            self.counts = (leaf.count(b"\n"), chars, len(leaf))
        else:
            self.counts = tuple(a + b for a, b in zip(left.counts, right.counts, strict=True))

    def leaves(self) -> Iterator[bytes]:
        open_nodes = [self]
        while open_nodes:
            node = open_nodes.pop()
            if node.leaf is not None:
                yield node.leaf
            else:
                open_nodes += (node.right, node.left)

    def units(self) -> int:
        """Lines; the last one may lack its line end."""
        node = self
        while node.leaf is None:
            node = node.right
        return self.counts[LINES] + (node.leaf[-1:] not in (b"", b"\n"))


EMPTY = Rope(b"")


def _begins(data: bytes) -> np.ndarray:
    """Which bytes begin a code point."""
    return (np.frombuffer(data, np.uint8) & 0xC0) != 0x80


def rope(data: bytes) -> Rope:
    """A balanced tree over ``data``; no code point is cut by a leaf border."""
    leaves, at = [], 0
    while at < len(data):
        end = min(at + LEAF, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        leaves.append(Rope(data[at:end]))
        at = end
    while len(leaves) > 1:
        leaves = [joined(*leaves[i : i + 2]) for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else EMPTY


def joined(*parts: Rope) -> Rope:
    found = [p for p in parts if p.counts[BYTES]]
    if not found:
        return EMPTY
    node = found[0]
    for p in found[1:]:
        node = Rope(None, node, p)
    return node


def _cut_at(leaf: bytes, measure: int, rank: int) -> int:
    """Byte after the first ``rank`` line ends, code points or bytes of a leaf."""
    if measure == BYTES or (measure == CHARS and leaf.isascii()):
        return rank
    if measure == CHARS:
        at = np.flatnonzero(_begins(leaf))
        return int(at[rank]) if rank < len(at) else len(leaf)
    return int(np.flatnonzero(np.frombuffer(leaf, np.uint8) == 10)[rank - 1]) + 1


def split(node: Rope, measure: int, rank: int) -> tuple[Rope, Rope]:
    """What lies before and after the first ``rank`` of what ``measure`` counts; as deep as the tree."""
    if rank <= 0:
        return EMPTY, node
    if rank >= node.counts[measure] and measure != LINES:
        return node, EMPTY
    if node.leaf is not None:
        at = _cut_at(node.leaf, measure, rank)
        return Rope(node.leaf[:at]), Rope(node.leaf[at:])
    before = node.left.counts[measure]
    if rank <= before:
        a, b = split(node.left, measure, rank)
        return a, joined(b, node.right)
    a, b = split(node.right, measure, rank - before)
    return joined(node.left, a), b


def lines_split(node: Rope, rank: int) -> tuple[Rope, Rope]:
    """Before and after the first ``rank`` lines."""
    return (node, EMPTY) if rank >= node.units() else split(node, LINES, rank)


def draws(seed: int, key: str | None) -> list[int]:
    """Four numbers of 32 bits from the seed and the row's id as text (null: none)."""
    digest = hashlib.sha256(f"{seed}:{key or ''}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def rearranged(text: bytes, h: list[int], rate: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """Lines, form, code points of prefix and middle, output."""
    whole = rope(text)
    n = whole.units()
    if not text or h[2] % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    rest, suffix = lines_split(whole, second)
    prefix, middle = lines_split(rest, first)
    marks = [Rope(s) for s in (PREFIX, SUFFIX, MIDDLE)]
    if h[3] % 100 < spm:
        form, out = "spm", joined(marks[1], suffix, marks[0], prefix, marks[2], middle)
    else:
        form, out = "psm", joined(marks[0], prefix, marks[1], suffix, marks[2], middle)
    return n, form, prefix.counts[CHARS], middle.counts[CHARS], b"".join(out.leaves())


def restored(output: bytes, form: str) -> bytes:
    """The text behind ``output``: the tree is split where the sentinels stand and joined in reading order."""
    if form == "plain":
        return output
    order = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    node, parts = rope(output), {}
    at = [output.index(s) for s in order]
    for mark, start in reversed(list(zip(order, at, strict=True))):
        node, tail = split(node, BYTES, start)
        parts[mark] = split(tail, BYTES, len(mark))[1]
    return b"".join(joined(parts[PREFIX], parts[MIDDLE], parts[SUFFIX]).leaves())


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """One row per document: id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars, output.

    ``rate`` of 100 documents are rearranged, ``spm`` of 100 of them with the suffix first; both and the two borders
    are drawn from the seed and the id alone. Plain (output is the text, no counts) are also empty texts and texts that
    hold a sentinel. Null text: empty. Null id: drawn from the seed alone. Rows with the same id are cut by the same
    draws, each for itself; an empty table gives an empty table; other columns are not looked at.
    """
    d = fields(docs, id=id_col, text=text_col).select("id", F.col("id").cast("string").alias("key"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for some in chunks(texts):
                rows = [rearranged(t, draws(seed, k), rate, spm) for k, t in zip(keys[some], texts[some], strict=True)]
                made = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(some.start, len(rows)), *made], names)

    kind = d.schema["id"].dataType.simpleString()
    out = d.mapInArrow(tidy(run), f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.select(F.col("id").alias(id_col), "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"))


def restore(filled: DataFrame, output_col: str = "output", form_col: str = "form", text_col: str = "text") -> DataFrame:
    """All columns of ``filled`` but the output, and ``text_col``: the exact text behind output and form. A null output
    or form gives a null text."""
    kept = [c for c in filled.columns if c not in (output_col, text_col)]
    d = filled.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{output_col}`").cast("binary").alias("_output"), F.col(f"`{form_col}`").alias("_form"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outputs, forms = (batch.column(i).to_pylist() for i in (batch.num_columns - 2, batch.num_columns - 1))
            texts = [None if o is None or f is None else restored(o, f) for o, f in zip(outputs, forms, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.binary())], [*batch.schema.names[:-2], "_text"])

    schema = d.drop("_form").withColumnRenamed("_output", "_text").schema
    out = d.mapInArrow(tidy(run), schema)
    return out.select(*[F.col(f"`{c}`") for c in kept], F.col("_text").cast("string").alias(text_col))
