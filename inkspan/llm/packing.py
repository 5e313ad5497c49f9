"""Best-fit packing with exact-complement hashing.

Texts are tokenized and cut to pieces in one map step. Packing is decided on the histogram of piece lengths, which has
at most ``capacity`` entries whatever the corpus size: for every length in descending order the gap it leaves is filled
exactly from an index of single, pair and triple sums under the counts still available; what is left is placed best-fit
decreasing, in bulk. The plan says which ranks within a length go to which sequences and offsets; pieces get their rank
by salted windows, so a length that a third of all pieces share is still split over many tasks.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkspan.llm.common import cut, fields, tidy

PIECES = "id {kind}, piece int, start long, length long, ids binary"


@lru_cache(maxsize=4)
def _tokenizer(path: str):  # noqa: ANN202
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _parts(word: bytes) -> tuple[bytes, ...]:
    """A word and the punctuation at its end, where an ASCII letter or digit stands before that: the border is one
    that the tokenizer makes too."""
    base = word.rstrip(b".,;:!?%$#*&|")
    return (base, word[len(base) :]) if base != word and base[-1:].isalnum() else (word,)


class _Words:
    """Token ids of single words, as bytes.

    Words of letters only are encoded 20 at a time, with a space between: each gives one token that ends a word, its
    last one, so the borders can be read from the ids. Where the count of such tokens differs (a letter whose lower case
    is no letter), and for all other words, each word is encoded alone. ASCII capitals of such words are folded first
    where the tokenizer folds them itself.
    """

    def __init__(self, path: str) -> None:
        tokenizer = _tokenizer(path)
        self.encode = tokenizer.encode_batch_fast
        suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(tokenizer.get_vocab_size(), bool)
        self.joins = bool(suffix)
        for token, i in tokenizer.get_vocab(with_added_tokens=False).items() if suffix else ():
            self.ends[i] = token.endswith(suffix)
        plain = not any(t.content.isalpha() for t in tokenizer.get_added_tokens_decoder().values())
        self.folds = plain and tokenizer.normalizer is not None and tokenizer.normalizer.normalize_str("AZ") == "az"

    def folded(self, word: bytes) -> bytes:
        return word.lower() if self.folds and word.isalpha() else word

    def ids(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        letters, alone = [], []
        for w in words:
            text = w.decode()
            (letters if self.joins and text.isalpha() else alone).append((w, text))
        blocks = [letters[i : i + 20] for i in range(0, len(letters), 20)]
        for block, got in zip(blocks, self.encode([" ".join(t for _, t in b) for b in blocks], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(ends) != len(block) or ends[-1] != 4 * len(ids):
                alone += block
                continue
            whole, at = ids.tobytes(), 0
            for (w, _), end in zip(block, ends.tolist(), strict=True):
                yield w, whole[at:end]
                at = end
        for (w, _), got in zip(alone, self.encode([t for _, t in alone], add_special_tokens=False), strict=True):
            yield w, array("I", got.ids).tobytes()


def tokenize_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0, words_kept: int = 400_000) -> DataFrame:
    """(id, piece, start, length, ids): each text's token ids and then ``end_id``, cut into pieces of at most ``capacity``.

    ids holds little-endian unsigned 32-bit ids. Null and empty texts give one piece with end_id only. The tokenizer
    must drop white space, so that runs between ASCII white space can be tokenized one by one and remembered (about
    ``words_kept`` of them per worker; the half that was longer without use goes first).
    """
    path = tokenizer or default_tokenizer()
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, known, before = _Words(path), {}, {}
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [x.split() if x else [] for x in part.column(1).cast(pa.binary()).to_pylist()]
                if len(known) > words_kept // 2:
                    known, before = {}, known
                words = set().union(*texts).difference(known)
                known |= {w: before[w] for w in words & before.keys()}
                new = {w: tuple(map(encoder.folded, _parts(w))) for w in words.difference(known)}
                needed = {p for both in new.values() for p in both}.difference(known)
                known |= {p: before[p] for p in needed & before.keys()}
                known.update(encoder.ids(list(needed.difference(known))))
                for word, both in new.items():
                    known[word] = known[both[0]] if len(both) == 1 else known[both[0]] + known[both[1]]
                rows, pieces, starts, lengths, ids = [], [], [], [], []
                for i, words in enumerate(texts):
                    whole = b"".join([known[w] for w in words]) + tail
                    for k, start in enumerate(range(0, len(whole) // 4, capacity)):
                        piece = whole[4 * start : 4 * (start + capacity)]
                        rows.append(i)
                        pieces.append(k)
                        starts.append(start)
                        lengths.append(len(piece) // 4)
                        ids.append(piece)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int32())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())],
                    ["id", "piece", "start", "length", "ids"],
                )

    d = fields(docs, id=id_col, text=text_col)
    return d.mapInArrow(tidy(run), PIECES.format(kind=d.schema["id"].dataType.simpleString()))


def plan_sequences(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how many sequences hold just these lengths), for all pieces of the histogram."""
    left = [0] * (capacity + 1)
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} outside 1..{capacity}")
        left[length] = n
    present = sum(1 << n for n in range(1, capacity + 1) if left[n])
    mirror = sum(1 << (capacity - n) for n in range(1, capacity + 1) if left[n])
    plan: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...], n: int) -> None:
        nonlocal present, mirror
        plan.append((lengths, n))
        for length, times in Counter(lengths).items():
            left[length] -= n * times
            if not left[length]:
                present &= ~(1 << length)
                mirror &= ~(1 << (capacity - length))

    def fits(lengths: tuple[int, ...]) -> int:
        return min(left[x] // times for x, times in Counter(lengths).items())

    def pair(total: int, with_: tuple[int, ...]) -> tuple[int, ...] | None:
        """The pair of available lengths with this sum whose larger length is largest."""
        hits = present & (mirror >> (capacity - total)) & ((1 << total) - 2) if total > 1 else 0
        while hits:
            a = hits.bit_length() - 1
            if 2 * a < total:
                break
            if fits((*with_, a, total - a)):
                return (a, total - a)
            hits ^= 1 << a
        return None

    def complement(length: int, gap: int) -> tuple[int, ...] | None:
        if left[gap] and fits((length, gap)):
            return (gap,)
        if (two := pair(gap, (length,))) is not None:
            return two
        rest = present & ((1 << (gap - 1)) - 1) if gap > 2 else 0
        while rest:
            a = rest.bit_length() - 1
            if 3 * a < gap:
                break
            if (two := pair(gap - a, (length, a))) is not None:
                return (a, *two)
            rest ^= 1 << a
        return None

    for length in range(capacity, 0, -1):
        while left[length]:
            found = () if length == capacity else complement(length, capacity - length)
            if found is None:
                break
            take((length, *found), fits((length, *found)))
    # best fit decreasing: bins with equal contents are one entry under the gap they leave
    bins: dict[int, list[list]] = {}
    gaps = 0
    for length in range(capacity, 0, -1):
        n = left[length]
        while n and (gaps >> length):
            gap = length + ((gaps >> length) & -(gaps >> length)).bit_length() - 1
            held, count = bins[gap].pop()
            k = min(n, count)
            if count > k:
                bins[gap].append([held, count - k])
            if not bins[gap]:
                gaps &= ~(1 << gap)
            bins.setdefault(gap - length, []).append([(*held, length), k])
            gaps |= 1 << (gap - length)
            n -= k
        each = capacity // length
        for k, count in ((each, n // each), (n % each, 1)):
            if k and count:
                bins.setdefault(capacity - k * length, []).append([(length,) * k, count])
                gaps |= 1 << (capacity - k * length)
    plan.extend((held, count) for entries in bins.values() for held, count in entries)
    return plan


def pack(pieces: DataFrame, capacity: int = 2048, order: tuple[str, ...] = ("id", "piece")) -> DataFrame:
    """Add sequence_id and offset to every row of ``pieces`` by its ``length`` (1..capacity); other columns pass through.

    Rows are numbered within a length by ``order``; equal rows are packed one by one. An empty table stays empty.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    rows, number, used = [], 0, Counter()
    for lengths, n in plan_sequences(counts, capacity):
        offset = 0
        for length, same in groupby(sorted(lengths, reverse=True)):
            times = len(list(same))
            rows.append((length, used[length], used[length] + n * times, number, times, offset))
            used[length] += n * times
            offset += length * times
        number += n
    plan = spark.createDataFrame(rows or [(0, 0, 0, 0, 1, 0)], "length long, lo long, hi long, base long, times long, at long")
    salt = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salt)))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inner = Window.partitionBy("length", "_salt").orderBy(*order)
    ranked = salted.withColumn("_rank", F.row_number().over(inner) - 1).join(starts, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_first"))
    # the plan grows with capacity, not with the rows, so it is broadcast
    p = F.broadcast(plan.withColumnRenamed("length", "_length"))
    placed = ranked.join(p, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi")))
    turn = F.col("_rank") - F.col("lo")
    return placed.select(
        *[c for c in pieces.columns],
        (F.col("base") + F.floor(turn / F.col("times"))).alias("sequence_id"),
        (F.col("at") + F.pmod(turn, F.col("times")) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """Packed pieces of all texts: id, piece, start, length, ids_crc32, sequence_id, offset.

    Ids may repeat or be null; each row is a document of its own.
    """
    pieces = tokenize_pieces(docs, id_col, text_col, capacity, tokenizer).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(cut(pieces, "pieces"), capacity).withColumnRenamed("id", id_col)
