"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled. The normaliser rewrites white space to the mark U+2581 and writes one mark in front. The
piece machine is a trie of arcs, character by character; where a piece ends, an arc writes it and leads to the state of
that piece. From state to state this arc weighs 1 where merging the two pieces' characters by score leaves just these
two pieces, else it is infinite. The fallback machine writes a character without a piece as its UTF-8 bytes, at weight 1
each. The composition with an input has states (position, last piece), opened as they are reached, and its shortest path
in the tropical semiring (min, +) is the encoding: a sequence of pieces is one just if every adjacent pair of it is.
Every prefix has one encoding, so of all arcs into a position one has finite weight: relaxation there ends with it.

What a worker remembers is bounded: about 120 MB for words, pairs of pieces and the compiled machines.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import Memo, fields, tidy

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
INFINITE = float("inf")
SHIFT = 1 << 32
SLICE = 1 << 20  # bytes of text encoded at once
START = -1  # the state after nothing and after bytes
PREFIX, PREFIXES = 8, 200_000  # longest prefix whose states are remembered, and how many of them


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Transducer:
    """Compiled from a model file once per worker."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only BPE models with the identity normaliser are compiled")
        self.prefix = spec.add_dummy_prefix
        self.pieces = [p.piece for p in model.pieces]
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.out = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" if p.type in (UNKNOWN, CONTROL) else p.piece.replace(MARK, " ").encode() for p in model.pieces]
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece goes on after white space")
        self.last = self._arcs()
        self.reached: dict[str, tuple] = {}
        #: pairs of characters that stand together in some piece
        self.inside = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.history = Memo(self._history, 20_000)
        self.weight = Memo(self._weight, 300_000)
        self.unit = Memo(self._path, 250_000)

    def _arcs(self) -> dict:
        """The piece machine by the last character: arcs lead back character by character, "" to the piece they write."""
        last: dict = {}
        for piece, i in self.id.items():
            state = last
            for c in reversed(piece):
                state = state.setdefault(c, {})
            state[""] = i
        return last

    def _history(self, piece: str) -> tuple[str, str, list[tuple[float, str, str]], str]:
        """First and last character, then per merge of the piece's own characters: score, new first and last symbol; what is left."""
        symbols, steps = list(piece), []
        while len(symbols) > 1:
            at, best = -1, -INFINITE
            for i in range(len(symbols) - 1):
                s = self.score.get(symbols[i] + symbols[i + 1])
                if s is not None and s > best:
                    at, best = i, s
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            steps.append((best, symbols[0], symbols[-1]))
        return piece[0], piece[-1], steps, symbols[0]

    def _weight(self, arc: int) -> float:
        """Of the arc from a state (last piece, or START after nothing or bytes) to the state of the next piece."""
        state, piece = arc // SHIFT - 1, arc % SHIFT
        fits = self._joint(state, piece) if state >= 0 else self.history[self.pieces[piece]][3] == self.pieces[piece]
        return 1.0 if fits else INFINITE

    def _joint(self, one: int, two: int) -> bool:
        """Whether merging both pieces' characters side by side never merges across the border."""
        one, two = self.pieces[one], self.pieces[two]
        (_, last, left, whole_left), (first, _, right, whole_right) = self.history[one], self.history[two]
        if whole_left != one or whole_right != two:
            return False
        i = j = 0
        while True:
            across = self.score.get(last + first, -INFINITE)
            a = left[i][0] if i < len(left) else -INFINITE
            b = right[j][0] if j < len(right) else -INFINITE
            # of equal scores the leftmost merge comes first
            if across > a and across >= b:
                return False
            if i == len(left) and j == len(right):
                return True
            if i < len(left) and (a >= b or j == len(right)):
                last = left[i][2]
                i += 1
            else:
                first = right[j][1]
                j += 1

    def _path(self, unit: str) -> bytes:
        """Shortest path through the composition with one unit (marks, then other characters): little-endian ids."""
        n, inside = len(unit), self.inside
        cuts = [i for i in range(1, n) if unit[i - 1 : i + 1] not in inside]
        if cuts:  # no piece spans these borders: one path after the other
            return b"".join([self.unit[unit[i:j]] for i, j in zip([0, *cuts], [*cuts, n], strict=True)])
        last, weight, known = self.last, self.weight, self.reached
        # the state of finite weight at each position (a piece, or START after bytes) and where its last arc begins; those
        # after a short prefix are remembered, since they depend on nothing else
        state, begin = [START] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            prefix = unit[:end] if end <= PREFIX else ""
            if prefix and (now := known.get(prefix)) is not None:
                state[end], begin[end] = now
                continue
            start = end - 1
            arc = last.get(unit[start])
            if arc is None or "" not in arc:
                begin[end] = start  # byte fallback
            else:
                while arc is not None:
                    piece = arc.get("")
                    if piece is not None and weight[(state[start] + 1) * SHIFT + piece] < INFINITE:
                        state[end], begin[end] = piece, start
                        break
                    start -= 1
                    arc = arc.get(unit[start]) if start >= 0 else None
            if prefix:
                if len(known) >= PREFIXES:
                    known.clear()
                known[prefix] = state[end], begin[end]
        ids: list[int] = []
        while n:
            if state[n] >= 0:
                ids.append(state[n])
            else:
                ids.extend(self.byte[x] for x in reversed(unit[begin[n] : n].encode("utf-8", "replace")))
            n = begin[n]
        return array("i", ids[::-1]).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        if not text:
            return b""
        words = text.replace(MARK, " ").split(" ")
        if "" not in words and self.prefix:
            return b"".join([self.unit[MARK + w] for w in words])
        units, marks = [], 1 if self.prefix else 0
        for k, w in enumerate(words):
            marks += k > 0
            if w or k == len(words) - 1:
                units.append(MARK * marks + w)
                marks = 0
        return b"".join([self.unit[u] for u in units if u])

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.out[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, round_trip: bool = False) -> DataFrame:
    """(id, ids array<int>): pieces of every whole text; with ``round_trip`` also a column of that name: whether decoding
    gives the text back, with marks as spaces. Null text: null ids and null; empty text: no ids. Repeated rows are
    encoded alike; ids of rows pass through, nulls included; an empty table gives an empty result."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                # slices of bounded size, so that long texts do not meet in memory
                size, end = 0, at
                while end < batch.num_rows and (end == at or size < SLICE):
                    size += len(batch.column(1)[end].as_buffer()) if batch.column(1)[end].is_valid else 0
                    end += 1
                part = batch.slice(at, end - at)
                texts = part.column(1).to_pylist()
                found = [None if x is None else machine.encode(x) for x in texts]
                offsets = np.cumsum([0, *[len(x) // 4 if x else 0 for x in found]]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join([x for x in found if x]), "<i4"))
                lists = pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array([x is None for x in found]))
                same = [None if x is None else machine.decode(np.frombuffer(ids, "<i4").tolist()) == x.replace(MARK, " ") for x, ids in zip(texts, found, strict=True)] if round_trip else []
                yield pa.RecordBatch.from_arrays([part.column(0), lists, *([pa.array(same, pa.bool_())] if round_trip else [])], ["id", "ids", *(["round_trip"] if round_trip else [])])
                at = end

    d = fields(docs, id=id_col, text=text_col)
    return d.mapInArrow(tidy(run), f"id {d.schema['id'].dataType.simpleString()}, ids array<int>" + ", round_trip boolean" * round_trip).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model: str | None = None) -> DataFrame:
    """Add the text of an array of ids; null ids give null. Control and unknown pieces write nothing."""
    path = model or default_model()

    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        machine = transducer(path)
        return pd.Series([None if x is None else machine.decode(x.tolist()) for x in ids], dtype=object)

    return encoded.withColumn(out_col, text_of(F.col(ids_col)))
