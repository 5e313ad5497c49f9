"""Quote location: exact in the hint, fuzzy in the hint, exact in the text, fuzzy in the text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache, reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from inkspan.functions.binding import once
from inkspan.functions.text import normalize_for_match, strip_quotes

LEAST_QUOTE, LEAST_FUZZY, FUZZY_SCORE = 2, 6, 90.0
SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("score", DoubleType()), StructField("method", StringType())])


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel columns over Python integers."""
    masks: dict[int, int] = {}
    for i, c in enumerate(a.tolist()):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b.tolist():
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _edits(m: np.ndarray | int) -> np.ndarray:
    """Deletions, and as many insertions, at most between two texts of m characters whose similarity is FUZZY_SCORE or more."""
    return np.floor((1 - FUZZY_SCORE / 100) * m + 1e-9).astype(np.int64)


def _windows(own: np.ndarray, told: np.ndarray, m: int, starts: np.ndarray) -> np.ndarray:
    """Those starts whose windows hold enough of a quote's 3-grams (own) for FUZZY_SCORE: a deletion breaks three, an insertion two."""
    least = m - GRAM + 1 - (2 * GRAM - 1) * int(_edits(m))
    if least <= 0 or not len(starts):
        return starts
    width = m - GRAM + 1
    run = np.concatenate([[0], np.cumsum(np.isin(told, own))])
    starts = starts[run[starts + width] - run[starts] >= least]
    if len(starts):
        values, counts = np.unique(own, return_counts=True)
        held = np.zeros(len(starts), np.int64)
        for v, k in zip(values, counts, strict=True):  # a gram counts as often as the quote has it
            at = np.flatnonzero(told == v)
            held += np.minimum(np.searchsorted(at, starts + width) - np.searchsorted(at, starts), k)
        starts = starts[held >= least]
    return starts


def similar_part(quote: str, text: str, starts: np.ndarray | None = None) -> tuple[int, int, float] | None:
    """The part of a text most like a quote: (start, end, similarity 0..100), the similarity being twice the common
    subsequence over both lengths. Windows of the quote's length are tried where letter counts allow a result of
    FUZZY_SCORE, then clipped windows at both ends. ``starts``, sorted, names the only windows that can reach it, if known."""
    q, t = np.frombuffer(quote.encode("utf-32-le"), np.uint32), np.frombuffer(text.encode("utf-32-le"), np.uint32)
    m, n = len(q), len(t)
    if not m or m > n:
        return None
    own, told = _grams(quote), _grams(text)
    starts = _windows(own, told, m, np.arange(n - m + 1) if starts is None else starts)
    # an upper bound per window from the characters it shares with the quote
    shared = np.zeros(n - m + 1, np.int64)
    values, counts = np.unique(q, return_counts=True)
    for v, k in zip(values, counts, strict=True) if len(starts) else ():
        run = np.concatenate([[0], np.cumsum(t == v)])
        shared += np.minimum(run[m:] - run[: n - m + 1], k)
    best: tuple[int, int, float] | None = None
    for s in starts[np.argsort(-shared[starts], kind="stable")]:
        if shared[s] * 100 / m < max(FUZZY_SCORE, best[2] if best else 0):
            break
        score = 100.0 * _common(q, t[s : s + m]) / m
        if best is None or score > best[2] or (score == best[2] and s < best[0]):
            best = (int(s), int(s) + m, score)
    # a clipped window of k characters that reaches FUZZY_SCORE holds 0.25 (m + k) - 2 of the quote's 3-grams or more
    least = 0.45 * m - 2
    head, tail = (np.isin(own, _grams(part)).sum() >= least for part in (text[:m], text[n - m :]))
    # and no more in common with it than the whole m characters there have
    most = {0: _common(q, t[:m]) if head else 0, 1: _common(q, t[n - m :]) if tail else 0}
    for k in range(max(1, int(m * 0.8)), m) if head or tail else ():
        for side, (s, e) in enumerate(((0, k), (n - k, n))):
            if 200.0 * min(k, most[side]) / (m + k) < FUZZY_SCORE:
                continue
            score = 200.0 * _common(q, t[s:e]) / (m + k)
            if best is None or score > best[2]:
                best = (s, e, score)
    return best if best and best[2] >= FUZZY_SCORE else None


@F.pandas_udf(SPAN)
def _fuzzy(quote: pd.Series, text: pd.Series) -> pd.DataFrame:
    rows = []
    for q, t in zip(quote, text, strict=True):
        found = similar_part(q, t) if q and t and LEAST_FUZZY <= len(q) <= len(t) else None
        rows.append((None, None, None, None) if found is None else (found[0], found[1], round(found[2] / 100, 3), "fuzzy"))
    return pd.DataFrame(rows, columns=["start", "end", "score", "method"]).astype({"start": "Int32", "end": "Int32"})


def exact_span(needle: Column, haystack: Column, offset: Column) -> Column:
    at = F.instr(haystack, needle) - 1
    return F.when(at >= 0, F.struct((at + offset).cast("int").alias("start"), (at + offset + F.length(needle)).cast("int").alias("end"), F.lit(1.0).alias("score"), F.lit("exact").alias("method")))


def locate(quotes: DataFrame, quote: str = "quote", text: str = "text", hint_start: str | None = None, hint_end: str | None = None) -> DataFrame:
    """Add ``span`` (start, end, score, method; null where the quote is nowhere) to rows of quote and text.

    Exact rows are settled by built-in search; only the others reach the Python function. Quotes of fewer than two
    characters locate nothing; null quotes or texts neither.
    """
    n = F.length("_hay")
    lo = F.greatest(F.lit(0), F.coalesce(F.col(hint_start), F.lit(0))) if hint_start else F.lit(0)
    hi = F.least(n, F.coalesce(F.col(hint_end), n)) if hint_end else n
    d = quotes.withColumn("_needle", normalize_for_match(strip_quotes(F.col(quote)))).withColumn("_hay", normalize_for_match(F.col(text)))
    d = d.withColumn("_lo", lo).withColumn("_window", F.substring("_hay", lo + 1, F.greatest(hi - lo, F.lit(0))))
    d = d.withColumn("span", F.when(F.length("_needle") >= LEAST_QUOTE, exact_span(F.col("_needle"), F.col("_window"), F.col("_lo"))))
    open_ = F.col("span").isNull() & (F.length("_needle") >= LEAST_QUOTE)
    done, rest = d.filter(~F.coalesce(open_, F.lit(False))), d.filter(open_)
    if hint_start:
        near = _fuzzy("_needle", "_window")
        rest = rest.withColumn("_near", near).withColumn("span", F.when(F.col("_near.start").isNotNull(), F.struct((F.col("_near.start") + F.col("_lo")).cast("int").alias("start"), (F.col("_near.end") + F.col("_lo")).cast("int").alias("end"), F.col("_near.score").alias("score"), F.col("_near.method").alias("method")))).drop("_near")
        rest = rest.withColumn("span", F.coalesce("span", exact_span(F.col("_needle"), F.col("_hay"), F.lit(0))))
    rest = rest.withColumn("_far", F.when(F.col("span").isNull(), F.col("_hay"))).withColumn("_wide", _fuzzy("_needle", "_far"))
    rest = rest.withColumn("span", F.coalesce("span", F.when(F.col("_wide.start").isNotNull(), F.col("_wide")))).drop("_far", "_wide")
    return done.unionByName(rest).drop("_needle", "_hay", "_lo", "_window")


@F.pandas_udf(ArrayType(SPAN))
def _fuzzy_each(quotes: pd.Series, text: pd.Series) -> pd.Series:
    def one(q: str | None, t: str) -> dict | None:
        found = similar_part(q, t) if q else None
        return None if found is None else {"start": found[0], "end": found[1], "score": round(found[2] / 100, 3), "method": "fuzzy"}

    return pd.Series([None if t is None else [one(q, t) for q in qs] for qs, t in zip(quotes, text, strict=True)], dtype=object)


def locate_each(df: DataFrame, quotes: Column, text: str, name: str = "spans") -> DataFrame:
    """Add an array of spans, one for each quote of an array, as :func:`locate` gives them without hints.

    A text is normalised once for all its quotes, and goes to the Python function once, only where a quote is open that may
    stand in it by similarity.
    """
    def place(hay: Column, needles: Column) -> Column:
        exact = F.transform(needles, lambda n: F.when(F.length(n) >= LEAST_QUOTE, exact_span(n, hay, F.lit(0))))
        size = F.length(hay)
        unmet = F.transform(needles, lambda n: F.when(F.length(n).between(LEAST_FUZZY, size) & ~hay.contains(n), n))
        return once(unmet, lambda u: F.struct(exact.alias("exact"), u.alias("open"), F.when(F.exists(u, lambda n: n.isNotNull()), hay).alias("hay")))

    needles = F.transform(quotes, lambda q: normalize_for_match(strip_quotes(q)))
    d = df.withColumn("_x", once(normalize_for_match(F.col(text)), lambda hay: once(needles, lambda n: place(hay, n))))
    # called nondeterministic, so that no filter or generator above takes a copy of it
    d = d.withColumn("_wide", _fuzzy_each.asNondeterministic()("_x.open", "_x.hay"))
    both = F.when(F.col("_wide").isNull(), F.col("_x.exact")).otherwise(F.zip_with("_x.exact", "_wide", lambda a, b: F.coalesce(a, b)))
    return d.withColumn(name, both).drop("_x", "_wide")


#: characters of a gram; of those of a quote of LONG characters or more, whose grams say more
GRAM, LONG_GRAM, LONG = 3, 4, 40
#: starts of windows that are counted as one; starts of one region; characters of a piece, which are the bits of a word
BLOCK, REGION, PIECE = 8, 512, 64
#: quotes and their characters in one table of grams; characters of texts, and pieces, handled at once
TABLE, TABLE_CHARS, CHARS, LANES = 256, 65_536, 32_768, 4_096


class _Table:
    """Some quotes of similar length: which of them hold a gram, and their pieces for bit-parallel search."""

    def __init__(self, quotes: tuple[str, ...], members: list[int]) -> None:
        self.members, some = members, [quotes[i] for i in members]
        self.sizes = np.array([len(q) for q in some], np.int64)
        g = self.gram = LONG_GRAM if self.sizes[0] >= LONG else GRAM
        at = [_grams(q, g) for q in some]
        self.grams, self.row = np.unique(np.concatenate(at), return_inverse=True)
        self.col = np.repeat(np.arange(len(some)), [len(x) for x in at])
        # over two equal lengths m a similarity of 0.9 leaves 0.1 m deletions and as many insertions at most; a deletion breaks
        # g of the quote's grams, an insertion g - 1
        self.least = self.sizes - g + 1 - (2 * g - 1) * _edits(self.sizes)
        # a clipped window of k characters leaves 0.55 m - 0.45 k deletions and 0.55 k - 0.45 m insertions; k is 0.8 m or more
        self.at_end = 1.8 * (0.55 - 0.1 * g) * self.sizes - g + 1 - 1e-6
        # blocks that hold a window whose start is in the first of them
        self.span = (self.sizes - g + BLOCK - 1) // BLOCK + 1
        # both kinds leave 0.2 m edits at most, hence one of the quote's pieces its share of them at most
        self.edits = np.floor(0.2 * self.sizes + 1e-6).astype(np.int64)
        codes = [_codes(q) for q in some]
        self.letters = np.unique(np.concatenate(codes))
        self.pieces = -(-self.sizes // PIECE)
        self.first = np.cumsum(self.pieces) - self.pieces
        place, size, owner = [], [], []
        for k, m in enumerate(self.sizes.tolist()):
            cuts = [m * x // int(self.pieces[k]) for x in range(int(self.pieces[k]) + 1)]
            place, size, owner = place + cuts[:-1], size + [y - x for x, y in zip(cuts, cuts[1:], strict=False)], owner + [k] * int(self.pieces[k])
        self.place, self.size, self.owner = np.array(place), np.array(size), np.array(owner)
        self.most = self.edits[self.owner] * self.size // self.sizes[self.owner]
        self.letter = [np.searchsorted(self.letters, codes[k][o : o + n]) for o, n, k in zip(place, size, owner, strict=True)]

    def regions(self, codes: np.ndarray, off: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(quote, text, first start, behind the last start, at an end of the text) where enough grams of a quote stand together.
        Texts begin at ``off``, which are multiples of BLOCK."""
        g, width = self.gram, len(self.members)
        holds = np.zeros((len(self.grams) + 1, width), np.uint8)  # the last row is that of grams that no quote has
        holds[self.row, self.col] = 1
        h = _hashed(codes, g)
        at = np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)
        ids = np.full(-(-len(codes) // BLOCK) * BLOCK, len(self.grams))
        ids[: len(h)] = np.where(self.grams[at] == h, at, len(self.grams))
        over = int(self.span.max())
        found: list[tuple[np.ndarray, ...]] = []
        for a in range(0, len(ids) // BLOCK, CHARS // BLOCK):
            rows = holds[ids[a * BLOCK : a * BLOCK + CHARS + over * BLOCK]]
            per = rows.reshape(-1, BLOCK, width).sum(1, dtype=np.uint8)
            run = np.zeros((len(per) + 1, width), np.int32)
            np.cumsum(per, 0, out=run[1:])
            n = min(CHARS // BLOCK, len(per))
            held = run[np.minimum(np.arange(n)[:, None] + self.span, len(per)), np.arange(width)] - run[:n]
            k, b = np.nonzero((held >= self.least).T)
            text = np.searchsorted(off, (a + b) * BLOCK, side="right") - 1
            lo = (a + b) * BLOCK
            hi = np.minimum(lo + BLOCK, off[text] + sizes[text] - self.sizes[k] + 1)
            k, text, lo, hi = (x[hi > lo] for x in (k, text, lo, hi))
            if len(k):  # neighbouring blocks are one region, of REGION starts at most
                new = np.append(True, (np.diff(k) != 0) | (np.diff(text) != 0) | (np.diff(lo) != BLOCK))
                nth = np.arange(len(k)) - np.flatnonzero(new)[np.cumsum(new) - 1]
                head = np.flatnonzero(new | (nth % (REGION // BLOCK) == 0))
                found.append((k[head], text[head], lo[head], hi[np.append(head[1:], len(k)) - 1], np.zeros(len(head), bool)))
            near = slice(max(0, int(np.searchsorted(off, a * BLOCK, side="right")) - 1), int(np.searchsorted(off, (a + n) * BLOCK + over * BLOCK)))
            for tail in (False, True):  # clipped windows lie in the first and in the last m characters
                s = off[near, None] + (sizes[near, None] - self.sizes) * tail
                b = s // BLOCK - a
                t, k = np.nonzero((sizes[near, None] >= self.sizes) & (b >= 0) & (b < n))
                full = held[b[t, k], k] >= self.at_end[k]
                t, k = t[full], k[full]
                found.append((k, t + near.start, s[t, k], s[t, k] + 1, np.ones(len(k), bool)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def confirmed(self, codes: np.ndarray, off: np.ndarray, sizes: np.ndarray, k: np.ndarray, text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether one of the quote's pieces stands in a region with its share of edits or fewer, by Myers' bit vectors: a
        word a piece, a step a character. A replaced letter counts once, so none is lost."""
        masks = np.zeros((len(self.place), len(self.letters) + 1), np.uint64)  # the last letter is one that no quote has
        bits = np.uint64(1) << np.arange(PIECE, dtype=np.uint64)
        for p, letters in enumerate(self.letter):  # a piece ends in the highest bit; what no letter meets below it costs nothing
            np.bitwise_or.at(masks[p], letters, bits[PIECE - len(letters) :])
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        letter = np.where(self.letters[at] == codes, at, len(self.letters))
        flat, row = masks.ravel(), masks.shape[1]
        region = np.repeat(np.arange(len(k)), self.pieces[k])
        piece = np.arange(len(region)) - np.repeat(np.cumsum(self.pieces[k]) - self.pieces[k], self.pieces[k]) + np.repeat(self.first[k], self.pieces[k])
        # the piece lies as far from the window's start as in the quote, but for the edits
        drift = self.edits[k][region] + 1
        begin = np.maximum(off[text][region], lo[region] + self.place[piece] - drift)
        steps = np.minimum((off + sizes)[text][region], hi[region] + self.place[piece] + self.size[piece] + drift) - begin
        hit = np.zeros(len(k), bool)
        letter = np.append(letter, np.full(steps.max(initial=0), len(self.letters)))
        one, last = np.uint64(1), np.uint64(PIECE - 1)
        order = np.argsort(steps, kind="stable")
        for some in (order[x : x + LANES] for x in range(0, len(order), LANES)):
            base, pos = piece[some] * row, begin[some]
            plus, minus = np.full(len(some), ~np.uint64(0)), np.zeros(len(some), np.uint64)
            score = self.size[piece[some]].copy()
            least = score.copy()
            for _ in range(int(steps[some[-1]])):  # what is read behind a lane's end can only add a region
                eq = flat.take(letter.take(pos) + base)
                pos += 1
                xh = eq & plus
                xh += plus
                xh ^= plus
                xh |= eq
                ph = xh | plus
                np.invert(ph, out=ph)
                ph |= minus
                mh = plus & xh
                score += (ph >> last).view(np.int64)
                score -= (mh >> last).view(np.int64)
                np.minimum(least, score, out=least)
                ph <<= one
                mh <<= one
                eq |= minus
                plus = eq | ph
                np.invert(plus, out=plus)
                plus |= mh
                minus = ph & eq
            hit[region[some[least <= self.most[piece[some]]]]] = True
        return hit


class _Quotes:
    """Normalised quotes of one pass: an automaton for exact places, tables of their grams and pieces for similar ones."""

    def __init__(self, quotes: tuple[str, ...]) -> None:
        import ahocorasick

        self.quotes = quotes
        self.exact = ahocorasick.Automaton()
        same: dict[str, list[int]] = {}
        for i, q in enumerate(quotes):
            if len(q) >= LEAST_QUOTE:
                same.setdefault(q, []).append(i)
        for q, owners in same.items():
            self.exact.add_word(q, owners)
        if same:
            self.exact.make_automaton()

    @cached_property
    def tables(self) -> list[_Table]:
        found: list[list[int]] = []
        chars = last = 0
        for i in sorted((i for i, q in enumerate(self.quotes) if len(q) >= LEAST_FUZZY), key=lambda i: len(self.quotes[i])):
            n = len(self.quotes[i])
            if not found or len(found[-1]) == TABLE or chars + n > TABLE_CHARS or last < LONG <= n:
                found, chars = [*found, []], 0
            found[-1].append(i)
            chars, last = chars + n, n
        return [_Table(self.quotes, members) for members in found]

    def exact_places(self, text: str) -> dict[int, int]:
        """First place of each quote that stands in the text."""
        found: dict[int, int] = {}
        if len(self.exact):
            for end, owners in self.exact.iter(text):
                for i in owners:
                    found.setdefault(i, end + 1 - len(self.quotes[i]))
        return found

    def candidates(self, text: str) -> dict[int, np.ndarray]:
        return self.candidates_of([text])[0]

    def candidates_of(self, texts: list[str | None]) -> list[dict[int, np.ndarray]]:
        """For each text the quotes that may be similar to a part of it, with the starts of the windows that may be; none is left
        out that is. Enough of a similar quote's grams stand in a window, or in the clipped one at an end of the text, and one of
        the quote's pieces stands there with few edits."""
        parts = [_codes(t or "") for t in texts]
        sizes = np.array([len(x) for x in parts], np.int64)
        whole = -(-sizes // BLOCK) * BLOCK
        off = np.cumsum(whole) - whole
        codes = np.zeros(int(whole.sum()), np.uint32)
        for x, a in zip(parts, off.tolist(), strict=True):
            codes[a : a + len(x)] = x
        found: list[dict[int, list[np.ndarray]]] = [{} for _ in texts]
        for table in self.tables if len(codes) else ():
            *where, end = table.regions(codes, off, sizes)
            good = np.flatnonzero(table.confirmed(codes, off, sizes, *where))
            for k, t, lo, hi, clipped in zip(*(x[good].tolist() for x in where), end[good].tolist(), strict=True):
                a = int(off[t])
                found[t].setdefault(table.members[k], []).append(np.arange(0) if clipped else np.arange(lo - a, hi - a))
        return [{k: np.unique(np.concatenate(x)) for k, x in some.items()} for some in found]


@lru_cache(maxsize=1)
def _quotes(quotes: tuple[str, ...]) -> _Quotes:
    """Kept for the next task of a Python worker."""
    return _Quotes(quotes)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashed(codes: np.ndarray, n: int) -> np.ndarray:
    """A number for every n characters in a row; of three, different ones never share a number, of more they seldom do."""
    c = codes.astype(np.int64)
    if len(c) < n:
        return np.zeros(0, np.int64)
    g = (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
    for k in range(GRAM, n):
        g = g[: len(c) - k] * 0x5851F42D4C957F2D + c[k:]
    return g


def _grams(text: str, n: int = GRAM) -> np.ndarray:
    return _hashed(_codes(text), n)


def locate_in_corpus(
    quotes: DataFrame, docs: DataFrame, quote_id: str = "item_id", quote: str = "text", doc_id: str = "doc_id", text: str = "text", similar: bool = False, chars: int = 4_000_000
) -> DataFrame:
    """(quote id, doc id, char_start, char_end, score, method): where each quote stands in each text, its first exact place;
    with ``similar``, else the part most like it (FUZZY_SCORE or more, quotes of LEAST_FUZZY characters or more).

    Texts are neither exploded nor shuffled: quotes of at most ``chars`` characters together travel to them, more quotes
    in several passes. Exact places come from one automaton; similar ones from a count of shared grams a window, below which no
    similarity of FUZZY_SCORE is possible, then from a search for pieces with few edits, and only what passes is aligned. Null
    quotes or texts, and quotes under LEAST_QUOTE characters, are nowhere.
    """
    q = quotes.select(F.col(quote_id).alias("_qid"), normalize_for_match(strip_quotes(F.col(quote))).alias("_q")).filter(F.length("_q") >= LEAST_QUOTE)
    d = docs.select(F.col(doc_id).alias("_did"), normalize_for_match(F.col(text)).alias("_t"))
    kinds = [x.simpleString() for x in (q.schema["_qid"].dataType, d.schema["_did"].dataType)]
    schema = f"_qid {kinds[0]}, _did {kinds[1]}, char_start long, char_end long, score double, method string"
    passes = max(1, -(-(q.agg(F.sum(F.length("_q"))).first()[0] or 0) // chars))

    def scan(some: DataFrame):  # noqa: ANN202
        held = some.toArrow()
        ids, needles = held.column("_qid").combine_chunks(), tuple(held.column("_q").to_pylist())

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            index = _quotes(needles)
            for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
                rows, found = [], []
                texts = batch.column(1).to_pylist()
                for i, (t, near) in enumerate(zip(texts, index.candidates_of(texts) if similar else repeat({}), strict=False)):
                    places = index.exact_places(t) if t else {}
                    got = [(k, at, at + len(needles[k]), 1.0, "exact") for k, at in places.items()]
                    for k, starts in near.items():
                        part = similar_part(needles[k], t, starts) if k not in places else None
                        if part:
                            got.append((k, part[0], part[1], round(part[2] / 100, 3), "fuzzy"))
                    rows += [i] * len(got)
                    found += got
                k, *cols = list(zip(*found, strict=True)) or [()] * 5
                types = (pa.int64(), pa.int64(), pa.float64(), pa.string())
                made = [pa.array(list(c), t) for c, t in zip(cols, types, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(list(k), pa.int64())), batch.column(0).take(pa.array(rows, pa.int64())), *made], ["_qid", "_did", "char_start", "char_end", "score", "method"])

        return run

    found = [d.mapInArrow(scan(q.filter(F.pmod(F.xxhash64("_q"), F.lit(passes)) == k)), schema) for k in range(passes)]
    return reduce(DataFrame.unionByName, found).withColumnsRenamed({"_qid": quote_id, "_did": doc_id})


def judge_in_unit(located: DataFrame, start: str = "unit_start", end: str = "unit_end") -> DataFrame:
    """Located quotes with verify_result and match_score: a span outside its unit proves nothing about it and fails, with
    the score it had; no span fails with score 0. char_start and char_end are null for failed ones."""
    inside = F.coalesce((F.col("span.start") >= F.col(start)) & (F.col("span.end") <= F.col(end)), F.lit(False))
    return located.withColumns({
        "verify_result": F.when(inside, F.col("span.method")).otherwise("failed"), "match_score": F.coalesce("span.score", F.lit(0.0)),
        "char_start": F.when(inside, F.col("span.start")), "char_end": F.when(inside, F.col("span.end")),
    })


def keep_first_reports(findings: DataFrame, *keys: str) -> DataFrame:
    """Verified findings without those that report again, in the same or a later round, a problem already kept: same
    risk_type and an overlapping span. A unit has a few rounds of a few findings, so its rows are folded in one array.

    findings: the keys, attempt_no, item_no, risk_type, char_start, char_end, verify_result; failed ones are no verified ones.
    """
    fields = ["attempt_no", "item_no", "risk_type", "char_start", "char_end", "verify_result"]
    good = findings.filter("coalesce(verify_result, 'failed') != 'failed'")
    rows = good.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_all"))
    same = lambda a, b: (a["risk_type"] == b["risk_type"]) & (a["char_start"] < b["char_end"]) & (b["char_start"] < a["char_end"])
    fold = F.aggregate("_all", F.slice("_all", 1, 0), lambda kept, f: F.when(F.exists(kept, lambda k: F.coalesce(same(k, f), F.lit(False))), kept).otherwise(F.concat(kept, F.array(f))))
    return rows.select(*keys, F.explode(fold).alias("_f")).select(*keys, "_f.*")


def merge_findings(rules: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """Rule findings and those model findings that no rule finding covers, with ``position`` per key: by severity, then place."""
    from pyspark.sql import Window

    from inkspan.operators.listing import severity_order
    from inkspan.operators.spans import drop_duplicates_of

    both = rules.unionByName(drop_duplicates_of(model, rules, key))
    return both.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(*severity_order(), F.col("finding_id"))))
