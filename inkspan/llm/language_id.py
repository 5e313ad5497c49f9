"""Language identification of mixed-language text.

Per word: the scripts of its letters narrow the languages, hashed character trigrams score those left. Per text: Viterbi
over the words with a penalty for each switch labels spans. The model is a table of fixed size, trained from labelled
texts in one aggregation; prediction is one map step.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import Memo, fields, small_batches, tidy

BUCKETS = 1 << 15
PENALTY = 18.0  # nats a switch costs
MOST = 3.0  # nats one word can speak against a language
UNDETERMINED = "und"
#: first code point of each script range (fixed values); what lies between stays with the range before
SCRIPTS = [
    (0x0000, "latin"),
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "armenian"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0900, "indic"),
    (0x0E00, "thai"),
    (0x1000, "other"),
    (0x10A0, "georgian"),
    (0x1100, "hangul"),
    (0x1200, "other"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2000, "other"),
    (0x3040, "kana"),
    (0x3100, "han"),
    (0x3130, "hangul"),
    (0x3190, "han"),
    (0xA000, "other"),
    (0xAC00, "hangul"),
    (0xD7B0, "other"),
    (0xF900, "han"),
    (0xFB00, "latin"),
    (0xFB13, "armenian"),
    (0xFB1D, "hebrew"),
    (0xFB50, "arabic"),
    (0xFE00, "other"),
    (0xFF21, "latin"),
    (0xFF66, "kana"),
    (0xFFA0, "hangul"),
    (0x10000, "other"),
    (0x20000, "han"),
]
_STARTS = [a for a, _ in SCRIPTS]


def script_of(char: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(char)) - 1][1]


_WORDLIKE = re.compile(r"[^\W\d_]+")


def letters_of(word: str) -> str:
    """Lower-cased runs of letters (Unicode category L), one space between them."""
    runs = " ".join(_WORDLIKE.findall(word.lower()))
    # the pattern also takes fractions, superscripts and the like
    return runs if runs.replace(" ", "").isalpha() else " ".join("".join([c if c.isalpha() else " " for c in runs]).split())


def trigrams(letters: str, known: Memo) -> list[int]:
    padded = f" {letters} "
    return [known[padded[i : i + 3]] for i in range(len(padded) - 2)]


def trigram_memo() -> Memo:
    return Memo(lambda g: xxhash.xxh32_intdigest(g) % BUCKETS, 100_000)


def held_out(id_: Column) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % 4 == 2


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray, scripts: dict[str, np.ndarray]) -> None:
        """counts: trigrams per language and bucket; scripts: letters per script and language."""
        self.languages = languages
        if languages:
            smooth = counts + 0.5
            self.log_p = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32)
            total = sum(scripts.values())
            #: languages that write at least a hundredth of their letters in the script
            self.writes = {s: n >= np.maximum(total * 0.01, 1) for s, n in scripts.items()}

    def score_words(self, words: list[str], known: Memo) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per word: log score of each language, 0 for the best and -MOST at least; letters; letters that fit a language.

        Scores are 0 without a letter of a script that some language writes. A word fits where its trigrams are likelier
        in its best language than if all buckets were alike.
        """
        n = len(self.languages)
        scores, counts = np.zeros((len(words), n), np.float32), np.zeros(len(words), np.float32)
        fitting = np.zeros(len(words), np.float32)
        flat, starts, at, narrowed = [], [], [], {}
        for k, word in enumerate(words):
            letters = letters_of(word)
            if not letters:
                continue
            counts[k] = len(letters) - letters.count(" ")
            scripts = ("latin",) if max(letters) < "\u0370" else tuple(sorted({script_of(c) for c in letters if c != " "}))
            if scripts not in narrowed:
                narrowed[scripts] = np.any([self.writes.get(s, np.zeros(n, bool)) for s in scripts], axis=0)
            if narrowed[scripts].any():
                at.append((k, scripts))
                starts.append(len(flat))
                flat.extend(trigrams(letters, known))
        if at:
            sums = np.add.reduceat(self.log_p[np.array(flat)], np.array(starts), axis=0)
            for scripts, some in narrowed.items():
                if some.any() and not some.all():
                    sums[np.ix_([i for i, (_, s) in enumerate(at) if s == scripts], ~some)] = -np.inf
            rows, best = [k for k, _ in at], sums.max(axis=1, keepdims=True)
            scores[rows] = np.maximum(sums - best, -MOST)
            sizes = np.diff([*starts, len(flat)])
            fitting[rows] = np.where(best[:, 0] > -sizes * math.log(BUCKETS), counts[rows], 0)
        return scores, counts, fitting


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_documents: int = 5_000) -> Model:
    """Model of the non-null languages, of each from about ``max_documents`` labelled texts at most (by hash of their id).

    Rows with null id, text or language teach nothing. Counts are aggregated per language and bucket, so what reaches
    the driver has a fixed size per language.
    """
    d = fields(docs, id=id_col, text=text_col, lang=lang_col).filter("id is not null and text is not null and lang is not null")
    sizes = d.groupBy("lang").agg(F.count("*").alias("n_lang"))
    d = d.join(F.broadcast(sizes), "lang").filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) * F.col("n_lang") < F.lit(max_documents << 30)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, Counter] = {}
        known = trigram_memo()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = grams.setdefault(lang, np.zeros(BUCKETS, np.int64))
                s = scripts.setdefault(lang, Counter())
                words = [letters_of(w) for w in text.split()]
                flat = [g for w in words if w for g in trigrams(w, known)]
                n += np.bincount(np.array(flat, np.int64), minlength=BUCKETS)
                for c, times in Counter("".join(words)).items():
                    if c != " ":
                        s[script_of(c)] += times
        for lang, n in grams.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "bucket": pa.array(at, pa.int32()), "script": pa.array([None] * len(at), pa.string()), "n": n[at]})
            s = scripts[lang]
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(s), "bucket": pa.array([-1] * len(s), pa.int32()), "script": pa.array(list(s), pa.string()), "n": pa.array(list(s.values()), pa.int64())})

    counts = d.mapInArrow(tidy(count), "lang string, bucket int, script string, n long").groupBy("lang", "bucket", "script").agg(F.sum("n").alias("n"))
    with small_batches(docs.sparkSession):
        rows = counts.collect()
    languages = sorted({r["lang"] for r in rows})
    place = {x: i for i, x in enumerate(languages)}
    counts, scripts = np.zeros((len(languages), BUCKETS)), {}
    for r in rows:
        if r["bucket"] >= 0:
            counts[place[r["lang"]], r["bucket"]] = r["n"]
        else:
            scripts.setdefault(r["script"], np.zeros(len(languages)))[place[r["lang"]]] = r["n"]
    return Model(languages, counts, scripts)


def viterbi(scores: np.ndarray, penalty: float = PENALTY) -> list[tuple[int, int, int]]:
    """(first word, end, language) spans of the best path. scores: words x languages."""
    total = scores.sum(axis=0)
    best = int(total.argmax())
    # no other language gains more over any run of words than half a switch costs: one span
    gain = np.cumsum(scores - scores[:, best : best + 1], axis=0)
    low = np.minimum.accumulate(np.vstack([np.zeros((1, scores.shape[1])), gain[:-1]]), axis=0)
    if (gain - low).max() <= penalty / 2:
        return [(0, len(scores), best)]
    n, back, value = scores.shape[1], [], [0.0] * scores.shape[1]
    for row in scores.tolist():
        top = max(range(n), key=value.__getitem__)
        limit = value[top] - penalty
        back.append([i if value[i] >= limit else top for i in range(n)])
        value = [max(value[i], limit) + row[i] for i in range(n)]
    at = max(range(n), key=value.__getitem__)
    spans, end = [], len(scores)
    for t in range(len(scores) - 1, -1, -1):
        before = back[t][at]
        if before != at or t == 0:
            spans.append((t, end, at))
            end, at = t, before
    return spans[::-1]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), words_kept: int = 100_000) -> DataFrame:
    """One row per row: id, lang_pred, score, spans (language and words of each), and the ``carry`` columns.

    lang_pred is the language with the most letters in the labelled spans, score its share of all letters, where only
    words that fit a language count for it. Null texts, texts without a letter, texts of which no word fits (scripts that
    were not learned, junk) and models without a language give 'und', 0.0 and no spans. Rows are predicted one by one,
    so repeated rows get equal results; only the text is looked at.
    """
    n = len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known, grams = np.zeros((words_kept, n + 2), np.float32), {}, trigram_memo()
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            langs, sure, spans = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = text.split() if text and n else []
                new = list(set(words).difference(known))
                if len(known) + len(new) > words_kept:
                    known.clear()
                    new = list(set(words))
                    if len(new) > len(table):
                        table = np.zeros((len(new), n + 2), np.float32)
                if new:
                    first = len(known)
                    known.update(zip(new, range(first, first + len(new)), strict=True))
                    some = slice(first, first + len(new))
                    table[some, :n], table[some, n], table[some, n + 1] = model.score_words([w.decode() for w in new], grams)
                at = np.array([known[w] for w in words], np.int64)
                rows = table[at]
                if not len(rows) or not rows[:, n + 1].any():
                    langs.append(UNDETERMINED)
                    sure.append(0.0)
                    spans.append([])
                    continue
                path = viterbi(rows[:, :n].astype(np.float64))
                share = np.zeros(n)
                for a, b, lang in path:
                    share[lang] += rows[a:b, n + 1].sum(dtype=np.float64)
                top = int(share.argmax())
                langs.append(model.languages[top])
                sure.append(float(share[top] / rows[:, n].sum(dtype=np.float64)))
                spans.append([{"first": a, "end": b, "lang": model.languages[x]} for a, b, x in path])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
            rest = [batch.column(i) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(sure, pa.float64()), pa.array(spans, kind), *rest], ["id", "lang_pred", "score", "spans", *[f"c{i}" for i in range(len(rest))]])

    d = fields(docs, id=id_col, text=text_col, **{f"c{i}": c for i, c in enumerate(carry)})
    kinds = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    schema = f"id {kinds['id']}, lang_pred string, score double, spans array<struct<first: int, end: int, lang: string>>" + "".join(f", c{i} {kinds[f'c{i}']}" for i in range(len(carry)))
    out = d.mapInArrow(tidy(run), schema)
    return out.select(F.col("id").alias(id_col), "lang_pred", "score", "spans", *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])


def predict_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_documents: int = 5_000) -> DataFrame:
    """(id, held_out, lang_pred, score, spans): learned from rows that are not held out, predicted for all."""
    seen = docs.filter(~F.coalesce(held_out(F.col(f"`{id_col}`")), F.lit(False)))
    out = identify(docs, fit(seen, id_col, text_col, lang_col, max_documents), id_col, text_col)
    return out.select(id_col, F.coalesce(held_out(F.col(f"`{id_col}`")), F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")
