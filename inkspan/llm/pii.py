"""Personal data: exact base spans, and further spans found by weak supervision.

Candidates (the base spans and looser forms of the same kinds) get votes from regex, gazetteer and context labelers.
Expectation-maximisation over the counts of vote patterns, taken over all documents, estimates each labeler's
reliability; a logistic span classifier is trained on the posteriors. What travels to the driver is one row per
distinct pattern of votes and features, a number bounded by their definition, not by the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import fields, small_batches, tidy

ACCEPT = 0.9  # least probability of an added span
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match of an unanchored digit pattern begins where a run of digits begins, so possessive runs stay linear
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# looser forms, candidates only
_LOOSE = (
    (
        EMAIL,
        re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s?(?:\(at\)|\[at\])\s?[A-Za-z0-9-]++(?:\s?(?:\.|\(dot\)|\[dot\])\s?[A-Za-z0-9-]++)+", re.I),
        re.compile(r"[(\[]at[)\]]", re.I),
    ),
    # look-alikes that fail the exact rule: what the votes must tell from personal data
    (CARD, re.compile(r"(?<![0-9A-Za-z.+-])[0-9](?:[ -]?[0-9]){12,18}+(?![0-9A-Za-z-])"), re.compile(r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]")),
    (IP, re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,4}+(?:\.[0-9]{1,4}+){3}(?![0-9A-Za-z]|\.[0-9])"), re.compile(r"[0-9]\.[0-9]")),
    (IP, re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"), re.compile(r":[0-9A-Fa-f]{1,4}:")),
    (PHONE, re.compile(r"(?<![0-9A-Za-z+.-])(?:00[1-9][0-9]{0,2}[ .-])?(?:\([0-9]{2,4}\)[ ]?|[0-9]{3,4}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])"), re.compile(r"[0-9]{3}[ .-][0-9]{4}")),
)
# fixed values: words that announce each kind within 40 characters before it
_CUES = (
    re.compile(r"\b(?:e-?mail|mail|contact|write|courriel|correo|kontakt|schreib\w*)\b", re.I),
    re.compile(r"\b(?:ip|host|server|address|client|adresse|servidor|serveur)\b", re.I),
    re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|karte|kreditkarte|tarjeta|carte|payment)\b", re.I),
    re.compile(r"\b(?:phone|tel|telephone|call|fax|mobile|cell|whatsapp|telefon|handy|tel[eé]fono|t[eé]l[eé]phone|m[oó]vil|appel\w*)\b", re.I),
)
_AGAINST = re.compile(r"(?:\b(?:version|build|isbn|issn|order|invoice|serial|sku|part|page|id|no|nr|chapter|section|token|hash|key)\b(?:\s+(?:number|no|nr|nummer|n[uú]mero|num[eé]ro|id)\b)?|[#$€£%=v])[\s:.\"']*$", re.I)
_DOMAINS = frozenset("com org net edu gov io info de fr es it uk eu us ca au ch at nl be".split())
_ISSUERS = re.compile(r"3[47]|4|5[1-5]|2[2-7]|6(?:011|5|4[4-9])|35")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the exact rules, by kind and then start; code points, end exclusive."""
    out = []
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((EMAIL, start, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for p in (g.lstrip("0") or "0" for g in m.groups())):
                out.append((IP, *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((CARD, *m.span()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((PHONE, *m.span()))
    return out


def votes(text: str, kind: int, start: int, end: int, exact: bool) -> tuple[int, ...]:
    """Each labeler's vote: 1 personal, -1 not, 0 abstains. Regex, gazetteer, cue, counter-cue, neighbours, shape."""
    span, before = text[start:end], text[max(0, start - 40) : start]
    digits = "".join(c for c in span if "0" <= c <= "9")
    if kind == EMAIL:
        named = 1 if span.rstrip(".").rsplit(".", 1)[-1].strip(" )]").lower() in _DOMAINS else 0
        shape = 1 if 6 <= len(span) <= 80 and span[0].isalnum() else -1
    elif kind == IP:
        named = -1 if span.startswith(("0.", "127.", "255.")) else 0
        shape = 1 if 7 <= len(span) <= 39 else -1
    elif kind == CARD:
        named = 1 if exact and _ISSUERS.match(digits) else -1
        shape = 1 if exact and len(digits) in (13, 14, 15, 16, 19) and len(set(digits)) > 3 else -1
    else:
        named = 1 if digits[-7:-4] == "555" or span.startswith(("+", "00")) else 0
        shape = 1 if 10 <= len(digits) <= 13 and len(set(digits)) > 2 else -1
    glued = (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    fails = not exact and (kind == CARD or (kind == IP and ":" not in span))
    return (1 if exact else -1 if fails else 0, named, 1 if _CUES[kind].search(before) else 0, -1 if _AGAINST.search(before) else 0, -1 if glued else 1, shape)


def features(kind: int, vote: tuple[int, ...]) -> list[float]:
    """The classifier's view of a span: its kind, and each labeler's votes for and against."""
    return [1.0, *[float(kind == k) for k in range(4)], *[float(v > 0) for v in vote], *[float(v < 0) for v in vote]]


def candidates(text: str) -> list[tuple[int, int, int, bool, tuple[int, ...]]]:
    """(kind, start, end, is base, votes): the base spans, then looser ones that do not overlap them or each other."""
    base = base_spans(text)
    out = [(k, s, e, True, votes(text, k, s, e, True)) for k, s, e in base]
    taken = [(s, e) for _, s, e in base]
    for kind, pattern, sign in _LOOSE:
        if sign.search(text):
            for m in pattern.finditer(text):
                s, e = m.span()
                if all(e <= a or s >= b for a, b in taken):
                    taken.append((s, e))
                    out.append((kind, s, e, False, votes(text, kind, s, e, False)))
    return out


def code_of(kind: int, vote: tuple[int, ...]) -> int:
    code = kind
    for v in vote:
        code = code * 3 + v + 1
    return code


def _votes_of(code: int) -> tuple[int, tuple[int, ...]]:
    vote = []
    for _ in range(6):
        code, v = divmod(code, 3)
        vote.append(v - 1)
    return code, tuple(reversed(vote))


def estimate(patterns: dict[int, int], rounds: int = 50) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of each pattern being personal, by expectation-maximisation with one table of vote probabilities per
    labeler and class; and those tables (class, labeler, vote + 1)."""
    codes = sorted(patterns)
    v = np.array([_votes_of(c)[1] for c in codes]) + 1
    n = np.array([patterns[c] for c in codes], float)
    post = 1 / (1 + np.exp(-(v - 1).sum(axis=1)))  # starts from the majority
    tables = np.full((2, 6, 3), 1 / 3)
    for _ in range(rounds):
        prior = (post * n).sum() / n.sum()
        for k, weight in enumerate(((1 - post) * n, post * n)):
            for j in range(6):
                got = np.bincount(v[:, j], weights=weight, minlength=3) + np.array(([1.5, 1.0, 0.5], [0.5, 1.0, 1.5])[k])
                tables[k, j] = got / got.sum()
        logit = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
        for j in range(6):
            logit = logit + np.log(tables[1, j, v[:, j]] / tables[0, j, v[:, j]])
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return dict(zip(codes, post.tolist(), strict=True)), tables


def train(patterns: dict[int, int], steps: int = 30) -> frozenset[int]:
    """Codes that the final classifier (ridge logistic regression on the posteriors) finds personal."""
    if not patterns:
        return frozenset()
    post, _ = estimate(patterns)
    codes = sorted(patterns)
    x = np.array([features(*_votes_of(c)) for c in codes])
    y, n = np.array([post[c] for c in codes]), np.array([patterns[c] for c in codes], float)
    w = np.zeros(x.shape[1])
    for _ in range(steps):  # Newton
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + w
        w -= np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), gradient)
    sure = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return frozenset(c for c, p in zip(codes, sure, strict=True) if p >= ACCEPT)


def fit(docs: DataFrame, text_col: str = "text") -> frozenset[int]:
    """Accepted patterns, from the candidates of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for kind, _, _, _, vote in candidates(text):
                    code = code_of(kind, vote)
                    found[code] = found.get(code, 0) + 1
        yield pa.RecordBatch.from_pydict({"code": pa.array(list(found), pa.int64()), "n": pa.array(list(found.values()), pa.int64())})

    texts = fields(docs, text=text_col).filter("text is not null")
    counts = texts.mapInArrow(tidy(count), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    with small_batches(docs.sparkSession):
        rows = counts.collect()  # at most 4 * 3**6 rows
    return train({r["code"]: r["n"] for r in rows})


SPAN = "array<struct<kind: int, start: int, end: int>>"


def find_spans(docs: DataFrame, accepted: frozenset[int], id_col: str = "doc_id", text_col: str = "text", mask: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row: id, base and added spans (arrays of kind, start, end), the text (masked if asked), and ``carry``.

    Null texts count as empty: no spans; they stay null. mask replaces each span by its kind in brackets. Rows are read
    one by one, so ids may repeat or be null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            base, added, texts = [], [], []
            for text in batch.column(1).to_pylist():
                found = candidates(text) if text else []
                b = [x[:3] for x in found if x[3]]
                a = [x[:3] for x in found if not x[3] and code_of(x[0], x[4]) in accepted]
                base.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in b])
                added.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in a])
                if mask:
                    texts.append(masked(text, b + a) if b or a else text)
            text = pa.array(texts, pa.string()) if mask else batch.column(1)
            rest = [batch.column(i) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind_of), pa.array(added, kind_of), text, *rest], ["id", "base", "added", "text", *[f"c{i}" for i in range(len(rest))]])

    d = fields(docs, id=id_col, text=text_col, **{f"c{i}": c for i, c in enumerate(carry)})
    kinds = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    out = d.mapInArrow(tidy(run), f"id {kinds['id']}, base {SPAN}, added {SPAN}, text string" + "".join(f", c{i} {kinds[f'c{i}']}" for i in range(len(carry))))
    return out.select(F.col("id").alias(id_col), "base", "added", F.col("text").alias(text_col), *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def told(spans: Column) -> Column:
    """kind:start:end, by kind as listed and then start, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every document; counts are of base spans."""
    found = find_spans(docs, fit(docs, text_col), id_col, text_col)
    counts = [count_of(F.col("base"), k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(id_col, *counts, F.sha2(told(F.col("base")).cast("binary"), 256).alias("base_sha256"), told(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
