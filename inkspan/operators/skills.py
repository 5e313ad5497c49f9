"""Skill dictionary: loading, lookup and tagging with offsets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.operators.spans import section_at

SHORT = 2  # ASCII words up to this length count only in their exact case
SPELLINGS = 200_000  # of one automaton


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(id, canonical_name, category, aliases) of a CSV with pipe-separated aliases; ids follow the order of files and lines."""
    from inkspan.operators.ranking import with_position

    raw = spark.read.option("header", True).csv(path).withColumn("_line", F.monotonically_increasing_id())
    d = with_position(raw, "_line", name="id")
    aliases = F.filter(F.transform(F.split(F.coalesce("aliases", F.lit("")), "\\|"), lambda a: F.trim(a)), lambda a: (a != "") & (F.lower(a) != F.lower("canonical_name")))
    return d.select("id", F.trim("canonical_name").alias("canonical_name"), "category", F.array_distinct(aliases).alias("aliases"))


def words(dictionary: DataFrame) -> DataFrame:
    """(word, exact, id): every spelling once, owned by the skill with the smallest id."""
    d = dictionary.select("id", F.explode(F.concat(F.array("canonical_name"), "aliases")).alias("word")).withColumn("word", F.trim("word")).filter("word != ''")
    d = d.withColumn("exact", (F.length("word") <= SHORT) & F.col("word").rlike("^[\\x00-\\x7f]*$"))
    return d.withColumn("word", F.when(F.col("exact"), F.col("word")).otherwise(F.lower("word"))).groupBy("word", "exact").agg(F.min("id").alias("id"))


def conflicts(dictionary: DataFrame) -> DataFrame:
    """Spellings that more than one skill claims."""
    d = dictionary.select("id", F.lower(F.explode(F.concat(F.array("canonical_name"), "aliases"))).alias("word"))
    return d.groupBy("word").agg(F.count_distinct("id").alias("owners")).filter("owners > 1")


def lookup(names: DataFrame, dictionary: DataFrame, name: str = "name") -> DataFrame:
    """Add skill_id: short ASCII spellings in exact case first, the others case-folded."""
    w = words(dictionary)
    exact = w.filter("exact").select(F.col("word").alias("_e"), F.col("id").alias("_eid"))
    folded = w.filter("NOT exact").select(F.col("word").alias("_f"), F.col("id").alias("_fid"))
    # no hint: each join is broadcast only where the session's size limit allows it
    d = names.join(exact, F.trim(name) == F.col("_e"), "left").join(folded, F.lower(F.trim(name)) == F.col("_f"), "left")
    return d.withColumn("skill_id", F.coalesce("_eid", "_fid")).drop("_e", "_eid", "_f", "_fid")


Entry = tuple[str, bool, int]  # word, exact, skill
ROWS, HITS = 200, 100_000  # texts scanned and mentions written at once


def folded(text: str) -> str:
    """Lower case, character by character, so that offsets stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


_APART = "\x01"  # stands between texts that are scanned together; no spelling holds it


def _bordered(text: str) -> tuple[str, np.ndarray]:
    """The text, lower-cased, with U+0000 on both sides of every run of ASCII letters and digits, so that a spelling that
    begins or ends with one cannot be found inside a longer run; and for each place in it the characters of the text before it."""
    codes = np.frombuffer(folded(text).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = ((codes >= 48) & (codes <= 57)) | ((codes >= 65) & (codes <= 90)) | ((codes >= 97) & (codes <= 122))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    made = np.insert(np.where(codes == 0, 32, codes).astype(np.uint32), edges, 0)
    return made.tobytes().decode("utf-32-le", "surrogatepass"), np.concatenate([[0], np.cumsum(made != 0)])


@lru_cache(maxsize=4)
def _automaton(entries: tuple[Entry, ...]):  # noqa: ANN202
    """The automaton over all spellings in lower case; per word its length and its owners: (exact word or "", skill)."""
    import ahocorasick

    owners: dict[str, list[tuple[str, int]]] = {}
    for word, exact, skill in entries:
        if word and _APART not in word:
            owners.setdefault(_bordered(word)[0], []).append((word if exact else "", skill))
    automaton = ahocorasick.Automaton()
    for k, word in enumerate(owners):
        automaton.add_word(word, k)
    if owners:
        automaton.make_automaton()
    # the owner of the case-folded spelling, -1 if there is none; words with exact owners are few
    plain = np.array([next((s for w, s in o if not w), -1) for o in owners.values()], np.int64)
    exact = {k: {w: s for w, s in o if w} for k, o in enumerate(owners.values()) if any(w for w, _ in o)}
    return automaton, np.array([len(w) for w in owners], np.int64), plain, exact


@lru_cache(maxsize=4)
def _automata(dealt: tuple[tuple[Entry, ...], ...]) -> list:
    return [_automaton.__wrapped__(entries) for entries in dealt]


def hits(text: str, entries: tuple[Entry, ...]) -> np.ndarray:
    """Rows of start, end, skill, exact: every occurrence of every spelling."""
    return _met(text, *_bordered(text), *_automaton(entries))


def _met(text: str, bordered: str, before: np.ndarray, automaton, sizes: np.ndarray, plain: np.ndarray, exact: dict) -> np.ndarray:  # noqa: ANN001
    got = list(automaton.iter(bordered)) if len(sizes) else []
    if not got:
        return np.zeros((0, 4), np.int64)
    last, k = np.array(got, np.int64).T
    start, end = before[last + 1 - sizes[k]], before[last + 1]
    found = [np.stack([start, end, plain[k], np.zeros_like(k)], axis=1)[plain[k] >= 0]]
    if exact:
        at = np.flatnonzero(np.isin(k, np.fromiter(exact, np.int64)))
        owned = [(s, e, exact[w].get(text[s:e], -1), 1) for s, e, w in zip(start[at].tolist(), end[at].tolist(), k[at].tolist(), strict=True)]
        owned = np.array(owned, np.int64).reshape(-1, 4)
        found.append(owned[owned[:, 2] >= 0])
    return np.concatenate(found)


def _free(found: np.ndarray) -> np.ndarray:
    """Leftmost first, longer ones first, no overlaps."""
    found = found[np.lexsort((-found[:, 1], found[:, 0]))]
    kept, end = [], 0
    for i, (s, e) in enumerate(zip(found[:, 0].tolist(), found[:, 1].tolist(), strict=True)):
        if s >= end:
            kept.append(i)
            end = e
    return found[kept]


def longest_first(found: np.ndarray) -> np.ndarray:
    """The hits that count: first among the case-folded and among the exact spellings each for themselves, then among
    what both leave."""
    exact = found[:, 3] == 1
    return _free(np.concatenate([_free(found[~exact]), _free(found[exact])]))


def find(text: str, entries: tuple[Entry, ...]) -> list[tuple[int, int, int]]:
    """(skill_id, start, end) of every mention, in order."""
    return [(skill, s, e) for s, e, skill, _ in longest_first(hits(text, entries)).tolist()]


def _scanned(texts: list[str | None], dealt: tuple[tuple[Entry, ...], ...], whole: bool) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(which text, surface, rows of hits with places in their own text) of many texts at once."""
    texts = [(t or "").replace(_APART, " ") for t in texts]
    together = _APART.join(texts)
    ready = _bordered(together)  # once for all automata
    h = np.concatenate([_met(together, *ready, *built) for built in _automata(dealt)])
    h = longest_first(h) if whole else h
    starts = np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1]
    row = np.searchsorted(starts, h[:, 0], "right") - 1
    surface = [together[s:e] for s, e in zip(h[:, 0].tolist(), h[:, 1].tolist(), strict=True)]
    h[:, :2] -= starts[row][:, None]
    return row, surface, h


def _group(ids) -> np.ndarray:  # noqa: ANN001
    """The number of each value's run in an Arrow array of sorted ids."""
    import pyarrow.compute as pc

    here, before = ids.slice(1), ids.slice(0, max(len(ids) - 1, 0))
    changed = pc.not_equal(here, before).fill_null(False).to_numpy(zero_copy_only=False)
    changed = changed | pc.xor(pc.is_valid(here), pc.is_valid(before)).to_numpy(zero_copy_only=False)  # nulls are one document
    return np.concatenate([[0], np.cumsum(changed)])[: len(ids)]


def tag(docs: DataFrame, dictionary: DataFrame, id_col: str = "resume_id", text_col: str = "full_text", spellings: int = SPELLINGS, at_once: int = SPELLINGS) -> DataFrame:
    """(id, skill_id, surface, char_start, char_end) of every mention; ids must be unique. Null text has none.

    Texts stay where they are: an Aho-Corasick automaton over the spellings travels to them. At most ``spellings`` of
    them, of at most that many times 64 characters, make one automaton; a larger dictionary is dealt into several. Automata
    of ``at_once`` spellings together run over a text in one pass, which decides there what overlaps; where more passes are
    needed, the hits of a document meet once more for that.
    """
    w = words(dictionary)
    size = w.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("chars")).first()
    shards = max(1, -(-size["n"] // spellings), -(-size["chars"] // (64 * spellings)))
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {d.schema['id'].dataType.simpleString()}, skill_id long, surface string, char_start int, char_end int"

    def scan(dealt: tuple[tuple[Entry, ...], ...], whole: bool):  # noqa: ANN202
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
                row, surface, h = _scanned(batch.column(1).to_pylist(), dealt, whole)
                names = ["id", "skill_id", "surface", "char_start", "char_end", "exact"][: 5 if whole else 6]
                for at in range(0, len(h), HITS):
                    some = h[at : at + HITS]
                    made = [batch.column(0).take(pa.array(row[at : at + HITS])), pa.array(some[:, 2]), pa.array(surface[at : at + HITS], pa.string()), pa.array(some[:, 0].astype(np.int32)), pa.array(some[:, 1].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(made if whole else [*made, pa.array(some[:, 3] == 1)], names)

        return run

    def resolved(batches: Iterator) -> Iterator:
        """Hits sorted by document: many documents are decided at once, the last one when the next begins."""
        import pyarrow as pa

        def kept(t):  # noqa: ANN001, ANN202
            ids = t.column("id").combine_chunks()
            c = [t.column(n).to_numpy().astype(np.int64) for n in ("char_start", "char_end", "skill_id", "exact")]
            apart = _group(ids) * (1 << 32)  # documents stand behind each other
            at = longest_first(np.stack([c[0] + apart, c[1] + apart, c[2], c[3], np.arange(len(apart))], axis=1))[:, 4]
            return t.take(pa.array(at)).select(["id", "skill_id", "surface", "char_start", "char_end"]).combine_chunks().to_batches()

        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = np.flatnonzero(np.diff(_group(batch.column(0))))
            if len(last) or (held and held[-1].column(0)[-1] != batch.column(0)[0]):
                cut = int(last[-1]) + 1 if len(last) else 0
                yield from kept(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, batch = [], batch.slice(cut)
            held.append(batch)
        if held:
            yield from kept(pa.Table.from_batches(held))

    passes = []
    dealt: list[list[Entry]] = [[] for _ in range(shards)]
    for r in w.withColumn("shard", F.pmod(F.xxhash64("word"), F.lit(shards))).orderBy("word", "exact").toLocalIterator():
        dealt[r["shard"]].append((r["word"], r["exact"], r["id"]))
    each = max(1, at_once // spellings)  # automata of one pass
    whole = shards <= each
    for at in range(0, shards, each):
        passes.append(d.mapInArrow(scan(tuple(tuple(some) for some in dealt[at : at + each]), whole), schema + ("" if whole else ", exact boolean")))
    out = passes[0] if whole else reduce(DataFrame.unionByName, passes).repartition("id").sortWithinPartitions("id").mapInArrow(resolved, schema)
    return out.withColumnRenamed("id", id_col)


def annotate(docs: DataFrame, dictionary: DataFrame, id_col: str = "resume_id", text_col: str = "full_text", sections_col: str = "sections") -> DataFrame:
    """Mentions with the type of the section they stand in."""
    found = tag(docs, dictionary, id_col, text_col).join(docs.select(id_col, sections_col), id_col)
    return found.withColumn("section_type", section_at(F.col(sections_col), F.col("char_start"))).drop(sections_col).withColumn("matched_by", F.lit("dict"))
