"""Conversation structure repair: cheapest edits by a fold of native column expressions.

The edits are found on narrow rows (role initial, fault flags, a digest instead of the text). Equal rows are counted
before they are shuffled, windows give the fault flags, and a range sort over all conversations puts the rows in order.
Each stretch of at most ``BLOCK`` rows of one conversation is collected as sorted turn structs and folded by
``aggregate()``, which carries four structs (cost, audit): nothing said yet, system said, user last, assistant last;
``least`` keeps the cheaper, on ties the ASCII-least. A stretch that may continue a conversation is folded from each
of the four states, and the stretches of one conversation are then joined by a second fold over these small results, so
no conversation is ever one array of turns, however long it is. Texts are shuffled once, to apply the edits row by row.

Two audits that compete for one state and cost the same are never one the start of the other (they would differ in
insertions alone, which cost), so appending the same edits to both keeps their order and the fold is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.llm.common import cut, fields, settled, tidy

BLOCK = 256
STATES = ("o", "s", "u", "a")  # nothing yet, system, user last, assistant last
UNREACHED = 1 << 50
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
_SPOKEN = "[^\\x20\\x09-\\x0D]"


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text and ``times``, how often the row is there after damage (0: dropped).

    Remainder 20 of crc32(``conv_id:turn``): 0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4
    sets its role to user. Nulls are read as one space, also in the role and the text that stay.
    """
    d = fields(turns, conv=conv_col, turn=turn_col, role=role_col, text=text_col)
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    d = d.select("conv", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return d.select(
        F.col("conv").alias(conv_col),
        F.col("turn").alias(turn_col),
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias(role_col),
        text.alias(text_col),
        F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1).alias("times"),
    )


def _shaped(turns: DataFrame, columns: tuple[str, str, str, str], times_col: str | None) -> DataFrame:
    """conv, turn, role, text, n, digest: nulls of role and text are one space; a row that is not there (n = 0) keeps its conv only."""
    conv, turn, role, text = columns
    d = fields(turns, conv=conv, turn=turn, role=role, text=text, **({"n": times_col} if times_col else {}))
    d = d.withColumn("n", F.coalesce(F.col("n").cast("long"), F.lit(0)) if times_col else F.lit(1).cast("long"))
    there = F.col("n") > 0
    d = d.select("conv", F.when(there, F.col("turn")).alias("turn"), F.when(there, F.coalesce("role", F.lit(" "))).alias("role"), F.when(there, F.coalesce("text", F.lit(" "))).alias("text"), "n")
    return d.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def _flagged(d: DataFrame) -> DataFrame:
    """One row per conversation, turn, role and text, with n (its copies) and live: its first copy may be kept."""
    blank = ~F.col("text").rlike(_SPOKEN)
    open_end = ~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")
    narrow = d.select("conv", "turn", "role", "digest", F.coalesce(blank, F.lit(False)).alias("blank"), F.coalesce(open_end, F.lit(False)).alias("open"), "n")
    counted = narrow.groupBy("conv", "turn", "role", "digest", "blank", "open").agg(F.sum("n").alias("n"))
    said = Window.partitionBy("conv", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    return counted.withColumn("live", (F.row_number().over(said) == 1) & ~F.col("blank") & (F.col("n") > 0))


def _pair_fault(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), 0).when(F.concat(a, b).isin("su", "ua", "au"), 0).otherwise(1)


def _state(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def _vector(**states: Column) -> Column:
    return F.struct(*[states[q].alias(q) for q in STATES])


def _only(entry: str | None = None) -> Column:
    """The vector that is in one state at no cost; without an entry, of the start of a conversation: nothing said, or inserted turns."""
    at = {entry: (0, "")} if entry else {"o": (0, ""), "u": (2, "I"), "a": (4, "II")}
    return _vector(**{q: _state(F.lit(at.get(q, (UNREACHED, ""))[0]), F.lit(at.get(q, (UNREACHED, ""))[1])) for q in STATES})


def _step(v: Column, x: Column) -> Column:
    """The vector after one row and its copies: deleted, kept, given another role; then turns inserted behind it."""

    def grown(q: Column, cost: Column, marks: Column) -> Column:
        return _state(q["cost"] + cost, F.concat(q["audit"], marks))

    def spoken(q: Column, initial: str) -> Column:
        same = x["initial"] == initial
        return F.when(x["live"], grown(q, x["base"] + F.when(same, 0).otherwise(2), F.concat(F.when(same, "K").otherwise("R"), x["rest"])))

    gone = {q: grown(v[q], x["gone_cost"], x["gone"]) for q in STATES}
    o = gone["o"]
    s = F.least(gone["s"], F.when(x["live"] & (x["initial"] == "s"), grown(v["o"], x["base"], F.concat(F.lit("K"), x["rest"]))))
    u = F.least(gone["u"], spoken(F.least(v["o"], v["s"], v["a"]), "u"))
    a = F.least(gone["a"], spoken(v["u"], "a"))
    insert = F.lit("I")
    u = F.least(u, grown(F.least(o, s, a), F.lit(2), insert))
    return _vector(o=o, s=s, u=u, a=F.least(a, grown(u, F.lit(2), insert)))


def _through(v: Column, block: Column) -> Column:
    """The vector after a block that was folded from each state."""
    entries = list(enumerate(STATES))
    return _vector(**{q: F.least(*[_state(v[e]["cost"] + block[i][q]["cost"], F.concat(v[e]["audit"], block[i][q]["audit"])) for i, e in entries]) for q in STATES})


def _blocks(flagged: DataFrame, block: int) -> DataFrame:
    """One row per stretch: conv, stretch, counts, borders, and its fold."""
    order = ("conv", "turn", "role", "digest")
    d = flagged.repartitionByRange(*order).sortWithinPartitions(*order)
    there = F.col("n") > 0
    d = d.select("conv", F.col("turn").cast("long").alias("turn"), F.when(there, F.substring("role", 1, 1)).alias("initial"), "blank", "open", "live", "n", F.monotonically_increasing_id().alias("id"))
    d = d.withColumn("stretch", F.floor(F.col("id") / block))
    near = Window.partitionBy("conv", "stretch").orderBy("id")
    again = F.greatest(F.col("n") - F.col("live").cast("long"), F.lit(0))  # copies that must go
    turn = F.struct(
        "id",
        "initial",
        "live",
        (3 * again + F.col("open").cast("long")).alias("base"),
        F.repeat(F.lit("D"), again.cast("int")).alias("rest"),
        (3 * F.col("n")).alias("gone_cost"),
        F.repeat(F.lit("D"), F.col("n").cast("int")).alias("gone"),
    )
    d = d.select(
        "conv",
        "stretch",
        "id",
        "initial",
        F.col("turn").alias("turn_no"),
        turn.alias("turn"),
        F.when(F.col("blank"), F.col("n")).otherwise(0).alias("blank"),
        F.when(F.col("blank"), 0).otherwise(again).alias("duplicate"),
        (F.col("live") & F.col("open")).cast("long").alias("truncated"),
        (F.greatest(F.col("n") - 1, F.lit(0)) + _pair_fault(F.lag("initial").over(near), F.col("initial"))).alias("illegal"),
        (F.col("turn").isNotNull() & ~F.lag("turn").over(near).eqNullSafe(F.col("turn"))).cast("long").alias("turns"),
    )
    said = F.when(F.col("initial").isNotNull(), F.col("id"))
    d = d.groupBy("conv", "stretch").agg(
        F.sort_array(F.collect_list("turn")).alias("rows"),
        F.min("id").alias("from"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns")],
        F.min("turn_no").alias("lo"),
        F.max("turn_no").alias("hi"),
        F.min_by("initial", said).alias("first"),
        F.max_by("initial", said).alias("last"),
    )
    # a stretch that does not begin at a border begins its conversation
    opening = F.col("from") % block != 0
    entries = F.when(opening, F.array(_only())).otherwise(F.array(*[_only(q) for q in STATES]))
    return d.withColumn("fold", F.transform(entries, lambda v: F.aggregate("rows", v, _step))).drop("rows", "from")


@settled
def audit_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    times_col: str | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit.

    Rows are taken by turn, nulls first, rows of one turn by role, then by the SHA-256 digest of their text. ``times_col``
    says how often a row is there; a conversation of rows that are there no times has zeros and an empty audit. Nulls of
    role and text are one space; rows with a null conversation are one conversation; equal rows are duplicates of the first
    of them. An initial is a role's first character, so other roles that begin with s, u or a count as these. Texts count
    as seen where role and SHA-256 digest are equal. An empty table gives an empty table.
    """
    d = _blocks(_flagged(_shaped(turns, (conv_col, turn_col, role_col, text_col), times_col)), block)
    behind = Window.partitionBy("conv").orderBy("stretch")
    d = d.withColumn("illegal", F.col("illegal") + _pair_fault(F.lag("last").over(behind), F.col("first")))
    d = d.withColumn("turns", F.col("turns") - F.coalesce((F.lag("hi").over(behind) == F.col("lo")).cast("long"), F.lit(0)))
    d = d.groupBy("conv").agg(
        F.coalesce(F.max("hi") - F.min("lo") + 1 - F.sum("turns"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal")],
        F.sort_array(F.collect_list(F.struct("stretch", "fold"))).alias("folds"),
    )
    last = F.aggregate("folds", _only(), lambda v, b: F.when(F.size(b["fold"]) == 1, b["fold"][0]).otherwise(_through(v, b["fold"])))
    d = d.withColumn("last", last).withColumn("best", F.least("last.o", "last.a"))
    return d.select(F.col("conv").alias(conv_col), "gaps", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit")


def repaired_turns(
    turns: DataFrame,
    audits: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    times_col: str | None = None,
    digest: bool = False,
) -> DataFrame:
    """The conversations with their audits' edits made: conv_id, position (from 0), role, text, edit (K, R or I).

    With ``digest``, one row per conversation instead: conv_id, repaired_sha256 of its ``role:text`` joined by line
    breaks. Each conversation's audit is sorted before its turns, so they pass through a task one by one; only the audit
    and a batch of rows are held, whatever a conversation's length.
    """
    d = _shaped(turns, (conv_col, turn_col, role_col, text_col), times_col).filter("n > 0")
    d = d.select("conv", F.lit(1).alias("kind"), "turn", "role", "digest", "text", "n")
    kinds = {c: d.schema[c].dataType for c in d.columns}
    heads = fields(audits, conv=conv_col, text="audit").select("conv", "text").withColumn("kind", F.lit(0)).withColumn("n", F.lit(0).cast("long"))
    d = d.unionByName(heads.select(*[F.col(c) if c in heads.columns else F.lit(None).cast(kinds[c]).alias(c) for c in d.columns]))
    d = d.repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "digest").select("conv", "kind", "role", "text", "n")
    kind = kinds["conv"].simpleString()
    schema = f"conv {kind}, sha256 string" if digest else f"conv {kind}, position long, role string, text string, edit string"
    out = d.mapInArrow(tidy(_digests if digest else _turns), schema)
    return out.select(F.col("conv").alias(conv_col), F.col("sha256").alias("repaired_sha256")) if digest else out.withColumnRenamed("conv", conv_col).withColumnRenamed("role", role_col).withColumnRenamed("text", text_col)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Per batch: (conv, None) where a conversation begins, and (conv, role, text, edit) for each turn of its repaired form."""
    conv, audit, at, last = None, "", 0, ""

    def inserted(made: list[tuple]) -> None:
        nonlocal at, last
        while audit[at : at + 1] == "I":
            last = "assistant" if last[:1] == "u" else "user"
            made.append((conv, last, "", "I"))
            at += 1

    for batch in batches:
        made: list[tuple] = []
        convs = batch.column(0)
        kinds, roles, texts, counts = (batch.column(i).to_pylist() for i in range(1, 5))
        for i, (head, role, text, n) in enumerate(zip(kinds, roles, texts, counts, strict=True)):
            if head == 0:
                inserted(made)
                conv, audit, at, last = convs[i], text, 0, ""
                made.append((conv, None))
                continue
            for _ in range(n):
                inserted(made)
                edit, at = audit[at], at + 1
                if edit != "D":
                    last = role if edit == "K" else "assistant" if last[:1] == "u" else "user"
                    made.append((conv, last, text, edit))
        yield made
    made = []
    inserted(made)
    yield made


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    position, kind = 0, None
    for made in _edited(batches):
        rows = []
        for x in made:
            if x[1] is None:
                position, kind = 0, x[0].type
            else:
                rows.append((x[0].as_py(), position, *x[1:]))
                position += 1
        if rows:
            columns = list(zip(*rows, strict=True))
            types = (kind, pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["conv", "position", "role", "text", "edit"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, found = None, None

    def batch(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c.as_py() for c, _ in done], done[0][0].type), pa.array([h for _, h in done])], ["conv", "sha256"])

    for made in _edited(batches):
        done = []
        for x in made:
            if x[1] is None:
                if conv is not None:
                    done.append((conv, found.hexdigest()))
                conv, found, some = x[0], hashlib.sha256(), False
            else:
                found.update((("\n" if some else "") + f"{x[1]}:{x[2]}").encode())
                some = True
        if done:
            yield batch(done)
    if conv is not None:
        yield batch([(conv, found.hexdigest())])


def repair_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", times_col: str | None = None
) -> DataFrame:
    """:func:`audit_conversations` with repaired_sha256."""
    columns = {"conv_col": conv_col, "turn_col": turn_col, "role_col": role_col, "text_col": text_col, "times_col": times_col}
    audits = audit_conversations(turns, **columns)
    made = repaired_turns(turns, audits, **columns, digest=True).withColumnRenamed(conv_col, "_conv")
    return cut(audits.join(made, audits[conv_col].eqNullSafe(made["_conv"])).drop("_conv"), "repaired")
