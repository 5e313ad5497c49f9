"""Threshold-scaled sketches and fill-in-middle against plain Python over whole tables."""

import hashlib
import re
import struct

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkspan.llm import fill_middle, queries, scaled_sketch
from inkspan.llm.common import table


def digest(*parts, seed=42):
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else struct.pack("<q", p), seed)
        seed = seed - (1 << 64) if seed >> 63 else seed
        last, seed = seed, seed % (1 << 64)
    return last


def sketch(text, scale=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    h = [digest(w) for w in words]
    pair = [digest(a, b) for a, b in zip(h, h[1:], strict=False)]
    four = [digest(a, b) for a, b in zip(pair, pair[2:], strict=False)]
    found = [digest(a, b) for a, b in zip(four, h[4:], strict=False)] if len(h) >= 5 else [digest(*h)] if h else []
    kept = [x for x in found if x < -(1 << 63) + (1 << 64) // scale]
    return (not kept and bool(found), {x & 0xFFFFFFFF for x in kept or ([min(found)] if found else [])})


def string(s):
    return ("~" if s[0] else "") + "".join(f"{x:08x}" for x in sorted(s[1]))


def like(a, b):
    return len(a[1] & b[1]) / len(a[1] | b[1]) if a[1] | b[1] else 1.0


def expected(rows):
    """rows: (id, text) in order."""
    out = []
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        a, b, c = sketch(text), sketch(edited), sketch(after)
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), string(a), string(b), round(like(a, b), 9), round(like(a, c), 9)))
    return sorted(out, key=str)


def found(df):
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    return sorted((tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in names) for r in df.collect()), key=str)


def ordered(rows):
    rows = [(i, t or "") for i, t in rows]
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), digest(r[1]), r[1]))


def test_op13_equals_plain_python(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert found(queries.op13_threshold_scaled_sketch(spark, sf)) == expected(ordered(rows))


def test_neighbours_of_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(None, "a b"), (None, None), (None, "a b"), (7, "same id one"), (7, "same id two"), (7, ""), (7, "same id one"), (3, long), (2, long + " x"), (1, "é" * 10), (-5, " \n ")]
    rows += [(9, f"text number {i} of one id") for i in range(60)] + [(None, f"no id {i}") for i in range(40)]
    schema = "doc_id long, text string, id int, bin int, hash string, first int, last int"
    docs = spark.createDataFrame([(*r, 1, 2, "h", 3, 4) for r in rows], schema)
    assert found(scaled_sketch.compare_neighbours(docs)) == expected(ordered(rows))
    assert found(scaled_sketch.compare_neighbours(docs.limit(0))) == []
    one = spark.createDataFrame([("k-1", "one two three four five six")], "doc_id string, text string")
    assert found(scaled_sketch.compare_neighbours(one)) == expected([("k-1", "one two three four five six")])
    named = [(f"k{i}", f"text {i} with a few words more") for i in range(50)]
    assert found(scaled_sketch.compare_neighbours(spark.createDataFrame(named, "doc_id string, text string"))) == expected(sorted(named, reverse=True))


def test_sketches_merge_and_estimate_containment(spark):
    big = " ".join(f"w{i % 7919}x{i % 31}" for i in range(40_000))
    small = " ".join(big.split()[5_000:6_000]) + " " + " ".join(f"own{i}" for i in range(1_000))
    df = spark.createDataFrame([(big, small)], "a string, b string").select(scaled_sketch.sketch_of(F.col("a")).alias("a"), scaled_sketch.sketch_of(F.col("b")).alias("b"))
    df = df.withColumn("both", scaled_sketch.merged(F.col("a"), F.col("b")))
    got = df.select(scaled_sketch.containment(F.col("b"), F.col("a")).alias("part"), scaled_sketch.containment(F.col("b"), F.col("both")).alias("whole"), scaled_sketch.containment(F.col("a"), F.col("both")).alias("other"), "both").first()
    assert abs(got["part"] - 0.5) < 0.06 and got["whole"] == got["other"] == 1.0 and not got["both"]["least"]
    assert set(got["both"]["hashes"]) == sketch(big)[1] | sketch(small)[1]


def test_no_python_in_the_fingerprint_plan(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    plan = scaled_sketch.fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_fill(key, text, seed=7, rate=100, spm=50):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    hexed = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(hexed[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_op11_equals_plain_python(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    rows = queries.op11_rope_fill_in_middle(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        n, form, prefix, middle, out = plain_fill(r["doc_id"], docs[r["doc_id"]])
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (out, docs[r["doc_id"]])]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) == (n, form, prefix, middle, *sha)


def test_fill_in_middle_of_odd_rows(spark):
    long = "".join(f"zeile {i} é€😀\n" for i in range(30_000)) + "no end"
    texts = [None, "", "\n", "\n\n", "one line", "a\nb", "a\r\nb c\n", "with <S> in it\n", "<P", "x<\n<S\n>\n", long, long.replace("\n", " "), "x\n" * 3]
    rows = [(i % 11, t) for i, t in enumerate(texts)] + [(None, "null\nid\n"), (1, "a\nb"), (1, "a\nb")]
    docs = spark.createDataFrame([(*r, "k", 1, "f") for r in rows], "doc_id long, text string, key string, n int, form string")
    for rate, spm in ((100, 50), (40, 100), (100, 0)):
        made = fill_middle.fill_in_middle(docs, rate=rate, spm=spm)
        got = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in made.collect()]
        assert sorted(got, key=str) == sorted(((k, *plain_fill(k, t or "", rate=rate, spm=spm)) for k, t in rows), key=str)
        back = [(r["doc_id"], r["text"]) for r in fill_middle.restore(made).collect()]
        assert sorted(back, key=str) == sorted(((k, t or "") for k, t in rows), key=str)
    assert fill_middle.restore(fill_middle.fill_in_middle(docs.limit(0))).collect() == []
    odd = spark.createDataFrame([(None, "psm"), ("x", None)], "output string, form string")
    assert [r["text"] for r in fill_middle.restore(odd).collect()] == [None, None]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab\né😀<", max_size=400), st.integers(0, 500))
def test_ropes_split_anywhere(text, rank):
    leaf, fill_middle.LEAF = fill_middle.LEAF, 5
    try:
        tree = fill_middle.rope(text.encode())
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        assert tree.units() == len(units) and tree.counts == (text.count("\n"), len(text), len(text.encode()))
        a, b = fill_middle.lines_split(tree, rank)
        assert [b"".join(x.leaves()).decode() for x in (a, b)] == ["".join(units[:rank]), "".join(units[rank:])]
        a, b = fill_middle.split(tree, fill_middle.CHARS, rank)
        assert [b"".join(x.leaves()).decode() for x in (a, b)] == [text[:rank], text[rank:]]
    finally:
        fill_middle.LEAF = leaf


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_an_output_without_its_sentinels_is_an_error(form):
    with pytest.raises(ValueError):
        fill_middle.restored(b"no sentinel", form)
