"""What FINDINGS_r05 named: the shape of what took too long, and the same results from the forms that replaced it."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401 - it registers the queries
from inkspan.operators import evidence, retrieval
from inkspan.plans import queries as plans

SYLLABLES = ["de ", "ción", "mente", "rr", "ña", "lla", "os ", "as", "tu", "ez ", "ie", "co", "中文", "的"]


def spoken(rng, n):
    return "".join(rng.choice(SYLLABLES) for _ in range(n))


def test_texts_of_the_same_syllables_are_no_candidates():
    """Their 3-grams all stand in the texts; all of them were aligned before."""
    rng = random.Random(5)
    quotes = [spoken(rng, 80) for _ in range(20)]
    texts = [spoken(rng, 1500) for _ in range(5)]
    assert not any(evidence._Quotes(tuple(quotes)).candidates_of(texts))


def test_candidates_lose_no_similar_part():
    """Windows in the middle and clipped ones at both ends, over texts handled together, against all pairs."""
    rng = random.Random(7)
    similar = clipped = 0
    for _ in range(12):
        texts = [spoken(rng, rng.randrange(2, 200)) for _ in range(8)] + ["", None]
        quotes = []
        for _ in range(12):
            t = texts[rng.randrange(8)]
            size = rng.choice([rng.randrange(6, 20), rng.randrange(20, 70), rng.randrange(60, 400)])
            at = rng.choice([0, max(0, len(t) - size), rng.randrange(len(t))])
            q = list(t[at : at + size])
            if rng.random() < 0.3:
                q = list(spoken(rng, 1 + rng.randrange(max(1, size // 12)))) + q
            if rng.random() < 0.3:
                q += list(spoken(rng, 1 + rng.randrange(max(1, size // 12))))
            for _ in range(rng.randrange(len(q) // 9 + 1)):
                x = rng.randrange(len(q))
                q[x : x + 1] = rng.choice([["§"], [q[x], "§"], ["a"], []]) if len(q) > 1 else q
            quotes.append("".join(q))
        for t, near in zip(texts, evidence._Quotes(tuple(quotes)).candidates_of(texts), strict=True):
            for k, q in enumerate(quotes):
                if t and len(q) >= evidence.LEAST_FUZZY:
                    want = evidence.similar_part(q, t)
                    assert want == (evidence.similar_part(q, t, near[k]) if k in near else None)
                    similar += want is not None
                    clipped += want is not None and want[1] - want[0] != len(q)
    assert similar > 80 and clipped > 20


def test_texts_of_one_file_are_dealt_out(spark, sf):
    """The file has one row group, which one task read and searched."""
    got = plans.QUERIES["ev_locate_similar"](spark, sf)
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def pair_by_pair(queries, chunks, n):
    """What recall must give: every pair's similarity by column expressions, ranked."""
    q = queries.select("session_id", "query_id", F.col("embedding").alias("a"))
    d = q.join(chunks.select("session_id", "idx", F.col("embedding").alias("b")), "session_id")
    d = d.select("session_id", "query_id", "idx", retrieval.cosine(F.col("a"), F.col("b")).alias("similarity"))
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc_nulls_last(), "idx")
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def told(df):
    return sorted((tuple(map(repr, r)) for r in df.select("session_id", "query_id", "idx", "similarity", "rank").collect()))


def test_recall_in_blocks_equals_all_pairs(spark, monkeypatch):
    """Equal vectors, ties by id, nearly equal ones, zero, null, shorter, tiny, huge and NaN ones; the same bits."""
    rng = random.Random(3)
    base = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(30)]
    odd = [None, [], [0.0] * 5, [1.0, None, 2.0, 0.0, 1.0], [1.0, 2.0], [1e-170] * 5, [1e160] * 5, [float("nan")] * 5, [float("inf"), 1.0, 1.0, 1.0, 1.0], base[0][::-1]]
    made = base + odd + [base[0]] * 9 + [[x * 3.0 for x in base[1]]] * 5 + [[x + 1e-16 for x in base[2]]] * 5
    rows = [(s, i * 10 + s, v) for s in (1, 2) for i, v in enumerate(made)] + [(3, 9001, base[0]), (3, 9002, None), (None, 9003, base[0])]
    chunks = spark.createDataFrame(rows, "session_id int, idx long, embedding array<double>")
    queries = chunks.filter("idx % 3 = 0").withColumnRenamed("idx", "query_id")
    monkeypatch.setattr(retrieval, "QUERIES", 4)
    monkeypatch.setattr(retrieval, "CHUNKS", 7)
    for n in (1, 3, 20):
        monkeypatch.setattr(retrieval, "PARTS", n)
        assert told(retrieval.recall(queries, chunks, n=n)) == told(pair_by_pair(queries, chunks, n))
    floats = [x.withColumn("embedding", F.col("embedding").cast("array<float>")) for x in (queries, chunks)]
    assert told(retrieval.recall(*floats, n=3)) == told(pair_by_pair(*floats, 3))


def test_recall_joins_blocks_not_vectors(spark, sf):
    """A row of the join was a pair of vectors, multiplied by an interpreted fold."""
    plan = plans.QUERIES["top_recall"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(zip_with" not in plan[: plan.index("Join Inner")]
    assert "_part" in plan[plan.index("Join Inner") :].split("\n")[0]
