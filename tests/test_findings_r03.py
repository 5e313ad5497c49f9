"""What FINDINGS_r03 named: the shape of plans that grew too fast, and the same results from the forms that replaced them."""

import duckdb

import __spark_entry__  # noqa: F401 - it registers the queries
from inkspan.plans import queries as plans
from tests.test_queries import rows


def beside_sql(spark, name, folder, **tables):
    """The rows of a query and of its SQL over tables given as DuckDB SELECTs."""
    con = duckdb.connect()
    for t, select in tables.items():
        con.execute(f"COPY ({select}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = plans.QUERIES[name](spark, str(folder))
    cursor = con.execute(plans.SQL[name])
    return rows(got.columns, got.collect()), rows([c[0] for c in cursor.description], cursor.fetchall())


def test_lay_tables_shuffles_the_line_items_only(spark, sf):
    physical = plans.QUERIES["lay_tables"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    keys = [x for x in physical.split("\n") if "Exchange hashpartitioning(" in x]
    assert keys and all("hashpartitioning(l_orderkey" in x for x in keys)


def times(spark, sf, name, word):
    return plans.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString().count(word)


def test_mask_splits_a_text_once_a_pattern(spark, sf):
    assert times(spark, sf, "str_mask_pii", "split(") == 6


def test_date_ranges_match_a_text_once(spark, sf):
    for name in ("dt_find_range", "dt_is_date_line"):
        assert times(spark, sf, name, "regexp_extract(") == 1


def test_round_takes_a_logarithm_once(spark, sf):
    assert times(spark, sf, "math_round", "LOG2(") == 2


def test_recall_takes_lengths_before_the_join(spark, sf):
    plan = plans.QUERIES["top_recall"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert 0 < plan.index("join inner") < plan.index("sqrt(")


def test_materials_of_an_order_key_that_stands_twice(spark, sf, tmp_path):
    # copies shifted by the largest key: the last order of one has the key of the first of the next
    orders = " UNION ALL ".join(f"SELECT * REPLACE (o_orderkey + {i} * (SELECT max(o_orderkey) FROM '{sf}/orders.parquet') AS o_orderkey) FROM '{sf}/orders.parquet'" for i in range(3))
    got, want = beside_sql(spark, "iv_materials", tmp_path, orders=orders, lineitem=f"SELECT * FROM '{sf}/lineitem.parquet'")
    assert got == want


def test_overlap_of_few_bytes_is_dealt_out(spark, sf):
    got = plans.QUERIES["math_overlap_2d"](spark, sf)
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_modes_of_matching_number_the_line_items_once_an_input(spark, sf):
    # requirements, mentions, education, answers and entries; every mode had them anew before
    plan = plans.QUERIES["match_modes"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number() windowspecdefinition(l_orderkey") == 5
    assert plan.count("regexp_extract(") == 1


def joins(spark, sf, name):
    return plans.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_spans_of_a_line_meet_in_one_grouping(spark, sf):
    assert joins(spark, sf, "src_pdf_line") == 0


def test_main_size_of_odd_spans(spark):
    from inkspan.operators import layout

    span = lambda line, x, text, size, bold=False: (1, 1, line, float(x), 0.0, x + 1.0, 1.0, text, size, bold)
    spans = [span(1, 0, "aa", 9.0), span(1, 2, "b", 10.0, True), span(1, 1, "c", 10.0, True), span(2, 0, None, 9.0), span(3, 0, "x", None), span(3, 1, "y", 8.0), span(None, 0, "z", 8.0)]
    names = "resume_id long, page_no int, line_no int, x0 double, y0 double, x1 double, y1 double, text string, font_size double, is_bold boolean"
    got = {r["line_no"]: (r["text"], r["font_size"], r["is_bold"]) for r in layout.merge_spans(spark.createDataFrame(spans, names)).collect()}
    assert got == {1: ("aacb", 10.0, False), 2: ("", 9.0, None), 3: ("xy", 8.0, False)}


def test_headers_that_repeat_are_found_without_a_join(spark, sf):
    assert joins(spark, sf, "lay_headers") == 1


def test_automata_that_fit_run_over_a_text_in_one_pass(spark, sf):
    plan = plans.QUERIES["arr_longest_first_alt"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "FlatMapGroups" not in plan


def test_several_passes_of_automata_decide_as_one(spark):
    from inkspan.operators import skills

    words = ["a", "go", "data base", "data", "base line", "line", "x y", "y", "Base"]
    held = spark.createDataFrame([(i, w, "word", [w.upper()]) for i, w in enumerate(words)], "id long, canonical_name string, category string, aliases array<string>")
    texts = [(None, "data base line a go"), (1, "x y base line data"), (2, None), (3, ""), (4, "nothing here")] + [(k, "go data base line x y a " * (k % 5)) for k in range(5, 40)]
    docs = spark.createDataFrame(texts, "resume_id long, full_text string").repartition(3)
    one, more = (sorted(skills.tag(docs, held, spellings=n, at_once=m).collect(), key=repr) for n, m in ((200_000, 200_000), (3, 3)))
    assert one and one == more


def test_asks_of_a_job_meet_its_text_once(spark, sf):
    plan = plans.QUERIES["jd_verify"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_fuzzy") == 1 or plan.count("ArrowEvalPython") == 1
    assert "Union" not in plan


def test_each_quote_is_located_as_alone(spark):
    from pyspark.sql import functions as F

    from inkspan.operators import evidence

    texts = [(1, "The quick brown fox jumps over the lazy dog."), (2, None), (3, ""), (4, "short")]
    quotes = ["quick brown", "quick brawn fox jumps over", "q", None, "", "not there at all", "'The Quick.'"]
    d = spark.createDataFrame(texts, "id long, text string").withColumn("quotes", F.array(*[F.lit(q) for q in quotes]))
    each = evidence.locate_each(d, F.col("quotes"), "text").select("id", F.posexplode("spans").alias("n", "span"))
    alone = evidence.locate(d.select("id", "text", F.posexplode("quotes").alias("n", "quote"))).select("id", "n", "span")
    got, want = ({(r["id"], r["n"]): r["span"] for r in x.collect() if r["span"]} for x in (each, alone))
    assert got == want and {n for _, n in got} == {0, 1, 6}


def test_diagnoses_of_an_order_key_that_stands_twice(spark, sf, tmp_path):
    # a diagnosis met its counters and tokens once for each of its rows before
    orders = " UNION ALL ".join(f"SELECT * REPLACE (o_orderkey + {i} * (SELECT max(o_orderkey) FROM '{sf}/orders.parquet') AS o_orderkey) FROM '{sf}/orders.parquet'" for i in range(2))
    got, want = beside_sql(spark, "snk_diagnosis", tmp_path, orders=orders, **{t: f"SELECT * FROM '{sf}/{t}.parquet'" for t in ("lineitem", "events")})
    assert got == want


def test_diagnoses_number_their_findings_once_a_write(spark, sf, monkeypatch):
    from inkspan.sources import staged

    plain, put = staged.replace_by_key, []
    monkeypatch.setattr(staged, "replace_by_key", lambda df, *a, **b: (put.append(df._jdf.queryExecution().optimizedPlan().toString()), plain(df, *a, **b))[1])
    plans.QUERIES["snk_diagnosis"](spark, sf)
    assert [p.count("row_number()") for p in put] == [1, 0, 1, 0]
    assert [p.count("Relation [o_orderkey") for p in put] == [0, 1, 0, 1]


def test_keys_are_replaced_alike_with_and_without_hot_keys(spark, tmp_path):
    from pyspark.sql import functions as F

    from inkspan.sources import staged
    from tests.test_sinks import BLOCK, stored

    first = [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z"), (None, 0, "n"), *[(f"k{i}", 0, "t") for i in range(50)]]
    again = [("a", 0, "new"), (None, 5, "m"), ("b", None, None), ("c", None, None)]
    want = sorted([r for r in first if r[0] not in ("a", "b", None)] + again[:2], key=str)
    for hot in (False, True):
        path = f"file://{tmp_path}/blocks-{hot}"
        staged.replace_by_key(spark.createDataFrame(first, BLOCK), path, "resume_id", buckets=8, hot_keys=hot)
        assert staged.replace_by_key(spark.createDataFrame(again, BLOCK), path, "resume_id", hot_keys=hot) == 2
        assert stored(spark, path) == want and sorted(map(tuple, staged.read_written(spark, path, 2).collect()), key=str) == sorted(again[:2], key=str)
        staged.replace_by_key(spark.createDataFrame([], BLOCK), path, "resume_id", hot_keys=hot)
        staged.clean_up(spark, path)
        assert stored(spark, path) == want
    # a table of the former kind: one run a bucket, the other hash
    path = f"file://{tmp_path}/former"
    rows_ = spark.createDataFrame(first, BLOCK)
    rows_.withColumn("bucket", F.expr("pmod(xxhash64(resume_id), 8)").cast("int")).write.partitionBy("bucket").parquet(f"{path}/parts/r0")
    held = {str(r["b"]): "r0" for r in rows_.select(F.expr("pmod(xxhash64(resume_id), 8)").alias("b")).distinct().collect()}
    staged._commit(spark, path, 1, {"buckets": 8, "schema": rows_.schema.jsonValue(), "runs": held})
    assert stored(spark, path) == sorted(first, key=str)
    staged.replace_by_key(spark.createDataFrame(again, BLOCK), path, "resume_id")
    staged.clean_up(spark, path)
    assert stored(spark, path) == want


def test_pieces_under_marks_are_sorted_once_without_their_marks(spark, sf):
    plan = plans.QUERIES["arr_segments_under_marks"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and plan.count("Window [") == 1
    assert plan.index("Window [lead(start") < plan.index("array_sort(transform(")


def test_a_piece_over_many_stretches_ends_with_its_block_or_the_next_cut(spark):
    from inkspan.operators import spans
    from tests.test_sinks import cut_up

    blocks = [("a", 0, 100), ("a", 100, 130), ("a", 131, 132), ("b", 7, 64), ("b", 64, 65), (None, 0, 33)]
    marks = [("a", 0, 20, 20, 1, "empty"), ("a", 1, 40, 110, 1, "m1"), ("a", 2, 96, 96, 0, "at a border"), ("a", 3, 0, 500, 0, "m3"), ("b", 0, 16, 32, 2, "m0"), ("b", 1, 32, 48, 2, None), ("b", 2, 70, 90, 2, "outside")]
    b = spark.createDataFrame(blocks, "doc string, char_start int, char_end int")
    m = spark.createDataFrame(marks, "doc string, ordinal int, mark_start int, mark_end int, priority int, mark string")
    for chunk in (1, 8, 16, 1000):
        got = spans.segments_under_marks(b, m, "doc", chunk)
        assert got.columns == ["doc", "start", "end", "mark", "marks"]
        assert sorted(map(tuple, got.collect()), key=str) == cut_up(blocks, marks)
