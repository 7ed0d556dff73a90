"""Operators on small fixtures, skewed ones included, against plain Python."""

from collections import Counter, defaultdict
from datetime import date

import duckdb
import pytest
from pyspark.sql import functions as F

from gleaner.operators import aggregates, cards, dedupe, joins, markdown, ordering, overlap, search
from gleaner.operators.filters import record_profile
from gleaner.plans import ordered
from gleaner.plans.skew import equi_join, hot_keys, row_salt, salted_join
from gleaner.schemas import CARD_SLOTS
from gleaner.sources import files, searches, tables


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows, a third of them under key 7, some under no key."""
    data = [(i, 7 if i % 3 == 0 else (None if i % 10 == 1 else i % 50), i % 4) for i in range(3000)]
    return data, spark.createDataFrame(data, "id bigint, key bigint, v int")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_salted_join_is_exact(spark, skewed, how, null_safe):
    data, left = skewed
    right_data = [(7, "a"), (7, "b"), (8, "c"), (None, "d"), (99, "e")]
    right = spark.createDataFrame(right_data, "key bigint, name string")
    by_key = defaultdict(list)
    for k, n in right_data:
        by_key[k].append(n)
    want = []
    for i, k, v in data:
        found = by_key[k] if (k is not None or null_safe) else []
        if how in ("inner", "left"):
            want += [(i, k, v, n) for n in found] or ([(i, k, v, None)] if how == "left" else [])
        elif bool(found) == (how == "left_semi"):
            want.append((i, k, v))
    plain, salted = (equi_join(left, right, "key", how, null_safe=null_safe, piece_rows=n) for n in (None, 50))
    assert plain.columns == salted.columns
    assert sorted(map(str, rows(plain))) == sorted(map(str, rows(salted))) == sorted(map(str, want))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_salted_join_of_hot_right_and_equal_rows(spark, how, null_safe):
    left = spark.createDataFrame([(k,) for k in [7] * 40 + [8] * 3 + [None] * 30 + [5]], "key bigint")
    right = spark.createDataFrame([(k, i % 3) for i, k in enumerate([7] * 30 + [8] * 50 + [None] * 25 + [6])], "key bigint, v int")
    got = salted_join(left.repartition(4), right, "key", how, null_safe=null_safe, piece_rows=10)
    test = left["key"].eqNullSafe(right["key"]) if null_safe else left["key"] == right["key"]
    want = left.join(right, test, how).select(left["key"], *([] if "_" in how else [right["v"]]))
    assert sorted(map(str, rows(got))) == sorted(map(str, rows(want)))


def test_a_plain_join_moves_each_side_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        left, right = spark.range(50).withColumnRenamed("id", "a"), spark.range(60).withColumnRenamed("id", "b")
        plan = equi_join(left, right, [("a", "b")])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2 and "Aggregate" not in plan


def test_salted_join_spreads_the_hot_key(spark, skewed):
    _, left = skewed
    assert [(r.key, r.pieces) for r in hot_keys(left, ["key"], 300).filter("key is not null").collect()] == [(7, 4)]
    same = spark.range(0, 8000, 1, 40).select(F.lit(7).alias("key"))  # equal rows from 40 partitions
    spread = same.groupBy(row_salt(same, F.lit(4)).alias("s")).count().collect()
    assert len(spread) == 4 and max(r["count"] for r in spread) < 4000


def test_company_lists_have_one_shape(spark):
    df = spark.createDataFrame([("a", "t", ["x", None, "y"]), ("a", "t", None), ("b", None, ["x"]), (None, "u", [])], "company string, title string, skills array<string>")
    got = rows(aggregates.company_lists(df, ["title", "skills"]))
    assert sorted(map(str, got)) == sorted(map(str, [("a", "title", "t", 2), ("a", "skills", "x", 1), ("a", "skills", "y", 1), ("b", "skills", "x", 1), (None, "title", "u", 1)]))


def test_lead_value_puts_nulls_first(spark):
    df = spark.createDataFrame([(1, 5, "c"), (1, None, "a"), (1, 3, "b"), (2, None, "d")], "u int, t int, kind string")
    led = ordered.lead_value(df, ["u"], ["t"], "kind", "nxt", slices=3)
    assert {r.kind: r.nxt for r in led.collect()} == {"a": "b", "b": "c", "c": None, "d": None}


def test_lead_and_running_count_across_buckets(spark):
    data = [(1 if i % 3 else 2, i, ["a", "b", "c"][(i * 7) % 3]) for i in range(400)]
    df = spark.createDataFrame(data, "u int, t int, kind string")
    want_lead, want_run = {}, {}
    for u in (1, 2):
        mine = [x for x in data if x[0] == u]
        hits = 0
        for at, (_, t, kind) in enumerate(mine):
            hits += kind == "b"
            want_lead[t] = mine[at + 1][2] if at + 1 < len(mine) else None
            want_run[t] = hits
    led = ordered.lead_value(df, ["u"], ["t"], "kind", "nxt", slices=23)
    assert {r.t: r.nxt for r in led.collect()} == want_lead
    run = ordered.running_count(df, ["u"], ["t"], F.col("kind") == "b", "k", slices=23)
    assert {r.t: r.k for r in run.collect()} == want_run


def test_slices_are_even_under_a_hot_day(spark):
    ts = F.lit("2024-03-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.when(F.col("id") % 3 == 0, 0).otherwise((F.col("id") % 30).cast("int")), F.lit(0), F.lit(0), F.col("id") / 100)
    df = spark.range(6000).withColumn("ts", ts)
    cut = ordered.with_slice(df, "ts", ordered.borders_of(df, "ts", 20))
    sizes = [r["count"] for r in cut.groupBy("_slice").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 450
    spans = cut.groupBy("_slice").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).orderBy("_slice").collect()
    assert all(x.b < y.a for x, y in zip(spans, spans[1:]))


@pytest.mark.parametrize("index", [0, 1, 250, 332, 333, 1000])
def test_nth_match_wraps(spark, index):
    df = spark.range(1000).withColumn("id", F.col("id") * 3 - 500)
    got = ordering.nth_match(df, F.col("id") % 9 == 1, "id", index).collect()
    ids = [r.id for r in df.filter(F.col("id") % 9 == 1).orderBy("id").collect()]
    assert [(r.id, r.position, r.n_matches) for r in got] == [(ids[index % len(ids)], index % len(ids) + 1, len(ids))]


def test_nth_match_evaluates_its_mask_once_per_row(spark):
    seen = spark.sparkContext.accumulator(0)

    def even(x: int) -> bool:
        seen.add(1)
        return x % 2 == 0

    df = spark.range(1000)
    assert [r.id for r in ordering.nth_match(df, F.udf(even, "boolean")("id"), "id", 123).collect()] == [246]
    assert seen.value == 1000


def test_forward_fill_carries_over_slices(spark):
    data = [(1 if i % 3 else 2, i if i else None, str(i) if i % 50 == 7 else None, "x") for i in range(600)] + [(None, 3, "n", "x"), (None, 9, None, "x")]
    df = spark.createDataFrame(data, "d int, line int, v string, _last string")
    got = {(r.d, r.line): r.out for r in markdown.forward_fill(df, "d", "line", "v", "out", slices=7).collect()}
    want, last = {}, {}
    for d, line, v, _ in sorted(data, key=lambda r: (r[0] or 0, r[1] if r[1] is not None else -1)):
        last[d] = v if v is not None else last.get(d)
        want[d, line] = last[d]
    assert got == want


def test_files_by_recency_are_listed_newest_first(spark, tmp_path):
    import os

    for n, age in (("a", 300), ("b", 100), ("c", 200), ("d", 100)):
        (tmp_path / f"{n}.html").write_text("x")
        os.utime(tmp_path / f"{n}.html", (1_700_000_000 - age,) * 2)
    listed = files.by_recency(files.file_inventory(spark, str(tmp_path), "*.html"))
    assert [r.path.rsplit("/", 1)[1] for r in listed.collect()] == ["b.html", "d.html", "c.html", "a.html"]


def test_a_time_without_zone_is_read_as_utc(spark):
    from gleaner.functions.values import to_utc

    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:  # one time of day does not exist there, one is there twice
        times = ["2025-03-09 02:30:00.000001", "2025-11-02 01:30:00", "1899-12-31 23:59:59", None]
        df = spark.createDataFrame([(x,) for x in times], "t string").select(to_utc(F.col("t").cast("timestamp_ntz")).alias("u"))
        got = [r[0] for r in df.select(F.unix_micros("u")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [1741487400000001, 1762047000000000, -2208988801000000, None]


def test_nth_match_of_none(spark):
    assert ordering.nth_match(spark.range(10), F.col("id") > 99, "id", 3).count() == 0


def test_value_counts(spark):
    df = spark.createDataFrame([(x,) for x in ["a", "a", "a", "b", "b", "c", None]], "c string")
    assert rows(aggregates.value_counts(df, "c", n=2, vmax=6)) == [("a", 3, 50.0), ("b", 2, 33.3), ("(Other)", 1, 16.7)]
    assert sorted(rows(aggregates.value_counts(df, "c", n=3))) == [("a", 3, 50.0), ("b", 2, 33.3), ("c", 1, 16.7)]
    assert sorted(rows(aggregates.value_counts(df, "c", n=9))) == [("a", 3, 50.0), ("b", 2, 33.3), ("c", 1, 16.7)]
    assert sorted(rows(aggregates.value_counts(df, "c", n=None, cutoff=3, vmax=3))) == [("(Other)", 3, 100.0), ("a", 3, 100.0)]
    assert rows(aggregates.value_counts(df.limit(0), "c", n=3)) == []


def test_exploded_counts_are_of_rows(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a"],), ([],), (None,)], "c array<string>")
    got = sorted(rows(aggregates.exploded_counts(df, "c", n=1)))
    assert got == [("(Other)", 1, 25.0), ("a", 2, 50.0)]


def test_share_counts_null_as_false(spark):
    df = spark.createDataFrame([(True,), (False,), (None,), (True,)], "m boolean")
    assert rows(aggregates.share_true(df, F.col("m"), with_false=True)) == [(2, 1, 4, 50.0)]


def test_set_overlap(spark):
    def keys(*ks):
        return spark.createDataFrame([(k,) for k in ks], "k int")

    sets = {"A": keys(1, 2, 3, 3), "B": keys(3, 4)}
    want = [("-", "-", 4, 100.0), ("-", "Yes", 2, 50.0), ("Yes", "-", 3, 75.0), ("Yes", "Yes", 1, 25.0)]
    assert sorted(rows(overlap.set_overlap(sets, "k"))) == want
    assert rows(overlap.set_overlap(sets, "k", chosen=[["A", "B"], []])) == [("Yes", "Yes", 1, 25.0), ("-", "-", 4, 100.0)]
    assert sorted(rows(overlap.exclusive_regions(sets, "k"))) == [(False, True, 1), (True, False, 2), (True, True, 1)]
    eleven = rows(overlap.set_overlap({str(i): keys(i) for i in range(11)}, "k"))
    assert sorted((r.count("Yes"), *r[-2:]) for r in eleven) == [(0, 11, 100.0)] + [(1, 1, 9.1)] * 11


def test_mismatch_reports_missing_pairs(spark):
    df = spark.createDataFrame([("x", "x"), ("x", "y"), ("x", None), (None, None)], "a string, b string")
    assert joins.mismatches(df, "a", "b").count() == 3


def test_keep_first_takes_byte_order_before_hours(spark):
    df = spark.createDataFrame([("A - x", 2), ("a - X", 1), (None, 5), (None, 4)], "position string, hours int")
    df = df.withColumn("_position", F.lower("position"))
    got = dedupe.keep_first(df, ["_position"], [F.asc_nulls_last("position"), F.asc_nulls_last("hours")])
    assert sorted((r.position or "", r.hours) for r in got.collect()) == [("", 4), ("A - x", 2)]
    assert dedupe.keep_first(got, ["_position"], [F.asc("hours")]).count() == got.count()


def test_card_repair_of_every_gap(spark):
    full = ["3d", "T", "L", "$1k/yr", "Onsite", "Full", "Co:", "NYSE", ": sums", "5+ YOE", "2+ Mgmt", "job", "SQL", "Job Posting", "9 views"]
    fill = {0: "0h", 3: "-", 7: "-", 9: "-", 10: "-", 12: "-"}
    data, want = [], {}
    for bits in range(64):
        gone = {slot for n, slot in enumerate(fill) if bits >> n & 1}
        data.append((bits, [x for i, x in enumerate(full) if i not in gone]))
        want[bits] = [fill[i] if i in gone else x for i, x in enumerate(full)]
    df = spark.createDataFrame(data, "k int, cells array<string>")
    assert {r.k: r.cells for r in cards.repair_cards(df).collect()} == want


def test_company_page_cards(spark):
    cells = ["Co", "3d", "T", "L", "$1k/yr", "Onsite", "Full", ": sums", "job", "SQL", "Job Posting", "9 views"]
    df = spark.createDataFrame([("Co_", cells)], "company string, cells array<string>")
    got = cards.repair_cards(df, company=F.col("company")).first().cells
    assert len(got) == len(CARD_SLOTS)
    assert got[:8] == ["3d", "T", "L", "$1k/yr", "Onsite", "Full", "Co_", None]


def test_check_all_fails_the_job(spark):
    df = cards.check_all(spark.range(3), F.col("id") < 2, "bad row")
    for read in (df.collect, df.count, df.withColumn("x", F.lit(1)).select("x").collect):
        with pytest.raises(Exception, match="bad row"):
            read()


def test_search_text_nulls(spark):
    schema = ("company_name string, title string, _hash string, requirements_summary string, technical_tools array<string>, "
              "role_activities array<string>, seniority_level string, company_tagline string, _md string")
    base = ["Co", "T", "h", "req", ["a", "b"], ["c"], "Senior", None, "body"]
    df = spark.createDataFrame([tuple(base), tuple(base[:3] + [None] + base[4:])], schema)
    got = [r[0] for r in df.select(search.search_text(df)).collect()]
    assert got == ["Co - T.h\n\nreq\n\na; b\nc\n\nSenior; ...\n\n---\n\nbody", None]


def test_highlight_takes_terms_literally(spark):
    df = spark.createDataFrame([("Use C.D and CxD, AI", ["C.D"])], "md string, tools array<string>")
    got = df.select(search.highlight_terms("md", F.col("tools"))).first()[0]
    assert got == f"Use {search.SPAN}C.D</span> and CxD, {search.SPAN}AI</span>"


def test_candidates(spark):
    df = spark.createDataFrame([("use Apache Spark and use Apache Spark or with S3",)], "t string")
    assert df.select(search.keyword_candidates("t")).first()[0] == ["Apache Spark", "S3"]
    long = spark.createDataFrame([("a " + "Word " * 50_000,)], "t string")
    assert len(long.select(search.keyword_candidates("t")).first()[0][0]) == 5 * 50_000 - 1


def test_candidates_with_a_character_of_their_own(spark):
    df = spark.createDataFrame([(1, "see Apache Spark and Foo, é in Bar. an_x Baz")], "id int, t string")
    assert df.select(search.keyword_candidates("t")).first()[0] == ["Apache Spark", "Foo", "Bar"]
    assert df.select(search.keyword_candidates("t", search.OWN_CHARACTER)).first()[0] == ["Apache Spark", "Bar"]


def test_candidate_query_reads_as_its_sql(spark, tmp_path):
    from gleaner.queries import load_all
    from tests.harness import difference, spark_table, sql_table

    text = "see Apache Spark and Foo, in Bar x Baz and Foo"
    rows = [(i, text) for i in range(3)] + [(3, "a Rare word")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    query = load_all()["keyword_candidates"]
    assert difference(spark_table(query.run(spark, str(tmp_path))), sql_table(con, query.sql)) is None


def test_folders_by_recency_whatever_the_number_of_files(spark, tmp_path):
    rows = spark.range(100).select(F.when(F.col("id") < 60, "a").otherwise("b").alias("q"), F.col("id").cast("string"))
    rows.repartition(7).write.partitionBy("q").text(f"{tmp_path}/out")
    found = files.file_inventory(spark, f"{tmp_path}/out", "part-*.txt")
    assert found.count() > 7
    folders = files.by_recency(files.folder_inventory(found)).collect()
    assert {r.path.rsplit("/", 1)[1]: r.size for r in folders} == {"q=a": 10 * 2 + 50 * 3, "q=b": 40 * 3}
    assert folders[0].mtime >= folders[1].mtime


def test_recency_query_reads_as_its_sql_from_many_files(spark, tmp_path):
    from gleaner.queries import load_all
    from tests.harness import difference, spark_table, sql_table

    kind = F.when(F.col("id") % 2 == 0, "view").otherwise("click")
    rows = spark.range(90).select(F.col("id").alias("event_id"), F.lit("2024-01-05").cast("timestamp_ntz").alias("ts"), kind.alias("event_type"))
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # each file a partition, as large ones are
    try:
        rows.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
        query = load_all()["files_by_recency"]
        assert difference(spark_table(query.run(spark, str(tmp_path))), sql_table(con, query.sql)) is None
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_ranking_agrees_with_the_index(spark, tmp_path):
    docs = spark.createDataFrame(
        [(i, " ".join(["health"] * (i % 4) + ["data"] * (i % 3) + ["pad"] * (i % 7))) for i in range(60)], "id int, t string"
    )
    direct = search.bm25_rank(docs, "id", "t", "the health data", 10)
    index = search.bm25_index(docs, "id", "t")
    stored = search.bm25_retrieve(index, "id", "the health data", 10)
    a, b = rows(direct), rows(stored)
    assert [x[0] for x in a] == [x[0] for x in b] and all(abs(x[1] - y[1]) < 1e-9 for x, y in zip(a, b))
    kept = search.write_index(docs, "id", "t", str(tmp_path / "index"))
    assert [x[0] for x in rows(search.bm25_retrieve(kept, "id", "the health data", 10))] == [x[0] for x in a]
    assert search.bm25_rank(docs, "id", "t", "nothing", 10).count() == 0
    assert search.bm25_retrieve(index, "id", "the", 10).count() == 0


def test_markdown_blocks(spark):
    text = ("---\ntitle: x\n---\n# Top\nline one\nline two\n\n- a\n- b\n  more\n- c\n\n1. n\n\n***\n<!-- gone -->\nend")
    df = spark.createDataFrame([(1, text)], "d int, t string")
    got = [r[1:] for r in rows(markdown.md_blocks(df, "d", "t"), "begin")]
    assert got == [
        (0, 1, "", "---", ""), (3, 3, "h1", "#", "Top"), (4, 3, "p", "", "line one\nline two"), (7, 6, "li", "-", "a"),
        (8, 5, "li", "-", "b\nmore"), (10, 6, "ul", "-", "c"), (12, 7, "ol", ".", "n"), (14, 1, "hr", "---", ""), (15, 3, "p", "", "end"),
    ]


def test_bold_runs(spark):
    df = spark.createDataFrame([("a **b** c",), (None,), ("x" * 300_000,)], "t string")
    got = [r[0] for r in df.select(markdown.bold_runs("t")).collect()]
    assert got[:2] == [[" a **b**", " c"], [""]] and len(got[2]) == 1
    parts = df.limit(1).select(markdown.split_runs(markdown.bold_runs("t"))).first()[0]
    assert [tuple(p) for p in parts] == [(" a ", "b"), (" c", None)]


def test_record_profile(spark):
    df = spark.createDataFrame([(1, "a", None, 3)], "k int, x string, y string, z int")
    assert sorted(rows(record_profile(df, "k"))) == [(1, "x", "a"), (1, "z", "3")]


def test_lookup_leaves_out_blocks_and_loses_no_hit(spark, tmp_path):
    import random

    draw = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    data = [(i, " ".join(draw.choices(words, weights=range(1, 41), k=draw.randrange(3, 60)))) for i in range(600)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(data, "id int, t string")
    index = search.write_index(docs, "id", "t", str(tmp_path / "index"), block_docs=4)
    weights = spark.createDataFrame([(i, (i % 7) / 7) for i in range(0, 600, 2)], "id int, weight double")
    for query, k in (("w0", 5), ("w0 w1 w39", 10), ("w39", 3), ("w39 w39 w38", 500), ("none", 3), ("", 3)):
        for heavy in (None, weights):
            want = [(r.id, round(r.score, 9)) for r in search.bm25_retrieve(index, "id", query, k, heavy).collect()]
            got = [(r.id, round(r.score, 9)) for r in search.bm25_lookup(index, "id", query, k, heavy).collect()]
            assert got == want, (query, k)
    total = index["blocks"].select("block").distinct().count()
    assert search.blocks_to_read(index, "id", {"w0": 3.0}, 5).count() < total / 2


def test_saved_search_round_trip(spark):
    df = spark.createDataFrame([('{"jobTitleQuery": "(data+OR+ml)",\n "dateFetchedPastNDays": 7, "roleYoeRange": [0, 6]}',)], "t string")
    url = df.select(searches.search_url("t", "https://x.org/?searchState=").alias("url"))
    got = url.select(searches.parse_search("url").alias("s")).first().s
    assert (got.jobTitleQuery, got.dateFetchedPastNDays, got.roleYoeRange, got.locations) == ("(data+OR+ml)", 7, [0, 6], None)


def test_searches_in_chunks(spark):
    df = spark.createDataFrame([(i, i) for i in range(20)], "id int, yoe int")
    wanted = {f"s{n}": {"roleYoeRange": [n, n + 1]} for n in range(7)}
    got = searches.matching_searches(df, wanted, date(2026, 1, 1), {"yoe": "yoe"})
    assert sorted((r.id, r.search) for r in got.collect()) == sorted((i, f"s{n}") for n in range(7) for i in (n, n + 1))


def test_radius_search(spark):
    df = spark.createDataFrame([(1, 37.3, -121.9), (2, 38.6, -121.5)], "id int, lat double, lon double")
    search_ = {"locations": [{"geometry": {"location": {"lat": 37.77493, "lon": -122.41942}}, "options": {"radius": 50, "radius_unit": "miles"}}]}
    got = searches.matching_searches(df, {"bay": search_}, date(2026, 1, 1), {"lat": "lat", "lon": "lon"})
    assert [(r.id, r.search) for r in got.collect()] == [(1, "bay")]


def test_set_search_fields_filter_or_raise(spark):
    df = spark.createDataFrame([(1, "Data Scientist", "Manager", "Required"), (2, "Data Nurse", "Manager", "Preferred"),
                                (3, "Data Scientist", "Individual Contributor", "Preferred")], "id int, title string, role string, phd string")
    words = {"data AND NOT nurse": ([["data"]], ["nurse"])}
    columns = {"title": "title", "role": "role", "doctorate": "phd"}
    wanted = {"a": {"jobTitleQuery": "data AND NOT nurse", "roleTypes": ["Manager"]},
              "b": {"roleTypes": ["Individual+Contributor"], "doctorateDegreeRequirements": ["Preferred"]}}
    got = searches.matching_searches(df, wanted, date(2026, 1, 1), columns, title_words=words)
    assert sorted((r.id, r.search) for r in got.collect()) == [(1, "a"), (3, "b")]
    assert searches.matching_searches(df, {}, date(2026, 1, 1), columns).count() == 0
    for bad, given in (({"roleTypes": ["x"]}, {}), ({"unheardOf": 1}, columns), ({"jobTitleQuery": "other"}, columns)):
        with pytest.raises(ValueError):
            searches.search_predicate(bad, date(2026, 1, 1), given, words)


def test_snapshot_layout_and_inventory(spark, tmp_path):
    for day, name, body in [("2026-01-02", "ALL", "<p>a</p>"), ("2026-01-03", "NorCal", "<p>b</p>")]:
        folder = tmp_path / day / name
        folder.mkdir(parents=True)
        (folder / f"{name}.html").write_text(body)
    found = files.snapshot_scan(spark, str(tmp_path))
    assert sorted((str(r.snapshot_date), r.query, r.value) for r in found.collect()) == [
        ("2026-01-02", "ALL", "<p>a</p>"), ("2026-01-03", "NorCal", "<p>b</p>")]
    assert files.snapshot_scan(spark, str(tmp_path), "NorCal.html").count() == 1
    listed = files.file_inventory(spark, str(tmp_path), "*.html", since=1)
    assert [r["size"] for r in files.by_recency(listed).collect()] == [8, 8]
    assert files.file_inventory(spark, str(tmp_path), since="2999-01-01").count() == 0
    assert sorted(r[0] for r in listed.select(files.stem("path")).collect()) == ["ALL", "NorCal"]


def test_reference_list_and_cache(spark, tmp_path):
    (tmp_path / "cities.csv").write_text("Silicon Valley\nSan Francisco\n#County\nAlameda\n")
    assert rows(files.reference_list(spark, str(tmp_path / "cities.csv"))) == [("San Francisco",), ("Alameda",)]
    built = []

    def build():
        built.append(1)
        return spark.range(len(built))

    path = str(tmp_path / "cache")
    assert tables.cached_parquet(spark, path, build).count() == 1
    assert tables.cached_parquet(spark, path, build).count() == 1
    assert tables.cached_parquet(spark, path, build, overwrite=True).count() == 2


def test_listings_keep_the_last_snapshot(spark, tmp_path):
    from gleaner.plans.postings import listing_snapshots

    def page(pay, key="k1"):
        texts = ["2d", "Data Lead", "Oakland, California, United States", pay, "Onsite", "Full", "Co:", ": sums", "job", "SQL", "Job Posting", "9"]
        spans = "".join(f"<span>{x}</span>" for x in texts)
        return (f'<title>All (N=1)</title><div class="card"><div>{spans}</div><div><div><a href="/view/{key}">a</a>'
                '<a href="/?company=co&x=1">b</a></div></div><div class="flex justify-center space-x-2"><div><button>1</button></div>'
                '<div><button>2</button></div></div></div><div><span>About</span><a href="/about">us</a><button>3</button></div>')

    for day, body in [("2026-01-02", page("$9k/yr") + page("$7k/yr", "k2")), ("2026-01-10", page("$8k/yr"))]:
        folder = tmp_path / day / "ALL"
        folder.mkdir(parents=True)
        (folder / "ALL.html").write_text(body)
    got = listing_snapshots(spark, str(tmp_path), ["Oakland"]).collect()
    assert sorted((r.hash, r.chash, r.company, r.lower, r.hours, r.bay, r._len, str(r.snapshot_date)) for r in got) == [
        ("k1", "co", "Co", 8.0, 48, ["Oakland"], 2, "2026-01-10"), ("k2", "co", "Co", 7.0, 48, ["Oakland"], 2, "2026-01-02")]
    assert listing_snapshots(spark, str(tmp_path), ["Oakland"], keep=None).count() == 3


def test_markdown_blocks_are_cut_within_the_row(spark):
    text = "# Top\n" + "- **a:** b\n" * 20_000 + "\nend\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "\n\n")], "d int, t string")
    made = markdown.md_style(markdown.md_explode(df, "d", "t"), resume=True, pagebreak=True)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    last = made.filter("d = 1").orderBy("place").tail(2)
    assert [(r.markdown, r.place, r.line) for r in last] == [("end", 20_004, 20_003), ("", 20_005, 20_004)]
    assert {r.d for r in made.collect()} == {1}


def test_sums_before(spark):
    from gleaner.functions.values import sums_before

    sizes = [[i % 7 for i in range(1000)], [], None, [5], [1] * 129]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in sizes], "s array<int>").select(sums_before(F.col("s"))).collect()]
    assert got == [None if s is None else [sum(s[:i]) for i in range(len(s))] for s in sizes]


def test_postings_are_counted_where_their_text_lies(spark):
    docs = spark.createDataFrame([(1, "data data tools"), (1, "data"), (2, None), (None, "tools x1 ÉTÉ ét")], "id int, t string")
    postings = search.bm25_index(docs, "id", "t")["postings"]
    plan = postings._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "_text" in plan.split("Exchange")[1].split("\n")[1]
    want = search.bm25_index(docs, "id", "t", by_doc=False)["postings"]
    assert sorted(map(repr, postings.collect())) == sorted(map(repr, want.collect()))
    assert {(r["id"], r["term"], r["tf"]) for r in postings.collect()} >= {(1, "data", 3), (None, "été", 1), (None, "ét", 1)}


def test_stored_index_deals_texts_once_and_stores_postings_once(spark, tmp_path):
    import math
    import random
    from pathlib import Path

    draw = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    data = [(i % 250, " ".join(draw.choices(words, weights=range(1, 61), k=draw.randrange(0, 90)))) for i in range(300)]
    docs = spark.createDataFrame(data + [(None, "w1 w1 w2"), (None, "w2"), (400, None), (401, "")], "id int, t string")
    folder = str(tmp_path / "index")
    index = search.write_index(docs, "id", "t", folder, block_docs=8)
    want = {(r["id"], r["term"], r["tf"], r["len"]) for r in search.bm25_index(docs, "id", "t")["postings"].collect()}
    kept = index["postings"].collect()
    assert {(r["id"], r["term"], r["tf"], r["len"]) for r in kept} == want and len(kept) == len(want)
    # what lies below the folder are the postings, a row per term and the row of statistics
    terms = {r["term"]: r["df"] for r in index["terms"].collect()}
    assert sum(spark.read.parquet(str(f)).count() for f in Path(folder).iterdir()) == len(want) + len(terms) + 1
    most, best = {}, {}
    for r in kept:
        most[r["term"], r["block"]] = max(r["part"], most.get((r["term"], r["block"]), 0.0))
        best.setdefault(r["term"], []).append(r["part"])
    assert {(r["term"], r["block"]): r["most"] for r in index["blocks"].collect()} == most and index["blocks"].count() == len(most)
    champions = {}
    for r in sorted(index["champions"].collect(), key=lambda r: (r["term"], r["place"])):
        champions.setdefault(r["term"], []).append(r["part"])
    assert champions == {t: sorted(x, reverse=True)[: search.CHAMPIONS] for t, x in best.items()} and max(map(len, best.values())) > search.CHAMPIONS
    stats = index["stats"].first()
    plan = search.block_postings(docs, "id", "t", stats["n_docs"], stats["avg_len"], 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "_text" in plan.split("Exchange")[1].split("\n")[1] and plan.count("Sort [") == 1
    assert math.ceil(304 / 8) >= index["blocks"].select("block").distinct().count() > 20
