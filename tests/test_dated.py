"""Dated tables, stored sketches, JSON without a schema, paths."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gleaner.functions.variants import json_fields, json_get, json_kind, json_value
from gleaner.operators.sketches import daily_sketches, error_bound, exact_counts, merged_counts
from gleaner.plans import postings as plans
from gleaner.sources.dated import last_seen, read_days, write_days
from gleaner.sources.tables import path_exists


def days(spark, rows):
    return spark.createDataFrame(rows, "day date, key bigint, pos int, v string")


def d(n):
    return dt.date(2026, 1, n)


def test_days_out_of_order_and_taken_again(spark, tmp_path):
    store = str(tmp_path / "store")
    write_days(days(spark, [(d(3), 1, 0, "c"), (d(3), 2, 0, "c")]), store, "day")
    write_days(days(spark, [(d(1), 1, 0, "a"), (d(1), 3, 0, "a"), (d(1), 3, 1, "b")]), store, "day")
    view = lambda **kw: sorted(map(tuple, last_seen(spark, store, ["key"], "day", ["pos"], **kw).select("key", "v").collect()))
    assert view() == [(1, "c"), (2, "c"), (3, "b")]
    assert view(until="2026-01-02") == [(1, "a"), (3, "b")]
    write_days(days(spark, [(d(1), 4, 0, "z")]), store, "day")  # the day as a whole, others stay
    assert view() == [(1, "c"), (2, "c"), (4, "z")]
    write_days(days(spark, [(d(1), 4, 0, "z")]), store, "day")
    assert view() == [(1, "c"), (2, "c"), (4, "z")]
    assert read_days(spark, store, "day").count() == 3


def test_days_without_a_date_or_without_rows(spark, tmp_path):
    store = str(tmp_path / "store")
    write_days(days(spark, [(None, 1, 0, "n"), (d(2), 1, 0, "b"), (None, 2, 0, "n")]), store, "day")
    write_days(days(spark, []), store, "day")
    got = sorted(map(tuple, last_seen(spark, store, ["key"], "day", ["pos"]).select("key", "v").collect()))
    assert got == [(1, "b"), (2, "n")]


def test_span_prunes_folders(spark, tmp_path):
    store = str(tmp_path / "store")
    write_days(days(spark, [(d(n), n, 0, "v") for n in range(1, 9)]), store, "day")
    found = read_days(spark, store, "day", since="2026-01-07")
    assert "PartitionFilters: [isnotnull(day" in found._jdf.queryExecution().executedPlan().toString()
    assert found.select(F.input_file_name()).distinct().count() == 2


def listing(*keys):
    texts = ["3d", "Nurse", "Oakland, California, United States", "$10k-$30k/yr", "Onsite", "Full Time", "Acme:", ": makes", "b", "SQL", "Job Posting", "1 view"]
    spans = "".join(f"<span>{x}</span>" for x in texts)
    return "\n".join(f'<div class="card"><div>{spans}</div><div><div><a href="/view/{k}">x</a><a href="/?company=c&s=1">y</a></div></div></div>' for k in keys)


def test_listing_pages_are_dealt_by_their_bytes(spark, tmp_path, monkeypatch):
    root = tmp_path / "pages"
    for n in (1, 2):
        for q in ("all", "near"):
            for page in range(10):
                (root / f"2026-01-0{n}" / q).mkdir(parents=True, exist_ok=True)
                (root / f"2026-01-0{n}" / q / f"{page}.html").write_text(listing(f"{q}{page}", f"{q}{page}x", f"{n}-{page}"))
    (root / "undated").mkdir()
    (root / "undated" / "0.html").write_text(listing("u"))

    def stored(to):
        plans.store_listings(spark, str(root), str(tmp_path / to), ["Oakland"])
        seen = plans.reconciled_listings(spark, str(tmp_path / to))
        return sorted(str(tuple(r)) for r in seen.select("hash", "snapshot_date", "query", "card", "hours", "title").collect())

    whole = stored("whole")
    assert len(whole) == 2 * 20 + 2 * 10 + 1
    assert len(list((tmp_path / "whole").rglob("*.parquet"))) == 3  # a file for each day, one without
    monkeypatch.setattr(plans, "TASK_BYTES", 4000)  # some pages
    assert stored("parts") == whole
    for n in (1, 2):
        files = list((tmp_path / "parts" / f"snapshot_date=2026-01-0{n}").glob("*.parquet"))
        assert 4 <= len(files) <= 15
        assert max(r["count"] for r in spark.read.parquet(*map(str, files)).groupBy(F.input_file_name()).count().collect()) < 30


def test_listings_of_an_empty_folder(spark, tmp_path):
    for n, keys in ((1, ["a"]), (2, [])):
        day = tmp_path / f"2026-01-0{n}" / "all"
        day.mkdir(parents=True)
        if keys:
            (day / "0.html").write_text(listing(*keys))
        plans.store_listings(spark, str(tmp_path / f"2026-01-0{n}"), str(tmp_path / "store"), ["Oakland"])
    assert [r["hash"] for r in plans.reconciled_listings(spark, str(tmp_path / "store")).collect()] == ["a"]


def test_sketches_merge_like_one_count(spark):
    rows = spark.range(200_000).select(
        (F.col("id") % 10).cast("int").alias("day"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"),
        F.when(F.col("id") % 11 != 0, F.col("id") % 70_000).alias("k"),
    )
    merged = {r["g"]: r for r in merged_counts(daily_sketches(rows, ["day", "g"], "k"), ["g"]).collect()}
    exact = {r["g"]: r for r in exact_counts(rows, ["g"], "k").collect()}
    for g in ("a", "b"):
        assert merged[g]["n_rows"] == exact[g]["n_rows"]
        assert abs(merged[g]["n_keys"] - exact[g]["n_keys"]) <= error_bound() * exact[g]["n_keys"]


def test_error_bound_over_many_sets(spark):
    """The stated bound of four deviations over 200 sets of 20,000 keys, at a coarse sketch."""
    rows = spark.range(4_000_000).select((F.col("id") % 200).alias("g"), F.col("id").alias("k"), F.lit(0).alias("day"))
    got = merged_counts(daily_sketches(rows, ["day", "g"], "k", lg_k=10), ["g"]).collect()
    errors = [abs(r["n_keys"] - 20_000) / 20_000 for r in got]
    assert len(errors) == 200 and max(errors) <= error_bound(10)
    assert sum(e <= error_bound(10, 2.0) for e in errors) >= 180


def test_sketch_of_nulls_and_of_no_rows(spark):
    none = spark.createDataFrame([(1, None), (1, None)], "g int, k string")
    assert [tuple(r) for r in merged_counts(daily_sketches(none, ["g"], "k"), ["g"]).collect()] == [(1, 2, 0)]
    assert merged_counts(daily_sketches(none.limit(0), ["g"], "k"), ["g"]).count() == 0


TEXTS = {
    1: '{"a": {"b": [1, "x"]}, "n": 2.5}', 2: "[1, null, {}]", 3: "not json", 4: None, 5: "", 6: '"s"', 7: "null", 8: '{"a": "7"}',
    9: json.dumps({"a": "y" * 300_000}),
}


@pytest.fixture(scope="module")
def shapes(spark):
    rows = spark.createDataFrame(list(TEXTS.items()), "id int, t string")
    return rows.select("id", json_value("t").alias("value"))


def test_paths_into_unknown_shapes(shapes):
    v = F.col("value")
    got = {r["id"]: r for r in shapes.select(
        "id", json_get(v, "$.a.b[1]").alias("deep"), json_get(v, "$.a", "int").alias("a"), json_get(v, "$.n", "double").alias("n"),
        json_kind(v).alias("kind"), F.length(json_get(v, "$.a")).alias("size"),
    ).collect()}
    assert got[1]["deep"] == "x" and got[1]["n"] == 2.5 and got[1]["a"] is None
    assert got[8]["a"] == 7 and got[9]["size"] == 300_000 and got[9]["a"] is None
    kinds = {i: r["kind"] for i, r in got.items()}
    assert kinds == {1: "object", 2: "array", 3: None, 4: None, 5: None, 6: "string", 7: "void", 8: "object", 9: "object"}


def test_fields_of_unknown_shapes(shapes):
    got = json_fields(shapes, "value").select("id", "pos", "key", json_kind(F.col("value")).alias("kind")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [
        (1, 0, "a", "object"), (1, 1, "n", "decimal"), (2, 0, None, "bigint"), (2, 1, None, "void"), (2, 2, None, "object"),
        (8, 0, "a", "string"), (9, 0, "a", "string"),
    ]))


def test_path_exists(spark, tmp_path):
    assert not path_exists(spark, str(tmp_path / "none"))
    assert path_exists(spark, str(tmp_path))
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert path_exists(spark, str(tmp_path / "t")) and path_exists(spark, str(tmp_path / "t" / "_SUCCESS"))
    assert not path_exists(spark, str(tmp_path / "t" / "_NONE"))
