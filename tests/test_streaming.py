"""Streams against their batch twins, a repeated batch included."""

from pyspark.sql import functions as F

from gleaner.streaming.first_seen import bucket_of, compact_first_seen, first_seen, stored_keys
from gleaner.streaming.latest import compact_latest, read_latest, upsert_latest

SCHEMA = "key bigint, ts int, v string"


def land(spark, folder, n, data):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_first_seen_over_two_runs(spark, tmp_path):
    folder = str(tmp_path)
    land(spark, folder, 1, [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")])
    run = lambda: first_seen(stream(spark, folder), "key", ["ts"], f"{folder}/seen", f"{folder}/cp").awaitTermination()
    run()
    land(spark, folder, 2, [(1, 3, "x"), (3, 1, "y")])
    run()
    run()  # nothing new
    got = spark.read.parquet(f"{folder}/seen").select("key", "v").collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (2, "c"), (3, "y")]


def test_first_seen_writes_a_repeated_batch_once(spark, tmp_path):
    folder = str(tmp_path)
    land(spark, folder, 1, [(1, 1, "a"), (2, 1, "c")])
    for checkpoint in ("cp1", "cp2"):  # a lost checkpoint makes batch 0 run again
        first_seen(stream(spark, folder), "key", ["ts"], f"{folder}/seen", f"{folder}/{checkpoint}").awaitTermination()
    assert spark.read.parquet(f"{folder}/seen").count() == 2


def test_upsert_latest(spark, tmp_path):
    folder = str(tmp_path)
    land(spark, folder, 1, [(1, 1, "a"), (1, 5, "b"), (2, 1, "c")])
    land(spark, folder, 2, [(1, 3, "x"), (2, 9, "y")])
    upsert_latest(stream(spark, folder), "key", ["ts"], f"{folder}/out", f"{folder}/cp").awaitTermination()
    want = [(1, 5, "b"), (2, 9, "y")]
    assert sorted(map(tuple, read_latest(spark, f"{folder}/out", "key", ["ts"]).collect())) == want
    assert sorted(map(tuple, compact_latest(spark, f"{folder}/out", "key", ["ts"], f"{folder}/base").collect())) == want


def test_new_data_under_a_new_checkpoint_keeps_what_is_stored(spark, tmp_path):
    folder = str(tmp_path)
    for part, keys in (("one", range(10)), ("two", range(8, 15))):
        land(spark, f"{folder}/{part}", 1, [(k, k, part) for k in keys])
        source = stream(spark, f"{folder}/{part}")
        first_seen(source, "key", ["ts"], f"{folder}/seen", f"{folder}/{part}/cp1").awaitTermination()
        source = stream(spark, f"{folder}/{part}")
        upsert_latest(source, "key", ["ts"], f"{folder}/latest", f"{folder}/{part}/cp2").awaitTermination()
    seen = spark.read.parquet(f"{folder}/seen").select("key", "v").collect()
    assert sorted(map(tuple, seen)) == [(k, "one" if k < 10 else "two") for k in range(15)]
    assert read_latest(spark, f"{folder}/latest", "key", ["ts"]).count() == 15


def test_first_seen_reads_only_the_buckets_of_its_keys(spark, tmp_path):
    folder = str(tmp_path)
    land(spark, folder, 1, [(k, 1, "a") for k in range(500)])
    first_seen(stream(spark, folder), "key", ["ts"], f"{folder}/seen", f"{folder}/cp").awaitTermination()
    known = stored_keys(spark, f"{folder}/seen", "key", "bigint", [3])
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "_bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    files = spark.read.parquet(f"{folder}/seen").select(F.col("_bucket"), F.input_file_name().alias("f")).distinct()
    assert files.count() == 64 and {r["_bucket"] for r in files.collect()} == set(range(64))
    got = {r["key"] for r in known.collect()}
    assert got == {r["id"] for r in spark.range(500).filter(bucket_of("id", 64) == 3).collect()}


def test_first_seen_goes_on_after_compaction_and_replay(spark, tmp_path):
    folder = str(tmp_path)
    for n in range(3):
        land(spark, folder, n, [(k, n, f"b{n}") for k in range(n * 10, n * 10 + 20)])
    first_seen(stream(spark, folder), "key", ["ts"], f"{folder}/seen", f"{folder}/cp").awaitTermination()
    before = sorted(map(tuple, spark.read.parquet(f"{folder}/seen").select("key", "v").collect()))
    assert [k for k, _ in before] == list(range(40))
    compact_first_seen(spark, f"{folder}/seen", f"{folder}/compact")
    # all batches once more under a new checkpoint, then new keys
    first_seen(stream(spark, folder), "key", ["ts"], f"{folder}/compact", f"{folder}/cp2").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{folder}/compact").select("key", "v").collect())) == before
    land(spark, folder, 4, [(39, 9, "x"), (40, 9, "new")])
    first_seen(stream(spark, folder), "key", ["ts"], f"{folder}/compact", f"{folder}/cp2").awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{folder}/compact").select("key", "v").collect()))
    assert got == before + [(40, "new")]


def test_first_seen_keeps_one_null_key(spark, tmp_path):
    folder = str(tmp_path)
    for n in range(2):
        land(spark, folder, n, [(None, n, f"b{n}"), (n, n, f"b{n}")])
    for checkpoint in ("cp", "cp2"):
        first_seen(stream(spark, folder), "key", ["ts"], f"{folder}/seen", f"{folder}/{checkpoint}").awaitTermination()
    keys = [r["key"] for r in spark.read.parquet(f"{folder}/seen").collect()]
    assert len(keys) == 3 and set(keys) == {None, 0, 1}


def test_compaction_leaves_few_files(spark, tmp_path):
    folder = str(tmp_path)
    for n in range(4):
        land(spark, folder, n, [(k, n, "v") for k in range(n * 50, n * 50 + 50)])
    first_seen(stream(spark, folder), "key", ["ts"], f"{folder}/seen", f"{folder}/cp", buckets=4).awaitTermination()
    files = lambda p: spark.read.parquet(p).select(F.input_file_name()).distinct().count()
    compact_first_seen(spark, f"{folder}/seen", f"{folder}/compact")
    assert files(f"{folder}/compact") < files(f"{folder}/seen")
    assert spark.read.parquet(f"{folder}/compact").count() == 200
