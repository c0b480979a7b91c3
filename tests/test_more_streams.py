"""The stateful gap stream against the batch operator, with a retried batch and a late row."""

import shutil
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import governance
from corpuslens.streaming import jobs

SCHEMA = "query string, created_at timestamp, intent string, domains string, decision string"
T0 = datetime(2024, 1, 1)


def at(hours):
    return T0 + timedelta(hours=hours)


BATCHES = [
    [("crack wall", at(0), "a", "x", None), ("wall crack", at(1), "b", "y", None), ("roof", at(2), "a", "x", None)],
    [("roof", at(30), "c", "z", None), ("crack wall", at(31), None, None, "accepted"), ("never asked", at(31), None, None, "rejected")],
    [("crack wall", at(60), "d", "w", None), ("roof", at(1), "late", "late", None), ("floor", at(61), "e", "v", None), ("", at(61), "e", "v", None)],
]


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def rows(df):
    return sorted((r["query_key"], r["n"], r["last_asked_at"], r["status"], r["query"], r["intent"], r["domains"]) for r in df.collect())


def test_three_batches_equal_the_batch_operator(spark, tmp_path, rocks):
    src, store, check = (str(tmp_path / x) for x in ("src", "store", "check"))
    empty = spark.createDataFrame([], f"query_key string, {jobs.GAP}")
    want, latest = empty, ("query", "intent", "domains")
    for i, rows_ in enumerate(BATCHES):
        spark.createDataFrame(rows_, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        log = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        jobs.stateful_gaps(log, store, check, late="10 hours").awaitTermination()
        on_time = spark.createDataFrame([r for r in rows_ if r[2] != "late"], SCHEMA)
        want = governance.capture_gaps(want, on_time.where("decision IS NULL"), latest)
        decided = on_time.where("decision IS NOT NULL").select(jobs.T.token_key(F.col("query")).alias("query_key"), "decision")
        want = want.join(decided, "query_key", "left").withColumn("status", F.coalesce("decision", "status")).drop("decision")
        want = spark.createDataFrame(want.collect(), want.schema)
        assert rows(jobs.gaps_so_far(spark, store)) == rows(want), i
    assert {r[0]: (r[1], r[3]) for r in rows(want)}["crack wall"] == (2, "accepted")
    # the last batch is retried: its commit is gone, its folder is written again, nothing counts twice
    commits = sorted(int(p.name) for p in Path(check, "commits").iterdir() if p.name.isdigit())
    for name in (str(commits[-1]), f".{commits[-1]}.crc"):
        Path(check, "commits", name).unlink(missing_ok=True)
    jobs.stateful_gaps(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src), store, check, late="10 hours").awaitTermination()
    assert rows(jobs.gaps_so_far(spark, store)) == rows(want)
    shutil.rmtree(check)


def test_decided_gaps_are_forgotten(spark, tmp_path, rocks):
    src, store, check = (str(tmp_path / x) for x in ("src", "store", "check"))
    for rows_ in ([("roof", at(0), "a", "x", None), ("roof", at(1), None, None, "rejected")], [("other", at(200), "a", "x", None)], [("other", at(201), "a", "x", None)], [("roof", at(300), "b", "y", None)]):
        spark.createDataFrame(rows_, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        log = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        jobs.stateful_gaps(log, store, check, late="1 hour", kept=timedelta(hours=48)).awaitTermination()
    got = {r[0]: (r[1], r[3], r[5]) for r in rows(jobs.gaps_so_far(spark, store))}
    assert got == {"roof": (1, "open", "b"), "other": (2, "open", "a")}


def run(stream, spark, tmp_path, name, mode="append"):
    """All rows a stream gives, batch by batch."""
    out = str(tmp_path / name)

    def keep(batch, n):
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{out}-check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


LOG = "user_id string, created_at timestamp, answered boolean, confidence double, latency_ms int"


def log_files(spark, tmp_path, *batches):
    for rows_ in batches:
        spark.createDataFrame(rows_, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))


def test_sliding_windows_equal_a_batch(spark, tmp_path):
    rows_ = [("u", T0 + timedelta(minutes=10 * i), i % 2 == 0, 0.5, 100) for i in range(12)]
    log = log_files(spark, tmp_path, rows_, [("u", at(50), True, 0.5, 100)], [("u", at(60), True, 0.5, 100)])
    got = run(jobs.windowed_metrics(log, "1 hour", "30 minutes"), spark, tmp_path, "sliding")
    counts = {r["start"]: (r["n_queries"], r["n_unanswered"]) for r in got.collect() if r["start"] < at(3)}
    want = {}
    for k in range(-1, 4):
        start = T0 + timedelta(minutes=30 * k)
        inside = [r for r in rows_ if start <= r[1] < start + timedelta(hours=1)]
        if inside:
            want[start] = (len(inside), sum(not r[2] for r in inside))
    assert counts == want


def test_sessions_and_late_rows(spark, tmp_path):
    first = [("u", at(0), True, 0.5, 1), ("u", T0 + timedelta(minutes=20), False, 0.5, 1), ("v", T0 + timedelta(minutes=10), True, 0.5, 1), ("u", at(2), True, 0.5, 1)]
    log = log_files(spark, tmp_path, first, [("u", at(40), True, 0.5, 1)], [("u", at(41), True, 0.5, 1)], [("u", at(1), True, 0.5, 1), ("v", at(80), True, 0.5, 1)])
    got = run(jobs.sessions(log), spark, tmp_path, "sessions")
    early = sorted((r["user_id"], r["start"], r["n_queries"], r["n_unanswered"]) for r in got.where(F.col("start") < F.lit(at(30))).collect())
    assert early == [("u", at(0), 2, 1), ("u", at(2), 1, 0), ("v", T0 + timedelta(minutes=10), 1, 0)]  # the row of hour 1 came too late


def test_stream_keeps_the_first_of_each_hash(spark, tmp_path):
    schema = "kb_id string, file_hash string, created_at timestamp"
    for rows_ in ([("a", "x", at(0)), ("a", "x", at(1)), ("b", "x", at(1))], [("a", "x", at(2)), ("a", "y", at(2))]):
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "docs"))
    got = run(jobs.deduplicated(docs), spark, tmp_path, "first")
    assert sorted((r["kb_id"], r["file_hash"]) for r in got.collect()) == [("a", "x"), ("a", "y"), ("b", "x")]
