"""State as a log of deltas: five batches equal one, replays change nothing, a batch writes what it adds."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lurewatch.operators import style as STY
from lurewatch.operators.history import build_history
from lurewatch.operators.threads import quote_match, shingle_index
from lurewatch.plans.q_streams import landed
from lurewatch.plans.views import view
from lurewatch.streaming import jobs as J

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


@pytest.fixture(scope="module")
def log(spark):
    return view(spark, SF, "mail_log").withColumn("ts", F.col("ts").cast("timestamp")).cache()


def batches(df, n):
    return [df.where(F.pmod(F.xxhash64("event_id"), F.lit(n)) == i) for i in range(n)]


def test_history_of_many_batches_with_replays(spark, log, tmp_path):
    state = J.history_state(f"{tmp_path}/h", fan=2, buckets=4)
    each = J.history_update(state)
    parts = batches(log, 9)
    for n, part in enumerate(parts):
        each(part, n)
        each(part, n)  # a replay
    cols = ["address", "received", "sent_to", "first_seen", "last_seen"]
    assert rows_of(state.read(spark).select(*cols)) == rows_of(build_history(log, "address").select(*cols))
    asked = log.select("address").limit(3)
    assert rows_of(state.lookup(asked, 9).select(*cols)) == rows_of(build_history(log, "address").join(asked.distinct(), "address", "left_semi").select(*cols))
    assert state.cover(spark, 0, 8) == [(0, 7), (8, 8)]
    assert (2, 3) not in state.segments(spark)  # covered, so deleted


def test_bytes_follow_the_batch(spark, tmp_path):
    state = J.history_state(f"{tmp_path}/h", fan=100, buckets=1)
    mail = spark.range(30_000).select(F.md5(F.col("id").cast("string")).alias("address"), F.lit("received").alias("direction"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    J.history_update(state)(mail, 0)
    J.history_update(state)(mail.limit(3), 1)
    assert size_of(f"{tmp_path}/h/s=1-1") < size_of(f"{tmp_path}/h/s=0-0") / 20


def test_a_missing_batch_is_an_error(spark, log, tmp_path):
    state = J.history_state(f"{tmp_path}/h")
    assert state.read(spark).count() == 0
    with pytest.raises(RuntimeError, match="batch 0 is missing"):
        J.history_update(state)(log, 3)


def test_threads_in_five_batches(spark, tmp_path):
    rows = view(spark, SF, "threads")
    stream = landed(spark, rows, "sent_at", str(tmp_path))
    state = J.thread_state(f"{tmp_path}/index", fan=2, buckets=4)
    J.run(stream, J.thread_update(str(tmp_path), state), f"{tmp_path}/cp")
    got = spark.read.parquet(f"{tmp_path}/verified").select("message_id", "q_shingles", "q_found")
    assert rows_of(got) == rows_of(quote_match(rows, shingle_index(rows)).select("message_id", "q_shingles", "q_found"))
    assert len(os.listdir(f"{tmp_path}/verified")) >= 5
    cols = ["mailbox", "shingle", "owner"]
    assert rows_of(state.read(spark).select(*cols)) == rows_of(shingle_index(rows).select(*cols))


def test_style_in_batches(spark, tmp_path):
    start = datetime(2024, 1, 1)
    text = "The report is ready, and we will send it to you when the team has read all of it. "
    rows = [(i, f"u{i % 3}", start + timedelta(hours=i), text * (6 + i % 4) + ("Hello! " * (i % 3) * 5)) for i in range(60)]
    mail = spark.createDataFrame(rows, "message_id bigint, address string, sent_at timestamp, body string")
    state = J.style_state(f"{tmp_path}/p", fan=2, buckets=4)
    each = J.style_update(str(tmp_path), state, lambda b: b.where("message_id % 5 <> 0").select("message_id"))
    for n in range(4):
        each(mail.where(F.col("message_id") % 4 == n), n)
    got, want = (STY.profile(STY.trait_rows(mail.where("message_id % 5 <> 0"), "body", "address")) if x else STY.from_moments(state.read(spark), "address") for x in (0, 1))
    for a, b in zip(rows_of(got), rows_of(want)):
        assert a[0] == b[0] and a[1] == b[1] and a[2] == pytest.approx(b[2]) and a[3] == pytest.approx(b[3], abs=1e-6)
    seen = spark.read.parquet(f"{tmp_path}/scored").orderBy("message_id").collect()
    assert len(seen) == 60 and max(r["messages_before"] for r in seen) > 8 and any(r["gap"] for r in seen)


def test_dense_index(spark):
    from lurewatch.operators.skew import dense_index
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("v")).repartition(7)
    got = {r["v"]: r["place"] for r in dense_index(df, [F.col("v")], "place").collect()}
    assert got == {v: i for i, v in enumerate(sorted(got))} and len(got) == 1000


@pytest.mark.parametrize("parts", [None, 3])
def test_stream_reads_tables_of_one_file_and_of_many(spark, tmp_path, parts):
    from lurewatch.plans.q_streams import DOCS
    rows = [(i, f"text {i}", "en", "web", 6) for i in range(40)]
    spark.createDataFrame(rows, DOCS).repartition(parts or 1).write.parquet(f"{tmp_path}/{'d/documents.parquet' if parts else 'w'}")
    if not parts:
        (tmp_path / "d").mkdir()
        next((tmp_path / "w").glob("part-*.parquet")).rename(tmp_path / "d" / "documents.parquet")
    (tmp_path / "d" / "labels.parquet").mkdir()
    J.to_parquet(J.table_source(spark, f"{tmp_path}/d", "documents", DOCS), f"{tmp_path}/rows", f"{tmp_path}/cp")
    assert rows_of(spark.read.parquet(f"{tmp_path}/rows")) == sorted(rows, key=repr)


def test_scored_batches_of_one_file_use_all_cores(spark, tmp_path, monkeypatch):
    """Mail lands as one file; its rows are dealt out before any text is read, and none is lost."""
    df = spark.createDataFrame([(i, f"m{i}") for i in range(64)], "message_id bigint, body string").coalesce(1)
    seen = []

    def scored(batch, model, vectors, **more):
        seen.append((batch.rdd.getNumPartitions(), batch.count()))
        return batch.select("message_id", F.lit("LOW").alias("band"), F.lit(0.0).alias("severity"), F.lit("").alias("vector"), F.lit(0.1).alias("p_final"), F.lit("").alias("sender"))
    monkeypatch.setattr(J, "score_by", scored)
    J.alerts(f"{tmp_path}/a", None)(df, 0)
    assert seen == [(spark.sparkContext.defaultParallelism, 64)]


def test_a_landed_file_of_one_row_group_is_dealt_out(spark, tmp_path, monkeypatch):
    """Such a file is cut into many splits, but one of them holds all rows; and the address is added after the rows are dealt out."""
    words = " ".join(f"word{i % 17} runs, and it stops." for i in range(40))
    spark.range(400).select(F.col("id").alias("message_id"), F.concat(F.col("id").cast("string"), F.lit(" "), F.lit(words)).alias("body")).coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = []

    def rows(df, text, *keep, plain=STY.trait_rows):
        seen.append([r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()])
        return plain(df, text, *keep)
    monkeypatch.setattr(STY, "trait_rows", rows)
    old = spark.conf.get("spark.sql.files.openCostInBytes"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
        state = J.style_state(f"{tmp_path}/p")
        each = J.style_update(str(tmp_path), state, lambda b: b.select("message_id"), named=lambda b: b.withColumn("address", F.lit("a.example")))
        J.run(J.source(spark, f"{tmp_path}/in", "message_id bigint, body string"), each, f"{tmp_path}/cp")
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old[0])
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[1])
    assert len(seen) == 1 and len(seen[0]) > 1 and max(seen[0]) < 400 and sum(seen[0]) == 400
    assert [(r.address, r.m[0]) for r in state.read(spark).collect()] == [("a.example", 400.0)]
