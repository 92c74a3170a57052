import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lynceus.operators.debounce import debounce
from lynceus.operators.throttle import NEVER, after, composed, decide, openings, state_after, throttle, transfer, window_openings
from lynceus.scale import work_dir
from lynceus.streaming.debounce import debounce_stream
from lynceus.streaming.throttle import throttle_stream

T0 = datetime(2024, 1, 1)


def fold(times, limit, window):
    start, used, out = None, 0, []
    for t in times:
        if start is None:
            start, used = t, 0
        if t - start >= window:
            start, used = t, 1
            out.append(True)
        elif used < limit:
            used += 1
            out.append(True)
        else:
            out.append(False)
    return out, start, used


@pytest.mark.parametrize("seed", range(30))
def test_transfer_equals_fold(seed):
    rnd = random.Random(seed)
    window, limit, blocks = 10, rnd.choice([1, 2, 3]), 4
    span = window * blocks
    times = sorted(rnd.randrange(0, 400) for _ in range(rnd.choice([5, 50, 300])))
    expected, _, _ = fold(times, limit, window)
    got, start, used, seen = [], NEVER, 0, set()
    for b in range(0, 400 // span + 1):
        t = np.array([x for x in times if x // span == b], dtype=np.int64)
        if not len(t):
            continue
        got += list(decide(t, start, used, window, limit))
        distinct = np.unique(t)
        steps = transfer(distinct, int(distinct[0]), window)
        seen |= set(openings(distinct, start, window))
        before, (start, used) = start, state_after(t, start, used, window, limit)
        assert after(steps, before, window) == start
    assert got == expected
    chain = [times[0]]
    for x in times:
        if x - chain[-1] >= window:
            chain.append(x)
    assert sorted(seen) == chain


@pytest.mark.parametrize("seed", range(30))
def test_composed_blocks_are_one_block(seed):
    """Blocks of any length, also much shorter than a window, composed in any grouping."""
    rnd = random.Random(seed)
    window = 20
    times = np.array(sorted(rnd.sample(range(400), rnd.choice([3, 40, 150]))), np.int64)
    cuts = sorted(rnd.sample(range(1, len(times)), min(len(times) - 1, rnd.choice([1, 5, 30]))))
    blocks = [b for b in np.split(times, cuts) if len(b)]
    steps = [transfer(b, int(b[0]), window) for b in blocks]
    while len(steps) > 1:
        i = rnd.randrange(len(steps) - 1)
        steps[i : i + 2] = [composed(steps[i], steps[i + 1], window)]
    # a window before the first time is open until it has passed
    for start in [NEVER, *range(int(times[0]) - 2 * window, int(times[0]))]:
        now = start
        for t in times.tolist():
            if t >= now + window:
                now = t
        assert after(steps[0], start, window) == now


@pytest.mark.parametrize("block_times, fan_in", [(1, 2), (3, 4), (4096, 16)])
def test_openings_of_a_hot_key(spark, block_times, fan_in):
    rnd = random.Random(block_times)
    times = {"hot": sorted(rnd.sample(range(3000), 700)), "b": [5, 9, 40], "c": [7]}
    df = spark.createDataFrame([(k, t) for k, ts in times.items() for t in ts for _ in range(rnd.randint(1, 2))], "key string, t bigint")
    got = window_openings(df, 30, block_times, fan_in).collect()
    expected = []
    for k, ts in times.items():
        now = NEVER
        for t in ts:
            if t >= now + 30:
                now = t
                expected.append((k, t))
    assert sorted(map(tuple, got)) == sorted(expected)
    assert window_openings(df.limit(0), 30, block_times, fan_in).collect() == []


def requests(spark, seed=1, n=600):
    rnd = random.Random(seed)
    rows = [
        (i, "hot" if rnd.random() < 0.4 else f"k{rnd.randrange(20)}", T0 + timedelta(seconds=rnd.randrange(0, 7200)))
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, "id BIGINT, ip STRING, ts TIMESTAMP")


def brute(rows, limit, seconds):
    out = {}
    for ip in {r[1] for r in rows}:
        own = sorted((r[2], r[0]) for r in rows if r[1] == ip)
        flags, _, _ = fold([(t - T0).total_seconds() for t, _ in own], limit, seconds)
        out.update({i: f for (_, i), f in zip(own, flags)})
    return out


def test_throttle_batch(spark):
    rows, df = requests(spark)
    for max_bytes in (0, 1 << 20):
        got = throttle(df, "ip", "ts", "id", 3, 60_000_000, block_times=7, max_bytes=max_bytes)
        assert {r["id"]: r["allowed"] for r in got.collect()} == brute(rows, 3, 60)
        assert got.columns == ["id", "ip", "ts", "allowed"]


def test_requests_without_a_key_share_one(spark):
    rows = [(i, None, T0 + timedelta(seconds=i)) for i in range(20)]
    df = spark.createDataFrame(rows, "id BIGINT, ip STRING, ts TIMESTAMP")
    got = throttle(df, "ip", "ts", "id")
    assert sorted(r["id"] for r in got.where("allowed").collect()) == list(range(10))
    assert got.count() == 20


def test_throttle_admits_at_most_the_limit_per_minute(spark):
    rows = [(i, "a", T0 + timedelta(milliseconds=100 * i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id BIGINT, ip STRING, ts TIMESTAMP")
    got = throttle(df, "ip", "ts", "id").where("allowed").count()
    assert got == 20


def test_throttle_stream_equals_batch(spark):
    rows, df = requests(spark, seed=2)
    df = df.selectExpr(
        "*", "IF(id % 3 = 0, NULL, 9007199254740993 + id) AS big", "IF(id % 5 = 0, DOUBLE('NaN'), id / 7) AS share",
        "CAST(id AS DECIMAL(20, 3)) / 7 AS part", "DATE'2001-02-03' + CAST(id AS INT) AS day", "ts + INTERVAL 1 MICROSECOND AS seen",
        "TIMESTAMP_NTZ'2001-01-01 00:00:00.000001' AS local", "concat('\"é\\n{', id) AS note", "id % 2 = 0 AS even",
    )
    src = work_dir(spark, "src")
    cut = F.lit(T0 + timedelta(hours=1))
    df.where(F.col("ts") < cut).coalesce(1).write.parquet(f"{src}/a")
    df.where(F.col("ts") >= cut).coalesce(1).write.parquet(f"{src}/b")
    stream = (
        spark.readStream.schema(df.schema).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", 1).parquet(src)
    )
    out = throttle_stream(stream, "ip", "ts", "id", limit=3)
    q = (
        out.writeStream.format("parquet").option("path", f"{src}-out")
        .option("checkpointLocation", f"{src}-cp").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    written = spark.read.parquet(f"{src}-out")
    assert {r["id"]: r["allowed"] for r in written.collect()} == brute(rows, 3, 60)
    assert out.columns == [*df.columns, "allowed"] and out.drop("allowed").dtypes == df.dtypes
    assert written.drop("allowed").exceptAll(df).count() == df.exceptAll(written.drop("allowed")).count() == 0
    with pytest.raises(ValueError, match="nested"):
        throttle_stream(stream.withColumn("nested", F.struct("id")), "ip", "ts", "id")


def burst_ends(rows, gap):
    out = set()
    for ip in {r[1] for r in rows}:
        own = sorted((r[2], r[0]) for r in rows if r[1] == ip)
        for (t, i), nxt in zip(own, own[1:] + [None]):
            if nxt is None or (nxt[0] - t).total_seconds() > gap:
                out.add(i)
    return out


def test_debounce_batch_and_stream(spark):
    rnd = random.Random(3)
    rows = [
        (i, rnd.choice(["a", "a", "b"]), T0 + timedelta(milliseconds=rnd.randrange(0, 400) * 100))
        for i in range(80)
    ]
    df = spark.createDataFrame(rows, "id BIGINT, ip STRING, ts TIMESTAMP").withColumn(
        "code", F.concat(F.lit("v"), F.col("id").cast("string"))
    )
    expected = burst_ends(rows, 1.5)
    got = debounce(df, "ip", "ts", "id")
    assert got.columns == df.columns
    assert {r["id"] for r in got.collect()} == expected
    assert all(r["code"] == f"v{r['id']}" for r in got.collect())

    src = work_dir(spark, "changes")
    late = spark.createDataFrame([(999, "z", T0 + timedelta(days=1), "end")], df.schema)
    df.unionByName(late).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = (
        debounce_stream(stream, "ip", "ts", "id").writeStream.format("parquet")
        .option("path", f"{src}-out").option("checkpointLocation", f"{src}-cp")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    assert {r["id"] for r in spark.read.parquet(f"{src}-out").collect()} - {999} == expected
