"""Streams end with the results of their batch forms."""

from pyspark.sql import functions as F

from waymill.operators import runs
from waymill.streaming import rollouts as S


def finished(stream, name, spark, mode, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def source(spark, tmp_path, df, parts):
    for k in range(parts):
        df.filter(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_streaks_equal_batch(spark, tmp_path):
    names = ["zero_variance", "zero_variance", "invalid", "zero_variance", "usable", "zero_variance"] * 3
    rows = [(f"r{k}", i, names[(i + k) % len(names)], i // 6) for k in range(3) for i in range(18)]
    df = spark.createDataFrame(rows, "run string, grp long, outcome string, part int")
    got = finished(S.no_signal_streaks(source(spark, tmp_path, df, 3)), "streaks", spark, "append", tmp_path)
    want = runs.streaks(df.drop("part"), "run", ["grp"], "outcome", "zero_variance", "usable")
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in want.select("run", "grp", "outcome", "streak").collect())


def test_counts_and_unseen(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    df = e.withColumn("part", (F.col("event_id") % 2).cast("int"))
    stream = source(spark, tmp_path, df, 2)
    got = finished(S.outcome_counts(stream, "ts", "event_type", delay="3650 days"), "counts", spark, "complete", tmp_path)
    want = {r.event_type: r["count"] for r in e.groupBy("event_type").count().collect()}
    assert {r.event_type: r.n for r in got.groupBy("event_type").agg(F.sum("n").alias("n")).collect()} == want
    twice = source(spark, tmp_path, df.withColumn("part", F.lit(0)), 1)
    once = finished(S.unseen(twice, "event_id", "ts", "3650 days"), "once", spark, "append", tmp_path)
    assert once.count() == e.count()


def test_streak_with_history_over_restarts(spark, tmp_path):
    """A run of outcomes in five files, one micro-batch each, and a restart from the checkpoint in between: as one loop over all."""
    import random

    from waymill.streaming.signals import signal_streaks

    kind = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    key = "spark.sql.streaming.stateStore.providerClass"
    had = spark.conf.get(key, None)
    spark.conf.set(key, kind)
    try:
        r = random.Random(4)
        given = [(run, g, r.choice(["zero_variance"] * 5 + ["usable", "invalid"]), r.choice([None, 0.5, 1.0])) for run in ("a", "b") for g in range(30)]
        schema = "run string, grp long, outcome string, reward double"
        src, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
        for part in range(5):
            spark.createDataFrame([x for x in given if x[1] // 6 == part], schema).coalesce(1).write.mode("append").parquet(src)
            if part in (1, 4):
                stream = signal_streaks(spark.readStream.schema(schema).parquet(src), threshold=4)
                q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
                q.awaitTermination(180)
        want = []
        for run in ("a", "b"):
            streak, held = 0, []
            for _, g, o, reward in (x for x in given if x[0] == run):
                if o == "usable":
                    streak, held = 0, []
                elif o == "zero_variance":
                    streak, held = streak + 1, [*held, (g, reward)][-4:]
                want.append((run, g, o, streak, streak >= 4, held))
        got = sorted((x.run, x.grp, x.outcome, x.streak, x.stop, [tuple(h) for h in x.history]) for x in spark.read.parquet(out).collect())
        assert got == sorted(want) and any(x[4] for x in want)
    finally:
        spark.conf.set(key, had) if had else spark.conf.unset(key)
