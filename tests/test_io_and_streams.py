"""Files, sinks, and streams that must equal their batch form."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ticklens.config import AlertConfig, FeatureConfig, RankConfig, SplitConfig
from ticklens.operators import alerts, ranking
from ticklens.operators.rolling import feature_snapshots
from ticklens.operators.thin import thin_by_gap
from ticklens.sources import readers, writers
from ticklens.streaming import feeds, live, state


def stream_of(spark, folder, df, parts, schema):
    """Write ``df`` in ts order as several files and read them one per micro-batch."""
    rows = df.orderBy("ts").collect()
    step = -(-len(rows) // parts)
    for i in range(parts):
        piece = rows[i * step : (i + 1) * step]
        if piece:
            spark.createDataFrame(piece, df.schema).coalesce(1).write.mode("append").parquet(f"{folder}/p{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/p*")


def drain(stream, folder, name):
    q = (
        stream.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", f"{folder}/cp_{name}").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_thin_stream(spark, tmp_path):
    rng = random.Random(1)
    rows = sorted({(rng.choice("ab"), rng.randrange(30_000)) for _ in range(300)})
    df = spark.createDataFrame(rows, "symbol string, ts long")
    s = stream_of(spark, f"{tmp_path}/in", df, 5, df.schema)
    got = drain(state.thin_stream(feeds.with_event_time(s), "symbol", 700), tmp_path, "thin_out")
    want = thin_by_gap(df, ["symbol"], "ts", 700)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_hysteresis_and_alert_streams(spark, tmp_path):
    rng = random.Random(2)
    rows, now = [], {}
    for t in range(1_000, 90_000, 1_000):
        for s in "abc":
            if rng.random() < 0.2:
                now[s] = rng.choice(["TRADEABLE", "TRAP", "DATA_ISSUE", "DEAD"])
            rows.append((s, t, now.get(s, "DEAD"), now.get(s) in ("TRADEABLE", "TRAP")))
    df = spark.createDataFrame(rows, "symbol string, ts long, status string, member boolean")
    s = stream_of(spark, f"{tmp_path}/in", df, 4, df.schema)
    got = drain(state.hysteresis_stream(feeds.with_event_time(s), RankConfig()), tmp_path, "hyst_out")
    want = ranking.hysteresis(df.select("symbol", "ts", "member"), RankConfig()).filter("event IS NOT NULL")
    want = want.select("symbol", "ts", "event")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and not got.isEmpty()
    cfg = AlertConfig(max_per_min=10_000)
    got = drain(state.alert_stream(s, cfg), tmp_path, "alert_out").select("ts", "symbol", "event")
    want = alerts.accept(alerts.candidates(df.select("symbol", "ts", "status"), cfg).filter("stable"), cfg)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("ts", "symbol", "event").collect()))


def test_a_symbol_that_stays_away_leaves(spark, tmp_path):
    rows = [("a", t, True) for t in range(1_000, 90_000, 1_000)] + [("z", t, True) for t in range(1_000, 30_000, 1_000)]
    df = spark.createDataFrame(sorted(rows, key=lambda r: r[1]), "symbol string, ts long, member boolean")
    s = stream_of(spark, f"{tmp_path}/in", df, 4, df.schema)
    got = drain(state.hysteresis_stream(feeds.with_event_time(s), RankConfig()), tmp_path, "away_out")
    away = RankConfig().min_dwell_ms + RankConfig().exit_ms
    assert sorted(map(tuple, got.collect())) == [("a", 3_000, "SYMBOL_ENTER"), ("z", 3_000, "SYMBOL_ENTER"), ("z", 29_000 + away, "SYMBOL_EXIT")]


def test_dedupe_stream(spark, tmp_path):
    df = spark.createDataFrame([(i // 2, i * 10) for i in range(40)], "id long, ts long")
    s = stream_of(spark, f"{tmp_path}/in", df, 4, df.schema)
    got = drain(feeds.dedupe_stream(s, ["id"]), tmp_path, "dedupe_out")
    assert sorted(r.id for r in got.collect()) == list(range(20))


def test_live_features_equal_batch(spark, tmp_path):
    from tests.test_features import SCHEMA, random_tape

    rows = sorted(random_tape(6, n=200, span=40_000), key=lambda e: e[1])
    tape, out = f"{tmp_path}/tape", f"{tmp_path}/out"
    run = live.live_features(tape, out, lateness_ms=0)
    for i in range(0, 200, 80):
        run(spark.createDataFrame(rows[i : i + 80], SCHEMA), i)
    got = spark.read.parquet(f"{out}/epoch=*").drop("epoch")
    whole = feature_snapshots(spark.createDataFrame(rows, SCHEMA), FeatureConfig())
    whole = whole.filter(F.col("ts") <= max(r[1] for r in rows) // 1_000 * 1_000)
    cols = ["symbol", "ts", "features", "windows", "data_health"]
    a, b = got.select(cols), whole.select(cols)
    assert a.count() == b.count() and a.exceptAll(b).isEmpty()


def test_events_skip_or_fail(spark, tmp_path):
    p = tmp_path / "ev.jsonl"
    ok = {"ts": 1, "source": "x", "symbol": "a", "type": "trade", "payload": {"p": "1"}, "recv_ts": 2}
    p.write_text(json.dumps(ok) + "\nbroken\n" + json.dumps({**ok, "ts": 5}) + "\n")
    rows = readers.read_market_events(spark, str(p)).orderBy("seq").collect()
    assert [(r.ts, r.symbol, json.loads(r.payload)["p"]) for r in rows] == [(1, "A", "1"), (5, "A", "1")]
    with pytest.raises(Exception):
        readers.read_market_events(spark, str(p), "fail").collect()


def test_datasets_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("A", i, i * 0.5) for i in range(100)], "symbol string, ts long, x double")
    for name in ("d.parquet", "d.jsonl"):
        writers.write_dataset(df, f"{tmp_path}/{name}")
        assert readers.read_labeled(spark, f"{tmp_path}/{name}").count() == 100
    with pytest.raises(ValueError):
        readers.read_labeled(spark, "x.csv")
    a = writers.dataset_metadata(df, SplitConfig()).first()
    b = writers.dataset_metadata(df.repartition(5), SplitConfig()).first()
    assert a == b and (a.row_count, a.symbol_count, len(a.data_hash)) == (100, 1, 16)
    changed = df.withColumn("x", F.when(F.col("ts") == 3, 9.0).otherwise(F.col("x")))
    assert writers.dataset_metadata(changed, SplitConfig()).first().data_hash != a.data_hash


def test_split_files(spark, tmp_path):
    df = spark.createDataFrame([("A", i) for i in range(100)], "symbol string, ts long")
    writers.save_split(df, str(tmp_path), SplitConfig(purge_gap_ms=2))
    meta = writers.load_split_metadata(spark, str(tmp_path))
    assert meta["train_last_ts"] == 67 and meta["val_first_ts"] == 71 and meta["test_first_ts"] == 86
    assert spark.read.parquet(f"{tmp_path}/val.parquet").count() == meta["val_rows"]


def test_calibration_files_and_digest(spark, tmp_path):
    c = spark.createDataFrame([("p_toxic", 1.5, -0.25)], "head string, a double, b double")
    writers.save_calibration(c, f"{tmp_path}/c")
    assert writers.load_calibration(spark, f"{tmp_path}/c") == {"p_toxic": (1.5, -0.25)}
    ev = spark.createDataFrame([(i, f"s{i}") for i in range(2_500)], "ts long, symbol string")
    d = lambda x: writers.stream_digest(x, ["ts", "symbol"], ["ts"]).first().digest
    assert d(ev) == d(ev.repartition(7))
    assert d(ev) != d(ev.withColumn("symbol", F.lit("s")))


def test_deliver_batch(spark, tmp_path):
    def broken(batch, epoch):
        raise RuntimeError("down")

    batch = spark.createDataFrame([("hello",)], "text string")
    run = writers.deliver_batch({"table": writers.table_sink(f"{tmp_path}/m"), "chat": broken})
    got = {r.sink: r.success for r in run(batch, 3).collect()}
    assert got == {"table": True, "chat": False}
    assert spark.read.parquet(f"{tmp_path}/m").count() == 1
    dry = writers.deliver_batch({"chat": broken}, dry_run=True)
    assert [r.sink for r in dry(batch, 4).collect()] == ["dry_run"]
    assert run(batch.limit(0), 5) is None


def test_plans_prune_and_push(spark):
    from ticklens.plans.marketview import market_tape

    t = market_tape(spark, "/root/testdata/sf0.001").filter("is_trade").select("symbol", "ts")
    plan = t._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1]
    assert "props" not in schema and "value" not in schema
