"""Operators against plain Python, and their checks."""

import datetime
import math
import random
import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom import queries as core
from barloom.functions import averages
from barloom.operators import features, kernel, multi, validation, zigzag
from barloom.plans import engine
from barloom.sources import events, feeds
from barloom.streaming.rsi import Oscillator, stream_oscillator

START = datetime.datetime(2024, 1, 1)
BAR = "series string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def walk(spark, n=200, seed=3, series=("a", "b"), flat=0, step=1.0):
    rng = np.random.default_rng(seed)
    rows = []
    for s in series:
        close = 100 + np.cumsum(rng.normal(size=n) * step)
        if flat:
            close[-flat:] = close[-flat]
        for k in range(n):
            still = flat and k >= n - flat + 1
            o = close[k] if still else close[k] + rng.normal() * 0.3
            hi, lo = max(o, close[k]), min(o, close[k])
            if not still:
                hi, lo = hi + abs(rng.normal()) * 0.2, lo - abs(rng.normal()) * 0.2
            rows.append((s, START + datetime.timedelta(hours=k), float(o), float(hi), float(lo), float(close[k]), float(rng.integers(1, 50))))
    return spark.createDataFrame(rows, BAR), rows


def frame(df, *by):
    return df.toPandas().sort_values(list(by) or ["series", "ts"]).reset_index(drop=True)


def test_bars_are_the_same_in_every_time_zone(spark):
    want = None
    zone = spark.conf.get("spark.sql.session.timeZone")
    rows = [(k, datetime.datetime.fromisoformat(t), "e", float(k)) for k, t in enumerate(["2024-03-10 01:59:59", "2024-03-10 02:00:00", "2024-03-10 02:30:00", "2024-03-10 03:10:00", "1969-12-31 23:15:00"])]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double")
    try:
        for z in ("UTC", "Asia/Kolkata", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            bars = events.bars(df, 60)
            got = [tuple(map(str, r)) for r in bars.orderBy("ts").collect()] + [tuple(map(str, r)) for r in multi.resample(bars, 2, 60).orderBy("ts").collect()]
            want = want or got
            assert got == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert len(want) == 5 and want[0][1].startswith("1969-12-31 23:00") and [w[-1] for w in want[:4]] == ["1.0", "1.0", "2.0", "1.0"]


@pytest.mark.parametrize("flat", [0, 400])
def test_batch_slices_and_updates_agree(spark, flat):
    bars, rows = walk(spark, 700, flat=flat)
    whole = frame(kernel.indicator(bars).select("series", "ts", "l0", "l3", "rsi", "gamma"))
    for s in ("a", "b"):
        one = Oscillator()
        got = [one.update_full(dict(zip(("series", "ts", "open", "high", "low", "close", "volume"), r))) for r in rows if r[0] == s]
        own = whole[whole.series == s]
        for c in ("l0", "l3", "rsi", "gamma"):
            assert np.abs(own[c].to_numpy() - [g[c] for g in got]).max() <= 1e-12
    if flat:
        assert (whole.groupby("series").rsi.last() == 0).all()  # what is left of the gaps is residue
    a, b = frame(features.features(bars)), frame(features.features(bars, minutes=60, per=128))
    assert list(a.columns) == ["series", "ts", *features.FEATURES] == list(b.columns)
    assert max((a[c] - b[c]).abs().max() for c in features.FEATURES) <= 1e-9


def test_export_and_restore():
    rng = random.Random(1)
    bars = [{"high": 2 + rng.random(), "low": 1 - rng.random(), "close": 1 + rng.random()} for _ in range(60)]
    whole, first = Oscillator(), Oscillator()
    want = [whole.update(b) for b in bars]
    got = [first.update(b) for b in bars[:30]]
    second = Oscillator().restore(*first.export())
    assert got + [second.update(b) for b in bars[30:]] == want
    with pytest.raises(ValueError):
        second.update({"high": 1.0, "low": None, "close": 1.0})


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    bars, _ = walk(spark, 60)
    typed = bars.withColumn("ts", F.col("ts").cast("timestamp"))
    schema = typed.schema
    for k in range(3):
        typed.where((F.hour("ts") >= 8 * k) & (F.hour("ts") < 8 * k + 8) & (F.col("ts") < "2024-01-02")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    try:
        query = stream_oscillator(stream).writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).outputMode("append").start()
        query.awaitTermination(120)
    except Exception as e:  # noqa: BLE001
        if "RocksDB" in str(e) or "protobuf" in str(e).lower():
            pytest.skip(f"no state here: {str(e)[:80]}")
        raise
    told = spark.table("told").where("NOT late").toPandas()
    want = frame(kernel.indicator(bars).select("series", "ts", "rsi")).set_index(["series", "ts"]).rsi
    assert len(told) > 20
    # Bars that came in order have the values of the batch.
    first = told[told.ts < pd.Timestamp("2024-01-01 08:00")]
    for r in first.itertuples():
        assert abs(want[(r.series, r.ts)] - r.rsi) <= 1e-12


def plain_zigzag(low, high, depth, deviation, backstep):
    n = len(low)
    lows, highs = [0.0] * n, [0.0] * n
    last_low = last_high = 0.0
    for i in range(n):
        for values, marks, best, sign in ((low, lows, min, -1), (high, highs, max, 1)):
            v = best(values[max(0, i - depth + 1) : i + 1])
            last = last_low if sign < 0 else last_high
            if v == last:
                v = 0.0
            else:
                if sign < 0:
                    last_low = v
                else:
                    last_high = v
                if abs(values[i] - v) > deviation:
                    v = 0.0
                else:
                    for k in range(max(0, i - backstep), i):
                        if marks[k] and marks[k] * sign < v * sign:
                            marks[k] = 0.0
            marks[i] = v if v and values[i] == v else 0.0
    points, look = [], 0  # (place, kind)
    for i in range(n):
        a, b = lows[i], highs[i]
        if look == 0:
            if b:
                points, look = [(i, 1)], -1
            if a:
                points, look = [(i, -1)], 1
        elif look == 1:
            if a and a < low[points[-1][0]] and not b:
                points[-1] = (i, -1)
            if b and not a:
                points.append((i, 1))
                look = -1
        else:
            if b and b > high[points[-1][0]] and not a:
                points[-1] = (i, 1)
            if a and not b:
                points.append((i, -1))
                look = 1
    return points


def test_zigzag_equals_a_plain_walk(spark):
    bars, rows = walk(spark, 300, seed=9)
    z = zigzag.zigzag(bars, 8, 0.1, 3)
    got = frame(z)
    told = frame(zigzag.confirmed(z))
    kept = frame(zigzag.not_repainted(z))
    for s in ("a", "b"):
        own = [r for r in rows if r[0] == s]
        want = plain_zigzag([r[4] for r in own], [r[3] for r in own], 8, 0.1, 3)
        g = got[got.series == s].reset_index(drop=True)
        assert [(i, 1 if g.peak.notna()[i] else -1) for i in range(len(g)) if g.peak.notna()[i] or g.bottom.notna()[i]] == want and len(want) > 10
        t = told[told.series == s].reset_index(drop=True)
        for k, (i, kind) in enumerate(want):
            later = next(((j, o) for j, o in want[k + 1 :] if o != kind), None)
            assert (pd.isna(t.confirmed[k]) and later is None) or t.confirmed[k] == own[later[0]][1] and t.level[k] == own[later[0]][3 if kind == 1 else 4]
        h = kept[kept.series == s]
        assert h.peak.notna().sum() + h.bottom.notna().sum() == len(want) - 1
    assert zigzag.alerts(z).where("kind NOT IN (1, -1)").count() == 0


def test_bollinger_alerts_and_framework_reseeding(spark):
    bars, rows = walk(spark, 200, seed=4, step=0.001)
    got = frame(averages.bollinger_delta(bars, 20, percent=True, bars=5, pause=7, calm=1000.0))
    for s in ("a", "b"):
        alerts = got[got.series == s].bb_alert.to_numpy().nonzero()[0]
        assert len(alerts) > 3 and set(np.diff(alerts)) == {12}
    zeros = spark.createDataFrame([("z", START + datetime.timedelta(hours=k), 0.0, 0.0, 0.0, p, 1.0) for k, p in enumerate([4.0, -4.0 * 0.5, 0.0, 2.0, 6.0])], BAR)
    got = frame(averages.add_framework_average(zeros, "e", "exponential", 2))["e"].tolist()
    want, prev = [], 0.0
    for k, p in enumerate([4.0, -2.0, 0.0, 2.0, 6.0]):
        past = [4.0, -2.0, 0.0, 2.0, 6.0][: k + 1]
        prev = (sum(past[-2:]) / 2 if k >= 1 else p) if prev == 0 else prev + 2 / 3 * (p - prev)
        want.append(prev)
    assert np.allclose(got, want)
    with pytest.raises(ValueError):
        averages.add_average(bars, "x", "hull", 5)
    with pytest.raises(ValueError):
        averages.applied_price("mid")


def test_interactions_are_null_until_all_intervals_are_known(spark):
    bars, _ = walk(spark, 150, series=("a",))
    got = frame(multi.multi_features(bars, 60, 2, 6))
    known = got.rsi_base.notna() & got.rsi_mult1.notna() & got.rsi_mult2.notna()
    assert not known.iloc[0] and known.iloc[-1]
    for c in multi.INTERACTIONS:
        own = got[c].notna()
        assert (own <= known).all() and (c == "regime_persistence_ratio" or (own == known).all()), c
    assert [c for c in got.columns[-40:]] == multi.INTERACTIONS
    clamped = frame(multi.multi_features(bars, 60, 2, 6, clamp_first=True))
    assert clamped[multi.INTERACTIONS].notna().all().all()


def test_pruning_and_sizes():
    assert len(multi.REDUNDANT) == len(set(multi.REDUNDANT)) == 48 and len(multi.INTERACTIONS) == len(set(multi.INTERACTIONS)) == 40
    assert multi.size_after_pruning(169) == 121 and multi.size_after_pruning(43) == 43 and multi.size_after_pruning(7) == 7
    assert multi.redundant(43) == [] and len(multi.redundant()) == 48
    assert multi.least_rows() == 30 and multi.least_rows(40, multiplier=12) == 600


def test_engine(spark):
    bars, _ = walk(spark, 500, series=("a",))
    with pytest.warns(UserWarning, match="one interval"):
        engine.Engine()
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        single, many = engine.Engine.single_interval(), engine.Engine.multi_interval()
    assert (single.n_features, many.n_features, engine.Engine.multi_interval(prune=False).n_features) == (43, 121, 169)
    assert (single.mode, many.mode, many.min_lookback) == ("single", "multi", 360)
    assert many.features(bars).columns == ["series", "ts", *many.columns]
    assert single.features(bars).count() == 500 == single.fit_transform(bars).count()
    with pytest.raises(ValueError, match="are needed"):
        many.features(bars.limit(100))
    with pytest.raises(ValueError, match="complete higher bars"):
        engine.Engine.multi_interval(4, 20, period=10, window=10, smoothing=3).features(bars.where("ts < '2024-01-19'"))
    for wrong in ({"m1": 4}, {"m1": 4, "m2": 4}, {"up": 0.1}, {"period": 0}, {"period": 1.5}, {"alignment": "none"}):
        with pytest.raises(ValueError):
            engine.Setup(**wrong)
    titled = bars.withColumnsRenamed({"open": "Open", "high": "High", "low": "Low", "close": "Close", "volume": "Volume", "ts": "date"}).drop("series")

    class Held:
        df = titled

    make = engine.make_indicator(20, 5)
    assert make.__name__ == "ATR_Laguerre_20_5" and make(Held()).count() == 500
    assert engine.compute_feature(titled, "regime").columns == ["series", "ts", "regime"]
    assert engine.supported_features() == list(features.FEATURES)
    for bad in ({"period": 9}, {"smoothing": 2}, {"offset": 1.5}, {"up": 0.4}, {"down": 0.6}):
        with pytest.raises(ValueError):
            engine.make_indicator(**bad)
    with pytest.raises(ValueError, match="no feature"):
        engine.compute_feature(titled, "nothing")
    with pytest.raises(ValueError, match="missing columns"):
        engine.as_bars(titled.drop("Close"))
    with pytest.raises(TypeError):
        engine.as_bars([1])
    assert engine.check_order(bars.union(bars.limit(1))).count() == 1
    assert {r.n_wrong for r in single.check_look_ahead(bars, 5).collect()} == {0}


def test_look_ahead_is_found(spark):
    bars, _ = walk(spark, 80, series=("a",))
    peek = lambda b: b.select("series", "ts", F.lead("close").over(kernel.order()).alias("next"), F.lag("close").over(kernel.order()).alias("last"))
    got = {r["column"]: r.n_wrong for r in validation.look_ahead(bars, peek, 10).collect()}
    assert got["last"] == 0 and got["next"] >= 9


def test_information_coefficient_needs_rows(spark):
    bars, _ = walk(spark, 40, series=("a",))
    x = bars.withColumn("x", F.col("close"))
    assert validation.information_coefficient(x.where("ts < '2024-01-02 04:00'"), "x").first().ic is None
    assert validation.information_coefficient(x, "x").first().ic is not None
    assert validation.information_coefficient(x.withColumn("x", F.lit(1.0)), "x").first().ic is None
    assert validation.information_coefficient(x.withColumn("x", F.lit(float("nan"))), "x").first().n == 0
    with pytest.raises(ValueError):
        validation.require_information(x.withColumn("x", F.lit(1.0)), "x")
    assert validation.passes(0.05) and not validation.passes(math.nan) and not validation.passes(None)


def test_feeds(spark, tmp_path, monkeypatch):
    bars, _ = walk(spark, 60, series=("a",))
    records = bars.select(F.col("ts").alias("date"), "open", "high", "low", "close", "volume", (F.col("ts") + F.expr("INTERVAL 59 MINUTES")).alias("close_time"), F.lit(1.0).alias("quote_asset_volume"), F.lit(3).alias("number_of_trades"), F.lit(1.0).alias("taker_buy_base_asset_volume"), F.lit(1.0).alias("taker_buy_quote_asset_volume"))
    assert feeds.record_violations(records).count() == 0
    broken = {r.rule for r in feeds.record_violations(records.limit(1).withColumn("close_time", F.col("date")).withColumn("low", F.lit(1e9)).withColumn("volume", F.lit(None).cast("double"))).collect()}
    assert broken >= {"close_time", "low_open", "low_close", "high_low", "null"}
    with pytest.raises(ValueError, match="missing"):
        feeds.check_records(records.drop("close"))
    with pytest.raises(ValueError, match="another kind"):
        feeds.check_records(records.withColumn("close", F.col("close").cast("string")))
    calls = []
    cache = feeds.BarCache(spark, str(tmp_path), lambda s, *a: calls.append(a) or records)
    for _ in range(2):
        assert cache.fetch("X", "1h", "2024-01-01", "2024-01-03").count() == 60
    assert calls == [("X", "1h", "2024-01-01", "2024-01-03")]
    with pytest.raises(ValueError, match="empty"):
        cache.fetch("", "1h", "a", "b")
    with pytest.raises(ValueError, match="no connector"):
        feeds.BarCache(spark, str(tmp_path)).fetch("Y", "1h", "a", "b")
    out = feeds.enrich(bars, "laguerre", "sessions")
    assert out.columns == [*bars.columns, *feeds.RANGE_COLUMNS, *feeds.SESSIONS] and feeds.enrich_range_bars(out) is out
    assert out.where("laguerre_rsi IS NULL").count() == 0
    assert feeds.enrich_range_bars(bars.limit(10)).where("laguerre_rsi IS NOT NULL").count() == 0
    timed = bars.drop("ts", "series").withColumn("timestamp_ms", F.lit(1_700_000_000_000) + F.monotonically_increasing_id())
    assert feeds.enrich_range_bars(timed).columns == [*timed.columns, *feeds.RANGE_COLUMNS]
    monkeypatch.setenv("RANGEBAR_LAGUERRE_ATR_PERIOD", "21")
    assert feeds.range_setup() == {**feeds.RANGE_SETUP, "period": 21}
    with pytest.raises(ValueError, match="no provider"):
        feeds.enrich(bars, "none")
    flags = feeds.extract_sessions(out)
    with pytest.raises(ValueError, match="are needed"):
        feeds.combine_sessions(bars.select("series", "ts", "close"), flags)
    assert feeds.combine_sessions(bars.select("series", "ts", "close"), flags, 1).count() == 60
    with pytest.raises(ValueError, match="different keys"):
        feeds.combine_sessions(bars.select("series", "ts", "close"), flags.limit(5), 1)
    with pytest.raises(ValueError, match="other than 0 and 1"):
        feeds.extract_sessions(flags.withColumn("is_lse_session", F.lit(2)))
    assert feeds.has_sessions(bars) == dict.fromkeys(feeds.SESSIONS, False) and set(feeds.session_info()) == set(feeds.session_names())


def test_flat_and_rising_series_have_no_nulls(spark):
    for closes in ([100.0] * 100, [100 + 0.5 * k for k in range(100)], [5.0]):
        rows = [("s", START + datetime.timedelta(minutes=5 * k), c, c, c, c, 1.0) for k, c in enumerate(closes)]
        got = frame(features.features(spark.createDataFrame(rows, BAR)))
        assert len(got) == len(closes) and not got.isna().any().any()
    assert features.features(spark.createDataFrame([], BAR)).count() == 0


def test_registered_bars_of_every_scale(spark):
    assert set(core.oracle_sql()) <= set(core.queries())
