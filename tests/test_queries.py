import duckdb
import pytest

from barloom import queries as core

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_equals_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = db.execute(core.oracle_sql()[name]).fetchdf()
    got = core.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    keys = [c for c in ("series", "ts", "column", "fold", "rule") if c in got.columns]
    got, want = (x[sorted(x.columns)].sort_values(keys).reset_index(drop=True) for x in (got, want))
    for c in got.columns:
        null = got[c].isna()
        assert (null == want[c].isna()).all(), c
        if got[c].dtype.kind == "f":
            assert null.all() or (got[c].astype(float) - want[c].astype(float)).abs().max() <= 2e-6, c
        else:
            assert (null | (got[c] == want[c])).all(), c


def test_features_have_no_nulls_and_look_back_only(spark):
    from pyspark.sql import functions as F

    from barloom.operators.features import FEATURES, features

    bars = core._bars(spark, SF)
    whole = features(bars).toPandas().set_index(["series", "ts"])
    assert list(whole.columns) == FEATURES and not whole.isna().any().any()
    cut = features(bars.where(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))).toPandas().set_index(["series", "ts"])
    assert ((whole.loc[cut.index] - cut).abs().max() <= 1e-9).all()


def test_velocity_of_a_long_span_counts_all_bars(spark):
    from barloom.operators.features import expand
    from barloom.operators.kernel import indicator

    got = expand(indicator(core._bars(spark, SF)), span=200).select("series", "ts", "rsi_change_1", "rsi_velocity").toPandas().sort_values(["series", "ts"])
    assert got.groupby("series").size().max() > 300
    want = got.groupby("series")["rsi_change_1"].transform(lambda v: v.ewm(span=200, adjust=False).mean())
    assert (got["rsi_velocity"] - want).abs().max() <= 1e-12


def test_multi_features(spark):
    from barloom.operators import multi

    out = core.queries()["multi_features"](spark, "/root/testdata/sf0.01")
    assert len(out.columns) == 2 + 169
    assert out.count() == core._bars(spark, "/root/testdata/sf0.01").count()
    with pytest.raises(ValueError):
        multi.multi_features(core._bars(spark, SF), 60, 4, 3)
