"""Entry points: a checked setup, and what is computed with it."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import DataFrame, functions as F

from ..operators import multi
from ..operators.features import FEATURES, features
from ..operators.kernel import indicator
from ..operators.validation import look_ahead


class Feature(Protocol):
    """What makes columns of bars."""

    def fit_transform(self, bars: DataFrame) -> DataFrame: ...

    def check_look_ahead(self, bars: DataFrame) -> DataFrame: ...


#: Capitalised column names as back-testing tools have them.
TITLES = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "volume", "Date": "ts", "date": "ts", "Timestamp": "ts"}
NEEDED = ("ts", "open", "high", "low", "close", "volume")


def as_bars(data) -> DataFrame:
    """Bars of a DataFrame, or of an object that holds one as ``df``: known names in their lower-case form, one series if none is named."""
    df = data if isinstance(data, DataFrame) else getattr(data, "df", None)
    if not isinstance(df, DataFrame):
        raise TypeError("bars are a DataFrame, or an object with one as df")
    for title, name in TITLES.items():
        if title in df.columns and name not in df.columns:
            df = df.withColumnRenamed(title, name)
    missing = [c for c in NEEDED if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are {', '.join(df.columns)}")
    if "series" not in df.columns:
        df = df.withColumn("series", F.lit(""))
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def check_order(bars: DataFrame) -> DataFrame:
    """(series, ts) of bars that stand more than once; a table has no other order than that of ``ts``."""
    return bars.groupBy("series", "ts").count().where("count > 1").select("series", "ts")


@dataclass(frozen=True)
class Setup:
    """``smoothing`` enters the lookback only; ``minutes`` is the width of a base bar."""

    period: int = 14
    smoothing: int = 5
    offset: float = 0.75
    up: float = 0.85
    down: float = 0.15
    window: int = 20
    span: int = 5
    minutes: int = 60
    m1: int | None = None
    m2: int | None = None
    prune: bool = True
    alignment: str = "availability"
    clamp_first: bool = False

    def __post_init__(self) -> None:
        whole = {"period": (1, 10**4), "smoothing": (1, 10**4), "window": (1, 10**4), "span": (1, 10**4), "minutes": (1, 10**6)}
        for name, (low, high) in whole.items():
            v = getattr(self, name)
            if not isinstance(v, int) or isinstance(v, bool) or not low <= v <= high:
                raise ValueError(f"{name} must be a whole number from {low} to {high}")
        if not 0 <= self.offset <= 10:
            raise ValueError("offset must be from 0 to 10")
        if not 0 < self.down < self.up < 1:
            raise ValueError("levels must satisfy 0 < down < up < 1")
        if (self.m1 is None) != (self.m2 is None):
            raise ValueError("give both multipliers or none")
        if self.m1 is not None:
            multi.check_multipliers(self.m1, self.m2)
        if self.alignment not in multi.ALIGNMENTS:
            raise ValueError(f"alignment is one of {', '.join(multi.ALIGNMENTS)}")


class Engine:
    """The oscillator and its features by one setup."""

    def __init__(self, setup: Setup | None = None, **changes):
        self.setup = replace(setup or Setup(), **changes)
        if self.mode == "single":
            warnings.warn("one interval: 43 features; multi_interval() has 121", UserWarning, stacklevel=2)

    @classmethod
    def single_interval(cls, **changes) -> Engine:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return cls(Setup(), **changes)

    @classmethod
    def multi_interval(cls, m1: int = 4, m2: int = 12, **changes) -> Engine:
        return cls(Setup(m1=m1, m2=m2), **changes)

    @property
    def mode(self) -> str:
        return "single" if self.setup.m1 is None else "multi"

    @property
    def columns(self) -> list[str]:
        if self.mode == "single":
            return list(FEATURES)
        names = [f"{c}_{k}" for k in ("base", "mult1", "mult2") for c in FEATURES] + list(multi.INTERACTIONS)
        return [c for c in names if not (self.setup.prune and c in multi.REDUNDANT)]

    @property
    def n_features(self) -> int:
        return len(self.columns)

    @property
    def min_lookback(self) -> int:
        s = self.setup
        return multi.least_rows(s.period, s.smoothing, s.window, s.m2 or 1)

    def _checked(self, data, least: int) -> DataFrame:
        bars = as_bars(data)
        few = bars.groupBy("series").count().where(F.col("count") < least).orderBy("series").first()
        if few is not None:
            raise ValueError(f"series {few.series!r} has {few['count']} bars; {least} are needed")
        return bars

    def fit_transform(self, data) -> DataFrame:
        """(series, ts, rsi)."""
        s = self.setup
        return indicator(self._checked(data, multi.least_rows(s.period, s.smoothing, s.window)), s.period, s.offset).select("series", "ts", "rsi")

    def features(self, data) -> DataFrame:
        """(series, ts) and ``columns``."""
        s = self.setup
        if self.mode == "single":
            return self._single(self._checked(data, s.window), s.minutes)
        bars = self._checked(data, self.min_lookback)
        if s.alignment == "availability":
            for m in (s.m1, s.m2):
                multi.check_higher_bars(multi.resample(bars, m, s.minutes))
        out = multi.interactions(multi.extract(bars, s.minutes, self._single, FEATURES, s.m1, s.m2, s.alignment, s.clamp_first))
        return out.select("series", "ts", *self.columns)

    def _single(self, bars: DataFrame, minutes: int) -> DataFrame:
        s = self.setup
        return features(bars, s.period, s.offset, s.up, s.down, s.window, s.span, minutes)

    def check_look_ahead(self, data, prefixes: int = 100) -> DataFrame:
        """(series, column, n_wrong) of the oscillator; ValueError for series that are too short."""
        bars = self._checked(data, max(self.setup.period + 10, 50))
        return look_ahead(bars, lambda b: indicator(b, self.setup.period, self.setup.offset).select("series", "ts", "rsi"), prefixes)


def supported_features() -> list[str]:
    return list(FEATURES)


def _adapter(period: int, smoothing: int, offset: float, up: float, down: float) -> Engine:
    """The setup of the adapters, with their narrower bounds."""
    for name, v, low, high in (("period", period, 10, 30), ("smoothing", smoothing, 3, 10), ("offset", offset, 0, 1), ("up", up, 0.5, 1), ("down", down, 0, 0.5)):
        if not low <= v <= high:
            raise ValueError(f"{name} must be from {low} to {high}")
    return Engine.single_interval(period=period, smoothing=smoothing, offset=offset, up=up, down=down)


def compute_indicator(data, period: int = 14, smoothing: int = 5, offset: float = 0.75, up: float = 0.85, down: float = 0.15) -> DataFrame:
    """(series, ts, rsi)."""
    return _adapter(period, smoothing, offset, up, down).fit_transform(data)


def compute_feature(data, feature: str, period: int = 14, smoothing: int = 5, offset: float = 0.75, up: float = 0.85, down: float = 0.15) -> DataFrame:
    """(series, ts, feature): one of the 43; the planner computes no others."""
    if feature not in FEATURES:
        raise ValueError(f"no feature {feature!r}; there are {', '.join(FEATURES)}")
    return _adapter(period, smoothing, offset, up, down).features(data).select("series", "ts", feature)


def make_indicator(period: int = 14, smoothing: int = 5, offset: float = 0.75, up: float = 0.85, down: float = 0.15) -> Callable[[DataFrame], DataFrame]:
    """A function of bars to (series, ts, rsi), its setup checked now."""
    engine = _adapter(period, smoothing, offset, up, down)

    def run(data) -> DataFrame:
        return engine.fit_transform(data)

    run.__name__ = f"ATR_Laguerre_{period}_{smoothing}"
    return run


