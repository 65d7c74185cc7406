"""Zigzag: alternating peaks and bottoms of bars, their confirmations and alerts.

A bar is a candidate low if its low is the least of the last ``depth`` bars and
differs from the candidate before; candidates among the last ``backstep`` bars
that it undercuts go.  Highs mirror that.  Then extremes alternate: a further
candidate of the same side replaces the last extreme if it goes beyond it, one
of the other side begins the next leg.

Zero prices mark "no candidate", as the definition has it; null highs or lows
make a bar no candidate.  A series is walked from its start in one task: an
extreme may be replaced as long as its leg lasts, so the result is known at a
series' end only (``confirmed`` says from which bar on it can be known).
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.kernel import order
from ..plans.scan import scan


def _candidates(depth: int, deviation: float, backstep: int):
    """For ``scan``: the candidate low and high of each bar, as they stand when the bar comes, and how many bars back each clears others (as a bit set)."""

    def side(sign: int):
        recent: deque = deque()  # (place, price), best first
        marks: deque = deque(maxlen=backstep)  # candidates of the last bars, oldest first
        known = [0, 0.0]

        def step(price: float) -> tuple[float, int]:
            place, last = known
            while recent and recent[-1][1] * sign <= price * sign:
                recent.pop()
            recent.append((place, price))
            while recent[0][0] <= place - depth:
                recent.popleft()
            best, cleared = recent[0][1], 0
            known[0] = place + 1
            value = 0.0
            if best != last:
                known[1] = best
                if abs(price - best) <= deviation:
                    value = best
                    for k in range(len(marks)):
                        if marks[k] != 0 and marks[k] * sign < best * sign:
                            marks[k] = 0.0
                            cleared |= 1 << (len(marks) - 1 - k)
            mark = value if value != 0 and price == value else 0.0
            marks.append(mark)
            return mark, cleared

        return step

    def make():
        low, high = side(-1), side(1)

        def work(lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, ...]:
            out = [[], [], [], []]
            for a, b in zip(lows.tolist(), highs.tolist(), strict=True):
                found = (*(low(a) if a == a else (0.0, 0)), *(high(b) if b == b else (0.0, 0)))
                for column, v in zip(out, found, strict=True):
                    column.append(v)
            return tuple(np.array(c, dtype=t) for c, t in zip(out, (float, np.int64, float, np.int64), strict=True))

        return work

    return make


def _legs():
    """For ``scan``: which extreme each bar makes (1 peak, -1 bottom), and the number of its leg; the last bar of a leg's side is its extreme."""

    def make():
        state = [0, 0.0, 0.0, 0]  # side looked for (0 either, 1 a peak, -1 a bottom), last low, last high, leg

        def work(lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, ...]:
            look, last_low, last_high, leg = state
            kinds, legs = [], []
            for low, high in zip(lows.tolist(), highs.tolist(), strict=True):
                kind = 0
                if look == 0:
                    if high:
                        kind, look, last_high, leg = 1, -1, high, leg + 1
                    if low:
                        kind, look, last_low, leg = -1, 1, low, leg + 1
                elif look == 1:
                    if low and low < last_low and not high:
                        kind, last_low = -1, low
                    if high and not low:
                        kind, look, last_high, leg = 1, -1, high, leg + 1
                else:
                    if high and high > last_high and not low:
                        kind, last_high = 1, high
                    if low and not high:
                        kind, look, last_low, leg = -1, 1, low, leg + 1
                kinds.append(kind)
                legs.append(leg)
            state[:] = look, last_low, last_high, leg
            return np.array(kinds, dtype=np.int64), np.array(legs, dtype=np.int64)

        return work

    return make


def candidates(bars: DataFrame, depth: int = 12, deviation: float = 0.05, backstep: int = 3) -> DataFrame:
    """``bars`` with low_mark and high_mark, the candidates left after all; 0 for none."""
    if depth < 1 or backstep < 0 or deviation < 0:
        raise ValueError("depth is 1 or more, backstep and deviation 0 or more")
    out = scan(bars, "__c", _candidates(depth, deviation, backstep), ["low", "high"], {"low": "double", "low_cut": "long", "high": "double", "high_cut": "long"})
    cut = lambda name: sum((F.coalesce(F.lead(f"__c.{name}", k).over(order()), F.lit(0)).bitwiseAND(F.lit(1 << (k - 1))) for k in range(1, backstep + 1)), F.lit(0))
    marks = {f"{s}_mark": F.when(cut(f"{s}_cut") == 0, F.col(f"__c.{s}")).otherwise(0.0) for s in ("low", "high")}
    return out.withColumns(marks).drop("__c")


def zigzag(bars: DataFrame, depth: int = 12, deviation: float = 0.05, backstep: int = 3) -> DataFrame:
    """``bars`` with peak and bottom: the price of the extreme that a bar is, else null."""
    out = candidates(bars, depth, deviation, backstep)
    out = scan(out, "__z", _legs(), ["low_mark", "high_mark"], {"kind": "long", "leg": "long"})
    # Of the bars of a leg's side the last is the extreme: those before were replaced.
    later = Window.partitionBy("series", F.col("__z.leg")).orderBy("ts").rowsBetween(1, Window.unboundedFollowing)
    last = F.col("__z.kind") != 0
    final = last & F.coalesce(F.max(last.cast("int")).over(later) == 0, F.lit(True))
    return out.withColumns({"peak": F.when(final & (F.col("__z.kind") == 1), F.col("high")), "bottom": F.when(final & (F.col("__z.kind") == -1), F.col("low"))}).drop("__z", "low_mark", "high_mark")


def extremes(zigzagged: DataFrame) -> DataFrame:
    """(series, ts, kind, price): 1 for peaks and -1 for bottoms, one row each."""
    kind = F.when(F.col("peak").isNotNull(), 1).when(F.col("bottom").isNotNull(), -1).cast("long")
    return zigzagged.select("series", "ts", kind.alias("kind"), F.coalesce("peak", "bottom").alias("price"), "high", "low").where("kind IS NOT NULL")


def confirmed(zigzagged: DataFrame) -> DataFrame:
    """(series, ts, kind, price, confirmed, level): each extreme with the first later one of the other side, null if there is none yet.

    A peak is confirmed at a bottom, with that bar's high as the level; a bottom
    at a peak, with its low.
    """
    e = extremes(zigzagged)
    later = Window.partitionBy("series").orderBy("ts").rowsBetween(1, Window.unboundedFollowing)
    other = lambda k, level: F.first(F.when(F.col("kind") == k, F.struct("ts", F.col(level).alias("level"))), ignorenulls=True).over(later)
    e = e.withColumn("at", F.when(F.col("kind") == 1, other(-1, "high")).otherwise(other(1, "low")))
    return e.select("series", "ts", "kind", "price", F.col("at.ts").alias("confirmed"), F.col("at.level").alias("level"))


def not_repainted(zigzagged: DataFrame) -> DataFrame:
    """``zigzagged`` without the extremes that later bars can still change: the newest of each series, and the one before if there are fewer than three."""
    found = F.col("peak").isNotNull() | F.col("bottom").isNotNull()
    whole = Window.partitionBy("series")
    since = F.count(F.when(found, 1)).over(order().rowsBetween(0, Window.unboundedFollowing))
    total = F.count(F.when(found, 1)).over(whole)
    hide = (since <= F.when(total < 3, 2).otherwise(1)) & (total >= 2)
    out = zigzagged.withColumn("__hide", hide)
    return out.withColumns({c: F.when(~F.col("__hide"), F.col(c)) for c in ("peak", "bottom")}).drop("__hide")


def alerts(zigzagged: DataFrame, recent: int = 3) -> DataFrame:
    """(series, confirmed, kind, ts, price): the confirmations on the last ``recent`` bars of a series, one for each bar and direction.

    A stream of bars calls this for each batch with the keys (series, ts, kind)
    that it has told before left out (see ``streaming``).
    """
    place = zigzagged.select("series", F.col("ts").alias("confirmed"), F.row_number().over(Window.partitionBy("series").orderBy(F.desc("ts"))).alias("back"))
    c = confirmed(zigzagged).where("confirmed IS NOT NULL").join(place, ["series", "confirmed"]).where(F.col("back") <= recent)
    return c.groupBy("series", "confirmed", "kind").agg(F.max("ts").alias("ts"), F.max_by("price", "ts").alias("price"))
