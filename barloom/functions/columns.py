"""Time arithmetic without time zones, and names for helper columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def seconds(ts) -> Column:
    """Whole seconds from 1970 of a timestamp without time zone, whatever the session's."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    ts = ts.cast("timestamp_ntz")
    return F.unix_date(ts.cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def from_seconds(s: Column) -> Column:
    """The timestamp without time zone that is ``s`` whole seconds from 1970."""
    s = s.cast("long")
    days, rest = F.floor(s / 86400), F.pmod(s, F.lit(86400))
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(days.cast("int"), F.lit(0), F.lit(0), rest.cast("decimal(18,6)"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, whatever its case."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out
