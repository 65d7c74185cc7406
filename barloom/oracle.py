"""DuckDB SQL of the registered queries, put together from pieces (common table expressions)."""

from __future__ import annotations

BARS = """b AS (
    SELECT event_type AS series, time_bucket(INTERVAL 1 HOUR, ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
           min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume
    FROM events WHERE value IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2)"""


def resample(of: str, to: str, m: int) -> str:
    return f"""{to}0 AS (SELECT *, date_trunc('day', min(ts) OVER (PARTITION BY series)) AS origin FROM {of}),
{to} AS (
    SELECT series, time_bucket(INTERVAL {m} HOUR, ts, origin) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
           arg_max(close, ts) AS close, sum(volume) AS volume, max(ts) + INTERVAL 1 HOUR AS ready
    FROM {to}0 GROUP BY series, time_bucket(INTERVAL {m} HOUR, ts, origin) HAVING count(*) = {m})"""


def volatility(of: str = "b", to: str = "v", period: int = 14, offset: float = 0.75) -> str:
    return f"""{to}_t AS (
    SELECT *, row_number() OVER w AS rn,
           CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high, lag(close) OVER w) - least(low, lag(close) OVER w) END AS tr
    FROM {of} WINDOW w AS (PARTITION BY series ORDER BY ts)),
{to}_s AS (
    SELECT a.series, a.rn, a.rn - c.rn + 1 AS k, sum(c.tr) OVER (PARTITION BY a.series, a.rn ORDER BY c.rn DESC) / (a.rn - c.rn + 1) AS m
    FROM {to}_t a JOIN {to}_t c ON a.series = c.series AND c.rn BETWEEN a.rn - {period - 1} AND a.rn),
{to}_e AS (SELECT series, rn, arg_max(m, k) AS atr, min(m) AS min_atr, max(m) AS max_atr FROM {to}_s GROUP BY ALL),
{to} AS (
    SELECT t.series, t.ts, t.rn, t.close, tr, atr, min_atr, max_atr,
           CASE WHEN max_atr = min_atr THEN 0.5 ELSE 1 - (atr - min_atr) / (max_atr - min_atr) END AS adaptive_coeff,
           1 - 10 / ({period} * (CASE WHEN max_atr = min_atr THEN 0.5 ELSE 1 - (atr - min_atr) / (max_atr - min_atr) END + {offset}) + 9) AS gamma
    FROM {to}_t t JOIN {to}_e USING (series, rn))"""


def gap(a: str, b: str) -> str:
    """a - b, or 0 if that is residue."""
    return f"CASE WHEN abs({a} - {b}) <= 1e-12 * (abs({a}) + abs({b})) THEN 0.0 ELSE {a} - {b} END"


def stages(of: str = "v", to: str = "o", seeded: bool = False) -> str:
    """The four stages by recursion; from zero, or from the first price."""
    first = "close AS l0, close AS l1, close AS l2, close AS l3" if seeded else "close * (1 - gamma) AS l0, -gamma * close * (1 - gamma) AS l1, gamma * gamma * close * (1 - gamma) AS l2, -gamma * gamma * gamma * close * (1 - gamma) AS l3"
    return f"""{to}_f AS (
    SELECT series, rn, ts, {first}
    FROM {of} WHERE rn = 1
    UNION ALL
    SELECT series, rn, ts, l0, l1, l2, l2p + gamma * (l3p - l2) FROM (
        SELECT *, l1p + gamma * (l2p - l1) AS l2 FROM (
            SELECT *, l0p + gamma * (l1p - l0) AS l1 FROM (
                SELECT v.series, v.rn, v.ts, v.gamma, f.l0 AS l0p, f.l1 AS l1p, f.l2 AS l2p, f.l3 AS l3p, v.close + v.gamma * (f.l0 - v.close) AS l0
                FROM {to}_f f JOIN {of} v ON v.series = f.series AND v.rn = f.rn + 1) x) y) z),
{to}_u AS (
    SELECT *, {gap('l0', 'l1')} AS g0, {gap('l1', 'l2')} AS g1, {gap('l2', 'l3')} AS g2 FROM {to}_f),
{to} AS (
    SELECT series, rn, ts, l0, l1, l2, l3, CASE WHEN g0 = 0 AND g1 = 0 AND g2 = 0 THEN 0.0
           ELSE (greatest(g0, 0) + greatest(g1, 0) + greatest(g2, 0)) / (abs(g0) + abs(g1) + abs(g2)) END AS rsi FROM {to}_u)"""


def features(vol: str, osc: str, to: str, up: float = 0.85, down: float = 0.15) -> str:
    """The 43 columns, from the tables of ``volatility`` and ``stages``."""
    ago = lambda c, n=1: f"coalesce(lag({c}, {n}) OVER w, first_value({c}) OVER w)"
    since = lambda cond: f"rn - coalesce(max(CASE WHEN {cond} THEN rn END) OVER w, 0)"
    return f"""{to}_a AS (
    SELECT v.series, v.ts, v.rn, close, min_atr, max_atr, adaptive_coeff, gamma, l0, l1, l2, l3, rsi, {gap('l0', 'l1')} AS g0, {gap('l1', 'l2')} AS g1, {gap('l2', 'l3')} AS g2,
           CASE WHEN rsi < {down} THEN 0 WHEN rsi > {up} THEN 2 ELSE 1 END::BIGINT AS regime
    FROM {osc} o JOIN {vol} v ON o.series = v.series AND o.rn = v.rn),
{to}_b AS (
    SELECT *, {ago('rsi')} AS was, {ago('regime')} AS regime_was, rsi - {ago('rsi')} AS rsi_change_1, rsi - {ago('rsi', 5)} AS rsi_change_5,
           list(rsi) OVER t AS last20, avg(rsi) OVER t AS mean20, coalesce(stddev_samp(rsi) OVER t, 0) AS vol20, max(rsi) OVER t - min(rsi) OVER t AS range20,
           {gap('l0', ago('l0'))} AS dl0, abs(close - {ago('close')}) AS dc, abs(close - {ago('close', 20)}) AS far, gamma - avg(gamma) OVER t AS gamma_spread,
           adaptive_coeff - {ago('adaptive_coeff')} AS roc, {since(f'rsi < {down}')} AS since_os, {since(f'rsi > {up}')} AS since_ob,
           CASE WHEN g0 > 0 AND g2 > 0 THEN 2 WHEN g0 > 0 THEN 1 WHEN g2 > 0 THEN 3 ELSE 0 END::BIGINT AS cycle_phase
    FROM {to}_a WINDOW w AS (PARTITION BY series ORDER BY ts), t AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
{to}_c AS (
    SELECT *, (regime <> regime_was)::BIGINT AS changed, sum((regime <> regime_was)::BIGINT) OVER w AS island,
           list_reduce(list(rsi_change_1) OVER w, lambda a, x: a + (x - a) / 3) AS velocity,
           sum(dc) OVER t AS path, stddev_samp(dl0) OVER t AS sd_dl0, count(vol20) OVER h AS n100, avg(vol20) OVER h AS m100, stddev_samp(vol20) OVER h AS s100, {ago('cycle_phase')} AS phase_was
    FROM {to}_b WINDOW w AS (PARTITION BY series ORDER BY ts), t AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
         h AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
{to}_d AS (
    SELECT *, row_number() OVER (PARTITION BY series, island ORDER BY ts) AS run, (abs(rsi_change_1) > 0.3)::BIGINT AS shock,
           coalesce(n100 >= 20 AND vol20 > m100 + 2 * s100, false)::BIGINT AS spike,
           least(greatest(far / CASE WHEN path = 0 THEN 1 ELSE path END, 0), 1) AS er
    FROM {to}_c),
{to} AS (
    SELECT series, ts, rsi, regime, (regime = 0)::BIGINT AS regime_bearish, (regime = 1)::BIGINT AS regime_neutral, (regime = 2)::BIGINT AS regime_bullish,
           changed AS regime_changed, run AS bars_in_regime, CASE WHEN rsi > {up} THEN rsi - {up} WHEN rsi < {down} THEN {down} - rsi ELSE 0 END::DOUBLE AS regime_strength,
           rsi - {up} AS dist_overbought, rsi - {down} AS dist_oversold, rsi - 0.5 AS dist_midline, abs(rsi - {up}) AS abs_dist_overbought, abs(rsi - {down}) AS abs_dist_oversold,
           (was <= {down} AND rsi > {down})::BIGINT AS cross_above_oversold, (was >= {up} AND rsi < {up})::BIGINT AS cross_below_overbought,
           (was <= 0.5 AND rsi > 0.5)::BIGINT AS cross_above_midline, (was >= 0.5 AND rsi < 0.5)::BIGINT AS cross_below_midline,
           since_os AS bars_since_oversold, since_ob AS bars_since_overbought, least(since_os, since_ob) AS bars_since_extreme,
           rsi_change_1, rsi_change_5, velocity AS rsi_velocity, len(list_filter(last20, lambda z: z < rsi)) / len(last20) * 100 AS rsi_percentile_20,
           (rsi - mean20) / CASE WHEN vol20 = 0 THEN 1 ELSE vol20 END AS rsi_zscore_20, vol20 AS rsi_volatility_20, range20 AS rsi_range_20,
           shock AS rsi_shock_1bar, (regime <> 1 AND run > 10)::BIGINT AS extreme_regime_persistence, spike AS rsi_volatility_spike,
           least(greatest(0.4 * shock + 0.3 * (regime <> 1 AND run > 10)::BIGINT + 0.3 * spike, 0), 1)::DOUBLE AS tail_risk_score,
           adaptive_coeff, roc AS adaptive_coeff_roc_1, gamma AS gamma_value, gamma_spread, (l0 - l3) / (abs(l0) + abs(l3) + 1e-10) AS laguerre_spread,
           abs(g1) / (abs(g0) + abs(g2) + 1e-10) AS laguerre_mid_convergence, dl0 / CASE WHEN sd_dl0 IS NULL OR sd_dl0 = 0 THEN 1 ELSE sd_dl0 END AS laguerre_slope,
           (max_atr - min_atr) / (max_atr + 1e-10) AS atr_range_width, er AS efficiency_ratio, (er > 0.5)::BIGINT AS efficiency_trend, cycle_phase, (cycle_phase <> phase_was)::BIGINT AS cycle_phase_changed
    FROM {to}_d)"""


def interval(of: str, to: str) -> str:
    """All from bars ``of`` to the 43 columns ``to``."""
    return f"{volatility(of, f'{to}v')}, {stages(f'{to}v', f'{to}o')}, {features(f'{to}v', f'{to}o', to)}"


def multi(names: list[str], m1: int = 4, m2: int = 12, match: str = "l.ready > h.ready", positional: bool = False) -> str:
    """``m``: the three intervals side by side; higher bars by the condition ``match`` on l (base) and h."""
    side = lambda k: ", ".join(f"{c} AS {c}_{k}" for c in names)
    out = f"{BARS}, {interval('b', 'x')}, {resample('b', 'r1', m1)}, {interval('r1', 'y')}, {resample('b', 'r2', m2)}, {interval('r2', 'z')}"
    rn = "row_number() OVER (PARTITION BY series ORDER BY ts) AS rn"
    out += f""", m0 AS (SELECT series, ts, ts + INTERVAL 1 HOUR AS ready, {rn}, {side('base')} FROM x),
h1 AS (SELECT series, ts, ts + INTERVAL {m1} HOUR AS ready, {rn}, {side('mult1')} FROM y), h2 AS (SELECT series, ts, ts + INTERVAL {m2} HOUR AS ready, {rn}, {side('mult2')} FROM z),
m1 AS (SELECT l.*, h.* EXCLUDE (series, ts, ready, rn) FROM m0 l ASOF LEFT JOIN h1 h ON l.series = h.series AND {match}),
m AS (SELECT l.*, h.* EXCLUDE (series, ts, ready, rn) FROM m1 l ASOF LEFT JOIN h2 h ON l.series = h.series AND {match})"""
    return out


def interactions(of: str = "m", to: str = "i") -> str:
    """The 40 interactions of the three intervals side by side."""
    b = lambda c: (f"{c}_base", f"{c}_mult1", f"{c}_mult2")
    g, r, chg, ob, os_, moved = b("regime"), b("rsi"), b("rsi_change_1"), b("cross_below_overbought"), b("cross_above_oversold"), b("regime_changed")
    ago = lambda c, n: f"coalesce(lag({c}, {n}) OVER w, 0) = 1"
    cascade = f"({moved[0]} = 1 AND coalesce(max({moved[2]}) OVER w5, 0) = 1)::BIGINT"
    mean = f"(({r[0]} + {r[1]} + {r[2]}) / 3)"
    std = f"sqrt((({r[0]} - {mean})^2 + ({r[1]} - {mean})^2 + ({r[2]} - {mean})^2) / 2)"
    columns = {
        "all_intervals_bullish": f"({g[0]} = 2 AND {g[1]} = 2 AND {g[2]} = 2)::BIGINT", "all_intervals_bearish": f"({g[0]} = 0 AND {g[1]} = 0 AND {g[2]} = 0)::BIGINT",
        "all_intervals_neutral": f"({g[0]} = 1 AND {g[1]} = 1 AND {g[2]} = 1)::BIGINT",
        "regime_agreement_count": f"CASE WHEN {g[0]} = {g[1]} AND {g[1]} = {g[2]} THEN 3 WHEN {g[0]} = {g[1]} OR {g[1]} = {g[2]} OR {g[0]} = {g[2]} THEN 2 ELSE 1 END::BIGINT",
        "regime_majority": f"CASE WHEN {g[0]} = {g[1]} OR {g[0]} = {g[2]} THEN {g[0]} WHEN {g[1]} = {g[2]} THEN {g[1]} ELSE least({g[0]}, {g[1]}, {g[2]}) END::BIGINT",
        "regime_unanimity": f"({g[0]} = {g[1]} AND {g[1]} = {g[2]})::BIGINT",
        "base_bull_higher_bear": f"({g[0]} = 2 AND ({g[1]} = 0 OR {g[2]} = 0))::BIGINT", "base_bear_higher_bull": f"({g[0]} = 0 AND ({g[1]} = 2 OR {g[2]} = 2))::BIGINT",
        "divergence_strength": f"greatest({', '.join(r)}) - least({', '.join(r)})", "divergence_direction": f"sign({r[0]} - {r[2]})::BIGINT",
        "base_extreme_higher_neutral": f"({g[0]} <> 1 AND {g[2]} = 1)::BIGINT", "base_neutral_higher_extreme": f"({g[0]} = 1 AND {g[2]} <> 1)::BIGINT",
        "gradient_up": f"({r[0]} > {r[1]} AND {r[1]} > {r[2]})::BIGINT", "gradient_down": f"({r[0]} < {r[1]} AND {r[1]} < {r[2]})::BIGINT",
        "rsi_spread_base_mult1": f"{r[0]} - {r[1]}", "rsi_spread_base_mult2": f"{r[0]} - {r[2]}", "rsi_spread_mult1_mult2": f"{r[1]} - {r[2]}",
        "momentum_direction": f"sign({r[0]} - {r[2]})::BIGINT", "momentum_magnitude": f"abs({r[0]} - {r[2]})", "momentum_consistency": f"(sign({chg[0]}) = sign({chg[2]}))::BIGINT",
        "any_interval_crossed_overbought": f"greatest({', '.join(ob)})", "all_intervals_crossed_overbought": f"least({', '.join(ob)})",
        "any_interval_crossed_oversold": f"greatest({', '.join(os_)})", "all_intervals_crossed_oversold": f"least({', '.join(os_)})",
        "base_crossed_while_higher_extreme": f"({os_[0]} = 1 AND {g[2]} <> 1)::BIGINT",
        "cascade_crossing_up": f"({ago(os_[2], 2)} AND {ago(os_[1], 1)} AND {os_[0]} = 1)::BIGINT", "cascade_crossing_down": f"({ago(ob[2], 2)} AND {ago(ob[1], 1)} AND {ob[0]} = 1)::BIGINT",
        "higher_crossed_first": f"(greatest({ob[0]}, {os_[0]}) = 1 AND coalesce(max(greatest({ob[2]}, {os_[2]})) OVER w10, 0) = 1)::BIGINT",
        "regime_persistence_ratio": "bars_in_regime_base / bars_in_regime_mult2", "regime_change_cascade": cascade,
        "regime_stability_score": f"1 - ({moved[0]} + {moved[1]} + {moved[2]}) / 3",
        "bars_since_alignment": "n - coalesce(max(CASE WHEN same THEN n END) OVER w, 0)", "alignment_duration": "n - coalesce(max(CASE WHEN NOT same THEN n END) OVER w, 0)",
        "higher_interval_leads": cascade, "regime_transition_pattern": f"4 * {g[0]} + 2 * {g[1]} + {g[2]}",
        "mean_rsi_across_intervals": mean, "std_rsi_across_intervals": std, "rsi_range_across_intervals": f"greatest({', '.join(r)}) - least({', '.join(r)})",
        "rsi_skew_across_intervals": f"({r[0]} - {mean}) / CASE WHEN {std} = 0 THEN 1 ELSE {std} END",
        "interval_momentum_agreement": f"({chg[0]} > 0)::BIGINT + ({chg[1]} > 0)::BIGINT + ({chg[2]} > 0)::BIGINT",
    }
    return f"""{to}0 AS (
    SELECT *, {g[0]} + {g[1]} + {g[2]} IS NOT NULL AS known, {g[0]} = {g[1]} AND {g[1]} = {g[2]} AS same,
           sum(({g[0]} + {g[1]} + {g[2]} IS NOT NULL)::BIGINT) OVER (PARTITION BY series ORDER BY ts) AS n FROM {of}),
{to} AS (
    SELECT {to}0.* EXCLUDE (known, same, n, ready, rn), {', '.join(f'CASE WHEN known THEN {v} END AS {k}' for k, v in columns.items())}
    FROM {to}0 WINDOW w AS (PARTITION BY series ORDER BY ts), w5 AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
         w10 AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))"""


def rounded(names: list[str], of: str, doubles: set[str], keys: str = "series, ts", digits: int = 6) -> str:
    return f"SELECT {keys}, " + ", ".join(f"round({c}, {digits}) AS {c}" if c in doubles else c for c in names) + f" FROM {of}"


def coefficient(of: str, to: str, x: str = "rsi", price: str = "close", ahead: int = 1, log: bool = True) -> str:
    """Spearman correlation of ``x`` with the return over the next bars."""
    gain = f"ln(later / {price})" if log else f"later / {price} - 1"
    return f"""{to}_p AS (SELECT *, lead({price}, {ahead}) OVER (PARTITION BY series ORDER BY ts) AS later FROM {of}),
{to}_q AS (SELECT series, {x} AS x, CASE WHEN later > 0 AND {price} > 0 THEN {gain} END AS y FROM {to}_p),
{to}_k AS (
    SELECT series, rank() OVER (PARTITION BY series ORDER BY x) + (count(*) OVER (PARTITION BY series, x) - 1) / 2.0 AS rx,
           rank() OVER (PARTITION BY series ORDER BY y) + (count(*) OVER (PARTITION BY series, y) - 1) / 2.0 AS ry FROM {to}_q WHERE x IS NOT NULL AND y IS NOT NULL),
{to}_n AS (SELECT series, count(*) AS bars FROM {of} GROUP BY series),
{to} AS (
    SELECT n.series, count(rx) AS n, CASE WHEN any_value(bars) >= {ahead + 30} AND count(rx) >= 30 THEN corr(rx, ry) END AS ic
    FROM {to}_n n LEFT JOIN {to}_k k ON n.series = k.series GROUP BY n.series)"""


def oscillator(of: str, to: str) -> str:
    """``to``: series, ts, close and rsi of bars ``of``."""
    return f"{volatility(of, f'{to}v')}, {stages(f'{to}v', f'{to}o')}, {to} AS (SELECT o.series, o.ts, v.close, o.rsi FROM {to}o o JOIN {to}v v ON o.series = v.series AND o.rn = v.rn)"


TRUE_RANGE = "CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high, lag(close) OVER w) - least(low, lag(close) OVER w) END"
BY_VOLATILITY = f"""a0 AS (SELECT *, {TRUE_RANGE} AS tr FROM b WINDOW w AS (PARTITION BY series ORDER BY ts)),
a1 AS (SELECT *, CASE WHEN count(*) OVER w >= 20 THEN avg(tr) OVER w END AS atr FROM a0 WINDOW w AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
a2 AS (SELECT series, quantile_cont(atr, 0.5) AS edge FROM a1 GROUP BY series),
split AS (SELECT a1.*, CASE WHEN atr <= edge THEN 'low' WHEN atr > edge THEN 'high' END AS volatility FROM a1 JOIN a2 USING (series))"""
BY_TREND = """a0 AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) AS rn FROM b),
a1 AS (SELECT *, CASE WHEN rn > 50 THEN abs(regr_slope(close, rn) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)) * 50 / 49 END AS slope FROM a0),
a2 AS (SELECT series, quantile_cont(slope, 0.5) AS edge FROM a1 GROUP BY series),
split AS (SELECT a1.*, CASE WHEN slope <= edge THEN 'ranging' WHEN slope > edge THEN 'trending' END AS trend FROM a1 JOIN a2 USING (series))"""


def robustness(split: str, by: str, sides: tuple[str, str]) -> str:
    one = lambda s: f"{s}0 AS (SELECT series, ts, open, high, low, close FROM split WHERE {by} = '{s}'), {oscillator(f'{s}0', f'{s}1')}, {coefficient(f'{s}1', f'{s}2')}"
    a, b = sides
    return f"""WITH RECURSIVE {BARS}, {split}, {one(a)}, {one(b)}
        SELECT x.series, x.n AS n_{a}, round(x.ic, 6) AS ic_{a}, y.n AS n_{b}, round(y.ic, 6) AS ic_{b}, round(abs(x.ic - y.ic), 6) AS difference,
               coalesce(x.ic >= 0.03 AND y.ic >= 0.03 AND abs(x.ic - y.ic) <= 0.02, false) AS robust FROM {a}2 x JOIN {b}2 y ON x.series = y.series"""


WALK = f"""c0 AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) AS rn, count(*) OVER (PARTITION BY series) AS size FROM b),
c1 AS (SELECT *, least((rn - 1) * 6 // size, 5)::INT AS fold FROM c0 WHERE size >= 180),
c2 AS (SELECT series || '#' || fold AS series, ts, open, high, low, close FROM c1 WHERE fold >= 1), {oscillator('c2', 'c3')}, {coefficient('c3', 'c4')}"""
ALONG = "WINDOW w AS (PARTITION BY series ORDER BY ts)"


def begun_with_mean(x: str, share: float, n: int) -> str:
    """A recursive average of the list ``x`` that begins with the mean of the first ``n``."""
    return f"CASE WHEN len({x}) >= {n} THEN list_reduce(list_concat([list_avg({x}[1:{n}])], {x}[{n + 1}:]), lambda a, z: a + {share!r} * (z - a)) END"


def classic(of: str, to: str, period: int = 32, smooth: str = "list_reduce(list(close) OVER w, lambda a, z: a + (z - a) / 3)") -> str:
    return f"""{to}_a AS (SELECT *, row_number() OVER w AS rn, {TRUE_RANGE} AS tr, {smooth} AS smooth FROM {of} {ALONG}),
{to}_b AS (SELECT *, sum(tr) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN {period - 1} PRECEDING AND CURRENT ROW) / {period} AS atr FROM {to}_a),
{to}_c AS (SELECT *, least(min(atr) OVER p, atr) AS lo, greatest(max(atr) OVER p, atr) AS hi FROM {to}_b WINDOW p AS (PARTITION BY series ORDER BY ts ROWS BETWEEN {period - 1} PRECEDING AND 1 PRECEDING)),
{to}_d AS (SELECT series, ts, rn, smooth AS close, 1 - 10 / ({period} * (CASE WHEN lo = hi THEN 0.5 ELSE 1 - (atr - lo) / (hi - lo) END + 0.75) + 9) AS gamma FROM {to}_c),
{stages(f'{to}_d', to, seeded=True)}"""
