"""Pieces of DuckDB SQL that the oracles of several queries share."""

from __future__ import annotations

from collections.abc import Sequence

from vibrata.functions.wavelet import DETAIL, SMOOTH

SIGNAL = "sig AS (SELECT event_type AS signal_id, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS idx, value FROM events)"
CELLS = """cells AS (SELECT event_type AS signal_id, 'c' || (user_id % 3)::VARCHAR AS condition,
  row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY ts) - 1 AS idx, value, (props->>'$.k')::DOUBLE AS k FROM events)"""


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"


def windows(source: str, keys: Sequence[str], size: int, step: int, name: str = "win", value: str = "value") -> str:
    """``name`` (keys, ws, i, x) of complete windows."""
    k = ", ".join(keys)
    on = " AND ".join(f"s.{c} = k.{c}" for c in keys)
    return f"""{name}_n AS (SELECT {k}, count(*) AS n FROM {source} GROUP BY {k}),
{name}_k AS (SELECT {k}, unnest(range(0, (n - {size}) // {step} + 1)) * {step} AS ws FROM {name}_n WHERE n >= {size}),
{name} AS (SELECT {', '.join('k.' + c for c in keys)}, k.ws, s.idx - k.ws AS i, s.{value} AS x FROM {name}_k k JOIN {source} s ON {on} AND s.idx BETWEEN k.ws AND k.ws + {size - 1})"""


def time_features(source: str, keys: Sequence[str], name: str) -> str:
    """``name`` (keys, ws, the plain features) of windows (keys, ws, i, x)."""
    k = ", ".join(keys)
    return f"""{name} AS (SELECT {k}, ws, avg(x) AS mean, var_pop(x) AS variance, sqrt(avg(x * x)) AS rms, skewness(x) AS skewness, kurtosis(x) AS kurtosis,
  sum(CASE WHEN before IS NOT NULL AND sign(x) <> sign(before) THEN 1 ELSE 0 END) / (count(*) - 1.0) AS zcr,
  quantile_cont(x, 0.25) AS quantile_25, quantile_cont(x, 0.5) AS quantile_50, quantile_cont(x, 0.75) AS quantile_75
  FROM (SELECT *, lag(x) OVER (PARTITION BY {k}, ws ORDER BY i) AS before FROM {source}) GROUP BY {k}, ws)"""


def modwt(source: str, keys: Sequence[str], level: int, name: str) -> str:
    """``name`` (keys, band, i, v) from (keys, i, x), a signal or window for each key, with the levels that its length allows."""
    k = ", ".join(keys)
    taps = ", ".join(f"({i}, {g!r}, {h!r})" for i, (g, h) in enumerate(zip(SMOOTH, DETAIL, strict=True)))
    parts = [f"{name}_f(l, g, h) AS (VALUES {taps})", f"{name}_0 AS (SELECT *, least({level}, greatest(1, floor(log2(n / {len(SMOOTH) - 1}.0)))) AS lv FROM (SELECT {k}, i, x, count(*) OVER (PARTITION BY {k}) AS n FROM {source}))"]
    on = " AND ".join(f"b.{c} = a.{c}" for c in keys)
    for j in range(1, level + 1):
        stride = 1 << (j - 1)
        parts.append(
            f"{name}_{j} AS (SELECT {', '.join('a.' + c for c in keys)}, a.i, a.n, a.lv, sum(f.g * b.x) AS x, sum(f.h * b.x) AS d FROM {name}_{j - 1} a CROSS JOIN {name}_f f "
            f"JOIN {name}_{j - 1} b ON {on} AND b.i = (a.i - {stride} * f.l + 8 * a.n) % a.n GROUP BY ALL)"
        )
    bands = [f"SELECT {k}, 'D{j}' AS band, i, d AS v FROM {name}_{j} WHERE lv >= {j} UNION ALL SELECT {k}, 'A{j}' AS band, i, x AS v FROM {name}_{j} WHERE lv = {j}" for j in range(1, level + 1)]
    parts.append(f"{name} AS ({' UNION ALL '.join(bands)})")
    return ",\n".join(parts)


def histogram(source: str, keys: Sequence[str], value: str, name: str, bins: int = 50) -> str:
    """``name`` (keys, c0, c1, cs, ps): first and last centre, centres and masses."""
    k = ", ".join(keys)
    return f"""{name}_r AS (SELECT {k}, min({value}) AS lo, max({value}) AS hi, count(*) AS n FROM {source} GROUP BY {k} HAVING max({value}) > min({value})),
{name}_c AS (SELECT {k}, least(floor(({value} - lo) / (hi - lo) * {bins}), {bins - 1})::INTEGER AS b, count(*) AS c FROM {source} JOIN {name}_r USING ({k}) GROUP BY ALL),
{name}_b AS (SELECT {k}, b, lo + (b + 0.5) * ((hi - lo) / {bins}) AS center, (coalesce(c, 0) + 1.0) / (n + {bins}) AS prob
  FROM (SELECT *, unnest(range({bins}))::INTEGER AS b FROM {name}_r) LEFT JOIN {name}_c USING ({k}, b)),
{name} AS (SELECT {k}, min(center) AS c0, max(center) AS c1, list(center ORDER BY b) AS cs, list(prob ORDER BY b) AS ps FROM {name}_b GROUP BY {k})"""


def _interpolated(x: str, side: str, bins: int) -> str:
    place = f"(({x}) - {side}.c0) / ({side}.c1 - {side}.c0) * {bins - 1}"
    low = f"least(greatest(floor({place}), 0), {bins - 2})::INTEGER"
    return f"CASE WHEN ({x}) < {side}.c0 - ({side}.c1 - {side}.c0) * 1e-9 OR ({x}) > {side}.c1 + ({side}.c1 - {side}.c0) * 1e-9 THEN 0.0 ELSE {side}.ps[{low} + 1] + ({side}.ps[{low} + 2] - {side}.ps[{low} + 1]) * ({place} - {low}) END"


def aligned(pairs: str, columns: str, name: str, bins: int = 50) -> str:
    """``name`` (columns, p, q) from ``pairs``, a FROM clause with distributions p and q."""
    low, high = "least(p.c0, q.c0)", "greatest(p.c1, q.c1)"
    x = f"CASE WHEN g.g = {bins - 1} THEN {high} ELSE {low} + g.g * (({high} - {low}) / {bins - 1}) END"
    return f"""{name}_g AS (SELECT {columns}, g.g, {_interpolated(x, 'p', bins)} + 1e-10 AS pv, {_interpolated(x, 'q', bins)} + 1e-10 AS qv
  FROM {pairs} CROSS JOIN range({bins}) g(g)),
{name} AS (SELECT * EXCLUDE (pv, qv, g), list(pv ORDER BY g) AS pl, list(qv ORDER BY g) AS ql FROM {name}_g GROUP BY ALL)"""


def _kl(p: str, q: str) -> str:
    clip = lambda a: f"greatest({a}, 1e-12)"
    return f"list_sum(list_transform(range(1, 51), lambda t: {clip(f'{p}[t]')} * ln({clip(f'{p}[t]')} / {clip(f'{q}[t]')})))"


def divergences(source: str, columns: str, name: str) -> str:
    """``name`` (columns, kl, sym, jsd) of the lists pl and ql, normalised here."""
    return f"""{name} AS (SELECT {columns}, {_kl('p', 'q')} AS kl, ({_kl('p', 'q')} + {_kl('q', 'p')}) / 2 AS sym, ({_kl('p', 'm')} + {_kl('q', 'm')}) / 2 AS jsd
  FROM (SELECT *, list_transform(range(1, 51), lambda t: (p[t] + q[t]) / 2) AS m
    FROM (SELECT *, list_transform(pl, lambda v: v / list_sum(pl)) AS p, list_transform(ql, lambda v: v / list_sum(ql)) AS q FROM {source})))"""


def uniform(seed: int, parts: Sequence[str], draw: str) -> str:
    text = ", ".join([f"'{seed}'", *(f"({p})::VARCHAR" for p in parts), f"'{draw}'"])
    return f"((('0x' || substr(md5(concat_ws('|', {text})), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"


def normal(seed: int, parts: Sequence[str], draw: str) -> str:
    return f"(sqrt(-2 * ln({uniform(seed, parts, draw + '1')})) * cos(2 * pi() * {uniform(seed, parts, draw + '2')}))"
