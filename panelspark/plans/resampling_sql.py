"""DuckDB SQL of the bootstrap and permutation tests whose draws are md5 hashes: replicates day by day, without running
sums. All texts begin with a comma and add common table expressions to a query."""

from __future__ import annotations

import math


def uniform(digest: str, at: int) -> str:
    return f"CAST(CAST('0x' || substr({digest}, {at}, 13) AS BIGINT) AS DOUBLE) / 4503599627370496"


def replicates(source: str, value: str, key: str, count: int, p: float, seed: int = 42) -> str:
    """bb: (key, replicate, n, mean, sharpe, cagr) of source (key, date, value)."""
    return f""", bs AS MATERIALIZED (SELECT {key} AS key, CAST({value} AS DOUBLE) AS x, row_number() OVER (PARTITION BY {key} ORDER BY date) - 1 AS spot FROM {source} WHERE {value} IS NOT NULL),
bn AS (SELECT key, count(*) AS n FROM bs GROUP BY key), br AS (SELECT key, n, CAST(ceil(n * {p!r} + 8 * sqrt(n * {p!r})) + 15 AS INTEGER) AS last, unnest(range({count})) AS replicate FROM bn),
bd AS (SELECT *, md5('{seed}:' || replicate || ':' || block) AS h FROM (SELECT *, unnest(range(last + 1)) AS block FROM br)),
bl AS (SELECT *, CAST(floor({uniform("h", 1)} * n) AS INTEGER) AS start, CAST(1 + floor(ln(1 - {uniform("h", 14)}) / {math.log(1 - p)!r}) AS INTEGER) AS length FROM bd),
bc AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY key, replicate ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM bl),
bi AS (SELECT key, n, replicate, (start + unnest(range(CAST(CASE WHEN block = last THEN n - before ELSE least(length, n - before) END AS INTEGER)))) % n AS spot FROM bc WHERE before < n),
ba AS (SELECT key, n, replicate, avg(x) AS mean, stddev_samp(x) AS sd, product(1 + x) AS grown FROM bi JOIN bs USING (key, spot) GROUP BY ALL),
bb AS (SELECT key, n, replicate, mean, CASE WHEN sd > 1e-12 THEN mean / sd * sqrt(252.0) ELSE 0 END AS sharpe, CASE WHEN grown > 0 THEN pow(grown, 252.0 / n) - 1 ELSE -1 END AS cagr FROM ba)"""


def permutations(source: str, count: int, seed: int = 42, least: int = 5) -> str:
    """pp: (replicate, ic), -1 the observed one, of source (date, ticker, x, y), x and y average ranks of a date."""
    return f""", p0 AS (SELECT *, x - avg(x) OVER d AS a, y - avg(y) OVER d AS b, count(*) OVER d AS n, row_number() OVER (PARTITION BY date ORDER BY ticker) AS place FROM {source} WINDOW d AS (PARTITION BY date)),
p1 AS MATERIALIZED (SELECT *, b / (sqrt(sum(a * a) OVER d) * sqrt(sum(b * b) OVER d)) AS w FROM p0 WHERE n >= {least} WINDOW d AS (PARTITION BY date) QUALIFY min(x) OVER d < max(x) OVER d AND min(y) OVER d < max(y) OVER d),
p2 AS (SELECT date, a, replicate, row_number() OVER (PARTITION BY date, replicate ORDER BY md5('{seed}:' || replicate || ':' || CAST(date AS VARCHAR) || ':' || ticker), ticker) AS place FROM p1, range({count}) r(replicate)),
p3 AS (SELECT p2.replicate, p2.date, sum(p2.a * p1.w) AS ic FROM p2 JOIN p1 USING (date, place) GROUP BY ALL UNION ALL SELECT -1, date, sum(a * w) FROM p1 GROUP BY date),
pp AS (SELECT replicate, avg(ic) AS ic FROM p3 GROUP BY replicate)"""
