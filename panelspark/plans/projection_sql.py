"""DuckDB SQL of the projection on exposure limits: levels by windows over the bends, then the four cases. All texts begin
with a comma and add common table expressions to a query."""

from __future__ import annotations


def level(name: str, value: str, cap: float, target: str) -> str:
    """name: (date, t) with sum(min(max(y - t, 0), cap)) = target over y = value in pw (date, w), target of pl (date)."""
    over = "(PARTITION BY date ORDER BY b DESC, d DESC ROWS UNBOUNDED PRECEDING)"
    return f""", {name}_b AS (SELECT date, {value} AS b, 1 AS d FROM pw UNION ALL SELECT date, {value} - {cap!r}, -1 FROM pw),
{name}_s AS (SELECT date, b, d, sum(d) OVER {over} AS slope, lead(b) OVER (PARTITION BY date ORDER BY b DESC, d DESC) AS next FROM {name}_b),
{name}_g AS (SELECT *, coalesce(sum(slope * (b - next)) OVER {over}, 0) AS high FROM {name}_s),
{name} AS (SELECT date, CASE WHEN {target} <= 0 THEN max(b) ELSE coalesce(max(b - ({target} - (high - slope * (b - next))) / slope) FILTER (slope > 0 AND high >= {target} AND high - slope * (b - next) < {target}), min(b)) END AS t FROM {name}_g JOIN pl USING (date) GROUP BY date, {target})"""


def projected(source: str, cap: float, gross: float, net: float) -> str:
    """px: (date, ticker, target_weight) of source (date, ticker, w), moved to the nearest weights within the limits."""
    clip = lambda x: f"greatest(least({x}, {cap!r}), -{cap!r})"
    part = lambda x: f"least(greatest({x}, 0), {cap!r})"
    soft = f"sign(w) * {part('abs(w) - m')}"
    return f""", pw AS MATERIALIZED (SELECT date, ticker, CAST(w AS DOUBLE) AS w FROM {source} WHERE w IS NOT NULL),
pl AS (SELECT date, {gross!r} AS gross FROM pw GROUP BY date){level("pm_", "abs(w)", cap, "gross")},
p1 AS (SELECT date, CASE WHEN sum(abs({clip("w")})) > {gross!r} THEN greatest(max(t), 0) ELSE 0 END AS m, sum({clip("w")}) AS clipped, max(abs(w)) AS top, sum(abs(w)) AS size, sum(w) AS total FROM pw JOIN pm_ USING (date) GROUP BY date),
p2 AS (SELECT date, any_value(m) AS m, any_value(clipped) AS clipped, sum({soft}) AS total, count(*) AS n, any_value(top) > {cap + 1e-6!r} OR any_value(size) > {gross + 1e-6!r} OR abs(any_value(p1.total)) > {net + 1e-6!r} AS breaks FROM pw JOIN p1 USING (date) GROUP BY date),
p3 AS MATERIALIZED (SELECT *, sign(total) AS side, abs(total) > {net!r} AS beyond FROM p2){level("pa", f"w + {cap!r}", 2 * cap, f"side * {net!r} + n * {cap!r}").replace("JOIN pl USING", "JOIN p3 USING")}
{level("pu", "w", cap, f"({gross!r} + side * {net!r}) / 2").replace("JOIN pl USING", "JOIN p3 USING")}{level("pd", "-w", cap, f"({gross!r} - side * {net!r}) / 2").replace("JOIN pl USING", "JOIN p3 USING")},
p4 AS (SELECT p3.date, any_value(side * clipped > {net!r}) AND sum(abs({clip("w - pa.t")})) <= {gross!r} + 1e-12 AS alone FROM p3 JOIN pw USING (date) JOIN pa USING (date) GROUP BY p3.date),
px AS (SELECT date, ticker, CASE WHEN NOT breaks THEN w WHEN NOT beyond THEN {soft} WHEN alone THEN {clip("w - pa.t")} ELSE {part("w - pu.t")} - {part("-w - pd.t")} END AS target_weight FROM pw JOIN p3 USING (date) JOIN p4 USING (date) JOIN pa USING (date) JOIN pu USING (date) JOIN pd USING (date))"""
