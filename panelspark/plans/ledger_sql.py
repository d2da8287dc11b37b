"""DuckDB SQL of the execution ledger, metrics and linear models, for the queries that are compared with it.

The ledger is a recursive query: a row a run and session, which holds shares and pending orders as lists in the order
of tickers. All texts begin with a comma and add common table expressions to a query.
"""

from __future__ import annotations

#: Commission, spread and slippage in basis points, and the capital.
MEDIUM = (5.0, 5.0, 5.0)
CASH = 1e7


def costed(source: str, run: str = "'run'", costs: dict[str, tuple[float, float, float]] | None = None, where: str = "true") -> str:
    """SELECT of a run's rows (run_id, date, ticker, p, w, c, s, l) of source (date, ticker, adj_close, target_weight)."""
    rows = ", ".join(f"('{k}', {c / 1e4!r}, {s / 1e4!r}, {sl / 1e4!r})" for k, (c, s, sl) in (costs or {"": MEDIUM}).items())
    name = f"{run} || CASE WHEN k = '' THEN '' ELSE '/' || k END"
    return f"SELECT {name} AS run_id, date, ticker, adj_close AS p, CAST(target_weight AS DOUBLE) AS w, c, s, l FROM {source}, (VALUES {rows}) v(k, c, s, l) WHERE {where}"


def ledger(rows: str) -> str:
    """led: (run_id, k, date, equity, cash, holdings, gross, net, before, lists of fills) of the runs of rows."""
    each = lambda body: f"list_transform(range(1, len(p) + 1), lambda i: {body})"
    total = lambda values: f"coalesce(list_sum({values}), 0.0)"
    orders = "CASE WHEN trades AND p[i] IS NOT NULL AND abs((coalesce(w[i], 0.0) * equity / p[i] - sh[i]) * p[i]) >= 10.0 THEN coalesce(w[i], 0.0) * equity / p[i] - sh[i] END"
    return f""", lr AS MATERIALIZED ({rows}), lt AS (SELECT DISTINCT run_id, ticker FROM lr),
ld AS (SELECT run_id, date, row_number() OVER (PARTITION BY run_id ORDER BY date) AS k, count(*) OVER (PARTITION BY run_id) AS n FROM (SELECT DISTINCT run_id, date FROM lr)),
lday AS MATERIALIZED (SELECT run_id, ld.date, k, k < n AS trades, max(c) AS c, max(s) AS s, max(l) AS l, list(ticker ORDER BY ticker) AS tickers, list(CASE WHEN lr.p > 0 THEN lr.p END ORDER BY ticker) AS p, list(lr.w ORDER BY ticker) AS w
 FROM ld JOIN lt USING (run_id) LEFT JOIN lr USING (run_id, date, ticker) GROUP BY run_id, ld.date, k, n),
led AS (SELECT run_id, k, date, tickers, p, w, c, s, l, sh, cash, equity, before, hv, fq, fp, pw, {each(orders)} AS pend FROM
 (SELECT *, list_transform(p, lambda x: CAST(0 AS DOUBLE)) AS sh, CAST({CASH!r} AS DOUBLE) AS cash, CAST({CASH!r} AS DOUBLE) AS equity, CAST({CASH!r} AS DOUBLE) AS before, list_transform(p, lambda x: CAST(NULL AS DOUBLE)) AS hv, list_transform(p, lambda x: CAST(NULL AS DOUBLE)) AS fq, list_transform(p, lambda x: CAST(NULL AS DOUBLE)) AS fp, list_transform(p, lambda x: CAST(NULL AS DOUBLE)) AS pw FROM lday WHERE k = 1)
 UNION ALL
 SELECT run_id, k, date, tickers, p, w, c, s, l, sh, cash, equity, before, hv, fq, fp, pw, {each(orders)} AS pend FROM
 (SELECT *, cash + {total("hv")} AS equity FROM
 (SELECT *, {each("sh[i] * p[i]")} AS hv FROM
 (SELECT * EXCLUDE (sh, cash), {each("CASE WHEN fq[i] IS NOT NULL AND abs(sh[i] + fq[i]) < 1e-6 THEN 0.0 ELSE sh[i] + coalesce(fq[i], 0.0) END")} AS sh, cash - {total(each("fq[i] * fp[i] + abs(fq[i]) * p[i] * c"))} AS cash FROM
 (SELECT *, {each("CASE WHEN fq[i] > 0 THEN p[i] * (1 + (s + l)) WHEN fq[i] < 0 THEN greatest(p[i] * (1 - (s + l)), 0.01) END")} AS fp FROM
 (SELECT d.*, led.sh, led.cash, led.equity AS before, led.w AS pw, list_transform(range(1, len(d.p) + 1), lambda i: CASE WHEN d.p[i] IS NOT NULL THEN led.pend[i] END) AS fq FROM led JOIN lday d ON d.run_id = led.run_id AND d.k = led.k + 1))))))"""


def snapshots() -> str:
    """sn: what the ledger's snapshots hold."""
    cost = lambda rate: f"coalesce(list_sum(list_transform(range(1, len(p) + 1), lambda i: abs(fq[i]) * p[i] * {rate})), 0.0)"
    return f""", sx AS (SELECT run_id, date, equity, cash, before, coalesce(list_sum(list_filter(hv, lambda x: x > 0)), 0.0) AS long, -coalesce(list_sum(list_filter(hv, lambda x: x < 0)), 0.0) AS short,
 coalesce(list_sum(list_transform(range(1, len(p) + 1), lambda i: abs(fq[i]) * fp[i])), 0.0) AS traded, {cost("c")} AS commission, {cost("l")} AS slippage_cost, {cost("s")} AS spread_cost FROM led),
sn AS (SELECT run_id, date, equity, cash, long - short AS holdings_value, CASE WHEN equity > 0 THEN (long + short) / equity ELSE 0 END AS gross_exposure, CASE WHEN equity > 0 THEN (long - short) / equity ELSE 0 END AS net_exposure,
 CASE WHEN equity > 0 THEN cash / equity ELSE 1 END AS cash_ratio, CASE WHEN before > 0 AND abs(equity - before) > 1e-12 * before THEN (equity - before) / before ELSE 0 END AS daily_return, CASE WHEN equity > 0 THEN traded / equity ELSE 0 END AS turnover,
 commission, slippage_cost, spread_cost, commission + spread_cost + slippage_cost AS total_cost, CAST(NULL AS DOUBLE) AS gross_return FROM sx)"""


def fills() -> str:
    """fl: the ledger's fills."""
    one = lambda x: f"unnest({x})"
    return f""", fx AS (SELECT run_id, date, {one("tickers")} AS ticker, {one("fq")} AS q, {one("fp")} AS fill_price, {one("p")} AS reference_price, {one("pw")} AS target_weight, c, s, l FROM led),
fl AS (SELECT run_id, date, ticker, CASE WHEN q > 0 THEN 'BUY' ELSE 'SELL' END AS direction, abs(q) AS quantity, reference_price, fill_price, abs(q) * reference_price * c AS commission, abs(q) * reference_price * s AS spread_cost, abs(q) * reference_price * l AS slippage_cost, coalesce(target_weight, 0.0) AS target_weight FROM fx WHERE q IS NOT NULL)"""


def metrics(source: str = "sn", key: str = "run_id") -> str:
    """pm: the fifteen metrics of source, unrounded."""
    w = f"(PARTITION BY {key} ORDER BY date)"
    zero = lambda c: f"CASE WHEN t < 2 THEN 0 ELSE {c} END"
    drag = "(pow(exp(log_gross - ln(1 + first_gross)), 252.0 / n_gross) - 1 - cagr) * 1e4"
    return f""", m0 AS (SELECT *, coalesce(equity / nullif(max(equity) OVER {w}, 0) - 1, 0) AS fall, row_number() OVER {w} AS seen FROM {source} WHERE daily_return IS NOT NULL),
m1 AS (SELECT *, seen - max(seen) FILTER (fall >= 0) OVER {w} AS below FROM m0),
m2 AS (SELECT {key}, count(*) AS t, avg(daily_return) AS m, stddev_samp(daily_return) AS sd, arg_min(equity, date) AS e0, arg_max(equity, date) AS e1, coalesce(sqrt(avg(daily_return * daily_return) FILTER (daily_return < 0)) * sqrt(252.0), 1e-6) AS down,
 avg((daily_return > 0)::INT) AS hit, coalesce(sum(daily_return) FILTER (daily_return > 0), 0) AS g, coalesce(-sum(daily_return) FILTER (daily_return < 0), 0) AS l, coalesce(avg(turnover), 0) AS turn, coalesce(sum(total_cost), 0) AS spent,
 count(gross_return) AS n_gross, sum(ln(greatest(1 + gross_return, 1e-300))) AS log_gross, arg_min(gross_return, date) FILTER (gross_return IS NOT NULL) AS first_gross, min(fall) AS mdd, max(below) AS days FROM m1 GROUP BY {key}),
m3 AS (SELECT *, CASE WHEN CASE WHEN e0 > 0 THEN e1 / e0 ELSE 1 END > 0 THEN pow(CASE WHEN e0 > 0 THEN e1 / e0 ELSE 1 END, 252.0 / t) - 1 ELSE -1 END AS cagr FROM m2),
pm AS (SELECT {key}, {zero("cagr")} AS cagr, {zero("m * 252")} AS annualized_return, {zero("sd * sqrt(252.0)")} AS annualized_volatility, {zero("CASE WHEN sd > 1e-12 THEN m / sd * sqrt(252.0) ELSE 0 END")} AS sharpe_ratio, {zero("CASE WHEN down > 1e-12 THEN m * 252 / down ELSE 0 END")} AS sortino_ratio,
 {zero("mdd")} AS max_drawdown, {zero("days")} AS max_drawdown_duration_days, {zero("CASE WHEN abs(mdd) > 1e-6 THEN cagr / abs(mdd) ELSE 0 END")} AS calmar_ratio, {zero("hit")} AS daily_hit_rate, {zero("CASE WHEN l > 1e-12 THEN g / l WHEN g > 0 THEN 100 ELSE 0 END")} AS profit_factor,
 {zero("turn")} AS average_daily_turnover, {zero("turn * 252")} AS annualized_turnover, spent AS total_cost_usd, {zero(f"CASE WHEN n_gross > 0 THEN {drag} ELSE 0 END")} AS cost_drag_bps, t AS total_trading_days FROM m3)"""


RATES = ("cagr", "annualized_return", "annualized_volatility", "sharpe_ratio", "sortino_ratio", "max_drawdown", "calmar_ratio", "daily_hit_rate", "profit_factor", "average_daily_turnover", "annualized_turnover")


def rounded_metrics(key: str = "run_id", digits: int = 5) -> str:
    """The columns of pm, rounded as the queries round them."""
    return f"{key}, max_drawdown_duration_days, total_trading_days, " + ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in RATES) + ", round(total_cost_usd, 1) + 0.0 AS total_cost_usd, round(cost_drag_bps, 2) + 0.0 AS cost_drag_bps"


def normal_cdf(x: str) -> str:
    """By the series of odd powers over odd double factorials; for |x| up to about 8."""
    term = f"exp((2 * j + 1) * ln(abs({x})) + j * ln(2.0) + lgamma(j + 1.0) - lgamma(2 * j + 2.0))"
    return f"(CASE WHEN {x} = 0 THEN 0.5 WHEN {x} < -8 THEN 0.0 WHEN {x} > 8 THEN 1.0 ELSE 0.5 + sign({x}) * exp(-{x} * {x} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 150), lambda j: {term})) END)"


def sharpe_probability(benchmark: float) -> str:
    """P(true yearly Sharpe ratio > benchmark) of (n, mean, std, skew, kurtosis)."""
    spread = "(1 - skew * (mean / std) + (kurtosis - 1) / 4 * pow(mean / std, 2))"
    z = f"((mean / std - {benchmark / 252**0.5!r}) * sqrt(n - 1.0) / sqrt({spread}))"
    return f"CASE WHEN n < 5 OR std IS NULL OR std < 1e-12 OR {spread} <= 0 THEN 0.5 ELSE {normal_cdf(z)} END"


def linear_model(source: str, features: tuple[str, ...], target: str, ridge: float = 0.0, lasso: float = 0.0) -> str:
    """lm: one row of coefficients b1..bd and the intercept b0 of target on features, scaled by their population
    deviations; by elimination, or for lasso by coordinate descent, a row of a recursive query each round."""
    d = len(features)
    z = {i: f"((CAST({f} AS DOUBLE) - m{i}) / sd{i})" for i, f in enumerate(features, 1)}
    known = " AND ".join(f"{c} IS NOT NULL" for c in (*features, target))
    stats = ", ".join(f"avg({f}) AS m{i}, stddev_pop({f}) AS sd{i}" for i, f in enumerate(features, 1))
    cross = [f"sum({z[i]} * {z[j]}) / count(*) + {ridge if i == j else 0.0!r} / count(*) AS a{i}_{j}" for i in z for j in z]
    right = [f"sum({z[i]} * (CAST({target} AS DOUBLE) - my)) / count(*) AS a{i}_{d + 1}" for i in z]
    out = f""", lx AS MATERIALIZED (SELECT * FROM {source} WHERE {known}), ls AS (SELECT {stats}, avg({target}) AS my FROM lx), e0 AS MATERIALIZED (SELECT {", ".join(cross + right)} FROM lx, ls)"""
    if lasso:
        left = lambda k: f"(a{k}_{d + 1} - " + " - ".join(f"a{k}_{j} * b{j}" for j in range(1, d + 1) if j != k) + ")"
        step = "SELECT 0 AS it, " + ", ".join(f"CAST(0 AS DOUBLE) AS b{k}" for k in range(1, d + 1))
        inner = "(SELECT g.*, e0.* FROM cd g, e0 WHERE it < 400)"
        for k in range(1, d + 1):
            inner = f"(SELECT * EXCLUDE (b{k}), sign({left(k)}) * greatest(abs({left(k)}) - {lasso!r}, 0) / a{k}_{k} AS b{k} FROM {inner})"
        out += f", cd AS ({step} UNION ALL SELECT it + 1, {', '.join(f'b{k}' for k in range(1, d + 1))} FROM {inner}), el AS (SELECT * FROM cd WHERE it = 400)"
    else:
        for k in range(1, d + 1):  # row k, divided by its pivot, leaves all other rows
            pivot = {j: f"(a{k}_{j} / a{k}_{k})" for j in range(k, d + 2)}
            columns = [f"{pivot[j]} AS a{i}_{j}" if i == k else f"a{i}_{j} - a{i}_{k} * {pivot[j]} AS a{i}_{j}" for i in range(1, d + 1) for j in range(k + 1, d + 2)]
            out += f", e{k} AS MATERIALIZED (SELECT {', '.join(columns)} FROM e{k - 1})"
        out += ", el AS (SELECT " + ", ".join(f"a{k}_{d + 1} AS b{k}" for k in range(1, d + 1)) + f" FROM e{d})"
    slopes = ", ".join(f"b{k} / sd{k} AS b{k}" for k in range(1, d + 1))
    return out + f", lm AS (SELECT {slopes}, my - " + " - ".join(f"b{k} / sd{k} * m{k}" for k in range(1, d + 1)) + " AS b0 FROM el, ls)"


def prediction(features: tuple[str, ...]) -> str:
    return "b0 + " + " + ".join(f"{f} * b{k}" for k, f in enumerate(features, 1))
