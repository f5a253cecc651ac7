"""DuckDB SQL for the registered panel queries, put together from common table expressions."""

from __future__ import annotations

import math

from ..functions.statistics import ERFC_EDGE, LEVELS, SERIES
from ..operators.factors import FACTORS
from ..sources.bars import BARS_SQL

# name: (text, names it reads)
CTES: dict[str, tuple[str, str]] = {}


def cte(name: str, text: str, needs: str = "") -> None:
    CTES[name] = (text, needs)


def with_(needs: str, select: str) -> str:
    """WITH the named expressions and all they read, then ``select``."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in CTES[name][1].split():
            add(n)
        if name not in order:
            order.append(name)

    for n in needs.split():
        add(n)
    parts = [CTES[n][0] for n in order]
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + select


def r(columns: str, digits: int = 6, exact: bool = False) -> str:
    """Column list in which names that end in * are rounded, as decimals if ``exact``."""
    number = lambda c: f"CAST(round(CAST({c} AS DECIMAL(28,9)), {digits}) AS DOUBLE)" if exact else f"round({c}, {digits})"
    return ", ".join(f"{number(c[:-1])} AS {c[:-1]}" if c.endswith("*") else c for c in columns.split())


H = (5, 20, 60)
NAMES = ", ".join(f.name for f in FACTORS)
FAMILY = "CASE factor_name " + " ".join(f"WHEN '{f.name}' THEN '{f.family}'" for f in FACTORS) + " END"
DIRECTION = "CASE factor_name " + " ".join(f"WHEN '{f.name}' THEN {f.direction}" for f in FACTORS) + " END"
NEUTRAL = "(factor_name <> 'log_market_cap')"
PRIMARY = "CASE WHEN factor_name = 'log_market_cap' THEN 'score' ELSE 'score_size_neutral' END"
CANDIDATES = "('reversal_5', 'reversal_20', 'turnover_20', 'amihud_20', 'volatility_20', 'volatility_60')"

cte("bars", BARS_SQL)
cte(
    "v",
    "v AS (SELECT *, coalesce(isfinite(close_adj) AND close_adj > 0 AND volume > 0 AND amount > 0, false) AS is_valid FROM bars)",
    "bars",
)
cte(
    "uni",
    """u0 AS (SELECT *, CAST(sum(CAST(is_valid AS INT)) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS history_observations,
  CASE WHEN is_valid AND count(amount) OVER w = 20 THEN avg(amount) OVER w END AS amount_mean FROM v
  WINDOW w AS (PARTITION BY symbol, is_valid ORDER BY date ROWS 19 PRECEDING)),
u1 AS (SELECT *, coalesce(is_valid AND history_observations >= 52 AND NOT is_st AND open_raw > 0 AND high_raw > 0 AND low_raw > 0 AND close_raw > 0 AND amount_mean > 0, false) AS passes FROM u0),
u2 AS (SELECT *, CASE WHEN passes THEN row_number() OVER (PARTITION BY date, passes ORDER BY amount_mean DESC NULLS LAST, symbol) END AS liquidity_rank FROM u1),
uni AS (SELECT *, coalesce(passes AND liquidity_rank <= 50, false) AS is_eligible FROM u2)""",
    "v",
)
cte(
    "muni",
    """m0 AS (SELECT *, count(date) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS history_observations,
  CASE WHEN count(amount) OVER w = 20 THEN avg(amount) OVER w END AS amount_mean FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)),
m1 AS (SELECT *, CASE WHEN amount_mean IS NOT NULL THEN row_number() OVER (PARTITION BY date ORDER BY amount_mean DESC NULLS LAST, symbol) END AS liquidity_rank FROM m0),
muni AS (SELECT *, coalesce(history_observations >= 52 AND NOT is_st AND open_raw > 0 AND high_raw > 0 AND low_raw > 0 AND close_raw > 0 AND amount_mean > 0 AND liquidity_rank <= 50, false) AS is_eligible FROM m1)""",
    "bars",
)
cte(
    "msig",
    """s0 AS (SELECT *, close_adj / lag(close_adj, 8) OVER w - 1 AS momentum, lead(close_adj, 4) OVER w / close_adj - 1 AS forward_return FROM muni WINDOW w AS (PARTITION BY symbol ORDER BY date)),
s1 AS (SELECT *, avg(CASE WHEN is_eligible THEN momentum END) OVER d AS m, stddev_samp(CASE WHEN is_eligible THEN momentum END) OVER d AS s FROM s0 WINDOW d AS (PARTITION BY date)),
msig AS (SELECT *, CASE WHEN is_eligible AND s > 0 THEN (momentum - m) / s END AS momentum_z FROM s1)""",
    "muni",
)
cte("sig", "sig AS (SELECT max(date) AS date FROM bars GROUP BY date_trunc('month', date))", "bars")
cte("cal", "cal AS (SELECT date, lead(date) OVER (ORDER BY date) AS next_date FROM (SELECT DISTINCT date FROM bars))", "bars")
cte(
    "lab",
    "l0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM v),\nlab AS (SELECT date, symbol, "
    + ", ".join(
        f"CASE WHEN is_valid THEN lead(close_adj, {h}) OVER w / close_adj - 1 END AS forward_return_{h}, "
        f"CASE WHEN is_valid THEN CAST(lead(date, {h}) OVER w - date AS INT) END AS forward_calendar_days_{h}, "
        f"CASE WHEN is_valid THEN CAST(lead(i, {h}) OVER w - i - {h} AS INT) END AS forward_skipped_observations_{h}"
        for h in H
    )
    + " FROM l0 WINDOW w AS (PARTITION BY symbol, is_valid ORDER BY date))",
    "v",
)
cte(
    "fac",
    """f0 AS (SELECT *, CASE WHEN close_adj > 0 AND prev_close_adj > 0 THEN close_adj / prev_close_adj - 1 END AS ret FROM v),
f1 AS (SELECT *, abs(ret) / amount AS ill FROM f0),
fac AS (SELECT date, symbol, CASE WHEN pe_ttm > 0 THEN 1 / pe_ttm END AS ep_ttm, CASE WHEN pb > 0 THEN 1 / pb END AS bp, CASE WHEN ps_ttm > 0 THEN 1 / ps_ttm END AS sp_ttm,
  CASE WHEN is_valid THEN close_adj / lag(close_adj, 60) OVER w - 1 END AS momentum_60, CASE WHEN is_valid THEN close_adj / lag(close_adj, 120) OVER w - 1 END AS momentum_120,
  CASE WHEN is_valid THEN lag(close_adj, 21) OVER w / lag(close_adj, 252) OVER w - 1 END AS momentum_12_1,
  CASE WHEN is_valid THEN close_adj / lag(close_adj, 5) OVER w - 1 END AS reversal_5, CASE WHEN is_valid THEN close_adj / lag(close_adj, 20) OVER w - 1 END AS reversal_20,
  CASE WHEN is_valid AND count(turnover) OVER w20 = 20 THEN avg(turnover) OVER w20 END AS turnover_20, CASE WHEN is_valid AND count(ill) OVER w20 = 20 THEN avg(ill) OVER w20 END AS amihud_20,
  CASE WHEN is_valid AND count(ret) OVER w20 = 20 THEN stddev_samp(ret) OVER w20 * sqrt(252.0::DOUBLE) END AS volatility_20,
  CASE WHEN is_valid AND count(ret) OVER w60 = 60 THEN stddev_samp(ret) OVER w60 * sqrt(252.0::DOUBLE) END AS volatility_60,
  CASE WHEN is_valid AND count(ret) OVER w60 = 60 THEN sqrt(avg(pow(least(ret, 0.0), 2)) OVER w60) * sqrt(252.0::DOUBLE) END AS downside_volatility_60,
  CASE WHEN total_market_cap > 0 THEN ln(total_market_cap) END AS log_market_cap FROM f1
  WINDOW w AS (PARTITION BY symbol, is_valid ORDER BY date), w20 AS (PARTITION BY symbol, is_valid ORDER BY date ROWS 19 PRECEDING), w60 AS (PARTITION BY symbol, is_valid ORDER BY date ROWS 59 PRECEDING))""",
    "v",
)
cte(
    "pan",
    f"""wide AS (SELECT u.date, u.symbol, {", ".join("f." + x.name for x in FACTORS)} FROM uni u JOIN sig USING (date) LEFT JOIN fac f ON f.date = u.date AND f.symbol = u.symbol WHERE u.is_eligible),
pan AS (SELECT date, symbol, factor_name, {FAMILY} AS family, raw_value FROM (SELECT * FROM wide UNPIVOT INCLUDE NULLS (raw_value FOR factor_name IN ({NAMES}))))""",
    "uni sig fac",
)
cte(
    "sco",
    f"""p0 AS (SELECT *, quantile_cont(raw_value, 0.01) OVER c AS lo, quantile_cont(raw_value, 0.99) OVER c AS hi FROM pan WINDOW c AS (PARTITION BY date, factor_name)),
p1 AS (SELECT *, CASE WHEN raw_value IS NOT NULL THEN least(greatest(raw_value, lo), hi) END AS winsorized_value FROM p0),
p2 AS (SELECT *, count(winsorized_value) OVER c AS n, avg(winsorized_value) OVER c AS m, stddev_pop(winsorized_value) OVER c AS s, max(winsorized_value) OVER c = min(winsorized_value) OVER c AS flat
  FROM p1 WINDOW c AS (PARTITION BY date, factor_name)),
p3 AS (SELECT *, CASE WHEN raw_value IS NULL THEN 'missing_raw_value' WHEN n < 2 THEN 'insufficient_valid_values' WHEN flat THEN 'zero_score_variance' END AS reason FROM p2),
p4 AS (SELECT date, symbol, factor_name, family, raw_value, winsorized_value, CASE WHEN reason IS NULL THEN {DIRECTION} * (winsorized_value - m) / s END AS score, reason FROM p3),
p5 AS (SELECT a.*, CASE WHEN a.score IS NOT NULL THEN b.score END AS x, CASE WHEN b.score IS NOT NULL THEN a.score END AS y FROM p4 a
  LEFT JOIN (SELECT date, symbol, score FROM p4 WHERE factor_name = 'log_market_cap') b USING (date, symbol)),
p6 AS (SELECT *, count(x) OVER c AS nx, avg(x) OVER c AS mx, avg(y) OVER c AS my, covar_pop(x, y) OVER c AS cxy, var_pop(x) OVER c AS vx FROM p5 WINDOW c AS (PARTITION BY date, factor_name)),
p7 AS (SELECT *, CASE WHEN vx > 0 THEN y - my - cxy / vx * (x - mx) END AS e FROM p6),
p8 AS (SELECT *, avg(e) OVER c AS me, stddev_pop(e) OVER c AS se FROM p7 WINDOW c AS (PARTITION BY date, factor_name)),
sco AS (SELECT date, symbol, factor_name, family, raw_value, winsorized_value, score, CASE WHEN {NEUTRAL} AND nx >= 3 AND se > 1e-12 THEN (e - me) / se END AS score_size_neutral,
  CASE WHEN factor_name IN ('ep_ttm', 'bp', 'sp_ttm') THEN 'unverified' ELSE 'ready' END AS point_in_time_status,
  coalesce(reason, CASE WHEN {NEUTRAL} THEN CASE WHEN score IS NOT NULL AND x IS NULL THEN 'missing_size_score' WHEN x IS NOT NULL AND nx < 3 THEN 'insufficient_size_samples' END END) AS preprocessing_reason FROM p8)""",
    "pan",
)
cte(
    "lsc",
    f"""lsc AS (SELECT date, symbol, factor_name, family, score_variant, value FROM (SELECT * FROM (SELECT date, symbol, factor_name, family, score, score_size_neutral FROM sco) UNPIVOT INCLUDE NULLS (value FOR score_variant IN (score, score_size_neutral))) WHERE score_variant = 'score' OR {NEUTRAL})""",
    "sco",
)
cte(
    "ic",
    """i0 AS (SELECT s.*, h.horizon, h.forward FROM lsc s LEFT JOIN (SELECT date, symbol, CAST(regexp_extract(label, '([0-9]+)$', 1) AS INT) AS horizon, forward FROM (SELECT * FROM (SELECT date, symbol, forward_return_5, forward_return_20, forward_return_60 FROM lab SEMI JOIN sig USING (date)) UNPIVOT INCLUDE NULLS (forward FOR label IN (forward_return_5, forward_return_20, forward_return_60)))) h USING (date, symbol)),
i1 AS (SELECT * FROM i0 WHERE value IS NOT NULL AND forward IS NOT NULL),
i2 AS (SELECT *, rank() OVER (g ORDER BY value) + (count(*) OVER (PARTITION BY date, factor_name, score_variant, horizon, value) - 1) / 2.0 AS rx,
  rank() OVER (g ORDER BY forward) + (count(*) OVER (PARTITION BY date, factor_name, score_variant, horizon, forward) - 1) / 2.0 AS ry FROM i1 WINDOW g AS (PARTITION BY date, factor_name, score_variant, horizon)),
i3 AS (SELECT date, factor_name, score_variant, horizon, count(*) AS n, corr(rx, ry) AS c, max(value) = min(value) AS cx, max(forward) = min(forward) AS cy FROM i2 GROUP BY ALL),
ic AS (SELECT k.*, coalesce(n, 0) AS n_obs, CASE WHEN n >= 20 AND NOT cx AND NOT cy THEN c END AS rank_ic,
  CASE WHEN coalesce(n, 0) < 20 THEN 'insufficient_observations' WHEN cx THEN 'constant_score' WHEN cy THEN 'constant_forward_return' END AS reason
  FROM (SELECT DISTINCT date, factor_name, family, score_variant, horizon FROM i0) k LEFT JOIN i3 USING (date, factor_name, score_variant, horizon))""",
    "lsc lab sig",
)
cte(
    "qr",
    """q0 AS (SELECT s.*, l.forward_return_20 AS f FROM lsc s JOIN lab l USING (date, symbol) WHERE value IS NOT NULL AND l.forward_return_20 IS NOT NULL),
q1 AS (SELECT *, count(*) OVER g AS n, row_number() OVER (g ORDER BY value, symbol) AS i FROM q0 WINDOW g AS (PARTITION BY date, factor_name, score_variant)),
qr AS (SELECT date, factor_name, family, score_variant, CAST((i - 1) * 5 // n + 1 AS INT) AS quantile, count(*) AS n_obs, avg(f) AS mean_return FROM q1 WHERE n >= 20 GROUP BY ALL)""",
    "lsc lab",
)


def spread(keys: str, source: str, name: str) -> str:
    return f"""{name}0 AS (SELECT {keys}, avg(d) AS spread FROM (SELECT date, {keys}, max(CASE WHEN quantile = 5 THEN mean_return END) - max(CASE WHEN quantile = 1 THEN mean_return END) AS d FROM {source} GROUP BY ALL) GROUP BY ALL),
{name}1 AS (SELECT {keys}, quantile, avg(mean_return) AS m FROM {source} GROUP BY ALL),
{name}2 AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY m) + (count(*) OVER (PARTITION BY {keys}, m) - 1) / 2.0 AS rk FROM {name}1),
{name} AS (SELECT * FROM {name}0 JOIN (SELECT {keys}, CASE WHEN count(*) = 5 THEN corr(CAST(quantile AS DOUBLE), rk) END AS monotonicity FROM {name}2 GROUP BY ALL) USING ({keys}))"""


cte("qs", spread("factor_name, family, score_variant", "qr", "qs"), "qr")
cte(
    "to_",
    """t0 AS (SELECT date, factor_name, family, score_variant, count(value) AS n FROM lsc GROUP BY ALL),
t1 AS (SELECT *, CAST(ceil(CAST(0.2 AS DOUBLE) * n) AS BIGINT) AS top_count, lag(date) OVER w AS previous_date, lag(CAST(ceil(CAST(0.2 AS DOUBLE) * n) AS BIGINT)) OVER w AS previous_top_count FROM t0
  WINDOW w AS (PARTITION BY factor_name, score_variant ORDER BY date)),
t2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY factor_name, score_variant, date ORDER BY value DESC, symbol) AS i FROM lsc WHERE value IS NOT NULL) JOIN t1 USING (date, factor_name, score_variant) WHERE i <= top_count),
t3 AS (SELECT a.date, a.factor_name, a.score_variant, count(*) AS k FROM t2 a JOIN t2 b ON a.factor_name = b.factor_name AND a.score_variant = b.score_variant AND a.symbol = b.symbol AND a.previous_date = b.date GROUP BY ALL),
to_ AS (SELECT date, factor_name, family, score_variant, previous_date, top_count, previous_top_count, CASE WHEN previous_date IS NOT NULL THEN
  least(1.0, greatest(0.0, 0.5 * ((top_count - kk) * nw + (previous_top_count - kk) * ow + kk * abs(nw - ow)))) END AS turnover
  FROM (SELECT t1.*, coalesce(k, 0) AS kk, CASE WHEN top_count > 0 THEN 1.0 / top_count ELSE 0 END AS nw, CASE WHEN previous_top_count > 0 THEN 1.0 / previous_top_count ELSE 0 END AS ow
  FROM t1 LEFT JOIN t3 USING (date, factor_name, score_variant)))""",
    "lsc",
)
cte(
    "sp",
    """sp AS (SELECT factor_name, family, score_variant, subperiod, p.s AS "start", p.e AS "end", count(CASE WHEN date BETWEEN p.s AND p.e THEN rank_ic END) AS valid_months, avg(CASE WHEN date BETWEEN p.s AND p.e THEN rank_ic END) AS mean_ic
  FROM ic, (VALUES ('1995-1997', DATE '1995-01-01', DATE '1997-12-31'), ('1998-1999', DATE '1998-01-01', DATE '1999-12-31'), ('2000-2001', DATE '2000-01-01', DATE '2001-12-31')) AS p(subperiod, s, e) WHERE horizon = 20 GROUP BY ALL)""",
    "ic",
)


def newey(source: str, keys: str, order: str, value: str, lag: str, name: str, most: int = 2) -> str:
    """Bartlett-kernel test with at most ``most`` lags."""
    steps = range(1, most + 1)
    return f"""{name}0 AS (SELECT {keys}, {order} AS o, {value} AS v, {value} - avg({value}) OVER k AS e FROM {source} WHERE {value} IS NOT NULL WINDOW k AS (PARTITION BY {keys})),
{name}1 AS (SELECT *, {", ".join(f"lag(e, {i}) OVER k AS e{i}" for i in steps)} FROM {name}0 WINDOW k AS (PARTITION BY {keys} ORDER BY o)),
{name}2 AS (SELECT {keys}, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS std, {lag} AS lag, sum(e * e) / count(*) AS g0, {", ".join(f"coalesce(sum(e * e{i}), 0) / count(*) AS g{i}" for i in steps)} FROM {name}1 GROUP BY {keys}),
{name} AS (SELECT *, CASE WHEN n > 1 AND lrv > 0 THEN mean / sqrt(lrv / n) END AS t FROM (SELECT *, g0 + {" + ".join(f"CASE WHEN least(lag, n - 1) >= {i} THEN 2 * (1 - {i} / (lag + 1.0::DOUBLE)) * g{i} ELSE 0 END" for i in steps)} AS lrv FROM {name}2))"""


LAG = "greatest(0, CAST(ceil(any_value(horizon) / 21.0) AS INT) - 1)"
cte("nw", newey("ic", "factor_name, score_variant, horizon", "date", "rank_ic", LAG, "nw"), "ic")
cte(
    "fs",
    """fs AS (SELECT k.*, c.coverage, coalesce(w.n, 0) AS valid_months, w.mean AS mean_ic, CASE WHEN w.n >= 2 THEN w.std END AS ic_std, CASE WHEN w.n >= 2 AND w.std > 0 THEN w.mean / w.std * sqrt(12.0::DOUBLE) END AS icir,
  pr.rate AS positive_ic_rate, w.lag AS nw_lag, w.t AS nw_t, q.spread AS q5_q1, q.monotonicity, tt.avg_turnover, st.point_in_time_status,
  CASE WHEN c.coverage = 0 THEN 'no_finite_scores' WHEN coalesce(w.n, 0) = 0 THEN 'no_valid_monthly_ic' END AS summary_reason
  FROM (SELECT DISTINCT factor_name, family, score_variant, horizon FROM ic) k LEFT JOIN nw w USING (factor_name, score_variant, horizon)
  LEFT JOIN (SELECT factor_name, score_variant, horizon, avg(CAST(rank_ic > 0 AS INT)) AS rate FROM ic WHERE rank_ic IS NOT NULL GROUP BY ALL) pr USING (factor_name, score_variant, horizon)
  LEFT JOIN (SELECT factor_name, score_variant, count(value) / count(*) AS coverage FROM lsc GROUP BY ALL) c USING (factor_name, score_variant)
  LEFT JOIN (SELECT *, 20 AS horizon FROM qs) q USING (factor_name, score_variant, horizon) LEFT JOIN (SELECT factor_name, score_variant, avg(turnover) AS avg_turnover FROM to_ GROUP BY ALL) tt USING (factor_name, score_variant)
  LEFT JOIN (SELECT factor_name, min(point_in_time_status) AS point_in_time_status FROM sco GROUP BY ALL) st USING (factor_name))""",
    "ic nw lsc qs to_ sco",
)
cte(
    "stat",
    f"""c0 AS (SELECT *, unnest(CASE WHEN factor_name IN ('reversal_20', 'turnover_20', 'volatility_60') THEN ['candidate_equal', 'family_equal', 'representative_equal'] ELSE ['candidate_equal', 'family_equal'] END) AS method
  FROM sco WHERE factor_name IN {CANDIDATES} AND score_size_neutral IS NOT NULL),
c1 AS (SELECT date, symbol, method, family, avg(score_size_neutral) AS f, count(*) AS k FROM c0 GROUP BY ALL),
c2 AS (SELECT date, symbol, method, CASE WHEN method = 'candidate_equal' THEN sum(f * k) / sum(k) ELSE avg(f) END AS raw_score, count(*) AS family_count, CAST(sum(k) AS BIGINT) AS factor_count FROM c1 GROUP BY date, symbol, method HAVING count(*) >= 2),
stat AS (SELECT *, CASE WHEN stddev_pop(raw_score) OVER g > 0 THEN (raw_score - avg(raw_score) OVER g) / stddev_pop(raw_score) OVER g ELSE 0 END AS score FROM c2 WINDOW g AS (PARTITION BY date, method))""",
    "sco",
)
cte(
    "wts",
    """real AS (SELECT date, date + CAST(max(forward_calendar_days_20) AS INT) AS realized FROM lab SEMI JOIN sig USING (date) GROUP BY date),
w0 AS (SELECT ic.*, realized FROM ic JOIN real USING (date) WHERE score_variant = 'score_size_neutral' AND horizon = 20 AND rank_ic IS NOT NULL),
wd AS (SELECT DISTINCT date AS weight_date FROM sco),
w1 AS (SELECT weight_date, date, row_number() OVER (PARTITION BY weight_date ORDER BY date DESC) AS i FROM (SELECT DISTINCT date, realized FROM w0) JOIN wd ON realized < weight_date),
w2 AS (SELECT weight_date, date FROM w1 WHERE i <= 24),
w3 AS (SELECT weight_date, min(date) AS history_start, max(date) AS history_end, count(*) AS history_months FROM w2 GROUP BY weight_date),
w4 AS (SELECT weight_date, factor_name, avg(rank_ic) AS m, count(*) AS n FROM w0 JOIN w2 USING (date) GROUP BY ALL),
w5 AS (SELECT wd.weight_date, c.*, coalesce(n, 0) AS n, greatest(coalesce(m, 0), 0) AS plus FROM wd, (VALUES ('reversal', 'reversal_5'), ('reversal', 'reversal_20'), ('liquidity', 'turnover_20'), ('liquidity', 'amihud_20'),
  ('low_volatility', 'volatility_20'), ('low_volatility', 'volatility_60')) AS c(family, factor_name) LEFT JOIN w4 ON w4.weight_date = wd.weight_date AND w4.factor_name = c.factor_name),
w6 AS (SELECT *, sum(plus) OVER g AS total, min(n) OVER g AS least_n FROM w5 WINDOW g AS (PARTITION BY weight_date, family)),
wts AS (SELECT w6.weight_date AS date, family, factor_name, CASE WHEN least_n < 12 OR total <= 0 THEN 0.5 ELSE 0.5 * 0.5 + 0.5 * plus / total END AS factor_weight, history_start, history_end, coalesce(history_months, 0) AS history_months,
  least_n < 12 OR total <= 0 AS fallback_equal FROM w6 LEFT JOIN w3 ON w3.weight_date = w6.weight_date)""",
    "ic lab sig sco",
)
cte(
    "roll",
    f"""g0 AS (SELECT s.date, s.symbol, s.family, sum(s.score_size_neutral * w.factor_weight) / sum(w.factor_weight) AS f, count(*) AS k FROM sco s JOIN wts w ON w.date = s.date AND w.factor_name = s.factor_name
  WHERE s.factor_name IN {CANDIDATES} AND s.score_size_neutral IS NOT NULL GROUP BY ALL),
g1 AS (SELECT date, symbol, 'rolling_ic_family' AS method, avg(f) AS raw_score, count(*) AS family_count, CAST(sum(k) AS BIGINT) AS factor_count FROM g0 GROUP BY date, symbol HAVING count(*) >= 2),
roll AS (SELECT *, CASE WHEN stddev_pop(raw_score) OVER g > 0 THEN (raw_score - avg(raw_score) OVER g) / stddev_pop(raw_score) OVER g ELSE 0 END AS score FROM g1 WINDOW g AS (PARTITION BY date, method))""",
    "sco wts",
)
cte("comp", "comp AS (SELECT date, symbol, method, score FROM stat UNION ALL SELECT date, symbol, method, score FROM roll)", "stat roll")
cte(
    "cic",
    """k0 AS (SELECT c.*, h.horizon, h.forward FROM comp c JOIN (SELECT date, symbol, CAST(regexp_extract(label, '([0-9]+)$', 1) AS INT) AS horizon, forward FROM (SELECT * FROM (SELECT date, symbol, forward_return_5, forward_return_20, forward_return_60 FROM lab) UNPIVOT INCLUDE NULLS (forward FOR label IN (forward_return_5, forward_return_20, forward_return_60)))) h USING (date, symbol)),
k1 AS (SELECT *, rank() OVER (g ORDER BY score) + (count(*) OVER (PARTITION BY date, method, horizon, score) - 1) / 2.0 AS rx, rank() OVER (g ORDER BY forward) + (count(*) OVER (PARTITION BY date, method, horizon, forward) - 1) / 2.0 AS ry
  FROM k0 WHERE score IS NOT NULL AND forward IS NOT NULL WINDOW g AS (PARTITION BY date, method, horizon)),
k2 AS (SELECT date, method, horizon, count(*) AS n, corr(rx, ry) AS c, max(score) = min(score) AS cx, max(forward) = min(forward) AS cy FROM k1 GROUP BY ALL),
cic AS (SELECT k.*, coalesce(n, 0) AS n_obs, CASE WHEN n >= 3 AND NOT cx AND NOT cy THEN c END AS rank_ic, CASE WHEN coalesce(n, 0) < 3 THEN 'insufficient_observations' WHEN cx THEN 'constant_score' WHEN cy THEN 'constant_forward_return' END AS reason
  FROM (SELECT DISTINCT date, method, horizon FROM k0) k LEFT JOIN k2 USING (date, method, horizon))""",
    "comp lab",
)
cte(
    "cqr",
    """e0 AS (SELECT c.*, l.forward_return_20 AS f FROM comp c JOIN lab l USING (date, symbol) WHERE score IS NOT NULL AND l.forward_return_20 IS NOT NULL),
e1 AS (SELECT *, count(*) OVER g AS n, row_number() OVER (g ORDER BY score, symbol) AS i FROM e0 WINDOW g AS (PARTITION BY date, method)),
cqr AS (SELECT date, method, CAST((i - 1) * 5 // n + 1 AS INT) AS quantile, count(*) AS n_obs, avg(f) AS mean_return FROM e1 GROUP BY ALL)""",
    "comp lab",
)
cte("cqs", spread("method", "cqr", "cqs"), "cqr")
cte("cnw", newey("cic", "method, horizon", "date", "rank_ic", LAG, "cnw"), "cic")
cte(
    "tgt",
    """y0 AS (SELECT date, symbol, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS i FROM stat WHERE method = 'family_equal'),
y1 AS (SELECT 'top10_equal' AS portfolio_name, date, symbol FROM y0 WHERE i <= 10 UNION ALL SELECT 'top20_equal', date, symbol FROM y0 WHERE i <= 20),
tgt AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY portfolio_name, date) AS target_weight FROM y1)""",
    "stat",
)
cte(
    "dia",
    """d0 AS (SELECT portfolio_name, date, lead(date) OVER (PARTITION BY portfolio_name ORDER BY date) AS nxt FROM (SELECT DISTINCT portfolio_name, date FROM tgt)),
d1 AS (SELECT portfolio_name, date, symbol, target_weight AS w FROM tgt UNION ALL SELECT portfolio_name, nxt, symbol, -target_weight FROM tgt JOIN d0 USING (portfolio_name, date) WHERE nxt IS NOT NULL),
d2 AS (SELECT portfolio_name, date, round(0.5 * sum(abs(d)), 12) AS one_way_turnover FROM (SELECT portfolio_name, date, symbol, sum(w) AS d FROM d1 GROUP BY ALL) GROUP BY ALL),
dia AS (SELECT *, 1 / hhi AS effective_holdings FROM (SELECT portfolio_name, date, count(*) AS holdings, max(target_weight) AS max_weight, sum(target_weight * target_weight) AS hhi FROM tgt GROUP BY ALL) JOIN d2 USING (portfolio_name, date))""",
    "tgt",
)
cte(
    "liq",
    "liq AS (SELECT date, symbol, CASE WHEN count(amount) OVER w = 20 THEN avg(amount) OVER w END AS amount_mean FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) QUALIFY date IN (SELECT date FROM sig))",
    "bars sig",
)
cte(
    "exe",
    """x0 AS (SELECT date, row_number() OVER (ORDER BY date) AS day FROM (SELECT DISTINCT date FROM bars)),
exe AS (SELECT b.*, avg(amount) OVER (PARTITION BY symbol ORDER BY day RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING) AS adv, CASE WHEN is_st THEN 0.05 ELSE 0.10 END::DOUBLE AS limit_rate, NOT coalesce(open_raw > 0, false) AS is_suspended FROM bars b JOIN x0 USING (date))""",
    "bars",
)
cte(
    "bench",
    """b0 AS (SELECT c.date, max(s.date) AS start FROM (SELECT date FROM cal) c LEFT JOIN (SELECT DISTINCT date FROM sco) s ON s.date < c.date GROUP BY c.date),
b1 AS (SELECT DISTINCT s.date AS start, s.symbol, b.total_market_cap AS cap, b.close_adj AS base FROM sco s JOIN bars b USING (date, symbol)),
b2 AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY start) AS we, cap / sum(cap) OVER (PARTITION BY start) AS wc FROM b1),
b3 AS (SELECT b0.date, b2.* FROM b0 JOIN b2 USING (start)),
b4 AS (SELECT b3.*, p.close_adj AS price FROM b3 ASOF JOIN bars p ON b3.symbol = p.symbol AND b3.date >= p.date),
b5 AS (SELECT start, date, sum(we * price / base) AS e, sum(wc * price / base) AS c, count(*) AS n FROM b4 GROUP BY ALL),
b6 AS (SELECT start, arg_max(e, date) AS e, arg_max(c, date) AS c FROM b5 GROUP BY start),
b7 AS (SELECT start, coalesce(exp(sum(ln(e)) OVER w), 1) AS be, coalesce(exp(sum(ln(c)) OVER w), 1) AS bc FROM b6 WINDOW w AS (ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
bench AS (SELECT b0.date, coalesce(be * e, 1) AS equal_weight, coalesce(bc * c, 1) AS cap_weight, coalesce(n, 0) AS member_count FROM b0 LEFT JOIN b5 ON b5.start = b0.start AND b5.date = b0.date LEFT JOIN b7 ON b7.start = b0.start)""",
    "cal sco bars",
)
cte("mkt", "mkt AS (SELECT date, avg(close_adj / prev_close_adj - 1) AS market_return FROM bars WHERE prev_close_adj > 0 GROUP BY date)", "bars")
cte(
    "reg",
    """r0 AS (SELECT date, market_return, CASE WHEN count(market_return) OVER a = 20 THEN exp(sum(ln(1 + market_return)) OVER a) - 1 END AS t, CASE WHEN count(market_return) OVER b = 10 THEN stddev_samp(market_return) OVER b * sqrt(252.0::DOUBLE) END AS v
  FROM mkt WINDOW a AS (ORDER BY date ROWS 19 PRECEDING), b AS (ORDER BY date ROWS 9 PRECEDING)),
r1 AS (SELECT *, quantile_cont(v, 0.5) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM r0),
reg AS (SELECT date, market_return, t AS trailing_market_return, v AS market_volatility, CASE WHEN t IS NULL THEN 'insufficient_history' WHEN t >= 0 THEN 'up' ELSE 'down' END AS market_trend,
  CASE WHEN v IS NULL OR h IS NULL THEN 'insufficient_history' WHEN v > h THEN 'high' ELSE 'low' END AS volatility_regime FROM r1)""",
    "mkt",
)
cte(
    "act",
    """act AS (SELECT symbol, CAST(date - 4 AS DATE) AS ex_date, CAST(date + 10 AS DATE) AS effective_date, round(close_raw * 0.01, 2) AS cash_per_share, CASE WHEN i % 52 = 0 THEN 0.1 ELSE 0.0 END::DOUBLE AS share_ratio
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM bars) WHERE i % 26 = 0)""",
    "bars",
)
cte(
    "pos",
    """z0 AS (SELECT portfolio_name, date, lead(date) OVER (PARTITION BY portfolio_name ORDER BY date) AS until FROM (SELECT DISTINCT portfolio_name, date FROM tgt)),
z1 AS (SELECT t.portfolio_name, t.symbol, t.target_weight, t.date AS since, c.date FROM tgt t JOIN z0 USING (portfolio_name, date) JOIN cal c ON c.date >= t.date AND (z0.until IS NULL OR c.date < z0.until)),
z2 AS (SELECT z1.*, p.date AS d, p.close_raw AS close_price FROM z1 ASOF JOIN bars p ON z1.symbol = p.symbol AND z1.date >= p.date),
z3 AS (SELECT z2.*, p.close_raw AS base FROM z2 ASOF JOIN bars p ON z2.symbol = p.symbol AND z2.since >= p.date),
z4 AS (SELECT *, target_weight * close_price / base AS market_value, CAST(date - d AS INT) AS stale_days FROM z3),
pos AS (SELECT portfolio_name, date, symbol, close_price, market_value, stale_days > 0 AS is_stale, stale_days, market_value / sum(market_value) OVER (PARTITION BY portfolio_name, date) AS asset_weight FROM z4)""",
    "tgt cal bars",
)


def spearman_sql(pairs: str, keys: str, minimum: int, name: str, reasons: tuple[str, str]) -> str:
    return f"""{name}a AS (SELECT *, rank() OVER (g ORDER BY x) + (count(*) OVER (PARTITION BY {keys}, x) - 1) / 2.0 AS rx, rank() OVER (g ORDER BY y) + (count(*) OVER (PARTITION BY {keys}, y) - 1) / 2.0 AS ry FROM {pairs} WINDOW g AS (PARTITION BY {keys})),
{name} AS (SELECT {keys}, count(*) AS n, CASE WHEN count(*) >= {minimum} AND min(x) < max(x) AND min(y) < max(y) THEN corr(rx, ry) END AS c, CASE WHEN count(*) < {minimum} THEN '{reasons[0]}' WHEN min(x) = max(x) OR min(y) = max(y) THEN '{reasons[1]}' END AS reason FROM {name}a GROUP BY {keys})"""


cte("ps", f"ps AS (SELECT date, symbol, factor_name, CASE WHEN {NEUTRAL} THEN score_size_neutral ELSE score END AS value FROM sco)", "sco")
cte(
    "red",
    "rp AS (SELECT a.date, a.factor_name AS factor_a, b.factor_name AS factor_b, a.value AS x, b.value AS y FROM ps a JOIN ps b ON a.date = b.date AND a.symbol = b.symbol AND a.factor_name <= b.factor_name WHERE a.value IS NOT NULL AND b.value IS NOT NULL),\n"
    + spearman_sql("rp", "date, factor_a, factor_b", 20, "rm", ("few", "flat"))
    + """,
rh AS (SELECT factor_a, factor_b, avg(c) AS mean_correlation, count(c) AS common_months FROM rm GROUP BY ALL),
red AS (SELECT * FROM rh UNION ALL SELECT factor_b, factor_a, mean_correlation, common_months FROM rh WHERE factor_a <> factor_b)""",
    "ps",
)
PLACE = "CASE {} " + " ".join(f"WHEN '{f.name}' THEN {i}" for i, f in enumerate(FACTORS)) + " END"
cte(
    "cls",
    f"""h0 AS (SELECT f.*, coalesce(g.good, 0) AS positive_subperiods FROM fs f LEFT JOIN (SELECT factor_name, score_variant, count(CASE WHEN mean_ic > 0 THEN 1 END) AS good FROM sp GROUP BY ALL) g USING (factor_name, score_variant)
  WHERE horizon = 20 AND score_variant = {PRIMARY}),
h1 AS (SELECT *, CASE WHEN nw_t IS NOT NULL THEN (0.254829592 * u - 0.284496736 * u * u + 1.421413741 * u * u * u - 1.453152027 * u * u * u * u + 1.061405429 * u * u * u * u * u) * exp(-z * z) END AS p
  FROM (SELECT *, abs(nw_t) / sqrt(2.0::DOUBLE) AS z, 1 / (1 + 0.3275911 * abs(nw_t) / sqrt(2.0::DOUBLE)) AS u FROM h0)),
h2 AS (SELECT *, least(1, p * count(p) OVER () / row_number() OVER (ORDER BY p NULLS LAST, factor_name)) AS raw, row_number() OVER (ORDER BY p NULLS LAST, factor_name) AS k FROM h1),
h3 AS (SELECT *, CASE WHEN p IS NOT NULL THEN min(raw) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING) END AS q FROM h2),
h4 AS (SELECT *, coalesce(coverage >= 0.8, false) AS coverage_pass, coalesce(valid_months >= 24, false) AS valid_months_pass, coalesce(mean_ic > 0, false) AS mean_ic_positive, coalesce(q <= 0.05, false) AS fdr_pass, coalesce(q5_q1 > 0, false) AS q5_q1_positive,
  positive_subperiods >= 2 AS subperiod_stability_pass, coalesce(point_in_time_status = 'ready', false) AS point_in_time_verified FROM h3),
h5 AS (SELECT *, concat_ws(';', CASE WHEN NOT coverage_pass THEN 'coverage_below_or_missing_threshold' END, CASE WHEN NOT valid_months_pass THEN 'insufficient_valid_months' END, CASE WHEN NOT mean_ic_positive THEN 'non_positive_or_missing_mean_ic' END) AS core,
  concat_ws(';', CASE WHEN NOT fdr_pass THEN 'fdr_threshold_not_met' END, CASE WHEN NOT q5_q1_positive THEN 'non_positive_or_missing_q5_q1' END, CASE WHEN NOT subperiod_stability_pass THEN 'subperiod_stability_not_met' END,
  CASE WHEN NOT point_in_time_verified THEN 'point_in_time_unverified' END) AS watch FROM h4),
cls AS (SELECT factor_name, family, score_variant AS primary_score_variant, positive_subperiods, coverage_pass, valid_months_pass, mean_ic_positive, fdr_pass, q5_q1_positive, subperiod_stability_pass, point_in_time_verified,
  CASE WHEN core <> '' THEN 'reject' WHEN watch <> '' THEN 'watch' ELSE 'candidate' END AS classification,
  CASE WHEN core <> '' THEN 'reject:' || core WHEN watch <> '' THEN 'watch:' || watch ELSE 'candidate:all_thresholds_passed' END AS reason FROM h5)""",
    "fs sp",
)
cte(
    "cor",
    """o0 AS (SELECT a.date, a.method AS left_name, b.method AS right_name, 'composite' AS right_type, a.score AS x, b.score AS y FROM comp a JOIN comp b ON a.date = b.date AND a.symbol = b.symbol AND a.method <= b.method
  UNION ALL SELECT a.date, a.method, s.factor_name, 'single_factor', a.score, s.score_size_neutral FROM comp a JOIN sco s ON a.date = s.date AND a.symbol = s.symbol WHERE s.score_size_neutral IS NOT NULL),
"""
    + spearman_sql("o0", "date, left_name, right_name, right_type", 3, "om", ("insufficient_common_securities", "constant_series"))
    + """,
cor AS (SELECT left_name, right_name, right_type, avg(c) AS mean_correlation, count(c) AS common_months, count(*) - count(c) AS invalid_months, mode(reason) AS primary_reason FROM om GROUP BY ALL)""",
    "comp sco",
)
cte(
    "stb",
    """v0 AS (SELECT method, date, lag(date) OVER (PARTITION BY method ORDER BY date) AS previous FROM (SELECT DISTINCT method, date FROM comp)),
v1 AS (SELECT c.*, v0.previous FROM comp c JOIN v0 USING (method, date)),
v2 AS (SELECT a.method, a.date, b.score AS x, a.score AS y FROM v1 a JOIN comp b ON b.method = a.method AND b.date = a.previous AND b.symbol = a.symbol),
"""
    + spearman_sql("v2", "method, date", 3, "v3", ("few", "flat"))
    + """,
v4 AS (SELECT *, row_number() OVER (g ORDER BY score DESC, symbol) AS i, greatest(1, floor(count(*) OVER g * 0.1)) AS k FROM v1 WINDOW g AS (PARTITION BY method, date)),
v5 AS (SELECT * FROM v4 WHERE i <= k),
v6 AS (SELECT a.method, a.date, 1 - count(b.symbol) / count(*) AS t FROM v5 a LEFT JOIN v5 b ON b.method = a.method AND b.date = a.previous AND b.symbol = a.symbol WHERE a.previous IS NOT NULL GROUP BY ALL),
stb AS (SELECT * FROM (SELECT method, avg(c) AS ranking_stability FROM v3 GROUP BY method) JOIN (SELECT method, avg(t) AS top10_turnover FROM v6 GROUP BY method) USING (method))""",
    "comp",
)
cte(
    "ord",
    """n0 AS (SELECT portfolio_name, date, lead(date) OVER (PARTITION BY portfolio_name ORDER BY date) AS nxt FROM (SELECT DISTINCT portfolio_name, date FROM tgt)),
n1 AS (SELECT portfolio_name, date, symbol, sum(w) AS w FROM (SELECT portfolio_name, date, symbol, target_weight AS w FROM tgt UNION ALL SELECT portfolio_name, nxt, symbol, 0.0 FROM tgt JOIN n0 USING (portfolio_name, date) WHERE nxt IS NOT NULL) GROUP BY ALL),
n2 AS (SELECT n1.*, cal.next_date, e.open_raw, e.adv, e.is_suspended, round(CAST(e.prev_close_raw AS DECIMAL(20,10)) * (1 - CAST(e.limit_rate AS DECIMAL(4,2))), 2)::DOUBLE AS low, round(CAST(e.prev_close_raw AS DECIMAL(20,10)) * (1 + CAST(e.limit_rate AS DECIMAL(4,2))), 2)::DOUBLE AS high
  FROM n1 JOIN cal USING (date) LEFT JOIN exe e ON e.symbol = n1.symbol AND e.date = cal.next_date WHERE cal.next_date IS NOT NULL),
n3 AS (SELECT *, CASE WHEN open_raw > 0 THEN CAST(floor(1e7 * w / open_raw / 100) * 100 AS BIGINT) END AS q FROM n2),
n4 AS (SELECT *, coalesce(last_value(q IGNORE NULLS) OVER (PARTITION BY portfolio_name, symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM n3),
n5 AS (SELECT *, q - held AS change, CASE WHEN q - held > 0 THEN 'buy' ELSE 'sell' END AS side FROM n4 WHERE q IS NULL OR q <> held),
n6 AS (SELECT *, CASE WHEN change IS NULL OR coalesce(is_suspended, true) THEN 'suspended_or_missing_open' WHEN NOT coalesce(adv > 0, false) THEN 'missing_lagged_adv'
  WHEN side = 'buy' AND open_raw >= high AND open_raw <= high + 0.01 THEN 'limit_up_buy' WHEN side = 'sell' AND open_raw <= low AND open_raw >= low - 0.01 THEN 'limit_down_sell' END AS reason, floor(adv * 0.5 / open_raw) AS room FROM n5),
ord AS (SELECT portfolio_name, date AS signal_date, next_date AS date, symbol, side, abs(change) AS quantity, CASE WHEN reason IS NULL THEN CAST(least(abs(change), CASE WHEN side = 'buy' THEN floor(room / 100) * 100 ELSE room END) AS BIGINT) ELSE 0 END AS fill_quantity, open_raw, adv, reason FROM n6)""",
    "tgt cal exe",
)
cte(
    "cost",
    """j0 AS (SELECT *, least(50.0, 10.0 * sqrt(fill_quantity * open_raw / adv / 0.01)) AS impact FROM ord WHERE fill_quantity > 0),
j1 AS (SELECT *, round(open_raw * (1 + CASE WHEN side = 'buy' THEN 1 ELSE -1 END * (5.0 + impact) / 10000), 2) AS price FROM j0),
j2 AS (SELECT *, fill_quantity * price AS amount, fill_quantity * open_raw / 10000 * 5.0 AS slippage_cost, fill_quantity * open_raw / 10000 * impact AS impact_cost FROM j1),
j3 AS (SELECT *, greatest(5.0, amount * 0.0003) AS commission, amount * CASE WHEN date <= DATE '1998-06-11' THEN 0.003 WHEN side = 'buy' THEN 0.0 ELSE 0.004 END AS stamp_duty,
  CASE WHEN symbol[1] IN ('5', '6', '9') THEN greatest(1.0, fill_quantity * 0.001) WHEN date <= DATE '1999-12-31' THEN 0.0 ELSE amount * 0.00002 END AS transfer_fee FROM j2),
cost AS (SELECT *, commission + stamp_duty + transfer_fee + slippage_cost + impact_cost AS total_cost FROM j3)""",
    "ord",
)

cte(
    "exl",
    """exl AS (SELECT s.date, s.symbol, CASE WHEN d5 <= DATE '2001-06-30' THEN o5 / o - 1 END AS x5, CASE WHEN d20 <= DATE '2001-06-30' THEN o20 / o - 1 END AS x20
  FROM (SELECT DISTINCT date, symbol FROM pan) s JOIN cal USING (date) LEFT JOIN (SELECT symbol, date AS next_date, open_adj AS o, lead(open_adj, 5) OVER w AS o5, lead(date, 5) OVER w AS d5, lead(open_adj, 20) OVER w AS o20, lead(date, 20) OVER w AS d20
  FROM v WHERE is_valid AND open_adj > 0 WINDOW w AS (PARTITION BY symbol ORDER BY date)) a ON a.symbol = s.symbol AND a.next_date = cal.next_date)""",
    "v cal pan",
)
cte(
    "obj",
    "obj AS (SELECT 'factor' AS object_type, factor_name AS object_name, date, symbol, value FROM ps UNION ALL SELECT 'composite', method, date, symbol, score FROM comp)",
    "ps comp",
)
cte(
    "per",
    "per AS (SELECT * FROM (VALUES ('1995-1997', DATE '1995-01-01', DATE '1997-12-31'), ('1998-1999', DATE '1998-01-01', DATE '1999-12-31'), ('2000-2001', DATE '2000-01-01', DATE '2001-12-31')) AS p(period, s, e))",
)
cte(
    "slc",
    """sl0 AS (SELECT date, equal_weight AS nav, cap_weight AS zero FROM bench WHERE date >= (SELECT max(date) FROM bench WHERE date <= DATE '1998-12-31')),
sl1 AS (SELECT *, nav / lag(nav) OVER w - 1 AS r, nav / max(nav) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS d FROM sl0 WINDOW w AS (ORDER BY date)),
sl2 AS (SELECT min(date) AS start_date, max(date) AS end_date, (DATE '2001-12-31' - DATE '1999-01-01') / 365.25 AS years, arg_max(nav, date) / arg_min(nav, date) AS g, arg_max(zero, date) / arg_min(zero, date) AS z, stddev_samp(r) AS s, min(d) AS maximum_drawdown, avg(nav) AS m FROM sl1),
slc AS (SELECT start_date, end_date, years, pow(g, 1 / years) - 1 AS annual_return, pow(z, 1 / years) - 1 AS zero_cost_annual_return, pow(z, 1 / years) - pow(g, 1 / years) AS cost_erosion, s * sqrt(252.0::DOUBLE) AS annual_volatility, maximum_drawdown,
  (SELECT sum(amount) FROM cost WHERE portfolio_name = 'top20_equal' AND date > start_date) / (m * 2 * years) AS turnover FROM sl2)""",
    "bench cost",
)
cte(
    "ver",
    """ve0 AS (SELECT CASE WHEN portfolio_name = 'top20_equal' THEN 'portfolio_baseline' ELSE portfolio_name END AS experiment_id, avg(one_way_turnover) AS turnover, avg(hhi) AS hhi FROM dia GROUP BY portfolio_name),
ve1 AS (SELECT experiment_id, 'ready' AS status, metric, value FROM (SELECT * FROM ve0 UNPIVOT (value FOR metric IN (turnover, hhi)))),
ve2 AS (SELECT g.experiment_id, category, coalesce(status, 'not_run') AS status, metric, value FROM (VALUES ('portfolio_baseline', 'portfolio'), ('top10_equal', 'portfolio'), ('execution_full_cost', 'execution'), ('never_run', 'factor_ablation')) AS g(experiment_id, category) LEFT JOIN ve1 USING (experiment_id)),
ve3 AS (SELECT ve2.*, CASE WHEN category = 'execution' THEN 'execution_full_cost' ELSE 'portfolio_baseline' END AS baseline_experiment_id FROM ve2),
ver AS (SELECT ve3.*, b.value AS baseline_value, ve3.value - b.value AS baseline_delta, CASE WHEN ve3.status <> 'ready' THEN 'failed' WHEN ve3.metric = 'turnover' AND b.value IS NOT NULL THEN CASE WHEN abs(ve3.value - b.value) <= 0.05 THEN 'stable' ELSE 'sensitive' END ELSE 'reported' END AS interpretation
  FROM ve3 LEFT JOIN ve1 b ON b.experiment_id = baseline_experiment_id AND b.metric = ve3.metric)""",
    "dia",
)
cte(
    "fmx",
    """fm0 AS (SELECT s.date, max(CASE WHEN factor_name = 'reversal_20' THEN score END) AS a, max(CASE WHEN factor_name = 'turnover_20' THEN score END) AS b, max(CASE WHEN factor_name = 'volatility_60' THEN score END) AS c, any_value(l.forward_return_20) AS y
  FROM sco s JOIN lab l USING (date, symbol) WHERE factor_name IN ('reversal_20', 'turnover_20', 'volatility_60') GROUP BY s.date, s.symbol),
fm1 AS (SELECT date, count(*) AS n, stddev_samp(a) AS sa, stddev_samp(b) AS sb, stddev_samp(c) AS sc, covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, b) AS bb, covar_pop(b, c) AS bc, covar_pop(c, c) AS cc, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, covar_pop(c, y) AS cy, covar_pop(y, y) AS yy
  FROM fm0 WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND y IS NOT NULL GROUP BY date HAVING count(*) >= 20 AND max(a) > min(a) AND max(b) > min(b) AND max(c) > min(c)),
fm2 AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM fm1),
fm3 AS (SELECT *, (ay * (bb * cc - bc * bc) - ab * (by_ * cc - bc * cy) + ac * (by_ * bc - bb * cy)) / det AS ka, (aa * (by_ * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - by_ * ac)) / det AS kb, (aa * (bb * cy - by_ * bc) - ab * (ab * cy - by_ * ac) + ay * (ab * bc - bb * ac)) / det AS kc FROM fm2),
fmx AS (SELECT date, u.factor_name, u.k AS coefficient, n AS n_obs, (ka * ay + kb * by_ + kc * cy) / yy AS r_squared FROM fm3, LATERAL (VALUES ('reversal_20', ka * sa), ('turnover_20', kb * sb), ('volatility_60', kc * sc)) AS u(factor_name, k))""",
    "sco lab",
)
cte(
    "idx",
    """ix0 AS (SELECT date, row_number() OVER w AS i, equal_weight, cap_weight, lag(equal_weight) OVER w AS eb, lag(cap_weight) OVER w AS cb FROM bench WINDOW w AS (ORDER BY date)),
idx AS (SELECT 'equal' AS "index", date, equal_weight AS close, eb AS preclose FROM ix0 WHERE i > 2 UNION ALL SELECT 'cap', date, cap_weight, cb FROM ix0 WHERE i > 2)""",
    "bench",
)
cte(
    "lst",
    "lst AS (SELECT * REPLACE (lpad(CAST(CAST(symbol AS BIGINT) * 10007 % 1000000 AS VARCHAR), 6, '0') AS symbol) FROM bars)",
    "bars",
)
#: Months in order: members of the month before stay while they rank within the buffer, the best of a size group fill up.
BUFFERED = """
a1 AS (SELECT *, CAST((row_number() OVER (g ORDER BY z, symbol) - 1) * 5 // count(*) OVER g + 1 AS INT) AS size_group FROM a0 WINDOW g AS (PARTITION BY k, date)),
a2 AS (SELECT *, row_number() OVER (PARTITION BY k, date, size_group ORDER BY score DESC, symbol) AS group_rank, dense_rank() OVER (PARTITION BY k ORDER BY date) AS m FROM a1),
a3 AS MATERIALIZED (SELECT * FROM a2 WHERE group_rank <= greatest(buffer, 2 * per_group)),
rec AS (SELECT k, date, m, symbol, size_group, group_rank FROM a3 WHERE m = 1 AND group_rank <= per_group
  UNION ALL SELECT k, date, m, symbol, size_group, group_rank FROM (SELECT n.*, row_number() OVER (PARTITION BY n.k, n.size_group ORDER BY CASE WHEN p.symbol IS NOT NULL AND n.group_rank <= n.buffer THEN 0 ELSE 1 END, n.group_rank) AS place
    FROM a3 n JOIN (SELECT DISTINCT k, m FROM rec) o ON o.k = n.k AND n.m = o.m + 1 LEFT JOIN rec p ON p.k = n.k AND p.symbol = n.symbol) WHERE place <= per_group)
SELECT 'size_stratified_buffered' AS portfolio_name, k AS {k}, date, symbol, size_group, CAST(group_rank AS INT) AS group_rank, round(1.0::DOUBLE / count(*) OVER (PARTITION BY k, date), 6) AS target_weight FROM rec"""
HERE = "symbol NOT LIKE '92%' AND symbol[1] IN ('0', '1', '2', '3', '5', '6', '9')"
BAD = (
    "(open_raw <= 0 OR high_raw <= 0 OR low_raw <= 0 OR close_raw <= 0 OR high_raw < greatest(open_raw, close_raw) OR low_raw > least(open_raw, close_raw) "
    "OR close_adj <= 0 OR high_adj < greatest(open_adj, close_adj) OR low_adj > least(open_adj, close_adj))"
)

ORACLE_SQL: dict[str, str] = {
    "mvp_rank_ic": with_(
        "msig sig",
        """, a0 AS (SELECT * FROM msig SEMI JOIN sig USING (date)), a1 AS (SELECT date, momentum_z AS x, forward_return AS y FROM a0 WHERE momentum_z IS NOT NULL AND forward_return IS NOT NULL),
"""
        + spearman_sql("a1", "date", 20, "a2", ("insufficient_stocks", "constant_factor"))
        + " SELECT k.date, coalesce(n, 0) AS n_obs, round(c, 6) AS rank_ic, CASE WHEN n IS NULL THEN 'insufficient_stocks' ELSE reason END AS reason FROM (SELECT DISTINCT date FROM a0) k LEFT JOIN a2 USING (date)",
    ),
    "mvp_universe": with_("muni", "SELECT " + r("date symbol history_observations amount_mean* liquidity_rank is_eligible") + " FROM muni"),
    "mvp_signal": with_("msig", "SELECT " + r("date symbol momentum* forward_return* momentum_z*") + " FROM msig"),
    "research_universe": with_("uni", "SELECT " + r("date symbol is_valid history_observations amount_mean* liquidity_rank is_eligible") + " FROM uni"),
    "forward_labels": with_("lab", "SELECT " + r("date symbol " + " ".join(f"forward_return_{h}* forward_calendar_days_{h} forward_skipped_observations_{h}" for h in H), 9) + " FROM lab"),
    "month_end_panel": with_("bars sig", "SELECT " + r("date symbol close_adj*", 6, True) + " FROM bars SEMI JOIN sig USING (date)"),
    "factor_panel": with_("pan", "SELECT " + r("date symbol factor_name family raw_value*", 9) + " FROM pan"),
    "preprocess_scores": with_(
        "sco",
        "SELECT " + r("date symbol factor_name score* score_size_neutral* point_in_time_status preprocessing_reason") + ", round(winsorized_value * CASE WHEN factor_name = 'amihud_20' THEN 1e9::DOUBLE ELSE 1 END, 6) AS winsorized_value FROM sco",
    ),
    "preprocess_scores_amihud": with_(
        "sco",
        "SELECT "
        + r("date symbol factor_name score* score_size_neutral* point_in_time_status preprocessing_reason")
        + ", round(winsorized_value * 1e9::DOUBLE, 6) AS winsorized_value_e9 FROM sco WHERE factor_name = 'amihud_20'",
    ),
    "winsorized_scores": with_("sco", "SELECT date, symbol, factor_name, round(score, 6) AS score, reason AS preprocessing_reason FROM p4"),
    "signal_liquidity": with_("liq", "SELECT " + r("date symbol amount_mean*") + " FROM liq"),
    "liquidity_proxy_rows": with_("pan", "SELECT date, symbol, round(-raw_value, 12) AS liquidity FROM pan WHERE factor_name = 'amihud_20'"),
    "executable_labels": with_(
        "v cal pan",
        """, a0 AS (SELECT symbol, date AS next_date, open_adj AS o, lead(open_adj, 5) OVER w AS o5, lead(date, 5) OVER w AS d5, lead(open_adj, 20) OVER w AS o20, lead(date, 20) OVER w AS d20 FROM v WHERE is_valid AND open_adj > 0 WINDOW w AS (PARTITION BY symbol ORDER BY date))
SELECT s.date, s.symbol, round(CASE WHEN d5 <= DATE '2001-06-30' THEN o5 / o - 1 END, 9) AS executable_return_5, round(CASE WHEN d20 <= DATE '2001-06-30' THEN o20 / o - 1 END, 9) AS executable_return_20
FROM (SELECT DISTINCT date, symbol FROM pan) s JOIN cal USING (date) LEFT JOIN a0 ON a0.symbol = s.symbol AND a0.next_date = cal.next_date""",
    ),
    "rank_ic": with_("ic", "SELECT " + r("date factor_name family score_variant horizon n_obs rank_ic* reason") + " FROM ic"),
    "quantile_returns": with_("qr", "SELECT " + r("date factor_name family score_variant quantile n_obs mean_return*") + " FROM qr"),
    "quantile_spread": with_("qs", "SELECT " + r("factor_name family score_variant spread* monotonicity*") + " FROM qs"),
    "factor_turnover": with_("to_", "SELECT " + r("date factor_name family score_variant previous_date top_count previous_top_count turnover*") + " FROM to_"),
    "subperiod_ic": with_("sp", 'SELECT factor_name, family, score_variant, subperiod, "start", "end", valid_months, round(mean_ic, 6) AS mean_ic FROM sp'),
    "newey_west_ic": with_("nw", "SELECT " + r("factor_name score_variant horizon n mean* std* lag t*") + " FROM nw"),
    "benjamini_hochberg_q": with_(
        "ic",
        """, a0 AS (SELECT factor_name, score_variant, 1 - abs(avg(rank_ic)) AS p FROM ic WHERE horizon = 20 GROUP BY ALL),
a1 AS (SELECT *, row_number() OVER (PARTITION BY score_variant ORDER BY p, factor_name) AS k, count(p) OVER (PARTITION BY score_variant) AS m FROM a0 WHERE p IS NOT NULL)
SELECT factor_name, score_variant, round(p, 6) AS p, round(q, 6) AS q FROM (SELECT *, min(least(1, p * m / k)) OVER (PARTITION BY score_variant ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS q FROM a1)
UNION ALL SELECT factor_name, score_variant, NULL, NULL FROM a0 WHERE p IS NULL""",
    ),
    "factor_summary": with_(
        "fs",
        "SELECT " + r("factor_name family score_variant horizon coverage* valid_months mean_ic* ic_std* icir* positive_ic_rate* nw_lag nw_t* q5_q1* monotonicity* avg_turnover* point_in_time_status summary_reason") + " FROM fs",
    ),
    "classification": with_("cls", "SELECT * FROM cls"),
    "redundancy": with_("red", "SELECT " + r("factor_a factor_b mean_correlation* common_months") + " FROM red"),
    "redundancy_flags": with_(
        "red",
        f"SELECT factor_a, factor_b, round(mean_correlation, 6) AS mean_correlation, round(abs(mean_correlation), 6) AS absolute_correlation, CASE WHEN mean_correlation >= 0 THEN 'positive' ELSE 'negative' END AS correlation_direction, common_months FROM red "
        f"WHERE {PLACE.format('factor_a')} < {PLACE.format('factor_b')} AND abs(mean_correlation) >= 0.5",
    ),
    "composite_static": with_("stat", "SELECT " + r("date symbol method score* raw_score* family_count factor_count") + " FROM stat"),
    "rolling_ic_weights": with_("wts", "SELECT " + r("date family factor_name factor_weight* history_start history_end history_months fallback_equal") + " FROM wts"),
    "composite_rolling": with_("roll", "SELECT " + r("date symbol method score* raw_score* family_count factor_count") + " FROM roll"),
    "ablation_scores": with_(
        "sco wts",
        """, a0 AS (SELECT s.date, s.symbol, 'rolling_ic_family' AS method, sum(s.score_size_neutral * w.factor_weight) / sum(w.factor_weight) AS raw_score, count(DISTINCT s.family) AS family_count, count(*) AS factor_count
  FROM sco s JOIN wts w ON w.date = s.date AND w.factor_name = s.factor_name WHERE s.family IN ('reversal', 'low_volatility') AND s.score_size_neutral IS NOT NULL GROUP BY s.date, s.symbol HAVING count(DISTINCT s.family) >= 2)
SELECT date, symbol, method, round(CASE WHEN stddev_pop(raw_score) OVER g > 0 THEN (raw_score - avg(raw_score) OVER g) / stddev_pop(raw_score) OVER g ELSE 0 END, 6) AS score, round(raw_score, 6) AS raw_score, family_count, factor_count FROM a0 WINDOW g AS (PARTITION BY date, method)""",
    ),
    "static_weights": with_(
        "sco",
        f""", a0 AS (SELECT DISTINCT date FROM sco), a1 AS (SELECT DISTINCT factor_name, family FROM sco WHERE factor_name IN {CANDIDATES})
SELECT date, m.method, factor_name, family, round(CASE WHEN m.method = 'representative_equal' THEN 1 / 3.0::DOUBLE ELSE 1 / 6.0::DOUBLE END, 6) AS weight FROM a0, a1, (VALUES ('candidate_equal'), ('family_equal'), ('representative_equal')) AS m(method)
WHERE m.method <> 'representative_equal' OR factor_name IN ('reversal_20', 'turnover_20', 'volatility_60')""",
    ),
    "composite_rank_ic": with_("cic", "SELECT " + r("date method horizon n_obs rank_ic* reason") + " FROM cic"),
    "composite_quantile_returns": with_("cqr", "SELECT " + r("date method quantile n_obs mean_return*") + " FROM cqr"),
    "composite_summary": with_(
        "cnw cqs",
        "SELECT c.method, horizon, round(mean, 6) AS mean_ic, round(CASE WHEN std > 0 THEN mean / std * sqrt(12.0::DOUBLE) END, 6) AS icir, round(t, 6) AS nw_t, n AS valid_months, round(spread, 6) AS spread, round(monotonicity, 6) AS monotonicity FROM cnw c LEFT JOIN cqs q ON q.method = c.method",
    ),
    "composite_correlations": with_("cor", "SELECT " + r("left_name right_name right_type mean_correlation* common_months invalid_months primary_reason") + " FROM cor"),
    "composite_stability": with_("stb", "SELECT " + r("method ranking_stability* top10_turnover*") + " FROM stb"),
    "composite_rolling_ic": with_(
        "cic",
        "SELECT date, method, horizon, round(CASE WHEN count(rank_ic) OVER w = 12 THEN avg(rank_ic) OVER w END, 6) AS rolling_ic FROM cic WINDOW w AS (PARTITION BY method, horizon ORDER BY date ROWS 11 PRECEDING)",
    ),
    "quintile_excess": with_(
        "cqr",
        "SELECT method, quantile, round(avg(e), 6) AS mean_excess, count(*) AS months FROM (SELECT *, mean_return - sum(mean_return * n_obs) OVER g / sum(n_obs) OVER g AS e FROM cqr WINDOW g AS (PARTITION BY date, method)) GROUP BY ALL",
    ),
    "leg_decomposition": with_(
        "cqr",
        """, a0 AS (SELECT date, method, sum(mean_return * n_obs) / sum(n_obs) AS u, max(CASE WHEN quantile = 5 THEN mean_return END) AS top, max(CASE WHEN quantile = 1 THEN mean_return END) AS low FROM cqr GROUP BY ALL),
a1 AS (SELECT *, top - u - avg(top - u) OVER g AS el, u - low - avg(u - low) OVER g AS es FROM a0 WHERE top IS NOT NULL AND low IS NOT NULL WINDOW g AS (PARTITION BY method)),
a2 AS (SELECT method, count(*) AS months, avg(top - u) AS l, avg(u - low) AS s, sum(el * el) / count(*) AS vl, sum(es * es) / count(*) AS vs FROM a1 GROUP BY method)
SELECT method, months, round(l, 6) AS long_leg, round(l / sqrt(vl / months), 6) AS long_leg_t, round(s, 6) AS short_leg, round(s / sqrt(vs / months), 6) AS short_leg_t, round(l + s, 6) AS spread, round(CASE WHEN l + s > 0 THEN l / (l + s) END, 6) AS long_share FROM a2""",
    ),
    "top_n_portfolio": with_("tgt", "SELECT " + r("portfolio_name date symbol target_weight*") + " FROM tgt"),
    "portfolio_diagnostics": with_("dia", "SELECT " + r("portfolio_name date holdings max_weight* hhi* one_way_turnover* effective_holdings*") + " FROM dia"),
    "portfolio_overlap": with_(
        "tgt",
        """, a AS (SELECT date, symbol FROM tgt WHERE portfolio_name = 'top10_equal'), b AS (SELECT date, symbol FROM tgt WHERE portfolio_name = 'top20_equal')
SELECT date, round(k / greatest(least(n, m), 1), 6) AS holding_overlap FROM (SELECT date, count(*) AS n FROM a GROUP BY date) JOIN (SELECT date, count(*) AS m FROM b GROUP BY date) USING (date) JOIN (SELECT date, count(*) AS k FROM a JOIN b USING (date, symbol) GROUP BY date) USING (date)""",
    ),
    "portfolio_warnings": with_(
        "dia stat",
        """, a0 AS (SELECT d.*, c.coverage FROM dia d LEFT JOIN (SELECT date, count(*) / 50 AS coverage FROM stat WHERE method = 'family_equal' GROUP BY date) c USING (date))
SELECT date, portfolio_name, 'warning' AS severity, 'insufficient_holdings' AS rule, CAST(holdings AS VARCHAR) AS details FROM a0 WHERE holdings < 20
UNION ALL SELECT date, portfolio_name, 'warning', 'coverage_decline', printf('%.6f', coverage) FROM a0 WHERE coverage < 0.9
UNION ALL SELECT date, portfolio_name, 'warning', 'high_target_turnover', printf('%.6f', one_way_turnover) FROM a0 WHERE one_way_turnover > 0.5""",
    ),
    "portfolio_exposures": with_(
        "tgt sco liq",
        f""", a0 AS (SELECT t.*, s.factor_name, s.family, CASE WHEN s.factor_name = 'log_market_cap' THEN raw_value ELSE score_size_neutral END AS x FROM tgt t JOIN sco s USING (date, symbol) WHERE s.factor_name IN {CANDIDATES} OR s.factor_name = 'log_market_cap')
SELECT date, portfolio_name, family, factor_name, round(coalesce(sum(target_weight * x), 0), 9) AS exposure, 'factor' AS exposure_type FROM a0 GROUP BY ALL
UNION ALL SELECT date, portfolio_name, family, family, round(coalesce(sum(target_weight * x), 0) / count(DISTINCT factor_name), 9), 'family' FROM a0 WHERE factor_name <> 'log_market_cap' GROUP BY date, portfolio_name, family
UNION ALL SELECT date, portfolio_name, 'capacity', 'amount_mean', round(CASE WHEN count(*) = count(amount_mean) THEN max(target_weight / amount_mean) END, 9), 'capacity' FROM tgt LEFT JOIN liq USING (date, symbol) GROUP BY date, portfolio_name""",
    ),
    "size_groups": with_(
        "stat sco",
        """, a0 AS (SELECT s.date, s.symbol, s.score, b.raw_value AS z FROM stat s JOIN sco b ON b.date = s.date AND b.symbol = s.symbol AND b.factor_name = 'log_market_cap' WHERE s.method = 'family_equal' AND b.raw_value IS NOT NULL),
a1 AS (SELECT *, CAST((row_number() OVER (g ORDER BY z, symbol) - 1) * 5 // count(*) OVER g + 1 AS INT) AS size_group FROM a0 WINDOW g AS (PARTITION BY date))
SELECT date, symbol, size_group, CAST(row_number() OVER (PARTITION BY date, size_group ORDER BY score DESC, symbol) AS INT) AS group_rank FROM a1""",
    ),
    "rebalance_schedule": with_(
        "stat",
        "SELECT s.date, symbol, round(score, 6) AS score FROM stat s JOIN (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM stat WHERE method = 'family_equal')) d USING (date) WHERE method = 'family_equal' AND (i - 1) % 3 = 0",
    ),
    "liquid_universe": with_(
        "stat pan",
        "SELECT date, symbol, round(score, 6) AS score FROM (SELECT s.*, row_number() OVER (PARTITION BY s.date ORDER BY -p.raw_value DESC NULLS LAST, s.symbol) AS i FROM stat s LEFT JOIN (SELECT * FROM pan WHERE factor_name = 'amihud_20') p ON p.date = s.date AND p.symbol = s.symbol WHERE method = 'family_equal') WHERE i <= 15",
    ),
    "execution_panel": with_("exe", "SELECT " + r("date symbol adv* limit_rate* is_suspended") + " FROM exe"),
    "rebalance_orders": with_("ord", "SELECT " + r("portfolio_name signal_date date symbol side quantity fill_quantity open_raw* adv* reason", 6, True) + " FROM ord"),
    "trade_costs": with_("cost", "SELECT " + r("portfolio_name date symbol side fill_quantity amount* commission* stamp_duty* transfer_fee* slippage_cost* impact_cost* total_cost*", 6, True) + " FROM cost"),
    "fee_coverage": "SELECT CAST(day AS DATE) AS day, 'sz' AS market, CAST(0 AS BIGINT) AS rules FROM generate_series(DATE '2000-01-01', DATE '2000-02-29', INTERVAL 1 DAY) AS t(day)",
    "blocked_orders": with_("ord", "SELECT portfolio_name, side, reason, count(*) AS orders FROM ord WHERE reason IS NOT NULL GROUP BY ALL"),
    "fill_statistics": with_(
        "ord",
        """SELECT portfolio_name, side, count(*) AS order_count, count(*) FILTER (fill_quantity = quantity AND fill_quantity > 0) AS filled, count(*) FILTER (fill_quantity > 0 AND fill_quantity < quantity) AS partially_filled,
  count(*) FILTER (coalesce(fill_quantity, 0) = 0) AS expired, count(*) FILTER (fill_quantity > 0) AS trade_count, round(count(*) FILTER (fill_quantity = quantity AND fill_quantity > 0) / count(*), 6) AS filled_order_rate,
  round(count(*) FILTER (fill_quantity > 0 AND fill_quantity < quantity) / count(*), 6) AS partially_filled_order_rate, round(1 - sum(CASE WHEN quantity IS NOT NULL THEN coalesce(fill_quantity, 0) END) / sum(quantity), 6) AS unfilled_rate
FROM ord GROUP BY ALL""",
    ),
    "universe_benchmark": with_("bench", "SELECT date, round(ln(equal_weight), 6) AS log_equal_weight, round(ln(cap_weight), 6) AS log_cap_weight, member_count FROM bench"),
    "relative_performance": with_(
        "bench",
        """, a0 AS (SELECT date, equal_weight / lag(equal_weight) OVER w - 1 AS s, cap_weight / lag(cap_weight) OVER w - 1 AS b FROM bench WINDOW w AS (ORDER BY date)), a1 AS (SELECT arg_max(equal_weight, date) / arg_min(equal_weight, date) AS gs, arg_max(cap_weight, date) / arg_min(cap_weight, date) AS gb FROM bench),
a2 AS (SELECT stddev_samp(s - b) * sqrt(252.0::DOUBLE) AS te, avg(s - b) AS ma, covar_samp(s, b) / var_samp(b) AS beta, corr(s, b) AS c FROM a0 WHERE s IS NOT NULL)
SELECT 'equal_over_cap' AS pair, round(pow(gs, 1 / 6.75) - 1, 6) AS strategy_annual_return, round(pow(gb, 1 / 6.75) - 1, 6) AS benchmark_annual_return, round(pow(gs / gb, 1 / 6.75) - 1, 6) AS annual_relative_return, round(te, 6) AS tracking_error, round(ma * 252 / te, 6) AS information_ratio, round(beta, 6) AS beta, round(c, 6) AS correlation FROM a1, a2""",
    ),
    "benchmark_drawdown": with_("bench", "SELECT date, round(equal_weight / max(equal_weight) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1, 6) AS drawdown FROM bench"),
    "calendar_year_returns": with_(
        "bench", "SELECT 'equal' AS path, CAST(y AS INT) AS year, round(v / lag(v, 1, 1.0) OVER (ORDER BY y) - 1, 6) AS annual_return FROM (SELECT year(date) AS y, arg_max(equal_weight, date) AS v FROM bench GROUP BY 1)"
    ),
    "market_return": with_("mkt", "SELECT " + r("date market_return*") + " FROM mkt"),
    "market_regimes": with_("reg", "SELECT " + r("date market_return* market_volatility* market_trend volatility_regime") + ", round(ln(1 + trailing_market_return), 6) AS log_trailing_growth FROM reg"),
    "regime_summary": with_(
        "reg mkt",
        """, a0 AS (SELECT date, market_return AS x, 'trend' AS segment_type, market_trend AS segment FROM reg UNION ALL SELECT date, market_return, 'time_period', CASE WHEN date <= DATE '1998-12-31' THEN 'early' ELSE 'late' END FROM mkt),
a1 AS (SELECT segment_type, segment, count(x) AS n, min(date) AS a, max(date) AS z, avg(x) AS m, stddev_samp(x) AS s FROM a0 GROUP BY ALL)
SELECT segment_type, segment, n AS observations, a AS start_date, z AS end_date, round(m, 6) AS mean_period_return, round(m * 52, 6) AS annualized_return, round(s * sqrt(52.0::DOUBLE), 6) AS annualized_volatility, round(s / sqrt(n), 6) AS standard_error, round(m - 1.96 * s / sqrt(n), 6) AS ci95_low, round(m + 1.96 * s / sqrt(n), 6) AS ci95_high FROM a1""",
    ),
    "size_segments": with_(
        "pan lab",
        """, a0 AS (SELECT p.date, p.raw_value, l.forward_return_20 AS f, quantile_cont(p.raw_value, 0.5) OVER (PARTITION BY p.date) AS med FROM pan p LEFT JOIN lab l USING (date, symbol) WHERE factor_name = 'log_market_cap')
SELECT date, CASE WHEN raw_value <= med THEN 'small' ELSE 'large' END AS segment, round(avg(f), 6) AS "return", 'market_size' AS segment_type FROM a0 GROUP BY ALL""",
    ),
    "fama_macbeth_univariate": with_(
        "sco lab",
        """, a0 AS (SELECT s.date, s.score AS x, l.forward_return_20 AS y FROM sco s JOIN lab l USING (date, symbol) WHERE factor_name = 'reversal_20' AND s.score IS NOT NULL AND l.forward_return_20 IS NOT NULL)
SELECT date, 'reversal_20' AS factor_name, round(covar_pop(x, y) / var_pop(x) * stddev_samp(x), 6) AS coefficient, count(*) AS n_obs, round(pow(corr(x, y), 2), 6) AS r_squared FROM a0 GROUP BY date HAVING count(*) >= 20 AND max(x) > min(x)""",
    ),
    "panel_issues": with_(
        "bars",
        """, a0 AS (SELECT count(*) FILTER (open_raw <= 0 OR high_raw <= 0 OR low_raw <= 0 OR close_raw <= 0 OR high_raw < greatest(open_raw, close_raw) OR low_raw > least(open_raw, close_raw) OR close_adj <= 0 OR high_adj < greatest(open_adj, close_adj) OR low_adj > least(open_adj, close_adj)) AS a,
  count(*) FILTER (prev_close_raw IS NULL OR prev_close_adj IS NULL) AS b, count(*) FILTER (pe_ttm IS NULL OR pb IS NULL OR ps_ttm IS NULL) AS c FROM bars)
SELECT * FROM (SELECT 'error' AS severity, 'invalid_ohlc' AS code, a AS count FROM a0 UNION ALL SELECT 'warning', 'missing_prev_close', b FROM a0 UNION ALL SELECT 'warning', 'missing_valuation', c FROM a0) WHERE count > 0""",
    ),
    "field_audit": with_(
        "bars",
        " UNION ALL ".join(
            f"SELECT '{c}' AS field, round(count({c}) / count(*), 6) AS non_null_rate, round(count(CASE WHEN isfinite({c}) THEN 1 END) / count(*), 6) AS finite_rate, round(count(CASE WHEN {c} > 0 THEN 1 END) / count(*), 6) AS positive_rate, "
            f"min(CASE WHEN {c} IS NOT NULL THEN date END) AS earliest_date, max(CASE WHEN {c} IS NOT NULL THEN date END) AS latest_date, 'ready' AS status FROM bars"
            for c in ("pe_ttm", "pb", "ps_ttm", "close_adj", "turnover")
        )
        + " UNION ALL SELECT 'industry', 0.0, 0.0, 0.0, NULL, NULL, 'missing'",
    ),
    "contract_violations": with_(
        "bars",
        " UNION ALL ".join(
            f"SELECT '{n}' AS rule, count(*) FILTER ({t}) AS violations FROM bars"
            for n, t in (
                ("null_key", "date IS NULL OR symbol IS NULL"), ("null_date", "date IS NULL"), ("date_too_early", "date < DATE '1995-06-01'"), ("date_too_late", "date > DATE '2001-06-30'"),
                ("close_adj_not_finite", "NOT isfinite(close_adj)"), ("pe_ttm_not_finite", "NOT isfinite(pe_ttm)"), ("volume_negative", "volume < 0"), ("amount_negative", "amount < 0"), ("duplicate_key", "false"),
            )
        ),
    ),
    "frame_statistics": with_("bars", "SELECT count(*) AS rows, min(date) AS minimum_date, max(date) AS maximum_date FROM bars"),
    "market_classes": with_(
        "bars",
        """, a0 AS (SELECT DISTINCT symbol, lpad(CAST(CAST(symbol AS BIGINT) * 10007 % 1000000 AS VARCHAR), 6, '0') AS code FROM bars)
SELECT symbol, code, CASE WHEN code LIKE '92%' OR code[1] IN ('4', '8') THEN 'bj' WHEN code[1] IN ('5', '6', '9') THEN 'sh' WHEN code[1] IN ('0', '1', '2', '3') THEN 'sz' END AS market FROM a0""",
    ),
    "weight_sums": with_("tgt", "SELECT portfolio_name, date, round(sum(target_weight), 6) AS total FROM tgt WHERE symbol <> '000001' GROUP BY ALL HAVING abs(sum(target_weight) - 1) > 1e-9"),
    "equal_buckets": with_(
        "bars", "SELECT date, bucket, count(*) AS n FROM (SELECT date, CAST((row_number() OVER (g ORDER BY amount, symbol) - 1) * 7 // count(*) OVER g + 1 AS INT) AS bucket FROM bars WINDOW g AS (PARTITION BY date)) GROUP BY ALL"
    ),
    "corporate_actions": with_(
        "act",
        "SELECT 'made_up' AS source, count(*) AS actions, round(sum(cash_per_share), 6) AS cash, count(*) FILTER (share_ratio > 0) AS share_actions FROM act WHERE ex_date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31' "
        "UNION ALL SELECT 'second', count(*), round(sum(cash_per_share), 6), count(*) FROM act WHERE share_ratio > 0 AND ex_date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'",
    ),
    "first_quote_after_action": with_("act bars", "SELECT a.symbol, a.ex_date, min(b.date) AS date FROM act a JOIN bars b ON b.symbol = a.symbol AND b.date >= a.ex_date GROUP BY ALL"),
    "marked_positions": with_("pos", "SELECT " + r("portfolio_name date symbol close_price* market_value* is_stale stale_days asset_weight*", 6, True) + " FROM pos"),
    "shadow_audit": with_(
        "act bars pos cal",
        """, a0 AS (SELECT a.symbol, a.ex_date, a.cash_per_share, a.share_ratio, min(b.date) AS date FROM act a JOIN bars b ON b.symbol = a.symbol AND b.date >= a.ex_date GROUP BY ALL),
a1 AS (SELECT symbol, date, sum(cash_per_share) AS cash, product(1 + share_ratio) AS shares FROM a0 GROUP BY ALL),
a2 AS (SELECT date, symbol, close_raw, close_adj, lag(close_raw) OVER w AS lr, lag(close_adj) OVER w AS la FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
a3 AS (SELECT a2.date, a2.symbol, close_adj / la - (close_raw * coalesce(shares, 1) + coalesce(cash, 0)) / lr AS d FROM a2 LEFT JOIN a1 USING (date, symbol) WHERE lr IS NOT NULL),
a4 AS (SELECT cal.next_date AS date, symbol, market_value AS v FROM pos JOIN cal USING (date) WHERE portfolio_name = 'top20_equal')
SELECT date, round(sum(d * v) / sum(v), 6) AS portfolio_return_difference, round(sum(abs(d) * v) / sum(v), 6) AS portfolio_absolute_difference, round(sum(v), 6) AS holdings_value, count(*) AS held_observations FROM a3 JOIN a4 USING (date, symbol) GROUP BY date""",
    ),
    "stale_positions": with_(
        "pos bars act",
        """, a0 AS (SELECT symbol, min(date) AS first_stale_date, max(date) AS last_stale_date, max(stale_days) AS maximum_stale_days, max(asset_weight) AS w FROM pos WHERE is_stale AND stale_days > 10 GROUP BY symbol)
SELECT a0.symbol, first_stale_date, last_stale_date, maximum_stale_days, round(w, 6) AS maximum_asset_weight, CASE WHEN l.last > last_stale_date THEN 'explained_resumption' WHEN e.symbol IS NOT NULL THEN 'explained_security_event' WHEN a0.symbol > '000080' THEN 'explained_public_evidence' ELSE 'unexplained' END AS classification
FROM a0 LEFT JOIN (SELECT symbol, max(date) AS last FROM bars WHERE date < DATE '2001-06-01' GROUP BY symbol) l ON l.symbol = a0.symbol LEFT JOIN (SELECT DISTINCT symbol FROM act WHERE share_ratio > 0 AND symbol < '000030') e ON e.symbol = a0.symbol""",
    ),
    "protocol_gate": with_(
        "ver",
        "SELECT count(*) FILTER (status = 'fatal') AS fatal_rows, count(DISTINCT CASE WHEN status = 'not_run' THEN experiment_id END) AS missing_experiments, CASE WHEN count(*) FILTER (status = 'fatal') > 0 THEN 'fatal_defect' WHEN count(*) FILTER (status = 'not_run') > 0 THEN 'incomplete' ELSE 'ready_to_seal' END AS status FROM ver",
    ),
    "robustness_verdicts": with_("ver", "SELECT " + r("experiment_id category status metric value* baseline_experiment_id baseline_value* baseline_delta* interpretation") + " FROM ver"),
    "path_summary": with_(
        "bench",
        """, a0 AS (SELECT 'equal' AS path, date, equal_weight AS nav FROM bench UNION ALL SELECT 'cap', date, cap_weight FROM bench),
a1 AS (SELECT *, nav / lag(nav) OVER w - 1 AS r, nav / max(nav) OVER (PARTITION BY path ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS d FROM a0 WINDOW w AS (PARTITION BY path ORDER BY date)),
a2 AS (SELECT path, min(date) AS start_date, max(date) AS end_date, count(*) AS observations, arg_max(nav, date) / arg_min(nav, date) AS g, avg(r) AS m, stddev_samp(r) AS s, min(d) AS maximum_drawdown FROM a1 GROUP BY path),
a3 AS (SELECT path, date_trunc('month', date) AS mo, arg_max(nav, date) AS v FROM a0 GROUP BY ALL),
a4 AS (SELECT path, avg(CAST(q > 0 AS INT)) AS monthly_win_rate FROM (SELECT path, v / lag(v) OVER (PARTITION BY path ORDER BY mo) - 1 AS q FROM a3) WHERE q IS NOT NULL GROUP BY path)
SELECT a2.path, start_date, end_date, observations, round(ln(g), 6) AS log_total_return, round(pow(g, 1 / greatest((end_date - start_date) / 365.25::DOUBLE, 1 / 252.0::DOUBLE)) - 1, 6) AS annual_return, round(s * sqrt(252.0::DOUBLE), 6) AS annual_volatility,
  round(coalesce(m / s * sqrt(252.0::DOUBLE), 0), 6) AS sharpe_zero_rate, round(maximum_drawdown, 6) AS maximum_drawdown, round(monthly_win_rate, 6) AS monthly_win_rate FROM a2 JOIN a4 USING (path)""",
    ),
    "fama_macbeth_monthly": with_("fmx", "SELECT " + r("date factor_name coefficient* n_obs r_squared*") + " FROM fmx"),
    "fama_macbeth_summary": with_("fmx", "")
    + ",\n"
    + newey("fmx", "factor_name", "date", "coefficient", "0", "na", 1)
    + ",\n"
    + newey("fmx", "factor_name", "date", "coefficient", "CAST(floor(4 * pow(count(*) / 100.0::DOUBLE, 2 / 9.0::DOUBLE)) AS INT)", "nb", 5)
    + " SELECT na.factor_name, na.n AS months, round(na.mean, 6) AS mean_coefficient, na.lag AS published_lag, round(na.t, 6) AS t_published_lag, nb.lag AS automatic_lag, round(nb.t, 6) AS t_automatic_lag, round(z.a, 6) AS mean_n_obs, round(z.b, 6) AS mean_r_squared"
    " FROM na JOIN nb USING (factor_name) JOIN (SELECT factor_name, avg(n_obs) AS a, avg(r_squared) AS b FROM fmx GROUP BY factor_name) z USING (factor_name)",
    "buffered_portfolio": with_("comp sco", "").replace("WITH ", "WITH RECURSIVE ", 1)
    + ", a0 AS (SELECT c.method AS k, c.date, c.symbol, c.score, b.raw_value AS z, 2 AS per_group, 4 AS buffer FROM comp c JOIN sco b ON b.date = c.date AND b.symbol = c.symbol AND b.factor_name = 'log_market_cap' WHERE b.raw_value IS NOT NULL AND c.score IS NOT NULL),"
    + BUFFERED.format(k="method"),
    "variant_targets": with_("roll pan sco", "").replace("WITH ", "WITH RECURSIVE ", 1)
    + """, b0 AS (SELECT * FROM (VALUES ('baseline', 4, 25, 1), ('quarterly', 4, 25, 3), ('tight_buffer', 2, 25, 1), ('wide', 4, 40, 1)) AS v(k, buffer, universe, every)),
b1 AS (SELECT r.*, dense_rank() OVER (ORDER BY r.date) - 1 AS month, row_number() OVER (PARTITION BY r.date ORDER BY -p.raw_value DESC NULLS LAST, r.symbol) AS i FROM roll r LEFT JOIN (SELECT * FROM pan WHERE factor_name = 'amihud_20') p ON p.date = r.date AND p.symbol = r.symbol),
a0 AS (SELECT b0.k, c.date, c.symbol, c.score, s.raw_value AS z, 2 AS per_group, b0.buffer FROM b1 c JOIN b0 ON c.i <= universe AND month % every = 0 JOIN sco s ON s.date = c.date AND s.symbol = c.symbol AND s.factor_name = 'log_market_cap' WHERE s.raw_value IS NOT NULL),"""
    + BUFFERED.format(k="variant"),
    "mvp_ic_summary": with_(
        "msig sig",
        """, a0 AS (SELECT date, momentum_z AS x, forward_return AS y FROM msig SEMI JOIN sig USING (date) WHERE momentum_z IS NOT NULL AND forward_return IS NOT NULL),
"""
        + spearman_sql("a0", "date", 20, "a1", ("few", "flat"))
        + " SELECT count(c) AS months, round(avg(c), 6) AS mean_ic, round(stddev_samp(c), 6) AS ic_std, round(avg(CAST(c > 0 AS INT)), 6) AS positive_ic_rate, round(avg(c) / stddev_samp(c) * sqrt(12.0::DOUBLE), 6) AS icir FROM a1",
    ),
    "supplement_ic": with_(
        "comp lab",
        """, a0 AS (SELECT c.date, c.method, c.score AS x, l.forward_return_60 AS y FROM comp c JOIN lab l USING (date, symbol) WHERE score IS NOT NULL AND l.forward_return_60 IS NOT NULL),
"""
        + spearman_sql("a0", "date, method", 3, "a1", ("insufficient_observations", "constant_score"))
        + " SELECT date, method, n AS n_obs, round(c, 6) AS rank_ic, reason FROM a1",
    ),
    "attached_metrics": with_(
        "stb cnw cqs",
        "SELECT s.method || '_top' AS candidate, round(top10_turnover, 6) AS top10_turnover, round(c.mean, 6) AS rank_ic, round(CASE WHEN std > 0 THEN c.mean / std * sqrt(12.0::DOUBLE) END, 6) AS icir, round(q.monotonicity, 6) AS monotonicity FROM stb s LEFT JOIN cnw c ON c.method = s.method AND c.horizon = 20 LEFT JOIN cqs q ON q.method = s.method",
    ),
    "target_contract": with_(
        "tgt",
        """, a0 AS (SELECT portfolio_name, date, count(*) AS n, sum(target_weight) AS w FROM tgt GROUP BY ALL)
SELECT 'other_count' AS rule, count(*) FILTER (n <> 10) AS violations FROM a0 UNION ALL SELECT 'other_sum', count(*) FILTER (abs(w - 1) > 1e-10) FROM a0 UNION ALL SELECT 'bad_weight', count(*) FILTER (target_weight < 0) FROM tgt UNION ALL SELECT 'late_date', count(*) FILTER (date >= DATE '2001-06-30') FROM tgt""",
    ),
    "sealed_dates": with_(
        "bars sco wts tgt",
        """, a0 AS (SELECT 'bars' AS "table", 'date' AS "column", max(date) AS latest FROM bars UNION ALL SELECT 'scores', 'date', max(date) FROM sco UNION ALL SELECT 'weights', 'date', max(date) FROM wts UNION ALL SELECT 'weights', 'history_end_date', max(history_end) FROM wts UNION ALL SELECT 'targets', 'date', max(date) FROM tgt)
SELECT *, latest < DATE '2001-11-01' AS is_sealed FROM a0""",
    ),
    "source_coverage": with_(
        "act bars",
        """, a0 AS (SELECT count(DISTINCT symbol) AS e FROM bars), a1 AS (SELECT count(DISTINCT symbol) AS c FROM act WHERE share_ratio > 0), a2 AS (SELECT count(DISTINCT symbol) AS m FROM bars WHERE symbol NOT IN (SELECT symbol FROM act WHERE share_ratio > 0)), a3 AS (SELECT count(*) FILTER (cash_per_share > 0 AND day(ex_date) = 9) AS p FROM act)
SELECT e AS expected_symbols, c AS cached_symbols, m AS missing_symbols, p AS payment_dates_missing, CASE WHEN m > 0 OR p > 0 THEN 'blocked' ELSE 'ready' END AS status FROM a0, a1, a2, a3""",
    ),
    "executable_ic": with_(
        "obj lab exl",
        """, a0 AS (SELECT o.*, h.horizon, h.f, h.x FROM obj o JOIN lab l USING (date, symbol) JOIN exl e USING (date, symbol), LATERAL (VALUES (5, l.forward_return_5, e.x5), (20, l.forward_return_20, e.x20)) AS h(horizon, f, x)),
a1 AS (SELECT object_type, object_name, horizon, count(CASE WHEN f IS NOT NULL AND x IS NOT NULL THEN 1 END) / count(f) AS label_coverage FROM a0 GROUP BY ALL),
a2 AS (SELECT object_type, object_name, horizon, date, value AS x, u.label, u.y FROM a0, LATERAL (VALUES ('close', f), ('open', a0.x)) AS u(label, y) WHERE f IS NOT NULL AND a0.x IS NOT NULL AND value IS NOT NULL),
"""
        + spearman_sql("a2", "object_type, object_name, horizon, label, date", "CASE WHEN object_type = 'factor' THEN 20 ELSE 3 END", "a3", ("few", "flat"))
        + ",\n"
        + newey("a3", "object_type, object_name, horizon, label", "date", "c", LAG, "a4")
        + """, a5 AS (SELECT *, CASE WHEN std > 0 THEN mean / std * sqrt(12.0::DOUBLE) END AS icir FROM a4),
a6 AS (SELECT object_type, object_name, horizon, max(CASE WHEN label = 'open' THEN n END) AS months, """
        + ", ".join(f"max(CASE WHEN label = '{side}' THEN {c} END) AS {side}_{n}" for side in ("close", "open") for c, n in (("mean", "mean_ic"), ("icir", "icir"), ("t", "t")))
        + """ FROM a5 GROUP BY ALL)
SELECT a1.object_type, a1.object_name, a1.horizon, round(label_coverage, 6) AS label_coverage, months, """
        + ", ".join(f"round({side}_{n}, 6) AS {side}_{n}" for side in ("close", "open") for n in ("mean_ic", "icir", "t"))
        + ", round(open_mean_ic - close_mean_ic, 6) AS mean_ic_change, round(open_mean_ic / close_mean_ic, 6) AS mean_ic_retained FROM a1 LEFT JOIN a6 USING (object_type, object_name, horizon)",
    ),
    "lag_table": with_(
        "ic cic per",
        f""", a0 AS (SELECT 'factor' AS object_type, factor_name AS object_name, date, rank_ic FROM ic WHERE horizon = 20 AND score_variant = {PRIMARY} UNION ALL SELECT 'composite', method, date, rank_ic FROM cic WHERE horizon = 20),
a1 AS (SELECT period, a0.* FROM a0 JOIN per ON date BETWEEN s AND e),
"""
        + newey("a1", "period, object_type, object_name", "date", "rank_ic", "0", "na", 1)
        + ",\n"
        + newey("a1", "period, object_type, object_name", "date", "rank_ic", "CAST(floor(4 * pow(count(*) / 100.0::DOUBLE, 2 / 9.0::DOUBLE)) AS INT)", "nb", 5)
        + " SELECT period, object_type, object_name, na.n AS months, round(na.mean, 6) AS mean_ic, na.lag AS published_lag, round(na.t, 6) AS t_published_lag, nb.lag AS automatic_lag, round(nb.t, 6) AS t_automatic_lag FROM na JOIN nb USING (period, object_type, object_name)",
    ),
    "relative_by_period": with_(
        "bench per",
        """, a0 AS (SELECT period, (e - s) / 365.25::DOUBLE AS years, date, equal_weight AS x, cap_weight AS y FROM bench JOIN per ON date BETWEEN s AND e OR date = (SELECT max(date) FROM bench WHERE date < s)),
a1 AS (SELECT *, x / lag(x) OVER w - 1 AS a, y / lag(y) OVER w - 1 AS b FROM a0 WINDOW w AS (PARTITION BY period ORDER BY date)),
a2 AS (SELECT period, years, arg_max(x, date) / arg_min(x, date) AS gx, arg_max(y, date) / arg_min(y, date) AS gy, stddev_samp(a - b) * sqrt(252.0::DOUBLE) AS te, avg(a - b) AS ma, covar_samp(a, b) / var_samp(b) AS beta, corr(a, b) AS c FROM a1 GROUP BY ALL)
SELECT period, 'equal_over_cap' AS pair, round(years, 6) AS years, round(pow(gx, 1 / years) - 1, 6) AS strategy_annual_return, round(pow(gy, 1 / years) - 1, 6) AS benchmark_annual_return, round(pow(gx / gy, 1 / years) - 1, 6) AS annual_relative_return, round(te, 6) AS tracking_error, round(ma * 252 / te, 6) AS information_ratio, round(beta, 6) AS beta, round(c, 6) AS correlation FROM a2""",
    ),
    "slice_metrics": with_("slc", "SELECT 'equal' AS candidate, " + r("start_date end_date years* annual_return* zero_cost_annual_return* cost_erosion* annual_volatility* maximum_drawdown* turnover*") + " FROM slc"),
    "slice_verdicts": with_(
        "slc",
        """SELECT 'equal' AS experiment_id, metric, round(value, 6) AS value, round(delta, 6) AS delta, CASE WHEN metric = 'maximum_drawdown' THEN CASE WHEN delta >= -0.05 THEN 'stable' ELSE 'sensitive' END WHEN abs(delta) <= t THEN 'stable' ELSE 'sensitive' END AS verdict
FROM slc, LATERAL (VALUES ('annual_return', annual_return, annual_return - zero_cost_annual_return, 0.02), ('maximum_drawdown', maximum_drawdown, maximum_drawdown - (maximum_drawdown + 0.1), 0.05), ('turnover', turnover, 0.0::DOUBLE, 0.5)) AS u(metric, value, delta, t)""",
    ),
    "validation_metrics": with_(
        "bench dia",
        """, a0 AS (SELECT date, equal_weight AS nav, cap_weight AS zero FROM bench WHERE date BETWEEN (SELECT max(date) FROM bench WHERE date < DATE '1999-01-01') AND DATE '2001-12-31'),
a1 AS (SELECT *, nav / lag(nav) OVER w - 1 AS q, nav / max(nav) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS d FROM a0 WINDOW w AS (ORDER BY date)),
a2 AS (SELECT (DATE '2001-12-31' - DATE '1999-01-01') / 365.25::DOUBLE AS years, arg_max(nav, date) / arg_min(nav, date) AS g, arg_max(zero, date) / arg_min(zero, date) AS z, stddev_samp(q) AS s, min(d) AS m, max(CASE WHEN date >= DATE '1999-01-01' THEN abs(ln(nav) - ln(zero)) END) AS gap FROM a1)
SELECT 'equal' AS candidate, round(pow(g, 1 / years) - 1, 6) AS net_annual_return, round(s * sqrt(252.0::DOUBLE), 6) AS annual_volatility, round(m, 6) AS maximum_drawdown, 0.05::DOUBLE AS average_cash_weight, round(t.a, 6) AS turnover, round(t.b, 6) AS average_target_deviation, round(gap, 6) AS maximum_reconciliation_difference,
  round(pow(z, 1 / years) - pow(g, 1 / years), 6) AS cost_erosion FROM a2, (SELECT avg(one_way_turnover) AS a, avg(max_weight) AS b FROM dia WHERE portfolio_name = 'top20_equal' AND date BETWEEN DATE '1999-01-01' AND DATE '2001-12-31') t""",
    ),
    "index_levels": with_("bench", """SELECT date, round(ln(equal_weight), 6) AS "equal", round(ln(cap_weight), 6) AS cap FROM (SELECT *, row_number() OVER (ORDER BY date) AS i FROM bench) WHERE i > 1"""),
    "index_violations": with_(
        "idx cal",
        """, a0 AS (SELECT "index", date, close, CASE WHEN "index" = 'cap' AND day(date) = 15 THEN preclose * 2 ELSE preclose END AS preclose FROM idx WHERE "index" = 'equal' OR day(date) <> 7),
a1 AS (SELECT *, lag(close) OVER w AS last FROM a0 WINDOW w AS (PARTITION BY "index" ORDER BY date)),
a2 AS (SELECT "index", count(*) FILTER (date < DATE '1996-01-01' OR date > DATE '2001-06-30') AS outside_range, 0::BIGINT AS duplicate_date, count(*) FILTER (NOT (close > 0 AND preclose > 0)) AS invalid_level, count(*) FILTER (abs(preclose - last) > 1e-9) AS broken_chain, min(date) AS a, max(date) AS b, count(*) AS n FROM a1 GROUP BY 1),
a3 AS (SELECT a2.*, (SELECT count(*) FROM cal WHERE date BETWEEN a AND b) - n AS missing_date, 0::BIGINT AS unknown_date FROM a2)
SELECT "index", rule, violations FROM (SELECT "index", outside_range, duplicate_date, invalid_level, broken_chain, missing_date, unknown_date FROM a3) UNPIVOT (violations FOR rule IN (outside_range, duplicate_date, invalid_level, broken_chain, missing_date, unknown_date))""",
    ),
    "combination_audit": with_(
        "stat roll wts",
        """, a0 AS (SELECT date, method, count(*) AS scored_securities, min(family_count) AS minimum_family_count FROM (SELECT date, method, family_count FROM stat UNION ALL SELECT date, method, family_count FROM roll) GROUP BY ALL)
SELECT a0.*, fallback_factor_count, minimum_history_months FROM a0 LEFT JOIN (SELECT date, count(*) FILTER (fallback_equal) AS fallback_factor_count, min(history_months) AS minimum_history_months FROM wts GROUP BY date) w USING (date)""",
    ),
    "panel_coverage": with_("sco", "SELECT factor_name, family, point_in_time_status, count(*) AS rows, count(score_size_neutral) AS finite_scores, count(*) - count(score_size_neutral) AS missing_scores, round(count(score_size_neutral) / count(*), 6) AS coverage FROM sco GROUP BY ALL"),
    "redundancy_reasons": with_(
        "ps",
        """, a0 AS (SELECT a.date, a.factor_name AS factor_a, b.factor_name AS factor_b, a.value AS x, b.value AS y FROM ps a JOIN ps b ON a.date = b.date AND a.symbol = b.symbol AND a.factor_name <= b.factor_name),
a1 AS (SELECT * FROM a0 WHERE x IS NOT NULL AND y IS NOT NULL),
"""
        + spearman_sql("a1", "date, factor_a, factor_b", 45, "a2", ("insufficient_common_observations", "constant_score"))
        + """, a3 AS (SELECT factor_a, factor_b, c, CASE WHEN n IS NULL THEN 'insufficient_common_observations' ELSE reason END AS reason FROM (SELECT DISTINCT date, factor_a, factor_b FROM a0) k LEFT JOIN a2 USING (date, factor_a, factor_b)),
a4 AS (SELECT factor_a, factor_b, reason, count(*) AS n, count(c) AS k FROM a3 GROUP BY ALL)
SELECT factor_a, factor_b, CAST(sum(k) AS BIGINT) AS common_months, CASE WHEN sum(k) = 0 THEN 'no_valid_common_months:' || string_agg(reason || CASE WHEN n > 1 THEN '=' || n ELSE '' END, ',' ORDER BY reason) END AS reason FROM a4 GROUP BY ALL""",
    ),
    "composite_subperiods": with_("cic per", "SELECT period AS subperiod, method, horizon, round(avg(rank_ic), 6) AS mean_ic, count(rank_ic) AS valid_months FROM cic JOIN per ON date BETWEEN s AND e GROUP BY ALL"),
    "legs_by_period": with_(
        "cqr per",
        """, a0 AS (SELECT period, date, method, sum(mean_return * n_obs) / sum(n_obs) AS u, max(CASE WHEN quantile = 5 THEN mean_return END) AS top, max(CASE WHEN quantile = 1 THEN mean_return END) AS low FROM cqr JOIN per ON date BETWEEN s AND e GROUP BY ALL),
a1 AS (SELECT *, top - u - avg(top - u) OVER g AS el, u - low - avg(u - low) OVER g AS es FROM a0 WHERE top IS NOT NULL AND low IS NOT NULL WINDOW g AS (PARTITION BY period, method)),
a2 AS (SELECT period, method, count(*) AS months, avg(top - u) AS l, avg(u - low) AS s, sum(el * el) / count(*) AS vl, sum(es * es) / count(*) AS vs FROM a1 GROUP BY period, method)
SELECT period, method, months, round(l, 6) AS long_leg, round(l / sqrt(vl / months), 6) AS long_leg_t, round(s, 6) AS short_leg, round(s / sqrt(vs / months), 6) AS short_leg_t, round(l + s, 6) AS spread, round(CASE WHEN l + s > 0 THEN l / (l + s) END, 6) AS long_share FROM a2""",
    ),
    "quantile_frames": with_(
        "qr cqr per",
        f"SELECT period, object_name, quantile, count(*) AS months, round(avg(mean_return), 6) AS mean_return, CAST(sum(n_obs) AS BIGINT) AS n_obs FROM (SELECT date, factor_name AS object_name, quantile, n_obs, mean_return FROM qr WHERE score_variant = {PRIMARY} UNION ALL SELECT date, method, quantile, n_obs, mean_return FROM cqr) JOIN per ON date BETWEEN s AND e GROUP BY period, object_name, quantile",
    ),
    "cost_components": with_(
        "cost",
        """, a0 AS (SELECT portfolio_name, sum(amount) AS amount, sum(total_cost) AS total, sum(commission) AS commission, sum(stamp_duty) AS stamp_duty, sum(transfer_fee) AS transfer_fee, sum(slippage_cost) AS slippage_cost, sum(impact_cost) AS impact_cost FROM cost GROUP BY 1)
SELECT portfolio_name, component, round(c * 1e4 / amount, 6) AS bps, round(c / total, 6) AS share FROM a0 UNPIVOT (c FOR component IN (commission, stamp_duty, transfer_fee, slippage_cost, impact_cost))""",
    ),
    "correlation_matrix": with_(
        "red",
        """, a0 AS (SELECT * FROM (VALUES ('reversal_5', 0), ('reversal_20', 1), ('turnover_20', 2), ('amihud_20', 3), ('log_market_cap', 4)) AS t(name, i))
SELECT a.i AS "row", b.i AS "column", factor_a, factor_b, round(mean_correlation, 6) AS mean_correlation FROM red JOIN a0 a ON a.name = factor_a JOIN a0 b ON b.name = factor_b""",
    ),
    "continuous_targets": with_("tgt", "SELECT date, symbol, round(target_weight, 6) AS target_weight FROM tgt WHERE portfolio_name = CASE WHEN date <= DATE '1998-12-31' THEN 'top10_equal' ELSE 'top20_equal' END"),
    "applied_actions": with_(
        "act bars",
        """, a0 AS (SELECT symbol, arg_max(cash_per_share, effective_date) AS c, arg_max(share_ratio, effective_date) AS q FROM act GROUP BY symbol), a1 AS (SELECT DISTINCT symbol, CAST(symbol AS BIGINT) * 7 + 100 AS shares FROM bars)
SELECT symbol, CAST(round_even(shares * coalesce(1 + q, 1.0::DOUBLE), 0) AS BIGINT) AS shares, round(shares * coalesce(c, 0), 6) AS cash FROM a1 LEFT JOIN a0 USING (symbol)""",
    ),
    "redundancy_input": with_(
        "sco",
        """SELECT u.rule, u.n AS violations FROM (SELECT count(*) FILTER (date IS NULL OR symbol IS NULL OR factor_name IS NULL) AS a, count(*) FILTER (trim(symbol) = '' OR trim(factor_name) = '') AS b, count(*) FILTER (date < DATE '1996-06-01' OR date > DATE '2001-06-30') AS c,
  count(*) - count(DISTINCT (date, symbol, factor_name)) AS d FROM sco) t, LATERAL (VALUES ('null_key', a), ('blank_key', b), ('outside_period', c), ('unknown_factor', 0::BIGINT), ('other_family', 0::BIGINT), ('duplicate_key', d), ('several_signal_dates', 0::BIGINT), ('several_statuses', 0::BIGINT)) AS u(rule, n)""",
    ),
    "metric_tables": with_(
        "fs red",
        f""", a0 AS (SELECT DISTINCT factor_name, score_variant, horizon FROM fs WHERE NOT (factor_name = 'bp' AND horizon = 60)), a1 AS (SELECT * FROM red WHERE NOT (factor_a = 'bp' AND factor_b = 'sp_ttm')),
a2 AS (SELECT factor_a, factor_b FROM a1 WHERE {PLACE.format("factor_a")} < {PLACE.format("factor_b")} AND abs(mean_correlation) >= 0.5)
SELECT 'missing_metric' AS rule, {3 * sum(1 + f.size_neutral for f in FACTORS)} - count(*) AS violations FROM a0 UNION ALL SELECT 'unknown_metric', 0 UNION ALL SELECT 'duplicate_metric', 0
UNION ALL SELECT 'asymmetric_pair', count(*) FROM a1 x LEFT JOIN a1 y ON y.factor_a = x.factor_b AND y.factor_b = x.factor_a WHERE y.factor_a IS NULL OR y.mean_correlation IS DISTINCT FROM x.mean_correlation OR y.common_months <> x.common_months
UNION ALL SELECT 'flag_mismatch', (SELECT count(*) FROM a2 WHERE factor_a = 'reversal_5') + (SELECT count(*) FROM (SELECT factor_a, factor_b FROM red WHERE {PLACE.format("factor_a")} < {PLACE.format("factor_b")} AND abs(mean_correlation) >= 0.5 AND factor_a <> 'reversal_5' EXCEPT SELECT * FROM a2))""",
    ),
    "panel_build_counts": with_("lst", f"SELECT year(date) AS year, count(*) AS rows, min(date) AS minimum_date, max(date) AS maximum_date FROM lst WHERE {HERE} AND NOT coalesce({BAD}, false) GROUP BY 1"),
    "panel_build_records": with_(
        "lst",
        f""", a0 AS (SELECT date, count(*) FILTER (NOT ({HERE})) AS a, count(*) FILTER ({HERE} AND coalesce({BAD}, false)) AS b, count(*) FILTER ({HERE} AND NOT coalesce({BAD}, false)) AS kept,
  count(*) FILTER ({HERE} AND NOT coalesce({BAD}, false) AND (prev_close_raw IS NULL OR prev_close_adj IS NULL)) AS c, count(*) FILTER ({HERE} AND NOT coalesce({BAD}, false) AND (pe_ttm IS NULL OR pb IS NULL OR ps_ttm IS NULL)) AS d FROM lst GROUP BY date)
SELECT date, u.severity, u.code, u.n AS count FROM a0, LATERAL (VALUES ('warning', 'outside_supported_markets_excluded', a), ('warning', 'invalid_ohlc_quarantined', b), ('warning', 'missing_prev_close', c), ('warning', 'missing_valuation', d), ('error', 'no_rows_left', CASE WHEN kept = 0 THEN 1::BIGINT ELSE 0::BIGINT END)) AS u(severity, code, n) WHERE u.n > 0""",
    ),
    "candidate_selection": with_(
        "cnw stb",
        """, a0 AS (SELECT c.method AS candidate, mean AS net_annual_return, -top10_turnover AS maximum_drawdown, top10_turnover AS turnover FROM cnw c JOIN stb s ON s.method = c.method WHERE horizon = 20),
a1 AS (SELECT a.*, concat_ws(';', CASE WHEN a.candidate <> b.candidate AND a.net_annual_return < b.net_annual_return - 0.01 THEN 'minimum_return_improvement' END, CASE WHEN a.candidate <> b.candidate AND a.maximum_drawdown < b.maximum_drawdown - 0.2 THEN 'maximum_drawdown_deterioration' END,
  CASE WHEN a.candidate <> b.candidate AND a.turnover > b.turnover + 0.05 THEN 'maximum_turnover_increase' END) AS failed_rules FROM a0 a, (SELECT * FROM a0 WHERE candidate = 'candidate_equal') b)
SELECT candidate, round(net_annual_return, 6) AS net_annual_return, round(maximum_drawdown, 6) AS maximum_drawdown, round(turnover, 6) AS turnover, failed_rules, failed_rules = '' AS passed,
  candidate = coalesce((SELECT candidate FROM a1 WHERE failed_rules = '' AND candidate <> 'candidate_equal' ORDER BY net_annual_return DESC, candidate DESC LIMIT 1), 'candidate_equal') AS selected FROM a1""",
    ),
    "event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL",
}


def erfc_sql(x: str) -> str:
    """The error function's complement of a non-negative column, in the same steps as the column expression."""
    series, tail = "1.0", f"greatest({x}, {ERFC_EDGE}::DOUBLE)"
    for k in range(SERIES, 0, -1):
        series = f"(1.0 + 2 * {x} * {x} / {2 * k + 1}.0::DOUBLE * {series})"
    far = tail
    for k in range(LEVELS, 0, -1):
        tail = f"({far} + {k / 2.0}::DOUBLE / {tail})"
    root = math.sqrt(math.pi)
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} < {ERFC_EDGE} THEN 1 - {2.0 / root!r}::DOUBLE * {x} * exp(-{x} * {x}) * {series} ELSE exp(-{far} * {far}) / {root!r}::DOUBLE / {tail} END"


_trades = """j0 AS (SELECT o.*, scenario, participation, fixed, imp, rate, least_fee, scale, CASE WHEN reason IS NULL THEN CAST(least(quantity, CASE WHEN side = 'buy' THEN floor(floor(adv * participation / open_raw) / 100) * 100 ELSE floor(adv * participation / open_raw) END) AS BIGINT) ELSE 0 END AS filled
  FROM (SELECT * EXCLUDE fill_quantity FROM ord) o, (VALUES ('baseline', 0.5, 5.0, 10.0, 0.0003, 5.0, 1.0), ('execution_full_cost', 0.5, 5.0, 10.0, 0.0003, 5.0, 1.0), ('zero_cost', 0.5, 0.0, 0.0, 0.0003, 5.0, 0.0), ('explicit_fees', 0.5, 0.0, 0.0, 0.0003, 5.0, 1.0),
    ('participation_10', 0.1, 5.0, 10.0, 0.0003, 5.0, 1.0), ('double_slippage', 0.5, 10.0, 20.0, 0.0003, 5.0, 1.0), ('dear_broker', 0.5, 5.0, 10.0, 0.001, 25.0, 1.0)) AS s0(scenario, a, b, c, d, e, f), LATERAL (SELECT a::DOUBLE AS participation, b::DOUBLE AS fixed, c::DOUBLE AS imp, d::DOUBLE AS rate, e::DOUBLE AS least_fee, f::DOUBLE AS scale) AS s),
j1 AS (SELECT *, least(50.0::DOUBLE, imp * sqrt(filled * open_raw / adv / 0.01)) AS impact FROM j0 WHERE filled > 0),
j2 AS (SELECT *, CAST(round(CAST(CAST(open_raw * (1 + CASE WHEN side = 'buy' THEN 1 ELSE -1 END * (fixed + impact) / 10000) AS VARCHAR) AS DECIMAL(30,12)), 2) AS DOUBLE) AS price FROM j1),
j3 AS (SELECT *, filled * price AS amount FROM j2),
j4 AS (SELECT *, (greatest(least_fee, amount * rate) + amount * CASE WHEN date <= DATE '1998-06-11' THEN 0.003::DOUBLE WHEN side = 'buy' THEN 0.0::DOUBLE ELSE 0.004::DOUBLE END +
  CASE WHEN symbol[1] IN ('5', '6', '9') THEN greatest(1.0::DOUBLE, filled * 0.001::DOUBLE) WHEN date <= DATE '1999-12-31' THEN 0.0::DOUBLE ELSE amount * 0.00002::DOUBLE END) * scale + filled * open_raw / 10000 * (fixed + impact) AS total_cost FROM j3),
j5 AS (SELECT scenario, portfolio_name, CAST(sum(CAST(amount AS DECIMAL(28,9))) AS DOUBLE) AS amount, CAST(sum(CAST(total_cost AS DECIMAL(28,9))) AS DOUBLE) AS total_cost FROM j4 GROUP BY ALL),
j6 AS (SELECT scenario, portfolio_name, count(*) AS orders, CAST(sum(quantity) AS BIGINT) AS requested, CAST(sum(filled) AS BIGINT) AS filled FROM j0 GROUP BY ALL),
j7 AS (SELECT j6.*, coalesce(amount, 0) AS amount, coalesce(total_cost, 0) AS total_cost, 1 - filled / nullif(requested, 0) AS unfilled_rate, coalesce(total_cost, 0) / nullif(coalesce(amount, 0), 0) AS cost_rate FROM j6 LEFT JOIN j5 USING (scenario, portfolio_name))
SELECT j7.scenario, j7.portfolio_name, j7.orders, j7.requested, j7.filled, round(j7.unfilled_rate, 6) AS unfilled_rate, round(j7.amount, 2) AS amount, round(j7.total_cost, 2) AS total_cost, round(j7.cost_rate, 6) AS cost_rate, round(j7.cost_rate - b.cost_rate, 6) AS cost_rate_delta
FROM j7 LEFT JOIN j7 b ON b.scenario = 'baseline' AND b.portfolio_name = j7.portfolio_name"""

_ic_changed = "a1 AS (SELECT * REPLACE (CASE WHEN factor_name = 'ep_ttm' AND horizon = 60 THEN rank_ic + 0.001::DOUBLE ELSE rank_ic END AS rank_ic) FROM ic WHERE NOT (factor_name = 'bp' AND horizon = 5) UNION ALL SELECT * FROM ic WHERE factor_name = 'sp_ttm' AND horizon = 20)"
_selected = lambda name, what, table, where="true": f"SELECT '{name}' AS name, {what} AS value FROM {table} WHERE {where}"
_neutral = "score_variant = 'score_size_neutral' AND horizon = 20"
_range = lambda name, table: f"SELECT '{name}' AS stage, count(*) AS rows, min(date) AS min_date, max(date) AS max_date, true AS timed FROM {table}"
_cached = """s0 AS (SELECT 'shard' || (o_custkey % 40 % 3) AS shard, lpad(CAST(o_custkey % 40 AS VARCHAR), 6, '0') AS symbol, CAST(year(o_orderdate) AS INT) AS year, o_totalprice FROM orders),
s1 AS (SELECT DISTINCT symbol, shard FROM s0), s2 AS (SELECT shard, symbol, CAST(y AS INT) AS year FROM s1, range(1995, 2002) AS t(y)),
s3 AS (SELECT s2.*, coalesce(n, 0) AS row_count FROM s2 LEFT JOIN (SELECT symbol, year, count(*) AS n FROM s0 GROUP BY ALL) USING (symbol, year))"""

ORACLE_SQL |= {
    "fee_coverage": "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, 'sz' AS market, CAST(0 AS BIGINT) AS rules FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderdate < TIMESTAMP '2000-04-01'",
    "factor_p_values": with_(
        "nw",
        f""", a0 AS (SELECT factor_name, score_variant, horizon, abs(t) / {math.sqrt(2.0)!r}::DOUBLE AS z FROM (SELECT DISTINCT factor_name, score_variant, horizon FROM ic) k LEFT JOIN nw USING (factor_name, score_variant, horizon)), a1 AS (SELECT *, {erfc_sql("z")} AS p FROM a0),
a2 AS (SELECT *, row_number() OVER (ORDER BY p, factor_name) AS k, count(*) OVER () AS m FROM a1 WHERE p IS NOT NULL AND horizon = 20 AND score_variant = {PRIMARY}),
a3 AS (SELECT *, min(least(1, p * m / k)) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS q FROM a2)
SELECT a1.factor_name, a1.score_variant, a1.horizon, round(a1.p, 4) AS nw_p, round(a3.q, 4) AS bh_q FROM a1 LEFT JOIN a3 USING (factor_name, score_variant, horizon)""",
    ),
    "block_bootstrap": with_(
        "bench",
        """, c0 AS (SELECT date, equal_weight / lag(equal_weight) OVER w - 1 AS s, cap_weight / lag(cap_weight) OVER w - 1 AS b FROM bench WINDOW w AS (ORDER BY date)),
c1 AS (SELECT row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n, s, s * s AS q, ln(1 + s) AS l, ln(1 + s) - ln(1 + b) AS d FROM c0 WHERE s IS NOT NULL AND b IS NOT NULL),
c2 AS (SELECT r AS replication, j, n, ('0x' || substr(md5('7:' || r || ':' || j), 1, 12))::BIGINT % n AS start FROM (SELECT DISTINCT n FROM c1), range(0, 500) AS x(r), range(0, 1000) AS y(j) WHERE j < ceil(n / 13.0)),
c3 AS (SELECT replication, n, (start + o) % n AS i FROM c2, range(0, 13) AS z(o) WHERE 13 * j + o < n),
c4 AS (SELECT replication, c3.n, sum(s) AS s, sum(q) AS q, sum(l) AS l, sum(d) AS d FROM c3 JOIN c1 USING (i) GROUP BY ALL UNION ALL SELECT -1, n, sum(s), sum(q), sum(l), sum(d) FROM c1 GROUP BY n),
c5 AS (SELECT replication, exp(l / 6.75) - 1 AS a, exp(d / 6.75) - 1 AS r, s / n / sqrt((q - s * s / n) / (n - 1)) * sqrt(252.0::DOUBLE) AS h FROM c4),
c6 AS (SELECT * FROM c5 WHERE replication >= 0)
SELECT 'equal_over_cap' AS pair, round(a, 6) AS annual_return, round(r, 6) AS annual_relative_return, round(h, 6) AS sharpe, round((SELECT quantile_cont(a, 0.025) FROM c6), 6) AS annual_return_low, round((SELECT quantile_cont(a, 0.975) FROM c6), 6) AS annual_return_high,
 round((SELECT quantile_cont(r, 0.025) FROM c6), 6) AS annual_relative_return_low, round((SELECT quantile_cont(r, 0.975) FROM c6), 6) AS annual_relative_return_high, round((SELECT quantile_cont(h, 0.025) FROM c6), 6) AS sharpe_low, round((SELECT quantile_cont(h, 0.975) FROM c6), 6) AS sharpe_high,
 round((SELECT avg(CAST(r <= 1e-15 AS DOUBLE)) FROM c6), 6) AS relative_non_positive_share FROM c5 WHERE replication = -1""",
    ),
    "proportional_buys": with_("ord", "").replace("WITH ", "WITH RECURSIVE ", 1)
    + """, g0 AS (SELECT portfolio_name, date, symbol, quantity, open_raw AS price, CAST(CAST(CAST(open_raw AS VARCHAR) AS DECIMAL(28,4)) * 10000 AS HUGEINT) AS p, 40000000000::HUGEINT AS cash FROM ord WHERE side = 'buy' AND reason IS NULL),
g1 AS (SELECT *, sum(quantity * p) OVER w AS wanted FROM g0 WINDOW w AS (PARTITION BY portfolio_name, date)),
g2 AS (SELECT *, CASE WHEN wanted <= cash THEN quantity ELSE quantity * cash // (wanted * 100) * 100 END AS base FROM g1),
g3 AS MATERIALIZED (SELECT *, row_number() OVER (w ORDER BY (quantity - base) * p DESC, symbol) AS i, cash - sum(base * p) OVER w AS left_ FROM g2 WINDOW w AS (PARTITION BY portfolio_name, date)),
g4 AS (SELECT portfolio_name, date, i, symbol, quantity, price, base + CASE WHEN wanted > cash AND base + 100 <= quantity AND p * 100 <= left_ THEN 100 ELSE 0 END AS got, left_ - CASE WHEN wanted > cash AND base + 100 <= quantity AND p * 100 <= left_ THEN p * 100 ELSE 0 END AS rest FROM g3 WHERE i = 1
  UNION ALL SELECT g3.portfolio_name, g3.date, g3.i, g3.symbol, g3.quantity, g3.price, base + CASE WHEN wanted > cash AND base + 100 <= g3.quantity AND p * 100 <= rest THEN 100 ELSE 0 END, rest - CASE WHEN wanted > cash AND base + 100 <= g3.quantity AND p * 100 <= rest THEN p * 100 ELSE 0 END
  FROM g3 JOIN g4 ON g3.portfolio_name = g4.portfolio_name AND g3.date = g4.date AND g3.i = g4.i + 1)
SELECT portfolio_name, date, symbol, quantity, round(price, 6) AS price, CAST(got AS BIGINT) AS allocated, round(CAST(last_value(rest) OVER (PARTITION BY portfolio_name, date ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS DOUBLE) / 10000, 6) AS cash_left FROM g4""",
    "execution_scenarios": with_("ord", ", " + _trades),
    "mvp_targets": with_(
        "msig sig cal",
        """, a0 AS (SELECT date, symbol, row_number() OVER (PARTITION BY date ORDER BY momentum_z DESC, symbol) AS i FROM msig SEMI JOIN sig USING (date) WHERE momentum_z IS NOT NULL)
SELECT date AS signal_date, next_date AS execution_date, symbol, round(1.0::DOUBLE / count(*) OVER (PARTITION BY date), 6) AS target_weight FROM a0 JOIN cal USING (date) WHERE i <= 10 AND next_date IS NOT NULL""",
    ),
    "metric_catalogue": with_(
        "ic qr to_ red",
        f""", a0 AS (SELECT 'rank_ic' AS table_name, 'unknown_horizon' AS rule, count(*) AS violations FROM ic WHERE factor_name = 'bp' AND horizon = 60
UNION ALL SELECT 'rank_ic', 'duplicate_key', count(*) FROM ic WHERE factor_name = 'bp' AND horizon = 5
UNION ALL SELECT 'quantile_returns', 'invalid_quantile', count(*) FROM qr WHERE factor_name = 'ep_ttm' AND quantile = 5
UNION ALL SELECT 'factor_turnover', 'other_family', count(*) FROM to_ WHERE factor_name = 'momentum_60'
UNION ALL SELECT 'factor_summary', 'missing_key', 2 UNION ALL SELECT 'subperiod_metrics', 'period_dates', 2 UNION ALL SELECT 'classification', 'other_primary_variant', 1
UNION ALL SELECT 'factor_correlations', 'missing_key', 1 UNION ALL SELECT 'factor_correlations', 'asymmetric_pair', 1
UNION ALL SELECT 'redundancy_flags', 'missing_flag', count(*) FROM red WHERE factor_a = 'reversal_5' AND {PLACE.format("factor_a")} < {PLACE.format("factor_b")} AND abs(mean_correlation) >= 0.5 AND NOT (factor_a = 'bp' AND factor_b = 'sp_ttm')
UNION ALL SELECT 'redundancy_flags', 'unexpected_flag', count(*) FROM red WHERE factor_a = 'bp' AND factor_b = 'sp_ttm' AND abs(mean_correlation) >= 0.5
UNION ALL SELECT 'redundancy_flags', 'flag_values', count(*) FROM red WHERE factor_a = 'turnover_20' AND {PLACE.format("factor_a")} < {PLACE.format("factor_b")} AND abs(mean_correlation) >= 0.5)
SELECT table_name, rule, CAST(violations AS BIGINT) AS violations FROM a0 WHERE violations > 0""",
    ),
    "report_figures": with_(
        "ic fs ord to_",
        ", a0 AS ("
        + " UNION ALL ".join(
            [
                _selected("ic_rows", "count(*)", "ic"), _selected("ic_rows_20", "count(*)", "ic", "horizon = 20"), _selected("ic_factors", "count(DISTINCT factor_name)", "ic"), _selected("ic_months", "count(DISTINCT date)", "ic"),
                _selected("ic_reasons", "count(DISTINCT coalesce(reason, ''))", "ic"), _selected("ic_mean_reversal_5", "avg(rank_ic)", "ic", "factor_name = 'reversal_5' AND score_variant = 'score_size_neutral' AND horizon = 5"),
                _selected("ic_mean_turnover_20", "avg(rank_ic)", "ic", "factor_name = 'turnover_20' AND score_variant = 'score' AND horizon = 20"), _selected("ic_weighted_reversal_20", "sum(n_obs) / sum(horizon)", "ic", "factor_name = 'reversal_20'"),
                *[_selected(f"summary_mean_ic_{n}", "max(mean_ic)", "fs", f"factor_name = '{n}' AND {_neutral}") for n in ("reversal_5", "turnover_20", "amihud_20", "volatility_60")],
                *[_selected(f"summary_months_{h}", "max(valid_months)", "fs", f"factor_name = 'log_market_cap' AND score_variant = 'score' AND horizon = {h}") for h in H],
                _selected("summary_rows", "count(*)", "fs"), _selected("orders_all", "count(*)", "ord"), _selected("orders_portfolios", "count(DISTINCT portfolio_name)", "ord"), _selected("orders_filled_rate", "sum(fill_quantity) / sum(quantity)", "ord"),
                _selected("orders_sell_filled_rate", "sum(fill_quantity) / sum(quantity)", "ord", "side = 'sell' AND portfolio_name = 'top20_equal'"), _selected("turnover_mean_bp", "avg(turnover)", "to_", "factor_name = 'bp' AND score_variant = 'score'"),
            ]
        )
        + ") SELECT name, round(CAST(value AS DOUBLE), 6) AS value FROM a0",
    ),
    "run_differences": with_(
        "ic",
        f""", {_ic_changed}, a2 AS (SELECT *, 1 AS x, 0 AS y FROM ic UNION ALL SELECT *, 0, 1 FROM a1), a3 AS (SELECT date, factor_name, family, score_variant, horizon, n_obs, rank_ic, reason, CAST(sum(x) AS BIGINT) AS times_one, CAST(sum(y) AS BIGINT) AS times_two FROM a2 GROUP BY ALL)
SELECT times_one, times_two, count(*) AS rows FROM a3 WHERE times_one <> times_two GROUP BY ALL""",
    ),
    "unreproduced_ic": with_(
        "ic",
        f""", {_ic_changed}, a2 AS (SELECT date, factor_name, score_variant, horizon, any_value(rank_ic) AS published, 1 AS p FROM a1 GROUP BY ALL), a3 AS (SELECT date, factor_name, score_variant, horizon, rank_ic AS recomputed, 1 AS r FROM ic WHERE NOT (factor_name = 'momentum_60' AND horizon = 60)),
a4 AS (SELECT *, CASE WHEN r IS NULL THEN 'not_recomputed' WHEN p IS NULL THEN 'not_published' WHEN recomputed IS NULL AND published IS NULL THEN NULL WHEN recomputed IS NULL OR published IS NULL THEN 'null_on_one_side' WHEN abs(recomputed - published) > 1e-12 THEN 'beyond_tolerance' END AS reason
  FROM a3 FULL JOIN a2 USING (date, factor_name, score_variant, horizon))
SELECT date, factor_name, score_variant, horizon, 'rank_ic' AS value, round(recomputed, 6) AS recomputed, round(published, 6) AS published, reason FROM a4 WHERE reason IS NOT NULL""",
    ),
    "stage_statistics": with_("bars pan sco ic qr to_ stat comp tgt", " UNION ALL ".join(_range(n, t) for n, t in (("bars", "bars"), ("panel", "pan"), ("scored", "sco"), ("ic", "ic"), ("quantiles", "qr"), ("turnover", "to_"), ("static", "stat"), ("composites", "comp"), ("targets", "tgt")))),
    "source_footers": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows, CAST(min({d}) AS DATE) AS min_date, CAST(max({d}) AS DATE) AS max_date, {n} AS columns FROM {t}" for t, d, n in (("lineitem", "l_shipdate", 11), ("events", "ts", 6), ("orders", "o_orderdate", 6))),
    "source_violations": """
WITH f AS (SELECT 'lineitem.parquet' AS path, count(*) AS n, CAST(min(l_shipdate) AS DATE) AS a, CAST(max(l_shipdate) AS DATE) AS b FROM lineitem UNION ALL SELECT 'events.parquet', count(*), CAST(min(ts) AS DATE), CAST(max(ts) AS DATE) FROM events UNION ALL SELECT 'orders.parquet', count(*), CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE) FROM orders)
SELECT 'gone.parquet' AS path, 'missing_file' AS rule, CAST(n AS VARCHAR) AS recorded, NULL AS found FROM f WHERE path = 'orders.parquet' UNION ALL SELECT path, 'unrecorded_file', NULL, CAST(n AS VARCHAR) FROM f WHERE path = 'events.parquet'
UNION ALL SELECT path, 'rows', CAST(n + 1 AS VARCHAR), CAST(n AS VARCHAR) FROM f WHERE path = 'orders.parquet' UNION ALL SELECT path, 'min_date', CAST(a - 1 AS VARCHAR), CAST(a AS VARCHAR) FROM f WHERE path = 'lineitem.parquet'
UNION ALL SELECT path, 'outside_period', '1990-01-01..2001-06-30', a || '..' || b FROM f WHERE a < DATE '1990-01-01' OR b > DATE '2001-06-30'""",
    "replaced_year": with_("bars", "SELECT CAST(year(date) AS INT) AS year, count(*) AS rows, CAST(sum(CAST(volume AS BIGINT) * CASE WHEN year(date) = 1998 THEN 2 ELSE 1 END) AS BIGINT) AS volume FROM bars GROUP BY 1"),
    "cache_faults": f"""
WITH {_cached}
SELECT symbol, year, 'not_covered' AS fault, '' AS shards FROM s3 WHERE symbol = '000004' AND year = 1996
UNION ALL SELECT symbol, year, 'row_without_coverage', shard FROM s3 WHERE symbol = '000004' AND year = 1996 AND row_count > 0
UNION ALL SELECT symbol, year, 'row_count', shard FROM s3 WHERE symbol = '000006' AND year = 1998
UNION ALL SELECT symbol, year, 'covered_twice', shard || ',shard9' FROM s3 WHERE symbol = '000005' AND year = 1997
UNION ALL SELECT '999999', year, 'unexpected', shard FROM s3 WHERE symbol = '000007' AND year = 1999""",
    "refreshed_cache": f"""
WITH {_cached}, f AS (SELECT symbol, count(*) AS n FROM s0 WHERE year = 1997 AND o_totalprice > 100000 GROUP BY ALL)
SELECT s3.symbol, year, CASE WHEN year <> 1997 THEN shard WHEN s3.symbol < '000010' THEN 'round2' ELSE 'round1' END AS shard, CASE WHEN year <> 1997 THEN row_count WHEN s3.symbol < '000010' THEN 0 ELSE coalesce(n, 0) END AS row_count,
       CASE WHEN year <> 1997 THEN row_count WHEN s3.symbol < '000010' THEN 0 ELSE coalesce(n, 0) END AS rows FROM s3 LEFT JOIN f USING (symbol)""",
}
ORACLE_SQL |= {
    "portfolio_comparison": with_(
        "dia tgt",
        """, a AS (SELECT date, symbol FROM tgt WHERE portfolio_name = 'top10_equal'), b AS (SELECT date, symbol FROM tgt WHERE portfolio_name = 'top20_equal'),
c AS (SELECT date, count(a.symbol) AS n, count(b.symbol) AS m, count(CASE WHEN a.symbol IS NOT NULL AND b.symbol IS NOT NULL THEN 1 END) AS k FROM a FULL JOIN b USING (date, symbol) GROUP BY date)
SELECT date, round(k / greatest(least(n, m), 1), 6) AS holding_overlap, round(o.one_way_turnover - p.one_way_turnover, 6) AS turnover_difference FROM c JOIN (SELECT * FROM dia WHERE portfolio_name = 'top10_equal') p USING (date) JOIN (SELECT * FROM dia WHERE portfolio_name = 'top20_equal') o USING (date)""",
    ),
    "valuation_prices": with_(
        "tgt cal bars",
        """, h AS (SELECT cal.next_date AS date, tgt.symbol FROM tgt JOIN cal USING (date) WHERE portfolio_name = 'top10_equal' AND next_date IS NOT NULL),
p AS (SELECT date, symbol, CASE WHEN (dayofyear(date) + CAST(symbol AS INT)) % 5 <> 0 AND open_adj > 0 THEN open_adj END AS o, CASE WHEN ((dayofyear(date) + CAST(symbol AS INT)) % 7 <> 0 OR year(date) < 1996) AND close_adj > 0 THEN close_adj END AS c FROM bars),
m AS (SELECT date, symbol, c FROM p WHERE c IS NOT NULL)
SELECT h.date, h.symbol, round(coalesce(p.o, b.c), 6) AS opening_price, round(n.c, 6) AS closing_price, n.date AS close_date
FROM h LEFT JOIN p ON p.date = h.date AND p.symbol = h.symbol ASOF LEFT JOIN m b ON b.symbol = h.symbol AND b.date < h.date ASOF LEFT JOIN m n ON n.symbol = h.symbol AND n.date <= h.date""",
    ),
    "price_mismatches": with_(
        "bars",
        """, a AS (SELECT date, symbol, close_adj, (dayofyear(date) + CAST(symbol AS INT)) AS k FROM bars WHERE year(date) = 1999)
SELECT date, symbol, CAST(round(CAST(close_adj AS DECIMAL(28,9)), 6) AS DOUBLE) AS executed, CASE WHEN k % 101 <> 0 THEN CAST(round(CAST(close_adj + 1 AS DECIMAL(28,9)), 6) AS DOUBLE) END AS rebuilt, CASE WHEN k % 101 = 0 THEN 'missing' ELSE 'differing' END AS fault FROM a WHERE close_adj IS NOT NULL AND (k % 101 = 0 OR k % 97 = 0)""",
    ),
    "extended_panel": with_("exe", "SELECT " + r("date symbol adv* limit_rate* is_suspended") + " FROM exe WHERE date <= DATE '2001-12-31'"),
    "event_contract": """
WITH e AS (SELECT o_orderkey AS n, lpad(CAST(o_orderkey % 1000 AS VARCHAR), 6, '0') AS source_symbol, CAST(o_orderdate AS DATE) AS effective_date, CASE o_orderkey % 4 WHEN 0 THEN 'cash_exit' WHEN 1 THEN 'stock_merger' WHEN 2 THEN 'write_off' ELSE 'other' END AS event_type,
  CASE WHEN o_orderkey % 4 = 1 THEN lpad(CAST((o_orderkey + o_orderkey % 3) % 1000 AS VARCHAR), 6, '0') END AS target_symbol, CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey % 5 ELSE 0 END AS ratio, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 3 WHEN o_orderkey % 8 = 1 THEN 1 ELSE 0 END AS cash FROM orders WHERE o_orderkey % 29 = 0)
SELECT source_symbol, effective_date, 'unknown_type' AS rule FROM e WHERE event_type = 'other' UNION ALL SELECT source_symbol, effective_date, 'sealed_date' FROM e WHERE effective_date > DATE '2001-06-30'
UNION ALL SELECT source_symbol, effective_date, 'merger_terms' FROM e WHERE event_type = 'stock_merger' AND (target_symbol = source_symbol OR ratio = 0 OR cash <> 0) UNION ALL SELECT source_symbol, effective_date, 'exit_terms' FROM e WHERE event_type = 'cash_exit' AND cash = 0
UNION ALL SELECT source_symbol, effective_date, 'duplicate_key' FROM e GROUP BY source_symbol, effective_date HAVING count(*) > 1
UNION ALL SELECT source_symbol, effective_date, 'target_is_gone' FROM e WHERE EXISTS (SELECT 1 FROM e g WHERE g.source_symbol = e.target_symbol AND g.effective_date <= e.effective_date)""",
}
for _family, _digits in (("value", 9), ("momentum", 9), ("reversal", 9), ("liquidity", 12), ("low_volatility", 9), ("size", 9)):
    _names = " ".join(f.name + "*" for f in FACTORS if f.family == _family)
    ORACLE_SQL[f"factor_{_family}"] = with_("fac", "SELECT " + r(f"date symbol {_names}", _digits) + " FROM fac")
