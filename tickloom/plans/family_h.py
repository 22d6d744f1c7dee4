"""Factor evaluation."""

from pyspark.sql import functions as F

from ..core.slices import over_rows
from ..operators import evaluation as H
from .inputs import BARS, bars
from .registry import query

W = "PARTITION BY symbol ORDER BY ts"
PANEL = BARS + f""",
panel AS (SELECT symbol, ts, close / lag(close, 5) OVER ({W}) - 1 AS factor, lead(close) OVER ({W}) / close - 1 AS fwd_1,
  lead(close, 5) OVER ({W}) / close - 1 AS fwd_5, close / lag(close) OVER ({W}) - 1 AS ret FROM bars)"""


def panel(spark, d):
    """Five-row momentum as the factor, next returns as targets, in one pass."""
    c = F.col("close")
    f = lambda x, w: x.withColumns({"factor": c / F.lag(c, 5).over(w) - 1, "fwd_1": F.lead(c, 1).over(w) / c - 1,
                                    "fwd_5": F.lead(c, 5).over(w) / c - 1, "ret": c / F.lag(c).over(w) - 1})
    return over_rows(bars(spark, d), f, back=5, ahead=5).select("symbol", "ts", "factor", "fwd_1", "fwd_5", "ret")


def rank_cols(src: str, by: str, *pairs) -> str:
    part = f"PARTITION BY {by} " if by else ""
    comma = f"{by}, " if by else ""
    return f"SELECT *, " + ", ".join(f"rank() OVER ({part}ORDER BY {x}) + (count(*) OVER (PARTITION BY {comma}{x}) - 1) / 2.0 AS {o}" for x, o in pairs) + f" FROM {src}"


def qcut_sql(src: str, by: str, x: str, q: int, out: str, name: str) -> str:
    """Right-closed quantile bins with the same interpolation arithmetic as the library."""
    edge = lambda p: f"l[CAST(floor((len(l) - 1) * {p!r}) AS BIGINT) + 1] + (l[CAST(ceil((len(l) - 1) * {p!r}) AS BIGINT) + 1] - l[CAST(floor((len(l) - 1) * {p!r}) AS BIGINT) + 1]) * ((len(l) - 1) * {p!r} - floor((len(l) - 1) * {p!r}))"
    group = f"GROUP BY {by}" if by else ""
    sel = f"{by}, " if by else ""
    join = f"JOIN {name}_e USING ({by})" if by else f"CROSS JOIN {name}_e"
    return f"""{name}_l AS (SELECT {sel}list({x} ORDER BY {x}) AS l FROM {src} WHERE {x} IS NOT NULL {group}),
{name}_e AS (SELECT {sel}list_sort(list_distinct([{", ".join(edge(i / q) for i in range(q + 1))}])) AS e FROM {name}_l),
{name} AS (SELECT * EXCLUDE (e), CASE WHEN {x} IS NOT NULL AND len(e) > 1 THEN 1 + len(list_filter(e[2:len(e) - 1], lambda v: v < {x})) END AS {out} FROM {src} {join})"""


@query("h01_information_coefficient", "ts! n# ic:6", PANEL + """, g AS (SELECT ts, count(*) AS n, corr(factor, fwd_1) AS ic FROM panel
  WHERE factor IS NOT NULL AND fwd_1 IS NOT NULL GROUP BY ts), result AS (SELECT * FROM g WHERE n >= 3)""")
def h01(spark, d):
    return H.information_coefficient(panel(spark, d), "factor", "fwd_1")


RANKED = "pv AS (SELECT * FROM panel WHERE factor IS NOT NULL AND fwd_1 IS NOT NULL),\npr AS (" + rank_cols("pv", "ts", ("factor", "rf"), ("fwd_1", "rr")) + ")"


@query("h01_rank_information_coefficient", "ts! n# ic:6", PANEL + f""", {RANKED}, result AS (
  SELECT ts, count(*) AS n, corr(rf, rr) AS ic FROM pr GROUP BY ts HAVING count(*) >= 3)""")
def h01b(spark, d):
    return H.information_coefficient(panel(spark, d), "factor", "fwd_1", "spearman")


@query("h02_forward_returns", "symbol ts! fwd_1:8 fwd_5:8 fwd_10:8", BARS + ", result AS (SELECT symbol, ts, " + ", ".join(
    f"lead(close, {p}) OVER ({W}) / close - 1 AS fwd_{p}" for p in (1, 5, 10)) + " FROM bars)")
def h02(spark, d):
    return H.forward_returns(bars(spark, d))


FRET = f"""fp AS (SELECT * FROM panel WHERE factor IS NOT NULL), {qcut_sql('fp', 'ts', 'factor', 5, 'bin', 'fq')},
fr AS (SELECT ts, avg(CASE WHEN bin = 5 THEN fwd_1 END) - avg(CASE WHEN bin = 1 THEN fwd_1 END) AS fwd_1,
  avg(CASE WHEN bin = 5 THEN fwd_5 END) - avg(CASE WHEN bin = 1 THEN fwd_5 END) AS fwd_5 FROM fq GROUP BY ts
  HAVING count(CASE WHEN bin = 5 THEN 1 END) > 0 AND count(CASE WHEN bin = 1 THEN 1 END) > 0)"""


@query("h03_quantile_factor_returns", "ts! fwd_1:6 fwd_5:6", PANEL + f", {FRET}, result AS (SELECT * FROM fr)")
def h03(spark, d):
    return H.quantile_factor_returns(panel(spark, d), "factor", ["fwd_1", "fwd_5"])


PAIRS = """fd AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS prev FROM (SELECT DISTINCT ts FROM panel WHERE factor IS NOT NULL)),
dp AS (SELECT a.ts, a.symbol, a.factor AS now, b.factor AS before FROM panel a JOIN fd ON a.ts = fd.ts
  JOIN panel b ON b.ts = fd.prev AND a.symbol = b.symbol WHERE a.factor IS NOT NULL AND b.factor IS NOT NULL),
dq AS (SELECT * FROM dp QUALIFY count(*) OVER (PARTITION BY ts) >= 3)"""
TURN = f"{PAIRS}, {qcut_sql('dq', 'ts', 'now', 5, 'qn', 'tn')}, {qcut_sql('tn', 'ts', 'before', 5, 'qb', 'tb')}, tu AS (SELECT ts, avg(CASE WHEN qn <> qb THEN 1.0 ELSE 0.0 END) * 100 AS turnover FROM tb GROUP BY ts)"


@query("h04_turnover", "ts! turnover:6", PANEL + f", {TURN}, result AS (SELECT * FROM tu)")
def h04(spark, d):
    return H.turnover(panel(spark, d), "factor")


@query("h05_tearsheet", "ic_mean:6 ic_std:6 ic_ir:6 ic_spearman_mean:6 mean_return:6 std_return:6 sharpe:6 mean_turnover:6", PANEL + f""", {FRET}, {TURN}, {RANKED},
ic AS (SELECT avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std FROM (SELECT corr(factor, fwd_1) AS ic FROM pv GROUP BY ts HAVING count(*) >= 3)),
sp AS (SELECT avg(ic) AS ic_spearman_mean FROM (SELECT corr(rf, rr) AS ic FROM pr GROUP BY ts HAVING count(*) >= 3)),
result AS (SELECT *, ic_mean / (ic_std + 1e-8) AS ic_ir, mean_return / (std_return + 1e-8) AS sharpe FROM ic, sp,
  (SELECT avg(fwd_1) AS mean_return, stddev_samp(fwd_1) AS std_return FROM fr), (SELECT avg(turnover) AS mean_turnover FROM tu))""")
def h05(spark, d):
    return H.tearsheet(panel(spark, d), "factor", "fwd_1")


@query("h06_factor_autocorrelation", "lag# autocorr:6", PANEL + f""", p AS (SELECT * FROM panel WHERE factor IS NOT NULL),
l AS (""" + " UNION ALL ".join(f"SELECT symbol, {i} AS lag, factor, lag(factor, {i}) OVER ({W}) AS b FROM p" for i in range(1, 6)) + """),
result AS (SELECT lag, avg(c) AS autocorr FROM (SELECT symbol, lag, corr(factor, b) AS c FROM l WHERE b IS NOT NULL GROUP BY symbol, lag) GROUP BY lag)""")
def h06(spark, d):
    return H.autocorrelation(panel(spark, d), "factor")


@query("h07_rank_autocorrelation", "rank_autocorr:6", PANEL + f", {PAIRS}, r AS (" + rank_cols("dq", "ts", ("now", "a"), ("before", "b")) + """),
result AS (SELECT avg(c) AS rank_autocorr FROM (SELECT corr(a, b) AS c FROM r GROUP BY ts))""")
def h07(spark, d):
    return H.rank_autocorrelation(panel(spark, d), "factor")


@query("h08_quantile_returns", "bin# mean_return:6 std_return:6 n#", PANEL + f""",
pq AS (SELECT * FROM panel WHERE factor IS NOT NULL AND fwd_1 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY ts) > 5), {qcut_sql('pq', 'ts', 'factor', 5, 'bin', 'b')},
m AS (SELECT ts, bin, avg(fwd_1) AS m, count(*) AS c FROM b GROUP BY ts, bin),
result AS (SELECT bin, avg(m) AS mean_return, stddev_samp(m) AS std_return, CAST(sum(c) AS BIGINT) AS n FROM m GROUP BY bin)""")
def h08(spark, d):
    return H.quantile_returns(panel(spark, d), "factor", "fwd_1")


@query("h09_signal_quality", "symbol n# ic:6 ir:5 t_stat:5", PANEL + ", pv AS (SELECT * FROM panel WHERE factor IS NOT NULL AND fwd_1 IS NOT NULL), r AS ("
       + rank_cols("pv", "symbol", ("factor", "rf"), ("fwd_1", "rr")) + """), g AS (SELECT symbol, count(*) AS n, corr(rf, rr) AS ic FROM r GROUP BY symbol),
result AS (SELECT *, ic * sqrt(n) AS ir, ic * sqrt(n - 2) / sqrt(1 - ic * ic) AS t_stat FROM g)""")
def h09(spark, d):
    return H.signal_quality(panel(spark, d), "factor", "fwd_1", ["symbol"])


@query("h10_decay_half_life", "symbol half_life#", PANEL + f""",
e AS (""" + " UNION ALL ".join(f"SELECT symbol, {i} AS lag, ts, factor, lead(ret, {i}) OVER ({W}) AS y FROM panel" for i in range(1, 21)) + """),
ev AS (SELECT * FROM e WHERE factor IS NOT NULL AND y IS NOT NULL), r AS (""" + rank_cols("ev", "symbol, lag", ("factor", "rf"), ("y", "ry")) + """),
g AS (SELECT symbol, lag, abs(corr(rf, ry)) AS ic FROM r GROUP BY symbol, lag),
result AS (SELECT g.symbol, min(CASE WHEN g.ic <= f.ic / 2 THEN g.lag END) AS half_life FROM g JOIN g f ON g.symbol = f.symbol AND f.lag = 1 GROUP BY g.symbol)""")
def h10(spark, d):
    return H.decay_half_life(panel(spark, d), "factor", "ret")


@query("h11_signal_backtest", "bin# mean_return:6 std_return:6 sharpe:6 n# top_only:6 long_short:6", PANEL + f""",
pv AS (SELECT * FROM panel WHERE factor IS NOT NULL AND fwd_1 IS NOT NULL), {qcut_sql('pv', '', 'factor', 5, 'bin', 'b')},
g AS (SELECT bin, avg(fwd_1) AS mean_return, stddev_samp(fwd_1) AS std_return, count(*) AS n FROM b GROUP BY bin),
result AS (SELECT *, mean_return / std_return * sqrt(252) AS sharpe, (SELECT mean_return FROM g WHERE bin = 5) AS top_only,
  (SELECT mean_return FROM g WHERE bin = 5) - (SELECT mean_return FROM g WHERE bin = 1) AS long_short FROM g)""")
def h11(spark, d):
    return H.signal_backtest(panel(spark, d), "factor", "fwd_1")
