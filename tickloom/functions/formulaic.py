"""Formula operators as Column functions.

Time-series operators take an already sliced frame's window ``w`` (by symbol in time order) and look
back a bounded number of rows; cross-section operators are frame functions in ``operators.formulas``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _frame(w, n: int):
    return w.rowsBetween(-(n - 1), 0)


def delay(x, n: int, w) -> Column:
    return F.lag(_c(x), n).over(w)


def delta(x, n: int, w) -> Column:
    return _c(x) - F.lag(_c(x), n).over(w)


def ts_mean(x, n: int, w) -> Column:
    return F.avg(_c(x)).over(_frame(w, n))


def ts_std(x, n: int, w) -> Column:
    return F.stddev_samp(_c(x)).over(_frame(w, n))


def ts_max(x, n: int, w) -> Column:
    return F.max(_c(x)).over(_frame(w, n))


def ts_min(x, n: int, w) -> Column:
    return F.min(_c(x)).over(_frame(w, n))


def ts_sum(x, n: int, w) -> Column:
    return F.sum(_c(x)).over(_frame(w, n))


def ts_rank(x, n: int, w) -> Column:
    """Average rank of the last value in its window scaled to 0..1; 0.5 for a window of one."""
    x = _c(x)
    win = F.collect_list(x).over(_frame(w, n))
    less = F.size(F.filter(win, lambda v: v < x))
    same = F.size(F.filter(win, lambda v: v == x))
    rank = (less + (same + 1) / 2 - 1) / (F.size(win) - 1)
    return F.when(x.isNull(), None).when(F.size(win) > 1, rank).otherwise(0.5)


def correlation(x, y, n: int, w) -> Column:
    f = _frame(w, n)
    return F.when(F.count(_c(x) + _c(y)).over(f) >= 2, F.nanvl(F.corr(_c(x), _c(y)).over(f), F.lit(None)))


def covariance(x, y, n: int, w) -> Column:
    return F.covar_samp(_c(x), _c(y)).over(_frame(w, n))


def log(x) -> Column:
    return F.log(_c(x) + EPS)


def absolute(x) -> Column:
    return F.abs(_c(x))


def sign(x) -> Column:
    return F.signum(_c(x))


def power(x, p: float) -> Column:
    return F.pow(_c(x), F.lit(float(p)))


def divide(x, y) -> Column:
    below = _c(y) + EPS
    return F.when(below != 0, _c(x) / below)


def less(x, y) -> Column:
    return F.when(_c(x) < _c(y), 1.0).otherwise(0.0)


def greater(x, y) -> Column:
    return F.when(_c(x) > _c(y), 1.0).otherwise(0.0)


def less_equal(x, y) -> Column:
    return F.when(_c(x) <= _c(y), 1.0).otherwise(0.0)
