"""What each operator takes and gives.

A grammar symbol names a kind of value: ``daily`` (a value per date and code), ``minute`` (a value per bar), ``source`` (a
minute value, or one with bars masked out). An operator gives one symbol from arguments of given symbols, and may take a
window. New operators are rows of this table and a kernel in ``operators.kernels``.
"""

from __future__ import annotations

from dataclasses import dataclass

WINDOWS = (5, 10, 20, 40, 60)


@dataclass(frozen=True)
class Op:
    name: str
    gives: str
    takes: tuple[str, ...]
    windowed: bool = False


def _ops(names: str, gives: str, *takes: str, windowed: bool = False) -> dict[str, Op]:
    return {n: Op(n, gives, takes, windowed) for n in names.split()}


#: Fixed names: the vocabulary of expressions.
DAILY_FEATURES = tuple("open high low close volume vwap".split())
MINUTE_FEATURES = tuple("open high low close vol amount ret vwap hl_pct bar_pos amihud rv signed_vol signed_amt typical vwap_cum twap obv pvt logret oc_ret".split())
UNARY = _ops("log abs neg sqrt tanh", "daily", "daily")
BINARY = _ops("add sub mul div", "daily", "daily", "daily")
TIME_SERIES = _ops("ts_delay ts_delta ts_mean ts_std ts_sum ts_max ts_min ts_rank ts_zscore", "daily", "daily", windowed=True)
CROSS_SECTION = _ops("cs_rank cs_demean cs_zscore", "daily", "daily")
MINUTE = (
    _ops("m_ret m_logret m_rank m_zscore m_abs m_sign m_log", "minute", "minute")
    | _ops("m_delay m_delta m_ma m_std", "minute", "minute", windowed=True)
    | _ops("m_add m_sub m_mul m_div", "minute", "minute", "minute")
)
MASKS = (
    _ops("m_head m_tail m_mid m_top m_bot m_xtreme", "source", "minute", windowed=True)
    | _ops("m_above m_below m_inner m_outer", "source", "minute")
    | _ops("m_at_top m_at_bot", "source", "minute", "minute", windowed=True)
    | _ops("m_when_pos m_when_gt", "source", "minute", "minute")
)
REDUCERS = _ops("r_mean r_std r_sum r_max r_min r_median r_first r_last r_skew r_kurt r_slope r_rsquare r_argmax", "daily", "source") | _ops("r_corr r_cov r_wmean", "daily", "minute", "minute")

#: How often a generator draws each group of the daily layer, and how often it ends a position there.
DRAWS = {"daily": ((UNARY, 2), (BINARY, 3), (TIME_SERIES, 4), (CROSS_SECTION, 2)), "minute": ((UNARY, 2), (BINARY, 2), (TIME_SERIES, 4), (CROSS_SECTION, 2))}
LEAVES = {"daily": 0.28, "minute": 0.42}

DAILY_OPS = UNARY | BINARY | TIME_SERIES | CROSS_SECTION
INTRADAY_OPS = MINUTE | MASKS | REDUCERS
