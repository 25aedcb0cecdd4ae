"""Evaluation queries over six factors of the monthly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.checks.expressions import BATCH, Script
from panelyard.evaluation import metrics as M
from panelyard.functions.scalar import rounded
from panelyard.index.research import yearly_audit
from panelyard.plans.compile import daily_factors
from panelyard.plans.nodes import parse
from panelyard.sources import panels

FACTORS = list(BATCH)


def wide(spark, sf):
    """Factors, target and risk facts from one pass over the panel."""
    panel = panels.with_risk(M.forward_return(panels.bars(spark, sf)), spark, sf)
    return daily_factors(panel, BATCH, ("target", "industry", "market_cap"))


def long(spark, sf):
    return M.long_form(wide(spark, sf), FACTORS)


def tidy(frame):
    """Doubles rounded for comparison, counts as long."""
    kinds = dict(frame.dtypes)
    return frame.select(*[rounded(F.col(c)).alias(c) if k == "double" else F.col(c).cast("long").alias(c) if k in ("int", "bigint") else F.col(c) for c, k in kinds.items()])


def _long_sql() -> str:
    script = Script(panels.bars_sql(), "bars")
    columns = {k: script.node(parse(v)) for k, v in BATCH.items()}
    wide_ = script.select("*").replace(f"select * from {script.at}", f", wide as (select *, lead(close, 5) over (partition by code order by date) / lead(close, 1) over (partition by code order by date) - 1 as target from {script.at})")
    parts = " union all ".join(f"select '{k}' as factor, date, code, {c} as value, target from wide" for k, c in columns.items())
    return f"{wide_.rstrip().removesuffix(',')}, long as (select l.*, cast(s_nationkey % 5 as varchar) as industry, s_acctbal as market_cap from ({parts}) l left join supplier on s_suppkey = code)"


LONG = _long_sql()
FD = "partition by factor, date"


def rank_sql(x: str, part: str) -> str:
    return f"case when {x} is not null then (rank() over ({part} order by {x} asc nulls last) + count({x}) over ({part}) + 1 - rank() over ({part} order by {x} desc nulls last)) / 2.0 end"


def corr_sql(x: str, y: str) -> str:
    w = f"filter (where {x} is not null and {y} is not null)"
    s = lambda e: f"sum({e}) {w}"
    n = f"count(*) {w}"
    below = f"sqrt(greatest({n} * {s(f'{x}*{x}')} - {s(x)} * {s(x)}, 0) * greatest({n} * {s(f'{y}*{y}')} - {s(y)} * {s(y)}, 0))"
    return f"case when {below} > 1e-12 then ({n} * {s(f'{x}*{y}')} - {s(x)} * {s(y)}) / {below} end"


def r(c: str, name: str | None = None) -> str:
    return f"round(({c})::double + 3.1e-8::double, 6) + 0.0::double as {name or c}"


def ir(c: str) -> str:
    return f"case when count({c}) > 1 and stddev_samp({c}) > 0 then avg({c}) / stddev_samp({c}) * sqrt(252.0 / 4) else 0 end"


IC = f"""ic as (select factor, date, count(*) n, {corr_sql('value', 'target')} ic, {corr_sql('rv', 'rt')} rank_ic from (
  select *, {rank_sql('value', FD)} rv, {rank_sql('target', FD)} rt from long where value is not null and target is not null) group by factor, date having count(*) >= 20)"""

REWARD_SQL = f"""{LONG},
e as (select * from (select *, count(*) over ({FD}) n_all, count(value) over ({FD}) n from long where target is not null) where n_all >= 20),
cov as (select factor, count(value) / count(*) coverage, count(distinct case when n >= 20 then date end) / count(distinct date) date_coverage from e group by factor),
v as (select *, greatest(market_cap, 0) size, case when market_cap is not null then value end value_s, case when industry is not null then value end value_i,
  quantile_cont(value, 0.9) over ({FD}) cut, {rank_sql('value', FD)} rv, {rank_sql('target', FD)} rt from e where value is not null and n >= 20),
k as (select *, {rank_sql('size', FD)} rs, {rank_sql('value_s', FD)} rvs, avg(value_i) over ({FD}) md, avg(value_i) over (partition by factor, date, industry) mi from v),
d as (select factor, date, {corr_sql('rv', 'rt')} ic, avg(target) filter (where value >= cut) - avg(target) excess, case when count(size) >= 5 then abs({corr_sql('rvs', 'rs')}) end size_ic,
  case when count(value_i) >= 8 and count(distinct industry) >= 2 and sum(pow(value_i - md, 2)) > 1e-12 then greatest(0, least(1, 1 - sum(pow(value_i - mi, 2)) / sum(pow(value_i - md, 2)))) end r2 from k group by factor, date),
o as (select factor, coalesce(avg(ic), 0) rank_ic, {ir('excess')} long_ir, coalesce(avg(excess) * 63, 0) annualized, coalesce(avg(r2), 0) industry_exposure, coalesce(avg(size_ic), 0) size_exposure from d group by factor),
p as (select *, least(1, pow(least(coverage, date_coverage) / 0.8, 2)) penalty from (select factor, coverage, date_coverage, coalesce(rank_ic, 0) rank_ic, coalesce(long_ir, 0) long_ir, coalesce(annualized, 0) annualized,
  coalesce(industry_exposure, 0) industry_exposure, coalesce(size_exposure, 0) size_exposure from cov left join o using (factor)))
select factor, {r('coverage')}, {r('date_coverage')}, {r('rank_ic')}, {r('long_ir')}, {r('annualized')}, {r('industry_exposure')}, {r('size_exposure')}, {r('penalty')},
  {r('greatest(1e-8, abs(rank_ic) * greatest(0.05, 1 + least(greatest(long_ir, -0.95), 5)) * exp(-0.5 * (industry_exposure + size_exposure)) * penalty)', 'reward')} from p"""

STABLE = f"""dates as (select date, row_number() over (order by date) pos_ from (select distinct date from long)),
ranked as (select factor, long.date, code, pos_, {rank_sql('value', FD)} / count(value) over ({FD}) rk from long join dates using (date)),
pairs as (select factor, date, rk, case when lag(pos_) over w = pos_ - 1 then lag(rk) over w end old from ranked window w as (partition by factor, code order by date)),
st as (select factor, coalesce(avg(c), 0) rank_stability, coalesce(avg(ch), 1) rank_turnover from (select factor, date, {corr_sql('rk', 'old')} c, avg(abs(rk - old)) ch from pairs where rk is not null and old is not null group by factor, date having count(*) >= 3) group by factor)"""

SUMMARY_SQL = f"""{LONG}, {IC}, {STABLE},
roll as (select *, case when count(rank_ic) over w >= 10 then avg(rank_ic) over w end roll, (sign(rank_ic) = sign(avg(rank_ic) over (partition by factor)))::int same from ic where rank_ic is not null
  window w as (partition by factor order by date rows between 59 preceding and current row)),
rk as (select factor, avg(rank_ic) ric, {ir('rank_ic')} icir, coalesce(avg(roll), avg(rank_ic)) rm, case when count(roll) > 1 then stddev_samp(roll) else 0 end rs, avg(same) same from roll group by factor),
ex as (select factor, date, avg(target) filter (where value >= cut) - avg(target) excess from (select *, quantile_cont(value, 0.9) over ({FD}) cut from long where value is not null and target is not null) group by factor, date),
sh as (select factor, {ir('excess')} sharpe from ex group by factor), pl as (select factor, coalesce(avg(ic), 0) ic from ic group by factor)
select factor, {r('sharpe', 'Sharpe')}, {r('coalesce(ic, 0)', 'IC')}, {r('coalesce(ric, 0)', 'RankIC')}, {r('coalesce(icir, 0)', 'ICIR')}, {r('coalesce(rm, 0)', 'rolling_ic_mean')}, {r('coalesce(rs, 0)', 'rolling_ic_std')}, {r('coalesce(rank_stability, 0)', 'rank_stability')}, {r('coalesce(rank_turnover, 0)', 'rank_turnover')}, {r('coalesce(same, 0) / (1 + coalesce(rs, 0))', 'temporal_stability')}
from sh left join pl using (factor) left join rk using (factor) left join st using (factor)"""

BUCKET = f"case when count(value) over ({FD}) >= 5 then greatest(1, ceil((row_number() over ({FD} order by value, code) - 1) * 5 / nullif(count(value) over ({FD}) - 1, 0))) end"
QUANTILE_SQL = f"""{LONG}, b as (select *, {BUCKET} bucket from long where value is not null and target is not null),
d as (select factor, date, bucket, avg(target) m, count(*) n, sum((target > 0)::int) up from b where bucket is not null group by all)
select factor, year(date)::bigint as year, bucket::bigint as bucket, sum(n)::bigint as n, {r('avg(m)', 'mean_target')}, {r('sum(up) / sum(n)', 'positive')} from d group by factor, year(date), bucket"""

_AUTO = lambda k: f"(select factor, avg(c) a{k} from (select x.factor, x.pos_, {corr_sql('x.rk', 'y.rk')} c from rr x join rr y on x.factor = y.factor and x.code = y.code and x.pos_ = y.pos_ + {k} group by x.factor, x.pos_) group by factor)"
QUALITY_SQL = f"""{LONG}, rows_ as (select * from long where value is not null),
f as (select *, row_number() over ({FD} order by value desc, code) pos_ from rows_),
t as (select factor, count(target) / count(*) label_coverage, avg(target) filter (where pos_ <= 10) top_mean, avg((target > 0)::int) filter (where pos_ <= 10 and target is not null) top_positive from f group by factor),
b as (select factor, bucket, avg(target) m from (select *, {BUCKET} bucket from rows_ where target is not null) where bucket is not null group by factor, bucket),
s as (select factor, max(case when bucket = 5 then m end) - max(case when bucket = 1 then m end) high_low, {corr_sql('bucket', 'rk')} monotonicity from (select *, {rank_sql('m', 'partition by factor')} rk from b) group by factor),
dd as (select date, row_number() over (order by date) pos_ from (select distinct date from rows_)),
rr as (select factor, code, pos_, {rank_sql('value', FD)} / count(value) over ({FD}) rk from rows_ join dd using (date))
select factor, {r('label_coverage')}, {r('top_mean')}, {r('top_positive')}, {r('high_low')}, {r('monotonicity')}, {r('a1', 'autocorr_1')}, {r('a5', 'autocorr_5')}, {r('a20', 'autocorr_20')}
from t left join s using (factor) left join {_AUTO(1)} using (factor) left join {_AUTO(5)} using (factor) left join {_AUTO(20)} using (factor)"""
DAYS_SQL = f"""{LONG}, rows_ as (select *, row_number() over ({FD} order by value desc, code) pos_, case when target is not null then value end v, {rank_sql('target', FD)} rt from long where value is not null),
k as (select *, {rank_sql('v', FD)} rv, case when v is not null and count(v) over ({FD}) >= 5 then greatest(1, ceil((row_number() over ({FD} order by v nulls last, code) - 1) * 5 / nullif(count(v) over ({FD}) - 1, 0))) end bucket from rows_),
a as (select factor, date, count(*) predictions, count(target) labels, {corr_sql('rv', 'rt')} rank_ic, avg(target) filter (where pos_ <= 10) top_mean from k group by factor, date),
b as (select *, {rank_sql('m', FD)} rk from (select factor, date, bucket, avg(target) m from k where bucket is not null group by factor, date, bucket)),
c as (select factor, date, max(case when bucket = 5 then m end) - max(case when bucket = 1 then m end) high_low, {corr_sql('bucket', 'rk')} monotonicity from b group by factor, date),
dq as (select * from a left join c using (factor, date))"""

_RK = "rk as (select factor, date, code, " + rank_sql("value", FD) + f" / count(value) over ({FD}) k from long)"
CORR_SQL = f"{LONG}, {_RK} select x.factor a, y.factor b, {r('coalesce(' + corr_sql('x.k', 'y.k') + ', 0)', 'corr')} from rk x join rk y on x.date = y.date and x.code = y.code and x.factor < y.factor group by x.factor, y.factor"


def audit_sql() -> str:
    active = " + ".join(f"coalesce(stddev_pop(case when factor = '{f}' then value end) > 1e-12, false)::int" for f in FACTORS)
    return f"""{LONG}, w as (select date, count(distinct code) n, count(value) f, count(target) // {len(FACTORS)} labels, max(target) > min(target) moves, {active} active from long group by date),
y as (select year(date) "year", sum(n)::bigint "rows", count(*) dates, sum(f) / (sum(n) * {len(FACTORS)}) fr, min(active)::bigint active_min, median(active) am, count(*) filter (where active = 0) dates_without_factor, count(*) filter (where labels > 0) label_dates,
  count(*) filter (where moves) varying_target_dates, count(*) filter (where labels >= 2 and not moves) constant_target_dates, max(date) filter (where labels > 0) last_label_date from w group by 1)
select "year", "rows", dates, {r('fr', 'finite_ratio')}, active_min, {r('am', 'active_median')}, dates_without_factor, label_dates, varying_target_dates, constant_target_dates, last_label_date, (select count(distinct code) from long where year(date) = y."year") as codes from y"""


def all_checks() -> dict:
    sizes = {k: (parse(v).complexity(), parse(v).depth()) for k, v in BATCH.items()}
    return {
        "eval_forward_return": (lambda s, sf: tidy(M.forward_return(panels.bars(s, sf, True)).select("date", "code", "target")), f"with {panels.bars_sql(True)} select date, code, {r('lead(close, 5) over w / lead(close, 1) over w - 1', 'target')} from bars window w as (partition by code order by date)"),
        "eval_daily_ic": (lambda s, sf: tidy(M.daily_ic(long(s, sf))), f"{LONG}, {IC} select factor, date, {r('ic')}, {r('rank_ic')} from ic"),
        "eval_reward": (lambda s, sf: tidy(M.reward(long(s, sf))), REWARD_SQL),
        "eval_summary": (lambda s, sf: tidy(M.summary(M.once(long(s, sf)))), SUMMARY_SQL),
        "eval_quantile_returns": (lambda s, sf: tidy(M.quantile_returns(long(s, sf))), QUANTILE_SQL),
        "eval_prediction_quality": (lambda s, sf: tidy(M.prediction_quality(M.once(long(s, sf)))), QUALITY_SQL),
        "eval_daily_quality": (lambda s, sf: tidy(M.daily_quality(M.once(long(s, sf)))), f"{DAYS_SQL} select factor, date, predictions, labels, {r('rank_ic')}, {r('top_mean')}, {r('high_low')}, {r('monotonicity')} from dq"),
        "eval_annual_quality": (lambda s, sf: tidy(M.annual_quality(M.daily_quality(M.once(long(s, sf))))), f"""{DAYS_SQL} select factor, year(date)::bigint as year, count(*) as dates, count(rank_ic) as ic_dates, {r('avg(rank_ic)', 'ic_mean')}, {r('stddev_samp(rank_ic)', 'ic_std')}, {r('case when stddev_samp(rank_ic) > 0 then avg(rank_ic) / stddev_samp(rank_ic) * sqrt(252) end', 'ic_ir')},
          {r('avg((rank_ic > 0)::int)', 'ic_positive')}, {r('avg(high_low)', 'high_low')}, {r('avg((high_low > 0)::int)', 'high_low_positive')}, {r('avg(monotonicity)', 'monotonicity')}, {r('avg(top_mean)', 'top_mean')}, {r('sum(labels) / sum(predictions)', 'label_coverage')} from dq group by factor, year(date)"""),
        "eval_yearly_audit": (lambda s, sf: tidy(yearly_audit(wide(s, sf), FACTORS)), audit_sql()),
        "eval_factor_correlation": (lambda s, sf: tidy(M.rank_correlation(wide(s, sf), FACTORS)), CORR_SQL),
        "eval_robustness": (lambda s, sf: M.robustness(long(s, sf)), None),
        "eval_scores": (lambda s, sf: M.scores(wide(s, sf), sizes), None),
    }
