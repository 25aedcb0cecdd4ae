"""Search, fusion and streams: iterative work, checked by rows here and by tests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelyard.checks.evaluation import FACTORS, FD, LONG, r, tidy, wide
from panelyard.checks.expressions import Script
from panelyard.evaluation import metrics as M
from panelyard.plans.nodes import DAILY, MINUTE, State, random_tree
from panelyard.search import fusion, policy
from panelyard.session import shared_path
from panelyard.sources import panels
from panelyard.streaming.bars import stream_bars


POOL = {f"factor_{i:03d}": random_tree(i) for i in range(8)}


def _scorer(s, sf):
    panel = panels.with_risk(M.forward_return(panels.bars(s, sf)), s, sf)
    return panel, policy.batch_rewards(panel)


def search(s, sf):
    """An epoch, then the pool that the policy gives."""
    _, score = _scorer(s, sf)
    p = policy.Policy()
    policy.train(p, score, epochs=1, batch=6)
    rows = policy.pool(p, score, 3)
    return s.createDataFrame([(r["factor"], r["expression"], r["tokens"], r["complexity"], r["depth"], float(r["reward"])) for r in rows], "factor string, expression string, tokens string, complexity long, depth long, reward double")


def pool_matrix(s, sf, start=None, end=None):
    rows = [{"factor": k, "tokens": t.to_json()} for k, t in POOL.items()]
    return tidy(policy.execute_pool(panels.bars(s, sf), rows, start=start, end=end))


def pool_sql() -> str:
    script = Script(panels.bars_sql(), "bars")
    columns = {k: script.node(t) for k, t in POOL.items()}
    return script.select("date, code, " + ", ".join(r(c, k) for k, c in columns.items()))


def inputs_sql() -> str:
    z = {f: f"max(case when factor = '{f}' then coalesce(case when s > 1e-12 then (value - m) / s end, 0) end)" for f in FACTORS}
    return f"""{LONG}, k as (select *, avg(value) over ({FD}) m, stddev_samp(value) over ({FD}) s, quantile_cont(target, 0.9) over ({FD}) cut,
  case when target is not null and count(target) over ({FD}) >= 5 then greatest(1, ceil((row_number() over ({FD} order by target nulls last, code) - 1) * 5 / nullif(count(target) over ({FD}) - 1, 0))) - 1 end rel from long)
select date, code, {r('any_value(target)', 'target')}, {', '.join(r(f'coalesce({e}, 0)', f) for f, e in z.items())}, {r('case when any_value(target) >= any_value(cut) then 3.0 else 1.0 end', 'sample_weight')}, any_value(rel)::bigint as relevance from k group by date, code"""


def grammar(s, sf):
    """How many tokens may follow each of the first choices."""
    rows = [(lang.name, len(lang.tokens), a, len(State(lang).step(a).actions())) for lang in (DAILY, MINUTE) for a in State(lang).actions()]
    return s.createDataFrame(rows, "language string, tokens long, first string, next long")


def fused(kind: str):
    return lambda s, sf: fusion.walk_forward(wide(s, sf), FACTORS, 40, 5, 30, kind)


def fused_quality(s, sf):
    matrix = wide(s, sf)
    return tidy(fusion.quality(fusion.walk_forward(matrix, FACTORS, 40, 5, 30, "linear"), matrix))


def fusion_inputs(s, sf):
    return tidy(fusion.prepared(wide(s, sf), FACTORS))


def streamed(s, sf):
    """The stream of ticks, run until it has read everything, into a table in memory."""
    path = shared_path(s, "ticks")
    panels.ticks(s, sf).write.parquet(path)
    source = s.readStream.schema(s.read.parquet(path).schema).parquet(path)
    name = f"bars_{uuid.uuid4().hex}"
    run = stream_bars(source).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", shared_path(s, "stream")).trigger(availableNow=True).start()
    run.awaitTermination()
    return tidy(s.table(name).withColumn("start", F.date_format("start", "yyyy-MM-dd")))


STREAM_SQL = f"""with {panels.ticks_sql()} select strftime(date, '%Y-%m-%d') as start, code, round(arg_min(open, row(datetime, seq)) + 3.1e-8::double, 6) + 0.0::double as open, round(max(high) + 3.1e-8::double, 6) + 0.0::double as high, round(min(low) + 3.1e-8::double, 6) + 0.0::double as low,
  round(arg_max(close, row(datetime, seq)) + 3.1e-8::double, 6) + 0.0::double as close, round(sum(vol) + 3.1e-8::double, 6) + 0.0::double as volume, round(sum(amount) + 3.1e-8::double, 6) + 0.0::double as amount, count(*) as bars from ticks group by date, code"""


#: A day comes out once the watermark, ten minutes behind the last tick, has passed its end.
APPEND_SQL = STREAM_SQL.replace(" from ticks group by", " from ticks where date + interval 1 day <= (select max(datetime) - interval 10 minute from ticks) group by")


def all_checks() -> dict:
    return {
        "search_grammar": (grammar, None), "search_pool": (search, None), "search_pool_matrix": (pool_matrix, pool_sql()), "fusion_inputs": (fusion_inputs, inputs_sql()),
        "fusion_trees": (fused("trees"), None), "fusion_linear": (fused("linear"), None), "fusion_huber": (fused("huber"), None), "fusion_listwise": (fused("listwise"), None), "fusion_quality": (fused_quality, None),
        "search_pool_slice": (lambda s, sf: pool_matrix(s, sf, "1996-01-01", "1996-12-31"), f"select * from ({pool_sql()}) where date between date '1996-01-01' and date '1996-12-31'"),
        "stream_daily_bars": (lambda s, sf: tidy(stream_bars(panels.ticks(s, sf)).withColumn("start", F.date_format("start", "yyyy-MM-dd"))), STREAM_SQL), "stream_append": (streamed, APPEND_SQL),
    }
