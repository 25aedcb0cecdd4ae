"""Ranks to portfolios: smoothing over signal dates, targets with a turnover cap, weights against a benchmark.

Smoothing is one window per code. Targets depend on those of the date before, so dates run in turn over a bounded list of names each. The weights of a
date are a separable convex problem with one coupling constraint, solved exactly through its multiplier; dates are solved in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.scalar import pct_rank, security_id


def smoothed_ranks(ranked: DataFrame, weights: Sequence[float]) -> DataFrame:
    """date, code, score, smoothed, order: percentile ranks (ties averaged) of the last signal dates, averaged by ``weights`` (of this date, the one
    before, ...) over the dates that hold the code; order goes by smoothed, score, code."""
    total = float(sum(weights))
    if not weights or min(weights) < 0 or total <= 0:
        raise ValueError("weights must not be negative, and not all be zero")
    day, own = Window.partitionBy("date"), Window.partitionBy("code").orderBy("at")
    dates = ranked.select("date").distinct().withColumn("at", F.row_number().over(Window.orderBy("date")))  # a row per signal date
    base = ranked.withColumn("own", pct_rank(F.col("score"), day)).join(dates, "date").select("date", "code", "score", "own", "at")
    past = [F.col("own")]
    for lag in range(1, len(weights)):
        # The date ``lag`` signals ago is at most ``lag`` rows back: dates without the code have no row.
        past.append(F.coalesce(*[F.when(F.lag("at", j).over(own) == F.col("at") - lag, F.lag("own", j).over(own)) for j in range(1, lag + 1)]))
    shares = [F.lit(w / total) for w in weights]
    zero = F.lit(0.0)
    top = sum((F.coalesce(p * w, zero) for p, w in zip(past, shares)), zero)
    bottom = sum((F.when(p.isNotNull(), w).otherwise(zero) for p, w in zip(past, shares)), zero)
    out = base.withColumn("smoothed", F.when(bottom > 0, top / bottom)).select("date", "code", "score", "smoothed")
    return out.withColumn("order", F.row_number().over(day.orderBy(F.desc("smoothed"), F.desc("score"), "code")))


def controlled_targets(ranked: Sequence, held: Sequence, days: dict, top_n: int, buffer_rank: int, max_replaced: float, min_days: int, place: dict | None = None) -> list:
    """Names for the next period. Held names queue by (too young to sell, within ``buffer_rank``, other) and rank; so many of the front stay as are of the
    first two kinds, or as the cap on replacements asks for; the best ranked of all others follow. ``place``: ranks by name, where ``ranked`` leaves names out."""
    place = place or {c: i for i, c in enumerate(dict.fromkeys(ranked), 1)}

    def queue(c) -> tuple:
        at = place.get(c, math.inf)
        return (0 if days.get(c, 0) < min_days else 1 if at <= buffer_rank else 2), at

    line = sorted(dict.fromkeys(held), key=queue)
    replaced = min(top_n, max(1, int(top_n * max_replaced)))
    stays = max(sum(queue(c)[0] < 2 for c in line), min(len(line), top_n) - replaced)
    kept = line[: max(0, min(top_n, stays))]
    return [*kept, *[c for c in dict.fromkeys(ranked) if c not in set(kept)][: max(0, top_n - len(kept))]]


def portfolio_path(ranked: DataFrame, top_n: int, buffer_rank: int, max_replaced: float, min_days: int) -> DataFrame:
    """date, code, order: targets of each date in turn. State passes from date to date, so dates run on the driver, which gets, with
    their ranks in the whole cross-section, all names that can matter: a name enters only from the first ``top_n``, so these and
    the names that were among them on an earlier date."""
    whole = ranked.where("order is not null").groupBy("date", "code").agg(F.min("order").alias("order"))
    placed = whole.withColumn("place", F.row_number().over(Window.partitionBy("date").orderBy("order", "code")))
    since = F.min(F.when(F.col("place") <= top_n, F.col("date"))).over(Window.partitionBy("code"))
    rows = placed.withColumn("since", since).where((F.col("place") <= top_n) | (F.col("since") < F.col("date")))
    rows = rows.groupBy("date").agg(F.sort_array(F.collect_list(F.struct("place", "code"))).alias("names")).orderBy("date")
    held, days, out = [], {}, []
    for r in rows.toLocalIterator():
        held = controlled_targets([x.code for x in r.names], held, days, top_n, buffer_rank, max_replaced, min_days, {x.code: x.place for x in r.names})
        days = {c: days.get(c, 0) + 1 for c in held}
        out += [(r.date, c, i + 1) for i, c in enumerate(held)]
    kind = ranked.schema["code"].dataType.simpleString()
    return ranked.sparkSession.createDataFrame(out, f"date date, code {kind}, order int")


def weight_history(rows: DataFrame, index_key: str, start=None, end=None) -> DataFrame:
    """date, code, benchmark_weight of one index from long rows (date, index_key, code, benchmark_weight), summing to 1 on each date.

    Reading fails on repeated codes, negative weights and dates whose weights sum to 0; rows without a weight are left out.
    """
    number = F.col("benchmark_weight").try_cast("double")
    own = rows.where(F.col("index_key").cast("string") == str(index_key)).select(F.col("date").try_cast("date").alias("date"), security_id(F.col("code")).alias("code"), number.alias("w"))
    own = own.where(F.col("w").isNotNull() & ~F.isnan("w") & F.col("date").isNotNull())
    for bound, inside in ((start, lambda b: F.col("date") >= b), (end, lambda b: F.col("date") <= b)):
        if bound is not None:
            own = own.where(inside(F.lit(bound).cast("date")))
    day = Window.partitionBy("date")
    seen = own.withColumns({"n": F.count(F.lit(1)).over(Window.partitionBy("date", "code")), "least": F.min("w").over(day), "sum": F.sum("w").over(day)})
    fault = F.when(F.col("n") > 1, "repeated weights").when(F.col("least") < 0, "negative weights").when(F.col("sum") <= 0, "weights that sum to zero")
    checked = F.when(fault.isNull(), F.col("w") / F.col("sum")).otherwise(F.raise_error(F.concat(fault, F.lit(" on "), F.col("date").cast("string"))))
    return seen.select("date", "code", checked.alias("benchmark_weight"))


@dataclass(frozen=True)
class Settings:
    """What the optimiser assumes unless told otherwise."""

    max_names: int = 200
    alpha_top_n: int = 100
    invested: float = 0.98
    alpha_strength: float = 0.05
    risk_aversion: float = 1.0
    turnover_penalty: float = 0.01
    max_active: float = 0.01
    max_weight: float = 0.10
    max_turnover: float = 0.20
    buy_cost: float = 0.0018
    sell_cost: float = 0.0023
    risk_floor: float = 0.001


def _at_sum(at, knots: np.ndarray, total: float) -> np.ndarray:
    """``at(m)`` for the m where its sum is ``total``: the sum falls with m and is linear between neighbouring ``knots``."""
    knots = np.unique(knots)
    low, high = 0, len(knots) - 1
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if at(knots[mid]).sum() >= total else (low, mid)
    above, below = at(knots[low]).sum(), at(knots[high]).sum()
    part = 0.0 if above == below else np.clip((above - total) / (above - below), 0.0, 1.0)
    return at(knots[low] + part * (knots[high] - knots[low]))


def nearest_within(x: np.ndarray, low: np.ndarray, high: np.ndarray, total: float) -> np.ndarray:
    """The nearest point to x with low <= w <= high and sum ``total``."""
    if low.sum() > total + 1e-10 or high.sum() < total - 1e-10:
        raise ValueError("no weights within the bounds have this sum")
    return _at_sum(lambda m: np.clip(x - m, low, high), np.concatenate([x - high, x - low]), total)


def best_weights(alpha: np.ndarray, benchmark: np.ndarray, current: np.ndarray, low: np.ndarray, high: np.ndarray, s: Settings) -> np.ndarray:
    """The minimum of risk over benchmark weight, less alpha, plus turnover and costs, within the bounds and fully invested.

    Given the multiplier of the sum each name stands alone: a parabola with a kink at its current weight, whose minimum is the one of the buying or the selling
    parabola, or the current weight between them. These move linearly with the multiplier between the points where one meets a bound or the kink.
    """
    curve = s.risk_aversion / np.maximum(benchmark, s.risk_floor)
    buy, sell = s.turnover_penalty + s.buy_cost, s.turnover_penalty + s.sell_cost

    def at(m: float) -> np.ndarray:
        pull = s.alpha_strength * alpha - m
        bought, sold = benchmark + (pull - buy) / curve, benchmark + (pull + sell) / curve
        return np.clip(np.maximum(bought, np.minimum(sold, current)), low, high)

    knots = [s.alpha_strength * alpha + cost - curve * (w - benchmark) for cost in (-buy, sell) for w in (low, high, current)]
    return _at_sum(at, np.concatenate(knots), s.invested)


def furthest(start: np.ndarray, goal: np.ndarray, current: np.ndarray, budget: float) -> np.ndarray:
    """The last point on the way from ``start`` to ``goal`` whose turnover from ``current`` is within ``budget``. Turnover is convex along the way and linear
    between the points where a name passes its current weight."""
    move = goal - start
    turnover = lambda a: np.abs(start + a * move - current).sum()
    if turnover(1.0) <= budget:
        return goal
    with np.errstate(divide="ignore", invalid="ignore"):
        crossings = (current - start) / move
    knots = np.unique(np.concatenate([[0.0, 1.0], crossings[(crossings > 0) & (crossings < 1)]]))
    values = np.array([turnover(a) for a in knots])
    last = int(np.flatnonzero(values <= budget)[-1]) if (values <= budget).any() else 0
    rise = values[last + 1] - values[last]
    share = (budget - values[last]) / rise if rise > 0 else 0.0
    return start + (knots[last] + max(0.0, share) * (knots[last + 1] - knots[last])) * move


def optimise(table: pd.DataFrame, settings: Settings | None = None) -> tuple[pd.DataFrame, dict]:
    """Target weights of one date from (code, score, benchmark, current); score is NULL for names that aren't ranked, benchmark and current are 0 where
    a name has none. Returns code, benchmark_weight, target_weight, active_weight, alpha_score, and diagnostics.

    Candidates are all held names, the best ranked and the benchmark's heaviest, as many as allowed.
    """
    s = settings or Settings()
    rows = table.assign(benchmark=table.benchmark.fillna(0.0).clip(lower=0), current=table.current.fillna(0.0).clip(lower=0)).sort_values("code")
    if rows.benchmark.sum() <= 0:
        raise ValueError("the benchmark has no weights")
    rows["benchmark"] /= rows.benchmark.sum()
    rows = rows[rows.score.notna() | (rows.current > 0)].reset_index(drop=True)
    best = rows.score.rank(ascending=False, method="first").to_numpy()
    place = np.select([rows.current > 0, best <= s.alpha_top_n, rows.benchmark > 0], [0, 1, 2], 3)
    within = np.select([place == 0, place == 1], [-rows.current, best], -rows.benchmark)
    limit = max(s.max_names, int((rows.current > 0).sum()), s.alpha_top_n)
    rows = rows.iloc[[i for i in np.lexsort((within, place)) if place[i] < 3][:limit]].reset_index(drop=True)
    covered = float(rows.benchmark.sum())
    if covered <= 0:
        raise ValueError("the candidates hold none of the benchmark")
    benchmark = rows.benchmark.to_numpy(float) / covered * s.invested
    alpha = rows.score.fillna(0.0).to_numpy(float)
    alpha = alpha - np.average(alpha, weights=np.maximum(benchmark, 1e-12))
    alpha = alpha / alpha.std() if alpha.std() > 1e-12 else alpha
    current = rows.current.to_numpy(float)
    spare = s.invested - current.sum()
    current = current + spare * benchmark / benchmark.sum() if spare > 0 else current * (s.invested / current.sum())
    low = np.maximum(0.0, benchmark - s.max_active)
    high = np.minimum(np.maximum(s.max_weight, benchmark), benchmark + s.max_active)
    start = nearest_within(current, low, high, s.invested)
    budget = max(s.max_turnover, float(np.abs(start - current).sum()) + 1e-8)
    w = furthest(start, best_weights(alpha, benchmark, current, low, high, s), current, budget)
    out = pd.DataFrame({"code": rows.code, "benchmark_weight": benchmark, "target_weight": w, "active_weight": w - benchmark, "alpha_score": alpha})
    traded = w - current
    facts = {
        "candidates": int((w > 1e-8).sum()), "benchmark_coverage": covered, "turnover": float(np.abs(traded).sum()), "max_active": float(np.abs(w - benchmark).max()),
        "cost": float(s.buy_cost * traded.clip(min=0).sum() + s.sell_cost * (-traded).clip(min=0).sum()),
        "objective": float(-s.alpha_strength * alpha @ w + 0.5 * s.risk_aversion * ((w - benchmark) ** 2 / np.maximum(benchmark, s.risk_floor)).sum() + s.turnover_penalty * np.abs(traded).sum() + s.buy_cost * traded.clip(min=0).sum() + s.sell_cost * (-traded).clip(min=0).sum()),
    }
    return out[out.target_weight > 1e-8].sort_values("target_weight", ascending=False, kind="stable").reset_index(drop=True), facts


def optimise_dates(frame: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The weights and diagnostics of every date of (date, code, score, benchmark, current): a small problem per date, dates in parallel."""
    kind, given = frame.schema["code"].dataType.simpleString(), asdict(settings or Settings())

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        out, facts = optimise(rows, Settings(**given))
        return out.assign(date=rows.date.iloc[0], turnover=facts["turnover"], benchmark_coverage=facts["benchmark_coverage"], cost=facts["cost"], objective=facts["objective"])

    schema = f"date date, code {kind}, benchmark_weight double, target_weight double, active_weight double, alpha_score double, turnover double, benchmark_coverage double, cost double, objective double"
    return frame.groupBy("date").applyInPandas(lambda rows: one(rows)[[x.split()[0] for x in schema.split(", ")]], schema)
