import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from panelyard.operators import kernels
from panelyard.operators import registry as R
from panelyard.plans.compile import daily_factors, minute_factors, minute_values
from panelyard.plans.nodes import DAILY, MINUTE, Node, State, parse, random_tree


def panel(spark, rows):
    """rows: (code, values of close); dates run from 2021-01-01."""
    out = [(dt.date(2021, 1, 1) + dt.timedelta(days=i), code, v) for code, values in rows for i, v in enumerate(values)]
    frame = spark.createDataFrame(out, "date date, code string, close double")
    return frame.selectExpr("*", "close as open", "close as high", "close as low", "100.0D as volume", "close as vwap")


def column(frame, name="f"):
    return [r[name] for r in frame.orderBy("code", "date").collect()]


def test_inventory():
    assert (len(R.DAILY_FEATURES), len(R.DAILY_OPS), len(R.MINUTE_FEATURES), len(R.MINUTE), len(R.MASKS), len(R.REDUCERS)) == (6, 21, 21, 15, 14, 16)
    assert len(DAILY.tokens) == 32 and len(MINUTE.tokens) == 92


def test_tokens_trees_and_text_round_trip():
    for language in (DAILY, MINUTE):
        for seed in range(60):
            tree = random_tree(seed, language)
            assert parse(tree.tokens(), language) == parse(tree.to_json(), language) == tree
            assert tree.depth() <= language.max_depth and tree.complexity() <= language.max_nodes + 4
    assert str(parse("cs_rank ts_mean W5 close")) == "cs_rank(ts_mean(close,5))"


def test_random_trees_follow_the_weights():
    for language, expected in ((DAILY, (2, 3, 4, 2)), (MINUTE, (2, 2, 4, 2))):
        roots = [random_tree(s, language).name for s in range(6000)]
        counts = [sum(n in group for n in roots) for group, _ in R.DRAWS[language.name]]
        assert 1 - sum(counts) / len(roots) == pytest.approx(R.LEAVES[language.name], abs=0.03)
        assert [c / sum(counts) for c in counts] == pytest.approx([e / sum(expected) for e in expected], abs=0.03)


@pytest.mark.parametrize("bad", ["", "close close", "ts_mean close", "ts_mean W7 close", "add close", "nothing", "r_mean close"])
def test_the_grammar_rejects(bad):
    with pytest.raises(ValueError):
        parse(bad)


def test_masks_only_under_reducers():
    assert parse("r_mean m_top W5 close", MINUTE)
    for bad in ("m_top W5 close", "r_corr m_top W5 close vol", "r_mean m_abs m_top W5 close", "close"):
        with pytest.raises(ValueError):
            parse(bad, MINUTE)


def test_states_offer_only_what_can_be_finished():
    state = State(MINUTE)
    for token in "cs_rank ts_mean W5 r_mean m_top W5 close".split():
        assert state.mask()[MINUTE.tokens.index(token)]
        state = state.step(token)
    assert state.terminal and state.actions() == ()
    with pytest.raises(ValueError):
        state.step("close")


def test_windows_need_all_rows_and_ranks_average_ties(spark):
    frame = panel(spark, [("A", [1.0, 2.0, 2.0, 4.0, None, 6.0, 7.0, 7.0, 7.0, 7.0]), ("B", [10.0] * 5)])
    out = daily_factors(frame, {"f": "ts_mean W5 close", "g": "ts_rank W5 close", "h": "ts_zscore W5 close", "i": "ts_delta W5 close", "j": "cs_rank close"})
    assert column(out) == [None] * 9 + [pytest.approx(6.8)] + [None] * 4 + [10.0]
    assert column(out, "g")[9] == pytest.approx((1 + (4 + 1) / 2) / 5) and column(out, "g")[14] == pytest.approx(0.6)
    assert column(out, "h")[14] is None and column(out, "i")[5] == 5.0
    assert column(out, "j")[:1] == [0.5] and column(out, "j")[4] is None and column(out, "j")[14] == 1.0


def test_division_and_infinities_are_null(spark):
    frame = panel(spark, [("A", [0.0, 1e-13, 2.0, 1e308])])
    out = daily_factors(frame, {"f": "div open close", "g": "mul close close", "h": "log close"})
    assert column(out) == [None, None, 1.0, 1.0] and column(out, "g")[3] is None and column(out, "h")[0] == pytest.approx(math.log(1e-12))


def test_no_look_ahead(spark):
    base = [("A", [float(3 + (i * 7) % 5) for i in range(40)]), ("B", [float(2 + (i * 5) % 7) for i in range(40)])]
    moved = [(c, [v * (100 if i >= 30 else 1) for i, v in enumerate(x)]) for c, x in base]
    for text in [f"{n} W5 close" for n in R.TIME_SERIES] + ["cs_zscore ts_mean W10 close", "ts_std W5 cs_rank close"]:
        a, b = (column(daily_factors(panel(spark, x), {"f": text}).where("date < '2021-01-31'")) for x in (base, moved))
        assert a == b, text


def test_shared_subtrees_are_computed_once_and_exchanges_follow_partitions(spark):
    plan = kernels.Steps()
    a = kernels.build(plan, "ts_mean", ("x",), 5)
    assert kernels.build(plan, "ts_mean", ("x",), 5) == a and len(plan.steps) == 1
    frame = panel(spark, [("A", [1.0] * 5)])
    many = {f"f{i}": f"cs_rank ts_mean W{w} {c}" for i, (w, c) in enumerate((w, c) for w in R.WINDOWS for c in ("close", "open", "volume"))}
    text = daily_factors(frame, many)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 2


def bars(spark, days):
    rows = [(dt.date(2024, 1, 1 + d), "A", dt.datetime(2024, 1, 1 + d, 9, 30 + i), i, *[v] * 4, 10.0 + i, None if v is None else v * (10.0 + i)) for d, values in enumerate(days) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "date date, code string, datetime timestamp_ntz, seq long, open double, high double, low double, close double, vol double, amount double")


def test_intraday_features_restart_each_day_and_empty_sums_are_zero(spark):
    frame = bars(spark, [[1.0, 2.0, 4.0], [None, None], [5.0]])
    ret = minute_values(frame, {"f": Node("ret"), "g": Node("signed_vol"), "h": Node("twap")}).orderBy("datetime").collect()
    assert [r.f for r in ret] == [None, 1.0, 1.0, None, None, None] and [r.g for r in ret][:3] == [0.0, 11.0, 12.0] and ret[2].h == pytest.approx(7 / 3)
    days = {str(r.date): r for r in minute_factors(frame, {"s": "r_sum close", "m": "r_mean close", "d": "r_std close", "a": "r_argmax close", "c": "r_corr close vol", "k": "r_skew close"}).collect()}
    assert days["2024-01-02"].s == 0.0 and days["2024-01-02"].m is None and days["2024-01-03"].d is None
    assert days["2024-01-01"].a == 1.0 and days["2024-01-03"].c is None and days["2024-01-03"].k is None


def test_top_bars_break_ties_by_time_and_skip_nulls(spark):
    frame = bars(spark, [[3.0, 3.0, None, 3.0, 1.0, 3.0, 3.0, 3.0]])
    out = minute_values(frame, {"t": Node("m_top", (Node("close"),), 5), "h": Node("m_head", (Node("close"),), 5), "m": Node("m_mid", (Node("close"),), 5)}).orderBy("datetime").collect()
    assert [r.t is not None for r in out] == [True, True, False, True, False, True, True, False]
    assert [r.h is not None for r in out] == [True, True, False, True, True, False, False, False]
    assert [r.m is not None for r in out] == [False, True, False, True, True, True, False, False]


def test_large_constant_values_stay_stable(spark):
    frame = bars(spark, [[10000.0 + 0.1 * (i % 2) for i in range(20)], [10000.0] * 20])
    days = {str(r.date): r for r in minute_factors(frame, {"z": "r_std m_zscore close", "c": "r_corr close vol", "r": "r_rsquare close", "s": "r_slope close"}).collect()}
    assert days["2024-01-01"].z == pytest.approx(1.0) and days["2024-01-02"].z is None and days["2024-01-02"].c is None and days["2024-01-02"].r is None and days["2024-01-02"].s == pytest.approx(0.0)
    assert abs(days["2024-01-01"].c) < 1 and frame.where(F.col("close").isNull()).count() == 0
