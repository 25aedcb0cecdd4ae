import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelyard.evaluation import metrics as M
from panelyard.functions.scalar import security_id
from panelyard.index import portfolio as P
from panelyard.index import research as I
from panelyard.plans.nodes import DAILY, Language, parse
from panelyard.search import fusion, policy
from panelyard.session import shared_path
from panelyard.sources import cleaning as C
from panelyard.sources import store

DAY = dt.date(2021, 1, 1)


def day(i):
    return DAY + dt.timedelta(days=i)


def test_forward_return_by_rows_and_by_calendar(spark):
    close = [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0]
    frame = spark.createDataFrame([(day(i), "A", v) for i, v in enumerate(close)] + [(day(i), "B", v) for i, v in enumerate(close) if i != 1], "date date, code string, close double").withColumn("volume", F.lit(1.0))
    rows = {(r.code, r.date): r.target for r in M.forward_return(frame).collect()}
    assert rows["A", day(0)] == 15.0 and rows["A", day(2)] is None and rows["B", day(0)] == 64 / 4 - 1
    labels = {(r.code, r.date): r for r in I.forward_labels(frame).collect()}
    assert labels["A", day(0)].raw_return == 15.0 and labels["B", day(0)].raw_return is None and not labels["B", day(0)].tradable


def test_limits_and_suspension_make_labels_untradable(spark):
    rows = [(day(i), c, 10.0, 0.0 if (c, i) == ("B", 5) else 1.0, 10.0 if (c, i) == ("A", 1) else 20.0, 5.0) for i in range(7) for c in "AB"]
    frame = spark.createDataFrame(rows, "date date, code string, close double, volume double, limit_up double, limit_down double")
    got = {(r.code, r.date): r.tradable for r in I.forward_labels(frame).collect()}
    assert not got["A", day(0)] and got["A", day(1)] and got["B", day(1)] and not got["B", day(0)]


def test_determinantal_choice_prefers_different_rows():
    assert M.determinantal_choice(np.array([[2, 1.8, 0], [1.8, 2, 0], [0, 0, 1]]), 2) == [0, 2]
    assert M.determinantal_choice(np.ones((3, 3)), 3) == [0] and M.determinantal_choice(np.eye(2), 0) == []


def test_rank_correlation_covers_every_date_of_a_large_panel(spark):
    # y follows x on three dates and opposes it on the other three, so any unequal choice of dates shows.
    frame = spark.range(600_006).select(F.date_add(F.lit(DAY), (F.col("id") % 6).cast("int")).alias("date"), F.col("id").cast("double").alias("x"), F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(-F.col("id")).cast("double").alias("y"))
    assert M.rank_correlation(frame, ["x", "y"]).first()["corr"] == pytest.approx(0, abs=1e-6)
    assert M.rank_correlation(frame, ["x", "y"], max_rows=500_000).first()["corr"] == pytest.approx(-0.5, abs=1e-6)


def test_noise_is_repeatable_and_small(spark):
    rows = [("f", day(d), c, float((c * 7 + d) % 31), float((c * 7 + d) % 31 + c % 3)) for d in range(5) for c in range(40)]
    long = spark.createDataFrame(rows, "factor string, date date, code long, value double, target double")
    a, b = ([r.value for r in M.perturbed(long).orderBy("date", "code").collect()] for _ in range(2))
    assert a == b and max(abs(x - r[3]) for x, r in zip(a, sorted(rows, key=lambda r: (r[1], r[2])))) < 0.05 * 9 * 5
    assert 0.9 < M.robustness(long).first().robustness <= 1


def test_targets_respect_buffer_youth_and_cap():
    ranked = list("ABCDEFGH")
    assert P.controlled_targets(ranked, list("GH"), {"G": 9, "H": 0}, 2, 3, 1.0, 2) == ["H", "A"]
    assert P.controlled_targets(ranked, list("CD"), {"C": 9, "D": 9}, 2, 4, 1.0, 2) == ["C", "D"]
    assert P.controlled_targets(ranked, list("EFGH"), dict.fromkeys("EFGH", 9), 4, 1, 0.25, 2) == ["E", "F", "G", "A"]
    assert P.controlled_targets(ranked, [], {}, 3, 5, 0.5, 1) == ["A", "B", "C"]


def test_path_agrees_with_full_rankings(spark):
    rng = np.random.default_rng(7)
    rankings = [[f"c{x:02d}" for x in rng.permutation(60)] for _ in range(12)]
    ranked = spark.createDataFrame([(day(d), c, i + 1) for d, names in enumerate(rankings) for i, c in enumerate(names)], "date date, code string, order int")
    for args in ((5, 10, 0.3, 2), (10, 20, 0.3, 2), (4, 4, 0.25, 0)):
        held, days, want = [], {}, []
        for d, names in enumerate(rankings):
            held = P.controlled_targets(names, held, days, *args)
            days = {c: days.get(c, 0) + 1 for c in held}
            want += [(day(d), c, i + 1) for i, c in enumerate(held)]
        assert sorted(map(tuple, P.portfolio_path(ranked, *args).collect())) == sorted(want)


def test_smoothing_averages_percentile_ranks_of_the_dates_that_hold_a_code(spark):
    kind = "date date, code string, score double"
    got = lambda rows, w: {(r.date, r.code): (r.smoothed, r.order) for r in P.smoothed_ranks(spark.createDataFrame(rows, kind), w).collect()}
    rows = [(day(0), c, x) for c, x in zip("ABC", (3.0, 2.0, 1.0))] + [(day(1), c, x) for c, x in zip("ABC", (1.0, 3.0, 2.0))]
    for w in ((0.5, 0.5), (5, 5)):
        out = got(rows, w)
        assert [out[day(1), c] for c in "BAC"] == [(pytest.approx(5 / 6), 1), (pytest.approx(2 / 3), 2), (pytest.approx(1 / 2), 3)]
    out = got([(day(0), "A", 2.0), (day(0), "B", 1.0), (day(1), "B", 1.0), (day(1), "C", 2.0), (day(2), "A", 1.0)], (0.5, 0.5))
    assert out[day(1), "C"][0] == 1.0 and (day(1), "A") not in out and out[day(2), "A"][0] == 1.0
    assert got([(day(0), c, 1.0) for c in "AB"], (1.0,))[day(0), "A"] == (0.75, 1)  # ties share their average rank
    for bad in ((), (0, 0), (1, -1)):
        with pytest.raises(ValueError):
            got(rows, bad)


def table(score, benchmark, current):
    return pd.DataFrame({"code": [f"{i:02d}" for i in range(len(score))], "score": score, "benchmark": benchmark, "current": current})


def test_weights_keep_bounds_sum_and_turnover():
    s = P.Settings(max_names=4, alpha_top_n=4, alpha_strength=0.02, max_active=0.03, max_weight=0.5, max_turnover=0.10)
    out, facts = P.optimise(table([1.0, 0.75, 0.5, 0.25], [0.4, 0.3, 0.2, 0.1], [0.39, 0.29, 0.20, 0.10]), s)
    assert out.target_weight.sum() == pytest.approx(0.98) and out.active_weight.abs().max() <= 0.03 + 1e-8
    assert facts["turnover"] <= 0.10 + 1e-7 and out.set_index("code").active_weight["00"] > 0
    cheap, dear = (P.optimise(table([1.0, 0.0], [0.5, 0.5], [0.49, 0.49]), P.Settings(max_names=2, alpha_top_n=2, risk_aversion=0.1, turnover_penalty=0.0, max_active=0.2, max_weight=0.8, max_turnover=0.4, buy_cost=c, sell_cost=c))[0] for c in (0.0, 0.2))
    assert dear.set_index("code").active_weight["00"] < cheap.set_index("code").active_weight["00"]
    with pytest.raises(ValueError):
        P.nearest_within(np.ones(2), np.zeros(2), np.full(2, 0.4), 1.0)
    with pytest.raises(ValueError, match="benchmark"):
        P.optimise(table([1.0, 0.0], [0.0, None], [0.5, 0.5]))


def test_weights_are_the_minimum():
    rng = np.random.default_rng(8)
    for _ in range(20):
        n = 12
        benchmark, current = rng.dirichlet(np.ones(n)) * 0.98, rng.dirichlet(np.ones(n)) * 0.98
        alpha, s = rng.normal(size=n), P.Settings(max_active=0.05)
        low, high = np.maximum(0, benchmark - 0.05), benchmark + 0.05
        cost = lambda w: -s.alpha_strength * alpha @ w + 0.5 * ((w - benchmark) ** 2 / np.maximum(benchmark, s.risk_floor)).sum() + s.turnover_penalty * np.abs(w - current).sum() + s.buy_cost * (w - current).clip(min=0).sum() + s.sell_cost * (current - w).clip(min=0).sum()  # noqa: B023, E731
        w = P.best_weights(alpha, benchmark, current, low, high, s)
        assert w.sum() == pytest.approx(0.98) and (w >= low - 1e-12).all() and (w <= high + 1e-12).all()
        for _ in range(200):  # no feasible step improves a convex function at its minimum
            other = P.nearest_within(w + rng.normal(size=n) * 10 ** rng.uniform(-5, -1), low, high, 0.98)
            assert cost(other) >= cost(w) - 1e-10
        near = P.nearest_within(current, low, high, 0.98)
        assert near.sum() == pytest.approx(0.98) and all(((current - near) ** 2).sum() <= ((current - P.nearest_within(near + rng.normal(size=n) * 0.01, low, high, 0.98)) ** 2).sum() + 1e-10 for _ in range(100))
        least = np.abs(near - current).sum()
        budget = (least + np.abs(w - current).sum()) / 2
        part = P.furthest(near, w, current, max(budget, least + 1e-8))
        assert np.abs(part - current).sum() <= max(budget, least + 1e-8) + 1e-9


def test_candidates_are_held_ranked_and_heavy_names():
    n = 30
    score = [None if i >= 25 else 1 - i / n for i in range(n)]
    out, facts = P.optimise(table(score, [1 / n] * n, [0.049 if i in (24, 29) else 0.0 for i in range(n)]), P.Settings(max_names=12, alpha_top_n=5, max_active=0.2, max_weight=0.9))
    assert facts["candidates"] <= 12 and facts["benchmark_coverage"] == pytest.approx(12 / n) and out.target_weight.sum() == pytest.approx(0.98)


def test_weight_history_is_checked_while_it_is_read(spark):
    kind = "date string, index_key string, code string, benchmark_weight string"
    rows = [("2024-01-02", "a", "600000", "30"), ("2024-01-02", "a", "000001.sz", "10"), ("2024-01-02", "b", "600000", "9"), ("2024-01-03", "a", "600000", "x"), ("2024-02-01", "a", "600000", "5")]
    read = lambda extra=(), **k: {(str(r.date), r.code): r.benchmark_weight for r in P.weight_history(spark.createDataFrame([*rows, *extra], kind), "a", **k).collect()}
    assert read() == {("2024-01-02", "600000.XSHG"): 0.75, ("2024-01-02", "000001.XSHE"): 0.25, ("2024-02-01", "600000.XSHG"): 1.0}
    assert list(read(start="2024-01-15")) == [("2024-02-01", "600000.XSHG")]
    for bad, text in (((("2024-02-01", "a", "600000.SH", "5"),), "repeated"), ((("2024-02-01", "a", "600001", "-1"),), "negative"), ((("2024-03-01", "a", "600001", "0"),), "sum to zero")):
        with pytest.raises(Exception, match=text):
            read(bad)


def test_as_of_takes_the_last_known_row(spark):
    left = spark.createDataFrame([(day(i), "A") for i in range(4)], "date date, code string")
    right = spark.createDataFrame([(day(1), "A", 1.0), (day(3), "A", 2.0)], "date date, code string, w double")
    got = lambda strict: [r.w for r in I.as_of(left, right, "date", ("code",), ("w",), strict).orderBy("date").collect()]
    assert got(False) == [None, 1.0, 1.0, 2.0] and got(True) == [None, None, 1.0, 1.0]


def test_index_input_needs_members_of_every_date(spark):
    scores = spark.createDataFrame([(day(0), "A", 1.0), (day(0), "A", 3.0), (day(1), "A", 1.0)], "date date, code string, score double")
    members = spark.createDataFrame([(day(0), "A")], "date date, code string")
    with pytest.raises(ValueError, match="no members"):
        I.index_input(scores, members)
    assert I.index_input(scores.where(F.col("date") == DAY), members).first().score == 2.0


def test_cleaning_names_fills_adjusts_and_drops(spark):
    rows = [("2021-01-01", " A ", 1.0, 2.0, 0.5, 1.5, -5.0, 10.0, 2.0), ("2021-01-02", "A", None, None, None, None, 4.0, 10.0, None), ("2021-01-03", "A", 3.0, 2.0, 9.0, 1.0, 4.0, 10.0, 2.0), ("bad", "A", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), ("2021-01-01", "", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "`Trade Date` string, order_book_id string, open double, high double, low double, close double, vol double, total_turnover double, `ex_cum_factor` double, line int")
    got = C.clean_daily(frame, ("line",)).orderBy("date").collect()
    assert [(str(r.date), r.code, r.close, r.volume) for r in got] == [("2021-01-01", "A", 3.0, 0.0), ("2021-01-02", "A", 3.0, 2.0)]
    with pytest.raises(ValueError, match="no columns"):
        C.column_mapping(frame.drop("vol"))
    with pytest.raises(ValueError):
        C.column_mapping(frame, {"nothing": "close"})
    with pytest.raises(ValueError, match="repeat"):
        C.assert_unique(frame.unionByName(frame), ("line",))
    with pytest.raises(ValueError):
        C.check_split(1, 5, 5, 9)


def test_security_ids(spark):
    ids = spark.createDataFrame([("600000",), ("000001.sz",), (" 830000 ",), ("300001.XSHE",), ("430001.BJ",)], "c string")
    assert [r.x for r in ids.select(security_id(F.col("c")).alias("x")).collect()] == ["600000.XSHG", "000001.XSHE", "830000.XBSE", "300001.XSHE", "430001.XBSE"]


def test_walk_forward_steps_leave_a_gap():
    steps = fusion.windows(list(range(30)), 10, 3, 5)
    assert steps[0] == fusion.Step(0, 9, 13, 17) and all(s.start - s.last == 4 and s.last - s.first == 9 for s in steps) and steps[-1].end == 29


def test_predictions_are_out_of_sample(spark):
    rng = np.random.default_rng(1)
    rows = [(day(d), c, float(x), float(2 * x + 0.1 * rng.normal())) for d in range(30) for c, x in enumerate(rng.normal(size=30))]
    matrix = spark.createDataFrame(rows, "date date, code int, f double, target double")
    out = fusion.walk_forward(matrix, ["f"], 15, 3, 20, "linear").join(matrix, ["date", "code"])
    assert out.agg(F.min("date")).first()[0] == day(18) and out.agg(F.corr("score", "target")).first()[0] > 0.9


def test_listwise_weights_minimise_the_cross_entropy(spark):
    rng = np.random.default_rng(4)
    rows = [(day(d), c, float(a), float(b), float(a - 0.5 * b + 0.3 * rng.normal())) for d in range(12) for c, (a, b) in enumerate(rng.normal(size=(25, 2)))]
    data = fusion.prepared(spark.createDataFrame(rows, "date date, code int, a double, b double, target double"), ["a", "b"])
    w = fusion.listwise(data, ["a", "b"], ridge=0.01)

    def loss(v):
        total = 0.0
        dates = {}
        for r in data.collect():
            dates.setdefault(r.date, []).append(r)
        for group in dates.values():
            e = [r.sample_weight * np.exp(r.a * v[0] + r.b * v[1]) for r in group]
            q = [r.sample_weight * np.exp(float(r.relevance)) for r in group]
            total -= sum(b / sum(q) * np.log(a / r.sample_weight / sum(e)) for a, b, r in zip(e, q, group))
        return total / len(dates) + 0.005 * float(np.dot(v, v))

    best = loss(w)
    assert w[0] > 0 > w[1] and all(loss(w + step) > best for step in np.array([[1e-2, 0], [-1e-2, 0], [0, 1e-2], [0, -1e-2]]))
    assert (fusion.listwise(data.limit(0), ["a", "b"]) == 0).all()


def test_listwise_ranks_are_out_of_sample_and_measured(spark):
    rng = np.random.default_rng(1)
    rows = [(day(d), c, float(x), float(2 * x + 0.1 * rng.normal())) for d in range(30) for c, x in enumerate(rng.normal(size=30))]
    matrix = spark.createDataFrame(rows, "date date, code int, f double, target double")
    days = fusion.quality(fusion.walk_forward(matrix, ["f"], 15, 3, 20, "listwise"), matrix).orderBy("date").collect()
    assert days[0].date == day(18) and len(days) == 12 and all(d.rank_ic > 0.9 and d.predictions == d.labels == 30 for d in days)


def test_a_stored_pool_looks_back_before_its_slice(spark, tmp_path):
    rows = [(day(d), c, *[float(10 + d + c)] * 4, 1.0, float(10 + d + c)) for d in range(12) for c in (1, 2)]
    panel = spark.createDataFrame(rows, "date date, code int, open double, high double, low double, close double, volume double, vwap double")
    panel.write.parquet(f"{tmp_path}/panel")
    spark.createDataFrame([("x", parse("ts_mean W5 close").to_json())], "factor string, tokens string").write.parquet(f"{tmp_path}/pool")
    out = policy.execute_stored(spark, f"{tmp_path}/pool", f"{tmp_path}/panel", start=day(9), end=day(10)).where("code = 1").orderBy("date").collect()
    assert [(r.date, r.x) for r in out] == [(day(9), 18.0), (day(10), 19.0)]
    with pytest.raises(ValueError):
        policy.execute_stored(spark, f"{tmp_path}/pool", f"{tmp_path}/panel", start=day(20))


def test_cleaning_report_counts_rows_of_every_kind(spark):
    rows = [("2020-01-01", str(c), 10.0 + c, 10.0 + c, 10.0 + c, 10.0 + c, 1.0, 0) for c in range(5)]
    rows += [("2020-01-01", "0", 10.0, 10.0, 10.0, 10.0, 1.0, 1), ("2020-01-01", "9", -1.0, 5.0, 1.0, 2.0, 1.0, 0), ("2020-01-01", " ", 1.0, 1.0, 1.0, 1.0, 1.0, 0), (None, "7", 1.0, 1.0, 1.0, 1.0, 1.0, 0)]
    frame = spark.createDataFrame(rows, "date string, code string, open double, high double, low double, close double, volume double, line int")
    got = {r.item: r.n for r in C.cleaning_report(frame, ("line",), (0.1, 0.9)).collect()}
    assert got == {"input_rows": 9, "invalid_keys": 2, "duplicates": 1, "bad_rows": 1, "output_rows": 5, "clipped_open": 2, "clipped_high": 2, "clipped_low": 2, "clipped_close": 2, "clipped_vwap": 2, "clipped_volume": 0}
    assert sum(r.n for r in C.cleaning_report(frame.limit(0), ("line",)).collect()) == 0


def test_policy_learns_to_prefer_rewarded_trees_and_round_trips():
    # Trees of two levels: six that are rewarded and 462 that hardly are, so balance gives the six a share of 6 / 10.62.
    small = Language("daily", DAILY.features, DAILY.feature_symbols, DAILY.ops, max_depth=2)
    p = policy.Policy(small, rate=0.05)
    score = lambda trees: {str(t): {"reward": 1.0 if t.name == "cs_rank" else 0.01, "coverage": 1.0} for t in trees}
    share = lambda: sum(p.sample(np.random.default_rng(i))[0].name == "cs_rank" for i in range(200)) / 200
    assert share() < 0.1
    history = policy.train(p, score, epochs=400, batch=16)
    assert 0.4 < share() < 0.75 and p.log_z == pytest.approx(np.log(10.62), abs=0.5) and np.mean([h["loss"] for h in history[-10:]]) < np.mean([h["loss"] for h in history[:10]])
    q = policy.Policy(small)
    q.load(p.save())
    assert str(q.sample(np.random.default_rng(3))[0]) == str(p.sample(np.random.default_rng(3))[0])
    rows = policy.pool(p, score, 3)
    assert len({r["expression"] for r in rows}) == 3 and all(str(parse(r["tokens"], small)) == r["expression"] for r in rows)


def test_training_goes_on_where_it_stopped():
    score = lambda trees: {str(t): {"reward": 1.0 / len(str(t)), "coverage": 1.0} for t in trees}
    whole, saved = policy.Policy(), {}
    history = policy.train(whole, score, 4, 3, keep=saved.__setitem__)
    again = policy.Policy()
    again.load(saved[1])
    assert policy.train(again, score, 4, 3, first=2) == history[2:] and again.save() == whole.save()


def test_localised_names_become_canonical(spark):
    names = ["交易日期", "证券代码", "开盘价", "最高价", "最低价", "收盘价", "成交量", "成交额", "复权因子", "总市值"]
    frame = spark.createDataFrame([("2021-01-01", "A", 1.0, 2.0, 0.5, 1.5, 10.0, 15.0, 1.0, 9.0)], ", ".join(f"`{n}` {'string' if i < 2 else 'double'}" for i, n in enumerate(names)))
    assert set(C.rename(frame).columns) == {"date", "code", "open", "high", "low", "close", "volume", "amount", "adj_factor", "market_cap"}
    english = frame.toDF("trading_date", "security_id", "open_price", "high_price", "low_price", "close_price", "trade_volume", "trade_amount", "adjust_factor", "float_market_cap")
    assert C.column_mapping(english)["code"] == "security_id" and C.column_mapping(english)["adj_factor"] == "adjust_factor"


def test_stores_round_trip_and_replace_only_their_partitions(spark):
    frame = spark.createDataFrame([(1, "a", 2020), (2, "b", 2021)], "x int, s string, year int")
    for suffix in (".parquet", ".csv.gz", ".json", ".orc"):
        path = shared_path(spark, "t") + suffix
        store.write(frame, path)
        assert sorted(map(tuple, store.read(spark, path, frame.schema).collect())) == [(1, "a", 2020), (2, "b", 2021)]
    path = shared_path(spark, "t")
    store.write(frame, path, ("year",))
    store.write(spark.createDataFrame([(9, "z", 2021)], frame.schema), path, ("year",))
    assert sorted((r.x, r.year) for r in store.read(spark, path).collect()) == [(1, 2020), (9, 2021)]
    assert store.content_digest(frame).first() == store.content_digest(frame.orderBy(F.desc("x"))).first()
    a, b = {"f": parse("cs_rank close")}, {"f": parse("cs_rank open")}
    assert store.fingerprint(frame, a) == store.fingerprint(frame, a) != store.fingerprint(frame, b)
