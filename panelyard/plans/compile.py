"""Many expressions as one Spark plan.

All nodes of all expressions become hash-consed steps. Steps are taken in rounds: everything elementwise that is ready, then every
ready window of the partition at hand, and only when none is left the partition that most ready windows want. So the plan has
one exchange per change of partition on the longest path, however many expressions there are; reductions of all minute
expressions share one aggregation.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.operators import kernels
from panelyard.operators import registry as R
from panelyard.plans.nodes import DAILY, MINUTE, Node, parse


def _apply(frame: DataFrame, plan: kernels.Steps) -> DataFrame:
    done = set(frame.columns)
    left = [s for s in plan.steps if s[3] != "agg" and s[0] not in done]
    at = None
    while left:
        ready = [s for s in left if set(s[1]) <= done]
        now = [s for s in ready if s[3] is None] or [s for s in ready if s[3] == at]
        if not now:
            if not ready:
                break  # what is left needs the reduction first
            at = Counter(s[3] for s in ready).most_common(1)[0][0]
            now = [s for s in ready if s[3] == at]
        frame = frame.select("*", *[make(*map(F.col, inputs)).alias(name) for name, inputs, make, _ in now])
        done |= {s[0] for s in now}
        left = [s for s in left if s[0] not in done]
    return frame


def _needed(plan: kernels.Steps, targets: Sequence[str]) -> kernels.Steps:
    """The steps that ``targets`` rest on."""
    by_name = {s[0]: s for s in plan.steps}
    wanted, stack = set(), list(targets)
    while stack:
        if (name := stack.pop()) not in wanted and name in by_name:
            wanted.add(name)
            stack += by_name[name][1]
    out = kernels.Steps()
    out.steps = [s for s in plan.steps if s[0] in wanted]
    return out


def daily_factors(panel: DataFrame, expressions: dict[str, Node | Sequence[str] | str], keep: Sequence[str] = ()) -> DataFrame:
    """date, code, the columns in ``keep`` and a column for each expression over a daily panel."""
    trees = {k: v if isinstance(v, Node) else parse(v, DAILY) for k, v in expressions.items()}
    if missing := set().union(*(t.leaves() for t in trees.values())) - set(panel.columns):
        raise ValueError(f"the panel has no {sorted(missing)}")
    plan = kernels.Steps()

    def lower(node: Node) -> str:
        if not node.args:
            return plan.add((f"given {node.name}",), (), lambda: F.col(node.name).cast("double"))
        return kernels.build(plan, node.name, tuple(lower(a) for a in node.args), node.window)

    out = {k: lower(t) for k, t in trees.items()}
    leaves = sorted(set().union(*(t.leaves() for t in trees.values())))
    frame = _apply(panel.select("date", "code", *dict.fromkeys([*keep, *leaves])), plan)
    return frame.select("date", "code", *keep, *[F.col(c).alias(k) for k, c in out.items()])


def minute_factors(panel: DataFrame, expressions: dict[str, Node | Sequence[str] | str]) -> DataFrame:
    """date, code and a column for each expression over bars (date, code, datetime, seq, ...); days without bars have no row."""
    trees = {k: v if isinstance(v, Node) else parse(v, MINUTE) for k, v in expressions.items()}
    plan, present = kernels.Steps(), set(panel.columns)

    def lower(node: Node) -> str:
        if not node.args:
            return kernels.minute_feature(plan, node.name, present)
        return kernels.build(plan, node.name, tuple(lower(a) for a in node.args), node.window)

    out = {k: lower(t) for k, t in trees.items()}
    reduced = [s for s in plan.steps if s[3] == "agg"]
    before = _needed(plan, [x for s in reduced for x in s[1]])
    base = [c for c in panel.columns if c in R.MINUTE_FEATURES]
    bars = _apply(panel.select("date", "code", "datetime", "seq", *base), before)
    days = bars.groupBy("date", "code").agg(*[make(*map(F.col, inputs)).alias(name) for name, inputs, make, _ in reduced])
    done = {s[0] for s in before.steps} | {s[0] for s in reduced}
    after = kernels.Steps()
    after.steps = [s for s in _needed(plan, list(out.values())).steps if s[0] not in done]
    return _apply(days, after).select("date", "code", *[F.col(c).alias(k) for k, c in out.items()])


def minute_values(panel: DataFrame, expressions: dict[str, Node]) -> DataFrame:
    """Bars with a column for each minute-layer tree (a feature, a transform or a mask), unreduced."""
    plan, present = kernels.Steps(), set(panel.columns)

    def lower(node: Node) -> str:
        if not node.args:
            return kernels.minute_feature(plan, node.name, present)
        return kernels.build(plan, node.name, tuple(lower(a) for a in node.args), node.window)

    out = {k: lower(t) for k, t in expressions.items()}
    base = [c for c in panel.columns if c in R.MINUTE_FEATURES]
    return _apply(panel.select("date", "code", "datetime", "seq", *base), plan).select("date", "code", "datetime", "seq", *[F.col(c).alias(k) for k, c in out.items()])


def align(blocks: dict[str, DataFrame]) -> DataFrame:
    """Blocks (date, code, value) of different sources side by side: a row for each key of any, and present_<block> telling an
    absent row from a NULL one. One full outer join each, all on the same key."""
    out = None
    for name, block in blocks.items():
        one = block.select("date", "code", F.col("value").alias(name), F.lit(True).alias(f"present_{name}"))
        out = one if out is None else out.join(one, ["date", "code"], "full_outer")
    return out.withColumns({f"present_{n}": F.coalesce(f"present_{n}", F.lit(False)) for n in blocks})


def over_blocks(aligned: DataFrame, expression: Node | Sequence[str] | str, language) -> DataFrame:
    """A daily expression over aligned blocks, whose names are its features: windows of a subtree run over the rows that
    all blocks of the subtree hold, so an absent row takes no place in them while a NULL one does."""
    tree = expression if isinstance(expression, Node) else parse(expression, language)

    def value(node: Node) -> DataFrame:
        if not node.args:
            return aligned.where(f"present_{node.name}").select("date", "code", F.col(node.name).cast("double").alias("v"))
        frame = None
        names = [f"a{i}" for i in range(len(node.args))]
        for name, a in zip(names, node.args):
            one = value(a).withColumnRenamed("v", name)
            frame = one if frame is None else frame.join(one, ["date", "code"])
        plan = kernels.Steps()
        out = kernels.build(plan, node.name, tuple(names), node.window)
        return _apply(frame, plan).select("date", "code", F.col(out).alias("v"))

    return value(tree).withColumnRenamed("v", "factor")


def reindex(panel: DataFrame, factors: DataFrame) -> DataFrame:
    """``factors`` on exactly the keys of ``panel``."""
    return panel.select("date", "code").join(factors, ["date", "code"], "left")


def union_keep_last(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("date", "code")) -> DataFrame:
    """Rows of both; where keys meet, those of ``new``."""
    return old.join(new.select(*keys), list(keys), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))

