"""Search over the grammar by trajectory balance.

A policy gives each allowed token a logit that depends on the symbol that is owed, the depth, and the two tokens before. Training moves
log Z + sum log P(token) towards log reward, squared; every tree has one prefix order, so the backward probability is one.
Rewards of a batch of trees come from one Spark job.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from panelyard.evaluation import metrics
from panelyard.plans.compile import daily_factors, minute_factors
from panelyard.plans.nodes import DAILY, MINUTE, Language, Node, State, parse
from panelyard.session import stored
from panelyard.sources import store
from panelyard.sources.cleaning import between, sliced


@dataclass
class Policy:
    language: Language = DAILY
    rate: float = 0.05
    log_z: float = 0.0
    logits: dict[tuple, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.index = {t: i for i, t in enumerate(self.language.tokens)}

    def _context(self, state: State) -> tuple:
        return (*state.owed[-1], *state.tokens[-2:])

    def _probabilities(self, state: State) -> tuple[tuple, np.ndarray, np.ndarray]:
        key = self._context(state)
        allowed = np.array([self.index[a] for a in state.actions()])
        x = self.logits.setdefault(key, np.zeros(len(self.index)))[allowed]
        p = np.exp(x - x.max())
        return key, allowed, p / p.sum()

    def sample(self, rng: np.random.Generator) -> tuple[Node, list[tuple[tuple, np.ndarray, np.ndarray, int]]]:
        """A tree and the choices that made it."""
        state, path = State(self.language), []
        while not state.terminal:
            key, allowed, p = self._probabilities(state)
            pick = int(rng.choice(len(p), p=p))
            path.append((key, allowed, p, pick))
            state = state.step(self.language.tokens[allowed[pick]])
        return state.tree(), path

    def learn(self, paths: Sequence[list], rewards: Sequence[float]) -> float:
        """One gradient step on the mean squared imbalance; returns it."""
        total = 0.0
        for path, reward in zip(paths, rewards):
            gap = self.log_z + sum(np.log(p[i]) for _, _, p, i in path) - np.log(reward)
            total += gap * gap
            step = 2 * self.rate * np.clip(gap, -20, 20) / len(paths)
            self.log_z -= 10 * step  # it must settle before the choices do
            for key, allowed, p, i in path:
                change = -p * 1.0
                change[i] += 1
                self.logits[key][allowed] -= step * change
        return total / max(1, len(paths))

    def save(self) -> str:
        return json.dumps({"log_z": self.log_z, "logits": [[list(k), v.tolist()] for k, v in self.logits.items()]})

    def load(self, text: str) -> None:
        state = json.loads(text)
        self.log_z, self.logits = state["log_z"], {tuple(k): np.array(v) for k, v in state["logits"]}


def batch_rewards(panel: DataFrame, **settings) -> Callable[[Sequence[Node]], dict[str, dict]]:
    """A function from trees to their score rows, by rendered text: one job for all that it hasn't scored before.

    ``panel`` has target, industry and market_cap beside the features.
    """
    known: dict[str, dict] = {}
    panel = stored(panel, "panel")  # every batch reads it

    def score(trees: Sequence[Node]) -> dict[str, dict]:
        new = {str(t): t for t in trees if str(t) not in known}
        if new:
            names = {f"f{i}": t for i, t in enumerate(new)}
            frame = daily_factors(panel, {f: new[t] for f, t in names.items()}, ("target", "industry", "market_cap"))
            rows = metrics.reward(metrics.long_form(frame, list(names)), **settings).collect()
            found = {names[r.factor]: r.asDict() for r in rows}
            known.update({t: found.get(t, {"reward": settings.get("floor", 1e-8), "coverage": 0.0}) for t in new})
        return {str(t): known[str(t)] for t in trees}

    return score


def train(policy: Policy, score: Callable, epochs: int, batch: int, seed: int = 0, first: int = 0, keep: Callable[[int, str], None] | None = None) -> list[dict]:
    """Metrics of each epoch: loss, mean and best reward, log Z.

    ``keep`` gets each finished epoch and the policy's text. A run that loads such a text and starts at the next epoch (``first``) goes on as if it
    had never stopped, since the draws of an epoch depend on the seed and its number only.
    """
    out = []
    for epoch in range(first, epochs):
        rng = np.random.default_rng([seed, epoch])
        drawn = [policy.sample(rng) for _ in range(batch)]
        rewards = [max(1e-8, score([t for t, _ in drawn])[str(t)]["reward"]) for t, _ in drawn]
        loss = policy.learn([p for _, p in drawn], rewards)
        out.append({"epoch": epoch, "loss": loss, "mean_reward": float(np.mean(rewards)), "best_reward": max(rewards), "log_z": policy.log_z})
        if keep is not None:
            keep(epoch, policy.save())
    return out


def pool(policy: Policy, score: Callable, size: int, min_coverage: float = 0.5, oversample: int = 5, seed: int = 1) -> list[dict]:
    """The best ``size`` of distinct sampled trees with enough coverage, as rows: factor, expression, tokens, complexity, depth, scores."""
    rng = np.random.default_rng(seed)
    trees = {str(t): t for t, _ in (policy.sample(rng) for _ in range(size * oversample))}
    scored = score(list(trees.values()))
    good = sorted((t for t in trees if scored[t].get("coverage", 0) >= min_coverage), key=lambda t: (-scored[t]["reward"], t))[:size]
    return [{"factor": f"factor_{i + 1:03d}", "expression": t, "tokens": trees[t].to_json(), "complexity": trees[t].complexity(), "depth": trees[t].depth()} | {k: v for k, v in scored[t].items() if k != "factor"} for i, t in enumerate(good)]


def execute_pool(panel: DataFrame, rows: Sequence[dict], language: Language = DAILY, start=None, end=None) -> DataFrame:
    """The factor matrix of a saved pool: date, code and a column per factor, in one plan.

    Factors are computed over the whole panel, so that windows reach back before ``start``; then the dates in [start, end] are kept.
    """
    trees = {r["factor"]: parse(r["tokens"], language) for r in rows}
    return between(minute_factors(panel, trees) if language is MINUTE else daily_factors(panel, trees), start, end)


def execute_stored(spark: SparkSession, pool_path: str, panel_path: str, language: Language = DAILY, start=None, end=None) -> DataFrame:
    """``execute_pool`` of a pool and a panel (bars for minute trees) that lie in files; no dates in [start, end] raises."""
    rows = [r.asDict() for r in store.read(spark, pool_path).select("factor", "tokens").collect()]  # a row per factor
    panel = store.read(spark, panel_path)
    sliced(panel.select("date"), start, end)
    return execute_pool(panel, rows, language, start, end)
