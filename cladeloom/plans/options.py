"""Run options and the combinations that make no sense together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from cladeloom.operators.sampling import METHODS

DRIFT_MODES = ("legacy", "inplace", "combine", "combine-lwf", "auto")
SELECTORS = ("best", "uniform", "weighted")
# Seed of the drift phase, apart from the search seed.
DRIFT_SEED = 7919


@dataclass(frozen=True)
class WalkOptions:
    max_steps: int = 10
    radius: int = 0
    accept_threshold: int = 0
    worsening_budget: int | None = None
    selector: str = "best"
    every_step: bool = False
    temperature: float = 1.0
    cooling: float = 0.9

    def __post_init__(self):
        if self.selector not in SELECTORS:
            raise ValueError(f"selector must be one of {', '.join(SELECTORS)}")
        if self.max_steps < 1 or self.radius < 0:
            raise ValueError("max_steps must be positive and radius not negative")


@dataclass(frozen=True)
class SearchOptions:
    """``max_moves`` 0 keeps every move; ``producer`` replaces the move search: it
    takes (index, radius, threshold) and returns (dag_id, src, dst, score)."""

    iterations: int = 1
    max_moves: int = 50
    max_radius: int = 0
    method: str = "parsimony"
    uniform: bool = False
    seed: int = 42
    score_coeff: int = 1
    node_coeff: int = 0
    likelihood_coeff: float = 0.0
    model: object | None = None
    patience: int | None = None
    sample_per_radius: bool = False
    strategy: str = "native"
    producer: Callable | None = None
    random_attempts: int = 100
    random_keep: int = 10
    subtree_leaves: tuple[int, int] | None = None
    drift_rounds: int = 0
    drift_mode: str = "legacy"
    drift_seed: int = DRIFT_SEED
    drift_walk: WalkOptions = WalkOptions(selector="uniform")
    trim: bool = False
    diverse: int = 0
    pool: int = 100

    def __post_init__(self):
        def need(ok: bool, text: str):
            if not ok:
                raise ValueError(text)

        need(self.method in METHODS, f"unknown sampling method {self.method!r}")
        need(self.strategy in ("native", "random"), "strategy is native or random")
        need(self.drift_mode in DRIFT_MODES, f"drift mode is one of {', '.join(DRIFT_MODES)}")
        need(self.iterations >= 0 and self.max_moves >= 0, "iterations and max_moves must not be negative")
        need(not (self.trim and self.diverse), "trim and diverse exclude each other")
        need(not self.diverse or self.pool >= self.diverse, "the pool must hold at least the diverse trees")
        parsimony = self.method in ("parsimony", "parsimony-ua-free")
        need(parsimony or not (self.drift_rounds or self.trim or self.diverse),
             "drift, trim and diverse need a parsimony method")
        need(self.method != "ml" or self.model is not None, "the ml method needs a model")
        need(not self.likelihood_coeff or self.model is not None, "a likelihood coefficient needs a model")
        need(not (self.likelihood_coeff and self.node_coeff), "likelihood and node rescoring exclude each other")
        need(self.strategy == "native" or not (self.drift_rounds or self.sample_per_radius),
             "drift and per-radius sampling need the native strategy")


@dataclass(frozen=True)
class ReportOptions:
    edge_penalties: str | None = None
    trim: str | None = None
    sample: str | None = None

    def __post_init__(self):
        if self.edge_penalties and (self.trim or self.sample):
            raise ValueError("edge penalties cannot be combined with trim or sample")
        if self.trim and self.sample:
            raise ValueError("trim and sample exclude each other")
