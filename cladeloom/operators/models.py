"""Mutation models: a k-mer table joined in SQL, and a small convolutional net.

The net runs in vectorised pandas batches with its weights (a few thousand
floats) in the closure; every distinct sequence pair is scored once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeloom.functions.bases import BASES
from cladeloom.operators.likelihood import CSP_FLOOR, kmer_table_loglik
from cladeloom.sources.models import read_pth, read_yaml

MASK = -1e9
#: Sequences of one pass through the network: bounds the windows held at once.
PASS = 64


def kmer_table(spark: SparkSession, log_rates: np.ndarray, logits: np.ndarray) -> DataFrame:
    """(kmer, rate, logits) rows of a k-mer model: 4**k + 1 of them."""
    rows = [
        (i, float(np.exp(r)), [float(x) for x in s])
        for i, (r, s) in enumerate(zip(log_rates.ravel(), logits))
    ]
    return spark.createDataFrame(rows, "kmer int, rate double, logits array<double>")


@dataclass(frozen=True)
class KmerModel:
    table: DataFrame
    k: int
    site_count: int
    rate_bias: float = 0.0

    def loglik(self, pairs: DataFrame) -> DataFrame:
        return kmer_table_loglik(pairs, self.table, self.k, self.site_count, self.rate_bias)


def softmax_rows(x: np.ndarray) -> np.ndarray:
    if not np.isfinite(x).all():
        raise ValueError("softmax input must be finite")
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def encode(seq: str, k: int, sites: int) -> tuple[np.ndarray, np.ndarray]:
    """k-mer numbers and base codes (4 = unknown) of the first ``sites`` positions."""
    codes = np.array([BASES.find(c) if c in BASES else 4 for c in seq.upper()], dtype=np.int64)
    half = k // 2
    wide = np.concatenate([np.full(half, 4), codes, np.full(half + max(0, sites - len(codes)), 4)])
    windows = np.lib.stride_tricks.sliding_window_view(wide, k)[:sites]
    number = (windows * 4 ** np.arange(k - 1, -1, -1)).sum(axis=1)
    return np.where((windows == 4).any(axis=1), 4**k, number), codes[:sites]


def poisson_loglik(rates: np.ndarray, csp: np.ndarray, parent: np.ndarray, child: np.ndarray) -> float:
    """Log-likelihood of one edge from per-site rates and substitution odds."""
    n = min(len(parent), len(child), len(rates))
    spot = np.flatnonzero(parent[:n] != child[:n])
    if not len(spot):
        return 0.0
    if not np.isfinite(rates[:n]).all() or (rates[:n] <= 0).any():
        raise ValueError("mutation rates must be positive and finite")
    if (child[spot] > 3).any() or (parent[spot] > 3).any():
        raise ValueError("mutated site with an unknown base")
    m = len(spot)
    odds = np.maximum(csp[spot, child[spot]], CSP_FLOOR)
    return float(m * np.log(m / rates[:n].sum()) - m + np.log(rates[spot] * odds).sum())


@dataclass(frozen=True)
class ConvModel:
    """Embedding, same-padded convolution and ReLU, three times: a shared path,
    one for rates and one for substitution odds."""

    weights: dict
    k: int
    site_count: int
    rate_bias: float = 0.0

    def _features(self, prefix: str, kmers: np.ndarray) -> np.ndarray:
        """(sequence, site, channel): the convolution of all sequences as one product over their windows."""
        w = self.weights
        emb = w[f"{prefix}kmer_embedding.weight"][kmers]
        conv, bias = w[f"{prefix}conv.weight"], w[f"{prefix}conv.bias"]
        width = conv.shape[2]
        padded = np.pad(emb, ((0, 0), (width // 2, width - 1 - width // 2), (0, 0)))
        seen = np.lib.stride_tricks.sliding_window_view(padded, width, axis=1)
        n, sites = kmers.shape
        flat = seen.reshape(n * sites, -1) @ conv.reshape(len(conv), -1).T
        return np.maximum(flat.reshape(n, sites, -1) + bias, 0)

    def forward_all(self, seqs: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rates, substitution odds and base codes of the first ``site_count`` sites of every sequence."""
        w, out = self.weights, []
        for at in range(0, len(seqs), PASS):
            encoded = [encode(s, self.k, self.site_count) for s in seqs[at : at + PASS]]
            kmers = np.stack([k for k, _ in encoded])
            shared = self._features("", kmers)
            rate = shared @ w["linear.weight"].T + w["linear.bias"]
            rate = rate + self._features("r_", kmers) @ w["r_linear.weight"].T + w["r_linear.bias"]
            odds = (shared + self._features("s_", kmers)) @ w["s_linear.weight"].T + w["s_linear.bias"]
            odds = odds.astype(float)
            codes = np.full(kmers.shape, 4)
            for i, (_, c) in enumerate(encoded):
                codes[i, : len(c)] = c
            known = np.nonzero(codes < 4)
            odds[(*known, codes[known])] += MASK
            rates, csp = np.exp(rate[..., 0] + self.rate_bias), softmax_rows(odds)
            out += [(r, c, own) for r, c, (_, own) in zip(rates, csp, encoded)]
        return out

    def forward(self, seq: str) -> tuple[np.ndarray, np.ndarray]:
        return self.forward_all([seq])[0][:2]

    def loglik(self, pairs: DataFrame) -> DataFrame:
        model = self

        @F.pandas_udf("double")
        def score(parent: pd.Series, child: pd.Series) -> pd.Series:
            own = list(dict.fromkeys(parent))
            known = dict(zip(own, model.forward_all(own)))
            ends = (encode(c, model.k, model.site_count)[1] for c in child)
            return pd.Series([poisson_loglik(*known[p], c) for p, c in zip(parent, ends)], dtype="float64")

        # Few but costly rows: hash-spread by parent so that its children share a forward pass.
        todo = pairs.select("parent_seq", "child_seq").distinct()
        todo = todo.where(F.col("parent_seq") != F.col("child_seq"))
        todo = todo.repartition("parent_seq", F.pmod(F.xxhash64("child_seq"), F.lit(16))).sortWithinPartitions("parent_seq")
        return todo.withColumn("loglik", score("parent_seq", "child_seq"))


def load_model(spark: SparkSession, prefix: str, rate_bias: float = 0.0):
    """The model described by ``<prefix>.yml`` with weights ``<prefix>-libtorch.pth``."""
    with open(f"{prefix}.yml", encoding="utf-8") as f:
        conf = read_yaml(f.read())
    weights = read_pth(f"{prefix}-libtorch.pth")
    k, sites = int(conf["encoder_parameters.kmer_length"]), int(conf["encoder_parameters.site_count"])
    kind = conf["model_class"]
    if kind == "RSFivemerModel":
        table = kmer_table(spark, weights["r_kmer_embedding.weight"], weights["s_kmer_embedding.weight"])
        return KmerModel(table, k, sites, rate_bias)
    if kind == "IndepRSCNNModel":
        return ConvModel(weights, k, sites, rate_bias)
    raise ValueError(f"unknown model class {kind}")
