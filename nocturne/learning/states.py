"""Classifier of sequences by hidden states that follow one another.

Each class has a Markov chain of hidden states with normally distributed nights. A sequence belongs to the class under
which it is likelier, so the order of its nights counts, not only which nights there were. Training is
Baum-Welch: a pass over the rows adds up expected states, changes and moments, a fixed number of sums
whatever the number of rows, and the driver updates the chains from them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least variance of a feature in a state, of standardised inputs.
FLOOR = 0.05

Chain = dict[str, np.ndarray]  # start (K), change (K, K), mean (K, D), variance (K, D)


def _log_density(x: np.ndarray, chain: Chain) -> np.ndarray:
    """Rows x steps x states."""
    mean, variance = chain["mean"], chain["variance"]
    square = ((x[:, :, None, :] - mean) ** 2 / variance).sum(-1)
    return -0.5 * (square + np.log(2 * np.pi * variance).sum(-1))


def expected_states(x: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood of each row, probability of each state at each step, and summed changes (K, K).

    Forward and backward sums, scaled at every step, for all rows at once.
    """
    density = _log_density(x, chain)
    top = density.max(axis=2, keepdims=True)
    density = np.exp(density - top)
    rows, steps, states = density.shape
    forward, scale = np.empty_like(density), np.empty((rows, steps))
    for t in range(steps):
        reached = chain["start"] if t == 0 else forward[:, t - 1] @ chain["change"]
        forward[:, t] = reached * density[:, t]
        scale[:, t] = forward[:, t].sum(axis=1)
        forward[:, t] /= scale[:, t, None]
    backward = np.ones_like(density)
    changes = np.zeros((states, states))
    for t in range(steps - 2, -1, -1):
        after = density[:, t + 1] * backward[:, t + 1] / scale[:, t + 1, None]
        changes += chain["change"] * (forward[:, t].T @ after)
        backward[:, t] = after @ chain["change"].T
    return (np.log(scale) + top[:, :, 0]).sum(axis=1), forward * backward, changes


def _sums(x: np.ndarray, chain: Chain) -> np.ndarray:
    likelihood, states, changes = expected_states(x, chain)
    weight = states.sum(axis=(0, 1))
    first, second = (np.einsum("ntk,ntd->kd", states, v) for v in (x, x * x))
    return np.concatenate([[likelihood.sum(), len(x)], states[:, 0].sum(axis=0), changes.ravel(), weight, first.ravel(), second.ravel()])


def updated(sums: np.ndarray, states: int, width: int) -> Chain:
    """The chain of greatest likelihood given the expected sums; a state hardly used keeps a little of everything."""
    parts = np.split(sums[2:], np.cumsum([states, states * states, states, states * width]))
    start, changes, weight = parts[0] + 0.1, parts[1].reshape(states, states) + 0.1, parts[2][:, None] + 1e-9
    mean, second = (p.reshape(states, width) / weight for p in parts[3:5])
    return {
        "start": start / start.sum(),
        "change": changes / changes.sum(axis=1, keepdims=True),
        "mean": mean,
        "variance": np.maximum(second - mean**2, FLOOR),
    }


def _rows_sums(rows: DataFrame, chains: list[Chain], steps: int) -> list[np.ndarray]:
    """The sums of each class over all its rows."""
    shared = rows.sparkSession.sparkContext.broadcast(chains)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: list = [0.0, 0.0]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, steps, -1)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                if (y == c).any():
                    totals[c] = totals[c] + _sums(x[y == c], shared.value[c])
        for c, total in enumerate(totals):
            if isinstance(total, np.ndarray):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(total), c, np.int32)), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)],
                    names=["y", "at", "v"],
                )

    found = rows.mapInArrow(add, "y int, at int, v double").groupBy("y", "at").agg(F.sum("v").alias("v")).collect()
    out: list[dict[int, float]] = [{}, {}]
    for r in found:
        out[r["y"]][r["at"]] = r["v"]
    return [np.array([v for _, v in sorted(part.items())]) for part in out]


def _first_chains(rows: DataFrame, states: int, steps: int) -> list[Chain]:
    """Chains whose states are the sequence's parts one after another, with the parts' own moments."""
    width = len(rows.first()["x"]) // steps
    cells = rows.select("y", F.posexplode("x").alias("at", "v")).withColumn("part", F.floor(F.floor(F.col("at") / width) * states / steps))
    moments = cells.groupBy("y", "part", (F.col("at") % width).alias("d")).agg(F.avg("v").alias("m"), F.var_pop("v").alias("s")).collect()
    chains = []
    for c in (0, 1):
        mean, variance = np.zeros((states, width)), np.ones((states, width))
        for r in moments:
            if r["y"] == c:
                mean[r["part"], r["d"]], variance[r["part"], r["d"]] = r["m"], max(r["s"], FLOOR)
        change = np.full((states, states), 0.1 / states) + 0.6 * np.eye(states) + 0.3 * np.eye(states, k=1)
        chains.append({"start": np.r_[0.7, np.full(states - 1, 0.3 / max(states - 1, 1))] if states > 1 else np.ones(1),
                       "change": change / change.sum(axis=1, keepdims=True), "mean": mean, "variance": variance})
    return chains


class SequenceStatesModel(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    chains = Param(Params._dummy(), "chains", "both classes' chains and the log odds, as JSON", TypeConverters.toString)
    steps = Param(Params._dummy(), "steps", "steps of a sequence", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, chains: str = "{}", steps: int = 7, featuresCol: str = "features"):
        super().__init__()
        self._set(chains=chains, steps=steps, featuresCol=featuresCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        held, steps = json.loads(self.getOrDefault(self.chains)), self.getOrDefault(self.steps)
        chains = [{k: np.array(v) for k, v in chain.items()} for chain in held["chains"]]
        odds = held["odds"]

        @F.pandas_udf("double")
        def share(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=float)
            x = np.vstack(vectors.to_numpy()).astype(float).reshape(len(vectors), steps, -1)
            likelihood = [expected_states(x, chain)[0] for chain in chains]
            margin = np.clip((likelihood[1] - likelihood[0]) / steps + odds, -700, 700)
            return pd.Series(1.0 / (1.0 + np.exp(-margin)))

        out = dataset.withColumn("_p", share(vector_to_array(F.col(self.getFeaturesCol()))))
        return out.withColumns(
            {
                "probability": array_to_vector(F.array(1.0 - F.col("_p"), F.col("_p"))),
                "prediction": (F.col("_p") >= 0.5).cast("double"),
            }
        ).drop("_p")


class SequenceStates(Estimator, HasFeaturesCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """The features hold a sequence step after step; all steps have the same inputs, standardised."""

    steps = Param(Params._dummy(), "steps", "steps of a sequence", TypeConverters.toInt)
    states = Param(Params._dummy(), "states", "hidden states of a class", TypeConverters.toInt)
    rounds = Param(Params._dummy(), "rounds", "passes at most", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, steps: int = 7, states: int = 4, rounds: int = 12, featuresCol: str = "features", labelCol: str = "label"):
        super().__init__()
        self._set(steps=steps, states=states, rounds=rounds, featuresCol=featuresCol, labelCol=labelCol)

    def _fit(self, dataset: DataFrame) -> SequenceStatesModel:
        steps, states = self.getOrDefault(self.steps), self.getOrDefault(self.states)
        x, y = vector_to_array(F.col(self.getFeaturesCol())), F.col(self.getLabelCol()).cast("int")
        rows = dataset.select(x.alias("x"), y.alias("y")).filter("y in (0, 1)").persist()
        if rows.select("y").distinct().count() < 2:
            raise ValueError("sequences of two classes are needed")
        chains, last = _first_chains(rows, states, steps), -np.inf
        width = chains[0]["mean"].shape[1]
        for _ in range(self.getOrDefault(self.rounds)):
            sums = _rows_sums(rows, chains, steps)
            chains = [updated(s, states, width) for s in sums]
            likelihood = sum(s[0] for s in sums)
            if likelihood - last < 1e-4 * abs(likelihood):
                break
            last = likelihood
        rows.unpersist()
        odds = float(np.log(sums[1][1] / sums[0][1]))
        held = {"chains": [{k: v.tolist() for k, v in chain.items()} for chain in chains], "odds": odds}
        return SequenceStatesModel(chains=json.dumps(held), steps=steps, featuresCol=self.getFeaturesCol())
