"""Agreement and ranking metrics, bootstrap intervals, leaderboards."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nocturne.functions.numeric import ratio
from nocturne.operators.ordered import running_sums
from nocturne.schemas import LABEL, PROBABILITY, TRUTH

# Study minimum and target of each measure.
TARGETS = {
    "Sensitivity": (0.75, 0.85),
    "Specificity": (0.70, 0.80),
    "AUC_ROC": (0.80, 0.88),
    "Cohen_Kappa": (0.60, 0.70),
}
SENSITIVITY_SQL = "coalesce(try_divide(tp, tp + fn), 0)"
SPECIFICITY_SQL = "coalesce(try_divide(tn, tn + fp), 0)"


def find_truth_column(columns: list[str]) -> str:
    if TRUTH in columns:
        return TRUTH
    near = [c for c in columns if "sleep_deprivation" in c.lower() and c != LABEL]
    if not near:
        raise ValueError(f"no truth column: expected {TRUTH} or a name like it")
    return near[0]


def join_truth(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Inner join on SID; columns both sides have get ``_pred`` and ``_gt``."""
    for side in (predictions, truth):
        if "SID" not in side.columns:
            raise ValueError("both tables need a SID column")
    shared = [c for c in predictions.columns if c in truth.columns and c != "SID"]
    left = predictions.withColumnsRenamed({c: f"{c}_pred" for c in shared})
    right = truth.withColumnsRenamed({c: f"{c}_gt" for c in shared})
    joined = left.join(right, "SID", "inner")
    found = find_truth_column([c for c in joined.columns if c != PROBABILITY])
    return joined if found == TRUTH else joined.withColumnRenamed(found, TRUTH)


def confusion(
    df: DataFrame, keys: tuple[str, ...] = (), truth: str = TRUTH, predicted: str = "prediction"
) -> DataFrame:
    y, p = F.col(truth).cast("int"), F.col(predicted).cast("int")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
    )


def cohen_kappa():
    """Agreement beyond chance from the four counts; NULL when undefined."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    n = tp + tn + fp + fn
    seen = F.try_divide(tp + tn, n)
    chance = F.try_divide((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), n * n)
    return F.try_divide(seen - chance, 1.0 - chance)


def clinical_measures(counts: DataFrame) -> DataFrame:
    """Adds the measures to a table of confusion counts."""
    return counts.withColumns(
        {
            "Sensitivity": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
            "Specificity": ratio(F.col("tn"), F.col("tn") + F.col("fp")),
            "PPV": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "NPV": ratio(F.col("tn"), F.col("tn") + F.col("fn")),
            "Cohen_Kappa": cohen_kappa(),
        }
    )


def clinical_metrics(
    df: DataFrame, keys: tuple[str, ...] = (), truth: str = TRUTH, predicted: str = "prediction"
) -> DataFrame:
    return clinical_measures(confusion(df, keys, truth, predicted))


def roc_auc(
    df: DataFrame,
    keys: tuple[str, ...] = (),
    truth: str = TRUTH,
    score: str = PROBABILITY,
) -> DataFrame:
    """Area under the ROC curve, ties counted half; NULL for a single class.

    Rows are first reduced to one per distinct score.
    """
    y = F.col(truth).cast("int")
    ties = (
        df.filter(y.isNotNull() & F.col(score).isNotNull())
        .groupBy(*keys, F.col(score).alias("_score"))
        .agg(F.count_if(y == 1).alias("_pos"), F.count_if(y == 0).alias("_neg"))
    )
    running = running_sums(ties, list(keys), [F.col("_score")], {"_upto": F.col("_neg")}, F.floor(F.col("_score") * 4096))
    wins = F.sum(F.col("_pos") * (F.col("_upto") - F.col("_neg") / 2))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
    return running.groupBy(*keys).agg(F.try_divide(wins, pairs).alias("AUC_ROC"))


def uniform_draw(seed: int, replicate: int, turn: int) -> float:
    """A number from 0 to 1 by what it counts, so that any engine can draw it again."""
    return int(hashlib.md5(f"{seed}#{replicate}#{turn}".encode()).hexdigest()[:13], 16) / (1 << 52)


def binomial_quantile(n: int, share: float, u: float) -> int:
    """The least number of successes of ``n`` whose probability, with all smaller ones, is above ``u``.

    Probabilities are built up from ratios of neighbours, over the numbers that are not too rare to add anything.
    """
    if n <= 0 or share <= 0:
        return 0
    if share >= 1:
        return n
    spread = 12 * math.sqrt(n * share * (1 - share)) + 60
    low, high = max(0, math.floor(n * share - spread)), min(n, math.ceil(n * share + spread))
    k = np.arange(low + 1, high + 1, dtype=float)
    weight = np.r_[0.0, np.cumsum(np.log((n - k + 1) / k) + math.log(share / (1 - share)))]
    upto = np.cumsum(np.exp(weight - weight.max()))
    return low + int(np.searchsorted(upto / upto[-1], u, "right"))


def resampled(cells: list[int], replicate: int, seed: int) -> list[int]:
    """One multinomial draw: each count binomial among what the counts before it left."""
    out, left, rest = [], sum(cells), sum(cells)
    for turn, n in enumerate(cells[:-1]):
        drawn = binomial_quantile(left, n / rest if rest else 0.0, uniform_draw(seed, replicate, turn))
        out.append(drawn)
        left, rest = left - drawn, rest - n
    return [*out, left]


def bootstrap_ci(
    df: DataFrame,
    metric: str = SENSITIVITY_SQL,
    keys: tuple[str, ...] = (),
    truth: str = TRUTH,
    predicted: str = "prediction",
    n_iter: int = 1000,
    ci: float = 0.95,
    seed: int = 42,
) -> DataFrame:
    """Percentile interval of a metric given as SQL over tp, tn, fp, fn.

    Resampling rows only changes the four counts, and those follow one
    multinomial draw, so a replicate costs about the root of the number of rows. The draws are
    hashes of seed and replicate: the interval is the same in every run, and SQL can repeat it.
    """
    counts = confusion(df, keys, truth, predicted)
    draws = counts.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n_iter - 1)))).repartition(
        "replicate"
    )
    names = ["tp", "tn", "fp", "fn"]

    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = batch[names].to_numpy()
            for row, replicate in enumerate(batch["replicate"].to_numpy()):
                cells[row] = resampled(cells[row].tolist(), int(replicate), seed)
            batch[names] = cells
            yield batch

    sampled = draws.mapInPandas(resample, draws.schema)
    scores = sampled.withColumn("_score", F.expr(metric).cast("double"))
    tail = (1 - ci) / 2
    enough = F.count("_score") >= 50
    ends = F.percentile("_score", [tail, 1 - tail])
    return scores.groupBy(*keys).agg(
        F.count("_score").alias("replicates"),
        F.when(enough, F.round(ends[0], 4)).alias("ci_low"),
        F.when(enough, F.round(ends[1], 4)).alias("ci_high"),
    )


def meets_targets(report: DataFrame) -> DataFrame:
    """One row per measure with the study minimum and target and whether each is met."""
    keep = [c for c in report.columns if c not in TARGETS]
    items = [
        F.struct(
            F.lit(name).alias("measure"),
            F.col(name).cast("double").alias("value"),
            F.lit(low).alias("minimum"),
            F.lit(goal).alias("target"),
            F.coalesce(F.col(name) >= low, F.lit(False)).alias("meets_minimum"),
            F.coalesce(F.col(name) >= goal, F.lit(False)).alias("meets_target"),
        )
        for name, (low, goal) in TARGETS.items()
        if name in report.columns
    ]
    return report.select(*keep, F.explode(F.array(*items)).alias("item")).select(*keep, "item.*")


def side_by_side(*parts: DataFrame) -> DataFrame:
    """One-row tables as one row, without a join that has no key."""
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(f"`{c}`").alias(c) for c in stacked.columns])


def clinical_report(joined: DataFrame, n_iter: int = 1000, seed: int = 42) -> DataFrame:
    """The one-row report: counts, measures, AUC and two intervals."""
    report = side_by_side(
        clinical_metrics(joined),
        roc_auc(joined),
        bootstrap_ci(joined, SENSITIVITY_SQL, n_iter=n_iter, seed=seed).select(
            F.col("ci_low").alias("Sensitivity_low"), F.col("ci_high").alias("Sensitivity_high")
        ),
        bootstrap_ci(joined, SPECIFICITY_SQL, n_iter=n_iter, seed=seed + 1).select(
            F.col("ci_low").alias("Specificity_low"), F.col("ci_high").alias("Specificity_high")
        ),
    )
    rounded = ["Sensitivity", "Specificity", "PPV", "NPV", "AUC_ROC", "Cohen_Kappa"]
    return report.select(
        F.col("n").alias("N"),
        *[F.col(c).alias(c.upper()) for c in ("tp", "tn", "fp", "fn")],
        *[F.bround(F.col(c), 4).alias(c) for c in rounded],
        "Sensitivity_low", "Sensitivity_high", "Specificity_low", "Specificity_high",
    )


def model_metrics(
    df: DataFrame,
    keys: tuple[str, ...] = ("model_name",),
    truth: str = LABEL,
    predicted: str = "prediction",
    score: str = "probability",
) -> DataFrame:
    """Accuracy, F1, precision, recall and AUC per model."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    counts = confusion(df, keys, truth, predicted).select(
        *keys,
        ratio(tp + F.col("tn"), F.col("n")).alias("accuracy"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
    )
    areas = roc_auc(df, keys, truth, score).withColumnRenamed("AUC_ROC", "roc_auc")
    return counts.join(areas, list(keys), "left")


def rank_models(leaderboard: DataFrame) -> DataFrame:
    """Best first by F1, accuracy, AUC; missing last; the name breaks ties."""
    return leaderboard.orderBy(
        F.desc_nulls_last("f1"),
        F.desc_nulls_last("accuracy"),
        F.desc_nulls_last("roc_auc"),
        F.asc("model_name"),
    )


def leaderboard_view(leaderboard: DataFrame, by: str = "f1", active: str | None = None) -> DataFrame:
    """Served form: missing measures as zero, the chosen measure first."""
    cell = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return leaderboard.select(
        F.col("model_name").alias("name"),
        cell("accuracy").alias("accuracy"),
        cell("precision").alias("precision"),
        cell("recall").alias("recall"),
        cell("f1").alias("f1Score"),
        cell("roc_auc").alias("aucRoc"),
        F.lit(0.0).alias("trainTime"),
        F.coalesce(F.col("model_name") == F.lit(active), F.lit(False)).alias("isActive"),
    ).orderBy(F.desc("aucRoc" if by == "roc_auc" else "f1Score"), F.asc("name"))
