"""Risk and quality bands, decisions and target checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band limits and texts of the two risk scales.
RISK_SCALES = {
    "task": ((0.30, "LOW RISK"), (0.65, "MODERATE RISK"), (None, "HIGH RISK")),
    "dashboard": ((0.40, "low"), (0.70, "moderate"), (None, "high")),
}
RISK_LEVELS = ("low", "moderate", "high")
DECISIONS = {
    0: "No strong sleep deprivation signal",
    1: "Likely sleep deprivation / sleep-disordered breathing risk",
}


def risk_band(probability: Column, scale: str = "dashboard") -> Column:
    """Text band of a probability; limits belong to the band above them."""
    steps = RISK_SCALES[scale]
    band = F.lit(steps[-1][1])
    for limit, text in reversed(steps[:-1]):
        band = F.when(probability < limit, text).otherwise(band)
    return F.when(probability.isNotNull(), band)


def quality_band(quality: Column, sessions: Column) -> Column:
    return (
        F.when((quality < 50) | (sessions == 0), "high")
        .when(quality < 70, "moderate")
        .otherwise("low")
    )


def decide(probability: Column, threshold: float = 0.5) -> Column:
    return F.when(probability.isNotNull(), (probability >= threshold).cast("int"))


def decision_text(decision: Column) -> Column:
    return F.when(decision == 0, DECISIONS[0]).when(decision == 1, DECISIONS[1])


def explicit_risk(probability: Column, stated: Column) -> Column:
    """A valid stated level wins over the level of the probability."""
    return F.when(stated.isin(*RISK_LEVELS), stated).otherwise(risk_band(probability))
