"""Rows to score and what is added to scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nocturne.functions import bands, rules
from nocturne.schemas import PROBABILITY


def inference_rows(features: DataFrame, participants: DataFrame, requested: DataFrame) -> DataFrame:
    """Feature rows of the requested SIDs overlaid on their participant row.

    Of several participant rows with one SID the first counts. Use
    ``missing_requests`` for requested SIDs that have no row.
    """
    wanted = requested.select("SID").distinct()
    first = Window.partitionBy("SID").orderBy(*[F.col(f"`{c}`") for c in participants.columns if c != "SID"])
    people = (
        participants.join(wanted, "SID", "left_semi")
        .withColumn("_place", F.row_number().over(first))
        .filter("_place = 1")
        .drop("_place")
    )
    overlay = [c for c in people.columns if c == "SID" or c not in features.columns]
    return features.join(people.select(*[f"`{c}`" for c in overlay]), "SID", "inner")


def missing_requests(features: DataFrame, participants: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested SIDs with the table that lacks them."""
    wanted = requested.select("SID").distinct()
    no_person = wanted.join(participants.select("SID"), "SID", "left_anti").withColumn(
        "missing_in", F.lit("participants")
    )
    no_reading = wanted.join(features.select("SID"), "SID", "left_anti").withColumn(
        "missing_in", F.lit("features")
    )
    return no_person.unionByName(no_reading)


def with_decision(df: DataFrame, probability: str = PROBABILITY, threshold: float = 0.5) -> DataFrame:
    """Adds the class, its text and the risk band of a probability."""
    return df.withColumn("prediction", bands.decide(F.col(probability), threshold)).withColumns(
        {
            "prediction_label": bands.decision_text(F.col("prediction")),
            "risk": bands.risk_band(F.col(probability), "task"),
        }
    )


def with_advice(df: DataFrame, table=rules.SERVICE_RULES, default=rules.SERVICE_DEFAULT) -> DataFrame:
    """Adds the recommendation array; columns a rule names but the table lacks never fire."""
    named = {
        c
        for c in (
            "sleep_stage_pct_N3", "event_rate", "HR_mean", "EDA_std", "sleep_stage_pct_R",
            "sleep_stage_pct_W", "n3", "rem", "sleep_efficiency",
        )
        if any(c in r.condition for r in table)
    }
    absent = [c for c in named if c not in df.columns]
    widened = df.withColumns({c: F.lit(None).cast("double") for c in absent}) if absent else df
    return widened.withColumn("recommendations", rules.advice(table, default)).drop(*absent)


def top_features(impacts: Column, k: int = 3) -> Column:
    """The ``k`` entries with the largest absolute impact, names break ties.

    ``impacts`` is ARRAY<STRUCT<feature, impact>>; the sort stays in the row.
    """
    keyed = F.transform(
        impacts,
        lambda e: F.struct(
            (-F.abs(e["impact"])).alias("rank"), e["feature"].alias("feature"), F.abs(e["impact"]).alias("impact")
        ),
    )
    best = F.slice(F.sort_array(keyed), 1, k)
    return F.transform(best, lambda e: F.struct(e["feature"].alias("feature"), e["impact"].alias("impact")))


def importance(df: DataFrame, impacts: str = "impacts", limit: int | None = 15) -> DataFrame:
    """Mean absolute impact per feature over all rows, largest first."""
    rows = df.select(F.explode(impacts).alias("e")).select("e.feature", F.abs("e.impact").alias("size"))
    out = rows.groupBy("feature").agg(F.avg("size").alias("mean_abs_impact"))
    ordered = out.orderBy(F.desc("mean_abs_impact"), F.asc("feature"))
    return ordered if limit is None else ordered.limit(limit)
