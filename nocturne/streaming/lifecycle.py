"""Session life cycle from status messages, and scoring of finished sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nocturne.functions import bands
from nocturne.operators.scoring import with_advice
from nocturne.operators.sessions import new_predictions

# Status texts that end a recording.
FINISHED = ("complete", "completed")
TERMINAL = (*FINISHED, "failed")


def session_state(changes: DataFrame) -> DataFrame:
    """(sid, status, at, seq) to the current state of each session.

    Only maxima are kept, so the result does not depend on arrival order. Works
    on a batch, and on a stream in update or complete mode with one small state
    row per session.
    """
    newest = F.struct("at", "seq")
    return changes.groupBy("sid").agg(
        F.max_by("status", newest).alias("status"),
        F.max(F.when(F.col("status") == "recording", F.col("at"))).alias("started_at"),
        F.max(F.when(F.col("status").isin(*TERMINAL), F.col("at"))).alias("ended_at"),
        F.count(F.lit(1)).alias("changes"),
    )


def finished_sessions(state: DataFrame) -> DataFrame:
    return state.filter(F.col("status").isin(*FINISHED))


def pending_readings(readings: DataFrame, pending: DataFrame) -> DataFrame:
    """Readings of the sessions still to score, so only those are aggregated."""
    return readings.join(pending.select("SID"), "SID", "left_semi")


def prediction_rows(scored: DataFrame, sessions: DataFrame, predictions: DataFrame, model_name: str) -> DataFrame:
    """Scored feature rows as new rows of the predictions table.

    ``scored`` has SID, prediction, probability_sleep_deprivation and the
    features; sessions that already have a finished prediction are left out.
    """
    advised = with_advice(scored)
    rows = advised.join(sessions.select(F.col("id").alias("session_id"), F.col("sid").alias("SID")), "SID").select(
        "session_id",
        F.lit(model_name).alias("model_name"),
        F.col("prediction").cast("int").alias("prediction"),
        F.col("probability_sleep_deprivation").alias("probability"),
        bands.risk_band(F.col("probability_sleep_deprivation"), "task").alias("label"),
        F.to_json("recommendations").alias("recommendations_json"),
        *([F.to_json("top_features").alias("shap_features")] if "top_features" in advised.columns else []),
        F.current_timestamp().alias("created_at"),
    )
    return new_predictions(rows, predictions)
