"""Session, prediction and patient tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nocturne.functions import bands, sleep, text
from nocturne.functions.numeric import clamp, half_up, leading_number
from nocturne.operators.ordered import in_chunks, slot_of
from nocturne.schemas import ADVICE, IMPACTS

PRIVILEGED = ("clinician", "admin")
DETAIL_FEATURES = ("HR_mean", "HR_std", "EDA_mean", "TEMP_mean", "event_rate")


def scope_to_user(df: DataFrame, user_id: int, role: str, owner: str = "user_id") -> DataFrame:
    return df if role in PRIVILEGED else df.filter(F.col(owner) == user_id)


def search(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    return df.filter(text.mentions(query, *[F.col(c) for c in columns]))


def page(df: DataFrame, order: list[Column], skip: int = 0, limit: int = 50) -> DataFrame:
    """A page of a fully ordered listing: each task keeps skip + limit rows at most."""
    return df.orderBy(*order).offset(skip).limit(limit)


def latest_prediction(predictions: DataFrame, newest: list[str], key: str = "session_id") -> DataFrame:
    """The newest row per session; tasks pre-select before the shuffle."""
    window = Window.partitionBy(key).orderBy(*[F.desc(c) for c in newest])
    return (
        predictions.withColumn("_place", F.row_number().over(window)).filter("_place = 1").drop("_place")
    )


def scored_sessions(sessions: DataFrame, predictions: DataFrame) -> DataFrame:
    """Sessions with an owner joined to their predictions that have a probability."""
    owned = sessions.filter(F.col("user_id").isNotNull()).select(
        F.col("id").alias("session_id"), "sid", "user_id", F.col("created_at").alias("session_at")
    )
    present = predictions.filter(F.col("probability").isNotNull())
    return owned.join(present, "session_id", "inner")


def trend(scored: DataFrame, newest: list[str], n: int = 7, owner: str = "user_id") -> DataFrame:
    """The last ``n`` scored rows of each owner, numbered in time order."""
    window = Window.partitionBy(owner).orderBy(*[F.desc(c) for c in newest])
    recent = scored.withColumn("_back", F.row_number().over(window)).filter(F.col("_back") <= n)
    size = F.count(F.lit(1)).over(Window.partitionBy(owner))
    return recent.withColumn("day", (size - F.col("_back") + 1).cast("int")).drop("_back")


def trend_change(
    df: DataFrame,
    value: str,
    oldest: list[str],
    n: int = 7,
    owner: str = "user_id",
) -> DataFrame:
    """Mean of the last ``n`` rows and its change against the ``n`` rows before."""
    order = [F.asc(c) for c in oldest]
    rows, parts = in_chunks(df, [owner], order, slot_of(df, oldest[0]), 2 * n - 1)
    window = Window.partitionBy(*parts).orderBy(*order)
    now = F.avg(value).over(window.rowsBetween(1 - n, 0))
    before = F.avg(value).over(window.rowsBetween(1 - 2 * n, -n))
    framed = rows.withColumns({"trend_score": now, "previous_score": before}).filter(~F.col("_halo"))
    return framed.select(
        *df.columns, "trend_score", (F.col("trend_score") - F.col("previous_score")).alias("trend_change")
    )


def new_predictions(results: DataFrame, predictions: DataFrame, key: str = "session_id") -> DataFrame:
    """Results for sessions that have no finished prediction yet.

    The right side is made distinct first, so a session with very many
    predictions is one row in the join.
    """
    finished = predictions.filter(F.col("prediction").isNotNull()).select(key).distinct()
    return results.join(finished, key, "left_anti")


def reject_existing(new: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """New rows whose key is free; one row per key."""
    return new.dropDuplicates([key]).join(current.select(key).distinct(), key, "left_anti")


def session_report(own: DataFrame, shared: DataFrame, key: str = "SID") -> DataFrame:
    """A session's own rows, else its rows in the shared table."""
    return own.unionByName(shared.join(own.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def dashboard_sessions(
    sessions: DataFrame, predictions: DataFrame, features: DataFrame, newest: list[str]
) -> DataFrame:
    """Every session with its newest prediction and features, absent ones zero."""
    latest = latest_prediction(predictions, newest).select(
        F.col("session_id").alias("id"), F.col("probability"), "model_name", "shap_features"
    )
    shares = {n: f"sleep_stage_pct_{c}" for n, c in sleep.STAGE_FIELDS.items()}
    measured = features.select(
        F.col("SID").alias("sid"),
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in DETAIL_FEATURES],
        sleep.sleep_efficiency(F.col("sleep_stage_pct_W"), F.col("event_rate")).alias("sleep_efficiency"),
        *[sleep.stage_percent(F.col(c)).alias(n) for n, c in shares.items()],
    )
    zero = lambda c, z: F.coalesce(F.col(c), F.lit(z)).alias(c)
    joined = sessions.join(latest, "id", "left").join(measured, "sid", "left")
    risk = F.coalesce(F.col("probability"), F.lit(0.0))
    return joined.select(
        "id",
        "sid",
        "user_id",
        "created_at",
        text.iso(F.col("created_at")).alias("date"),
        text.minutes(F.col("duration_seconds")).alias("duration"),
        risk.alias("riskProbability"),
        bands.risk_band(risk).alias("riskLevel"),
        text.known_status(F.col("status")).alias("status"),
        *[zero(c, 0.0) for c in DETAIL_FEATURES],
        zero("sleep_efficiency", 0.0),
        *[zero(n, 0) for n in shares],
        "model_name",
        "shap_features",
    )


def session_detail(dashboard: DataFrame) -> DataFrame:
    """Dashboard rows in nested form, stored JSON parsed."""
    advice = (
        text.safe_json(F.col("recommendations_json"), ADVICE)
        if "recommendations_json" in dashboard.columns
        else F.array().cast(ADVICE)
    )
    return dashboard.select(
        "sid", "date", "duration", "riskProbability", "riskLevel", "status",
        F.struct(*sleep.STAGE_FIELDS).alias("sleepStages"),
        F.struct(*DETAIL_FEATURES, "sleep_efficiency").alias("features"),
        F.struct(
            "model_name",
            advice.alias("recommendations"),
            text.safe_json(F.col("shap_features"), IMPACTS).alias("shap_top_features"),
        ).alias("prediction"),
    )


def dashboard_summary(dashboard: DataFrame) -> DataFrame:
    return dashboard.agg(
        F.coalesce(F.avg("riskProbability"), F.lit(0.0)).alias("avgRisk"),
        F.coalesce(F.avg("sleep_efficiency"), F.lit(0.0)).alias("avgEfficiency"),
        F.coalesce(F.avg("n3"), F.lit(0.0)).alias("avgDeepSleep"),
        F.count(F.lit(1)).alias("totalSessions"),
        text.iso(F.max("created_at")).alias("lastSessionDate"),
    )


def patient_rollup(users: DataFrame, dashboard: DataFrame) -> DataFrame:
    """One row per patient, with or without sessions.

    Sessions are reduced per owner before the join, so a busy owner is one row.
    """
    per_owner = dashboard.groupBy(F.col("user_id").alias("id")).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.avg("sleep_efficiency").alias("efficiency"),
        F.max("date").alias("last"),
        F.avg("duration").alias("minutes"),
    )
    patients = users.filter(F.col("role") == "patient").join(per_owner, "id", "left")
    count = F.coalesce(F.col("sessions"), F.lit(0))
    quality = F.coalesce(half_up(F.col("efficiency")), F.lit(0))
    return patients.select(
        "id",
        "name",
        "email",
        bands.quality_band(quality, count).alias("riskLevel"),
        F.coalesce(F.col("last"), F.lit("No sessions")).alias("lastSession"),
        count.alias("sessionsCount"),
        quality.cast("int").alias("avgQuality"),
        F.round(F.coalesce(F.col("minutes"), F.lit(0.0)) / 60, 1).alias("avgHours"),
    )


def cohort_kpis(rollup: DataFrame) -> DataFrame:
    high = F.count_if(F.col("riskLevel") == "high")
    moderate = F.count_if(F.col("riskLevel") == "moderate")
    total = F.count(F.lit(1))
    return rollup.agg(
        total.alias("total"),
        high.alias("high"),
        moderate.alias("moderate"),
        (total - high - moderate).alias("low"),
    )


def normalise_sessions(raw: DataFrame, now: str) -> DataFrame:
    """Stored session texts to typed rows; rows without an id are dropped.

    ``raw`` holds text columns; NULL means the field is absent. ``now`` is the
    date for rows that state none.
    """
    texts = ["riskProbability", "riskScore", "sleep_efficiency", "sleepQuality"]
    numbers = [c for c in (*sleep.STAGE_FIELDS, *DETAIL_FEATURES, *texts) if c in raw.columns]
    # In steps, so that each text is parsed once.
    parsed = raw.filter(text.filled(F.col("id")).isNotNull()).select(
        "id",
        "status",
        F.coalesce(text.filled(F.col("sid")), F.col("id")).alias("sid"),
        F.coalesce(text.filled(F.col("date")), text.filled(F.col("createdAt")), F.lit(now)).alias("date"),
        text.parse_duration(F.col("duration")).alias("duration"),
        F.coalesce(F.col("riskLevel"), F.col("risk")).alias("stated"),
        *[F.col(c).isNotNull().alias(f"has_{c}") for c in texts],
        *[F.coalesce(leading_number(F.col(c)), F.lit(0.0)).alias(c) for c in numbers],
    )
    chosen = parsed.withColumns(
        {
            "riskProbability": F.when(F.col("has_riskProbability"), F.col("riskProbability")).otherwise(
                F.col("riskScore") / 100
            ),
            "sleep_efficiency": F.when(F.col("has_sleep_efficiency"), F.col("sleep_efficiency")).otherwise(
                clamp(F.col("sleepQuality"), 0.0, 100.0)
            ),
        }
    ).withColumn("riskProbability", clamp(F.col("riskProbability"), 0.0, 1.0))
    return chosen.select(
        "id", "sid", "date", "duration", "riskProbability",
        bands.explicit_risk(F.col("riskProbability"), F.col("stated")).alias("riskLevel"),
        text.known_status(F.col("status")).alias("status"),
        *[c for c in numbers if c not in texts],
        "sleep_efficiency",
    )
