"""End-to-end jobs: each reads tables or folders, runs operators and writes results."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nocturne.learning import attribution
from nocturne.learning.longitudinal import train_longitudinal
from nocturne.learning.preprocess import FEATURES
from nocturne.learning.training import Trained, load_bundle, save_bundle, score, train_and_select
from nocturne.operators import features, fill, labels, metrics, profile, scoring, sequences, sessions
from nocturne.schemas import CLINICAL_NUMBERS, HOURS, LABEL, NEW_PREDICTIONS, PROFILE_COLUMNS, TRUTH
from nocturne.sources import recordings, sinks, tables
from nocturne.streaming import lifecycle
from nocturne.streaming import live as feed


def labelled_participants(participants: DataFrame) -> DataFrame:
    return labels.with_recommended_hours(labels.deprivation_label(participants))


def build_features(readings: DataFrame, participants: DataFrame) -> DataFrame:
    return features.join_participants(
        features.recording_features(readings), labelled_participants(participants)
    )


def features_from_tables(spark: SparkSession, readings: DataFrame, participants: DataFrame, out: str) -> DataFrame:
    """The raw and the filled feature table of readings in our layout.

    The raw table is written once and read back for the medians and the empty
    check, so the readings are aggregated once.
    """
    root = out.rstrip("/")
    sinks.write_features(build_features(readings, participants), f"{root}/features_raw")
    stored = features.require_rows(
        tables.read_features(spark, f"{root}/features_raw"),
        "no recording matches a participant: check the SIDs",
    )
    sinks.write_features(fill.apply_fill(stored, fill.fit_fill(stored)), f"{root}/features")
    return tables.read_features(spark, f"{root}/features")


def preprocess(spark: SparkSession, folder: str, participants: str, out: str) -> DataFrame:
    """Recordings and participants to the raw and the filled feature table."""
    return features_from_tables(
        spark, recordings.read_readings(spark, folder), tables.read_participants(spark, participants), out
    )


def profile_tables(df: DataFrame) -> dict[str, DataFrame]:
    """Overview, missing cells, correlations, class counts and clinical histograms."""
    numeric = fill.numeric_columns(df)
    out = {
        "overview": profile.describe_all(df),
        "missing": profile.missing_profile(df),
        "correlation": profile.corr_matrix(df, numeric),
        "curated_correlation": profile.corr_matrix(df, [c for c in PROFILE_COLUMNS if c in df.columns]),
        "classes": profile.class_counts(df, LABEL),
    }
    for c in CLINICAL_NUMBERS:
        if c in df.columns and c != "AGE":
            out[f"histogram_{c.replace(' ', '_')}"] = profile.histogram(df, c)
    return out


def run_profile(spark: SparkSession, table: str, out: str) -> None:
    sinks.write_profile(profile_tables(tables.read_features(spark, table)), out)


def train(spark: SparkSession, table: str, out: str, **options) -> Trained:
    trained = train_and_select(tables.read_features(spark, table), **options)
    summary = spark.createDataFrame(
        [(trained.best, trained.train_size + trained.test_size, trained.train_size, trained.test_size)],
        "best_model string, num_rows long, train_size long, test_size long",
    )
    nested = trained.leaderboard.agg(F.collect_list(F.struct("*")).alias("leaderboard"))
    sinks.write_training(
        trained.leaderboard, metrics.side_by_side(summary, nested), out
    )
    save_bundle(spark, trained, f"{out.rstrip('/')}/bundle")
    return trained


def attributed(df: DataFrame, model: PipelineModel, meta: dict) -> DataFrame:
    """Adds ``top_features`` of the chosen model, against the background kept in the bundle."""
    prepared, last = df, model.stages[-1]
    for stage in model.stages[:-1]:
        prepared = stage.transform(prepared)
    told = attribution.attribute(prepared.select("SID", FEATURES), last, meta["centre"], meta["feature_names"])
    top = told.select("SID", scoring.top_features(F.col("impacts")).alias("top_features"))
    return df.join(top, "SID")


def predict(
    spark: SparkSession, readings: DataFrame, participants: DataFrame, requested: DataFrame, bundle: str, out: str
) -> DataFrame:
    """Scores the requested SIDs, with bands, advice and attribution.

    Each run appends its rows under its own ``run_id``; earlier runs' rows stay, and
    ``sinks.newest_by_sid`` tells the current one of a SID. Returns this run's rows.
    """
    return _predict(spark, readings, participants, requested, load_bundle(spark, bundle), out)


def _predict(
    spark: SparkSession, readings: DataFrame, participants: DataFrame, requested: DataFrame, loaded: tuple[PipelineModel, dict], out: str
) -> DataFrame:
    root = out.rstrip("/")
    run_id, now = uuid.uuid4().hex, datetime.now(timezone.utc)
    stamped = {"run_id": F.lit(run_id), "scored_at": F.lit(now).cast("timestamp")}
    mine = F.col("run_id") == run_id
    model, meta = loaded
    wanted = requested.select("SID").distinct()
    rows = features.recording_features(lifecycle.pending_readings(readings, wanted))
    people = labelled_participants(participants)
    inference = fill.apply_fill(scoring.inference_rows(rows, people, wanted), meta["fill"])
    sinks.write_by_sid(inference.withColumns(stamped), f"{root}/inference", "append")
    stored = spark.read.parquet(f"{root}/inference").filter(mine).drop("sid_bucket", *stamped)
    scored = scoring.with_advice(attributed(score(stored, model, meta["fill"]), model, meta))
    sinks.write_by_sid(scored.withColumns(stamped), f"{root}/predictions", "append")
    return spark.read.parquet(f"{root}/predictions").filter(mine).drop("sid_bucket", *stamped)


def score_finished(
    spark: SparkSession,
    readings: DataFrame,
    participants: DataFrame,
    service: dict[str, DataFrame],
    bundle: str,
    out: str,
) -> DataFrame:
    """New prediction rows for finished sessions that have none yet, as they were stored.

    Set-based over all pending sessions and safe to repeat: sessions with a prediction in
    the service's table or in ``new_predictions`` of an earlier run are left out. With nothing
    pending no reading is read, no model loaded and nothing written.
    """
    folder, run_id = f"{out.rstrip('/')}/new_predictions", uuid.uuid4().hex
    before = tables.read_if_present(spark, folder)
    known = service["predictions"]
    if before is not None:
        known = known.select("session_id", "prediction").unionByName(before.select("session_id", "prediction"))
    finished = lifecycle.finished_sessions(service["sessions"])
    pending = sessions.new_predictions(finished.select(F.col("id").alias("session_id"), F.col("sid").alias("SID")), known)
    if pending.isEmpty():
        return spark.createDataFrame([], NEW_PREDICTIONS)
    loaded = load_bundle(spark, bundle)
    scored = _predict(spark, readings, participants, pending, loaded, out)
    rows = lifecycle.prediction_rows(scored, finished, known, loaded[1]["best_model_name"])
    rows.withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(folder)
    return spark.read.parquet(folder).filter(F.col("run_id") == run_id).drop("run_id")


def train_and_predict(
    spark: SparkSession, folder: str, participants: str, service: dict[str, DataFrame], out: str
) -> DataFrame:
    """Features, training and scoring of the finished sessions in one run."""
    root = out.rstrip("/")
    preprocess(spark, folder, participants, root)
    train(spark, f"{root}/features", f"{root}/training")
    return score_finished(
        spark, recordings.read_readings(spark, folder), tables.read_participants(spark, participants), service,
        f"{root}/training/bundle", f"{root}/scored",
    )


def harmonise(spark: SparkSession, root: str, participants: str, out: str, in_root: bool = False) -> dict[str, DataFrame]:
    """A foreign dataset as readings, participants and truth labels, plus the rejected files."""
    readings, rejected = recordings.read_external(spark, root, in_root)
    people = tables.read_external_participants(spark, participants, f"{out.rstrip('/')}/participant_info.csv")
    truth = labels.with_truth_label(people).select("SID", TRUTH)
    sinks.write_harmonised(readings, people, truth, out)
    base = out.rstrip("/")
    return {
        "readings": spark.read.parquet(f"{base}/readings"),
        "participants": spark.read.parquet(f"{base}/participants"),
        "truth": spark.read.parquet(f"{base}/truth"),
        "rejected": rejected,
    }


def clinical_report(predictions: DataFrame, truth: DataFrame, out: str, n_iter: int = 1000) -> DataFrame:
    sinks.write_report(metrics.clinical_report(metrics.join_truth(predictions, truth), n_iter), out)
    report = predictions.sparkSession.read.parquet(out)
    if not report.first()["N"]:
        raise ValueError("predictions and truth share no SID")
    return report


def dashboard(service: dict[str, DataFrame], feature_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Session rows and their one-row summary."""
    rows = sessions.dashboard_sessions(
        service["sessions"], service["predictions"], feature_rows, ["created_at", "id"]
    )
    return rows, sessions.dashboard_summary(rows)


def longitudinal(readings: DataFrame, participants: DataFrame):
    """Nightly rows to sequences to a fitted classifier and its metrics."""
    people = labelled_participants(participants).select("SID", LABEL, HOURS)
    nights = sequences.with_night_index(sequences.night_features(readings)).join(people, "SID")
    return train_longitudinal(sequences.night_sequences(nights))


def live(
    messages: DataFrame, device_sessions: DataFrame, out: str, bins: DataFrame | None = None, width: float = 5.0,
    available_now: bool = False,
):
    """The live pipeline: parse, derive, impute, gate, then record and show.

    Returns both running queries. Each has its own checkpoint.
    """
    root = out.rstrip("/")
    rows = feed.with_device(feed.derive_live(feed.parse_live(messages)))
    if bins is not None:
        rows = feed.impute_live(rows, bins, width)
    gated = feed.gate_active(rows, device_sessions)
    return (
        feed.write_recording(gated, f"{root}/recording", f"{root}/checkpoints/recording", available_now=available_now),
        feed.write_live(gated, f"{root}/payload", f"{root}/checkpoints/payload", available_now=available_now),
    )


def live_sessions(
    spark: SparkSession,
    messages: DataFrame,
    device_sessions: Callable[[], DataFrame],
    out: str,
    bins: DataFrame | None = None,
    width: float = 5.0,
    available_now: bool = False,
    completed: Callable[[], object] | None = None,
):
    """The live pipeline with sessions that come and end while it runs.

    ``device_sessions`` is read anew in each trigger. ``completed`` is called when a trigger
    is stored; give it ``score_finished`` on the tables as they are then, which scores
    each finished session once. Returns the running query.
    """
    root = out.rstrip("/")
    rows = feed.with_device(feed.derive_live(feed.parse_live(messages)))
    if bins is not None:
        rows = feed.impute_live(rows, bins, width)
    return feed.write_gated(rows, device_sessions, root, f"{root}/checkpoints/live", available_now=available_now, after=completed)
