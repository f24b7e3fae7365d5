"""Queries that go through files: written below the shared folder from the given tables, then read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nocturne.operators import columns, features, fill, labels, metrics
from nocturne.plans import adapters as a
from nocturne.plans import catalogue, jobs
from nocturne.runtime import scratch_path, stored
from nocturne.schemas import CHANNELS, EVENTS, LABEL, STAGE, TRUTH
from nocturne.sources import recordings, sinks, tables

#: What the recordings' files hold, by the remainder of the SID's number: all, no stages, few and in another order.
LAYOUTS = (
    ("ts", *CHANNELS, STAGE, *EVENTS),
    ("TIMESTAMP", *CHANNELS[::-1], EVENTS[0]),
    ("note", "HR", STAGE, "EDA", "BVP"),
)


def recording_folder(spark: SparkSession, sf: str) -> str:
    """The given readings as files of three layouts."""
    home = scratch_path(spark, "recordings")
    readings = a.readings(spark, sf).withColumns({"TIMESTAMP": F.col("ts"), "note": F.lit('say "x", twice')})
    kind = F.substring("SID", 2, 20).cast("int") % len(LAYOUTS)
    for k, names in enumerate(LAYOUTS):
        sinks.write_recording_files(readings.filter(kind == k).select("SID", *names), f"{home}/layout{k}")
    return home


def read_recordings(spark, sf):
    readings = recordings.read_readings(spark, recording_folder(spark, sf), "*.csv", nested=True)
    sums = [F.round(F.sum(c), 6).alias(c) for c in CHANNELS]
    return readings.groupBy("SID").agg(
        F.count(F.lit(1)).alias("records"), F.count("ts").alias("times"), F.count(STAGE).alias("stages"),
        F.bool_and("stage_present").alias("stage_present"), *[F.count(c).alias(f"{c}_count") for c in EVENTS], *sums,
    )


def preprocess_files(spark, sf):
    """Recordings and participants from files to the stored feature table."""
    home = scratch_path(spark, "preprocess")
    sinks.write_recording_files(a.readings(spark, sf).drop("reading_id"), f"{home}/recordings")
    a.raw_participants(spark, sf).write.option("header", True).csv(f"{home}/participants")
    readings = recordings.read_readings(spark, f"{home}/recordings", "*.csv", nested=True)
    jobs.features_from_tables(spark, readings, tables.read_participants(spark, f"{home}/participants"), f"{home}/out")
    stored = tables.read_features(spark, f"{home}/out/features_raw")
    return catalogue.rounded(stored, [*catalogue.STDS, "recommended_sleep_hours"])


def participants_file(spark, sf):
    home = scratch_path(spark, "people")
    a.raw_participants(spark, sf).write.option("header", True).csv(home)
    return labels.with_heuristic_label(tables.read_participants(spark, home))


def external_participants(spark, sf):
    """A foreign participant file, found at its second place."""
    home = scratch_path(spark, "foreign-people")
    people = a.raw_participants(spark, sf).select(
        F.col("SID").alias("Participant ID"), F.col("AGE").alias("Age"), F.col("GENDER").alias("Sex"), F.col("AHI").alias("ahi"),
        F.col("Mean_SaO2").alias("SpO2"), F.col("Sleep_Disorders").alias("diagnosis"),
    )
    people.write.option("header", True).csv(f"{home}/second")
    found = tables.read_external_participants(spark, f"{home}/first", f"{home}/second")
    return found.select("SID", "AGE", "GENDER", "BMI", "AHI", "Mean_SaO2", "Sleep_Disorders")


def harmonise_files(spark, sf):
    """A foreign dataset without its usual folder: one-hot stages folded, files that lack a column refused."""
    home = scratch_path(spark, "foreign")
    readings = a.readings(spark, sf)
    hot = {f"Sleep Stage {s}": (F.col(STAGE) == s).cast("int") for s in ("W", "N1", "N2", "N3", "R")}
    foreign = readings.withColumns({c: F.coalesce(v, F.lit(0)) for c, v in hot.items()}).select(
        F.col("reading_id").alias("Record Time"), *[F.col(c).alias(c.lower() if c.startswith("ACC") else c) for c in CHANNELS], *hot
    )
    for name, rows in (("good", foreign.filter("`Record Time` % 3 <> 0")), ("bad", foreign.filter("`Record Time` % 3 = 0").drop("IBI"))):
        rows.coalesce(1).write.mode("append").option("header", True).csv(f"{home}/{name}")
    folder = f"{home}/*"
    accepted, refused = recordings.read_external(spark, folder, in_root=True)
    kept = accepted.groupBy(STAGE).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("EDA"), 6).alias("EDA"), F.count("IBI").alias("ibi"))
    return kept.withColumn("refused", F.lit(refused.filter(F.array_contains("missing", "IBI")).count()).cast("long"))


def service_files(spark, sf):
    """Users, sessions and predictions as stored tables; the newest prediction of each session."""
    home = scratch_path(spark, "service")
    held = {"users": a.users(spark, sf), "sessions": a.sessions(spark, sf), "predictions": a.predictions(spark, sf)}
    for name, rows in held.items():
        known = {f.name for f in tables.SERVICE[name].fields}
        rows.select(*[c for c in rows.columns if c in known]).write.parquet(f"{home}/{name}")
    read = tables.read_service_tables(spark, home)
    counted = read["predictions"].groupBy("session_id").agg(F.count("prediction").alias("scored"))
    return read["sessions"].join(read["users"].select(F.col("id").alias("user_id"), "role"), "user_id").join(
        counted.withColumnRenamed("session_id", "id"), "id", "left"
    ).groupBy("role", "status").agg(F.count(F.lit(1)).alias("sessions"), F.sum("scored").alias("scored"))


def leaderboard_files(spark, sf):
    """The leaderboard written and read as the CSV that others read, with its odd cells."""
    home = scratch_path(spark, "board")
    board = catalogue.model_metrics(spark, sf).select("model_name", "accuracy", "f1", "precision", "recall", "roc_auc")
    odd = board.withColumn("recall", F.when(F.col("model_name") == "knn", F.lit("nan")).otherwise(F.col("recall").cast("string")))
    odd.write.option("header", True).csv(home)
    return tables.read_leaderboard(spark, home)


def report_files(spark, sf):
    """The clinical report as table and as CSV: numbers from one, interval texts from the other."""
    home = scratch_path(spark, "report")
    report = catalogue.clinical_report(spark, sf)
    sinks.write_report(report, f"{home}/table")
    sinks.write_report(report, f"{home}/csv", as_csv=True)
    text = tables.read_report(spark, f"{home}/csv").select("N", "Sensitivity", "AUC_ROC", "Sensitivity_CI_95")
    return metrics.side_by_side(text, spark.read.parquet(f"{home}/table").select("Sensitivity_low", "Sensitivity_high"))


def stored_by_sid(spark, sf):
    """Prediction rows of two runs, foldered by SID bucket: the newer of each SID, and one SID read alone."""
    home = scratch_path(spark, "by-sid")
    scored = a.scored(spark, sf).select("SID", "probability_sleep_deprivation", "prediction")
    for run, part in enumerate((scored, scored.filter("prediction = 1").withColumn("prediction", F.lit(7)))):
        stamped = part.withColumns({"run_id": F.lit(f"r{run}"), "scored_at": F.timestamp_seconds(F.lit(run))})
        sinks.write_by_sid(stamped, home, "append")
    newest = sinks.newest_by_sid(spark.read.parquet(home).drop("sid_bucket"))
    one = sinks.read_by_sid(spark, home, "D5").count()
    return newest.groupBy("prediction", "run_id").agg(F.count(F.lit(1)).alias("n")).withColumn("rows_of_one", F.lit(one).cast("long"))


def stored_profile(spark, sf):
    """The filled feature table, written, read and profiled into stored tables."""
    home = scratch_path(spark, "profile")
    rows = stored(catalogue.feature_rows(spark, sf), "features")  # the medians and the fill read it
    sinks.write_features(fill.apply_fill(rows, fill.fit_fill(rows)), f"{home}/features")
    jobs.run_profile(spark, f"{home}/features", f"{home}/profile")
    missing = spark.read.parquet(f"{home}/profile/missing").select("column", "missing_count")
    overview = spark.read.parquet(f"{home}/profile/overview").select("column", F.col("count").alias("present"))
    classes = spark.read.parquet(f"{home}/profile/classes").agg(F.sum("n").alias("rows"))
    joined = overview.join(missing, "column").select("column", "present", "missing_count")
    return joined.withColumn("rows", F.lit(classes.first()["rows"]))


def model_inputs(spark, sf):
    """The columns a model is given, the truth column found by name, and the class guard's verdict."""
    rows = columns.require_two_classes(features.join_participants(
        features.recording_features(a.readings(spark, sf)), jobs.labelled_participants(catalogue.participants(spark, sf))
    ))
    names = columns.feature_columns(rows.columns)
    try:
        columns.require_two_classes(rows.filter(F.col(LABEL) == 1))
        guarded = False
    except ValueError:
        guarded = True
    found = metrics.find_truth_column([LABEL, "my_sleep_deprivation_truth", "x"])
    assert metrics.find_truth_column([TRUTH, "a_sleep_deprivation"]) == TRUTH
    return rows.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(names)).alias("inputs"), F.lit(guarded).alias("guarded"), F.lit(found).alias("truth_column")
    )


FILES = {
    f.__name__: f
    for f in (
        read_recordings, preprocess_files, participants_file, external_participants, harmonise_files, service_files,
        leaderboard_files, report_files, stored_by_sid, stored_profile, model_inputs,
    )
}
