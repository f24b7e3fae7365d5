"""Batch queries over the given tables, one per operator or small group of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nocturne.functions import bands, live, rules, sleep, text
from nocturne.operators import (
    columns,
    features,
    fill,
    labels,
    metrics,
    profile,
    scoring,
    sequences,
    series,
    sessions,
    sites,
)
from nocturne.plans import adapters as a
from nocturne.schemas import CHANNELS, EVENTS, HOURS, LABEL, NIGHT_FEATURES, PROFILE_COLUMNS, STAGES
from nocturne.streaming import lifecycle
from nocturne.streaming import live as feed

STDS = [f"{c}_std" for c in CHANNELS]
SHARES = [f"sleep_stage_pct_{s}" for s in STAGES]
CORE = ["HR", "EDA", "TEMP", "BVP"]


def rounded(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in names})


def stamp(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def participants(spark: SparkSession, sf: str) -> DataFrame:
    return labels.clean_participants(a.raw_participants(spark, sf))


def feature_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Readings to features, joined to labelled participants: 57 columns."""
    people = labels.with_recommended_hours(labels.deprivation_label(participants(spark, sf)))
    return features.join_participants(features.recording_features(a.readings(spark, sf)), people)


def feature_table(spark, sf):
    return rounded(feature_rows(spark, sf), [*STDS, HOURS])


def channel_stats(spark, sf):
    rows = features.coerce_channels(a.readings(spark, sf))
    out = rows.groupBy("SID").agg(F.count(F.lit(1)).alias("records"), *features.channel_aggregates())
    return rounded(out, STDS)


def event_rates(spark, sf):
    out = features.recording_features(a.readings(spark, sf))
    return out.select("SID", *[f"{c}_count" for c in EVENTS], "event_rate")


def stage_shares(spark, sf):
    return features.recording_features(a.readings(spark, sf)).select("SID", *SHARES)


def stage_pivot(spark, sf):
    staged = a.readings(spark, sf).select("SID", F.coalesce("Sleep_Stage", F.lit("Unknown")).alias("stage"))
    counts = staged.groupBy("SID").pivot("stage", list(STAGES)).count().na.fill(0)
    return counts.withColumnsRenamed({s: f"n_{s}" for s in STAGES})


def participants_clean(spark, sf):
    return labels.with_heuristic_label(participants(spark, sf))


def deprivation_label(spark, sf):
    return labels.deprivation_label(participants(spark, sf)).select("SID", LABEL)


def severity_topk(spark, sf):
    people = labels.with_severity(participants(spark, sf))
    return labels.severity_label(people).select("SID", "severity", LABEL)


def recommended_hours(spark, sf):
    return rounded(labels.with_recommended_hours(participants(spark, sf)).select("SID", HOURS), [HOURS])


def truth_proxy(spark, sf):
    return labels.with_truth_label(participants(spark, sf)).select("SID", "sleep_deprivation_label_gt")


def median_fill(spark, sf):
    people = participants(spark, sf)
    return fill.apply_fill(people, fill.fit_fill(people))


def foreign_readings(spark, sf) -> DataFrame:
    """Readings under foreign names: blanks, lower case, one-hot stages."""
    kind = F.col("event_type")
    hot = {"view": "W", "click": "N1", "purchase": "N2", "signup": "N3"}
    base = a.readings_from(a.table(spark, sf, "events")).drop("Sleep_Stage", *EVENTS)
    kinds = a.table(spark, sf, "events").select(F.col("event_id").alias("reading_id"), "event_type")
    named = base.join(kinds, "reading_id").select(
        F.concat(F.lit(" rec_"), F.lower("SID")).alias("stem"),
        "reading_id", "BVP", F.col("ACC_X").alias("acc_x"), F.col("ACC_Y").alias(" Acc_Y "),
        F.col("ACC_Z").alias("acc z"), "TEMP", "EDA", "HR", "IBI",
        *[(kind == k).cast("int").alias(f"Sleep Stage {s}") for k, s in hot.items()],
        F.lit(0).alias("Sleep_Stage_R"),
    )
    return named


def harmonise(spark, sf):
    named = columns.normalise_columns(foreign_readings(spark, sf))
    staged = columns.ensure_columns(columns.onehot_to_stage(named))
    lacking = columns.missing_columns(staged.columns, columns.REQUIRED)
    if lacking:
        raise ValueError(f"columns missing after harmonising: {lacking}")
    counted = staged.select(
        "reading_id", columns.stem_sid(F.col("stem")).alias("SID"), "ACC_X", "ACC_Y", "ACC_Z", "Sleep_Stage",
        F.coalesce(*EVENTS, F.lit("absent")).alias("events"),
    )
    return counted


def onehot_stage(spark, sf):
    staged = columns.onehot_to_stage(columns.normalise_columns(foreign_readings(spark, sf)))
    return staged.select("reading_id", "Sleep_Stage")


def synonym_pick(spark, sf):
    raw = a.raw_participants(spark, sf)
    foreign = raw.select(
        F.col("SID").alias("Participant"), F.col("AGE").alias("Age"), F.col("GENDER").alias("Sex"),
        F.col("BMI").alias("bmi"), F.col("AHI").alias("ahi"), F.col("Mean_SaO2").alias("SpO2"),
        F.col("Sleep_Disorders").alias("diagnosis"),
    )
    return columns.map_participants(foreign)


def missing_profile(spark, sf):
    return profile.missing_profile(a.readings(spark, sf))


def top_missing(spark, sf):
    return profile.missing_profile(feature_rows(spark, sf)).limit(15)


def describe_numeric(spark, sf):
    out = profile.describe_numeric(participants(spark, sf))
    return rounded(out, ["mean", "std", "q25", "q50", "q75"])


def describe_text(spark, sf):
    return profile.describe_text(participants(spark, sf).drop("SID"))


def corr_matrix(spark, sf):
    return rounded(profile.corr_matrix(feature_rows(spark, sf), list(PROFILE_COLUMNS)), ["r"])


def histogram(spark, sf):
    return profile.histogram(participants(spark, sf), "AHI")


def class_counts(spark, sf):
    return profile.class_counts(participants_clean(spark, sf), LABEL)


def summaries(spark, sf) -> DataFrame:
    kinds = a.table(spark, sf, "events").select(F.col("event_id").alias("reading_id"), "event_type")
    return sites.site_summary(a.readings(spark, sf).join(kinds, "reading_id"), "event_type", CORE)


def site_summary(spark, sf):
    return rounded(summaries(spark, sf), ["std"]).withColumn("m2", F.round("m2", 2))


def merged_summary(spark, sf):
    return rounded(sites.merge_summaries(summaries(spark, sf)), ["mean", "std"])


def judged(spark, sf) -> DataFrame:
    return metrics.join_truth(a.scored(spark, sf), a.truth(spark, sf))


def confusion_by_segment(spark, sf):
    return metrics.confusion(judged(spark, sf), ("segment",))


def clinical_metrics(spark, sf):
    out = metrics.clinical_metrics(judged(spark, sf))
    return rounded(out, ["Sensitivity", "Specificity", "PPV", "NPV", "Cohen_Kappa"])


def kappa(spark, sf):
    out = metrics.clinical_metrics(judged(spark, sf), ("segment",))
    return rounded(out.select("segment", "Cohen_Kappa"), ["Cohen_Kappa"])


def roc_auc(spark, sf):
    return rounded(metrics.roc_auc(judged(spark, sf), ("segment",)), ["AUC_ROC"], 9)


def targets_met(spark, sf):
    joined = judged(spark, sf)
    report = metrics.side_by_side(metrics.clinical_metrics(joined), metrics.roc_auc(joined))
    measured = report.select("n", "Sensitivity", "Specificity", "AUC_ROC", "Cohen_Kappa")
    return rounded(metrics.meets_targets(measured), ["value"])


def bootstrap_ci(spark, sf):
    return metrics.bootstrap_ci(judged(spark, sf), keys=("segment",))


def clinical_report(spark, sf):
    return metrics.clinical_report(judged(spark, sf))


def scored_models(spark, sf) -> DataFrame:
    """Predictions of three models judged by how their session ended."""
    outcome = a.sessions(spark, sf).select(
        F.col("id").alias("session_id"), (F.col("status") == "complete").cast("int").alias(LABEL)
    )
    known = a.predictions(spark, sf).filter(F.col("probability").isNotNull())
    return known.join(outcome, "session_id")


def model_metrics(spark, sf):
    out = metrics.model_metrics(scored_models(spark, sf))
    return rounded(out, ["accuracy", "f1", "precision", "recall", "roc_auc"], 9)


def leaderboard(spark, sf):
    ranked = metrics.rank_models(model_metrics(spark, sf))
    return ranked.select("model_name", "f1", "accuracy", "roc_auc")


def leaderboard_view(spark, sf):
    return metrics.leaderboard_view(model_metrics(spark, sf), "roc_auc", "knn")


def risk_bands(spark, sf):
    p = F.col("probability")
    return a.predictions(spark, sf).groupBy(
        bands.risk_band(p, "task").alias("task_band"),
        bands.risk_band(p, "dashboard").alias("dashboard_band"),
        bands.quality_band(F.floor(p * 100), F.col("l_linenumber") - 1).alias("quality_band"),
        bands.decision_text(bands.decide(p)).alias("decision"),
    ).agg(F.count(F.lit(1)).alias("n"))


def sleep_efficiency(spark, sf):
    rows = features.recording_features(a.readings(spark, sf))
    value = sleep.sleep_efficiency(F.col("sleep_stage_pct_W"), F.col("event_rate"))
    return rows.select("SID", F.round(value, 6).alias("sleep_efficiency"))


def stage_percents(spark, sf):
    rows = features.recording_features(a.readings(spark, sf))
    return rows.select("SID", sleep.stage_percents().alias("p")).select("SID", "p.*")


def _advice_rows(df: DataFrame) -> DataFrame:
    rows = df.select("SID", F.posexplode("recommendations").alias("pos", "rule"))
    return rows.select("SID", "pos", "rule.code", "rule.severity", "rule.message")


def recommendations(spark, sf):
    return _advice_rows(scoring.with_advice(features.recording_features(a.readings(spark, sf))))


def recommendations_ui(spark, sf):
    rows = features.recording_features(a.readings(spark, sf))
    shown = rows.select(
        "SID", "event_rate", "HR_mean",
        sleep.sleep_efficiency(F.col("sleep_stage_pct_W"), F.col("event_rate")).alias("sleep_efficiency"),
        sleep.stage_percent(F.col("sleep_stage_pct_N3")).alias("n3"),
        sleep.stage_percent(F.col("sleep_stage_pct_R")).alias("rem"),
    )
    return _advice_rows(scoring.with_advice(shown, rules.UI_RULES, None)).drop("message")


def latest_prediction(spark, sf):
    out = sessions.latest_prediction(a.predictions(spark, sf), a.NEWEST)
    return out.select("session_id", "model_name", "prediction", "probability", "l_linenumber")


TREND_ORDER = ["session_at", "session_id", *a.NEWEST]


def trend7(spark, sf):
    joined = sessions.scored_sessions(a.sessions(spark, sf), a.predictions(spark, sf))
    out = sessions.trend(joined, TREND_ORDER)
    return out.select("user_id", "day", "sid", text.iso(F.col("session_at")).alias("date"), "probability",
                      bands.risk_band(F.col("probability"), "task").alias("label"))


def trend_change(spark, sf):
    joined = sessions.scored_sessions(a.sessions(spark, sf), a.predictions(spark, sf))
    out = sessions.trend_change(joined, "probability", TREND_ORDER)
    return out.select("user_id", "session_id", "l_linenumber", "l_partkey", "l_suppkey", "probability",
                      "trend_score", "trend_change")


def page(spark, sf):
    out = sessions.page(a.sessions(spark, sf), [F.desc("created_at"), F.desc("id")], 10, 50)
    return out.select("id", "sid", "status", text.iso(F.col("created_at")).alias("created"))


def dashboard(spark, sf) -> DataFrame:
    rows = features.recording_features(a.readings(spark, sf))
    return sessions.dashboard_sessions(a.sessions(spark, sf), a.predictions(spark, sf), rows, a.NEWEST)


def dashboard_sessions(spark, sf):
    out = dashboard(spark, sf).drop("created_at", "shap_features")
    return rounded(out, ["HR_std", "sleep_efficiency"])


def session_detail(spark, sf):
    detail = sessions.session_detail(dashboard(spark, sf))
    top = F.col("prediction.shap_top_features")
    return detail.select(
        "sid", "riskLevel", "status", F.col("sleepStages.n3").alias("n3"),
        F.col("features.event_rate").alias("event_rate"), F.size(top).alias("impacts"),
        F.get(top, F.lit(0))["impact"].alias("first_impact"),
    )


def dashboard_summary(spark, sf):
    return rounded(sessions.dashboard_summary(dashboard(spark, sf)), ["avgRisk", "avgEfficiency", "avgDeepSleep"])


def patient_rollup(spark, sf):
    return sessions.patient_rollup(a.users(spark, sf), dashboard(spark, sf))


def cohort_kpis(spark, sf):
    return sessions.cohort_kpis(patient_rollup(spark, sf))


def scoped_listing(spark, sf):
    own = sessions.scope_to_user(a.sessions(spark, sf), 7, "patient")
    return own.select("id", "sid", "user_id", "status")


def search(spark, sf):
    return sessions.search(a.users(spark, sf), "R#00000001", ["name", "email"]).select("id", "name", "email")


def new_predictions(spark, sf):
    pending = a.sessions(spark, sf).select(F.col("id").alias("session_id"), "sid")
    return sessions.new_predictions(pending, a.predictions(spark, sf))


def reject_existing(spark, sf):
    """Incoming sessions named after parts; those that exist are dropped."""
    incoming = a.table(spark, sf, "lineitem").select(F.concat(F.lit("S"), F.col("l_partkey") * 100).alias("sid"))
    return sessions.reject_existing(incoming, a.sessions(spark, sf), "sid")


def session_report(spark, sf):
    """Own reports are the finished predictions, the shared table has all sessions."""
    own = sessions.latest_prediction(
        a.predictions(spark, sf).filter(F.col("prediction") == 1), a.NEWEST
    ).select("session_id", F.lit("own").alias("origin"), "probability")
    shared = a.sessions(spark, sf).select(
        F.col("id").alias("session_id"), F.lit("shared").alias("origin"), F.lit(0.0).alias("probability")
    )
    return sessions.session_report(own, shared, "session_id")


def inference_rows(spark, sf):
    wanted = a.table(spark, sf, "events").filter("event_type = 'purchase'").select(
        F.concat(F.lit("S"), "user_id").alias("SID")
    ).distinct()
    rows = features.recording_features(lifecycle.pending_readings(a.readings(spark, sf), wanted))
    out = scoring.inference_rows(rows, participants(spark, sf), wanted)
    return out.select("SID", "records", "HR_mean", "AGE", "BMI", "Arousal Index")


def missing_requests(spark, sf):
    rows = features.recording_features(a.readings(spark, sf))
    wanted = a.table(spark, sf, "orders").select(F.concat(F.lit("S"), "o_custkey").alias("SID"))
    return scoring.missing_requests(rows, participants(spark, sf), wanted)


def scored_decisions(spark, sf):
    out = scoring.with_decision(a.scored(spark, sf))
    return out.select("SID", "prediction", "prediction_label", "risk")


def top_features(spark, sf):
    parsed = a.predictions(spark, sf).select(
        "session_id", text.safe_json(F.col("shap_features"), "array<struct<feature:string,impact:double>>").alias("i")
    )
    best = parsed.select("session_id", F.posexplode(scoring.top_features(F.col("i"), 3)).alias("pos", "e"))
    return best.groupBy("pos", "e.feature").agg(
        F.count(F.lit(1)).alias("n"), F.max("e.impact").alias("largest"), F.sum("e.impact").alias("total")
    )


def importance(spark, sf):
    parsed = a.predictions(spark, sf).select(
        text.safe_json(F.col("shap_features"), "array<struct<feature:string,impact:double>>").alias("impacts")
    )
    return rounded(scoring.importance(parsed), ["mean_abs_impact"])


def downsample(spark, sf):
    out = series.downsample(a.readings(spark, sf), 5, ["SID"], ["ts", "reading_id"])
    return out.select("SID", "reading_id", "HR", "EDA")


def hypnogram(spark, sf):
    out = series.hypnogram(a.readings(spark, sf), "5 minutes")
    return out.select("SID", stamp("start"), "stage", "code")


def minute_series(spark, sf):
    return series.minute_series(a.readings(spark, sf)).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def stage_runs(spark, sf):
    """Day-long epochs, so that runs span several of them."""
    out = series.stage_runs(series.hypnogram(a.readings(spark, sf), "1 day"))
    return out.select("SID", "stage", stamp("start"), stamp("end"), "epochs")


def nights(spark, sf) -> DataFrame:
    return sequences.with_night_index(sequences.night_features(a.readings(spark, sf)))


def night_index(spark, sf):
    return nights(spark, sf).select(
        "SID", F.date_format("night", "yyyy-MM-dd").alias("night"), "night_index", "records", "event_rate"
    )


def labelled_nights(spark, sf) -> DataFrame:
    people = labels.with_heuristic_label(participants(spark, sf)).select("SID", LABEL)
    return nights(spark, sf).join(people, "SID")


def night_sequences(spark, sf):
    built = sequences.night_sequences(labelled_nights(spark, sf))
    rows = built.select("SID", "night_index", LABEL, F.posexplode("sequence").alias("pos", "n"))
    return rounded(rows.select("SID", "night_index", LABEL, "pos", "n.*"), ["EDA_std"])


def raw_sessions(spark, sf) -> DataFrame:
    """Session texts as a client stores them, with gaps and odd values."""
    key = F.col("o_orderkey")
    cents = F.floor("o_totalprice")
    return a.table(spark, sf, "orders").select(
        F.when(key % 50 != 0, F.concat(F.lit("s"), key)).otherwise(" ").alias("id"),
        F.when(key % 3 == 0, F.concat(F.lit("S"), key)).when(key % 3 == 1, " ").alias("sid"),
        F.when(key % 4 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"),
        F.when(key % 8 == 0, "2001-01-01").alias("createdAt"),
        F.when(key % 5 == 0, F.concat(F.lit("7."), key % 10, F.lit(" H")))
        .when(key % 5 == 1, F.concat((key % 600).cast("string"), F.lit(" min")))
        .when(key % 5 == 2, "soon")
        .otherwise((key % 480).cast("string"))
        .alias("duration"),
        F.when(key % 6 == 0, "bad").when(key % 6 < 4, (cents % 200 / 128).cast("string")).alias("riskProbability"),
        (cents % 120).cast("string").alias("riskScore"),
        F.when(key % 10 == 0, "high").when(key % 10 == 1, "odd").alias("riskLevel"),
        F.when(key % 10 == 2, "low").alias("risk"),
        F.when(key % 2 == 0, "processing").otherwise("complete").alias("status"),
        F.when(key % 7 == 0, (cents % 150).cast("string")).alias("sleep_efficiency"),
        (cents % 130).cast("string").alias("sleepQuality"),
        F.concat((cents % 30).cast("string"), F.lit("%")).alias("n3"),
    )


def status_normalise(spark, sf):
    return sessions.normalise_sessions(raw_sessions(spark, sf), "2024-01-01")


def duration_parse(spark, sf):
    out = raw_sessions(spark, sf).select("duration", text.parse_duration(F.col("duration")).alias("minutes"))
    return out.groupBy("duration", "minutes").agg(F.count(F.lit(1)).alias("n"))


def safe_json(spark, sf):
    impacts = text.safe_json(F.col("shap_features"), "array<struct<feature:string,impact:double>>")
    parsed = a.predictions(spark, sf).select("session_id", impacts.alias("i"))
    return parsed.groupBy("session_id").agg(
        F.sum(F.size("i")).alias("entries"), F.max(F.get("i", F.lit(0))["impact"]).alias("largest")
    )


def hm_text(spark, sf):
    rows = a.sessions(spark, sf).select("id", text.minutes(F.col("duration_seconds")).alias("minutes"))
    return rows.select("id", "minutes", text.hm_text(F.col("minutes")).alias("shown"))


def live_derive(spark, sf):
    rows = feed.derive_live(feed.parse_live(a.messages(spark, sf)))
    return rounded(rows.select("event_id", *CHANNELS), list(CHANNELS))


def live_rejects(spark, sf):
    return feed.rejected_live(a.messages(spark, sf)).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def live_impute_bins(spark, sf):
    bins = feed.fit_bins(a.readings(spark, sf), 5.0)
    rows = feed.impute_live(feed.derive_live(feed.parse_live(a.messages(spark, sf))), bins, 5.0)
    return rounded(rows.select("event_id", "EDA", "TEMP", "BVP", "imputed"), ["EDA", "TEMP", "BVP"])


def device_sessions(spark, sf) -> DataFrame:
    return device_sessions_from(a.table(spark, sf, "customer"))


def device_sessions_from(customers: DataFrame) -> DataFrame:
    """One recording per device: ten days, or open ended."""
    key = F.col("c_custkey")
    start = F.date_add(F.to_date(F.lit("2024-01-01")), (key % 20).cast("int"))
    return customers.select(
        F.concat(F.lit("S"), key).alias("device"),
        F.concat(F.lit("REC"), key).alias("SID"),
        start.cast("timestamp").alias("started_at"),
        F.when(F.col("c_nationkey") % 5 != 0, F.date_add(start, 10).cast("timestamp")).alias("ended_at"),
    )


def gated_live(spark, sf):
    rows = feed.with_device(feed.derive_live(feed.parse_live(a.messages(spark, sf))))
    gated = feed.gate_active(rows, device_sessions(spark, sf))
    return gated.select("SID", "event_id", F.round("HR", 6).alias("HR"))


def live_payload(spark, sf):
    rows = feed.derive_live(feed.parse_live(a.messages(spark, sf)))
    payload = F.from_json(feed.payload(), "HR double, EDA double, TEMP double, BVP double, ts string")
    return rows.select("event_id", payload.alias("p")).select(
        "event_id", F.round("p.HR", 6).alias("HR"), F.round("p.EDA", 6).alias("EDA"), F.col("p.ts").alias("ts")
    )


BATCH = {
    f.__name__: f
    for f in (
        feature_table, channel_stats, event_rates, stage_shares, stage_pivot, participants_clean,
        deprivation_label, severity_topk, recommended_hours, truth_proxy, median_fill, harmonise,
        onehot_stage, synonym_pick, missing_profile, top_missing, describe_numeric, describe_text,
        corr_matrix, histogram, class_counts, site_summary, merged_summary, confusion_by_segment,
        clinical_metrics, kappa, roc_auc, targets_met, bootstrap_ci, clinical_report, model_metrics,
        leaderboard, leaderboard_view, risk_bands, sleep_efficiency, stage_percents, recommendations,
        recommendations_ui, latest_prediction, trend7, trend_change, page, dashboard_sessions,
        session_detail, dashboard_summary, patient_rollup, cohort_kpis, scoped_listing, search,
        new_predictions, reject_existing, session_report, inference_rows, missing_requests,
        scored_decisions, top_features, importance, downsample, hypnogram, minute_series, stage_runs,
        night_index, night_sequences, status_normalise, duration_parse, safe_json, hm_text, live_derive,
        live_rejects, live_impute_bins, gated_live, live_payload,
    )
}
