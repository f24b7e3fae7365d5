"""Column names, table schemas and the fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Names and codes that incoming files and results must carry.
CHANNELS = ("BVP", "ACC_X", "ACC_Y", "ACC_Z", "TEMP", "EDA", "HR", "IBI")
EVENTS = ("Obstructive_Apnea", "Central_Apnea", "Hypopnea", "Multiple_Events")
STAGE = "Sleep_Stage"
#: Of recording files that hold several recordings: the SID of a row, URL-encoded.
ROW_SID = "_row_sid"
STAGES = ("W", "N1", "N2", "N3", "R", "P", "Unknown")
STAGE_CODES = {"W": 0, "N1": 1, "N2": 2, "N3": 3, "R": 4}
CLINICAL = (
    "AGE", "GENDER", "BMI", "OAHI", "AHI", "Mean_SaO2", "Arousal Index",
    "MEDICAL_HISTORY", "Sleep_Disorders",
)
CLINICAL_NUMBERS = ("AGE", "BMI", "OAHI", "AHI", "Arousal Index", "Mean_SaO2")
LABEL = "sleep_deprivation_label"
HOURS = "recommended_sleep_hours"
TRUTH = "sleep_deprivation_label_gt"
PROBABILITY = "probability_sleep_deprivation"
NIGHT_FEATURES = (
    "HR_mean", "EDA_std", "BVP_mean", "TEMP_mean", "event_rate",
    "sleep_stage_pct_N3", "sleep_stage_pct_R", "sleep_stage_pct_W",
)
PROFILE_COLUMNS = (
    "AGE", "BMI", "OAHI", "AHI", "Arousal Index", "Mean_SaO2", "event_rate",
    "HR_mean", "EDA_mean", "TEMP_mean", LABEL,
)
# The cell texts a pandas CSV reader takes as missing.
NA_TOKENS = (
    "", " ", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

USERS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("email", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("is_active", T.BooleanType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
SESSIONS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("sid", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("ended_at", T.TimestampType()),
        T.StructField("duration_seconds", T.IntegerType()),
        T.StructField("sensor_csv_path", T.StringType()),
        T.StructField("notes", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
PREDICTIONS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("session_id", T.LongType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("prediction", T.IntegerType()),
        T.StructField("probability", T.DoubleType()),
        T.StructField("label", T.StringType()),
        T.StructField("shap_features", T.StringType()),
        T.StructField("recommendations_json", T.StringType()),
        T.StructField("predictions_csv_path", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
NEW_PREDICTIONS = (
    "session_id long, model_name string, prediction int, probability double, label string, "
    "recommendations_json string, shap_features string, created_at timestamp"
)
LEADERBOARD = T.StructType(
    [T.StructField("model_name", T.StringType())]
    + [
        T.StructField(c, T.DoubleType())
        for c in ("accuracy", "f1", "precision", "recall", "roc_auc")
    ]
)
IMPACTS = "array<struct<feature:string,impact:double>>"
ADVICE = "array<struct<code:string,message:string,severity:string>>"
