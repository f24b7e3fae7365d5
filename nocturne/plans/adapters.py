"""The given tables, mapped onto recordings, participants and service tables.

Channel values are multiples of a power of two, so sums and means come out the
same in any order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def reading_columns() -> dict:
    """Event columns to the columns of a sensor reading."""
    k, kind = F.col("k"), F.col("event_type")

    def event(low: int, high: int):
        return F.when((kind == "error") & (k >= low) & (k < high), F.lit(1))

    return {
        "BVP": F.when(k % 10 != 0, F.floor("value") / 2),
        "ACC_X": (k % 7) / 8,
        "ACC_Y": (k % 5) / 4,
        "ACC_Z": F.lit(0.5),
        "TEMP": 33 + (k % 8) / 4,
        "EDA": k / 8,
        "HR": F.when(k % 25 != 24, 40.0 + F.floor("value")),
        "Sleep_Stage": F.when(kind == "view", "W")
        .when(kind == "click", "N1")
        .when(kind == "purchase", F.when(k < 50, "N2").otherwise("R"))
        .when(kind == "signup", "N3"),
        "Obstructive_Apnea": event(0, 20),
        "Central_Apnea": event(20, 40),
        "Hypopnea": event(40, 60),
        "Multiple_Events": event(60, 100),
    }


def readings_from(events: DataFrame) -> DataFrame:
    """Works on batch and streaming events alike."""
    columns = reading_columns()
    named = events.select(
        F.concat(F.lit("S"), F.col("user_id")).alias("SID"),
        F.col("event_id").alias("reading_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    rows = named.select("SID", "reading_id", "ts", *[c.alias(n) for n, c in columns.items()])
    return rows.withColumn("IBI", F.floor(60000 / F.col("HR")).cast("double"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings_from(table(spark, sf_dir, "events"))


def raw_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text, as a participant file would be read."""
    key, balance = F.col("c_custkey"), F.floor(F.abs("c_acctbal"))
    segment, nation = F.col("c_mktsegment"), F.col("c_nationkey")
    ahi = F.when(key % 13 != 0, balance % 20)
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit(" S"), key, F.lit(" ")).alias("SID"),
        (20 + key % 60).cast("string").alias("AGE"),
        F.when(nation % 2 == 0, "M").otherwise("F").alias("GENDER"),
        (18 + key % 30).cast("string").alias("BMI"),
        F.floor(ahi * 0.75).cast("string").alias("OAHI"),
        F.coalesce(ahi.cast("string"), F.lit("N/A")).alias("AHI"),
        F.when(key % 17 == 0, "bad").otherwise(F.concat(85 + key % 15, F.lit("%"))).alias("Mean_SaO2"),
        (balance % 40).cast("string").alias("Arousal Index"),
        F.when(nation % 3 == 0, "None")
        .when(nation % 3 == 1, "Hypertension, Sleep Apnea")
        .otherwise("Asthma")
        .alias("MEDICAL_HISTORY"),
        F.when(segment == "BUILDING", "OSA, snoring")
        .when(segment == "HOUSEHOLD", "Difficulty Breathing")
        .when(segment == "MACHINERY", "None")
        .when(segment == "FURNITURE", "")
        .otherwise("insomnia")
        .alias("Sleep_Disorders"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.org")).alias("email"),
        F.when(key % 41 == 0, "admin").when(key % 40 == 0, "clinician").otherwise("patient").alias("role"),
        F.lit(True).alias("is_active"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, owner = F.col("o_orderkey"), F.col("o_custkey")
    seconds = F.when(key % 11 != 0, (3600 * (4 + key % 6) + key % 600).cast("int"))
    status = (
        F.when(F.col("o_orderstatus") == "P", "processing")
        .when(F.col("o_orderstatus") == "F", "complete")
        .when(key % 3 == 0, "recording")
        .when(key % 3 == 1, "created")
        .otherwise("failed")
    )
    start = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        key.alias("id"),
        F.concat(F.lit("S"), key).alias("sid"),
        F.when(owner % 97 != 0, owner).alias("user_id"),
        status.alias("status"),
        start.alias("started_at"),
        F.when(F.col("o_orderstatus") == "F", F.timestamp_seconds(F.unix_timestamp(start) + seconds)).alias(
            "ended_at"
        ),
        seconds.alias("duration_seconds"),
        start.alias("created_at"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several per session; the line number breaks ties in time."""
    probability = F.when(
        F.col("l_linenumber") != 7, F.floor(F.col("l_extendedprice") / 1000) / 128
    )
    impacts = F.concat(
        F.lit('[{"feature":"HR_mean","impact":'),
        F.col("l_quantity").cast("int"),
        F.lit('},{"feature":"EDA_std","impact":'),
        F.col("l_linenumber"),
        F.lit("}]"),
    )
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session_id"),
        F.when(F.col("l_returnflag") == "A", "random_forest")
        .when(F.col("l_returnflag") == "N", "knn")
        .otherwise("svc_rbf")
        .alias("model_name"),
        (probability >= 0.5).cast("int").alias("prediction"),
        probability.alias("probability"),
        F.when(F.col("l_tax") == 0.0, "")
        .when(F.col("l_tax") == 0.08, "not json")
        .otherwise(impacts)
        .alias("shap_features"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "l_extendedprice",
        "l_tax",
    )


# Newest first; the trailing columns make the order unique.
NEWEST = ["created_at", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax"]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions over documents: score from length, class at one half."""
    score = F.least(F.col("n_chars") / 5000, F.lit(1.0))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("D"), F.col("doc_id")).alias("SID"),
        F.col("lang").alias("segment"),
        score.alias("probability_sleep_deprivation"),
        (score >= 0.5).cast("int").alias("prediction"),
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.concat(F.lit("D"), F.col("doc_id")).alias("SID"),
        F.col("quality").cast("int").alias("sleep_deprivation_label_gt"),
    )


def messages_from(events: DataFrame) -> DataFrame:
    """Heart-rate messages, some of them odd: broken, quoted, empty, null."""
    k, value = F.col("k"), F.col("value").cast("string")
    keyed = events.withColumn("k", F.get_json_object("props", "$.k").cast("int") % 20)
    return keyed.select(
        "event_id",
        F.concat(F.lit("sensor/S"), F.col("user_id"), F.lit("/hr")).alias("topic"),
        F.when(k == 0, "notjson")
        .when(k == 1, F.concat(F.lit('{"bpm":"'), value, F.lit('"}')))
        .when(k == 2, "{}")
        .when(k == 3, '{"bpm":null}')
        .otherwise(F.concat(F.lit('{"bpm":'), value, F.lit("}")))
        .alias("value"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_from(table(spark, sf_dir, "events"))
