import pytest
from pyspark.sql import functions as F

from helpers import rows
from nocturne.functions import bands, clinical, live, numeric, rules, sleep, text
from nocturne.operators import scoring


def one(spark, expr, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    "raw, expected",
    [("91", 91.0), (" 1e3 ", 1000.0), (".5", 0.5), ("-2.", -2.0), ("1d", None), ("inf", None), ("nan", None),
     ("", None), (None, None), ("bad", None), ("1 2", None)],
)
def test_to_number(spark, raw, expected):
    assert one(spark, numeric.to_number, raw) == expected


def test_percent_and_leading(spark):
    assert one(spark, numeric.percent_number, "91.0%") == 91.0
    assert one(spark, numeric.leading_number, "12.5 kg") == 12.5
    assert one(spark, numeric.leading_number, "kg") is None


def test_nan_becomes_null(spark):
    assert one(spark, numeric.no_nan, float("nan"), "double") is None
    assert one(spark, numeric.no_nan, 2.0, "double") == 2.0


@pytest.mark.parametrize(
    "p, task, board",
    [(0.0, "LOW RISK", "low"), (0.3, "MODERATE RISK", "low"), (0.4, "MODERATE RISK", "moderate"),
     (0.65, "HIGH RISK", "moderate"), (0.7, "HIGH RISK", "high"), (None, None, None)],
)
def test_risk_bands(spark, p, task, board):
    assert one(spark, lambda c: bands.risk_band(c, "task"), p, "double") == task
    assert one(spark, lambda c: bands.risk_band(c, "dashboard"), p, "double") == board


def test_quality_band(spark):
    df = spark.createDataFrame([(80, 0), (49, 1), (69, 1), (70, 1)], "q int, n int")
    got = [r["b"] for r in df.select(bands.quality_band(F.col("q"), F.col("n")).alias("b")).collect()]
    assert got == ["high", "high", "moderate", "low"]


def test_missing_side_of_a_comparison_is_false(spark):
    df = spark.createDataFrame([(None, None, None, False), (None, 15.0, None, False)], "o double, a double, r double, f boolean")
    label = clinical.heuristic_label(F.col("o"), F.col("a"), F.col("r"), F.col("f"))
    assert [r["l"] for r in df.select(label.alias("l")).collect()] == [0, 1]


@pytest.mark.parametrize(
    "raw, minutes",
    [("7.5h", 450), ("8 H", 480), ("90 min", 90), ("-5", -5), ("soon", 0), (None, 0), ("0.0417h", 3)],
)
def test_parse_duration(spark, raw, minutes):
    assert one(spark, text.parse_duration, raw) == minutes


def test_text_helpers(spark):
    assert one(spark, lambda c: text.hm_text(c), 453, "int") == "7h 33m"
    assert one(spark, text.minutes, None, "int") == 0
    assert one(spark, text.known_status, "complete") == "completed"
    assert one(spark, text.known_status, "recording") == "recording"
    assert one(spark, lambda c: text.safe_json(c, "array<struct<feature:string,impact:double>>"), "oops") == []
    assert one(spark, lambda c: text.mentions("AbC", c), "xxaBcxx") is True
    assert one(spark, lambda c: text.mentions("AbC", c), None) is False


@pytest.mark.parametrize(
    "bpm, bvp, temp, eda, ibi", [(72.5, 22.5, 33.5, 2.5, 827.586207), (0.0, 20, 33, 2, 0), (-5.0, 25, 34, 3, 0)]
)
def test_derived_channels(spark, bpm, bvp, temp, eda, ibi):
    df = spark.createDataFrame([(bpm,)], "bpm double")
    got = df.select(*[c.alias(n) for n, c in live.derived_channels(F.col("bpm")).items()]).first()
    assert (got["BVP"], got["TEMP"], got["EDA"], round(got["IBI"], 6)) == (bvp, temp, eda, ibi)
    assert (got["ACC_X"], got["ACC_Y"], got["ACC_Z"], got["HR"]) == (0.5, 0.5, 0.5, bpm)


@pytest.mark.parametrize(
    "message, bpm",
    [('{"bpm": 72.5}', 72.5), ('{"bpm":"72"}', 72.0), ("{}", 0.0), ('{"bpm":null}', None), ("notjson", None),
     ('{"bpm":"fast"}', None), ("[1]", None), (None, None), ('{"other":1}', 0.0)],
)
def test_message_bpm(spark, message, bpm):
    assert one(spark, live.message_bpm, message) == bpm


FEATURE_TYPES = "N3 double, e double, h double, s double, R double, W double"


def advised(spark, values):
    df = spark.createDataFrame([values], FEATURE_TYPES).toDF(
        "sleep_stage_pct_N3", "event_rate", "HR_mean", "EDA_std", "sleep_stage_pct_R", "sleep_stage_pct_W"
    )
    return [(r["code"], r["severity"]) for r in scoring.with_advice(df).first()["recommendations"]]


def test_advice_fires_in_order_and_defaults(spark):
    assert [c for c, _ in advised(spark, (0.0, 0.5, 80.0, 1.0, 0.0, 0.25))] == [r.code for r in rules.SERVICE_RULES]
    assert advised(spark, (0.2, 0.0, 70.0, 0.1, 0.2, 0.1)) == [("normal", "ok")]
    assert advised(spark, (None, None, None, None, None, None)) == [("normal", "ok")]


def test_advice_without_columns_and_custom_table(spark):
    df = spark.createDataFrame([(80.0,)], "HR_mean double")
    assert [r["code"] for r in scoring.with_advice(df).first()["recommendations"]] == ["high_nocturnal_hr"]
    own = (rules.Rule("slow", "HR_mean < 90D", "slow", "info"),)
    assert scoring.with_advice(df, own, None).first()["recommendations"][0]["code"] == "slow"


def test_efficiency_and_percents(spark):
    df = spark.createDataFrame([(0.25, 0.5), (0.1, 0.05), (None, None)], "w double, e double")
    got = [r["x"] for r in df.select(sleep.sleep_efficiency(F.col("w"), F.col("e")).alias("x")).collect()]
    assert got == [0.0, pytest.approx(80.0), 100.0]
    assert one(spark, sleep.stage_percent, 0.125, "double") == 12
    assert one(spark, sleep.stage_percent, 0.135, "double") == 14


def test_top_features_breaks_ties_by_name(spark):
    df = spark.createDataFrame(
        [([("b", -2.0), ("a", 2.0), ("c", 5.0), ("d", 0.1)],)], "i array<struct<feature:string,impact:double>>"
    )
    got = rows(df.select(scoring.top_features(F.col("i")).alias("t")))[0]["t"]
    assert got == [{"feature": "c", "impact": 5.0}, {"feature": "a", "impact": 2.0}, {"feature": "b", "impact": 2.0}]
