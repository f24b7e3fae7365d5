"""Recording and participant files: naming, headers, gaps, and the golden rows."""

import json

import pytest
from pyspark.sql import functions as F

from helpers import rows
from nocturne.operators import columns, features, labels
from nocturne.plans import jobs
from nocturne.schemas import CHANNELS
from nocturne.sources import recordings, sinks, tables

# The five pilot participants.
PARTICIPANTS = (
    "﻿SID,AGE,GENDER,BMI,OAHI,AHI,Mean_SaO2,Arousal Index,MEDICAL_HISTORY,Sleep_Disorders\n"
    'S002,65.9,M,27,19,19,91.0%,98,"Asthma, Body Pain, GERD, Hypertension, Sleep Apnea",OSA\n'
    'S003,29.38,F,51,34,37,95.0%,28,None,"snoring, sleep apnea, difficulty breathing, snorts"\n'
    'S004,55.66,F,41,63,99,89.0%,109,"Arrhythmia, Body Pain, Depression, Dyspnea, GERD",difficulty breathing\n'
    'S005,49.12,F,43,19,20,95.0%,28,"Asthma, Body Pain, Depression, Diabetes, Dyspnea, GERD, Sleep Apnea",OSA\n'
    'S006,36.91,F,22,4,5,97.0%,34,"Depression, Sleep Apnea",OSA\n'
)
S002 = (
    "BVP,ACC_X,ACC_Y,ACC_Z,TEMP,EDA,HR,IBI,Sleep_Stage,Obstructive_Apnea,Central_Apnea,Hypopnea,Multiple_Events\n"
    "10,0.5,0.5,0.5,33,1.0,60,1000,W,,,,\n"
    "20,0.5,0.5,0.5,34,2.0,70,,N1,1,,,\n"
    "30,0.5,0.5,0.5,35,,80,750,N2,,,0,\n"
    "40,,0.5,0.5,36,3.0,bad,800,,,,,\n"
)


def put(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")


@pytest.fixture
def folder(tmp_path):
    put(tmp_path, "compressed_S002_whole_df.csv", S002)
    put(tmp_path, "compressed_P01_whole_df.csv", "HR,BVP\n70,9\n")
    put(tmp_path, "participant_info.csv", PARTICIPANTS)
    return tmp_path


def test_golden_recording(spark, folder):
    got = {r["SID"]: r for r in rows(features.recording_features(recordings.read_readings(spark, str(folder))))}
    s = got["S002"]
    near = lambda *v: [pytest.approx(x, abs=1e-6) for x in v]
    stats = lambda r, c: [r[f"{c}_{m}"] for m in ("mean", "std", "min", "max")]
    assert s["records"] == 4
    assert stats(s, "BVP") == near(25, 12.909944, 10, 40)
    assert stats(s, "HR") == near(70, 10, 60, 80)
    assert stats(s, "EDA") == near(2, 1, 1, 3)
    assert stats(s, "TEMP") == near(34.5, 1.290994, 33, 36)
    assert stats(s, "IBI") == near(850, 132.287566, 750, 1000)
    assert (s["ACC_X_mean"], s["ACC_X_std"]) == (0.5, 0.0)
    counts = [s[f"{c}_count"] for c in ("Obstructive_Apnea", "Central_Apnea", "Hypopnea", "Multiple_Events")]
    assert counts == [1, 0, 1, 0] and s["event_rate"] == 0.5
    assert [s[f"sleep_stage_pct_{c}"] for c in ("W", "N1", "N2", "N3", "R", "P", "Unknown")] == [
        0.25, 0.25, 0.25, 0, 0, 0, 0.25,
    ]
    p = got["P01"]
    assert (p["records"], p["HR_mean"], p["HR_std"], p["BVP_mean"], p["EDA_mean"]) == (1, 70.0, None, 9.0, None)
    assert p["event_rate"] == 0 and all(p[c] == 0 for c in p if c.startswith("sleep_stage_pct_"))


def test_sid_from_names(spark, tmp_path):
    for name in ("a b", "a+b", "P01", "12", "q%41"):
        put(tmp_path, f"compressed_{name}_whole_df.csv", "HR\n60\n")
    got = recordings.read_readings(spark, str(tmp_path)).select("SID").collect()
    assert sorted(r["SID"] for r in got) == ["12", "P01", "a b", "a+b", "q%41"]


def test_file_without_sid_raises(spark, tmp_path):
    put(tmp_path, "night.csv", "HR\n60\n")
    with pytest.raises(Exception, match="no SID"):
        recordings.read_readings(spark, str(tmp_path), "*.csv").collect()


def test_no_files(spark, tmp_path):
    put(tmp_path, "other.csv", "HR\n60\n")
    with pytest.raises(FileNotFoundError):
        recordings.read_readings(spark, str(tmp_path))


def test_golden_participants(spark, folder):
    people = tables.read_participants(spark, str(folder / "participant_info.csv"))
    got = {r["SID"]: r for r in rows(jobs.labelled_participants(people))}
    assert {s: r["sleep_deprivation_label"] for s, r in got.items()} == {
        "S002": 1, "S003": 0, "S004": 1, "S005": 0, "S006": 0,
    }
    assert [round(got[s]["recommended_sleep_hours"], 2) for s in sorted(got)] == [9.79, 9.28, 10.0, 8.95, 8.41]
    assert got["S003"]["MEDICAL_HISTORY"] is None and got["S002"]["Mean_SaO2"] == 91.0
    severity = {r["SID"]: r["severity"] for r in rows(labels.with_severity(people))}
    assert severity == {"S002": 97.0, "S003": 95.0, "S004": 226.5, "S005": 63.0, "S006": 36.0}
    assert {r["x"] for r in rows(labels.with_heuristic_label(people, "x"))} == {1}


def test_preprocess_and_profile(spark, folder):
    table = jobs.preprocess(spark, str(folder), str(folder / "participant_info.csv"), str(folder / "out"))
    assert len(table.columns) == 57 and [r["SID"] for r in table.collect()] == ["S002"]
    with pytest.raises(FileNotFoundError, match="preprocess"):
        tables.read_features(spark, str(folder / "absent"))
    jobs.run_profile(spark, str(folder / "out" / "features"), str(folder / "profile"))
    assert spark.read.parquet(str(folder / "profile" / "overview")).count() == 57
    corr = spark.read.parquet(str(folder / "profile" / "curated_correlation"))
    assert corr.count() == 121 and corr.filter("r IS NOT NULL").count() == 0


def test_unmatched_sids_raise(spark, folder):
    people = tables.read_participants(spark, str(folder / "participant_info.csv")).filter("SID = 'S006'")
    with pytest.raises(ValueError, match="SIDs"):
        jobs.features_from_tables(spark, recordings.read_readings(spark, str(folder)), people, str(folder / "none"))


def test_duplicate_participants_fan_out(spark, folder):
    people = tables.read_participants(spark, str(folder / "participant_info.csv"))
    joined = features.join_participants(
        features.recording_features(recordings.read_readings(spark, str(folder))), people.unionByName(people)
    )
    assert joined.count() == 2


def test_external_folder(spark, tmp_path):
    data = tmp_path / "data_64Hz"
    data.mkdir()
    head = "TIMESTAMP,BVP,acc_x,acc_y,ACC_Z,TEMP,EDA,HR,IBI,Sleep Stage W,Sleep_Stage_N1,Sleep_Stage_N2,Sleep_Stage_N3,Sleep_Stage_R\n"
    put(data, "s101_night.csv", head + "0,1,2,3,4,33,1,60,900,0,0,0,1,0\n1,1,2,3,4,33,1,60,900,0,0,0,0,0\n")
    put(data, "plain.csv", head.replace("Sleep Stage W,", "Sleep_Stage_W,") + "0,1,2,3,4,33,1,60,900,0,0,1,1,0\n")
    put(data, "S103.csv", head.replace(",IBI", "") + "0,1,2,3,4,33,1,60,0,0,0,1,0\n")
    put(data, "PSG_labels.csv", "SID,x\n1,2\n")
    put(tmp_path, "participant_info.csv", "Participant ID,Age,Sex,SpO2,AHI,diagnosis\n S101 ,50,F,95%,20,None\nplain,40,M,90%,,snoring\n")
    out = jobs.harmonise(spark, str(tmp_path), str(tmp_path / "participant_info.csv"), str(tmp_path / "out"))
    staged = rows(out["readings"].select("SID", "Sleep_Stage", "ACC_X", "Obstructive_Apnea"), "SID", "Sleep_Stage")
    assert [(r["SID"], r["Sleep_Stage"]) for r in staged] == [("S101", "N3"), ("S101", "W"), ("plain", "N2")]
    assert all(r["ACC_X"] == 2.0 and r["Obstructive_Apnea"] is None for r in staged)
    assert [(r["path"].rsplit("/")[-1], r["missing"]) for r in rows(out["rejected"])] == [("S103.csv", ["IBI"])]
    people = {r["SID"]: r for r in rows(out["participants"])}
    assert people["S101"]["Mean_SaO2"] == 95.0 and people["S101"]["BMI"] is None and people["S101"]["GENDER"] == "F"
    assert {r["SID"]: r["sleep_deprivation_label_gt"] for r in rows(out["truth"])} == {"S101": 1, "plain": 1}


def test_many_headers_are_one_scan(spark, tmp_path):
    names = ["BVP", "HR", "Sleep_Stage", "EDA"]
    for i in range(60):
        order = names[i % 4:] + names[: i % 4] + [f"extra{k}" for k in range(i % 20)]
        cells = {"BVP": i, "HR": 60 + i, "Sleep_Stage": "N1", "EDA": '"0.5"'}
        lines = [",".join(str(cells.get(c, "z")) for c in order) for _ in range(3)]
        put(tmp_path, f"compressed_H{i}_whole_df.csv", ",".join(order) + "\r\n" + "\r\n\r\n".join(lines) + "\r\n")
    readings = recordings.read_readings(spark, str(tmp_path))
    plan = readings._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Union" not in plan  # one scan; headers are settled beforehand
    got = {r["SID"]: r for r in rows(features.recording_features(readings))}
    assert len(got) == 60
    for i in range(60):
        r = got[f"H{i}"]
        assert (r["records"], r["BVP_mean"], r["HR_mean"], r["EDA_mean"], r["TEMP_mean"]) == (3, i, 60 + i, 0.5, None)
        assert r["sleep_stage_pct_N1"] == 1.0


def test_short_long_and_quoted_lines(spark, tmp_path, monkeypatch):
    text = '\ufeffHR,"BVP",EDA\n60\n61,2,3,4,5\n"62","7,5",1\n\n ,,\n'
    put(tmp_path, "compressed_A_whole_df.csv", text)
    put(tmp_path, "compressed_B_whole_df.csv", "EDA\n1\n")
    read = lambda: sorted((r["SID"], r["HR"], r["BVP"], r["EDA"]) for r in recordings.read_readings(spark, str(tmp_path)).fillna(-1.0).collect())
    whole = [("A", -1.0, -1.0, -1.0), ("A", 60.0, -1.0, -1.0), ("A", 61.0, 2.0, 3.0), ("A", 62.0, -1.0, 1.0), ("B", -1.0, -1.0, 1.0)]
    assert read() == whole
    monkeypatch.setattr(recordings, "BROADCAST_FILES", 0)
    assert read() == whole


def test_foreign_files_in_the_root(spark, tmp_path):
    head = "BVP,ACC_X,ACC_Y,ACC_Z,TEMP,EDA,HR,IBI,Sleep_Stage\n"
    put(tmp_path, "S007.csv", head + "1,2,3,4,33,1,60,900,N2\n")
    readings, refused = recordings.read_external(spark, str(tmp_path))
    assert [(r["SID"], r["Sleep_Stage"]) for r in readings.collect()] == [("S007", "N2")] and refused.count() == 0


def test_column_rules():
    assert columns.infer_id_column(["Age", "Record No", "x"]) == "Record No"
    assert columns.infer_id_column(["a", "b"]) == "a"
    assert columns.canonical_name(" acc x ") == "ACC_X"
    assert columns.pick_name(["bmi", "Sex"], ("GENDER", "Gender", "Sex")) == "Sex"
    assert columns.missing_columns(["BVP"], ("BVP", "HR")) == ["HR"]
    assert recordings.split_header('a,"b,c",,a') == ["a", "b,c", "_unnamed2", "a.3"]


def test_onehot_options(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (None, 1)], "Sleep_Stage_N1 int, Sleep_Stage_R int")
    assert [r["Sleep_Stage"] for r in columns.onehot_to_stage(df).collect()] == ["N1", "N1", "R"]
    assert columns.onehot_to_stage(df, True).first()["Sleep_Stage"] == "Unknown"
    single = df.select("Sleep_Stage_R")
    assert columns.onehot_to_stage(single).columns == ["Sleep_Stage_R"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "SID string, x double")
    sinks.write_by_sid(df, str(tmp_path / "p"), buckets=4)
    assert [r["x"] for r in sinks.read_by_sid(spark, str(tmp_path / "p"), "b", 4).collect()] == [2.0]
    nested = df.withColumn("n", F.array(F.struct("x")))
    sinks.write_features(nested, str(tmp_path / "csv"), True)
    text = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert json.loads(text.filter("SID = 'a'").first()["n"]) == [{"x": 1.0}]
    put(tmp_path, "board.csv", "model_name,accuracy,f1,precision,recall,roc_auc\nknn,0.5,nan,,x,0.7\n")
    assert tables.read_leaderboard(spark, str(tmp_path / "board.csv")).first().asDict() == {
        "model_name": "knn", "accuracy": 0.5, "f1": None, "precision": None, "recall": None, "roc_auc": 0.7,
    }
    put(tmp_path, "report.csv", "N,Sensitivity,Sensitivity_CI_95\n5,0.5,0.0–1.0\n")
    report = tables.read_report(spark, str(tmp_path / "report.csv")).first()
    assert (report["N"], report["Sensitivity_CI_95"]) == (5.0, "0.0–1.0")


def test_absent_channel_and_all_missing(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", None)], "SID string, HR double")
    got = features.recording_features(df).first().asDict()
    assert got["HR_mean"] is None and got["records"] == 2
    assert all(got[f"{c}_mean"] is None for c in CHANNELS)


def test_files_do_not_grow_with_sids(spark, tmp_path):
    """Many recordings of one task lie in one file; every row keeps its SID, odd ones included."""
    sids = [*[f"S{k}" for k in range(200)], "a b", "x,y", 'q"r', "50%", "l\nm", " é "]
    readings = spark.createDataFrame([(s, float(k)) for k, s in enumerate([*sids, None])], "SID string, HR double").coalesce(1)
    sinks.write_recording_files(readings, str(tmp_path / "r"))
    assert len(list((tmp_path / "r").rglob("*.csv"))) == 1
    got = recordings.read_readings(spark, str(tmp_path / "r"), "*.csv", nested=True)
    assert {(r["SID"], r["HR"]) for r in got.collect()} == {(r["SID"], r["HR"]) for r in readings.collect()}
