"""Column naming and schema gates for foreign datasets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nocturne.functions.numeric import to_number
from nocturne.schemas import EVENTS, HOURS, LABEL, STAGE

# Names as foreign files spell them.
CANONICAL = {"acc_x": "ACC_X", "acc_y": "ACC_Y", "acc_z": "ACC_Z", "timestamp": "TIMESTAMP"}
ONE_HOT = {
    "Sleep_Stage_W": "W", "Sleep_Stage_N1": "N1", "Sleep_Stage_N2": "N2",
    "Sleep_Stage_N3": "N3", "Sleep_Stage_R": "R",
}
REQUIRED = ("BVP", "ACC_X", "ACC_Y", "ACC_Z", "EDA", "TEMP", "HR", "IBI", "Sleep_Stage")
ID_PATTERN = r"participant|subject|id|pid|record"
SYNONYMS = {
    "AGE": (("AGE", "Age"), None),
    "GENDER": (("GENDER", "Gender", "Sex", "SEX"), "Unknown"),
    "BMI": (("BMI", "Bmi"), None),
    "OAHI": (("OAHI", "oahi"), None),
    "AHI": (("AHI", "ahi"), None),
    "Mean_SaO2": (("Mean_SaO2", "SaO2", "SpO2", "MEAN_SAO2"), None),
    "Arousal Index": (("Arousal Index", "AROUSAL_INDEX", "arousal_index"), None),
    "MEDICAL_HISTORY": (("MEDICAL_HISTORY", "medical_history", "history"), ""),
    "Sleep_Disorders": (("Sleep_Disorders", "sleep_disorders", "diagnosis"), ""),
}
NOT_FEATURES = (LABEL, HOURS)


def canonical_name(name: str) -> str:
    plain = name.strip().replace(" ", "_")
    return CANONICAL.get(plain.lower(), plain)


def normalise_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[canonical_name(c) for c in df.columns])


def pick_name(columns: list[str], names: tuple[str, ...]) -> str | None:
    """The first wanted name any column matches, case ignored."""
    lowered = {}
    for c in columns:
        lowered.setdefault(c.lower(), c)
    return next((lowered[n.lower()] for n in names if n.lower() in lowered), None)


def pick(df: DataFrame, names: tuple[str, ...], default=None) -> Column:
    found = pick_name(df.columns, names)
    return F.lit(default).cast("string") if found is None else F.col(f"`{found}`").cast("string")


def infer_id_column(columns: list[str]) -> str:
    hits = [
        c for c in columns
        if re.search(ID_PATTERN, c, re.IGNORECASE) and c.lower() not in ("age", "bmi")
    ]
    return hits[0] if hits else columns[0]


def map_participants(df: DataFrame, id_column: str | None = None) -> DataFrame:
    """A foreign participant table in our columns, still as text."""
    key = id_column or infer_id_column(df.columns)
    return df.select(
        F.trim(F.col(f"`{key}`").cast("string")).alias("SID"),
        *[pick(df, names, default).alias(c) for c, (names, default) in SYNONYMS.items()],
    )


def onehot_to_stage(df: DataFrame, unknown_on_zero: bool = False) -> DataFrame:
    """Stage name of the largest one-hot column; the first wins a tie.

    An all-zero row gives the first column present unless ``unknown_on_zero``.
    Tables with a stage column or fewer than two one-hot columns pass through.
    """
    present = [c for c in ONE_HOT if c in df.columns]
    if STAGE in df.columns or len(present) < 2:
        return df
    numeric = {c: kind not in ("string",) for c, kind in df.dtypes}
    cells = {
        c: F.coalesce(F.col(c).cast("double") if numeric[c] else to_number(F.col(c)), F.lit(0.0))
        for c in present
    }
    return df.withColumn(STAGE, largest_stage(cells, unknown_on_zero))


def largest_stage(cells: dict[str, Column], unknown_on_zero: bool = False) -> Column:
    """The stage of the largest of one-hot cells by column name; NULL cells take no part."""
    top = F.greatest(*cells.values())
    stage = F.lit(None).cast("string")
    for c in reversed(list(cells)):
        stage = F.when(cells[c] == top, ONE_HOT[c]).otherwise(stage)
    return F.when(top > 0, stage).otherwise("Unknown") if unknown_on_zero else stage


def ensure_columns(df: DataFrame, columns: tuple[str, ...] = EVENTS) -> DataFrame:
    absent = {c: F.lit(None).cast("string") for c in columns if c not in df.columns}
    return df.withColumns(absent) if absent else df


def missing_columns(columns: list[str], required: tuple[str, ...] = REQUIRED) -> list[str]:
    return [c for c in required if c not in columns]


def stem_sid(stem: Column) -> Column:
    """``S`` and three digits anywhere in the name, upper-cased, else the whole name."""
    coded = F.upper(F.regexp_extract(stem, r"(?i)(S\d{3})", 1))
    return F.coalesce(F.nullif(coded, F.lit("")), F.trim(stem))


def feature_columns(
    columns: list[str], keep_id: bool = False, exclude: tuple[str, ...] = ()
) -> list[str]:
    """Model inputs: everything but targets, the id and the excluded names."""
    dropped = {*NOT_FEATURES, *exclude} | (set() if keep_id else {"SID"})
    return [c for c in columns if c not in dropped]


def require_two_classes(df: DataFrame, label: str = LABEL) -> DataFrame:
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().limit(3).collect()}
    if len([c for c in counts if c is not None]) < 2:
        raise ValueError(f"{label} needs at least two classes, found {counts}")
    return df
