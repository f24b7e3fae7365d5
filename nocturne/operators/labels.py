"""Participant labels and derived clinical columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nocturne.functions import clinical
from nocturne.functions.numeric import percent_number
from nocturne.operators.fill import fit_medians
from nocturne.operators.select import pick_ranks
from nocturne.schemas import CLINICAL_NUMBERS, HOURS, LABEL, NA_TOKENS, TRUTH


def null_tokens(df: DataFrame, columns: list[str], tokens=NA_TOKENS) -> DataFrame:
    """Cells holding one of the missing-value texts become NULL."""
    return df.withColumns(
        {c: F.when(~F.col(f"`{c}`").isin(*tokens), F.col(f"`{c}`")) for c in columns}
    )


def clean_participants(df: DataFrame) -> DataFrame:
    """Trim the id, read the numbers, drop the missing-value texts."""
    texts = [name for name, kind in df.dtypes if kind == "string" and name != "SID"]
    df = null_tokens(df, texts)
    return df.withColumns(
        {
            "SID": F.trim(F.col("SID").cast("string")),
            **{c: percent_number(F.col(f"`{c}`")) for c in CLINICAL_NUMBERS if c in df.columns},
        }
    )


def _flag():
    return clinical.apnea_flag(F.col("Sleep_Disorders"), F.col("MEDICAL_HISTORY"))


def with_heuristic_label(df: DataFrame, name: str = LABEL) -> DataFrame:
    label = clinical.heuristic_label(
        F.col("OAHI"), F.col("AHI"), F.col("`Arousal Index`"), _flag()
    )
    return df.withColumn(name, label)


def with_severity(df: DataFrame, name: str = "severity") -> DataFrame:
    """Severity score from median-filled numbers."""
    medians = fit_medians(df, ["OAHI", "AHI", "Arousal Index"])
    filled = {
        c: F.coalesce(F.col(f"`{c}`"), F.lit(medians.get(c)).cast("double"))
        for c in ("OAHI", "AHI", "Arousal Index")
    }
    score = clinical.severity(filled["OAHI"], filled["AHI"], filled["Arousal Index"], _flag())
    return df.withColumn(name, score)


def severity_label(df: DataFrame, name: str = LABEL) -> DataFrame:
    """The most severe half is positive; ties by SID, rows without a severity last.

    The cut is found by counting, first among the severities and then among the SIDs that tie there, so the
    table is never ordered. Rows equal in both get the same label.
    """
    total = df.count()
    positives = min(max(1, total // 2), total - 1)
    scored = with_severity(df, "_severity")
    severity, sid = F.col("_severity"), F.coalesce(F.col("SID").cast("string"), F.lit(""))
    if positives < 1:
        return scored.withColumn(name, F.lit(0)).drop("_severity")
    cells = scored.filter(severity.isNotNull()).select(F.lit(0).alias("search"), (-severity).alias("value"))
    found = pick_ranks(cells, {0: positives - 1})
    if found:
        above, level = severity > F.lit(-found[0]), severity == F.lit(-found[0])
    else:
        above, level = severity.isNotNull(), severity.isNull()
    left = positives - scored.filter(above).count()
    last = pick_ranks(scored.filter(level).select(F.lit(0).alias("search"), sid.alias("value")), {0: left - 1}) if left else {}
    chosen = above | (level & (sid <= F.lit(last[0]))) if last else above
    return scored.withColumn(name, F.coalesce(chosen, F.lit(False)).cast("int")).drop("_severity")


def deprivation_label(df: DataFrame, name: str = LABEL) -> DataFrame:
    """Heuristic label; when it has one class only, the severity rank decides."""
    labelled = with_heuristic_label(df, name)
    ends = labelled.agg(F.min(name).alias("low"), F.max(name).alias("high")).first()
    if ends["low"] != ends["high"]:
        return labelled
    return severity_label(df, name)


def with_recommended_hours(df: DataFrame, name: str = HOURS) -> DataFrame:
    columns = ["BMI", "Arousal Index", "AHI", "Mean_SaO2"]
    medians = fit_medians(df, columns)
    filled = [
        F.coalesce(F.col(f"`{c}`"), F.lit(medians.get(c)).cast("double")) for c in columns
    ]
    return df.withColumn(name, clinical.recommended_hours(*filled))


def with_truth_label(df: DataFrame, name: str = TRUTH) -> DataFrame:
    medians = fit_medians(df, ["AHI", "OAHI"])
    filled = [
        F.coalesce(F.col(c), F.lit(medians.get(c)).cast("double")) for c in ("AHI", "OAHI")
    ]
    return df.withColumn(name, clinical.truth_label(*filled))
