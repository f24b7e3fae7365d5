"""Sensor recordings: many CSV files whose headers differ."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nocturne.functions.numeric import to_number
from nocturne.operators import columns as naming
from nocturne.operators.features import coerce_channels
from nocturne.operators.labels import null_tokens
from nocturne.runtime import cut_lineage
from nocturne.schemas import CHANNELS, EVENTS, ROW_SID, STAGE

# How recording files are named, and files that are none.
RECORDING_GLOB = "compressed_*_whole_df.csv"
NAMED_SID = r"(?i)compressed_(.+?)_whole_df\.csv$"
FOLDER_SID = r"/SID=([^/]+)/"
CODED_SID = r"(S\d{3})"
NOT_RECORDINGS = ("participant_info.csv", "psg_labels.csv")


def plain_file_name() -> Column:
    """The file's name as on disk; the metadata column has it URL-encoded.

    A plus sign is not encoded there but would be decoded to a blank.
    """
    return plain("_metadata.file_name")


def plain(column: str) -> Column:
    return F.url_decode(F.replace(F.col(column), F.lit("+"), F.lit("%2B")))


def sid_of(name: Column) -> Column:
    """SID in a recording's file name, or in a folder ``SID=...`` above it; NULL when there is none."""
    named = F.nullif(F.regexp_extract(name, NAMED_SID, 1), F.lit(""))
    named = F.coalesce(named, F.url_decode(F.nullif(F.regexp_extract(name, FOLDER_SID, 1), F.lit(""))))
    coded = F.nullif(F.regexp_extract(name, CODED_SID, 1), F.lit(""))
    return F.coalesce(named, coded)


def external_sid(name: Column) -> Column:
    """SID of a foreign file: a converted name first, else from the stem."""
    named = F.nullif(F.regexp_extract(name, NAMED_SID, 1), F.lit(""))
    return F.coalesce(named, naming.stem_sid(F.regexp_replace(name, r"(?i)\.csv$", "")))


def first_line(path: str) -> str:
    """First line of a file on any file system Arrow can open.

    The path is taken as written: names may hold blanks and percent signs.
    """
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme in ("file", path):
        system, inner = fs.LocalFileSystem(), "/" + (rest or path).lstrip("/")
    else:
        host, _, inner = rest.lstrip("/").partition("/")
        system, base = fs.FileSystem.from_uri(f"{scheme}://{host}/")
        inner = f"{base.rstrip('/')}/{inner}"
    line = b""
    with system.open_input_stream(inner) as stream:
        while part := stream.read(1 << 16):
            line += part
            if b"\n" in part or b"\r" in part:
                break
    # the reader's own line ends, and no others: a header may hold form feeds or U+2028
    return re.split(rb"[\r\n]", line, maxsplit=1)[0].decode("utf-8-sig", errors="replace")


def listed(spark: SparkSession, folder: str, pattern: str, nested: bool = False) -> DataFrame:
    """``path, name, opened`` of a folder's files: as scans name them, as on disk, and as readers open them.

    With ``nested`` files in folders below count too, and ``name`` is the whole path.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", nested).load(folder)
    name = plain("_metadata.file_path") if nested else plain_file_name()
    return files.select(F.col("_metadata.file_path").alias("path"), name.alias("name"), F.col("path").alias("opened"))


def with_headers(files: DataFrame) -> DataFrame:
    """Adds ``header``; tasks read the first line of their files only."""

    def first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(header=[first_line(p) for p in batch["opened"]])

    return files.mapInPandas(first_lines, "path string, name string, opened string, header string")


def split_header(header: str) -> list[str]:
    """Column names of a header line; repeated names get a number."""
    import csv

    names: list[str] = []
    for i, cell in enumerate(next(csv.reader([header]), [])):
        name = cell.strip() or f"_unnamed{i}"
        names.append(name if name not in names else f"{name}.{i}")
    return names


class Layout(NamedTuple):
    """Where a header has the wanted columns; None where it lacks them."""

    header: str
    width: int
    sid: int | None
    time: int | None
    cells: list[int | None]
    one_hot: list[int | None]
    missing: list[str]


#: Text columns that readings take from a file.
WANTED = (*CHANNELS, STAGE, *EVENTS)


def layout(header: str, foreign: bool = False) -> Layout:
    """The layout of a header line; a foreign one has its names normalised and may code stages one-hot."""
    names = split_header(header)
    width = len(names)
    if foreign:
        names = [naming.canonical_name(c) for c in names]
    place = lambda c: names.index(c) if c in names else None
    coded = [place(c) for c in naming.ONE_HOT] if foreign else []
    if STAGE in names or sum(k is not None for k in coded) < 2:
        coded = []
    have = [*names, *EVENTS, *([STAGE] if coded else [])]
    missing = naming.missing_columns(have) if foreign else []
    time = next((place(c) for c in ("ts", "TIMESTAMP") if c in names), None)
    return Layout(header, width, place(ROW_SID), time, [place(c) for c in WANTED], coded, missing)


_LAYOUT = "header string, width int, sid int, time int, cells array<int>, one_hot array<int>, missing array<string>"


def bound_files(spark: SparkSession, folder: str, pattern: str, skip: tuple[str, ...] = (), foreign: bool = False, nested: bool = False) -> tuple[DataFrame, int]:
    """The files of a folder with their layouts, and the widest header.

    The driver sees each distinct header once, no file names and no rows.
    """
    wanted = listed(spark, folder, pattern, nested)
    if skip:
        wanted = wanted.filter(~F.lower("name").isin(*skip))
    files = cut_lineage(with_headers(wanted))
    layouts = [layout(r["header"], foreign) for r in files.select("header").distinct().collect()]
    if not layouts:
        raise FileNotFoundError(f"no files like {pattern} in {folder}")
    known = spark.createDataFrame(layouts, _LAYOUT)
    return files.join(known, "header"), max(x.width for x in layouts)


#: Files whose layouts are sent to every task; with more, lines and layouts are joined by path.
BROADCAST_FILES = 200_000


def read_bound(
    spark: SparkSession, folder: str, pattern: str, files: DataFrame, width: int, sid: Column, nested: bool = False
) -> DataFrame:
    """All lines of ``files`` in one scan, every line cut by its own file's layout.

    ``sid`` is that of a file; where the layout has a column of SIDs, the row's own counts. A line that repeats its file's header in the first block of the file is no row.
    """
    lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", nested).text(folder).select(
        "value", F.col("_metadata.file_path").alias("path"), (F.col("_metadata.file_block_start") == 0).alias("first")
    )
    known = files.select("path", F.col("name").alias("_file"), "header", "sid", "time", "cells", "one_hot")
    if files.count() <= BROADCAST_FILES:
        known = F.broadcast(known)
    rows = lines.filter(F.col("value").rlike(r"[^\x00-\x20]")).join(known, "path")
    rows = rows.filter(~(F.col("first") & (F.regexp_replace("value", "^\ufeff", "") == F.col("header"))))
    names = [f"c{i}" for i in range(width)]
    parsed = F.from_csv("value", ", ".join(f"{n} string" for n in names))
    rows = rows.withColumn("row", parsed).withColumn("row", F.array(*[F.col(f"row.{n}") for n in names]))
    cell = lambda at: F.get("row", at)
    stage = WANTED.index(STAGE)
    coded = {c: F.get("one_hot", F.lit(k)) for k, c in enumerate(naming.ONE_HOT)}
    folded = naming.largest_stage(
        {c: F.when(at.isNotNull(), F.coalesce(to_number(cell(at)), F.lit(0.0))) for c, at in coded.items()}
    )
    has_coded = F.size("one_hot") > 0
    columns = [cell(F.get("cells", F.lit(k))).alias(c) for k, c in enumerate(WANTED)]
    columns[stage] = F.when(has_coded, folded).otherwise(cell(F.get("cells", F.lit(stage)))).alias(STAGE)
    bound = rows.select(
        F.when(F.col("sid").isNotNull(), F.url_decode(cell(F.col("sid")))).otherwise(sid).alias("SID"),
        cell(F.col("time")).try_cast("timestamp").alias("ts"),
        *columns,
        (has_coded | F.get("cells", F.lit(stage)).isNotNull()).alias("stage_present"),
    )
    return coerce_channels(null_tokens(bound, [STAGE, *EVENTS]))


def read_readings(spark: SparkSession, folder: str, pattern: str = RECORDING_GLOB, nested: bool = False) -> DataFrame:
    """All recordings of a folder in one scan, columns bound by each file's own header.

    A CSV scan would bind all files by position. Files without a SID in their path or rows (``ROW_SID``, as
    ``sinks.write_recording_files`` leaves them) raise when read. With ``nested`` the files may lie in folders.
    """
    files, width = bound_files(spark, folder, pattern, nested=nested)
    name = F.col("_file")
    sid = F.coalesce(
        sid_of(name), F.raise_error(F.concat(F.lit("no SID in file name "), name)).cast("string")
    )
    return read_bound(spark, folder, pattern, files, width, sid, nested)


def is_folder(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def read_external(spark: SparkSession, root: str, in_root: bool = False) -> tuple[DataFrame, DataFrame]:
    """A foreign dataset folder as (accepted readings, rejected files).

    The files lie in ``data_64Hz``, or in the folder itself where there is no such folder or
    ``in_root`` says so. Column names are normalised, one-hot stages folded, absent event columns
    added; files that still lack a required column are rejected, not an error.
    """
    inner = f"{root.rstrip('/')}/data_64Hz"
    folder = root if in_root or not is_folder(spark, inner) else inner
    files, width = bound_files(spark, folder, "*.csv", NOT_RECORDINGS, foreign=True)
    accepted = files.filter(F.size("missing") == 0)
    if accepted.isEmpty():
        raise ValueError(f"no file in {folder} has the required columns")
    refused = files.filter(F.size("missing") > 0).select(F.col("opened").alias("path"), "missing")
    return read_bound(spark, folder, "*.csv", accepted, width, external_sid(F.col("_file"))), refused
