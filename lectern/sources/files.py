"""Sidecar marker files, scripts, settings and state as tables."""

from __future__ import annotations

import csv
import dataclasses
import io
import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import basename
from ..functions.timecode import format_time, parse_time
from ..operators.checks import Settings
from ..operators.state import profiles

#: The columns of sidecar files, found by their names in the header, and what a missing one stands for.
COLUMNS = {"Name": "", "Start": "0:00.000", "Duration": "0:00.000", "Time Format": "decimal", "Type": "Cue", "Description": ""}


def marker_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, line_no, name, start, duration, time_format, marker_type, description, reason) of sidecar files as read.

    Tab-separated with a header, whose names say what the columns are, in any order; a byte order mark is allowed. A record
    with fewer fields than the header has the reason 'columns', an unreadable file one record with its error; reason is
    null for all others. A sidecar file is a small file, read by one task as a whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows = csv.reader(io.StringIO(bytes(content).decode("utf-8-sig"), newline=""), delimiter="\t")
                    header = next(rows, [])
                    at = {c: header.index(c) for c in COLUMNS if c in header}
                    for row in rows:
                        if row:
                            short = len(row) < len(header)
                            out.append((path, rows.line_num, *[row[at[c]].strip() if c in at and at[c] < len(row) else None if c in at else d for c, d in COLUMNS.items()], "columns" if short else None))
                except (UnicodeDecodeError, csv.Error) as e:
                    out.append((path, None, *[None] * len(COLUMNS), str(e)))
            yield pd.DataFrame(out, columns=["path", "line_no", "name", "start", "duration", "time_format", "marker_type", "description", "reason"]).astype({"line_no": "Int64"})

    content = spark.read.format("binaryFile").load(paths).select(local_path(F.col("path")).alias("path"), "content")
    return content.mapInPandas(run, "path string, line_no long, name string, start string, duration string, time_format string, marker_type string, description string, reason string")


def read_markers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, ord, name, start_seconds, duration_seconds, time_format, marker_type, description), in order of start.

    Records without a name are left out, and those that can't be read (see marker_records, which tells them). `ord` numbers
    a file's rows by start.
    """
    rows = marker_records(spark, paths).where("reason IS NULL AND name <> ''")
    made = rows.select("path", "line_no", "name", parse_time(F.col("start")).alias("start_seconds"), parse_time(F.col("duration")).alias("duration_seconds"), "time_format", "marker_type", "description")
    return made.withColumn("ord", F.row_number().over(Window.partitionBy("path").orderBy("start_seconds", "line_no"))).drop("line_no")


def local_path(path: Column) -> Column:
    """A path as Spark names it, without the scheme of local files."""
    return F.regexp_replace(path, "^file:/*", "/")


def marker_lines(markers: DataFrame, *, key: str = "path", order: str = "start_seconds") -> DataFrame:
    """(key, content): the text of each recording's sidecar file, with byte order mark and header, rows in order."""
    row = F.concat_ws("\t", "name", format_time(F.col("start_seconds")), format_time(F.coalesce("duration_seconds", F.lit(0.0))), F.coalesce("time_format", F.lit("decimal")), F.coalesce("marker_type", F.lit("Cue")), F.coalesce("description", F.lit("")))
    lists = markers.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("t")))).alias("x"))
    head = "﻿Name\tStart\tDuration\tTime Format\tType\tDescription\n"
    return lists.select(key, F.concat(F.lit(head), F.array_join(F.transform("x", lambda r: r.t), "\n"), F.lit("\n")).alias("content"))


def find_sidecars(recordings: DataFrame, listed: DataFrame, *, path: str = "path") -> DataFrame:
    """recordings with sidecar: the file of the same folder and stem ending in .csv, or else in .CSV; null if neither."""
    body = F.regexp_replace(F.col(path), r"\.[^./\\]*$", "")
    found = listed.select(F.col(path).alias("sidecar"), F.regexp_replace(F.col(path), r"\.[^./\\]*$", "").alias("__stem")).where(F.col("sidecar").rlike(r"\.(?:csv|CSV)$"))
    best = found.groupBy("__stem").agg(F.min_by("sidecar", F.when(F.col("sidecar").endswith(".csv"), 0).otherwise(1)).alias("sidecar"))
    return recordings.withColumn("__stem", body).join(best, "__stem", "left").drop("__stem")


def read_scripts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, filename, raw_text) of plain text scripts, one row a file."""
    rows = spark.read.text(paths, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), basename(F.col("_metadata.file_path")).alias("filename"), F.col("value").alias("raw_text"))


def read_documents(spark: SparkSession, paths: list[str], extract: Callable[[bytes], str]) -> DataFrame:
    """(path, filename, raw_text, error) of binary documents, by any function from a file's bytes to its text.

    The function is called in the tasks; pages are separated by it as it likes, and a failure is noted for its file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows.append((path, path.rsplit("/", 1)[-1], extract(bytes(content)).strip(), None))
                except Exception as e:  # whatever a library of others raises is that file's error
                    rows.append((path, path.rsplit("/", 1)[-1], None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "filename", "raw_text", "error"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "path string, filename string, raw_text string, error string")


def output_name(path: str, kind: str) -> str:
    """SQL for the name of a derived file: '<stem>_marked.wav' beside it, or '<first part>_Mastered|_Fixed/<name>'."""
    if kind == "marked":
        return f"regexp_replace({path}, '(\\\\.[^./]*)$', '_marked$1')"
    folder = {"mastered": "_Mastered", "fixed": "_Fixed"}[kind]
    return f"regexp_replace({path}, '([^/_ .-]+)([^/]*)$', '$1{folder}/$1$2')"


def settings_from(text: str) -> tuple[Settings, list[str]]:
    """(settings, names left out) from a JSON object: each value is taken if its name is known and its kind fits."""
    try:
        found = json.loads(text)
    except ValueError:
        return Settings(), ["the whole file"]
    if not isinstance(found, dict):
        return Settings(), ["the whole file"]
    taken, left = {}, []
    defaults = dataclasses.asdict(Settings())
    for name, value in found.items():
        kind = type(defaults.get(name))
        fits = isinstance(value, (int, float)) and not isinstance(value, bool) if kind in (int, float) else isinstance(value, kind)
        if name in defaults and fits and (kind is not int or float(value).is_integer()):
            taken[name] = kind(value)
        else:
            left.append(name)
    return Settings(**taken), left


def load_settings(path: str) -> Settings:
    """Settings from a file (see settings_from); the defaults where there is none."""
    if not os.path.isfile(path):
        return Settings()
    with open(path, encoding="utf-8", errors="replace") as file:
        return settings_from(file.read())[0]


def save_settings(settings: Settings, path: str) -> None:
    with open(path, "w", encoding="utf-8") as file:
        json.dump(dataclasses.asdict(settings), file, indent=2)


CORRECTION = T.StructType(
    [T.StructField("language", T.StringType()), T.StructField("verse_number", T.LongType()), T.StructField("expected_time", T.DoubleType()), T.StructField("corrected_time", T.DoubleType()), T.StructField("reader_id", T.StringType()), T.StructField("timestamp", T.DoubleType())]
)
STATE = T.StructType([T.StructField("version", T.LongType()), T.StructField("profiles", T.MapType(T.StringType(), T.StructType([T.StructField("average_pause_duration", T.DoubleType()), T.StructField("corrections", T.ArrayType(CORRECTION))])))])


def read_state(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The corrections held in state files, with the profile's key and their place; an unreadable file gives no rows."""
    raw = spark.read.text(paths, wholetext=True).select(F.from_json("value", STATE).alias("s"))
    rows = raw.select(F.explode("s.profiles").alias("profile", "p")).select("profile", F.posexplode("p.corrections").alias("seq", "c"))
    return rows.select("profile", "seq", "c.*")


def save_state(corrections: DataFrame, path: str, pauses: DataFrame | None = None) -> None:
    """Writes a state file from corrections(profile, seq, language, verse_number, expected_time, corrected_time, reader_id,
    timestamp) and pauses(profile, mean), so that read_state gives the same corrections.

    Profiles are made in the tasks and come to the driver one partition at a time, to be written to the one file.
    """
    known = profiles(corrections, keys=["profile"], expected="expected_time", corrected="corrected_time")
    each = F.struct("seq", F.struct("language", "verse_number", "expected_time", "corrected_time", "reader_id", "timestamp").alias("c"))
    logs = corrections.groupBy("profile").agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: x.c).alias("corrections"))
    out = logs.join(known.select("profile", F.col("corrections").alias("total_corrections"), F.col("mean_offset").alias("average_offset_s"), F.col("mean_speed").alias("average_speed_factor")), "profile")
    out = out.join(pauses.select("profile", F.col("mean").alias("average_pause_duration")), "profile", "left") if pauses is not None else out.withColumn("average_pause_duration", F.lit(0.5))
    out = out.withColumn("average_pause_duration", F.coalesce("average_pause_duration", F.lit(0.5))).withColumns({"language": F.substring_index("profile", ":", 1), "reader_id": F.substring_index("profile", ":", -1)})
    rows = out.select("profile", F.to_json(F.struct("language", "reader_id", "total_corrections", "average_offset_s", "average_speed_factor", "average_pause_duration", "corrections")).alias("j"))
    with open(path + ".part", "w", encoding="utf-8") as file:
        file.write('{"version": 1, "profiles": {')
        for i, r in enumerate(rows.toLocalIterator()):
            file.write((", " if i else "") + json.dumps(r.profile) + ": " + r.j)
        file.write("}}")
    os.replace(path + ".part", path)


def read_dimension(spark: SparkSession, path: str) -> DataFrame:
    """(book, chapter, verses) from a JSON object of books, each with the list of its chapters' verse counts."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<bigint>>")).alias("book", "v"))
    return raw.select("book", F.posexplode("v").alias("i", "verses")).select("book", (F.col("i") + 1).alias("chapter"), "verses")


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(alias, book) from a JSON object of aliases."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("alias", "book"))
