"""The whole check of a folder of recordings."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dsp import measure_files
from ..operators import checks, identity, marking, reconcile, series
from ..operators import script as scripts
from ..operators.series import segments
from ..sources import files as files_
from ..sources import wav


def check_recordings(
    spark: SparkSession, paths: list[str], settings: checks.Settings = checks.Settings(), *,
    aliases: DataFrame | None = None, chapters: DataFrame | None = None, sidecar: DataFrame | bool = False, words: DataFrame | None = None, script: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(files, items): the recordings with their identity and overall result, and all check items.

    Only what the settings enable is planned. 'CSV Match' is added for recordings with markers and a sidecar file: with
    sidecar=True the files of the same stem beside them are looked up and read, or a table (path, name, start_seconds,
    csv_id) is given. 'Script Match' is added with words(path, pos, start, end, word), the output of any speech
    recogniser, and script(verse, text), for all recordings, or script(path, verse, text): each marked verse is compared
    with the words heard up to the next marker. A header that can't be read is the file's error, and it has no items.
    """
    header = wav.read(spark, paths, "header")
    good = header.where("error IS NULL")
    markers = wav.read(spark, paths, "markers")
    measured = good.select("path", "sample_rate", "bits")
    if settings.meter_available and (settings.enable_loudness or settings.enable_true_peak):
        level = measure_files(good.select("path")).select("path", "lufs", "true_peak")
        measured = measured.join(level, "path", "left")
    else:
        measured = measured.withColumns({"lufs": F.lit(None).cast("double"), "true_peak": F.lit(None).cast("double")})
    if settings.enable_head_silence or settings.enable_tail_silence:
        quiet = wav.silence(wav.read(spark, paths, "peaks", edgeseconds=min(60.0, max(1.0, 3 * settings.silence_seconds))), threshold_dbfs=settings.silence_threshold_dbfs, expected_s=settings.silence_seconds)
        measured = measured.join(quiet, "path", "left")
    else:
        measured = measured.withColumns({"head_silence": F.lit(None).cast("double"), "tail_silence": F.lit(None).cast("double")})
    files = header.select("path", "filename", "error")
    if aliases is not None and chapters is not None:
        files = identity.identify(files, aliases, chapters).withColumnRenamed("verses", "expected_verses")
    else:
        files = files.withColumns({"canonical_book": F.lit(None).cast("string"), "chapter_no": F.lit(None).cast("bigint"), "expected_verses": F.lit(None).cast("bigint")})
    readable = files.where("error IS NULL")
    items = checks.measurement_items(measured, settings, key="path")
    if settings.enable_markers or settings.enable_verses:
        items = items.unionByName(checks.marker_items(readable, markers, settings, key="path"))
    marked = markers.select("path").distinct()
    if sidecar is True:
        sidecar = sidecar_markers(spark, paths)
    if sidecar is not False and sidecar is not None:
        pairs = reconcile.compare_markers(markers, sidecar.join(marked, "path", "left_semi"), path="path", name="name", label="label", seconds="seconds", start="start_seconds", order="cue_id", sidecar_order="csv_id")
        pairs = pairs.join(sidecar.select("path").distinct(), "path", "left_semi")
        items = items.unionByName(checks.sidecar_items(pairs))
    if settings.enable_script_verification and words is not None and script is not None:
        asked = script if "path" in script.columns else for_each(marked, script)
        compared = scripts.verify(markers, words, asked, good.select("path", "seconds"), threshold=settings.script_match_threshold, verse_word=settings.verse_word)
        items = items.unionByName(checks.script_items(compared))
    return checks.overall(files, items, key="path", error="error"), items


def sidecar_markers(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """(path, name, start_seconds, csv_id) of the sidecar files beside recordings; None if there are none."""
    found = {}
    for path in wav.list_files(paths):
        stem = os.path.splitext(path)[0]
        beside = next((stem + end for end in (".csv", ".CSV") if os.path.isfile(stem + end)), None)
        if beside:
            found[beside] = path
    if not found:
        return None
    listed = spark.createDataFrame(list(found.items()), "sidecar string, recording string")
    rows = files_.read_markers(spark, sorted(found)).withColumnRenamed("path", "sidecar").join(listed, "sidecar")
    return rows.select(F.col("recording").alias("path"), "name", "start_seconds", F.col("ord").cast("bigint").alias("csv_id"))


def for_each(recordings: DataFrame, script: DataFrame) -> DataFrame:
    """(path, verse, text): the verses of one script, a chapter at most, for each recording."""
    told = json.dumps([{"verse": int(r.verse), "text": r.text} for r in script.select("verse", "text").collect()])
    return recordings.select("path", F.explode(F.from_json(F.lit(told), "array<struct<verse:bigint,text:string>>")).alias("v")).select("path", "v.*")


def mark_recordings(
    spark: SparkSession, paths: list[str], script: DataFrame, *, words: DataFrame | None = None, corrections: DataFrame | None = None, language: str = "", reader: str = "", min_pause_s: float = 0.3, threshold_dbfs: float = -40.0,
) -> DataFrame:
    """(path, output, markers, error): a marked copy of each recording, and its marker file, from script(verse, text).

    Markers are placed by words where a recogniser gave some, else by pauses found in the recording, else evenly, and
    corrected by what was learned for the language and reader. Runs when the result is used.
    """
    header = wav.read(spark, paths, "header").where("error IS NULL")
    profile = ":".join((language or "unknown", reader or "default"))
    files = header.select("path", F.lit(script.count()).alias("verses"), F.col("seconds").alias("duration"), F.col("sample_rate").alias("rate"), F.lit(profile).alias("profile"))
    peaks = wav.read(spark, paths, "peaks", whole=True)
    pauses = series.pauses(peaks, keys=["path"], start="t0", width="dur_s", peak="peak", threshold=10 ** (threshold_dbfs / 20), least=min_pause_s)
    each = for_each(header.select("path"), script) if words is not None else None
    placed = marking.auto_mark(files, each, key="path", verses="verses", duration="duration", rate="rate", words=words, pauses=pauses, corrections=corrections, profile=["profile"])
    return wav.write_marked(placed, sidecar=True)


def verse_segments(markers: DataFrame, files: DataFrame, *, duration: str = "seconds") -> DataFrame:
    """(path, verse, start_s, end_s): from each verse marker to the next marker of any kind, or the recording's end."""
    marked = checks.classify(markers, checks.Settings()).join(files.select("path", F.col(duration).alias("__end")), "path")
    parts = segments(marked, keys=["path"], start="seconds", tie="cue_id", end_of_group=F.col("__end"))
    return parts.where("category = 'verse'").select("path", "verse", F.col("seconds").alias("start_s"), F.col("segment_end").alias("end_s"))
