"""python -m lectern PATH...: checks recordings, prints the result, and exits 0 if all pass, 2 if not, 1 on misuse.

With --auto-mark, marked copies are written instead.
"""

from __future__ import annotations

import argparse
import dataclasses
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.checks import Settings
from .operators.completeness import missing_chapters
from .operators.script import sequence_warnings, verses
from .plans import report
from .plans.check import check_recordings, mark_recordings
from .sources import files as sources
from .sources.wav import list_files

#: Switches of the command line and the settings they turn off.
SWITCHES = {
    "no-format": ["enable_format"], "no-lufs": ["enable_loudness"], "no-true-peak": ["enable_true_peak"], "no-loudness": ["enable_loudness", "enable_true_peak"], "no-head-silence": ["enable_head_silence"],
    "no-tail-silence": ["enable_tail_silence"], "no-silence": ["enable_head_silence", "enable_tail_silence"], "no-markers": ["enable_markers"], "no-verses": ["enable_verses"],
}


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(prog="lectern")
    made.add_argument("paths", nargs="+", help="recordings or folders")
    for name, settings in SWITCHES.items():
        made.add_argument("--" + name, action="store_true", help="without " + ", ".join(x.removeprefix("enable_") for x in settings))
    made.add_argument("--config", help="settings, a JSON file")
    made.add_argument("--dimension", help="verse counts: a JSON object of books, each a list by chapter")
    made.add_argument("--aliases", help="a JSON object from names in file names to books")
    made.add_argument("--script", help="the verses' text, a plain text file")
    made.add_argument("--words", help="timed words (path, pos, start, end, word) of a recogniser, a Parquet table")
    made.add_argument("--language", default="", help="language code, for what was learned")
    made.add_argument("--state", help="state file with corrections")
    made.add_argument("--auto-mark", action="store_true", help="write marked copies (needs --script)")
    made.add_argument("--json", help="file for the whole result as JSON")
    made.add_argument("--mistakes", help="folder for a CSV of failing recordings")
    made.add_argument("--report", help="folder for a CSV of all checks")
    return made


def read_script(spark: SparkSession, path: str) -> DataFrame | None:
    """(verse, text) of a script, with what is told about it; None if it can't be read or has no verses."""
    try:
        found = verses(sources.read_scripts(spark, [path]), key="path", text="raw_text").select("verse", "text").persist()
        n = found.count()
    except Exception as e:  # whatever a reader raises is told, not raised
        print(f"the script can't be read: {str(e).splitlines()[0]}", file=sys.stderr)
        return None
    if not n:
        print("the script has no verses", file=sys.stderr)
        return None
    print(f"script with {n} verses")
    for line in sequence_warnings(found):
        print("  " + line)
    return found


def main(args: list[str]) -> int:
    chosen = parser().parse_args(args)
    recordings = list_files(chosen.paths)
    if not recordings:
        print("no recordings found", file=sys.stderr)
        return 1
    if chosen.auto_mark and not chosen.script:
        print("--auto-mark needs --script", file=sys.stderr)
        return 1
    settings = sources.load_settings(chosen.config) if chosen.config else Settings()
    off = {s: False for name, ss in SWITCHES.items() if getattr(chosen, name.replace("-", "_")) for s in ss}
    settings = dataclasses.replace(settings, **off, **({"enable_script_verification": True} if chosen.script else {}))
    spark = SparkSession.builder.appName("lectern").getOrCreate()
    script = None
    if chosen.script and (script := read_script(spark, chosen.script)) is None:
        return 1
    words = spark.read.parquet(chosen.words) if chosen.words else None
    if chosen.auto_mark:
        return _mark(spark, chosen, script, words)
    chapters = sources.read_dimension(spark, chosen.dimension) if chosen.dimension else None
    aliases = None
    if chapters is not None:
        own = chapters.select(F.col("book").alias("alias"), "book").distinct()
        aliases = sources.read_aliases(spark, chosen.aliases).unionByName(own).distinct() if chosen.aliases else own
    files, items = check_recordings(spark, chosen.paths, settings, aliases=aliases, chapters=chapters, sidecar=True, words=words, script=script)
    files, items = files.persist(), items.persist()
    if chapters is not None:
        totals = chapters.groupBy("book").agg(F.max("chapter").alias("total"))
        books = missing_chapters(files, totals.withColumnRenamed("book", "canonical_book"), book="canonical_book", chapter="chapter_no", total="total")
    else:
        books = missing_chapters(files, spark.createDataFrame([], "canonical_book string, total bigint"), book="canonical_book", chapter="chapter_no", total="total")
    books = books.persist()
    if chosen.json:
        report.write_json(files, items, books, chosen.json)
    if chosen.mistakes:
        report.mistakes_table(files, items, books).write.mode("overwrite").csv(chosen.mistakes, header=True)
    if chosen.report:
        report.full_table(files, items, books).write.mode("overwrite").csv(chosen.report, header=True)
    for r in report.console_lines(files, items, key="path").orderBy("path", "ord").toLocalIterator():
        print(r.line)
    bad = files.where("NOT passed").count()
    print(f"{len(recordings) - bad}/{len(recordings)} pass")
    for r in report.chapter_section(books).orderBy("book").toLocalIterator():
        print(f"{r.book}: {r.summary}")
    return report.exit_code(files, books)


def _mark(spark: SparkSession, chosen: argparse.Namespace, script: DataFrame, words: DataFrame | None) -> int:
    corrections = None
    if chosen.state:
        log = sources.read_state(spark, [chosen.state])
        corrections = log.select("profile", F.col("verse_number").alias("verse"), F.col("expected_time").alias("expected"), F.col("corrected_time").alias("corrected"), "seq")
    done = mark_recordings(spark, chosen.paths, script, words=words, corrections=corrections, language=chosen.language).persist()
    for r in done.orderBy("path").toLocalIterator():
        print(f"{'FAIL' if r.error else 'OK'}  {r.output or r.path}  {r.error or str(r.markers) + ' markers'}")
    good, n = done.where("error IS NULL").count(), len(list_files(chosen.paths))
    print(f"{good}/{n} marked")
    return 0 if good == n else 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
