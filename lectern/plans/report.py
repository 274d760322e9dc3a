"""Reports of a batch of recordings."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nested(files: DataFrame, items: DataFrame, *, key: str) -> DataFrame:
    """files with checks, an array of structs (name, status, value, detail) in order; empty where there are none."""
    status = F.when(F.col("passed"), "PASS").otherwise("FAIL")
    each = F.struct("ord", "name", status.alias("status"), F.coalesce("value", F.lit("")).alias("value"), F.coalesce("detail", F.lit("")).alias("detail"))
    lists = items.groupBy(key).agg(F.array_sort(F.collect_list(each)).alias("checks"))
    lists = lists.withColumn("checks", F.transform("checks", lambda c: F.struct(c["name"].alias("name"), c.status.alias("status"), c.value.alias("value"), c.detail.alias("detail"))))
    empty = F.array().cast("array<struct<name:string,status:string,value:string,detail:string>>")
    return files.join(lists, key, "left").withColumn("checks", F.coalesce("checks", empty))


def json_lines(files: DataFrame, items: DataFrame, *, key: str) -> DataFrame:
    """One JSON object a recording, in the column value: ready for DataFrameWriter.text."""
    full = nested(files, items, key=key)
    return full.select(F.to_json(F.struct(*[F.col(c) for c in full.columns]), {"ignoreNullFields": "false"}).alias("value"))


def mistakes(files: DataFrame, items: DataFrame, *, key: str, error: str = "error") -> DataFrame:
    """(key, issues): recordings with a hard error or failed items, these as 'name: detail' joined by ' | ' in order."""
    failed = items.where(~F.col("passed")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", F.concat_ws(": ", "name", F.coalesce("detail", F.lit(""))).alias("t")))).alias("x"))
    out = files.select(key, F.col(error).alias("__e")).join(failed, key, "left").where("__e IS NOT NULL OR x IS NOT NULL")
    return out.select(key, F.coalesce("__e", F.array_join(F.transform("x", lambda i: i.t), " | ")).alias("issues"))


def full(files: DataFrame, items: DataFrame, *, key: str, error: str = "error") -> DataFrame:
    """One row a check, and one row ERROR for each recording that couldn't be read."""
    base = files.select(key, F.col(error).alias("__e"))
    status = F.when(F.col("passed"), "PASS").otherwise("FAIL")
    rows = items.join(base.where("__e IS NULL"), key).select(key, F.col("name").alias("Check"), status.alias("Status"), F.col("value").alias("Value"), F.col("detail").alias("Detail"))
    broken = base.where("__e IS NOT NULL").select(key, F.lit("ERROR").alias("Check"), F.lit("FAIL").alias("Status"), F.lit("").alias("Value"), F.col("__e").alias("Detail"))
    return rows.unionByName(broken)


def console_lines(files: DataFrame, items: DataFrame, *, key: str, error: str = "error") -> DataFrame:
    """(key, ord, line): what a terminal shows for each recording: its result, then its checks in order."""
    mark = F.when(F.col("passed"), "PASS").otherwise("FAIL")
    known = F.lit("")
    if {"canonical_book", "chapter_no", "expected_verses"} <= set(files.columns):
        known = F.when(F.col("canonical_book").isNotNull(), F.format_string("  [%s %d, expect %d verses]", "canonical_book", "chapter_no", "expected_verses")).otherwise("")
    heads = files.select(key, F.lit(0).alias("ord"), F.concat(mark, F.lit("  "), F.col(key), known, F.when(F.col(error).isNotNull(), F.concat(F.lit("  "), F.col(error))).otherwise("")).alias("line"))
    rows = items.select(key, "ord", F.concat(F.lit("    "), F.rpad("name", 16, " "), mark, F.lit("  "), F.coalesce("value", F.lit("")), F.when(F.col("passed"), "").otherwise(F.concat(F.lit("  "), F.coalesce("detail", F.lit(""))))).alias("line"))
    return heads.unionByName(rows)


def tally(rows: DataFrame, status: str) -> DataFrame:
    """How many rows have each status: done, skipped and failed ones of a batch run."""
    return rows.groupBy(F.coalesce(F.col(status), F.lit("none")).alias("status")).agg(F.count("*").alias("n"))


def chapter_section(chapters: DataFrame) -> DataFrame:
    """(book, summary) of the books with missing or repeated chapters, from completeness.missing_chapters."""
    rows = chapters.where(~F.col("complete") | (F.size("repeated") > 0))
    told = F.concat_ws("; ", F.when(~F.col("complete"), F.concat(F.lit("missing "), "missing_text")), F.when(F.size("repeated") > 0, F.concat(F.lit("repeated "), F.array_join(F.col("repeated").cast("array<string>"), ", "))))
    return rows.select("book", told.alias("summary"))


def mistakes_table(files: DataFrame, items: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """(File, Book, Chapter, Issues) of the failing recordings, then of books with missing or repeated chapters."""
    named = files.select("path", F.col("filename").alias("File"), F.col("canonical_book").alias("Book"), F.col("chapter_no").cast("string").alias("Chapter"))
    out = mistakes(files, items, key="path").join(named, "path").select("File", "Book", "Chapter", F.col("issues").alias("Issues"))
    if chapters is None:
        return out
    return out.unionByName(chapter_section(chapters).select(F.lit(None).cast("string").alias("File"), F.col("book").alias("Book"), F.lit(None).cast("string").alias("Chapter"), F.col("summary").alias("Issues")))


def full_table(files: DataFrame, items: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """One row a check with the recording's identity and overall result, then the books with missing or repeated chapters."""
    named = files.select("path", F.col("filename").alias("File"), F.col("canonical_book").alias("Book"), F.col("chapter_no").cast("string").alias("Chapter"), F.col("expected_verses").cast("string").alias("ExpectedVerses"), F.when(F.col("passed"), "PASS").otherwise("FAIL").alias("Overall"))
    out = full(files, items, key="path").join(named, "path").drop("path")
    if chapters is None:
        return out
    none = F.lit(None).cast("string")
    have = F.concat((F.col("total_chapters") - F.size("missing")).cast("string"), F.lit("/"), F.col("total_chapters").cast("string"))
    lacking = chapters.where("NOT complete").select("book", "total_chapters", F.lit("Missing Chapters").alias("Check"), F.lit("FAIL").alias("Status"), have.alias("Value"), F.col("missing_text").alias("Detail"))
    twice = chapters.where(F.size("repeated") > 0).select("book", "total_chapters", F.lit("Repeated Chapters").alias("Check"), F.lit("WARN").alias("Status"), F.lit("").alias("Value"), F.array_join(F.col("repeated").cast("array<string>"), ", ").alias("Detail"))
    rows = lacking.unionByName(twice)
    return out.unionByName(rows.select(none.alias("File"), F.col("book").alias("Book"), none.alias("Chapter"), F.col("total_chapters").cast("string").alias("ExpectedVerses"), F.when(F.col("Status") == "FAIL", "FAIL").otherwise("").alias("Overall"), "Check", "Status", "Value", "Detail"))


def write_json(files: DataFrame, items: DataFrame, chapters: DataFrame, path: str) -> None:
    """Writes one JSON document {files, missing_chapters}; rows come to the driver one partition at a time."""
    named = files.select("path", F.col("filename").alias("file"), F.col("canonical_book").alias("book"), F.col("chapter_no").alias("chapter"), "expected_verses", "passed", "error")
    books = chapters.select("book", "total_chapters", F.col("present").alias("chapters_found"), F.col("missing").alias("chapters_missing"), F.col("repeated").alias("duplicate_chapters"), "complete")
    with open(path + ".part", "w", encoding="utf-8") as out:
        for name, rows, start in (("files", json_lines(named, items, key="path").orderBy("value"), '{"files": ['), ("missing_chapters", books.orderBy("book").select(F.to_json(F.struct(*books.columns), {"ignoreNullFields": "false"}).alias("value")), '], "missing_chapters": [')):
            out.write(start)
            for i, r in enumerate(rows.toLocalIterator()):
                out.write((",\n" if i else "") + r.value)
        out.write("]}\n")
    os.replace(path + ".part", path)


def exit_code(overall: DataFrame, chapters: DataFrame) -> int:
    """0 if every recording passes and every book is complete, else 2."""
    bad = overall.where(~F.col("passed")).limit(1).count() + chapters.where(~F.col("complete")).limit(1).count()
    return 2 if bad else 0
