"""Which book and chapter a recording is, told from its file name and dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import stem


def parse_filename(files: DataFrame, filename: str = "filename") -> DataFrame:
    """files with book_key (lower case, without blanks and underscores) and chapter_no, both null where it has no number."""
    base = stem(F.col(f"`{filename}`"))
    shape = r"(?U)^\s*(.+?)[\s_\-.]+(\d+)\s*$"
    book = F.regexp_extract(base, shape, 1)
    digits = F.regexp_extract(base, shape, 2)
    return files.withColumns({"book_key": F.when(book != "", F.regexp_replace(F.lower(book), r"[ _]", "")), "chapter_no": F.when(digits != "", digits.try_cast("bigint"))})


def identify(files: DataFrame, aliases: DataFrame, chapters: DataFrame, filename: str = "filename") -> DataFrame:
    """files with canonical_book, chapter_no and verses, null where the name isn't recognised or the chapter doesn't exist.

    aliases(alias, book) and chapters(book, chapter, verses) are dimension tables. Names are looked up without case,
    blanks and underscores. Without a hint Spark broadcasts the dimensions as long as they are small.
    """
    keyed = parse_filename(files, filename)
    names = aliases.select(F.regexp_replace(F.lower("alias"), r"[ _]", "").alias("book_key"), F.col("book").alias("canonical_book")).groupBy("book_key").agg(F.min("canonical_book").alias("canonical_book"))
    dim = chapters.select(F.col("book").alias("canonical_book"), F.col("chapter").cast("bigint").alias("chapter_no"), F.col("verses").alias("verses"))
    out = keyed.join(names, "book_key", "left").join(dim, ["canonical_book", "chapter_no"], "left")
    known = F.col("verses").isNotNull()
    return out.withColumns({"canonical_book": F.when(known, F.col("canonical_book")), "chapter_no": F.when(known, F.col("chapter_no"))}).drop("book_key")


def dimension_totals(chapters: DataFrame) -> DataFrame:
    """Chapters and verses of each book of the dimension."""
    return chapters.groupBy("book").agg(F.count("*").alias("chapters"), F.sum("verses").alias("verses"))
