"""Whether the numbers found cover the range expected, and how the rest is told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranges(numbers: Column) -> Column:
    """An array of whole numbers as '3-5, 9': runs of neighbours joined, in order, duplicates once. '' for an empty array."""
    start = F.struct(F.lit("").alias("done"), F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("b"))
    show = lambda x: F.when(x.a.isNull(), x.done).otherwise(
        F.concat(x.done, F.when(x.done != "", ", ").otherwise(""), F.when(x.a == x.b, x.a.cast("string")).otherwise(F.concat(x.a.cast("string"), F.lit("-"), x.b.cast("string"))))
    )

    def step(acc: Column, n: Column) -> Column:
        follows = F.coalesce(n == acc.b + 1, F.lit(False))
        return F.when(follows, F.struct(acc.done.alias("done"), acc.a.alias("a"), n.alias("b"))).otherwise(F.struct(show(acc).alias("done"), n.alias("a"), n.alias("b")))

    tidy = F.array_sort(F.array_distinct(F.filter(numbers.cast("array<bigint>"), lambda n: n.isNotNull())))
    return F.aggregate(tidy, start, step, show)


def completeness(found: DataFrame, expected: DataFrame, *, keys: list[str], number: str, upto: str) -> DataFrame:
    """For each group of `expected`, the numbers 1 to `upto` that are missing, those beyond, and those found repeatedly.

    Columns: the keys, expected, found (rows, repeats included), missing and extra and repeated as arrays, missing_text
    and passed. Numbers are first counted for each group and number, with partial counts, so a group holds each number
    once, however often it was found. A group without rows misses everything; where `upto` is null, only repeats fail.
    Null numbers are not counted.
    """
    each = found.where(F.col(number).isNotNull()).groupBy(*keys, F.col(number).cast("bigint").alias("__n")).agg(F.count("*").alias("__c"))
    groups = each.groupBy(*keys).agg(F.sum("__c").alias("found"), F.collect_list("__n").alias("__seen"), F.collect_list(F.when(F.col("__c") > 1, F.col("__n"))).alias("__twice"))
    return judged(expected.select(*keys, F.col(upto).cast("bigint").alias("expected")).join(groups, keys, "left"))


def judged(groups: DataFrame) -> DataFrame:
    """The columns of completeness() from expected, found, __seen and __twice (the numbers found, and those repeated)."""
    none = F.array().cast("array<bigint>")
    seen = F.coalesce("__seen", none)
    wanted = F.when(F.col("expected") >= 1, F.sequence(F.lit(1).cast("bigint"), F.col("expected"))).otherwise(none)
    out = groups.withColumns(
        {
            "found": F.coalesce("found", F.lit(0).cast("bigint")),
            "missing": F.array_sort(F.array_except(wanted, seen)),
            "extra": F.when(F.col("expected").isNull(), none).otherwise(F.array_sort(F.filter(seen, lambda n: (n < 1) | (n > F.col("expected"))))),
            "repeated": F.array_sort(F.coalesce("__twice", none)),
        }
    ).drop("__seen", "__twice")
    return out.withColumns({"missing_text": ranges(F.col("missing")), "passed": (F.size("missing") == 0) & (F.size("extra") == 0) & (F.size("repeated") == 0)})


def missing_numbers(found: DataFrame, expected: DataFrame, *, keys: list[str], number: str, upto: str) -> DataFrame:
    """One row for each missing number: the generated range without what was found."""
    wanted = expected.where(F.col(upto) >= 1).select(*keys, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(upto).cast("bigint"))).alias(number))
    have = found.select(*keys, F.col(number).cast("bigint").alias(number)).distinct()
    return wanted.join(have, [*keys, number], "left_anti")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, and how often."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_chapters(files: DataFrame, books: DataFrame, *, book: str, chapter: str, total: str) -> DataFrame:
    """Per recognised book: chapters found, missing and found repeatedly; complete books are reported too.

    books(book, total) is the dimension; files of other or null books, and null chapters, take no part.
    """
    dim = books.select(F.col(book).alias("book"), F.col(total).cast("bigint").alias("total_chapters"))
    known = files.where(F.col(chapter).isNotNull()).select(F.col(book).alias("book"), F.col(chapter).cast("bigint").alias("chapter")).join(F.broadcast(dim.select("book")), "book", "left_semi")
    seen = known.select("book").distinct().join(dim, "book")
    out = completeness(known, seen, keys=["book"], number="chapter", upto="total_chapters")
    present = F.array_except(F.when(F.col("expected") >= 1, F.sequence(F.lit(1).cast("bigint"), F.col("expected"))).otherwise(F.array().cast("array<bigint>")), F.col("missing"))
    return out.select("book", F.col("expected").alias("total_chapters"), F.col("found").alias("files"), present.alias("present"), "missing", "missing_text", "repeated", (F.size("missing") == 0).alias("complete"))


def sequence_gaps(rows: DataFrame, *, keys: list[str], number: str, most: int = 10) -> DataFrame:
    """Groups whose numbers don't start at 1 or leave gaps between the smallest and largest: both, and the first gaps."""
    each = rows.where(F.col(number).isNotNull()).select(*keys, F.col(number).cast("bigint").alias("n")).distinct()
    w = Window.partitionBy(*keys).orderBy("n")
    steps = each.withColumn("before", F.lag("n").over(w))
    gap = F.when(F.col("n") > F.col("before") + 1, F.sequence(F.col("before") + 1, F.least(F.col("n") - 1, F.col("before") + most)))
    out = steps.withColumn("gap", gap).groupBy(*keys).agg(F.min("n").alias("first"), F.max("n").alias("last"), F.count("*").alias("numbers"), F.array_sort(F.flatten(F.collect_list("gap"))).alias("gaps"))
    return out.where((F.col("first") != 1) | (F.size("gaps") > 0)).withColumn("gaps", F.slice("gaps", 1, most))
