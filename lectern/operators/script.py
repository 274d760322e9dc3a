"""Reads verses from script text, and verifies transcripts against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.similarity import text_similarity
from ..functions.text import ascii_digits, preview, strip, verse_number, without_chapter_headings

NUMBERED = r"(?Us)^\s*(\d+)\s*[.:)}\]]*\s*(.*)$"


def verses(scripts: DataFrame, *, key: str, text: str, keep_headings: bool = False) -> DataFrame:
    """(key, verse, text): a line that begins with a number opens a verse, other lines go on with it, joined by a blank.

    Any closing marks may follow the number. Chapter headings are left out unless `keep_headings` says that they are text.
    Blank lines and lines before the first number are left out, verses without text are not kept, and of equal numbers
    the last wins. Digits of any script count. A null text gives no rows. The lines of one script are numbered by a
    running count in a window of that script, so scripts of any number spread over all tasks.
    """
    lines = scripts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.posexplode(F.split(F.col(text) if keep_headings else without_chapter_headings(F.col(text)), "\n")).alias("pos", "raw"))
    lines = lines.withColumn("line", strip(F.col("raw"))).where("line <> ''")
    number = F.regexp_extract(ascii_digits(F.regexp_extract("line", r"(?U)^(\d+)", 1)), r"^([0-9]+)", 1)
    opens = F.col("line").rlike(NUMBERED)
    lines = lines.withColumns({"opens": opens, "number": F.when(opens, number.try_cast("bigint")), "body": F.when(opens, F.regexp_extract("line", NUMBERED, 2)).otherwise(F.col("line"))})
    w = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    blocks = lines.withColumn("block", F.sum(F.col("opens").cast("int")).over(w)).where("block > 0")
    said = F.array_sort(F.collect_list(F.when(F.col("body") != "", F.struct("pos", "body"))))
    made = blocks.groupBy("key", "block").agg(F.max("number").alias("verse"), F.array_join(F.transform(said, lambda x: x.body), " ").alias("text"))
    made = made.where("text <> '' AND verse IS NOT NULL")
    return made.groupBy("key", "verse").agg(F.max_by("text", "block").alias("text")).withColumnRenamed("key", key)


def sequence_warnings(found: DataFrame, *, verse: str = "verse", most: int = 10) -> list[str]:
    """What is odd about the verse numbers of one script: not beginning at 1, or with gaps (the first `most` numbers)."""
    from .completeness import sequence_gaps

    out = []
    for r in sequence_gaps(found.withColumn("__all", F.lit(1)), keys=["__all"], number=verse, most=most).collect():
        if r.first != 1:
            out.append(f"verses begin at {r.first}")
        if r.gaps:
            out.append("verses missing: " + ", ".join(map(str, r.gaps)))
    return out


def words_of_segments(words: DataFrame, parts: DataFrame, *, keys: list[str]) -> DataFrame:
    """The words whose middle lies in each segment, both ends included, joined in order.

    words(keys, pos, start, end, word), parts(keys, verse, start_s, end_s).
    """
    from .series import points_in_segments

    middle = words.withColumn("mid", (F.col("start") + F.col("end")) / 2).select(*keys, "pos", "mid", "word")
    inside = points_in_segments(middle, parts.select(*keys, "verse", "start_s", "end_s"), keys=keys, at="mid", start="start_s", end="end_s")
    return inside.groupBy(*keys, "verse", "start_s", "end_s").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x.word), " ").alias("transcript"))


def compare_texts(pairs: DataFrame, *, expected: str, transcribed: str, threshold: float = 0.6) -> DataFrame:
    """pairs with measured (0 to 1) and matches (at least the threshold). Null texts count as empty."""
    measured = text_similarity(F.col(expected), F.col(transcribed))
    return pairs.withColumn("measured", measured).withColumn("matches", F.col("measured") >= threshold)


def verification_summary(compared: DataFrame, *, keys: list[str], verse: str, expected: str, told: int = 5) -> DataFrame:
    """Per recording: verses checked, matching, mean similarity, whether all match, and the first `told` that don't.

    Texts are compared once, before the shuffle; a recording's rows are ranked in a window, which spills, so no list grows
    with a recording.
    """
    rows = compared.select(*keys, F.col(verse).alias("__v"), preview(F.col(expected)).alias("__t"), "measured", "matches")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("matches", "__v", "__t"))
    issue = F.when(~F.col("matches") & (F.col("__n") <= told), F.struct(F.col("__v").alias("verse"), F.col("__t").alias("text"), "measured"))
    out = rows.withColumn("__n", rank).groupBy(*keys).agg(F.count("*").alias("checked"), F.count_if("matches").alias("matching"), F.avg("measured").alias("mean_similarity"), F.array_sort(F.collect_list(issue)).alias("issues"))
    return out.withColumn("ok", (F.col("checked") > 0) & (F.col("checked") == F.col("matching")))


def verify(markers: DataFrame, words: DataFrame, script: DataFrame, files: DataFrame, *, threshold: float = 0.6, verse_word: str = "Verse") -> DataFrame:
    """(path, verse, expected, transcribed, measured, matches): each marked verse that the script has, compared with the
    words heard between its marker and the next one.

    markers(path, cue_id, label, seconds), words(path, pos, start, end, word), script(path, verse, text),
    files(path, seconds). A verse in which nothing was heard is compared with an empty text.
    """
    from .series import segments

    number = verse_number(F.col("label"), verse_word)
    marked = markers.join(files.select("path", F.col("seconds").alias("__end")), "path").withColumn("verse", number)
    parts = segments(marked, keys=["path"], start="seconds", tie="cue_id", end_of_group=F.col("__end")).where("verse IS NOT NULL")
    parts = parts.select("path", F.col("verse").cast("bigint").alias("verse"), F.col("seconds").alias("start_s"), F.col("segment_end").alias("end_s"))
    heard = words_of_segments(words, parts, keys=["path"]).select("path", "verse", "start_s", F.col("transcript").alias("transcribed"))
    asked = script.select("path", F.col("verse").cast("bigint").alias("verse"), F.col("text").alias("expected"))
    pairs = parts.join(asked, ["path", "verse"]).join(heard, ["path", "verse", "start_s"], "left").withColumn("transcribed", F.coalesce("transcribed", F.lit("")))
    return compare_texts(pairs, expected="expected", transcribed="transcribed", threshold=threshold).select("path", "verse", "expected", "transcribed", "measured", "matches")
