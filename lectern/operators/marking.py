"""Places verse markers: by aligning a script with timed words, by pauses, or evenly."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .series import longest, push_apart
from .state import adjust


def run_score(verse: str, words: list[str]) -> float:
    """Similarity of a verse and a run of words by characters found one after the other."""
    said = " ".join(words)
    at, hits = -1, 0
    for c in verse:
        at = said.find(c, at + 1)
        if at < 0:
            break
        hits += 1
    whole = len(verse) + len(said)
    return 2.0 * hits / whole if whole else 0.0


def align(words: list[str], verses: list[tuple[int, str]], score=run_score) -> list[tuple[int, int, float]]:
    """(verse, word position, score): for each verse in order the best start among the words ahead.

    A verse of n words is looked for in the next max(3 n, 20) words, against the 2 n words from each; the first of the
    best starts is taken, even at score 0, and the next verse is looked for behind it.
    """
    placed, cursor = [], 0
    for number, text in verses:
        n = len(text.split())
        if not n or cursor >= len(words):
            continue
        ahead = range(cursor, min(len(words), cursor + max(3 * n, 20)))
        scores = [score(text, words[i : i + 2 * n]) for i in ahead]
        top = max(scores)
        spot = cursor + (scores.index(top) if top > 0 else 0)
        placed.append((number, spot, top))
        cursor = spot + 1
    return placed


def place_by_words(words: DataFrame, script: DataFrame, *, key: str) -> DataFrame:
    """(key, verse, time_s, confidence, method 'words') from words(key, pos, start, word) and script(key, verse, text).

    The search for one verse depends on where the last one was found, so a recording is aligned as a whole, in one
    Python group; both sides are gathered in rows of the recording, which hold a chapter at most.
    """
    said = words.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "start", F.coalesce("word", F.lit("")).alias("word")))).alias("said"))
    asked = script.where("text IS NOT NULL").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("verse", "text"))).alias("asked"))
    both = said.join(asked, key)
    kind = both.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, heard, wanted in zip(pdf[key], pdf["said"], pdf["asked"]):
                for verse, spot, value in align([w["word"] for w in heard], [(v["verse"], v["text"]) for v in wanted]):
                    out.append((k, verse, heard[spot]["start"], value, "words"))
            yield pd.DataFrame(out, columns=[key, "verse", "time_s", "confidence", "method"])

    return both.mapInPandas(run, f"{key} {kind}, verse long, time_s double, confidence double, method string")


def place_by_pauses(pauses: DataFrame, expected: DataFrame, *, key: str, verses: str, head_s: float = 2.0) -> DataFrame:
    """Verse 2 and on at the ends of the longest pauses behind the head, as many as verses but one."""
    usable = pauses.where(F.col("end") > head_s + 0.5).join(expected.select(key, F.col(verses).alias("__verses")), key)
    best = longest(usable, keys=[key], duration="duration", start="start", k=F.col("__verses") - 1)
    return best.select(key, (F.col("number") + 1).cast("bigint").alias("verse"), F.col("end").alias("time_s"), F.least(F.col("duration"), F.lit(1.0)).alias("confidence"), F.lit("pause").alias("method"))


def place_evenly(files: DataFrame, *, key: str, verses: str, duration: str) -> DataFrame:
    """All verses at equal steps between the edges: 2 s or a twentieth in, whichever is less."""
    edge = F.least(F.lit(2.0), 0.05 * F.col(duration))
    end = F.greatest(F.col(duration) - 2.0, 0.95 * F.col(duration))
    n = F.col(verses).cast("bigint")
    listed = files.where((n >= 1) & (F.col(duration) > 0)).select(key, edge.alias("a"), end.alias("b"), n.alias("n"), F.explode(F.sequence(F.lit(1).cast("bigint"), n)).alias("verse"))
    return listed.select(key, "verse", (F.col("a") + (F.col("verse") - 1) * (F.col("b") - F.col("a")) / F.col("n")).alias("time_s"), F.lit(0.2).alias("confidence"), F.lit("even").alias("method"))


def choose(candidates: DataFrame, files: DataFrame, *, key: str, verses: str) -> DataFrame:
    """Of the placements by words, pauses and even steps (method), those to be used for each recording.

    Words, if they place at least half of the verses; else pauses, if they place more than words do, noted as 'combined'
    where words placed some; else what words placed; even steps only where neither places any.
    """
    per = Window.partitionBy(key)
    of = lambda m: F.count_if(F.col("method") == m).over(per)
    rows = candidates.withColumns({"__w": of("words"), "__p": of("pause")}).join(files.select(key, F.col(verses).alias("__v")), key)
    use = F.when((F.col("__w") > 0) & (F.col("__w") >= 0.5 * F.col("__v")), "words").when(F.col("__p") > F.col("__w"), "pause").when(F.col("__w") > 0, "words").otherwise("even")
    rows = rows.where(F.col("method") == use)
    return rows.withColumn("method", F.when((F.col("method") == "pause") & (F.col("__w") > 0), "combined").otherwise(F.col("method"))).drop("__w", "__p", "__v")


def observed(pauses: DataFrame, *, duration: str = "duration", least_s: float = 0.1, most_s: float = 5.0) -> DataFrame:
    """The pauses that may be learned from: neither gaps between words nor long silences."""
    return pauses.where(F.col(duration).between(least_s, most_s))


def timeline(heard: DataFrame, *, key: str) -> DataFrame:
    """(key, pos, start, end, word) from heard(key, start, end, text, words array<struct<start, end, word>>), the segments
    of a recogniser: its words, or, for a recording for which it gave none at all, its segments as they are.

    A word without its own times takes its segment's.
    """
    rows = heard.withColumn("words", F.coalesce("words", F.array().cast(heard.schema["words"].dataType)))
    has = rows.groupBy(key).agg(F.max(F.size("words") > 0).alias("__has"))
    rows = rows.join(has, key).withColumn("words", F.when(F.col("__has"), F.col("words")).otherwise(F.array(F.struct("start", "end", F.col("text").alias("word")))))
    words = rows.select(key, F.col("start").alias("s"), F.col("end").alias("e"), F.posexplode("words").alias("i", "w"))
    words = words.select(key, "s", "i", F.coalesce("w.start", "s").alias("start"), F.coalesce("w.end", "e").alias("end"), F.trim(F.coalesce("w.word", F.lit(""))).alias("word"))
    place = Window.partitionBy(key).orderBy("s", "i")
    return words.select(key, F.row_number().over(place).cast("bigint").alias("pos"), "start", "end", "word")


def finish(placed: DataFrame, files: DataFrame, *, key: str, rate: str, duration: str, gap_s: float = 0.1) -> DataFrame:
    """(key, ord, label, sample_offset, time_s, confidence, method): a title a second before the first verse, verses at
    least a gap apart and within the recording."""
    each = lambda label, verse, time, confidence, method: F.struct(label.alias("label"), verse.alias("verse"), time.alias("time_s"), confidence.alias("confidence"), method.alias("method"))
    c = F.col
    title = each(F.lit("Chapter Title"), F.lit(0).cast("bigint"), F.greatest(c("time_s") - 1.0, F.lit(0.0)), F.lit(0.9).cast("double"), F.lit("auto"))
    own = each(F.format_string("Verse %d", c("verse")), c("verse").cast("bigint"), c("time_s"), c("confidence").cast("double"), c("method"))
    first = F.row_number().over(Window.partitionBy(key).orderBy("time_s", "verse")) == 1
    every = placed.withColumn("__first", first).select(key, F.explode(F.when(c("__first"), F.array(title, own)).otherwise(F.array(own))).alias("x")).select(key, "x.*")
    every = every.join(files.select(key, F.col(rate).alias("__rate"), F.col(duration).alias("__duration")), key)
    every = every.withColumn("ms", F.floor(F.col("time_s") * 1000 + 1e-6).cast("bigint"))
    apart = push_apart(every, keys=[key], position="ms", tie="verse", gap=int(gap_s * 1000))
    end = F.greatest(F.col("__duration") * F.col("__rate") - 1, F.lit(0)).cast("bigint")
    offset = F.least(F.floor(F.col("placed") * F.col("__rate") / 1000).cast("bigint"), end)
    w = Window.partitionBy(key).orderBy("placed", "verse")
    return apart.select(key, F.row_number().over(w).alias("ord"), "label", offset.alias("sample_offset"), (F.col("placed") / 1000).alias("time_s"), "confidence", "method")


def auto_mark(
    files: DataFrame, script: DataFrame | None, *, key: str, verses: str, duration: str, rate: str, words: DataFrame | None = None, pauses: DataFrame | None = None,
    corrections: DataFrame | None = None, profile: list[str] = (), gap_s: float = 0.1,
) -> DataFrame:
    """Placements for each file by the best way there is; words, the output of any speech recogniser, is optional.

    corrections(*profile, verse, expected, corrected, seq), the log of what was moved by hand, shifts markers of files
    with the same profile columns as state.adjust does; the method of those that are moved ends in '+corrected'.
    """
    found = place_evenly(files, key=key, verses=verses, duration=duration)
    if pauses is not None:
        found = found.unionByName(place_by_pauses(pauses, files, key=key, verses=verses))
    if words is not None and script is not None:
        found = found.unionByName(place_by_words(words, script, key=key))
    chosen = choose(found, files, key=key, verses=verses)
    if corrections is not None:
        own = [c for c in profile if c != key]
        placed = chosen.join(files.select(key, *own), key) if own else chosen
        known = corrections.select(*profile).distinct().withColumn("__known", F.lit(True))
        moved = adjust(placed, corrections, keys=list(profile), verse="verse", time="time_s", expected="expected", corrected="corrected", order="seq").join(known, list(profile), "left")
        near = F.coalesce(F.col("__known") & (F.col("adjusted") != F.col("time_s")), F.lit(False))
        moved = moved.withColumn("method", F.when(near, F.concat("method", F.lit("+corrected"))).otherwise(F.col("method"))).withColumn("time_s", F.when(near, F.col("adjusted")).otherwise(F.col("time_s")))
        chosen = moved.select(key, "verse", "time_s", "confidence", "method")
    return finish(chosen, files, key=key, rate=rate, duration=duration, gap_s=gap_s)


def retained(markers: DataFrame, *, old_rate: Column, new_rate: Column, shift_s: Column | float, duration_s: Column) -> DataFrame:
    """Markers carried over to a processed recording: times shifted, in the new rate, those past the end dropped."""
    shift = shift_s if isinstance(shift_s, Column) else F.lit(float(shift_s))
    seconds = F.col("sample_offset") / old_rate + shift
    out = markers.withColumn("seconds", seconds).where((F.col("seconds") >= 0) & (F.col("seconds") < duration_s))
    return out.withColumn("sample_offset", F.floor(F.col("seconds") * new_rate).cast("bigint"))
