"""Rules evaluated for each recording, as one long table of check items."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import at_most, within
from ..functions.text import label_kind, verse_number
from ..functions.timecode import format_centiseconds
from .completeness import judged
from .reconcile import comparison_summary
from .script import verification_summary


@dataclass(frozen=True)
class Settings:
    """What is checked and against which values. Only enabled rules become part of a plan.

    Fixed values: names and defaults are those of settings files, which are read by them.
    """

    target_lufs: float = -18.0
    lufs_tolerance: float = 0.5
    true_peak_max: float = -1.0
    silence_seconds: float = 2.0
    silence_tolerance: float = 0.5
    silence_threshold_dbfs: float = -60.0
    expected_sample_rate: int = 48000
    expected_bits: int = 24
    check_format: bool = True
    chapter_title_name: str = "Chapter Title"
    heading_name: str = "Heading"
    verse_word: str = "Verse"
    require_chapter_title: bool = True
    require_heading: bool = False
    strict_verse_spelling: bool = True
    enable_format: bool = True
    enable_loudness: bool = True
    enable_true_peak: bool = True
    enable_head_silence: bool = True
    enable_tail_silence: bool = True
    enable_markers: bool = True
    enable_verses: bool = True
    enable_script_verification: bool = False
    script_match_threshold: float = 0.6
    meter_available: bool = True


def _item(key: str, order: int, name: str, passed: Column, value: Column | str, detail: Column | str) -> Column:
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(order).alias("ord"), F.lit(name).alias("name"), passed.alias("passed"), text(value).cast("string").alias("value"), text(detail).cast("string").alias("detail"))


def measurement_items(files: DataFrame, s: Settings, *, key: str) -> DataFrame:
    """(key, ord, name, passed, value, detail) of format, loudness, peak and silence.

    files has sample_rate, bits, lufs, true_peak, head_silence and tail_silence, null where they couldn't be measured;
    a missing measurement fails. All items of a file come from one row and one pass.
    """
    items: list[Column] = []
    c = F.col
    if s.enable_format and s.check_format:
        ok = F.coalesce((c("sample_rate") == s.expected_sample_rate) & (c("bits") == s.expected_bits), F.lit(False))
        items.append(_item(key, 1, "Format", ok, F.format_string("%sk/%d-bit", F.regexp_replace(F.format_string("%.3f", c("sample_rate") / 1000), r"\.?0+$", ""), c("bits")), F.format_string(f"expected {s.expected_sample_rate} Hz / {s.expected_bits}-bit, file has %d Hz / %d-bit", c("sample_rate"), c("bits"))))
    shown = lambda x, unit: F.when(x.isNull(), "n/a").otherwise(F.format_string(f"%.1f {unit}", x))
    if not s.meter_available and (s.enable_loudness or s.enable_true_peak):
        items.append(_item(key, 2, "Loudness", F.lit(False), "", "no meter to measure loudness and peak"))
    elif s.meter_available:
        if s.enable_loudness:
            items.append(_item(key, 2, "Loudness", within(c("lufs"), s.target_lufs, s.lufs_tolerance), shown(c("lufs"), "LUFS"), F.concat(F.lit(f"target {s.target_lufs} LUFS within {s.lufs_tolerance}, measured "), shown(c("lufs"), "LUFS"))))
        if s.enable_true_peak:
            items.append(_item(key, 3, "True Peak", at_most(c("true_peak"), s.true_peak_max), shown(c("true_peak"), "dBTP"), F.concat(F.lit(f"at most {s.true_peak_max} dBTP, measured "), shown(c("true_peak"), "dBTP"))))
    for on, order, name, column in ((s.enable_head_silence, 4, "Head Silence", "head_silence"), (s.enable_tail_silence, 5, "Tail Silence", "tail_silence")):
        if on:
            text = F.when(c(column).isNull(), "n/a").otherwise(F.format_string("%.2fs", c(column)))
            items.append(_item(key, order, name, within(c(column), s.silence_seconds, s.silence_tolerance), text, F.concat(F.lit(f"expected {s.silence_seconds}s within {s.silence_tolerance}s, measured "), text)))
    if not items:
        return files.select(key, F.explode(F.array(_item(key, 0, "", F.lit(True), "", ""))).alias("x")).where("false").select(key, "x.*")
    return files.select(key, F.explode(F.array(*items)).alias("x")).select(key, "x.*")


def classify(markers: DataFrame, s: Settings, label: str = "label") -> DataFrame:
    """markers with category and verse."""
    return markers.withColumns({"category": label_kind(F.col(label), s.chapter_title_name, s.heading_name, s.verse_word), "verse": verse_number(F.col(label), s.verse_word)})


def marker_items(files: DataFrame, markers: DataFrame, s: Settings, *, key: str, seconds: str = "seconds", expected: str = "expected_verses", told: int = 20) -> DataFrame:
    """Check items of markers: any present, one title, a heading if required, spelling, and completeness of verses.

    A recording without markers gets the item 'Markers' alone (or none, if only verses are checked). Files without a
    known number of verses fail on repeated numbers only. Markers are counted once for each recording, category and verse,
    with partial counts, and all items but the names come from these counts. Of badly named markers all are counted, and
    the first `told` of a recording are listed; the others are cut off before the shuffle.
    """
    c = F.col
    cm = classify(markers, s)
    verse = F.when((c("category") == "verse") & c("verse").isNotNull(), c("verse").cast("bigint"))
    each = cm.groupBy(key, "category", verse.alias("__v")).agg(F.count("*").alias("__c"))
    of = lambda *kinds: F.sum(F.when(c("category").isin(*kinds), c("__c")).otherwise(0))
    counts = each.groupBy(key).agg(
        F.sum("__c").alias("n"), of("title").alias("titles"), of("heading").alias("headings"), of("malformed", "unknown").alias("bad"),
        F.sum(F.when(c("__v").isNotNull(), c("__c"))).alias("found"), F.collect_list("__v").alias("__seen"), F.collect_list(F.when(c("__c") > 1, c("__v"))).alias("__twice"),
    )
    base = files.select(key, F.col(expected).cast("bigint").alias("expected")).join(counts, key, "left")
    has = F.coalesce("n", F.lit(0)) > 0
    items = []
    if s.enable_markers:
        items.append(F.when(~has, _item(key, 6, "Markers", F.lit(False), "", "no markers")))
        if s.require_chapter_title:
            n = F.coalesce("titles", F.lit(0))
            items.append(F.when(has, _item(key, 7, "Chapter Title", n == 1, F.when(n == 1, "1").otherwise(""), F.when(n == 1, "present").when(n == 0, f"no '{s.chapter_title_name}' marker").otherwise(F.format_string("%d title markers, expected 1", n)))))
        if s.require_heading:
            items.append(F.when(has & (F.coalesce("headings", F.lit(0)) == 0), _item(key, 8, "Heading", F.lit(False), "", f"no '{s.heading_name}' marker")))
        if s.strict_verse_spelling:
            base = base.join(_first_bad(cm, key, seconds, told), key, "left")
            items.append(F.when(has & (c("bad") > 0), _item(key, 9, "Marker Spelling", F.lit(False), F.format_string("%d bad", c("bad")), F.concat(F.coalesce("names", F.lit("")), more(c("bad"), told)))))
    if s.enable_verses:
        base = judged(base)
        text = F.concat_ws("; ", F.when(F.size("missing") > 0, F.concat(F.lit("missing: "), "missing_text")), F.when(F.size("extra") > 0, F.concat(F.lit("unexpected: "), F.array_join("extra", ", "))), F.when(F.size("repeated") > 0, F.concat(F.lit("repeated: "), F.array_join("repeated", ", "))))
        value = F.when(c("expected").isNull(), F.format_string("%d found", c("found"))).otherwise(F.format_string("%d/%d", c("found"), c("expected")))
        items.append(F.when(has, _item(key, 10, "Verses", c("passed"), value, F.when(text == "", "complete").otherwise(text))))
    return base.select(key, F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("x")).select(key, "x.*")


def more(count: Column, shown: int) -> Column:
    return F.when(count > shown, F.format_string(" (+%d more)", count - shown)).otherwise("")


def _first_bad(cm: DataFrame, key: str, seconds: str, told: int) -> DataFrame:
    """(key, names): the first badly named markers of each recording, in order of time. The rank limit is applied in each
    task before the shuffle, so a recording with any number of them is not gathered."""
    bad = cm.where(F.col("category").isin("malformed", "unknown")).select(key, (F.col("category") == "unknown").alias("u"), F.col(seconds).alias("at"), F.coalesce("label", F.lit("")).alias("label"))
    first = bad.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("at", "label", "u"))).where(F.col("__n") <= told)
    text = F.concat(F.lit("'"), "label", F.lit("' @ "), F.coalesce(format_centiseconds(F.col("at")), F.lit("?")), F.when(F.col("u"), " (unknown name)").otherwise(" (no verse number)"))
    lists = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__n", text.alias("t")))).alias("x"))
    return lists.select(key, F.array_join(F.transform("x", lambda m: m.t), "; ").alias("names"))


def sidecar_items(compared: DataFrame, *, key: str = "path", times: int = 3, names: int = 5) -> DataFrame:
    """The check item 'CSV Match' of each recording with a sidecar, from reconcile.compare_markers.

    The detail tells the first `times` names whose times differ and the first `names` on one side only, and how many more.
    """
    c = F.col
    summary = comparison_summary(compared)
    listed = c("matched") + c("time_differs") + c("sidecar_only")
    ranked = compared.where("status <> 'matched'").withColumn("__n", F.row_number().over(Window.partitionBy("path", "status").orderBy("name", "row")))
    ranked = ranked.where(F.col("__n") <= F.when(c("status") == "time", times).otherwise(names))
    of = lambda status: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c("status") == status, F.struct("__n", "name")))), lambda x: x["name"]), ", ").alias(status)
    first = ranked.groupBy("path").agg(of("time"), of("sidecar_only").alias("__sidecar"), of("embedded_only").alias("__embedded"))
    told = F.concat_ws(
        " | ", F.when(c("time_differs") > 0, F.concat(F.lit("times differ: "), c("time"), more(c("time_differs"), times))), F.when(c("sidecar_only") > 0, F.concat(F.lit("in sidecar only: "), c("__sidecar"), more(c("sidecar_only"), names))),
        F.when(c("embedded_only") > 0, F.concat(F.lit("in recording only: "), c("__embedded"), more(c("embedded_only"), names))),
    )
    rows = summary.join(first, "path", "left").where(listed > 0)
    return rows.select(c("path").alias(key), F.lit(11).alias("ord"), F.lit("CSV Match").alias("name"), c("ok").alias("passed"), F.format_string("%d/%d", c("matched"), listed).alias("value"), F.when(c("ok"), "all markers match").otherwise(told).alias("detail"))


def script_items(compared: DataFrame, *, key: str = "path", issues: int = 5) -> DataFrame:
    """The check item 'Script Match' of each recording, from script.compare_texts(path, verse, expected, measured, matches)."""
    c = F.col
    found = verification_summary(compared, keys=["path"], verse="verse", expected="expected", told=issues)
    value = F.when(c("ok"), F.format_string("%.0f%%", c("mean_similarity") * 100)).otherwise(F.format_string("%d issues", c("checked") - c("matching")))
    told = F.array_join(F.transform("issues", lambda i: F.concat(F.lit("verse "), i.verse.cast("string"), F.format_string(" (%.0f%%)", i.measured * 100))), "; ")
    detail = F.when(c("ok"), F.format_string("all verses match (%.0f%% on average)", c("mean_similarity") * 100)).otherwise(F.concat(told, more(c("checked") - c("matching"), issues)))
    return found.select(c("path").alias(key), F.lit(12).alias("ord"), F.lit("Script Match").alias("name"), c("ok").alias("passed"), value.alias("value"), detail.alias("detail"))


def rollup(items: DataFrame, *, key: str) -> DataFrame:
    """Per recording: items, failed ones and whether all passed."""
    return items.groupBy(key).agg(F.count("*").alias("items"), F.count_if(~F.col("passed")).alias("fails"), F.bool_and("passed").alias("passed"))


def overall(files: DataFrame, items: DataFrame, *, key: str, error: str) -> DataFrame:
    """files with passed: no error and no failed item; a file without items passes."""
    return files.join(rollup(items, key=key), key, "left").withColumns({"items": F.coalesce("items", F.lit(0)), "fails": F.coalesce("fails", F.lit(0)), "passed": F.col(error).isNull() & F.coalesce("passed", F.lit(True))})


#: Checks that a narrow table shows in one column, which fails if any of them does.
MARKER_COLUMN = ("Markers", ["Markers", "Chapter Title", "Heading", "Marker Spelling"])


def pivoted(items: DataFrame, *, key: str, names: list[str], combine: tuple[str, list[str]] | None = None) -> DataFrame:
    """One column a check with PASS, FAIL or null; the names are given, so no pass is needed to find them. `combine` puts
    several checks into one column, as MARKER_COLUMN does."""
    worst = F.min(F.col("passed"))
    if combine:
        to, parts = combine
        items = items.withColumn("name", F.when(F.col("name").isin(parts), to).otherwise(F.col("name")))
        names = list(dict.fromkeys(to if n in parts else n for n in names))
    return items.groupBy(key).pivot("name", names).agg(F.when(worst, "PASS").when(~worst, "FAIL"))
