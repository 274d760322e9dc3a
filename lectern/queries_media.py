"""Queries of containers, sidecar text, reports, marking and small functions, and their SQL.

The containers are made of the clips in `embeddings`: bits and rate by the clip's number, a marker each 16 samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dsp, text, timecode
from .operators import checks, marking, script, series, state
from .plans import report
from .queries_checks import _CM, _CMP, _FILES, _ITEMS, SETTINGS, _compared, _files, _markers
from .queries_series import _REC, _gaps, _recordings, _verses_heard
from .session import table
from .sources import files, wav


def _containers(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    bits = F.element_at(F.array(*map(F.lit, (8, 16, 24, 32))), (F.col("vec_id") % 4 + 1).cast("int"))
    marks = F.transform(F.sequence(F.lit(0), F.ceil(F.size("embedding") / 16).cast("int") - 1), lambda i: F.struct((i * 16).cast("bigint").alias("sample_offset"), F.format_string("Verse %d", i + 1).alias("label")))
    clips = v.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("x"), bits.alias("bits"), F.when(F.col("vec_id") % 3 == 0, 48000).otherwise(44100).alias("rate"), marks.alias("cues"))
    return wav.to_content(clips, path="id", samples="x", bits="bits", rate="rate", cues="cues")


def container_headers(spark: SparkSession, d: str) -> DataFrame:
    out = wav.from_content(_containers(spark, d), "header")
    return out.select(F.col("path").cast("bigint").alias("vec_id"), "audio_format", "channels", "sample_rate", "bits", "sampwidth", "n_frames", "error")


def container_markers(spark: SparkSession, d: str) -> DataFrame:
    out = wav.from_content(_containers(spark, d), "markers")
    return out.select(F.col("path").cast("bigint").alias("vec_id"), "cue_id", "sample_offset", "label", "sample_rate")


def container_levels(spark: SparkSession, d: str) -> DataFrame:
    """Peaks of the samples after a round trip through the container's whole numbers."""
    out = wav.from_content(_containers(spark, d), "envelope", columns=1)
    return out.select(F.col("path").cast("bigint").alias("vec_id"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def container_blocks(spark: SparkSession, d: str) -> DataFrame:
    out = wav.from_content(_containers(spark, d), "pcm", blockframes=20)
    return out.select(F.col("path").cast("bigint").alias("vec_id"), "block", "start_frame", F.octet_length("pcm").cast("bigint").alias("bytes"))


def sidecar_text(spark: SparkSession, d: str) -> DataFrame:
    """The text of each recording's sidecar file, as digest and size."""
    rows = table(spark, d, "csv_marker").where("path IS NOT NULL AND start_seconds IS NOT NULL").withColumn("at", F.struct("start_seconds", "csv_id"))
    out = files.marker_lines(rows.withColumns({"name": F.coalesce("name", F.lit("")), "description": F.coalesce("description", F.lit(""))}), order="at")
    return out.select("path", F.md5("content").alias("digest"), F.length("content").cast("bigint").alias("size"))


def output_names(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "file_report").where("path IS NOT NULL").select("path").distinct()
    return paths.selectExpr("path", f"{files.output_name('path', 'marked')} AS marked", f"{files.output_name('path', 'mastered')} AS mastered", f"{files.output_name('path', 'fixed')} AS fixed")


def _checked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    found = _files(spark, d)
    items = checks.marker_items(found, _markers(spark, d), SETTINGS, key="path")
    return found, items


def report_nested(spark: SparkSession, d: str) -> DataFrame:
    out = report.nested(*_checked(spark, d), key="path")
    failed = F.filter("checks", lambda c: c.status == "FAIL")
    return out.select("path", F.size("checks").cast("bigint").alias("checks"), F.array_join(F.transform(failed, lambda c: c["name"]), ",").alias("failed"))


def console_report(spark: SparkSession, d: str) -> DataFrame:
    found, items = _checked(spark, d)
    whole = checks.overall(found, items, key="path", error="error")
    return report.console_lines(whole, items.withColumn("detail", F.lit("see report")), key="path")


def heading_items(spark: SparkSession, d: str) -> DataFrame:
    """Headings required, nothing else but titles checked."""
    s = checks.Settings(require_heading=True, strict_verse_spelling=False, enable_verses=False)
    return checks.marker_items(_files(spark, d), _markers(spark, d), s, key="path").select("path", "ord", "name", "passed", "value", "detail")


def sidecar_match(spark: SparkSession, d: str) -> DataFrame:
    return checks.sidecar_items(_compared(spark, d)).select("path", "name", "passed", "value", "detail")


def script_match(spark: SparkSession, d: str) -> DataFrame:
    """Words heard, cut by the embedded markers and compared with the script, as one item a recording."""
    words, asked = _verses_heard(spark, d)
    timed = words.withColumn("end", F.col("start") + 0.4).where("path IS NOT NULL")
    lengths = _recordings(spark, d).select("path", F.col("duration").alias("seconds"))
    markers = _markers(spark, d).where("path IS NOT NULL AND seconds IS NOT NULL").select("path", F.col("marker_id").alias("cue_id"), "label", "seconds")
    return checks.script_items(script.verify(markers, timed, asked.where("text IS NOT NULL"), lengths)).select("path", "name", "passed", "value")


def clip_meter(spark: SparkSession, d: str) -> DataFrame:
    """Peak level of each clip by the meter that recordings are measured with."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            peaks = [dsp.sample_peak(np.asarray(x, np.float64)[None]) for x in pdf["x"]]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "peak_db": np.round(peaks, 6)})

    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x")).mapInPandas(run, "vec_id long, peak_db double")


def time_ticks(spark: SparkSession, d: str) -> DataFrame:
    """How many ticks a display of each comparison's time shows, and those marks of it that are visible in its middle."""
    v = table(spark, d, "verse_comparison").where("start_s IS NOT NULL AND end_s IS NOT NULL AND end_s > start_s")
    step = timecode.tick_interval(F.col("end_s") - F.col("start_s"))
    return v.select("comparison_id", step.alias("step"), F.size(series.ticks(F.col("start_s"), F.col("end_s"), step)).cast("bigint").alias("ticks"))


def sample_times(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "marker").where("sample_offset IS NOT NULL AND sample_rate > 0")
    seconds = timecode.samples_to_seconds(F.col("sample_offset"), F.col("sample_rate"))
    return m.select("marker_id", F.floor(seconds * 1000000 + 0.25).cast("bigint").alias("us"), timecode.seconds_to_samples(seconds + 1e-6, F.lit(1000)).alias("ms"))


def text_tools(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "verse_comparison")
    return v.select("comparison_id", text.preview(F.col("expected_text"), 20).alias("preview"), text.trailing_number(F.concat(F.lit("Take "), F.col("verse_number").cast("string"))).alias("number"), text.measured(F.concat(F.round("start_s", 4).cast("decimal(20,4)").cast("string"), F.lit("s"))).alias("measured"))


def without_headings(spark: SparkSession, d: str) -> DataFrame:
    """Lines of scripts that are left when chapter headings are taken off."""
    s = table(spark, d, "parsed_script").where("raw_text IS NOT NULL")
    lines = F.filter(F.split(text.without_chapter_headings(F.col("raw_text")), "\n"), lambda x: F.trim(x) != "")
    return s.select("script_id", F.size(lines).cast("bigint").alias("lines"))


def _marks(spark: SparkSession, d: str, words: DataFrame | None = None, asked: DataFrame | None = None, **more: object) -> DataFrame:
    out = marking.auto_mark(_recordings(spark, d), asked, key="path", verses="verses", duration="duration", rate="rate", words=words, pauses=_gaps(spark, d), **more)
    return out.select("path", F.col("ord").cast("bigint").alias("ord"), "label", F.floor(F.col("time_s") * 1000 + 0.25).cast("bigint").alias("time_ms"), "method")


def pause_marks(spark: SparkSession, d: str) -> DataFrame:
    """Markers without a recogniser: by pauses, or evenly where there are none."""
    return _marks(spark, d)


def auto_mark(spark: SparkSession, d: str) -> DataFrame:
    """All three ways to place markers, with the corrections that were made to earlier recordings."""
    words, asked = _verses_heard(spark, d)
    made = table(spark, d, "csv_marker").where("path IS NOT NULL AND start_seconds IS NOT NULL").select(
        "path", text.verse_number(F.col("name")).cast("bigint").alias("verse"), F.col("start_seconds").alias("expected"), (F.col("start_seconds") * 1.01 + 0.2).alias("corrected"), F.col("csv_id").alias("seq")
    )
    return _marks(spark, d, words, asked, corrections=made.where("verse IS NOT NULL"), profile=["path"])


def pause_observations(spark: SparkSession, d: str) -> DataFrame:
    """The pauses that are learned from, and their moving mean for each recording."""
    seen = marking.observed(_gaps(spark, d))
    return state.exponential_mean(seen, keys=["path"], value="duration", order="start").select("path", F.round("mean", 5).alias("mean"))


_CLIP = "x AS (SELECT vec_id, embedding::DOUBLE[] AS v, [8, 16, 24, 32][vec_id % 4 + 1] AS bits, CASE WHEN vec_id % 3 = 0 THEN 48000 ELSE 44100 END AS rate FROM embeddings)"
_WHOLE = "CASE WHEN bits = 8 THEN (least(floor((greatest(least(a, 1.0::DOUBLE), -1.0::DOUBLE) + 1) * 128), 255) - 128) / 128 ELSE trunc(greatest(least(a, 1.0::DOUBLE), -1.0::DOUBLE) * (pow(2, bits - 1) - 1)) / pow(2, bits - 1) END"
_GAPS = """gaps AS (SELECT path, end_s AS s, nxt AS e, nxt - end_s AS d FROM (SELECT path, start_s, end_s, lead(start_s) OVER (PARTITION BY path ORDER BY start_s, end_s) AS nxt
 FROM (SELECT DISTINCT path, start_s, end_s FROM verse_comparison WHERE path IS NOT NULL AND start_s IS NOT NULL AND end_s IS NOT NULL)) WHERE nxt > end_s)"""
_OVER = f"{_ITEMS}, o AS (SELECT path, error IS NULL AND coalesce(ok, true) AS passed, error FROM f LEFT JOIN (SELECT path, bool_and(passed) AS ok FROM items GROUP BY 1) USING (path))"

QUERIES = {
    f.__name__: f
    for f in (
        container_headers, container_markers, container_levels, container_blocks, sidecar_text, output_names, report_nested, console_report, heading_items, sidecar_match, script_match, clip_meter, time_ticks,
        sample_times, text_tools, without_headings, pause_marks, auto_mark, pause_observations,
    )
}
SQL = {
    "container_headers": f"WITH {_CLIP} SELECT vec_id::BIGINT AS vec_id, 1 AS audio_format, 1 AS channels, rate::BIGINT AS sample_rate, bits::INT AS bits, (bits // 8)::INT AS sampwidth, len(v)::BIGINT AS n_frames, NULL::VARCHAR AS error FROM x",
    "container_markers": f"WITH {_CLIP}, m AS (SELECT vec_id, rate, unnest(generate_series(0, (len(v) + 15) // 16 - 1)) AS i FROM x) SELECT vec_id::BIGINT AS vec_id, (i + 1)::BIGINT AS cue_id, (i * 16)::BIGINT AS sample_offset, 'Verse ' || (i + 1) AS label, rate::BIGINT AS sample_rate FROM m",
    "container_levels": f"WITH {_CLIP}, u AS (SELECT vec_id, bits, unnest(v) AS a FROM x) SELECT vec_id::BIGINT AS vec_id, round(min({_WHOLE}), 6) AS low, round(max({_WHOLE}), 6) AS high FROM u GROUP BY 1",
    "container_blocks": f"WITH {_CLIP}, b AS (SELECT vec_id, bits, len(v) AS n, unnest(generate_series(0, (len(v) + 19) // 20 - 1)) AS block FROM x) SELECT vec_id::BIGINT AS vec_id, block::BIGINT AS block, (block * 20)::BIGINT AS start_frame, (least(20, n - block * 20) * (bits // 8))::BIGINT AS bytes FROM b",
    "sidecar_text": """WITH m AS (SELECT *, round(start_seconds * 1000)::BIGINT AS a, round(coalesce(duration_seconds, 0) * 1000)::BIGINT AS b FROM csv_marker WHERE path IS NOT NULL AND start_seconds IS NOT NULL),
t AS (SELECT path, start_seconds, csv_id, coalesce(name, '') || chr(9) || printf('%d:%02d.%03d', a // 60000, (a % 60000) // 1000, a % 1000) || chr(9) || printf('%d:%02d.%03d', b // 60000, (b % 60000) // 1000, b % 1000) || chr(9) || coalesce(time_format, 'decimal') || chr(9) || coalesce(marker_type, 'Cue') || chr(9) || coalesce(description, '') AS line FROM m),
w AS (SELECT path, chr(65279) || 'Name' || chr(9) || 'Start' || chr(9) || 'Duration' || chr(9) || 'Time Format' || chr(9) || 'Type' || chr(9) || 'Description' || chr(10) || string_agg(line, chr(10) ORDER BY start_seconds, csv_id) || chr(10) AS content FROM t GROUP BY 1)
SELECT path, md5(content) AS digest, length(content)::BIGINT AS size FROM w""",
    "output_names": r"""SELECT DISTINCT path, regexp_replace(path, '(\.[^./]*)$', '_marked\1') AS marked, regexp_replace(path, '([^/_ .-]+)([^/]*)$', '\1_Mastered/\1\2') AS mastered, regexp_replace(path, '([^/_ .-]+)([^/]*)$', '\1_Fixed/\1\2') AS fixed FROM file_report WHERE path IS NOT NULL""",
    "report_nested": f"WITH {_ITEMS} SELECT path, count(name) AS checks, coalesce(string_agg(name, ',' ORDER BY ord) FILTER (NOT passed), '') AS failed FROM f LEFT JOIN items USING (path) GROUP BY 1",
    "console_report": f"WITH {_OVER} SELECT path, 0 AS ord, CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END || '  ' || path || coalesce('  ' || error, '') AS line FROM o UNION ALL SELECT path, ord, '    ' || rpad(name, 16, ' ') || CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END || '  ' || value || CASE WHEN passed THEN '' ELSE '  see report' END FROM items",
    "heading_items": f"""WITH {_CM}, {_FILES}, cnt AS (SELECT path, count(*) FILTER (category = 'title') AS t, count(*) FILTER (category = 'heading') AS h FROM cm GROUP BY 1)
SELECT path, 6 AS ord, 'Markers' AS name, false AS passed, '' AS value, 'no markers' AS detail FROM f ANTI JOIN cnt USING (path)
UNION ALL SELECT path, 7, 'Chapter Title', t = 1, CASE WHEN t = 1 THEN '1' ELSE '' END, CASE WHEN t = 1 THEN 'present' WHEN t = 0 THEN 'no ''Chapter Title'' marker' ELSE t || ' title markers, expected 1' END FROM f JOIN cnt USING (path)
UNION ALL SELECT path, 8, 'Heading', false, '', 'no ''Heading'' marker' FROM f JOIN cnt USING (path) WHERE h = 0""",
    "sidecar_match": f"""WITH {_CMP}, s AS (SELECT path, count(*) FILTER (status = 'matched') AS m, count(*) FILTER (status = 'time') AS t, count(*) FILTER (status = 'sidecar_only') AS c, count(*) FILTER (status = 'embedded_only') AS e FROM cmp GROUP BY 1),
n AS (SELECT path, status, string_agg(name, ', ' ORDER BY k) AS names FROM (SELECT *, row_number() OVER (PARTITION BY path, status ORDER BY name, "row") AS k FROM cmp WHERE status <> 'matched') WHERE k <= CASE WHEN status = 'time' THEN 3 ELSE 5 END GROUP BY 1, 2),
j AS (SELECT s.*, a.names AS tn, b.names AS cn, d.names AS en FROM s LEFT JOIN n a ON a.path = s.path AND a.status = 'time' LEFT JOIN n b ON b.path = s.path AND b.status = 'sidecar_only' LEFT JOIN n d ON d.path = s.path AND d.status = 'embedded_only')
SELECT path, 'CSV Match' AS name, m > 0 AND t + c + e = 0 AS passed, m || '/' || (m + t + c) AS value, CASE WHEN m > 0 AND t + c + e = 0 THEN 'all markers match' ELSE concat_ws(' | ', CASE WHEN t > 0 THEN 'times differ: ' || tn || CASE WHEN t > 3 THEN ' (+' || (t - 3) || ' more)' ELSE '' END END,
 CASE WHEN c > 0 THEN 'in sidecar only: ' || cn || CASE WHEN c > 5 THEN ' (+' || (c - 5) || ' more)' ELSE '' END END, CASE WHEN e > 0 THEN 'in recording only: ' || en || CASE WHEN e > 5 THEN ' (+' || (e - 5) || ' more)' ELSE '' END END) END AS detail FROM j WHERE m + t + c > 0""",
    "clip_meter": "SELECT vec_id, round(CASE WHEN p > 0 THEN greatest(20 * log10(p), -120) ELSE -120 END, 6) AS peak_db FROM (SELECT vec_id, list_max(list_transform(embedding::DOUBLE[], lambda a: abs(a))) AS p FROM embeddings)",
    "time_ticks": """WITH v AS (SELECT comparison_id, start_s AS a, end_s AS b, end_s - start_s AS span FROM verse_comparison WHERE start_s IS NOT NULL AND end_s IS NOT NULL AND end_s > start_s),
s AS (SELECT *, coalesce(list_filter([0.1::DOUBLE, 0.2, 0.5, 1, 2, 5, 10, 15, 30, 60, 120, 300], lambda x: span / x <= 10)[1], 600) AS step FROM v)
SELECT comparison_id, step, greatest(floor(b / step)::BIGINT - ceil(a / step)::BIGINT + 1, 0) AS ticks FROM s""",
    "sample_times": "SELECT marker_id, floor(sample_offset / sample_rate * 1000000 + 0.25::DOUBLE)::BIGINT AS us, trunc((sample_offset / sample_rate + 1e-6::DOUBLE) * 1000)::BIGINT AS ms FROM marker WHERE sample_offset IS NOT NULL AND sample_rate > 0",
    "text_tools": "SELECT comparison_id, CASE WHEN length(expected_text) > 20 THEN expected_text[1:20] || '...' ELSE expected_text END AS preview, verse_number::BIGINT AS number, coalesce(round(start_s, 4), 0) AS measured FROM verse_comparison",
    "without_headings": r"""SELECT script_id, len(list_filter(string_split(raw_text, chr(10)), lambda x: trim(regexp_replace(x, '^\s*(?:chapter|अध्याय)\s*[\p{Nd}]+', '', 'i')) <> ''))::BIGINT AS lines FROM parsed_script WHERE raw_text IS NOT NULL""",
    "pause_marks": f"""WITH {_REC}, {_GAPS}, u AS (SELECT gaps.path, s, e FROM gaps JOIN rv ON gaps.path = rv.path WHERE e > 2.5 QUALIFY row_number() OVER (PARTITION BY gaps.path ORDER BY d DESC, s) <= verses - 1),
p AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY s) + 1 AS verse, e AS t, 'pause' AS method FROM u),
r AS (SELECT path, verses, least(2.0::DOUBLE, 0.05::DOUBLE * duration) AS a, greatest(duration - 2.0::DOUBLE, 0.95::DOUBLE * duration) AS b, unnest(generate_series(1, verses)) AS verse FROM rv WHERE verses >= 1),
c AS (SELECT * FROM p UNION ALL SELECT path, verse, a + (verse - 1) * (b - a) / verses, 'even' FROM r ANTI JOIN p USING (path)),
l AS (SELECT path, 0 AS verse, greatest(min(t) - 1.0::DOUBLE, 0) AS t, 'auto' AS method, 'Chapter Title' AS label FROM c GROUP BY 1 UNION ALL SELECT path, verse, t, method, 'Verse ' || verse FROM c),
m AS (SELECT *, floor(t * 1000 + 1e-6::DOUBLE)::BIGINT AS ms FROM l), i AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ms, verse) - 1 AS i FROM m),
q AS (SELECT *, max(ms - i * 100) OVER (PARTITION BY path ORDER BY ms, verse ROWS UNBOUNDED PRECEDING) + i * 100 AS placed FROM i)
SELECT path, row_number() OVER (PARTITION BY path ORDER BY placed, verse) AS ord, label, placed::BIGINT AS time_ms, method FROM q""",
    "pause_observations": f"WITH {_GAPS} SELECT path, round(list_reduce(list_prepend(0.5::DOUBLE, list(d ORDER BY s)), lambda a, x: 0.7::DOUBLE * a + 0.3::DOUBLE * x), 5) AS mean FROM gaps WHERE d BETWEEN 0.1 AND 5.0 GROUP BY 1",
}
