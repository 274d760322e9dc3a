"""Queries of time series, clips, scripts, similarity, marking and learned state, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import numeric, text, timecode
from .functions.similarity import greedy_similarity, text_similarity
from .operators import marking, script, series, state
from .session import spread, table

GAP_US = 36_000_000_000
#: Groups of more rows are cut into stretches of time.
HOT_ROWS = 1_000_000


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    return e.select("event_id", "user_id", "event_type", F.col("value").cast("double").alias("value"), "props", us.alias("us")).withColumn("pos", (F.row_number().over(w) - 1).cast("bigint"))


def pause_islands(spark: SparkSession, d: str) -> DataFrame:
    out = series.islands(_events(spark, d), keys=["user_id"], order=[F.col("us"), F.col("event_id")], inside=F.col("value") <= 20, start="us", end="us", hot_rows=HOT_ROWS)
    return out.where("n >= 4").select("user_id", "start", "end", "n")


def head_run(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumn("width", F.lit(0.01))
    return series.edge_run(rows, keys=["user_id"], order=["us", "event_id"], peak="value", threshold=20, width="width", most=3.0).withColumn("silence_s", F.round("silence_s", 4))


def tail_run(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumn("width", F.lit(0.01))
    return series.edge_run(rows, keys=["user_id"], from_end=True, order=["us", "event_id"], peak="value", threshold=20, width="width", most=3.0).withColumn("silence_s", F.round("silence_s", 4))


def top_pauses(spark: SparkSession, d: str) -> DataFrame:
    found = series.islands(_events(spark, d), keys=["user_id"], order=[F.col("us"), F.col("event_id")], inside=F.col("value") <= 30, start="us", end="us", hot_rows=HOT_ROWS).withColumn("duration", F.col("end") - F.col("start"))
    out = series.longest(found, keys=["user_id"], duration="duration", start="start", k=3)
    return out.select("user_id", "start", "duration", F.col("number").cast("bigint").alias("number"))


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events = _events(spark, d)
    last = events.groupBy("user_id").agg(F.max("us").alias("end_us"))
    marks = events.where("event_type = 'signup'").join(last, "user_id")
    return events, series.segments(marks, keys=["user_id"], start="us", tie="event_id", end_of_group=F.col("end_us")).select("user_id", F.col("event_id").alias("segment"), F.col("us").alias("a"), F.col("segment_end").alias("b"))


def segments_lead(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d)[1]


def midpoint_range_join(spark: SparkSession, d: str) -> DataFrame:
    events, parts = _parts(spark, d)
    inside = series.points_in_segments(events.select("user_id", "us"), parts, keys=["user_id"], at="us", start="a", end="b", bucket_s=86_400_000_000.0)
    return inside.groupBy("user_id", "segment").agg(F.count("*").alias("points"))


def envelope(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumn("total", F.count("*").over(Window.partitionBy("user_id")))
    return series.envelope(rows, keys=["user_id"], position="pos", value="value", total="total", columns=16)


def bucket_peaks(spark: SparkSession, d: str) -> DataFrame:
    return series.bucket_peaks(_events(spark, d), keys=["user_id"], position="us", value="value", width=86_400_000_000)


def min_gap_push(spark: SparkSession, d: str) -> DataFrame:
    return series.push_apart(_events(spark, d), keys=["user_id"], position="us", tie="event_id", gap=GAP_US, hot_rows=HOT_ROWS).select("event_id", "placed")


def thinning(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumn("s", F.floor(F.col("us") / 1_000_000))
    out = series.thin(rows, keys=["user_id"], position="s", gap=172_800.0)
    return out.select("user_id", F.size("drawn").cast("bigint").alias("n"), F.aggregate("drawn", F.lit(0.0), lambda a, x: a + x).cast("bigint").alias("total"))


def clip_stats(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").withColumn("x", F.col("embedding").cast("array<double>"))
    free = series.without_offset(F.col("x"))
    return v.select("vec_id", F.round(F.aggregate("x", F.lit(0.0), lambda a, b: a + b) / F.size("x"), 6).alias("mean"), F.round(F.array_max(F.transform("x", F.abs)), 6).alias("peak"), F.round(F.array_max(free), 6).alias("highest"))


def clip_gain_clip(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", series.gained(F.col("embedding").cast("array<double>"), 4.0).alias("y"))
    return v.select("vec_id", F.round(F.aggregate("y", F.lit(0.0), lambda a, b: a + b), 5).alias("total"), F.size(F.filter("y", lambda x: F.abs(x) >= 1.0)).cast("bigint").alias("clipped"))


def clip_head_silence(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    fixed = series.fix_edges(x, 0.1, 5)
    return table(spark, d, "embeddings").select("vec_id", series.first_loud(x, 0.1).cast("bigint").alias("head"), F.size(fixed).cast("bigint").alias("length"))


def clip_envelope(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.size("embedding").alias("total"), F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "value"))
    return series.envelope(rows, keys=["vec_id"], position="pos", value="value", total="total", columns=8).select("vec_id", "bucket", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def time_parse(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "csv_raw").where("line_no > 1").select("line_id", F.try_element_at(F.split("line", "\t"), F.lit(2)).alias("t"))
    return raw.select("line_id", F.round(timecode.parse_time(F.col("t")), 4).alias("seconds"))


def time_format(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "csv_marker").where("start_seconds IS NOT NULL")
    return m.select("csv_id", timecode.format_time(F.col("start_seconds")).alias("clock"), timecode.minutes_seconds(F.col("start_seconds")).alias("short"))


def level_tally(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.col("value").cast("double").alias("value"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"), F.round(F.avg(numeric.to_db(F.col("value") / 100)), 4).alias("level"))


def loudness_parse(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("I: -70.0 LUFS\n I: -"), F.col("o_orderkey") % 30, F.lit(".5 LUFS\n Peak: -"), F.col("o_custkey") % 9, F.lit(".0 dBFS\n Peak: -3.5 dBFS"))
    level, peak = text.loudness_summary(said)
    return table(spark, d, "orders").select("o_orderkey", level.alias("lufs"), peak.alias("peak"))


def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "script_verse").select("script_id", "verse", "text")).select("script_id", "verse", text.comparable(F.col("text")).alias("plain"))


def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "verse_comparison").where("expected_text IS NOT NULL AND transcribed_text IS NOT NULL")
    return spread(v.select("comparison_id", "expected_text", "transcribed_text")).select("comparison_id", F.round(greedy_similarity(F.col("expected_text"), F.col("transcribed_text")), 6).alias("score"))


def block_similarity(spark: SparkSession, d: str) -> DataFrame:
    v = spread(table(spark, d, "verse_comparison").select("comparison_id", "expected_text", "transcribed_text"))
    return v.select("comparison_id", F.round(text_similarity(F.col("expected_text"), F.col("transcribed_text")), 6).alias("similarity"))


def script_verification(spark: SparkSession, d: str) -> DataFrame:
    v = spread(table(spark, d, "verse_comparison").where("path IS NOT NULL").select("path", "verse_number", "expected_text", "transcribed_text"))
    out = script.verification_summary(script.compare_texts(v, expected="expected_text", transcribed="transcribed_text"), keys=["path"], verse="verse_number", expected="expected_text")
    return out.select("path", "checked", "matching", F.round("mean_similarity", 6).alias("mean_similarity"), "ok", (F.col("checked") - F.col("matching")).alias("issues"))


def verse_blocks(spark: SparkSession, d: str) -> DataFrame:
    return script.verses(spread(table(spark, d, "parsed_script").select("script_id", "raw_text"), "script_id"), key="script_id", text="raw_text", keep_headings=True)


def segment_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of the expected texts, spread evenly over their times, given to the segments between embedded markers."""
    v = table(spark, d, "verse_comparison").where("path IS NOT NULL AND expected_text IS NOT NULL AND start_s < end_s")
    one = v.groupBy("path", "verse_number").agg(F.min_by(F.struct("expected_text", "start_s", "end_s"), "comparison_id").alias("x")).select("path", "verse_number", "x.*")
    cut = one.withColumn("w", F.split("expected_text", " ")).withColumn("step", (F.col("end_s") - F.col("start_s")) / F.size("w"))
    words = cut.select("path", F.posexplode("w").alias("i", "word"), "start_s", "step", "verse_number")
    words = words.select("path", (F.col("verse_number") * 1000 + F.col("i")).cast("bigint").alias("pos"), (F.col("start_s") + F.col("i") * F.col("step")).alias("start"), (F.col("start_s") + (F.col("i") + 1) * F.col("step")).alias("end"), "word")
    return script.words_of_segments(words, one.select("path", F.col("verse_number").alias("verse"), "start_s", "end_s"), keys=["path"]).select("path", "verse", "transcript")


def _corrections(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = _events(spark, d)
    return e.select("event_id", "user_id", "event_type", (F.col("value") % 10).alias("expected"), ((F.col("value") * 1.02 + 0.1) % 10).alias("corrected"), "us", F.row_number().over(w).alias("seq"))


def learned_profiles(spark: SparkSession, d: str) -> DataFrame:
    out = state.profiles(_corrections(spark, d), keys=["user_id"], expected="expected", corrected="corrected")
    return out.select("user_id", "corrections", F.round("mean_offset", 5).alias("mean_offset"), F.round("mean_speed", 5).alias("mean_speed"))


def ema_state(spark: SparkSession, d: str) -> DataFrame:
    return state.exponential_mean(_events(spark, d), keys=["user_id"], value="value", order="pos").select("user_id", F.round("mean", 5).alias("mean"))


def running_means(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return _events(spark, d).select("event_id", F.round(F.avg("value").over(w), 5).alias("mean"))


def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return state.latest(_events(spark, d), keys=["user_id", "event_type"], value=F.col("value"), order="pos")


def damped_adjust(spark: SparkSession, d: str) -> DataFrame:
    times = _corrections(spark, d).select("event_id", "user_id", "event_type", F.col("expected").alias("time"))
    out = state.adjust(times, _corrections(spark, d), keys=["user_id"], verse="event_type", time="time", expected="expected", corrected="corrected", order="seq")
    return out.select("event_id", F.floor(F.col("adjusted") * 1000 + 0.25).cast("bigint").alias("adjusted_ms"))


def _recordings(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "marker").where("path IS NOT NULL AND sample_offset IS NOT NULL")
    length = m.groupBy("path").agg((F.max(F.col("sample_offset") / F.col("sample_rate")) + 5.0).alias("duration"), F.max("sample_rate").alias("rate"))
    return length.join(table(spark, d, "file_report").where("expected_verses IS NOT NULL").groupBy("path").agg(F.max("expected_verses").alias("verses")), "path")


def even_marks(spark: SparkSession, d: str) -> DataFrame:
    out = marking.place_evenly(_recordings(spark, d), key="path", verses="verses", duration="duration")
    return out.select("path", "verse", F.floor(F.col("time_s") * 1000 + 0.25).cast("bigint").alias("time_ms"))


def _verses_heard(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(words, script) from verse_comparison: of each path and verse the first comparison, the words of its transcript
    0.4 s apart from where it starts. Repeated comparisons of a verse would be the same verse heard twice in a recording."""
    v = table(spark, d, "verse_comparison").where("path IS NOT NULL")
    one = v.groupBy("path", F.col("verse_number").cast("bigint").alias("verse")).agg(F.min_by(F.struct("expected_text", "transcribed_text", "start_s"), "comparison_id").alias("x")).select("path", "verse", "x.*")
    words = one.where("transcribed_text IS NOT NULL").select("path", "verse", F.coalesce("start_s", F.col("verse") * 10.0).alias("s"), F.posexplode(F.split("transcribed_text", " ")).alias("i", "word"))
    words = words.select("path", (F.col("verse") * 1000 + F.col("i")).alias("pos"), (F.col("s") + F.col("i") * 0.4).alias("start"), "word")
    return words, one.select("path", "verse", F.col("expected_text").alias("text"))


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    """Pauses: the gaps between the verses' times of verse_comparison."""
    v = table(spark, d, "verse_comparison").where("path IS NOT NULL AND start_s IS NOT NULL AND end_s IS NOT NULL").select("path", "start_s", "end_s").distinct()
    w = Window.partitionBy("path").orderBy("start_s", "end_s")
    return v.select("path", F.col("end_s").alias("start"), F.lead("start_s").over(w).alias("end")).where("end > start").withColumn("duration", F.col("end") - F.col("start"))


def align_words(spark: SparkSession, d: str) -> DataFrame:
    """Expected verses aligned with the words of the transcripts."""
    words, asked = _verses_heard(spark, d)
    return marking.place_by_words(words, asked, key="path")


_E = "e AS (SELECT event_id, user_id, event_type, value::DOUBLE AS value, props, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"
_ISL = "i AS (SELECT user_id, min(us) AS \"start\", max(us) AS \"end\", count(*) AS n FROM (SELECT *, sum((NOT value <= {0})::INT) OVER (PARTITION BY user_id ORDER BY us, event_id) AS g FROM e) WHERE value <= {0} GROUP BY user_id, g)"
_SEG = "seg AS (SELECT user_id, event_id AS segment, us AS a, coalesce(lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id), m) AS b FROM e JOIN (SELECT user_id, max(us) AS m FROM e GROUP BY 1) USING (user_id) WHERE event_type = 'signup')"
_COR = "c AS (SELECT event_id, user_id, event_type, value % 10 AS expected, (value * 1.02::DOUBLE + 0.1::DOUBLE) % 10 AS corrected, pos + 1 AS seq FROM e)"
_REC = """rec AS (SELECT path, max(sample_offset / sample_rate) + 5.0::DOUBLE AS duration, max(sample_rate) AS rate FROM marker WHERE path IS NOT NULL AND sample_offset IS NOT NULL GROUP BY 1),
rv AS (SELECT path, duration, rate, verses FROM rec JOIN (SELECT path, max(expected_verses) AS verses FROM file_report WHERE expected_verses IS NOT NULL GROUP BY 1) USING (path))"""
_PUNCT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x{BF}\x{0964}\x{0965}\x{2000}-\x{206F}\x{2E00}-\x{2E7F}\x{3000}-\x{303F}\x{FF00}-\x{FF0F}\x{FF1A}-\x{FF20}\x{FF3B}-\x{FF40}\x{FF5B}-\x{FF65}]"
_RUN = "SELECT user_id, round(least(count(*) FILTER (g = 0) * 0.01::DOUBLE, 3.0), 4) AS silence_s FROM (SELECT user_id, sum((value > 20)::INT) OVER (PARTITION BY user_id ORDER BY us {0}, event_id {0}) AS g FROM e) GROUP BY 1"

QUERIES = {
    f.__name__: f
    for f in (
        pause_islands, head_run, tail_run, top_pauses, segments_lead, midpoint_range_join, envelope, bucket_peaks, min_gap_push, thinning, clip_stats, clip_gain_clip, clip_head_silence, clip_envelope,
        time_parse, time_format, level_tally, loudness_parse, text_normalize, greedy_match, block_similarity, script_verification, verse_blocks, segment_words, learned_profiles, ema_state, running_means,
        latest_per_key, damped_adjust, even_marks, align_words,
    )
}
SQL = {
    "pause_islands": f"WITH {_E}, {_ISL.format(20)} SELECT * FROM i WHERE n >= 4",
    "head_run": f"WITH {_E} {_RUN.format('')}",
    "tail_run": f"WITH {_E} {_RUN.format('DESC')}",
    "top_pauses": f'WITH {_E}, {_ISL.format(30)}, k AS (SELECT user_id, "start", "end" - "start" AS duration FROM i QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY "end" - "start" DESC, "start") <= 3) SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "start") AS number FROM k',
    "segments_lead": f"WITH {_E}, {_SEG} SELECT * FROM seg",
    "midpoint_range_join": f"WITH {_E}, {_SEG} SELECT e.user_id, segment, count(*) AS points FROM e JOIN seg ON e.user_id = seg.user_id AND us BETWEEN a AND b GROUP BY 1, 2",
    "envelope": f"WITH {_E}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS c FROM e), b AS (SELECT user_id, pos // greatest(1, c // 16) AS bucket, value FROM n) SELECT user_id, bucket, min(value) AS low, max(value) AS high FROM b WHERE bucket < 16 GROUP BY 1, 2",
    "bucket_peaks": f"WITH {_E} SELECT user_id, us // 86400000000 AS bucket, max(abs(value)) AS peak, count(*) AS samples FROM e GROUP BY 1, 2",
    "min_gap_push": f"WITH {_E} SELECT event_id, (max(us - pos * {GAP_US}) OVER (PARTITION BY user_id ORDER BY us, event_id) + pos * {GAP_US})::BIGINT AS placed FROM e",
    "thinning": f"""WITH {_E}, s AS (SELECT user_id, list({{'p': (us // 1000000)::DOUBLE, 'last': -1e18::DOUBLE, 'n': 0::BIGINT, 't': 0::BIGINT}} ORDER BY us // 1000000) AS l FROM e GROUP BY 1),
r AS (SELECT user_id, list_reduce(list_prepend({{'p': 0::DOUBLE, 'last': -1e18::DOUBLE, 'n': 0::BIGINT, 't': 0::BIGINT}}, l), lambda a, x: CASE WHEN x.p - a.last >= 172800 THEN {{'p': x.p, 'last': x.p, 'n': a.n + 1, 't': a.t + x.p::BIGINT}} ELSE a END) AS z FROM s)
SELECT user_id, z.n AS n, z.t AS total FROM r""",
    "greedy_match": """WITH v AS (SELECT comparison_id, expected_text AS x, transcribed_text AS y FROM verse_comparison WHERE expected_text IS NOT NULL AND transcribed_text IS NOT NULL),
c AS (SELECT *, list_transform(generate_series(1, length(x)), lambda i: {'c': substr(x, i, 1), 'at': 0::BIGINT, 'm': 0::BIGINT}) AS l FROM v),
r AS (SELECT comparison_id, length(x) + length(y) AS n, list_reduce(list_prepend({'c': '', 'at': 0::BIGINT, 'm': 0::BIGINT}, l), lambda a, e: CASE WHEN a.at < 0 THEN a WHEN instr(substr(y, a.at + 1), e.c) > 0 THEN {'c': '', 'at': a.at + instr(substr(y, a.at + 1), e.c), 'm': a.m + 1} ELSE {'c': '', 'at': -1::BIGINT, 'm': a.m} END).m AS m FROM c)
SELECT comparison_id, round(CASE WHEN n = 0 THEN 0 ELSE 2.0::DOUBLE * m / n END, 6) AS score FROM r""",
    "segment_words": """WITH o AS (SELECT path, verse_number, arg_min({'t': expected_text, 'a': start_s, 'b': end_s}, comparison_id) AS z FROM verse_comparison WHERE path IS NOT NULL AND expected_text IS NOT NULL AND start_s < end_s GROUP BY 1, 2),
p AS (SELECT path, verse_number AS v, z.a AS a, z.b AS b, string_split(z.t, ' ') AS w FROM o), q AS (SELECT path, v, a, (b - a) / len(w) AS step, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM p),
m AS (SELECT path, v * 1000 + i AS pos, ((a + i * step) + (a + (i + 1) * step)) / 2 AS mid, word FROM q)
SELECT m.path, p.v AS verse, string_agg(word, ' ' ORDER BY pos) AS transcript FROM m JOIN p ON m.path = p.path AND mid BETWEEN p.a AND p.b GROUP BY 1, 2, p.a, p.b""",
    "clip_stats": "WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT *, list_sum(v) / len(v) AS mean FROM x) SELECT vec_id, round(mean, 6) AS mean, round(list_max(list_transform(v, lambda a: abs(a))), 6) AS peak, round(list_max(v) - CASE WHEN abs(mean) > 1e-6 THEN mean ELSE 0 END, 6) AS highest FROM m",
    "clip_gain_clip": "WITH x AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda a: greatest(least(a * 4.0::DOUBLE, 1.0::DOUBLE), -1.0::DOUBLE)) AS v FROM embeddings) SELECT vec_id, round(list_sum(v), 5) AS total, len(list_filter(v, lambda a: abs(a) >= 1.0))::BIGINT AS clipped FROM x",
    "clip_head_silence": """WITH x AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda a: abs(a) > 0.1::DOUBLE) AS v FROM embeddings), p AS (SELECT vec_id, len(v) AS n, coalesce(nullif(list_position(v, true), 0) - 1, len(v)) AS h, coalesce(nullif(list_position(list_reverse(v), true), 0) - 1, len(v)) AS t FROM x)
SELECT vec_id, h::BIGINT AS head, (CASE WHEN h >= n THEN n ELSE n - h - t END + 10)::BIGINT AS length FROM p""",
    "clip_envelope": "WITH x AS (SELECT vec_id, len(embedding) AS n, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT vec_id, pos // greatest(1, n // 8) AS bucket, round(min(v), 6) AS low, round(max(v), 6) AS high FROM x WHERE pos // greatest(1, n // 8) < 8 GROUP BY 1, 2",
    "time_parse": r"""WITH t AS (SELECT line_id, trim(nullif(string_split(line, chr(9))[2], NULL)) AS t FROM csv_raw WHERE line_no > 1), g AS (SELECT line_id, t, regexp_extract(t, '^(?:([0-9]+):)?([0-9]+):([0-9]{1,2})\.([0-9]+)$', ['h', 'm', 's', 'f']) AS p FROM t)
SELECT line_id, round(CASE WHEN regexp_matches(t, '^(?:([0-9]+):)?([0-9]+):([0-9]{1,2})\.([0-9]+)$') THEN coalesce(try_cast(p.h AS DOUBLE), 0) * 3600 + try_cast(p.m AS DOUBLE) * 60 + try_cast(p.s AS DOUBLE) + try_cast(rpad(p.f, 3, '0')[1:3] AS DOUBLE) / 1000
 WHEN regexp_matches(t, '^[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?$') THEN try_cast(t AS DOUBLE) ELSE 0 END, 4) AS seconds FROM g""",
    "time_format": "WITH m AS (SELECT csv_id, start_seconds AS s, round(start_seconds * 1000)::BIGINT AS ms FROM csv_marker WHERE start_seconds IS NOT NULL) SELECT csv_id, printf('%d:%02d.%03d', ms // 60000, (ms % 60000) // 1000, ms % 1000) AS clock, printf('%d:%02d', floor(s)::BIGINT // 60, floor(s)::BIGINT % 60) AS short FROM m",
    "level_tally": "SELECT event_type, count(*) AS n, sum(try_cast(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k, round(avg(CASE WHEN value > 0 THEN greatest(20 * log10(value::DOUBLE / 100), -120) ELSE -120 END), 4) AS level FROM events GROUP BY 1",
    "loudness_parse": "SELECT o_orderkey, -(o_orderkey % 30 + 0.5)::DOUBLE AS lufs, greatest(-(o_custkey % 9)::DOUBLE, -3.5::DOUBLE) AS peak FROM orders",
    "text_normalize": rf"SELECT script_id, verse, trim(regexp_replace(regexp_replace(lower(nfc_normalize(coalesce(text, ''))), '{_PUNCT}', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM script_verse",
    "verse_blocks": "SELECT DISTINCT script_id, verse::BIGINT AS verse, text FROM script_verse",
    "learned_profiles": f"WITH {_E}, {_COR} SELECT user_id, count(*) AS corrections, round(avg(corrected - expected), 5) AS mean_offset, round(coalesce(avg(CASE WHEN expected > 0 THEN corrected / expected END), 1), 5) AS mean_speed FROM c GROUP BY 1",
    "ema_state": f"WITH {_E} SELECT user_id, round(list_reduce(list_prepend(0.5::DOUBLE, list(value ORDER BY pos)), lambda a, x: 0.7::DOUBLE * a + 0.3::DOUBLE * x), 5) AS mean FROM e GROUP BY 1",
    "running_means": f"WITH {_E} SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING), 5) AS mean FROM e",
    "latest_per_key": f"WITH {_E} SELECT user_id, event_type, arg_max(value, pos) AS latest FROM e GROUP BY 1, 2",
    "damped_adjust": f"""WITH {_E}, {_COR}, p AS (SELECT user_id, avg(corrected - expected) AS mo, coalesce(avg(CASE WHEN expected > 0 THEN corrected / expected END), 1) AS ms FROM c GROUP BY 1), l AS (SELECT user_id, event_type, arg_max(corrected - expected, seq) AS lo FROM c GROUP BY 1, 2),
n AS (SELECT event_id, expected AS t, greatest(expected + 0.7::DOUBLE * lo + 0.3::DOUBLE * mo, 0) AS a FROM c JOIN p USING (user_id) JOIN l USING (user_id, event_type)) SELECT event_id, floor(CASE WHEN abs(a - t) < 5 THEN a ELSE t END * 1000 + 0.25)::BIGINT AS adjusted_ms FROM n""",
    "even_marks": f"WITH {_REC}, s AS (SELECT path, verses, least(2.0::DOUBLE, 0.05::DOUBLE * duration) AS a, greatest(duration - 2.0::DOUBLE, 0.95::DOUBLE * duration) AS b, unnest(generate_series(1, verses)) AS verse FROM rv WHERE verses >= 1) SELECT path, verse::BIGINT AS verse, floor((a + (verse - 1) * (b - a) / verses) * 1000 + 0.25)::BIGINT AS time_ms FROM s",
}
