"""Queries of identity, completeness, rules, reconciliation and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import basename, label_kind, short_label, stem, verse_number
from .operators import checks, completeness, identity, reconcile
from .plans import report
from .session import table

SETTINGS = checks.Settings()


def _markers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "marker").withColumn("seconds", F.col("sample_offset") / F.col("sample_rate"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    """One row a recording: the earliest scan."""
    rows = table(spark, d, "file_report").where("path IS NOT NULL")
    first = F.min_by(F.struct("file_id", "filename", "book", "chapter", "expected_verses", "error"), F.struct("file_id"))
    return rows.groupBy("path").agg(first.alias("x")).select("path", "x.*")


def completeness_missing(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"))
    upto = lines.groupBy("l_orderkey").agg(F.max("n").alias("upto"))
    return completeness.missing_numbers(lines, upto, keys=["l_orderkey"], number="n", upto="upto")


def completeness_report(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"))
    upto = lines.groupBy("l_orderkey").agg(F.max("n").alias("upto"))
    out = completeness.completeness(lines, upto, keys=["l_orderkey"], number="n", upto="upto")
    return out.select("l_orderkey", "expected", "found", "missing_text", F.size("repeated").cast("bigint").alias("repeated"), "passed")


def verse_completeness(spark: SparkSession, d: str) -> DataFrame:
    verses = checks.classify(_markers(spark, d), SETTINGS).where("category = 'verse'").select("path", "verse")
    out = completeness.completeness(verses, _files(spark, d), keys=["path"], number="verse", upto="expected_verses")
    return out.select("path", "expected", "found", "missing_text", completeness.ranges(F.col("extra")).alias("extra_text"), completeness.ranges(F.col("repeated")).alias("repeated_text"), "passed")


def duplicates(spark: SparkSession, d: str) -> DataFrame:
    return completeness.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def orders_without_lines(spark: SparkSession, d: str) -> DataFrame:
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left_anti").select("o_orderkey")


def range_compress_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(completeness.ranges(F.collect_set(F.col("l_partkey"))).alias("parts"))


def batch_missing_chapters(spark: SparkSession, d: str) -> DataFrame:
    books = table(spark, d, "ref_item").where("kind = 'book'").select(F.col("name").alias("book"), F.col("chapters").alias("chapters"))
    out = completeness.missing_chapters(table(spark, d, "file_report").select("book", "chapter"), books.select(F.col("book"), F.col("chapters").alias("total")), book="book", chapter="chapter", total="total")
    return out.select("book", "total_chapters", "files", "missing_text", completeness.ranges(F.col("repeated")).alias("repeated_text"), "complete")


def script_number_gaps(spark: SparkSession, d: str) -> DataFrame:
    out = completeness.sequence_gaps(table(spark, d, "script_verse"), keys=["script_id"], number="verse")
    return out.select("script_id", "first", "last", "numbers", F.array_join(F.col("gaps").cast("array<string>"), ",").alias("gaps"))


def filename_parse(spark: SparkSession, d: str) -> DataFrame:
    out = identity.parse_filename(table(spark, d, "file_report").select("file_id", "path", "filename"))
    return out.select("file_id", basename(F.col("path")).alias("base"), stem(F.col("path")).alias("stem"), "book_key", "chapter_no")


def alias_lookup(spark: SparkSession, d: str) -> DataFrame:
    ref = table(spark, d, "ref_item").where("kind = 'book'")
    aliases = ref.select(F.col("code").alias("alias"), F.col("name").alias("book")).unionByName(ref.select(F.col("name").alias("alias"), F.col("name").alias("book")))
    chapters = ref.select(F.col("name").alias("book"), F.explode(F.sequence(F.lit(1), "chapters")).alias("chapter"), F.col("chapters").alias("verses"))
    return identity.identify(table(spark, d, "file_report").select("file_id", "filename"), aliases, chapters).select("file_id", "canonical_book", "chapter_no", "verses")


def dimension_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "file_report").where("book IS NOT NULL AND chapter IS NOT NULL").groupBy("book", "chapter").agg(F.max("expected_verses").alias("verses"))
    return identity.dimension_totals(rows)


def label_classes(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "marker").select(label_kind(F.col("label")).alias("category"), verse_number(F.col("label")).alias("verse"))
    return out.groupBy("category").agg(F.count("*").alias("n"), F.count("verse").alias("numbered"), F.sum("verse").alias("total"))


def label_short(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "marker").groupBy(short_label(F.col("label")).alias("short")).agg(F.count("*").alias("n"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts as stand-ins for measured recordings."""
    p = table(spark, d, "part")
    return p.select(
        "p_partkey", F.when(F.col("p_size") > 25, 48000).otherwise(44100).alias("sample_rate"), F.when(F.col("p_size") % 2 == 0, 24).otherwise(16).alias("bits"),
        (-18.0 - (F.col("p_size") % 5) * 0.25).alias("lufs"), (-1.5 + (F.col("p_size") % 3) * 0.5).alias("true_peak"),
        F.when(F.col("p_size") % 7 != 0, 1.5 + (F.col("p_size") % 4) * 0.5).alias("head_silence"), (1.0 + (F.col("p_size") % 6) * 0.25).alias("tail_silence"),
    )


def check_items_long(spark: SparkSession, d: str) -> DataFrame:
    return checks.measurement_items(_parts(spark, d), SETTINGS, key="p_partkey").select("p_partkey", "ord", "name", "passed")


def report_rollup(spark: SparkSession, d: str) -> DataFrame:
    return checks.rollup(checks.measurement_items(_parts(spark, d), SETTINGS, key="p_partkey"), key="p_partkey")


def report_pivot(spark: SparkSession, d: str) -> DataFrame:
    names = ["Format", "Loudness", "True Peak", "Head Silence", "Tail Silence"]
    out = checks.pivoted(checks.measurement_items(_parts(spark, d), SETTINGS, key="p_partkey"), key="p_partkey", names=names)
    return out.toDF("p_partkey", *[n.lower().replace(" ", "_") for n in names])


def marker_check_items(spark: SparkSession, d: str) -> DataFrame:
    return checks.marker_items(_files(spark, d), _markers(spark, d), SETTINGS, key="path").select("path", "ord", "name", "passed", "value")


def file_overall(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    items = checks.marker_items(files, _markers(spark, d), SETTINGS, key="path")
    return checks.overall(files, items, key="path", error="error").select("path", "items", "fails", "passed")


def _compared(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.compare_markers(_markers(spark, d), table(spark, d, "csv_marker"), path="path", name="name", label="label", seconds="seconds", start="start_seconds", order="marker_id", sidecar_order="csv_id")


def reconcile_full_outer(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d)


def reconcile_summary(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.comparison_summary(_compared(spark, d))


def batch_tally(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_report").agg(F.count("*").alias("files"), F.count_if("passed").alias("passed"), F.count("error").alias("errors"))


def mistakes_export(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    return report.mistakes(files, checks.marker_items(files, _markers(spark, d), SETTINGS, key="path").drop("detail").withColumn("detail", F.coalesce("value", F.lit(""))), key="path")


def full_report(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    items = checks.marker_items(files, _markers(spark, d), SETTINGS, key="path")
    return report.full(files, items, key="path").select("path", "Check", "Status", "Value")


def distinct_ordered(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


_CAT = r"""CASE WHEN lower(trim(coalesce(label, ''))) = 'chapter title' THEN 'title' WHEN regexp_full_match(lower(trim(coalesce(label, ''))), 'heading\s*[0-9]*') THEN 'heading'
 WHEN regexp_full_match(lower(trim(coalesce(label, ''))), 'verse\s*[0-9]+') THEN 'verse' WHEN regexp_matches(lower(trim(coalesce(label, ''))), '^verse\b') THEN 'malformed' ELSE 'unknown' END"""
_CM = rf"cm AS (SELECT path, marker_id, label, {_CAT} AS category, try_cast(nullif(regexp_extract(lower(trim(label)), '^verse\s*([0-9]+)$', 1), '') AS BIGINT) AS verse FROM marker)"
_RUNS = "list_aggregate(list_transform({0}, lambda r: CASE WHEN r.a = r.b THEN r.a::VARCHAR ELSE r.a::VARCHAR || '-' || r.b::VARCHAR END), 'string_agg', ', ')"


def _ranges(name: str, source: str, keys: str) -> str:
    """Runs of n in `source`, told as text for each key."""
    return f"""{name} AS (SELECT {keys}, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a::VARCHAR || '-' || b::VARCHAR END, ', ' ORDER BY a) AS t FROM
  (SELECT {keys}, min(n) AS a, max(n) AS b FROM (SELECT {keys}, n, n - row_number() OVER (PARTITION BY {keys} ORDER BY n) AS g FROM (SELECT DISTINCT {keys}, n FROM {source})) GROUP BY {keys}, g) GROUP BY {keys})"""


_FILES = "f AS (SELECT path, file_id, filename, book, chapter, expected_verses, error FROM file_report WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY file_id) = 1)"
_VC = f"""{_CM}, {_FILES}, vs AS (SELECT path, verse AS n, count(*) AS c FROM cm WHERE category = 'verse' AND verse IS NOT NULL GROUP BY 1, 2),
want AS (SELECT path, unnest(generate_series(1, expected_verses)) AS n FROM f WHERE expected_verses >= 1),
miss AS (SELECT path, n FROM want ANTI JOIN vs USING (path, n)),
ext AS (SELECT path, n FROM vs JOIN f USING (path) WHERE expected_verses IS NOT NULL AND (n < 1 OR n > expected_verses)),
rep AS (SELECT path, n FROM vs WHERE c > 1), {_ranges('mt', 'miss', 'path')}, {_ranges('et', 'ext', 'path')}, {_ranges('rt', 'rep', 'path')},
fnd AS (SELECT path, sum(c)::BIGINT AS found FROM vs GROUP BY 1),
vc AS (SELECT path, expected_verses::BIGINT AS expected, coalesce(found, 0) AS found, coalesce(mt.t, '') AS missing_text, coalesce(et.t, '') AS extra_text, coalesce(rt.t, '') AS repeated_text,
  mt.t IS NULL AND et.t IS NULL AND rt.t IS NULL AS passed FROM f LEFT JOIN fnd USING (path) LEFT JOIN mt USING (path) LEFT JOIN et USING (path) LEFT JOIN rt USING (path))"""
_ITEMS = f"""{_VC}, cnt AS (SELECT path, count(*) AS n, count(*) FILTER (category = 'title') AS titles, count(*) FILTER (category IN ('malformed', 'unknown')) AS bad FROM cm GROUP BY 1),
items AS (SELECT path, 6 AS ord, 'Markers' AS name, false AS passed, '' AS value FROM f ANTI JOIN cnt USING (path)
 UNION ALL SELECT path, 7, 'Chapter Title', titles = 1, CASE WHEN titles = 1 THEN '1' ELSE '' END FROM f JOIN cnt USING (path)
 UNION ALL SELECT path, 9, 'Marker Spelling', false, bad || ' bad' FROM f JOIN cnt USING (path) WHERE bad > 0
 UNION ALL SELECT path, 10, 'Verses', passed, CASE WHEN expected IS NULL THEN found || ' found' ELSE found || '/' || expected END FROM vc JOIN cnt USING (path))"""
_PARTS = """p AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN 48000 ELSE 44100 END AS rate, CASE WHEN p_size % 2 = 0 THEN 24 ELSE 16 END AS bits, -18.0::DOUBLE - (p_size % 5) * 0.25 AS lufs,
 -1.5::DOUBLE + (p_size % 3) * 0.5 AS peak, CASE WHEN p_size % 7 <> 0 THEN 1.5::DOUBLE + (p_size % 4) * 0.5 END AS head, 1.0::DOUBLE + (p_size % 6) * 0.25 AS tail FROM part),
items AS (SELECT p_partkey, 1 AS ord, 'Format' AS name, rate = 48000 AND bits = 24 AS passed FROM p UNION ALL SELECT p_partkey, 2, 'Loudness', abs(lufs + 18) <= 0.5 FROM p
 UNION ALL SELECT p_partkey, 3, 'True Peak', peak <= -1.0 FROM p UNION ALL SELECT p_partkey, 4, 'Head Silence', coalesce(abs(head - 2) <= 0.5, false) FROM p UNION ALL SELECT p_partkey, 5, 'Tail Silence', abs(tail - 2) <= 0.5 FROM p)"""
_CMP = """l AS (SELECT path, lower(trim(name)) AS name, start_seconds, csv_id FROM csv_marker WHERE trim(name) <> '' AND path IS NOT NULL),
r AS (SELECT path, lower(trim(label)) AS name, arg_max_null(sample_offset / sample_rate, marker_id) AS s, true AS here FROM marker WHERE trim(label) <> '' AND path IS NOT NULL GROUP BY 1, 2),
cmp AS (SELECT path, name, CASE WHEN csv_id IS NULL THEN 'embedded_only' WHEN here IS NULL THEN 'sidecar_only' WHEN coalesce(abs(start_seconds - s) <= 0.5, false) THEN 'matched' ELSE 'time' END AS status, csv_id AS "row" FROM l FULL JOIN r USING (path, name))"""
_LINES = f"""lines AS (SELECT l_orderkey, l_linenumber AS n, count(*) AS c FROM lineitem GROUP BY 1, 2), up AS (SELECT l_orderkey, max(n) AS upto, sum(c)::BIGINT AS found, count(*) FILTER (c > 1) AS repeated FROM lines GROUP BY 1),
miss AS (SELECT l_orderkey, n FROM (SELECT l_orderkey, unnest(generate_series(1, upto)) AS n FROM up) ANTI JOIN lines USING (l_orderkey, n)), {_ranges('mt', 'miss', 'l_orderkey')}"""
_STEM = r"regexp_replace(filename, '(.)\.[^.]*$', '\1')"

QUERIES = {
    f.__name__: f
    for f in (
        completeness_missing, completeness_report, verse_completeness, duplicates, orders_without_lines, range_compress_lines, batch_missing_chapters, script_number_gaps, filename_parse, alias_lookup,
        dimension_totals, label_classes, label_short, check_items_long, report_rollup, report_pivot, marker_check_items, file_overall, reconcile_full_outer, reconcile_summary, batch_tally, mistakes_export,
        full_report, distinct_ordered,
    )
}
SQL = {
    "completeness_missing": f"WITH {_LINES} SELECT l_orderkey, n::BIGINT AS n FROM miss",
    "completeness_report": f"WITH {_LINES} SELECT l_orderkey, upto::BIGINT AS expected, found, coalesce(t, '') AS missing_text, repeated, t IS NULL AND repeated = 0 AS passed FROM up LEFT JOIN mt USING (l_orderkey)",
    "verse_completeness": f"WITH {_VC} SELECT * FROM vc",
    "duplicates": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "orders_without_lines": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "range_compress_lines": f"WITH s AS (SELECT l_suppkey, l_partkey AS n FROM lineitem), {_ranges('x', 's', 'l_suppkey')} SELECT l_suppkey, t AS parts FROM x",
    "batch_missing_chapters": f"""WITH b AS (SELECT name AS book, chapters FROM ref_item WHERE kind = 'book'), s AS (SELECT book, chapter AS n, count(*) AS c FROM file_report SEMI JOIN b USING (book) WHERE chapter IS NOT NULL GROUP BY 1, 2),
t0 AS (SELECT book, sum(c)::BIGINT AS files FROM s GROUP BY 1), miss AS (SELECT book, n FROM (SELECT book, unnest(generate_series(1, chapters)) AS n FROM b SEMI JOIN t0 USING (book)) ANTI JOIN s USING (book, n)), rep AS (SELECT book, n FROM s WHERE c > 1),
{_ranges('mt', 'miss', 'book')}, {_ranges('rt', 'rep', 'book')} SELECT book, chapters::BIGINT AS total_chapters, files, coalesce(mt.t, '') AS missing_text, coalesce(rt.t, '') AS repeated_text, mt.t IS NULL AS complete
FROM t0 JOIN b USING (book) LEFT JOIN mt USING (book) LEFT JOIN rt USING (book)""",
    "script_number_gaps": """WITH e AS (SELECT DISTINCT script_id, verse::BIGINT AS n FROM script_verse WHERE verse IS NOT NULL), g AS (SELECT script_id, min(n) AS first, max(n) AS last, count(*) AS numbers FROM e GROUP BY 1),
s AS (SELECT script_id, n, lag(n) OVER (PARTITION BY script_id ORDER BY n) AS p FROM e),
m AS (SELECT script_id, unnest(generate_series(p + 1, least(n - 1, p + 10))) AS n FROM s WHERE n > p + 1),
k AS (SELECT script_id, string_agg(n::VARCHAR, ',' ORDER BY n) AS t FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY script_id ORDER BY n) <= 10) GROUP BY 1)
SELECT script_id, first, last, numbers, coalesce(t, '') AS gaps FROM g LEFT JOIN k USING (script_id) WHERE first <> 1 OR t IS NOT NULL""",
    "filename_parse": rf"""SELECT file_id, regexp_extract(path, '[^/\\]*$') AS base, regexp_replace(regexp_extract(path, '[^/\\]*$'), '(.)\.[^.]*$', '\1') AS stem,
 regexp_replace(lower(nullif(regexp_extract({_STEM}, '^\s*(.+?)[\s_.-]+([0-9]+)\s*$', 1), '')), '[ _]', '', 'g') AS book_key, try_cast(nullif(regexp_extract({_STEM}, '^\s*(.+?)[\s_.-]+([0-9]+)\s*$', 2), '') AS BIGINT) AS chapter_no FROM file_report""",
    "alias_lookup": rf"""WITH k AS (SELECT file_id, regexp_replace(lower(nullif(regexp_extract({_STEM}, '^\s*(.+?)[\s_.-]+([0-9]+)\s*$', 1), '')), '[ _]', '', 'g') AS a, try_cast(nullif(regexp_extract({_STEM}, '^\s*(.+?)[\s_.-]+([0-9]+)\s*$', 2), '') AS BIGINT) AS ch FROM file_report),
al AS (SELECT a, min(name) AS name FROM (SELECT regexp_replace(lower(unnest([code, name])), '[ _]', '', 'g') AS a, name FROM ref_item WHERE kind = 'book') GROUP BY 1), b AS (SELECT name, chapters FROM ref_item WHERE kind = 'book')
SELECT file_id, CASE WHEN ok THEN name END AS canonical_book, CASE WHEN ok THEN ch END AS chapter_no, CASE WHEN ok THEN chapters END AS verses FROM (SELECT *, coalesce(ch BETWEEN 1 AND chapters, false) AS ok FROM k LEFT JOIN al USING (a) LEFT JOIN b USING (name))""",
    "dimension_totals": "SELECT book, count(*) AS chapters, sum(v)::BIGINT AS verses FROM (SELECT book, chapter, max(expected_verses) AS v FROM file_report WHERE book IS NOT NULL AND chapter IS NOT NULL GROUP BY 1, 2) GROUP BY 1",
    "label_classes": f"WITH {_CM} SELECT category, count(*) AS n, count(verse) AS numbered, sum(verse)::BIGINT AS total FROM cm GROUP BY 1",
    "label_short": f"WITH {_CM} SELECT CASE WHEN category = 'title' THEN 'Chapter' WHEN category = 'heading' THEN 'Heading' WHEN regexp_replace(label, '[^0-9]', '', 'g') <> '' THEN regexp_replace(label, '[^0-9]', '', 'g') ELSE label END AS short, count(*) AS n FROM cm GROUP BY 1",
    "check_items_long": f"WITH {_PARTS} SELECT * FROM items",
    "report_rollup": f"WITH {_PARTS} SELECT p_partkey, count(*) AS items, count(*) FILTER (NOT passed) AS fails, bool_and(passed) AS passed FROM items GROUP BY 1",
    "report_pivot": f"WITH {_PARTS} SELECT p_partkey, " + ", ".join(f"max(CASE WHEN name = '{n}' THEN CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END END) AS {n.lower().replace(' ', '_')}" for n in ("Format", "Loudness", "True Peak", "Head Silence", "Tail Silence")) + " FROM items GROUP BY 1",
    "marker_check_items": f"WITH {_ITEMS} SELECT * FROM items",
    "file_overall": f"WITH {_ITEMS} SELECT path, coalesce(n, 0) AS items, coalesce(x, 0) AS fails, error IS NULL AND coalesce(ok, true) AS passed FROM f LEFT JOIN (SELECT path, count(*) AS n, count(*) FILTER (NOT passed) AS x, bool_and(passed) AS ok FROM items GROUP BY 1) USING (path)",
    "reconcile_full_outer": f"WITH {_CMP} SELECT * FROM cmp",
    "reconcile_summary": f"""WITH {_CMP}, s AS (SELECT path, count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'time') AS time_differs, count(*) FILTER (status = 'sidecar_only') AS sidecar_only, count(*) FILTER (status = 'embedded_only') AS embedded_only FROM cmp GROUP BY 1)
SELECT *, matched > 0 AND time_differs + sidecar_only + embedded_only = 0 AS ok FROM s""",
    "batch_tally": "SELECT count(*) AS files, count(*) FILTER (passed) AS passed, count(error) AS errors FROM file_report",
    "mistakes_export": f"""WITH {_ITEMS} SELECT path, coalesce(error, string_agg(name || ': ' || value, ' | ' ORDER BY ord)) AS issues FROM f LEFT JOIN (SELECT * FROM items WHERE NOT passed) USING (path) GROUP BY path, error HAVING error IS NOT NULL OR count(name) > 0""",
    "full_report": f"""WITH {_ITEMS} SELECT path, name AS "Check", CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END AS "Status", value AS "Value" FROM items JOIN f USING (path) WHERE error IS NULL UNION ALL SELECT path, 'ERROR', 'FAIL', '' FROM f WHERE error IS NOT NULL""",
    "distinct_ordered": "SELECT md5(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
}
