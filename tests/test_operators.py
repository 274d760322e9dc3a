import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import numeric, text, timecode
from lectern.functions.similarity import greedy_similarity, text_similarity
from lectern.operators import checks, completeness, identity, marking, reconcile, script, series, state

FEW = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def told(numbers):
    out = []
    for n in sorted(set(numbers)):
        if out and out[-1][1] == n - 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return ", ".join(str(a) if a == b else f"{a}-{b}" for a, b in out)


@FEW
@given(st.lists(st.lists(st.integers(-3, 30), max_size=15), min_size=1, max_size=20))
def test_ranges(spark, lists):
    df = spark.createDataFrame(list(enumerate(lists)), "i int, n array<bigint>")
    assert {r.i: r.t for r in df.select("i", completeness.ranges(F.col("n")).alias("t")).collect()} == {i: told(x) for i, x in enumerate(lists)}


def test_completeness_of_groups_with_repeats_nulls_and_without_rows(spark):
    found = spark.createDataFrame([("a", 1), ("a", 1), ("a", 3), ("a", 9), ("b", None), ("d", 2), ("d", 2)], "k string, n int")
    want = spark.createDataFrame([("a", 4), ("b", 2), ("c", 0), ("d", None)], "k string, upto int")
    got = {r.k: r for r in completeness.completeness(found, want, keys=["k"], number="n", upto="upto").collect()}
    assert (got["a"].missing, got["a"].extra, got["a"].repeated, got["a"].found, got["a"].passed) == ([2, 4], [9], [1], 4, False)
    assert got["b"].missing_text == "1-2" and got["c"].passed and not got["d"].passed and got["d"].extra == []
    assert completeness.completeness(found.where("false"), want.where("false"), keys=["k"], number="n", upto="upto").collect() == []


def test_missing_chapters_and_gaps(spark):
    files = spark.createDataFrame([("X", 1), ("X", 3), ("X", 3), ("Y", 1), ("Z", 1), (None, 1), ("X", None)], "book string, chapter int")
    books = spark.createDataFrame([("X", 4), ("Y", 1), ("W", 2)], "book string, total int")
    got = {r.book: r for r in completeness.missing_chapters(files, books, book="book", chapter="chapter", total="total").collect()}
    assert set(got) == {"X", "Y"} and got["X"].missing == [2, 4] and got["X"].repeated == [3] and got["Y"].complete
    gaps = completeness.sequence_gaps(spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 6), (3, 1), (3, 40)], "k int, n int"), keys=["k"], number="n")
    got = {r.k: r.gaps for r in gaps.collect()}
    assert got == {2: [4, 5], 3: list(range(2, 12))}


@FEW
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 50)), min_size=1, max_size=40), st.integers(0, 9))
def test_push_apart(spark, rows, gap):
    df = spark.createDataFrame([(i, k, p) for i, (k, p) in enumerate(rows)], "id int, k int, p long")
    got = {r.id: r.placed for r in series.push_apart(df, keys=["k"], position="p", tie="id", gap=gap).collect()}
    assert got == {r.id: r.placed for r in series.push_apart(df, keys=["k"], position="p", tie="id", gap=gap, hot_rows=4).collect()}
    for key in {k for k, _ in rows}:
        last = None
        for p, i in sorted((p, i) for i, (k, p) in enumerate(rows) if k == key):
            last = p if last is None else max(p, last + gap)
            assert got[i] == last


@FEW
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 30), st.booleans()), min_size=1, max_size=40))
def test_islands_in_stretches(spark, rows):
    df = spark.createDataFrame([(i, k, t, x) for i, (k, t, x) in enumerate(rows)], "id int, k string, t long, x boolean")
    found = [sorted((str(r.k), r.start, r.end, r.n) for r in series.islands(df, keys=["k"], order=[F.col("t"), F.col("id")], inside=F.col("x"), start="t", end="t", hot_rows=hot).collect()) for hot in (None, 4, 1000)]
    want = []
    for key in {k for k, _, _ in rows}:
        run = []
        for t, _, x in [*sorted((t, i, x) for i, (k, t, x) in enumerate(rows) if k == key), (99, 99, False)]:
            if x:
                run.append(t)
            elif run:
                want.append((str(key), run[0], run[-1], len(run)))
                run = []
    assert found[0] == found[1] == found[2] == sorted(want)


@FEW
@given(st.lists(st.floats(0, 50, allow_nan=False).map(lambda x: round(x, 1)), max_size=30))
def test_thin(spark, positions):
    df = spark.createDataFrame([(1, p, i % 7 == 3) for i, p in enumerate(positions)], "k int, p double, m boolean")
    got = series.thin(df, keys=["k"], position="p", gap=5.0, always=F.col("m")).collect()
    last, want = None, []
    for p, m in sorted((p, i % 7 == 3) for i, p in enumerate(positions)):
        if m or last is None or p - last >= 5.0:
            want.append(p)
            last = p
    assert (got[0].drawn if got else []) == want


def test_islands_runs_pauses_and_longest(spark):
    peaks = [0, 0, 5, 0, 0, 0, 5, 5, 0, 0]
    df = spark.createDataFrame([("a", i, i * 0.1, 0.1, float(p)) for i, p in enumerate(peaks)], "k string, b int, t double, w double, peak double")
    run = lambda most, **kw: series.edge_run(df, keys=["k"], order=["b"], peak="peak", threshold=1, width="w", most=most, **kw).first().silence_s
    assert run(0.15) == pytest.approx(0.15) and run(None) == pytest.approx(0.2) == run(None, from_end=True)
    assert series.edge_run(df.withColumn("k", F.lit(None).cast("string")), keys=["k"], order=["b"], peak="peak", threshold=9, width="w").first().silence_s == pytest.approx(1.0)
    got = sorted((round(r.start, 1), round(r.end, 1)) for r in series.pauses(df, keys=["k"], start="t", width="w", peak="peak", threshold=1.0, least=0.2).collect())
    assert got == [(0.0, 0.2), (0.3, 0.6), (0.8, 1.0)]
    p = series.pauses(df, keys=["k"], start="t", width="w", peak="peak", threshold=1.0, least=0.2)
    assert [(r.number, round(r.start, 1)) for r in series.longest(p, keys=["k"], duration="duration", start="start", k=2).orderBy("number").collect()][1] == (2, 0.3)


@FEW
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 300)), max_size=30), st.lists(st.tuples(st.integers(0, 1), st.integers(0, 300), st.integers(0, 150)), max_size=12))
def test_points_in_segments(spark, points, parts):
    p = spark.createDataFrame([(i, k, float(t)) for i, (k, t) in enumerate(points)], "id int, k int, t double")
    s = spark.createDataFrame([(i, k, float(a), float(a + n)) for i, (k, a, n) in enumerate(parts)], "seg int, k int, a double, b double")
    got = sorted((r.id, r.seg) for r in series.points_in_segments(p, s, keys=["k"], at="t", start="a", end="b").collect())
    assert got == sorted((i, j) for i, (k, t) in enumerate(points) for j, (q, a, n) in enumerate(parts) if k == q and a <= t <= a + n)


def test_ticks_and_visible(spark):
    df = spark.createDataFrame([(0.3, 2.1), (5.0, 4.0), (2.0, 2.0)], "a double, b double")
    assert [list(r[0]) for r in df.select(series.ticks(F.col("a"), F.col("b"), F.lit(0.5))).collect()] == [[0.5, 1.0, 1.5, 2.0], [], [2.0]]
    assert series.visible(df, position="a", start=0.3, end=2.0).count() == 2


def test_clips(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0, 0.5, -0.6, 0.0]), (2, [0.0, 0.0]), (3, [])], "i int, x array<double>")
    got = {r.i: (r.h, list(r.f)) for r in df.select("i", series.first_loud(F.col("x"), 0.1).alias("h"), series.fix_edges(F.col("x"), 0.1, 1).alias("f")).collect()}
    assert got == {1: (2, [0.0, 0.5, -0.6, 0.0]), 2: (2, [0.0, 0.0, 0.0, 0.0]), 3: (0, [0.0, 0.0])}
    assert list(df.where("i = 1").select(series.gained(F.col("x"), 3.0).alias("g")).first().g) == [0.0, 0.0, 1.0, -1.0, 0.0]


def test_labels(spark):
    labels = [" chapter TITLE ", "Heading", "heading 02", "Verse 012", "verse3", "VERSE  7", "Verse x", "verse3x", "Vers 3", "", None, "Verse 0"]
    kinds = ["title", "heading", "heading", "verse", "verse", "verse", "malformed", "unknown", "unknown", "unknown", "unknown", "verse"]
    df = spark.createDataFrame(list(enumerate(labels)), "i int, label string")
    got = df.select("i", text.label_kind(F.col("label")).alias("k"), text.verse_number(F.col("label")).alias("n"), text.trailing_number(F.col("label")).alias("t"), text.short_label(F.col("label")).alias("s")).orderBy("i").collect()
    assert [r.k for r in got] == kinds
    assert [r.n for r in got] == [None, None, None, 12, 3, 7, None, None, None, None, None, 0]
    assert [got[i].s for i in (0, 1, 3)] == ["Chapter", "Heading", "012"] and got[3].t == 12


def test_names_and_texts(spark):
    df = spark.createDataFrame([("/a/b/Gen.001.wav", "x" * 70, "१२ और"), ("Gen_001", None, None)], "p string, t string, d string")
    got = df.select(text.basename(F.col("p")).alias("b"), text.stem(F.col("p")).alias("s"), text.preview(F.col("t")).alias("v"), text.ascii_digits(F.col("d")).alias("d"), text.comparable(F.col("t")).alias("c")).collect()
    assert (got[0].b, got[0].s, got[0].v, got[0].d) == ("Gen.001.wav", "Gen.001", "x" * 60 + "...", "12 और") and got[1].c == ""
    said = unicodedata.normalize("NFD", "Él — Dijo:  ¡Hola!") + "।"
    assert spark.createDataFrame([(said,)], "t string").select(text.comparable(F.col("t")).alias("c")).first().c == "él dijo hola"
    meter = "I: -70.0 LUFS\nI: -18.2 LUFS Peak: -3.0 dBFS\nPeak: -1.5 dBFS"
    a, b = text.loudness_summary(F.col("t"))
    assert tuple(spark.createDataFrame([(meter,)], "t string").select(a, b).first()) == (-18.2, -1.5)
    assert [r[0] for r in spark.createDataFrame([("2.00s",), ("n/a",), (None,), ("7d",)], "t string").select(text.measured(F.col("t"))).collect()] == [2.0, 0.0, 0.0, 0.0]
    assert spark.createDataFrame([("Chapter 3\nx\n अध्याय 4 \ny",)], "t string").select(text.without_chapter_headings(F.col("t")).alias("t")).first().t.split() == ["x", "y"]


def test_times(spark):
    cases = {"0:01.000": 1.0, "0:38.250": 38.25, "1:34.75": 94.75, "1:02:05.5": 3725.5, "12:05.50049": 725.5, "3.5": 3.5, "1:30": 0.0, "x": 0.0, "": 0.0, None: 0.0, "7d": 0.0}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select(timecode.parse_time(F.col("t")).alias("s"))
    assert [r.s for r in df.collect()] == pytest.approx(list(cases.values()))
    shown = spark.createDataFrame([(59.9996,), (725.5,), (0.0,), (None,)], "s double").select(timecode.format_time(F.col("s")).alias("t"), timecode.format_centiseconds(F.col("s")).alias("c"), timecode.minutes_seconds(F.col("s")).alias("m")).collect()
    assert [r.t for r in shown][:3] == ["1:00.000", "12:05.500", "0:00.000"] and shown[1].c == "12:05.50" and shown[1].m == "12:05"
    assert [r[0] for r in spark.createDataFrame([(1.0,), (45.0,), (9000.0,)], "s double").select(timecode.tick_interval(F.col("s"))).collect()] == [0.1, 5.0, 600.0]


@FEW
@given(st.lists(st.tuples(st.text("abcü ", max_size=12), st.text("abcü ", max_size=12)), min_size=1, max_size=25))
def test_similarities(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    for r in df.select("i", greedy_similarity(F.col("a"), F.col("b")).alias("g")).collect():
        a, b = pairs[r.i]
        at = m = 0
        for c in a:
            found = b.find(c, at)
            if found < 0:
                break
            at, m = found + 1, m + 1
        assert r.g == pytest.approx(2 * m / (len(a) + len(b)) if a or b else 0.0)


def test_text_similarity_of_nulls_and_equals(spark):
    df = spark.createDataFrame([("A b.", "a  B"), (None, ""), ("x", None), ("one two", "two one")], "a string, b string")
    got = [r.s for r in df.select(text_similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got[:3] == [1.0, 1.0, 0.0] and 0.4 < got[3] < 1


def test_reconcile(spark):
    embedded = spark.createDataFrame([("p", 1, "Verse 1", 1.0), ("p", 2, " verse 1", 5.0), ("p", 3, "Verse 2", 9.0), ("p", 4, None, 3.0), ("p", 5, "Only", 1.0), ("q", 6, "a", None)], "path string, id long, label string, seconds double")
    sidecar = spark.createDataFrame([(1, "p", "VERSE 1", 5.4), (2, "p", "Verse 1 ", 1.0), (3, "p", "verse 2", None), (4, "p", "More", 2.0), (5, "q", "a", 1.0), (6, "p", " ", 1.0)], "csv_id long, path string, name string, start double")
    got = reconcile.compare_markers(embedded, sidecar, path="path", name="name", label="label", seconds="seconds", start="start", order="id", sidecar_order="csv_id")
    assert sorted((r.path, r.name, r.status, r.row or 0) for r in got.collect()) == [("p", "more", "sidecar_only", 4), ("p", "only", "embedded_only", 0), ("p", "verse 1", "matched", 1), ("p", "verse 1", "time", 2), ("p", "verse 2", "time", 3), ("q", "a", "time", 5)]
    assert {r.path: r.ok for r in reconcile.comparison_summary(got).collect()} == {"p": False, "q": False}


def test_verses(spark):
    raw = "Title\n1. one\ngoes on\n\n2) two\n१२ twelve\n2 last\n3\n"
    df = spark.createDataFrame([(1, raw), (2, None), (3, ""), (4, "no numbers")], "id int, raw string")
    assert sorted((r.id, r.verse, r.text) for r in script.verses(df, key="id", text="raw").collect()) == [(1, 1, "one goes on"), (1, 2, "last"), (1, 12, "twelve")]


def test_words_and_verification(spark):
    words = spark.createDataFrame([("p", 0, 0.0, 1.0, "a"), ("p", 1, 1.0, 3.0, "b"), ("p", 2, 3.0, 4.0, "c")], "path string, pos int, start double, end double, word string")
    parts = spark.createDataFrame([("p", 1, 0.0, 2.0), ("p", 2, 2.0, 9.0)], "path string, verse int, start_s double, end_s double")
    got = {r.verse: r.transcript for r in script.words_of_segments(words, parts, keys=["path"]).collect()}
    assert got == {1: "a b", 2: "b c"}
    pairs = spark.createDataFrame([("p", 1, "a b", "a b"), ("p", 2, "x y z", "q")], "path string, verse int, e string, t string")
    r = script.verification_summary(script.compare_texts(pairs, expected="e", transcribed="t"), keys=["path"], verse="verse", expected="e").first()
    assert (r.checked, r.matching, r.ok, r.issues[0].verse) == (2, 1, False, 2)


def test_identity(spark):
    files = spark.createDataFrame([("Gen_001.wav",), ("1Sam 5.WAV",), ("Xyz_009",), ("Gen_099.wav",), ("noise",), (None,)], "filename string")
    aliases = spark.createDataFrame([("gen", "Genesis"), ("1 sam", "1 Samuel")], "alias string, book string")
    chapters = spark.createDataFrame([("Genesis", 1, 31), ("1 Samuel", 5, 12)], "book string, chapter int, verses int")
    got = {r.filename: (r.canonical_book, r.chapter_no, r.verses) for r in identity.identify(files, aliases, chapters).collect()}
    assert got["Gen_001.wav"] == ("Genesis", 1, 31) and got["1Sam 5.WAV"] == ("1 Samuel", 5, 12)
    assert all(got[f] == (None, None, None) for f in ("Xyz_009", "Gen_099.wav", "noise", None))


def test_items_and_overall(spark):
    s = checks.Settings()
    df = spark.createDataFrame([("a", 48000, 24, -18.5, -1.0, 2.5, 1.4), ("b", 44100, 24, None, None, None, 2.0)], "path string, sample_rate int, bits int, lufs double, true_peak double, head_silence double, tail_silence double")
    items = checks.measurement_items(df, s, key="path")
    assert {(r.path, r.name) for r in items.where("NOT passed").collect()} == {("a", "Tail Silence"), ("b", "Format"), ("b", "Loudness"), ("b", "True Peak"), ("b", "Head Silence")}
    none = checks.Settings(enable_format=False, enable_loudness=False, enable_true_peak=False, enable_head_silence=False, enable_tail_silence=False)
    assert checks.measurement_items(df, none, key="path").count() == 0
    files = spark.createDataFrame([("a", None), ("b", None), ("c", "broken"), ("d", None)], "path string, error string")
    assert {r.path: r.passed for r in checks.overall(files, items, key="path", error="error").collect()} == {"a": False, "b": False, "c": False, "d": True}
    only = checks.Settings(enable_markers=False)
    empty = spark.createDataFrame([], "path string, label string, seconds double")
    known = files.withColumn("expected_verses", F.lit(3))
    assert checks.marker_items(known, empty, only, key="path").count() == 0
    assert {r.name for r in checks.marker_items(known, empty, s, key="path").collect()} == {"Markers"}


def test_marking(spark):
    words = [f"w{i}" for i in range(40)]
    placed = marking.align(words, [(1, "w2 w3 w4"), (2, ""), (3, "w10 w11")])
    assert [(v, at) for v, at, _ in placed] == [(1, 0), (3, 8)]  # the first start whose words hold the verse
    assert marking.align(["a"], [(1, "zzz"), (2, "b")]) == [(1, 0, 0.0)]
    files = spark.createDataFrame([("p", 4, 60.0, 100), ("q", 2, 10.0, 100)], "path string, verses int, duration double, rate int")
    pauses = spark.createDataFrame([("p", 0.0, 2.0, 2.0), ("p", 10.0, 11.0, 1.0), ("p", 20.0, 20.5, 0.5), ("p", 30.0, 30.9, 0.9), ("p", 40.0, 40.4, 0.4)], "path string, start double, end double, duration double")
    got = marking.place_by_pauses(pauses, files, key="path", verses="verses").orderBy("verse").collect()
    assert [(r.verse, r.time_s) for r in got] == [(2, 11.0), (3, 20.5), (4, 30.9)]
    said = spark.createDataFrame([], "path string, verse long, text string")
    made = marking.auto_mark(files, said, key="path", verses="verses", duration="duration", rate="rate", pauses=pauses).orderBy("path", "ord").collect()
    assert [r.label for r in made if r.path == "p"] == ["Chapter Title", "Verse 2", "Verse 3", "Verse 4"] and {r.method for r in made if r.path == "q"} == {"auto", "even"}
    assert [r.sample_offset for r in made if r.path == "p"] == [1000, 1100, 2050, 3090]
    few = pauses.where("start < 20")  # one pause for four verses is still better than even steps
    assert {r.method for r in marking.auto_mark(files, said, key="path", verses="verses", duration="duration", rate="rate", pauses=few).where("path = 'p'").collect()} == {"auto", "pause"}


def test_choice_of_placements(spark):
    def chosen(words, pauses, verses=4):
        rows = [("p", "words", i) for i in range(words)] + [("p", "pause", i) for i in range(pauses)] + [("p", "even", i) for i in range(verses)]
        found = spark.createDataFrame(rows, "path string, method string, verse int")
        files = spark.createDataFrame([("p", verses)], "path string, verses int")
        got = [r.method for r in marking.choose(found, files, key="path", verses="verses").collect()]
        return got[0], len(got)

    assert chosen(2, 3) == ("words", 2) and chosen(1, 3) == ("combined", 3) and chosen(1, 1) == ("words", 1) and chosen(0, 1) == ("pause", 1) and chosen(0, 0) == ("even", 4)


def test_corrections_shift_markers(spark):
    files = spark.createDataFrame([("p", 2, 60.0, 100, "en"), ("q", 2, 60.0, 100, "xx")], "path string, verses int, duration double, rate int, profile string")
    log = spark.createDataFrame([("en", 1, 10.0, 11.0, 1), ("en", 1, 10.0, 11.0, 2)], "profile string, verse long, expected double, corrected double, seq int")
    plain, moved = (marking.auto_mark(files, None, key="path", verses="verses", duration="duration", rate="rate", corrections=c, profile=["profile"]).collect() for c in (None, log))
    at = lambda rows: {(r.path, r.label): (round(r.time_s, 2), r.method) for r in rows}
    before, after = at(plain), at(moved)
    assert after["p", "Verse 1"][1] == "even+corrected" and after["p", "Verse 1"][0] == pytest.approx(before["p", "Verse 1"][0] + 1.0)
    assert after["q", "Verse 1"] == before["q", "Verse 1"]
    far = log.withColumn("corrected", F.lit(40.0))  # a shift of 5 seconds or more isn't believed
    assert at(marking.auto_mark(files, None, key="path", verses="verses", duration="duration", rate="rate", corrections=far, profile=["profile"]).collect())["p", "Verse 1"] == before["p", "Verse 1"]


def test_word_timeline_and_observed_pauses(spark):
    kind = "path string, start double, end double, text string, words array<struct<start:double,end:double,word:string>>"
    heard = spark.createDataFrame([("a", 0.0, 2.0, "x y", [(0.0, 1.0, " x"), (None, None, "y ")]), ("a", 2.0, 3.0, "z", None), ("b", 5.0, 6.0, "whole", [])], kind)
    got = [(r.path, r.pos, r.start, r.end, r.word) for r in marking.timeline(heard, key="path").orderBy("path", "pos").collect()]
    assert got == [("a", 1, 0.0, 1.0, "x"), ("a", 2, 0.0, 2.0, "y"), ("b", 1, 5.0, 6.0, "whole")]
    gaps = spark.createDataFrame([(0.05,), (0.1,), (5.0,), (5.1,), (None,)], "duration double")
    assert sorted(r.duration for r in marking.observed(gaps).collect()) == [0.1, 5.0]


def test_verification_from_words(spark):
    markers = spark.createDataFrame([("p", 1, "Verse 1", 1.0), ("p", 2, "Heading", 3.0), ("p", 3, "Verse 2", 4.0), ("p", 4, "Verse 9", 8.0)], "path string, cue_id long, label string, seconds double")
    words = spark.createDataFrame([("p", 1, 1.1, 1.5, "in"), ("p", 2, 1.6, 2.0, "the"), ("p", 3, 2.1, 2.9, "beginning"), ("p", 4, 3.1, 3.5, "noise"), ("p", 5, 4.2, 5.0, "nothing")], "path string, pos long, start double, end double, word string")
    asked = spark.createDataFrame([("p", 1, "In the beginning."), ("p", 2, "And the earth was void")], "path string, verse int, text string")
    files = spark.createDataFrame([("p", 10.0)], "path string, seconds double")
    compared = script.verify(markers, words, asked, files)
    got = {r.verse: (r.transcribed, r.matches) for r in compared.collect()}
    assert got == {1: ("in the beginning", True), 2: ("nothing", False)}
    item = checks.script_items(compared).first()
    assert (item.name, item.passed, item.value) == ("Script Match", False, "1 issues") and item.detail.startswith("verse 2 (")


def test_details_are_bounded(spark):
    files = spark.createDataFrame([("p", 2)], "path string, expected_verses int")
    rows = spark.createDataFrame([("p", f"Vers {i}", float(i), i) for i in range(500)] + [("p", "Verse 1", 1.0, 900), ("p", "Verse 1", 2.0, 901), ("p", "Chapter Title", 0.0, 902)], "path string, label string, seconds double, cue_id int")
    got = {r.name: r for r in checks.marker_items(files, rows, checks.Settings(), key="path").collect()}
    assert got["Marker Spelling"].value == "500 bad" and got["Marker Spelling"].detail.count("@") == 20 and got["Marker Spelling"].detail.endswith("(+480 more)")
    assert got["Chapter Title"].passed and got["Verses"].detail == "missing: 2; repeated: 1"
    pairs = spark.createDataFrame([("p", f"n{i:02d}", "time", i) for i in range(4)] + [("p", f"s{i}", "sidecar_only", i) for i in range(7)] + [("p", "e", "embedded_only", None)], "path string, name string, status string, row long")
    assert checks.sidecar_items(pairs).first().detail == "times differ: n00, n01, n02 (+1 more) | in sidecar only: s0, s1, s2, s3, s4 (+2 more) | in recording only: e"
    items = spark.createDataFrame([("p", "Markers", True), ("p", "Marker Spelling", False), ("p", "Format", True)], "path string, name string, passed boolean")
    r = checks.pivoted(items, key="path", names=["Format", "Markers", "Marker Spelling"], combine=checks.MARKER_COLUMN).first()
    assert (r.Format, r.Markers) == ("PASS", "FAIL")


def test_script_marks_and_headings(spark):
    df = spark.createDataFrame([(1, "1 one\nChapter 2\n3.) three\nअध्याय ५\n4:} four")], "id int, raw string")
    assert sorted((r.verse, r.text) for r in script.verses(df, key="id", text="raw").collect()) == [(1, "one"), (3, "three"), (4, "four")]
    assert sorted((r.verse, r.text) for r in script.verses(df, key="id", text="raw", keep_headings=True).collect()) == [(1, "one Chapter 2"), (3, "three अध्याय ५"), (4, "four")]
    found = script.verses(df, key="id", text="raw")
    assert script.sequence_warnings(found) == ["verses missing: 2"] and script.sequence_warnings(found.where("verse > 3")) == ["verses begin at 4"]


def test_format_is_told_short(spark):
    df = spark.createDataFrame([("a", 48000, 24), ("b", 44100, 16), ("c", 11025, 8)], "path string, sample_rate int, bits int")
    df = df.withColumns({c: F.lit(None).cast("double") for c in ("lufs", "true_peak", "head_silence", "tail_silence")})
    got = {r.path: r.value for r in checks.measurement_items(df, checks.Settings(), key="path").where("name = 'Format'").collect()}
    assert got == {"a": "48k/24-bit", "b": "44.1k/16-bit", "c": "11.025k/8-bit"}
    assert checks.measurement_items(df, checks.Settings(check_format=False), key="path").where("name = 'Format'").count() == 0


def test_state(spark):
    log = spark.createDataFrame([("k", 1, 10.0, 11.0, 1), ("k", 1, 10.0, 12.0, 2), ("k", 2, 0.0, 1.0, 3)], "k string, verse int, e double, c double, seq int")
    p = state.profiles(log, keys=["k"], expected="e", corrected="c").first()
    assert (p.corrections, p.mean_offset, round(p.mean_speed, 6)) == (3, pytest.approx(4 / 3), 1.15)
    times = spark.createDataFrame([("k", 1, 20.0), ("k", 9, 20.0), ("x", 1, 20.0)], "k string, verse int, t double")
    got = {(r.k, r.verse): r.adjusted for r in state.adjust(times, log, keys=["k"], verse="verse", time="t", expected="e", corrected="c", order="seq").collect()}
    assert got[("k", 1)] == pytest.approx(20 + 0.7 * 2 + 0.3 * 4 / 3) and got[("k", 9)] == pytest.approx(20 * 1.15 + 0.5 * 4 / 3) and got[("x", 1)] == 20.0
    e = state.exponential_mean(log, keys=["k"], value="c", order="seq").first().mean
    assert e == pytest.approx(0.7 * (0.7 * (0.7 * 0.5 + 0.3 * 11) + 0.3 * 12) + 0.3 * 1)
    assert state.cleared(log, F.col("k") == "k").count() == 0


def test_numbers(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (0.1,)], "x double")
    assert [round(r[0], 3) for r in df.select(numeric.to_db(F.col("x"))).collect()] == [0.0, -120.0, -20.0]
    assert [r[0] for r in df.select(numeric.clamp(F.col("x"), 0.05, 0.5)).collect()] == [0.5, 0.05, 0.1]
