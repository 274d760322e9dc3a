import difflib
import math
import os
import re
import subprocess
import sys
import unicodedata
from collections import defaultdict

import pytest

from lectern.functions.text import PUNCTUATION
from lectern.queries import QUERIES, SQL

from . import oracle

DATA = os.environ.get("LECTERN_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return oracle.tables(DATA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, db, name):
    oracle.check(spark, db, QUERIES[name], SQL[name], DATA)


def comparable(t):
    t = unicodedata.normalize("NFC", t or "").lower()
    return " ".join(re.sub(PUNCTUATION, " ", t).split())


def similarity(a, b):
    def ratio(x, y):
        return 1.0 if not x and not y else 0.0 if not x or not y else difflib.SequenceMatcher(None, x, y).ratio()

    a, b = comparable(a), comparable(b)
    return max(ratio(a, b), ratio(a.split(), b.split()))


@pytest.fixture(scope="module")
def compared(db):
    return db.execute("SELECT comparison_id, path, verse_number, expected_text, transcribed_text, start_s, end_s FROM verse_comparison").df().astype(object).where(lambda x: x.notna(), None).to_dict("records")


def test_similarity_replayed(spark, compared):
    got = {r.comparison_id: r.similarity for r in QUERIES["block_similarity"](spark, DATA).collect()}
    assert got == pytest.approx({r["comparison_id"]: similarity(r["expected_text"], r["transcribed_text"]) for r in compared}, abs=1e-6)


def test_script_verification_replayed(spark, compared):
    want = defaultdict(list)
    for r in compared:
        if r["path"] is not None:
            want[r["path"]].append(similarity(r["expected_text"], r["transcribed_text"]))
    got = {r.path: r for r in QUERIES["script_verification"](spark, DATA).collect()}
    assert set(got) == set(want)
    for path, values in want.items():
        r = got[path]
        good = sum(v >= 0.6 for v in values)
        assert (r.checked, r.matching, r.issues, r.ok) == (len(values), good, len(values) - good, good == len(values)) and r.mean_similarity == pytest.approx(sum(values) / len(values), abs=1e-6)


def heard(compared):
    """Of each path and verse the first comparison: (words with their times, verses)."""
    first = {}
    for r in sorted(compared, key=lambda r: r["comparison_id"]):
        if r["path"] is not None:
            first.setdefault((r["path"], int(r["verse_number"])), r)
    words, verses = defaultdict(list), defaultdict(list)
    for (path, verse), r in sorted(first.items()):
        start = verse * 10.0 if r["start_s"] is None else r["start_s"]
        if r["transcribed_text"] is not None:
            words[path] += [(start + i * 0.4, w) for i, w in enumerate(r["transcribed_text"].split(" "))]
        if r["expected_text"] is not None:
            verses[path].append((verse, r["expected_text"]))
    return words, verses


def placed_by_words(words, verses):
    """Each verse at the best of the next starts, scored by characters found one after the other."""
    out, cursor = [], 0
    for number, text in verses:
        n = len(text.split())
        if not n or cursor >= len(words):
            continue
        best, spot = 0.0, cursor
        for i in range(cursor, min(len(words), cursor + max(3 * n, 20))):
            said = " ".join(w for _, w in words[i : i + 2 * n])
            at, hits = -1, 0
            for c in text:
                at = said.find(c, at + 1)
                if at < 0:
                    break
                hits += 1
            score = 2.0 * hits / (len(text) + len(said)) if text or said else 0.0
            if score > best:
                best, spot = score, i
        out.append((number, words[spot][0], best))
        cursor = spot + 1
    return out


def test_alignment_replayed(spark, compared):
    words, verses = heard(compared)
    want = {(p, v): (t, s) for p in words if p in verses for v, t, s in placed_by_words(words[p], verses[p])}
    got = {(r.path, r.verse): (r.time_s, r.confidence) for r in QUERIES["align_words"](spark, DATA).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_marking_replayed(spark, db, compared):
    words, verses = heard(compared)
    by_words = {p: [(v, t) for v, t, _ in placed_by_words(words[p], verses[p])] for p in words if p in verses}
    files = {r.path: r for r in db.execute("SELECT path, max(sample_offset / sample_rate) + 5.0 AS duration, max(expected_verses) AS verses FROM marker JOIN file_report USING (path) WHERE sample_offset IS NOT NULL AND expected_verses IS NOT NULL GROUP BY 1").df().itertuples()}
    spans, gaps = defaultdict(set), {}
    for r in compared:
        if r["path"] is not None and r["start_s"] is not None and r["end_s"] is not None:
            spans[r["path"]].add((r["start_s"], r["end_s"]))
    for p, s in spans.items():
        s = sorted(s)
        gaps[p] = [(a[1], b[0]) for a, b in zip(s, s[1:]) if b[0] > a[1]]
    log = defaultdict(list)
    for r in db.execute("SELECT path, name, start_seconds, csv_id FROM csv_marker WHERE path IS NOT NULL AND start_seconds IS NOT NULL ORDER BY csv_id").df().itertuples():
        m = re.fullmatch(r"verse\s*(\d+)", (r.name or "").strip().lower())
        if m:
            log[r.path].append((int(m[1]), r.start_seconds, r.start_seconds * 1.01 + 0.2))
    got = defaultdict(list)
    for r in QUERIES["auto_mark"](spark, DATA).orderBy("path", "ord").collect():
        got[r.path].append((r.label, r.time_ms, r.method))
    n = 0
    for p, f in files.items():
        k = int(f.verses)
        usable = [g for g in gaps.get(p, []) if g[1] > 2.5]
        pauses = sorted(sorted(usable, key=lambda g: (-(g[1] - g[0]), g[0]))[: max(k - 1, 0)])
        said = by_words.get(p, [])
        if said and len(said) >= 0.5 * k:
            method, chosen = "words", said
        elif len(pauses) > len(said):
            method, chosen = "combined" if said else "pause", [(i + 2, e) for i, (_, e) in enumerate(pauses)]
        elif said:
            method, chosen = "words", said
        else:
            a, b = min(2.0, 0.05 * f.duration), max(f.duration - 2.0, 0.95 * f.duration)
            method, chosen = "even", [(i + 1, a + i * (b - a) / k) for i in range(k)]
        rows = []
        entries = log.get(p, [])
        if entries:
            mean = sum(c - e for _, e, c in entries) / len(entries)
            speeds = [c / e for _, e, c in entries if e > 0]
            speed = sum(speeds) / len(speeds) if speeds else 1.0
            last = {v: c - e for v, e, c in entries}
        for v, t in chosen:
            new = t
            if entries:
                new = max(t + 0.7 * last[v] + 0.3 * mean if v in last else t * speed + 0.5 * mean, 0.0)
                new = new if abs(new - t) < 5 else t
            rows.append((v, new, method + ("+corrected" if new != t else "")))
        if not rows:
            continue
        rows.append((0, max(min(t for _, t, _ in rows) - 1.0, 0.0), "auto"))
        at = None
        want = []
        for v, ms, m in sorted(((v, math.floor(t * 1000 + 1e-6), m) for v, t, m in rows), key=lambda x: (x[1], x[0])):
            at = ms if at is None else max(ms, at + 100)
            want.append(("Chapter Title" if v == 0 else f"Verse {v}", at, m))
        assert [(x[0], x[2]) for x in sorted(got[p], key=lambda x: (x[1], x[0]))] == [(x[0], x[2]) for x in sorted(want, key=lambda x: (x[1], x[0]))] and all(abs(a[1] - b[1]) <= 1 for a, b in zip(got[p], want))
        n += 1
    assert n == len(got) > 0


def test_script_match_replayed(spark, db, compared):
    words, verses = heard(compared)
    duration = dict(db.execute("SELECT path, max(sample_offset / sample_rate) + 5.0 FROM marker JOIN file_report USING (path) WHERE sample_offset IS NOT NULL AND expected_verses IS NOT NULL GROUP BY 1").fetchall())
    marks = defaultdict(list)
    for path, label, seconds, i in db.execute("SELECT path, label, sample_offset / sample_rate, marker_id FROM marker WHERE path IS NOT NULL AND sample_offset IS NOT NULL").fetchall():
        marks[path].append((seconds, i, label or ""))
    want = {}
    for path, own in marks.items():
        if path not in duration:
            continue
        own.sort()
        asked, values = dict(verses.get(path, [])), []
        for (a, _, label), b in zip(own, [m[0] for m in own[1:]] + [duration[path]]):
            m = re.fullmatch(r"verse\s*(\d+)", label.strip().lower())
            if m and int(m[1]) in asked:
                said = " ".join(w for t, w in words.get(path, []) if a <= (t + (t + 0.4)) / 2 <= b)
                values.append(similarity(asked[int(m[1])], said))
        if values:
            want[path] = (len(values), sum(v >= 0.6 for v in values))
    got = {r.path: r for r in QUERIES["script_match"](spark, DATA).collect()}
    assert set(got) == set(want)
    for path, (n, good) in want.items():
        assert got[path].passed == (n == good) and (n == good or got[path].value == f"{n - good} issues")


def test_every_query_without_sql_is_replayed():
    assert set(QUERIES) - set(SQL) == {"block_similarity", "script_verification", "align_words", "auto_mark", "script_match"}


def test_the_core_does_not_load_the_subpackage_for_training_data():
    code = "import sys, pkgutil, importlib, lectern\nfor m in pkgutil.walk_packages(lectern.__path__, 'lectern.'):\n    if not m.name.startswith('lectern.llm') and not m.name.endswith('__main__'): importlib.import_module(m.name)\nassert not any(m.startswith('lectern.llm.') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if DATA == "/root/testdata/sf0.001":
        assert e.entry(spark).count() > 0
