import random
import re

import pyarrow as pa

from lectern.operators.rejects import FIELDS, parse_batch, parse_marker_records, split_valid


def plain(line):
    """Reads a record field by field: (fields, broken quoting, values)."""
    if line is None:
        return 0, False, None
    line = line[:-1] if line.endswith("\r") else line
    found, at = [], 0
    while True:
        if line[at : at + 1] == '"':
            m = re.compile(r'"((?:[^"]|"")*)"(?=\t|\Z)', re.S).match(line, at)
            if not m:
                return None, True, None
            found.append(m[1].replace('""', '"'))
            at = m.end()
        else:
            end = line.find("\t", at)
            end = len(line) if end < 0 else end
            found.append(line[at:end])
            at = end
        if at >= len(line):
            return len(found), False, found
        at += 1


def test_structure_equals_reading_field_by_field():
    random.seed(7)
    for turn in range(60):
        lines = [None if random.random() < 0.05 else "".join(random.choice('""\t\tab\r\n é') for _ in range(random.randint(0, 30))) for _ in range(150)]
        lines += ["\t".join(random.choice(["", 'a"b', '"a"', '""', '"a""b"', '"a\tb"', "x", '"""q"', '"x"y']) for _ in range(6)) for _ in range(100)]
        array = pa.array(lines)
        if turn % 2:
            array, lines = array.slice(7), lines[7:]
        for line, got in zip(lines, parse_batch(array).to_pylist()):
            n, bad, values = plain(line)
            assert got["bad_quoting"] == bad, line
            if not bad:
                assert got["n_fields"] == n, line
                if n == 6:
                    assert [got[f] for f in FIELDS] == values


def test_long_and_empty_batches():
    long = "x" * 1_000_000 + '"' * 1001 + "\t" * 50_000
    assert parse_batch(pa.array([long])).to_pylist()[0]["n_fields"] == 50_001
    assert parse_batch(pa.array([], pa.string())).to_pylist() == []
    assert parse_batch(pa.array([None, ""], pa.string())).to_pylist()[1]["n_fields"] == 1


CASES = {
    "a\t0:01.5\t0\tdecimal\tCue\t": None, '"a\tb"\t1:00:01.25\t0\t DECIMAL \tCue\t"x ""y"""\r': None, "a\t12\t0\tSamples\tCue\t": None, "a\t00:01:02:15\t0\t30 fps\tCue\t": None, "a\t3.125\t0\tdecimal\tCue\t5\" reel": None,
    '"a\t0:01.5\t0\tdecimal\tCue\t': "quoting", '"a"b\t0:01.5\t0\tdecimal\tCue\t': "quoting", "a\t0:01.5\t0\tdecimal\tCue": "columns", "a\t0:01.5\t0\tdecimal\tCue\t\t": "columns", "": "columns", None: "columns",
    "a\t0:01.5\t0\tbeats\tCue\t": "time_format", "a\tx\t0\t\tCue\t": "time_format", "a\t0:61.5\t0\tdecimal\tCue\t": "start", "a\t1:60:01.5\t0\tdecimal\tCue\t": "start", "a\t0:01.5000\t0\tdecimal\tCue\t": "start", "a\t1.5\t0\tsamples\tCue\t": "start",
    "a\t00:00:00:30\t0\t30 fps\tCue\t": "start", "a\t\t0\tdecimal\tCue\t": "start",
}


def test_reasons_and_values(spark):
    rows = [(i, k, "mine") for i, k in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id long, line string, reason string")
    got = {r.id: r for r in parse_marker_records(df).collect()}
    assert {i: got[i].parsed_reason for i in got} == dict(enumerate(CASES.values()))
    assert all(r.reason == "mine" for r in got.values())
    assert [got[i].start_seconds for i in range(5)] == [1.5, 3601.25, None, 62.5, 3.125]
    assert got[2].start_samples == 12 and got[1].name == "a\tb" and got[1].description == 'x "y"'
    valid, rejected = split_valid(df)
    assert valid.count() + rejected.count() == len(CASES) and valid.count() == 5


def test_empty_table(spark):
    assert parse_marker_records(spark.createDataFrame([], "line string, other int")).collect() == []
