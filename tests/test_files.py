import io
import json
import struct

import numpy as np
import pytest

from lectern.functions import dsp
from lectern.operators import series
from lectern.operators.checks import Settings
from lectern.plans import report
from lectern.plans.check import check_recordings, verse_segments
from lectern.sources import files as F
from lectern.sources import wav, wavcodec

NAMES = ["Chapter Title", "Heading"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("recordings")
    full = NAMES + [f"Verse {i}" for i in range(1, 32)]
    (out / "good").mkdir()
    (out / "good" / "Gen_001.wav").write_bytes(wavcodec.synthetic(full))
    (out / "Gen_001.wav").write_bytes(wavcodec.synthetic([x for x in full if x not in {f"Verse {i}" for i in (5, 17, 18, 19)}]))
    (out / "Jon_001.WAV").write_bytes(wavcodec.synthetic(NAMES + [f"Verse {i}" for i in range(1, 17)] + ["Vers 17"], tail_s=0.4))
    (out / "Oba_001.wav").write_bytes(wavcodec.synthetic([]))
    (out / "bad.wav").write_bytes(b"nothing of the kind")
    return out


def test_round_trip_of_all_depths():
    t = np.arange(801) / 8000
    x = np.vstack([0.5 * np.sin(400 * t), -0.25 * np.cos(300 * t)])
    for bits in (8, 16, 24, 32):
        raw = wavcodec.write(wavcodec.from_float(x, bits), channels=2, sample_rate=8000, bits=bits, cues=[(5, "a"), (5, "é")])
        h, cues = wavcodec.parse(raw)
        assert (h.channels, h.bits, h.n_frames) == (2, bits, 801) and [c.label for c in cues] == ["a", "é"]
        y = wavcodec.to_float(wavcodec.read_frames(io.BytesIO(raw), h), h)
        assert np.abs(x - y).max() < 2.5 / (1 << (bits - 1)) + 1e-6
        assert len(wavcodec.read_frames(io.BytesIO(raw), h, 800, 99)) == h.sampwidth * 2


def test_odd_containers():
    raw = bytearray(wavcodec.synthetic(["Verse 1"], rate=8000, bits=16))
    at = raw.index(b"data")
    raw[at + 4 : at + 8] = struct.pack("<I", len(raw))  # a size beyond the end hides the markers, which are found again
    h, cues = wavcodec.parse(bytes(raw))
    assert h.data_size == len(raw) - at - 8
    raw = bytearray(wavcodec.synthetic(["Verse 1"], rate=8000, bits=16))
    raw[at + 4 : at + 8] = struct.pack("<I", 1000)
    assert [c.label for c in wavcodec.parse(bytes(raw))[1]] == ["Verse 1"]
    for broken in (b"", b"RIFF", b"RIFF\0\0\0\0WAVE"):
        with pytest.raises(wavcodec.WavError):
            wavcodec.parse(broken)
    cue = struct.pack("<I", 3) + b"".join(struct.pack("<II4sIII", i, p, b"data", 0, 0, o) for i, p, o in ((1, 7, 0), (2, 0, 9), (1, 0, 30)))
    adtl = b"".join(t + struct.pack("<I", len(b)) + b + b"\0" * (len(b) & 1) for t, b in ((b"note", struct.pack("<I", 1) + b"n\0"), (b"labl", struct.pack("<I", 2) + b"caf\xe9\0"), (b"ltxt", struct.pack("<II4s8x", 1, 50, b"rgn ") + b"t\0")))
    found = wavcodec.read_cues(wavcodec.Header(chunks={"cue ": cue[:-5] + cue[-5:], "LIST:adtl": adtl}))
    assert [(c.cue_id, c.sample_offset, c.label, c.length_samples) for c in found] == [(2, 9, "café", 0), (1, 30, "n", 50)]


def test_source_views(spark, folder):
    rows = {r.path.rsplit("/", 2)[-1] + str(r.error is None): r for r in wav.read(spark, [str(folder)]).collect()}
    assert len(rows) == 5 or len(wav.list_files([str(folder)])) == 5
    assert rows["bad.wavFalse"].n_frames is None and "RIFF" in rows["bad.wavFalse"].error
    marks = wav.read(spark, [str(folder)], "markers")
    assert marks.groupBy("path").count().count() == 3
    silent = {r.path.split("/")[-1]: r for r in wav.silence(wav.read(spark, [str(folder)], "peaks")).collect()}
    assert silent["Jon_001.WAV"].tail_silence == pytest.approx(0.4, abs=0.02) and silent["Jon_001.WAV"].head_silence == pytest.approx(2.0, abs=0.02)
    blocks = wav.read(spark, [str(folder / "Oba_001.wav")], "pcm", blockframes=50_000).orderBy("block").collect()
    assert sum(len(b.pcm) for b in blocks) == 4 * 48000 * 3
    shape = wav.read(spark, [str(folder / "good")], "envelope", columns=100, blockframes=10_000).orderBy("bucket").collect()
    assert [r.bucket for r in shape] == list(range(100)) and max(r.high for r in shape) == pytest.approx(0.5, abs=0.01) and shape[0].high == 0.0
    quiet = series.pauses(wav.read(spark, [str(folder / "good")], "peaks", whole=True), keys=["path"], start="t0", width="dur_s", peak="peak").orderBy("start").collect()
    assert [round(r.duration, 1) for r in quiet] == [2.0, 2.0]
    parts = verse_segments(marks, wav.read(spark, [str(folder)]))
    assert parts.where("end_s <= start_s").count() == 0


def test_checking_a_folder(spark, folder):
    aliases = spark.createDataFrame([("gen", "Genesis"), ("jon", "Jonah"), ("oba", "Obadiah")], "alias string, book string")
    chapters = spark.createDataFrame([("Genesis", 1, 31), ("Jonah", 1, 17), ("Obadiah", 1, 21)], "book string, chapter int, verses int")
    files, items = check_recordings(spark, [str(folder)], Settings(target_lufs=-9.2, lufs_tolerance=3.0), aliases=aliases, chapters=chapters)
    failed = {}
    for r in items.where("NOT passed").collect():
        failed.setdefault(r.path[len(str(folder)) + 1 :], {})[r.name] = r.detail
    assert "good/Gen_001.wav" not in failed
    assert set(failed["Gen_001.wav"]) == {"Verses"} and "5, 17-19" in failed["Gen_001.wav"]["Verses"]
    assert {"Marker Spelling", "Verses", "Tail Silence"} <= set(failed["Jon_001.WAV"]) and "Markers" in failed["Oba_001.wav"]
    passed = {r.path[len(str(folder)) + 1 :]: r.passed for r in files.collect()}
    assert passed["good/Gen_001.wav"] and not passed["bad.wav"] and len(passed) == 5
    told = [json.loads(r.value) for r in report.json_lines(files, items, key="path").collect()]
    assert len(told) == 5 and any(c["name"] == "Verses" and c["status"] == "FAIL" for t in told for c in t["checks"])
    assert report.mistakes(files, items, key="path").count() == 4
    assert report.full(files, items, key="path").where("Check = 'ERROR'").count() == 1


def test_writing_markers(spark, tmp_path):
    path = tmp_path / "Oba_001.wav"
    path.write_bytes(wavcodec.synthetic([], rate=8000, bits=16))
    placed = spark.createDataFrame([(str(path), 100, "Verse 1"), (str(path), 50, "Chapter Title"), (str(tmp_path / "none.wav"), 1, "x")], "path string, sample_offset long, label string")
    done = {r.path: r for r in wav.write_marked(placed).collect()}
    assert done[str(path)].markers == 2 and done[str(tmp_path / "none.wav")].error
    assert [c.label for c in wavcodec.parse(open(done[str(path)].output, "rb").read())[1]] == ["Chapter Title", "Verse 1"]


def test_sidecars_scripts_settings_and_state(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Name\tStart\tDuration\tTime Format\tType\tDescription\nVerse 2\t0:05.500\t0:00.000\tdecimal\tCue\t\nVerse 1\t0:01.000\t0:00.000\tdecimal\tCue\tx\n\t0:01.0\t\t\t\t\n", encoding="utf-8")
    rows = F.read_markers(spark, [str(tmp_path / "a.csv")]).orderBy("ord").collect()
    assert [(r.name, r.start_seconds) for r in rows] == [("Verse 1", 1.0), ("Verse 2", 5.5)]
    said = F.marker_lines(F.read_markers(spark, [str(tmp_path / "a.csv")])).first().content
    assert said.startswith("﻿Name\t") and "Verse 1\t0:01.000\t0:00.000\tdecimal\tCue\tx\n" in said
    names = spark.createDataFrame([("x/a.wav",), ("x/b.wav",)], "path string")
    listed = spark.createDataFrame([("x/a.CSV",), ("x/a.csv",), ("x/c.csv",)], "path string")
    assert {r.path: r.sidecar for r in F.find_sidecars(names, listed).collect()} == {"x/a.wav": "x/a.csv", "x/b.wav": None}
    (tmp_path / "s.txt").write_text("1 one\n2 two")
    assert F.read_scripts(spark, [str(tmp_path / "s.txt")]).first().raw_text == "1 one\n2 two"
    F.save_settings(Settings(target_lufs=-20.0), str(tmp_path / "c.json"))
    assert F.load_settings(str(tmp_path / "c.json")).target_lufs == -20.0
    (tmp_path / "c.json").write_text("{broken")
    assert F.load_settings(str(tmp_path / "c.json")) == Settings() == F.load_settings(str(tmp_path / "none.json"))
    (tmp_path / "m.json").write_text(json.dumps({"version": 1, "profiles": {"en:x": {"average_pause_duration": 0.4, "corrections": [{"language": "en", "verse_number": 3, "expected_time": 1.0, "corrected_time": 1.5}]}}}))
    (tmp_path / "n.json").write_text("no json")
    got = F.read_state(spark, [str(tmp_path / "m.json"), str(tmp_path / "n.json")]).collect()
    assert len(got) == 1 and got[0].verse_number == 3
    out = spark.createDataFrame([("d/Gen_001.wav",)], "p string").selectExpr(f"{F.output_name('p', 'marked')} a", f"{F.output_name('p', 'mastered')} b").first()
    assert (out.a, out.b) == ("d/Gen_001_marked.wav", "d/Gen_Mastered/Gen_001.wav")


def test_signals():
    rate = 48000
    t = np.arange(rate * 5) / rate
    tone = np.sin(2 * np.pi * 997 * t)[None]
    assert dsp.integrated_loudness(tone, rate) == pytest.approx(-3.01, abs=0.02)
    assert dsp.integrated_loudness(np.zeros((1, rate)), rate) is None and dsp.integrated_loudness(np.zeros((1, 10)), rate) is None
    quarter = np.sin(2 * np.pi * rate / 4 * t + np.pi / 4)[None]
    assert dsp.sample_peak(quarter) == pytest.approx(-3.01, abs=0.05) and dsp.true_peak(quarter[:, :4800]) == pytest.approx(0.0, abs=0.2)
    y = dsp.master(np.r_[np.zeros(rate // 2), 0.05 * tone[0], np.zeros(rate // 3)][None], rate)
    assert dsp.integrated_loudness(y[None], rate) == pytest.approx(-18.0, abs=0.5) and dsp.true_peak(y[None]) <= -1.0
    assert dsp.edges(y)[0] == pytest.approx(2 * rate, abs=rate * 0.02)
    assert len(dsp.fix_silence(np.zeros(100), 100, 1.0)) == 300 and len(dsp.resample(tone[0], 48000, 44100)) == 5 * 44100


def test_meter_in_blocks_equals_the_whole():
    rng = np.random.default_rng(3)
    for rate, channels in ((48000, 2), (11025, 1), (8000, 5)):
        x = 0.2 * rng.standard_normal((channels, rate * 3 + 7))
        x[0, :5] = 1.3
        whole = dsp.Meter(rate, channels)
        whole.feed(x)
        for block in (97, 4000, rate):
            parts = dsp.Meter(rate, channels)
            for at in range(0, x.shape[1], block if block > 97 else 977):
                parts.feed(x[:, at : at + (block if block > 97 else 977)])
            assert parts.loudness() == pytest.approx(whole.loudness(), abs=1e-6) and parts.sample_peak() == whole.sample_peak()
            assert parts.true_peak() == pytest.approx(dsp.true_peak(x), abs=0.02)
    assert dsp.Meter(8000, 1).loudness() is None


def test_odd_headers_are_errors_not_crashes(spark, tmp_path):
    good = bytearray(wavcodec.synthetic(["Verse 1"], rate=8000, bits=16))
    zero, odd = bytearray(good), bytearray(good)
    zero[24:28] = struct.pack("<I", 0)
    odd[34:36] = struct.pack("<H", 48)
    for name, raw in (("zero.wav", zero), ("odd.wav", odd), ("good.wav", good)):
        (tmp_path / name).write_bytes(bytes(raw))
    for view in ("header", "markers", "peaks", "envelope", "pcm"):
        assert {r.path.rsplit("/", 1)[1] for r in wav.read(spark, [str(tmp_path)], view).select("path").distinct().collect()} >= {"good.wav"}
    told = {r.filename: r.error for r in wav.read(spark, [str(tmp_path)]).collect()}
    assert "rate" in told["zero.wav"] and "48 bits" in told["odd.wav"] and told["good.wav"] is None
    late = bytearray(wavcodec.synthetic(["Verse 1", "Verse 2"], rate=8000, bits=16))
    at = late.index(b"data")
    late[at + 4 : at + 8] = struct.pack("<I", 1000)
    late[at + 8 + 2001 : at + 8 + 2019] = b"cue cue \xff\xff\xff\x7fLISTxx"  # false beginnings before the markers
    assert [c.label for c in wavcodec.parse(bytes(late))[1]] == ["Verse 1", "Verse 2"]


def test_relative_paths(spark, folder, monkeypatch):
    monkeypatch.chdir(folder.parent)
    files, items = check_recordings(spark, [folder.name + "/good"], Settings(target_lufs=-9.2, lufs_tolerance=3.0))
    assert {r.name: r.passed for r in items.where("name IN ('Loudness', 'True Peak')").collect()} == {"Loudness": True, "True Peak": True}


def test_sidecar_columns_by_name_and_rejects(spark, tmp_path):
    (tmp_path / "x.csv").write_text("\ufeffStart\tName\tNotes\n0:01.000\t Verse 1 \tn\n0:00.500\n0:02.000\t\tn\n0:03.000\t\"Verse\t2\"\tn\n", encoding="utf-8")
    (tmp_path / "y.csv").write_bytes(b"Name\tStart\n\xff\xfe\t1\n")
    got = [(r.name, r.start_seconds, r.time_format, r.ord) for r in F.read_markers(spark, [str(tmp_path / "x.csv")]).orderBy("ord").collect()]
    assert got == [("Verse 1", 1.0, "decimal", 1), ("Verse\t2", 3.0, "decimal", 2)]
    told = {(r.path.rsplit("/", 1)[1], r.line_no): r.reason for r in F.marker_records(spark, [str(tmp_path / "*.csv")]).where("reason IS NOT NULL").collect()}
    assert told[("x.csv", 3)] == "columns" and "decode" in told[("y.csv", None)]


def test_settings_are_checked(tmp_path):
    made, left = F.settings_from('{"target_lufs": -20, "expected_bits": 16.0, "strict_verse_spelling": false, "enable_verses": "no", "expected_sample_rate": 44100.5, "theme": "dark", "heading_name": null}')
    assert (made.target_lufs, made.expected_bits, made.strict_verse_spelling, made.enable_verses, made.expected_sample_rate) == (-20.0, 16, False, True, 48000)
    assert sorted(left) == ["enable_verses", "expected_sample_rate", "heading_name", "theme"]
    assert F.settings_from("[1]") == (Settings(), ["the whole file"])


def test_state_round_trip(spark, tmp_path):
    rows = [("en:x", 0, "en", 1, 10.0, 11.0, "x", 5.0), ("en:x", 1, "en", 2, 20.0, 21.0, "x", 6.0), ("unknown:default", 0, None, 1, 1.0, 2.0, None, 7.0)]
    log = spark.createDataFrame(rows, "profile string, seq int, language string, verse_number long, expected_time double, corrected_time double, reader_id string, timestamp double")
    F.save_state(log, str(tmp_path / "s.json"), spark.createDataFrame([("en:x", 0.4)], "profile string, mean double"))
    got = sorted(tuple(r) for r in F.read_state(spark, [str(tmp_path / "s.json")]).select("profile", "seq", "language", "verse_number", "expected_time", "corrected_time", "reader_id", "timestamp").collect())
    assert got == sorted(rows)
    told = json.loads((tmp_path / "s.json").read_text())["profiles"]["en:x"]
    assert told["total_corrections"] == 2 and told["average_offset_s"] == 1.0 and told["average_pause_duration"] == 0.4


def test_exporting_and_fixing_many(spark, tmp_path):
    (tmp_path / "a_1.wav").write_bytes(wavcodec.synthetic(["Verse 1", "Verse 2"], rate=8000, bits=16, head_s=1.0, tail_s=3.0))
    (tmp_path / "b_1.wav").write_bytes(wavcodec.synthetic([], rate=8000, bits=16))
    (tmp_path / "c_1.wav").write_bytes(b"x")
    done = wav.export_markers(spark, [str(tmp_path)])
    assert {r.path[-7]: r.status for r in done.collect()} == {"a": "ok", "b": "skip", "c": "fail"}
    assert {r.status: r.n for r in report.tally(done, "status").collect()} == {"ok": 1, "skip": 1, "fail": 1}
    assert [(r.name, r.start_seconds) for r in F.read_markers(spark, [str(tmp_path / "a_1.csv")]).orderBy("ord").collect()] == [("Verse 1", 1.0), ("Verse 2", 1.2)]
    fixed = {r.path[-7]: r for r in wav.fix_files(spark, [str(tmp_path / "a_1.wav"), str(tmp_path / "c_1.wav")]).collect()}
    h, cues = wavcodec.parse(open(fixed["a"].output, "rb").read())
    assert fixed["a"].output.endswith("a_Fixed/a_1.wav") and fixed["c"].error and abs(fixed["a"].head_s - 1.0) < 0.01
    assert [round(c.sample_offset / 8000, 1) for c in cues] == [2.0, 2.2] and abs(h.seconds - 4.4) < 0.01


def test_command_line(spark, folder, tmp_path, capsys, monkeypatch):
    from lectern.__main__ import main

    monkeypatch.setattr(spark, "stop", lambda: None)
    (tmp_path / "dim.json").write_text(json.dumps({"Genesis": [31, 25], "Jonah": [17], "Obadiah": [21]}))
    (tmp_path / "names.json").write_text(json.dumps({"gen": "Genesis", "jon": "Jonah", "oba": "Obadiah"}))
    (tmp_path / "c.json").write_text(json.dumps({"target_lufs": -9.2, "lufs_tolerance": 3.0}))
    (folder / "good" / "Gen_001.csv").write_text("\ufeffName\tStart\tDuration\tTime Format\tType\tDescription\nVerse 1\t0:02.400\t0:00.000\tdecimal\tCue\t\nVerse 99\t1:00.000\t0:00.000\tdecimal\tCue\t\n", encoding="utf-8")
    dims = ["--dimension", str(tmp_path / "dim.json"), "--aliases", str(tmp_path / "names.json"), "--config", str(tmp_path / "c.json")]
    code = main([str(folder), *dims, "--json", str(tmp_path / "r.json"), "--mistakes", str(tmp_path / "m"), "--report", str(tmp_path / "f")])
    said = capsys.readouterr().out
    assert code == 2 and "[Genesis 1, expect 31 verses]" in said and "Genesis: missing 2; repeated 1" in said and "5, 17-19" in said and "in sidecar only: verse 99" in said
    told = json.loads((tmp_path / "r.json").read_text())
    assert len(told["files"]) == 5 and [b for b in told["missing_chapters"] if b["book"] == "Genesis"] == [{"book": "Genesis", "total_chapters": 2, "chapters_found": [1], "chapters_missing": [2], "duplicate_chapters": [1], "complete": False}]
    jon = next(f for f in told["files"] if f["file"] == "Jon_001.WAV")
    assert jon["book"] == "Jonah" and {"Marker Spelling", "Verses", "Tail Silence"} <= {c["name"] for c in jon["checks"] if c["status"] == "FAIL"}
    mistakes = spark.read.csv(str(tmp_path / "m"), header=True).collect()
    assert any(r.File is None and r.Book == "Genesis" for r in mistakes) and any(r.File == "Oba_001.wav" and "no markers" in r.Issues for r in mistakes)
    assert spark.read.csv(str(tmp_path / "f"), header=True).where("Check = 'Missing Chapters'").count() == 1
    (folder / "good" / "Gen_001.csv").unlink()
    (tmp_path / "dim.json").write_text(json.dumps({"Genesis": [31]}))
    assert main([str(folder / "good"), *dims]) == 0 and main([str(tmp_path)]) == 1 and main([str(folder), "--auto-mark"]) == 1
    (tmp_path / "script.txt").write_text("Chapter 1\n1 In the beginning\n2 And the earth\n4 And more")
    spark.createDataFrame([(str(folder / "good" / "Gen_001.wav"), 1, 2.4, 2.5, "in the beginning")], "path string, pos long, start double, end double, word string").write.parquet(str(tmp_path / "words"))
    assert main([str(folder / "good"), *dims, "--script", str(tmp_path / "script.txt"), "--words", str(tmp_path / "words")]) == 2
    said = capsys.readouterr().out
    assert "verses missing: 3" in said and "Script Match" in said and "2 issues" in said
    assert main([str(folder / "good"), "--script", str(tmp_path / "none.txt")]) == 1
    target = tmp_path / "x_1.wav"
    target.write_bytes(wavcodec.synthetic([f"Verse {i}" for i in range(1, 4)], rate=8000, bits=16))
    assert main([str(target), "--auto-mark", "--script", str(tmp_path / "script.txt")]) == 0
    assert [c.label for c in wavcodec.parse((tmp_path / "x_1_marked.wav").read_bytes())[1]] == ["Chapter Title", "Verse 2"]  # by the pause at the end
    assert [r.name for r in F.read_markers(spark, [str(tmp_path / "x_1_marked.csv")]).orderBy("ord").collect()] == ["Chapter Title", "Verse 2"]


def test_measuring_and_mastering_in_tasks(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wavcodec.synthetic(["Verse 1", "Verse 2"], segment_s=1.0))
    (tmp_path / "b.wav").write_bytes(b"x")
    content = spark.read.format("binaryFile").load(str(tmp_path))
    names = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.wav", "b.wav", "none.wav")], "path string")
    got = {r.path.rsplit("/", 1)[1]: r for r in dsp.measure_files(names).collect()}
    assert got["a.wav"].lufs < -5 and got["b.wav"].error and got["none.wav"].error
    done = {r.path[-5:]: r for r in dsp.master_files(content).collect()}
    h, cues = wavcodec.parse(bytes(done["a.wav"].mastered))
    assert (h.sample_rate, h.bits, h.channels, [c.label for c in cues]) == (48000, 24, 1, ["Verse 1", "Verse 2"])


def test_clips_documents_and_console(spark, tmp_path):
    path = tmp_path / "a.wav"
    path.write_bytes(wavcodec.synthetic(["Verse 1"], rate=8000, bits=24))
    rows = spark.createDataFrame([(str(path), 2.0, 2.1), (str(tmp_path / "no.wav"), 0.0, 1.0)], "path string, start_s double, end_s double")
    got = {r.path: r.clip for r in wav.cut_segments(rows).collect()}
    h, _ = wavcodec.parse(bytes(got[str(path)]))
    assert (h.n_frames, h.bits, h.channels) == (800, 16, 1) and got[str(tmp_path / "no.wav")] is None
    (tmp_path / "x.pdf").write_bytes(b" text ")
    (tmp_path / "y.pdf").write_bytes(b"\xff")
    docs = {r.filename: r for r in F.read_documents(spark, [str(tmp_path / "*.pdf")], lambda b: b.decode("utf-8")).collect()}
    assert docs["x.pdf"].raw_text == "text" and docs["y.pdf"].error
    files = spark.createDataFrame([("a", True, None), ("b", False, "broken")], "path string, passed boolean, error string")
    items = spark.createDataFrame([("a", 1, "Format", True, "48k", "ok")], "path string, ord int, name string, passed boolean, value string, detail string")
    assert [r.line for r in report.console_lines(files, items, key="path").orderBy("path", "ord").collect()] == ["PASS  a", "    Format          PASS  48k", "FAIL  b  broken"]
    assert {r.status: r.n for r in report.tally(files, "error").collect()} == {"none": 1, "broken": 1}
