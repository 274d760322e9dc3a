"""A Spark data source for WAVE containers, and a sink that writes them."""

from __future__ import annotations

import glob
import io
import itertools
import os
import re
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import wavcodec

SCHEMAS = {
    "header": "path string, filename string, audio_format int, channels int, sample_rate long, bits int, sampwidth int, data_offset long, data_size long, n_frames long, seconds double, error string",
    "markers": "path string, cue_id long, sample_offset long, label string, length_samples long, sample_rate long, seconds double",
    "peaks": "path string, edge string, bucket long, t0 double, dur_s double, peak double",
    "envelope": "path string, bucket long, low double, high double",
    "pcm": "path string, block long, start_frame long, channels int, sample_rate long, bits int, pcm binary",
}


def list_files(paths: list[str]) -> list[str]:
    """Recordings in order, as absolute paths: explicit files as given, folders searched to all depths in order of name;
    each path once."""
    found: dict[str, None] = {}
    for path in map(os.path.abspath, paths):
        if os.path.isdir(path):
            inside = (p for p in glob.iglob(os.path.join(glob.escape(path), "**", "*"), recursive=True) if p.lower().endswith(".wav"))
            for p in sorted(inside):
                found.setdefault(p)
        elif path.lower().endswith(".wav"):
            found.setdefault(path)
    return list(found)


class Chunk(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class WavReader(DataSourceReader):
    def __init__(self, options: dict):
        self.view = options.get("view", "header")
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.per_task = int(options.get("filespertask", 16))
        self.edge_s = float(options.get("edgeseconds", 6.0))
        self.block = int(options.get("blockframes", 480_000))
        self.bucket_s = float(options.get("bucketseconds", 0.01))
        self.columns = int(options.get("columns", 1400))
        self.whole = options.get("whole", "false").lower() == "true"

    def partitions(self) -> list[Chunk]:
        files = list_files(self.paths)
        return [Chunk(files[i : i + self.per_task]) for i in range(0, len(files), self.per_task)] or [Chunk([])]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        for path in partition.files:
            try:
                with open(path, "rb") as stream:
                    header = wavcodec.read_header(stream, os.path.getsize(path))
                    yield from getattr(self, "_" + self.view)(path, stream, header)
            except (OSError, wavcodec.WavError, struct.error) as e:
                if self.view == "header":
                    yield (path, os.path.basename(path), *[None] * 9, str(e))

    def _header(self, path: str, stream, h: wavcodec.Header) -> Iterator[tuple]:
        yield path, os.path.basename(path), h.audio_format, h.channels, h.sample_rate, h.bits, h.sampwidth, h.data_offset, h.data_size, h.n_frames, h.seconds, None

    def _markers(self, path: str, stream, h: wavcodec.Header) -> Iterator[tuple]:
        for c in wavcodec.read_cues(h):
            yield path, c.cue_id, c.sample_offset, c.label, c.length_samples, h.sample_rate, c.sample_offset / h.sample_rate

    def _peaks(self, path: str, stream, h: wavcodec.Header) -> Iterator[tuple]:
        """10 ms peaks of the head and, on a grid from the end, of the tail; of the whole recording with whole=true."""
        import numpy as np

        width = max(1, int(self.bucket_s * h.sample_rate))
        edge = h.n_frames if self.whole else min(h.n_frames, int(self.edge_s * h.sample_rate))
        for name, start in (("head", 0), *([] if self.whole else [("tail", h.n_frames - edge)])):
            mono = np.abs(wavcodec.to_mono(wavcodec.to_float(wavcodec.read_frames(stream, h, start, edge), h)))
            mono = mono[::-1] if name == "tail" else mono
            for b in range(0, len(mono), width):
                part = mono[b : b + width]
                yield path, name, b // width, b / h.sample_rate, len(part) / h.sample_rate, float(part.max())

    def _envelope(self, path: str, stream, h: wavcodec.Header) -> Iterator[tuple]:
        """Lowest and highest sample in at most `columns` equal stretches, read stretch by stretch."""
        width = max(1, h.n_frames // self.columns)
        at_once = max(1, self.block // width)
        for first in range(0, min(self.columns, -(-h.n_frames // width)), at_once):
            count = min(at_once, self.columns - first)
            mono = wavcodec.to_mono(wavcodec.to_float(wavcodec.read_frames(stream, h, first * width, count * width), h))
            for i, a in enumerate(range(0, len(mono), width)):
                part = mono[a : a + width]
                yield path, first + i, float(part.min()), float(part.max())

    def _pcm(self, path: str, stream, h: wavcodec.Header) -> Iterator[tuple]:
        for i, start in enumerate(range(0, h.n_frames, self.block)):
            yield path, i, start, h.channels, h.sample_rate, h.bits, wavcodec.read_frames(stream, h, start, self.block)


class WavSource(DataSource):
    """format("wav"): views header (the default), markers, peaks, envelope and pcm, chosen by the option `view`.

    Only what a view needs is read: headers skip the samples, peaks read the edges, pcm gives blocks of `blockframes`.
    Unreadable files appear in the header view with their error and nowhere else.
    """

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("view", "header")]

    def reader(self, schema) -> WavReader:
        return WavReader(dict(self.options))


def read(spark: SparkSession, paths: list[str], view: str = "header", **options: object) -> DataFrame:
    spark.dataSource.register(WavSource)
    reader = spark.read.format("wav").option("view", view)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(",".join(map(os.path.abspath, paths)))  # the source runs in another process, in its own folder


def from_content(content: DataFrame, view: str = "header", **options: object) -> DataFrame:
    """A view, as of read(), of containers in a binary column: (path, content), such as binaryFile gives for any file system
    that Spark can list and read, object stores included."""
    schema = SCHEMAS[view]
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    reader_options = {"view": view} | {k.lower(): str(v) for k, v in options.items()}

    def run(batches):
        import pandas as pd

        reader = WavReader(reader_options)
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"]):
                try:
                    stream = io.BytesIO(raw if raw is not None else b"")
                    rows = getattr(reader, "_" + view)(path, stream, wavcodec.read_header(stream, len(stream.getbuffer())))
                    while part := list(itertools.islice(rows, 10_000)):
                        yield pd.DataFrame(part, columns=names).astype(object)
                except (wavcodec.WavError, struct.error) as e:
                    if view == "header":
                        yield pd.DataFrame([(path, os.path.basename(path or ""), *[None] * 9, str(e))], columns=names).astype(object)

    return content.select("path", "content").mapInPandas(run, schema)


def to_content(clips: DataFrame, *, path: str, samples: str, bits: str, rate: str, cues: str) -> DataFrame:
    """(path, content): a mono container of each row's samples (an array from -1 to 1) with its markers, an array of structs
    (sample_offset, label)."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            made = []
            for x, b, r, marks in zip(pdf[samples], pdf[bits], pdf[rate], pdf[cues]):
                pcm = wavcodec.from_float(np.asarray(x if x is not None else [], np.float64)[None], int(b))
                made.append(wavcodec.write(pcm, channels=1, sample_rate=int(r), bits=int(b), cues=[(int(c["sample_offset"]), c["label"]) for c in (marks if marks is not None else [])]))
            yield pd.DataFrame({"path": pdf[path], "content": made})

    return clips.select(path, samples, bits, rate, cues).mapInPandas(run, f"path {clips.schema[path].dataType.simpleString()}, content binary")


def silence(peaks: DataFrame, *, threshold_dbfs: float = -60.0, expected_s: float = 2.0) -> DataFrame:
    """(path, head_silence, tail_silence) from the peaks view; each is capped at 1.5 times what is expected."""
    from ..operators.series import edge_run

    runs = edge_run(peaks, keys=["path", "edge"], order=["bucket"], peak="peak", threshold=10 ** (threshold_dbfs / 20), width="dur_s", most=1.5 * expected_s)
    return runs.groupBy("path").agg(F.max(F.when(F.col("edge") == "head", F.col("silence_s"))).alias("head_silence"), F.max(F.when(F.col("edge") == "tail", F.col("silence_s"))).alias("tail_silence"))


def cut_segments(segments: DataFrame, *, path: str = "path", start: str = "start_s", end: str = "end_s") -> DataFrame:
    """segments with clip: each stretch of its recording as a 16-bit mono container, for a speech recogniser; null where
    the recording can't be read. Only the stretch's frames are read."""
    schema = segments.select("*", F.lit(None).cast("binary").alias("clip")).schema

    def run(batches):
        for pdf in batches:
            clips = []
            for p, a, b in zip(pdf[path], pdf[start], pdf[end]):
                try:
                    with open(p, "rb") as stream:
                        h = wavcodec.read_header(stream, os.path.getsize(p))
                        first, last = int(a * h.sample_rate), int(b * h.sample_rate)
                        x = wavcodec.to_float(wavcodec.read_frames(stream, h, first, last - first), h)[:1]
                    clips.append(wavcodec.write(wavcodec.from_float(x, 16), channels=1, sample_rate=h.sample_rate, bits=16))
                except (OSError, TypeError, ValueError):
                    clips.append(None)
            yield pdf.assign(clip=clips)

    return segments.mapInPandas(run, schema)


def sidecar_text(rows: list[tuple[str, float]]) -> str:
    """A sidecar file's text for names and their seconds."""
    def told(t: float) -> str:
        ms = round(t * 1000)
        return f"{ms // 60000}:{ms // 1000 % 60:02d}.{ms % 1000:03d}"

    lines = ["Name\tStart\tDuration\tTime Format\tType\tDescription", *(f"{name}\t{told(t)}\t0:00.000\tdecimal\tCue\t" for name, t in rows)]
    return "\ufeff" + "\n".join(lines) + "\n"


def write_marked(placements: DataFrame, *, key: str = "path", suffix: str = "_marked", sidecar: bool = False) -> DataFrame:
    """Writes a copy of each recording with the placed markers beside it, and with `sidecar` also the marker file of that
    copy, and returns (path, output, markers, error).

    Runs when the result is used; a recording's placements are one row, its file is read and written in one task.
    """
    lists = placements.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sample_offset", "label"))).alias("cues"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for path, cues in zip(pdf[key], pdf["cues"]):
                target = os.path.splitext(path)[0] + suffix + os.path.splitext(path)[1]
                try:
                    with open(path, "rb") as stream:
                        h = wavcodec.read_header(stream, os.path.getsize(path))
                        if h.audio_format == wavcodec.FLOAT:
                            raise wavcodec.WavError("floating-point samples can't be marked")
                        pcm = wavcodec.read_frames(stream, h)
                    made = wavcodec.write(pcm, channels=h.channels, sample_rate=h.sample_rate, bits=h.bits, cues=[(int(c["sample_offset"]), c["label"]) for c in cues])
                    with open(target + ".part", "wb") as sink:
                        sink.write(made)
                    os.replace(target + ".part", target)  # a task that runs twice leaves one whole file
                    if sidecar:
                        listing = os.path.splitext(target)[0] + ".csv"
                        with open(listing + ".part", "w", encoding="utf-8") as sink:
                            sink.write(sidecar_text([(c["label"], int(c["sample_offset"]) / h.sample_rate) for c in cues]))
                        os.replace(listing + ".part", listing)
                    out.append((path, target, len(cues), None))
                except (OSError, wavcodec.WavError) as e:
                    out.append((path, None, 0, str(e)))
            yield pd.DataFrame(out, columns=["path", "output", "markers", "error"])

    return lists.mapInPandas(run, "path string, output string, markers long, error string")


def export_markers(spark: SparkSession, paths: list[str], folder: str | None = None) -> DataFrame:
    """Writes each recording's markers into a sidecar file, beside it or in `folder`, and returns (path, output, markers,
    status, error): 'ok', 'skip' for one without markers, 'fail' for one that can't be read or written.

    One task a few recordings; the header's chunks are read, not the samples.
    """
    header = read(spark, paths, "header").select("path", "error")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for path in pdf["path"]:
                target = os.path.splitext(path)[0] + ".csv"
                target = os.path.join(folder, os.path.basename(target)) if folder else target
                try:
                    with open(path, "rb") as stream:
                        h = wavcodec.read_header(stream, os.path.getsize(path))
                    cues = wavcodec.read_cues(h)
                    if cues:
                        with open(target + ".part", "w", encoding="utf-8") as sink:
                            sink.write(sidecar_text([(c.label, c.sample_offset / h.sample_rate) for c in cues]))
                        os.replace(target + ".part", target)
                    out.append((path, target if cues else None, len(cues), "ok" if cues else "skip", None))
                except (OSError, wavcodec.WavError, struct.error) as e:
                    out.append((path, None, 0, "fail", str(e)))
            yield pd.DataFrame(out, columns=["path", "output", "markers", "status", "error"])

    return header.mapInPandas(run, "path string, output string, markers long, status string, error string")


def fix_files(spark: SparkSession, paths: list[str], *, seconds: float = 2.0, threshold_dbfs: float = -60.0) -> DataFrame:
    """Writes a copy of each recording, in the folder for fixed ones, whose quiet edges are cut or filled up to `seconds`,
    with its markers moved along, and returns (path, output, head_s, tail_s, error)."""
    from ..functions.dsp import edges, fix_silence

    header = read(spark, paths, "header").select("path")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for path in pdf["path"]:
                try:
                    with open(path, "rb") as stream:
                        h = wavcodec.read_header(stream, os.path.getsize(path))
                        x = wavcodec.to_mono(wavcodec.to_float(wavcodec.read_frames(stream, h), h))
                    head, tail = edges(x, threshold_dbfs)
                    y = fix_silence(x, h.sample_rate, seconds, threshold_dbfs)
                    shift = round(seconds * h.sample_rate) - (head if head < len(x) else 0)
                    cues = [(c.sample_offset + shift, c.label) for c in wavcodec.read_cues(h) if 0 <= c.sample_offset + shift < len(y)]
                    bits = h.bits if h.audio_format != wavcodec.FLOAT else 24
                    stem, name = os.path.splitext(os.path.basename(path))[0], os.path.basename(path)
                    target = os.path.join(os.path.dirname(path), re.split(r"[_ .-]", stem, maxsplit=1)[0] + "_Fixed", name)
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    with open(target + ".part", "wb") as sink:
                        sink.write(wavcodec.write(wavcodec.from_float(y, bits), channels=1, sample_rate=h.sample_rate, bits=bits, cues=cues))
                    os.replace(target + ".part", target)
                    out.append((path, target, head / h.sample_rate, tail / h.sample_rate, None))
                except (OSError, wavcodec.WavError, struct.error) as e:
                    out.append((path, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "output", "head_s", "tail_s", "error"])

    return header.mapInPandas(run, "path string, output string, head_s double, tail_s double, error string")
