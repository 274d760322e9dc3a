"""RIFF/WAVE containers: header, markers and samples, without any Spark."""

from __future__ import annotations

import io
import struct
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np

#: Fixed values of the format.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
RESCAN_BYTES = 1 << 20


class WavError(ValueError):
    """The bytes are no readable RIFF/WAVE container."""


@dataclass
class Header:
    audio_format: int = 0
    channels: int = 0
    sample_rate: int = 0
    bits: int = 0
    sampwidth: int = 1
    data_offset: int = 0
    data_size: int = 0
    chunks: dict[str, bytes] = field(default_factory=dict)

    @property
    def n_frames(self) -> int:
        return self.data_size // max(1, self.sampwidth * self.channels)

    @property
    def seconds(self) -> float:
        return self.n_frames / self.sample_rate if self.sample_rate else 0.0


@dataclass(frozen=True)
class Cue:
    cue_id: int
    sample_offset: int
    label: str
    length_samples: int = 0


def _keep(header: Header, tag: bytes, body: bytes) -> None:
    if tag == b"cue ":
        header.chunks["cue "] = body
    elif tag == b"LIST" and len(body) >= 4:
        header.chunks["LIST:" + body[:4].decode("latin-1")] = body[4:]
    elif tag == b"fmt " and len(body) >= 16:
        kind, header.channels, header.sample_rate, _, _, header.bits = struct.unpack_from("<HHIIHH", body)
        header.audio_format = struct.unpack_from("<H", body, 24)[0] if kind == EXTENSIBLE and len(body) >= 40 else kind
        header.sampwidth = max(1, header.bits // 8)


def read_header(stream: BinaryIO, size: int) -> Header:
    """The header from the chunks around the samples, which are skipped, not read.

    Sizes that reach beyond the end are cut; odd chunks are padded. Without a cue chunk, up to 1 MiB behind the samples is
    searched for one, since writers at times note a wrong size of the samples.
    """
    stream.seek(0)
    first = stream.read(12)
    if len(first) < 12 or first[:4] not in (b"RIFF", b"RF64") or first[8:] != b"WAVE":
        raise WavError("not a RIFF/WAVE file")
    header, at = Header(), 12
    while at + 8 <= size:
        stream.seek(at)
        tag, length = struct.unpack("<4sI", stream.read(8))
        length = min(length, size - at - 8)
        if tag == b"data":
            if not header.data_offset:
                header.data_offset, header.data_size = at + 8, length
        elif tag in (b"fmt ", b"cue ", b"LIST"):
            _keep(header, tag, stream.read(length))
        at += 8 + length + (length & 1)
    if not header.channels or not header.data_offset:
        raise WavError("no format or no samples")
    if not header.sample_rate:
        raise WavError("a sample rate of 0")
    if header.sampwidth not in ((4, 8) if header.audio_format == FLOAT else (1, 2, 3, 4)):
        raise WavError(f"samples of {header.bits} bits can't be read")
    if "cue " not in header.chunks:
        _rescan(stream, size, header)
    return header


def _rescan(stream: BinaryIO, size: int, header: Header) -> None:
    end = header.data_offset + header.data_size
    for start in dict.fromkeys((end + (header.data_size & 1), end)):
        stream.seek(start)
        tail = stream.read(min(RESCAN_BYTES, max(0, size - start)))
        at = 0
        while True:
            at = min((i for i in (tail.find(b"cue ", at), tail.find(b"LIST", at)) if i >= 0), default=-1)
            if at < 0 or at + 8 > len(tail):
                break
            tag, length = struct.unpack_from("<4sI", tail, at)
            if at + 8 + length <= len(tail):
                _keep(header, tag, tail[at + 8 : at + 8 + length])
                at += 8 + length + (length & 1)
            else:
                at += 1
        if "cue " in header.chunks:
            return


def _label(raw: bytes) -> str:
    raw = raw.split(b"\0", 1)[0]
    try:
        return raw.decode("utf-8").strip()
    except UnicodeDecodeError:
        return raw.decode("latin-1").strip()


def read_cues(header: Header) -> list[Cue]:
    """Markers in order of time. Of equal ids the last counts; a label outranks a note or region text."""
    body = header.chunks.get("cue ", b"")
    count = struct.unpack_from("<I", body)[0] if len(body) >= 4 else 0
    spots: dict[int, int] = {}
    for i in range(min(count, (len(body) - 4) // 24)):
        cue, position, _, _, _, offset = struct.unpack_from("<II4sIII", body, 4 + 24 * i)
        spots[cue] = offset or position
    labels: dict[int, str] = {}
    other: dict[int, str] = {}
    lengths: dict[int, int] = {}
    listing, at = header.chunks.get("LIST:adtl", b""), 0
    while at + 8 <= len(listing):
        tag, length = struct.unpack_from("<4sI", listing, at)
        part = listing[at + 8 : at + 8 + length]
        if len(part) >= 4:
            cue = struct.unpack_from("<I", part)[0]
            if tag == b"labl":
                labels[cue] = _label(part[4:])
            elif tag == b"note":
                other.setdefault(cue, _label(part[4:]))
            elif tag == b"ltxt" and len(part) >= 8:
                lengths[cue] = struct.unpack_from("<I", part, 4)[0]
                if len(part) > 20 and (said := _label(part[20:])):
                    other.setdefault(cue, said)
        at += 8 + length + (length & 1)
    found = [Cue(c, o, labels.get(c) or other.get(c, ""), lengths.get(c, 0)) for c, o in spots.items()]
    return sorted(found, key=lambda c: (c.sample_offset, c.cue_id))


def read_frames(stream: BinaryIO, header: Header, start: int = 0, count: int | None = None) -> bytes:
    """The bytes of a range of frames, cut to what there is."""
    start = min(max(start, 0), header.n_frames)
    count = header.n_frames - start if count is None else min(max(count, 0), header.n_frames - start)
    width = header.sampwidth * header.channels
    stream.seek(header.data_offset + start * width)
    return stream.read(count * width)


def to_float(raw: bytes, header: Header) -> np.ndarray:
    """(channels, frames) from -1 to 1."""
    width = header.sampwidth
    if header.audio_format == FLOAT:
        flat = np.frombuffer(raw, "<f8" if width == 8 else "<f4").astype(np.float64)
    elif width == 1:
        flat = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128.0) / 128.0
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        value = b[:, 0] | (b[:, 1] << 8) | (b[:, 2] << 16)
        flat = (value - ((value & 0x800000) << 1)) / float(1 << 23)
    else:
        flat = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float64) / float(1 << (8 * width - 1))
    return flat.reshape(-1, header.channels).T


def to_mono(x: np.ndarray) -> np.ndarray:
    """One channel as it is, two as their mean, of more the first."""
    return x[0] if len(x) != 2 else x.mean(0)


def from_float(x: np.ndarray, bits: int) -> bytes:
    """Interleaved PCM of (channels, frames), clipped, towards zero."""
    flat = np.clip(np.atleast_2d(x), -1.0, 1.0).T.reshape(-1)
    if bits == 8:
        return np.minimum((flat + 1.0) * 128.0, 255).astype(np.uint8).tobytes()
    value = np.trunc(flat * ((1 << (bits - 1)) - 1)).astype(np.int64)
    if bits == 24:
        return (value & 0xFFFFFF).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    return value.astype({16: "<i2", 32: "<i4"}[bits]).tobytes()


def _chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write(pcm: bytes, *, channels: int, sample_rate: int, bits: int, cues: list[tuple[int, str]] = ()) -> bytes:
    """A PCM container with markers, numbered from 1 in the order given."""
    width = max(1, bits // 8) * channels
    parts = [_chunk(b"fmt ", struct.pack("<HHIIHH", PCM, channels, sample_rate, sample_rate * width, width, bits)), _chunk(b"data", pcm)]
    if cues:
        points = [struct.pack("<II4sIII", i, offset, b"data", 0, 0, offset) for i, (offset, _) in enumerate(cues, 1)]
        parts.append(_chunk(b"cue ", struct.pack("<I", len(cues)) + b"".join(points)))
        labels = [_chunk(b"labl", struct.pack("<I", i) + label.encode("utf-8") + b"\0") for i, (_, label) in enumerate(cues, 1)]
        parts.append(_chunk(b"LIST", b"adtl" + b"".join(labels)))
    body = b"WAVE" + b"".join(parts)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse(content: bytes) -> tuple[Header, list[Cue]]:
    header = read_header(io.BytesIO(content), len(content))
    return header, read_cues(header)


def synthetic(labels: list[str], *, rate: int = 48000, bits: int = 24, head_s: float = 2.0, tail_s: float = 2.0, segment_s: float = 0.2, amplitude: float = 0.5) -> bytes:
    """A test recording: silence, a tone a label with a marker at its start, silence."""
    cues, parts, at = [], [np.zeros(int(head_s * rate))], int(head_s * rate)
    n = int(segment_s * rate)
    for i, label in enumerate(labels):
        cues.append((at, label))
        parts.append(amplitude * np.sin(2 * np.pi * (200 + 10 * i) * np.arange(n) / rate))
        at += n
    parts.append(np.zeros(int(tail_s * rate)))
    return write(from_float(np.concatenate(parts), bits), channels=1, sample_rate=rate, bits=bits, cues=cues)
