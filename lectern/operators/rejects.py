"""Rows that fail to parse: delimited records are split structurally, checked, and set apart with a reason."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("name", "start", "duration", "time_format", "marker_type", "description")
#: The accepted time formats and, for each, the shape of a start value.
START_SHAPES = {
    "decimal": r"^(?:[0-9]+:[0-5][0-9]|[0-9]+:[0-5][0-9]:[0-5][0-9]|[0-9]+)\.[0-9]{1,3}$",
    "samples": r"^[0-9]+$",
    "30 fps": r"^[0-9]{2}:[0-5][0-9]:[0-5][0-9]:[0-2][0-9]$",
}
TAB, QUOTE, RETURN = 9, 34, 13


def split_records(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the delimiting tabs of each record, the record of each, and whether a record's quoting is broken.

    data holds the UTF-8 bytes of all records; record i is data[starts[i]:ends[i]]. A quote mask and its prefix parity
    (the count of quotes since the record's start, modulo 2) tell which tabs lie outside quotes. A quote that turns the
    parity odd must open a field or double the quote before it; where it does neither, it stands inside a field that
    did not begin with a quote, so the quotes of that field are taken out of the mask and the parity is built anew, for
    the records concerned only. A quote that turns the parity even must be followed by a tab, the record's end or the
    other quote of a pair.
    """
    n = len(starts)
    bad = np.zeros(n, bool)
    tabs = np.flatnonzero(data == TAB)
    tab_row = np.searchsorted(starts, tabs, "right") - 1
    inside = tabs < ends[tab_row] if n else np.zeros(0, bool)
    tabs, tab_row = tabs[inside], tab_row[inside]
    quotes = np.flatnonzero(data == QUOTE)
    quote_row = np.searchsorted(starts, quotes, "right") - 1
    inside = quotes < ends[quote_row] if n else np.zeros(0, bool)
    quotes, quote_row = quotes[inside], quote_row[inside]
    size = max(int(ends.max(initial=0)), 1)
    while len(quotes):
        first = np.searchsorted(quote_row, quote_row, "left")
        odd = (np.arange(len(quotes)) - first) % 2 == 0  # parity becomes odd: the quote opens
        at_start = (quotes == starts[quote_row]) | (data[quotes - 1] == TAB)
        before = np.zeros(len(quotes), bool)
        before[1:] = (quotes[1:] - quotes[:-1] == 1) & (quote_row[1:] == quote_row[:-1])
        plain = odd & ~at_start & ~before
        after = np.zeros(len(quotes), bool)
        after[:-1] = before[1:]
        nxt = np.minimum(quotes + 1, len(data) - 1)
        closes = ~odd & ~after & ~((quotes + 1 == ends[quote_row]) | (data[nxt] == TAB))
        last = np.zeros(len(quotes), bool)
        last[:-1] = quote_row[1:] != quote_row[:-1]
        last[-1] = True
        open_end = odd & last  # never closed
        wrong = np.flatnonzero(plain | closes | open_end)
        if not len(wrong):
            break
        rows, where = np.unique(quote_row[wrong], return_index=True)
        leading = wrong[where]  # the first violation of each record decides
        is_plain = plain[leading]
        bad[rows[~is_plain]] = True
        again = rows[is_plain]
        keep_row = np.isin(quote_row, again) | ~np.isin(quote_row, rows)
        # quotes up to the next tab after a plain one belong to the same plain field
        limit = np.full(n, -1, np.int64)
        begin = np.full(n, size + 1, np.int64)
        spot = quotes[leading[is_plain]]
        behind = np.searchsorted(tabs, spot)
        stop = np.where(behind < len(tabs), tabs[np.minimum(behind, max(len(tabs) - 1, 0))] if len(tabs) else size, size)
        begin[again], limit[again] = spot, np.minimum(stop, ends[again])
        drop = (quotes >= begin[quote_row]) & (quotes < limit[quote_row])
        keep = keep_row & ~drop
        if keep.all():
            break
        quotes, quote_row = quotes[keep], quote_row[keep]
    parity = np.searchsorted(quotes, tabs) - np.searchsorted(quotes, starts[tab_row]) if len(quotes) else np.zeros(len(tabs), int)
    outside = parity % 2 == 0
    return tabs[outside], tab_row[outside], bad


def _field(data: np.ndarray, left: np.ndarray, right: np.ndarray, good: np.ndarray) -> pa.Array:
    """The texts data[left:right] of the good records, unquoted, null for the others, cut out of the bytes by offsets."""
    quoted = (right > left) & (data[np.minimum(left, len(data) - 1)] == QUOTE)
    left, right = left + quoted, right - quoted
    size = right - left
    before = np.cumsum(size) - size
    at = np.repeat(left - before, size) + np.arange(size.sum())
    piece = data[at]
    if quoted.any():  # of each pair of quotes in a quoted field one is kept
        marks = np.flatnonzero((piece == QUOTE) & np.repeat(quoted, size))[1::2]
        size = size - np.bincount(np.searchsorted(before, marks, "right") - 1, minlength=len(size)).astype(size.dtype)
        piece = np.delete(piece, marks)
    sizes = np.zeros(len(good), np.int64)
    sizes[good] = size
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    valid = pa.py_buffer(np.packbits(good, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.large_string(), len(good), [valid, pa.py_buffer(offsets.tobytes()), pa.py_buffer(piece.tobytes())]).cast(pa.string())


def parse_batch(lines: pa.Array) -> pa.StructArray:
    """The number of fields, the first six fields unquoted, and whether quoting is broken, of each record of a batch."""
    lines = lines.cast(pa.large_binary()) if lines.type != pa.large_binary() else lines
    null = np.asarray(lines.is_null())
    offsets = np.frombuffer(lines.buffers()[1], np.int64, len(lines) + 1, lines.offset * 8)
    raw = lines.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    starts, ends = offsets[:-1].copy(), offsets[1:].copy()
    base, top = (int(starts[0]), int(ends[-1])) if len(lines) else (0, 0)
    data, starts, ends = data[base:top], starts - base, ends - base
    if not len(data):
        data = np.zeros(1, np.uint8)
    final = (ends > starts) & (data[np.maximum(ends - 1, 0)] == RETURN)
    ends = ends - final
    # equal starts (empty records) would share positions; searchsorted "right" gives the last of them, which owns the bytes
    tabs, row, bad = split_records(data, starts, ends)
    counts = np.bincount(row, minlength=len(starts)) + 1
    first_tab = np.searchsorted(row, np.arange(len(starts)))
    good = (counts == len(FIELDS)) & ~bad & ~null
    rows = np.flatnonzero(good)
    edges = tabs[first_tab[rows][:, None] + np.arange(len(FIELDS) - 1)] if len(rows) else np.zeros((0, len(FIELDS) - 1), int)
    left = np.concatenate([starts[rows][:, None], edges + 1], 1)
    right = np.concatenate([edges, ends[rows][:, None]], 1)
    out = [_field(data, left[:, k], right[:, k], good) for k in range(len(FIELDS))]
    return pa.StructArray.from_arrays(
        [pa.array(np.where(null, 0, counts), pa.int32()), pa.array(bad & ~null), *out], ["n_fields", "bad_quoting", *FIELDS]
    )


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def parse_marker_records(records: DataFrame, line: str = "line") -> DataFrame:
    """records with the typed sidecar columns and `reason`, null where the record is valid.

    Every input column is kept; the added ones are n_fields, name, start, duration, time_format, marker_type,
    description, start_seconds, start_samples, duration_text and reason. Where an input column has one of these names,
    the added column is prefixed with "parsed_" instead. The first that applies of quoting, columns, time_format and
    start is the reason. A null record has no fields, so its reason is 'columns'; an empty text has one field, likewise.
    start_seconds of a 'samples' record needs the rate of its recording and is null; start_samples holds the count.
    Row-local, so nothing is shuffled and a file that is much worse than others costs no more.
    """
    source = records.columns
    kind = "struct<n_fields:int,bad_quoting:boolean," + ",".join(f"{f}:string" for f in FIELDS) + ">"
    schema = records.select(*source, F.expr(f"CAST(NULL AS {kind})").alias("__parsed")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = parse_batch(batch.column(batch.schema.get_field_index(line)))
            yield pa.RecordBatch.from_arrays([*batch.columns, parsed], [*batch.schema.names, "__parsed"])

    df = records.mapInArrow(run, schema)
    p = lambda f: F.col(f"__parsed.{f}")
    form = F.lower(_trimmed(p("time_format")))
    start = _trimmed(p("start"))
    fits = F.lit(False)
    for name, shape in START_SHAPES.items():
        fits = fits | ((form == name) & start.rlike(shape))
    reason = (
        F.when(p("bad_quoting"), "quoting")
        .when(p("n_fields") != len(FIELDS), "columns")
        .when(~F.coalesce(form.isin(*START_SHAPES), F.lit(False)), "time_format")
        .when(~F.coalesce(fits, F.lit(False)), "start")
    )
    parts = F.split(start, ":")
    number = lambda i: F.element_at(parts, i).try_cast("double")
    decimal = F.coalesce(F.try_element_at(parts, F.lit(-1)).try_cast("double"), F.lit(0.0))
    for place, unit in ((-2, 60.0), (-3, 3600.0)):
        decimal = decimal + F.coalesce(F.try_element_at(parts, F.lit(place)).try_cast("double"), F.lit(0.0)) * unit
    frames = number(1) * 3600 + number(2) * 60 + number(3) + number(4) / 30
    clash = lambda c: f"parsed_{c}" if c in source else c
    added = {
        "n_fields": p("n_fields"), "name": p("name"), "start": p("start"), "duration_text": p("duration"), "time_format": form,
        "marker_type": p("marker_type"), "description": p("description"),
    }
    df = df.withColumn("__reason", reason)
    valid = F.col("__reason").isNull()
    seconds = F.when(valid & (form == "decimal"), decimal).when(valid & (form == "30 fps"), frames)
    return df.select(
        *[F.col(f"`{c}`") for c in source],
        *[c.alias(clash(n)) for n, c in added.items()],
        seconds.alias(clash("start_seconds")),
        F.when(valid & (form == "samples"), start.try_cast("decimal(38,0)")).alias(clash("start_samples")),
        F.col("__reason").alias(clash("reason")),
    )


def split_valid(records: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """The valid records, typed, and the rejected ones with their reason; together they are all records."""
    parsed = parse_marker_records(records, line)
    reason = "parsed_reason" if "reason" in records.columns else "reason"
    return parsed.where(F.col(reason).isNull()).drop(reason), parsed.where(F.col(reason).isNotNull()).select(*records.columns, reason)
