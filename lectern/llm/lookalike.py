"""One consistent form for text that looks the same: compatibility forms, ignorable characters, look-alike letters."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters that look alike in Latin, Cyrillic and Greek. "." stands for no such letter in the script.
LATIN = "aceijopsxyhABCEHIJKMNOPSTXYZvwVW"
CYRILLIC = "асеіјорѕхуһАВСЕНІЈКМ.ОРЅТХУ.ѵԝѴԜ"
GREEK = ".....ο.....ΑΒ.ΕΗΙ.ΚΜΝΟΡ.ΤΧΥΖν..."
SCRIPTS = ("latin", "cyrillic", "greek")
#: Ranges of characters without any mark of their own.
_INVISIBLE = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0xE0000, 0xE0FFF),
]
IGNORABLE = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _INVISIBLE) + "]")
GAP = re.compile(r"\s+")


def _classes() -> tuple[dict[str, int], list[tuple[str, ...]]]:
    of, members = {}, []
    for row in zip(LATIN, CYRILLIC, GREEK):
        for c in row:
            if c != ".":
                of[c] = len(members)
        members.append(tuple("" if c == "." else c for c in row))
    return of, members


CLASS_OF, MEMBERS = _classes()


def script_of(c: str) -> int | None:
    """0 Latin, 1 Cyrillic, 2 Greek, None for every other character."""
    o = ord(c)
    if o < 0x250:
        return 0 if c.isalpha() else None
    if 0x400 <= o <= 0x52F:
        return 1
    if 0x370 <= o <= 0x3FF and c.isalpha():
        return 2
    return 0 if 0x1E00 <= o <= 0x1EFF else None


def folded(text: str) -> str:
    """Compatibility form without ignorable characters, each gap one space, letters apart from their accents (NFD).

    Ignorable characters go before normalization, so that an accent after one still joins its letter, and gaps that
    compatibility forms bring in are closed again.
    """
    text = IGNORABLE.sub("", text)
    if text.isascii():
        return GAP.sub(" ", text).strip()
    return GAP.sub(" ", IGNORABLE.sub("", unicodedata.normalize("NFKD", text))).strip()


class Model:
    """Bigram scores of letters within words, for each script; None stands for a word's edge."""

    def __init__(self, counts: list[tuple[int, str, str, int]]):
        self.pair: dict[tuple[int, str, str], float] = {}
        total: dict[tuple[int, str], int] = {}
        for s, a, b, n in counts:
            total[s, a] = total.get((s, a), 0) + n
        for s, a, b, n in counts:
            self.pair[s, a, b] = math.log((n + 0.5) / (total[s, a] + 50.0))
        self.total = total
        self.known: dict[str, str] = {}

    def score(self, s: int, a: str, b: str) -> float:
        got = self.pair.get((s, a, b))
        return got if got is not None else math.log(0.5 / (self.total.get((s, a), 0) + 50.0))

    def token(self, word: str) -> str:
        """The most probable reading of a folded token's look-alike lattice.

        The lattice holds, for each letter, all letters of its look-alike class, so words that look the same have the
        same lattice and come out the same, and words that look different cannot. A state is the script read so far; a
        change of script within the word costs as much as a very rare letter pair.
        """
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[word] = self._viterbi(word)
        return got

    def _viterbi(self, word: str) -> str:
        if not any(c in CLASS_OF for c in word):
            return word
        change = -12.0
        states: dict[int, tuple[float, str, tuple | None]] = {s: (-0.001 * s, "", None) for s in range(3)}
        for c in word:
            k = CLASS_OF.get(c)
            own = script_of(c) if k is None else None
            new: dict[int, tuple[float, str, tuple | None]] = {}
            for s in range(3):
                if k is None:
                    if own is None:  # accents, digits and marks stand in any script and leave the last letter
                        score, last, back = states[s] if s in states else (-math.inf, "", None)
                        if s in states:
                            new[s] = (score, last, (back, c))
                        continue
                    if own != s:
                        continue
                    letter = c
                else:
                    letter = MEMBERS[k][s]
                    if not letter:
                        continue
                best = None
                for p, (score, last, back) in states.items():
                    value = score + (0.0 if p == s or not last else change) + self.score(s, last if p == s else "", letter)
                    if best is None or value > best[0] + 1e-9:
                        best = (value, letter, (back, letter))
                new[s] = best
            states = new
        score, back = -math.inf, None
        for s in sorted(states):
            value = states[s][0] + self.score(s, states[s][1], "")
            if value > score + 1e-9:
                score, back = value, states[s][2]
        out = []
        while back:
            back, c = back
            out.append(c)
        return "".join(reversed(out))

    def text(self, text: str | None) -> str | None:
        if text is None:
            return None
        return unicodedata.normalize("NFC", " ".join([self.token(w) for w in folded(text).split(" ")]))


def letter_pairs(texts: DataFrame, columns: list[str]) -> list[tuple[int, str, str, int]]:
    """Counts of letter pairs within words of one script, over all texts.

    Only words whose letters all lie in one of the three scripts' own blocks are counted. Distinct words are counted
    first, with a partial count on each task; the pairs are limited by the alphabets, so the result is small.
    """
    words = texts.select(F.explode(F.array(*[F.col(f"`{c}`") for c in columns])).alias("x")).where("x IS NOT NULL")
    words = words.select(F.explode(F.split("x", r"(?U)[^\p{L}]+")).alias("w")).where("length(w) >= 2").groupBy("w").agg(F.count("*").alias("n"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, str, str], int] = {}
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                letters = [c for c in folded(word) if c.isalpha()]
                scripts = {script_of(c) for c in letters}
                if len(scripts) == 1 and (s := scripts.pop()) is not None:
                    for a, b in zip(["", *letters], [*letters, ""]):
                        counts[s, a, b] = counts.get((s, a, b), 0) + n
        rows = list(counts.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _ in rows], pa.int32()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([k[2] for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())],
            ["s", "a", "b", "n"],
        )

    found = words.mapInArrow(pairs, "s int, a string, b string, n long").groupBy("s", "a", "b").agg(F.sum("n").alias("n"))
    return [(r.s, r.a, r.b, r.n) for r in found.collect()]


def consistent(df: DataFrame, columns: list[str], pairs: list[tuple[int, str, str, int]] | None = None) -> DataFrame:
    """df with `<column>_form` for each column: its text in the one form shared by all texts that look the same.

    Two texts get equal forms just when a reader sees the same letters, accents, digits, punctuation and gaps. Null
    stays null; a text of ignorable characters and gaps only becomes ''. Whole texts are read, of any length. Where an
    input column has the name of an added one, it is replaced. The letter pairs are counted over all rows of df unless
    given. Row-local apart from that count, so no key can be hot.
    """
    pairs = letter_pairs(df, columns) if pairs is None else pairs
    pairs = sorted(pairs)
    forms = [f"{c}_form" for c in columns]
    kept = [c for c in df.columns if c not in forms]
    schema = df.select(*[F.col(f"`{c}`") for c in kept], *[F.lit(None).cast("string").alias(f) for f in forms]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(pairs)
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            made = [pa.array([model.text(t) for t in batch.column(at[c]).to_pylist()], pa.string()) for c in columns]
            yield pa.RecordBatch.from_arrays([*[batch.column(at[c]) for c in kept], *made], [*kept, *forms])

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)
