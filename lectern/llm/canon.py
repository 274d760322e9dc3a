"""Maps freely typed values to the entries of a canonical list, and reports those that mean none."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How ordinals are written, and words that may stand before a name without being part of it.
ORDINALS = {"1": "1", "2": "2", "3": "3", "4": "4", "1st": "1", "2nd": "2", "3rd": "3", "4th": "4", "i": "1", "ii": "2", "iii": "3", "iv": "4", "first": "1", "second": "2", "third": "3", "fourth": "4"}
LEADING = ["the book of", "book of", "the", "bk.", "bk"]
#: Signs typed for letters.
SIGNS = str.maketrans({"@": "a", "0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "9": "i", "!": "i", "$": "s", "|": "l"})


@dataclass(frozen=True)
class Rules:
    """How values of one field are normalised, and when a candidate is accepted."""

    #: Least cosine of a candidate, and how far it must lie above the next one's where the edits don't tell them apart.
    threshold: float = 0.2
    margin: float = 0.06
    #: In the exact check: edits allowed for each letter of the name, and by how many the next must need more in a tie.
    edits: float = 0.45
    lead: float = 0.08
    #: Shortest leading part of a name that stands for the name.
    prefix: int = 3
    codes: bool = False
    filename: bool = False


def plain(text: str) -> str:
    """Lower case, compatibility form, separators as single blanks."""
    text = unicodedata.normalize("NFKC", text).casefold()
    return re.sub(r"[\s_\-.#:,/]+", " ", text).strip()


def stem(value: str, rules: Rules) -> str:
    """The part of a value that can name an entry, without extension, take suffixes and running numbers.

    This is what values are reduced to before they are compared, so that the work follows the number of different
    spellings and not of values.
    """
    text = unicodedata.normalize("NFKC", value).strip()
    if rules.filename:
        text = re.sub(r"\.[A-Za-z][A-Za-z0-9]{1,3}$", "", text.strip())
        for _ in range(3):
            text = re.sub(r"(?:\s*\(\d+\)|[\s_\-.]*(?:v\d+|final|mastered|marked|fixed|copy|take\s*\d+))$", "", text, flags=re.I)
        text = re.sub(r"[\s_\-.]+\d+$", "", text)
    else:
        text = re.sub(r"(?<=[^\d\s])[\s_\-.#:]*\d+\s*$" if not re.search(r"[A-Za-z]\d\s*$", text) else r"[\s_\-.#:]*\d+\s*$", "", text)
    return plain(text)


def ordinal(text: str) -> tuple[str, str]:
    """A leading ordinal, as one digit, and the rest of a plain text."""
    first, _, rest = text.partition(" ")
    if rest and first in ORDINALS:
        return ORDINALS[first], rest
    glued = re.match(r"^([1-4])(?:st|nd|rd|th)?(?=[^\W\d_])(.*)$", text)
    return (glued[1], glued[2].strip()) if glued else ("", text)


def grams(text: str) -> dict[str, float]:
    """Character n-grams of a text: single letters, pairs, triples and pairs with one letter between them."""
    body = text.replace(" ", "")
    edged = f"^{body}$"
    found: dict[str, float] = {}
    for piece, weight in (
        *((edged[i : i + 2], 1.0) for i in range(len(edged) - 1)),
        *((edged[i : i + 3], 0.8) for i in range(len(edged) - 2)),
        *((edged[i] + "*" + edged[i + 2], 0.7) for i in range(len(edged) - 2)),
        *((c + "?", 0.35) for c in body),
    ):
        found[piece] = found.get(piece, 0.0) + weight
    return {g: min(w, 2 * w) if w < 2 else 1 + math.log(w) for g, w in found.items()}


def edits(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours that turn a into b."""
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        before, last = last, row
    return last[-1]


@dataclass
class Index:
    """Inverted index from character n-grams to spellings of the entries, with weights by rarity."""

    entries: list[tuple[int, str, str | None]]
    rules: Rules
    spellings: list[tuple[int, str, str, bool]] = field(default_factory=list)

    def __post_init__(self) -> None:
        bodies = {}
        for key, name, code in self.entries:
            number, body = ordinal(plain(name))
            bodies[key] = (number, body)
            self.spellings.append((key, number, body, True))
        seen: dict[tuple[str, str], set[int]] = {}
        for key, (number, body) in bodies.items():
            flat = body.replace(" ", "")
            for cut in range(self.rules.prefix, len(flat)):
                seen.setdefault((number, flat[:cut]), set()).add(key)
        for key, name, code in self.entries:
            if self.rules.codes and code:
                number, body = ordinal(plain(code))
                seen.setdefault((number, body), set()).add(key)
                if len(seen[number, body]) > 1:  # an entry's own code outranks another one's leading part
                    seen[number, body] = {key}
        self.short = {k: next(iter(v)) for k, v in seen.items() if len(v) == 1}
        frequency: dict[str, int] = {}
        made = [grams(body) for _, _, body, _ in self.spellings]
        for g in made:
            for piece in g:
                frequency[piece] = frequency.get(piece, 0) + 1
        n = len(made)
        self.rarity = {piece: 1 + math.log((1 + n) / (1 + f)) for piece, f in frequency.items()}
        self.unseen = 1 + math.log(1 + n)
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for i, g in enumerate(made):
            weights = {p: w * self.rarity[p] for p, w in g.items()}
            size = math.sqrt(sum(w * w for w in weights.values()))
            for p, w in weights.items():
                self.postings.setdefault(p, []).append((i, w / size))

    def cosines(self, body: str) -> dict[int, float]:
        weights = {p: w * self.rarity.get(p, self.unseen) for p, w in grams(body).items()}
        size = math.sqrt(sum(w * w for w in weights.values())) or 1.0
        scores: dict[int, float] = {}
        for p, w in weights.items():
            for i, v in self.postings.get(p, ()):
                scores[i] = scores.get(i, 0.0) + w * v / size
        return scores

    def readings(self, text: str) -> list[tuple[str, str]]:
        """The ways to read a plain text: with and without a leading phrase, an ordinal taken off, signs as letters."""
        out: list[tuple[str, str]] = []
        texts = [text]
        for phrase in LEADING:
            if text.startswith(phrase + " ") and len(text) > len(phrase) + 1:
                texts.append(text[len(phrase) + 1 :])
        for t in texts:
            number, body = ordinal(t)
            for b in (body, body.translate(SIGNS)):
                if b and (number, b) not in out:
                    out.append((number, b))
        return out

    def find(self, text: str) -> tuple[int, float]:
        """The entry meant by a stem, or 0, and its score."""
        best: dict[int, float] = {}
        close: dict[int, float] = {}
        for number, body in self.readings(text):
            flat = body.replace(" ", "")
            hit = self.short.get((number, flat))
            if hit is not None:
                best[hit] = max(best.get(hit, 0.0), 0.999)
                close[hit] = 0.0
            for i, score in self.cosines(body).items():
                key, own, name, _ = self.spellings[i]
                if own != number or score < 0.2:
                    continue
                if score > best.get(key, 0.0):
                    best[key] = score
                whole = name.replace(" ", "")
                gap = edits(flat, whole) / max(len(whole), 1)
                close[key] = min(close.get(key, 9.0), gap)
        # edits confirm candidates; of the confirmed ones the cosine decides, and edits again where it is a tie
        sure = {k: v for k, v in best.items() if v >= self.rules.threshold and close[k] <= self.rules.edits}
        if not sure:
            return 0, max(best.values(), default=0.0)
        most = max(sure.values())
        rivals = sorted((k for k, v in sure.items() if most - v < self.rules.margin), key=lambda k: (close[k], -sure[k], k))
        key = rivals[0]
        near = (k for k, v in best.items() if k != key and v >= self.rules.threshold and abs(v - sure[key]) < self.rules.margin)
        if any(close[k] - close[key] < self.rules.lead for k in near):
            return 0, most
        return key, sure[key]


def map_values(values: DataFrame, entries: list[tuple[int, str, str | None]], *, value: str, row_id: str, rules: Rules, case: Column | None = None) -> DataFrame:
    """(row_id, stem, entry, score) of the rows in `case` (by default those with a value): the entry meant, or 0.

    Null values take no part; blank ones come out as entry 0. Values are reduced to stems and each different stem is
    looked up once: n-gram postings give the candidates, the weighted cosine of their n-grams the score, which must reach
    a threshold, and the number of edits confirms them. The highest score is taken if it leads by a margin; of those within
    the margin the one of fewest edits, if these lead clearly. An entry whose leading ordinal differs from the value's is no candidate. Ties between entries leave the value unmatched. `entries` is the
    reference list, small by nature. Stems are counted with partial counts before the shuffle and looked up in the
    tasks; the mapping is then joined to the rows by stem, with the rows of a frequent stem salted, so that a value that
    fills a third of the table is not gathered in one task.
    """
    case = F.col(f"`{value}`").isNotNull() if case is None else case
    rows = values.where(case & F.col(f"`{value}`").isNotNull()).select(F.col(f"`{row_id}`").alias("__id"), F.col(f"`{value}`").alias("__value"))

    def stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            made = [known.get(v) or known.setdefault(v, stem(v, rules)) for v in coded.dictionary.to_pylist()]
            if len(known) > 200_000:
                known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string()).take(coded.indices)], ["__id", "stem"])

    stemmed = rows.mapInArrow(stems, rows.select("__id", F.lit("").alias("stem")).schema)
    salts = max(16, values.sparkSession.sparkContext.defaultParallelism)  # a hot stem is spread over all cores
    distinct = stemmed.groupBy("stem").agg(F.count("*").alias("n"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(entries, rules)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = [index.find(t) if t else (0, 0.0) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([k for k, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], ["stem", "n", "entry", "score"])

    mapped = distinct.mapInArrow(look, "stem string, n long, entry long, score double")
    mapped = mapped.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).drop("n")
    salted = stemmed.withColumn("__salt", F.pmod(F.xxhash64("__id"), F.lit(salts)).cast("int"))
    return salted.join(mapped, ["stem", "__salt"]).select(F.col("__id").alias(row_id), "stem", "entry", "score")
