"""Repairs text extracted from scanned pages: furniture, hyphenation, misrecognised characters, paragraphs."""

from __future__ import annotations

import difflib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a character may be misrecognised as, in lower case.
CONFUSIONS = [
    ("a", "4"), ("b", "8"), ("d", "cl"), ("e", "c"), ("f", "ſ"), ("g", "q"), ("h", "b"), ("i", "!"), ("i", "1"), ("i", "|"), ("in", "m"), ("l", "1"),
    ("l", "|"), ("m", "rn"), ("n", "ri"), ("o", "0"), ("r", "i"), ("rn", "m"), ("s", "5"), ("t", "f"), ("u", "ii"), ("ü", "ii"), ("v", "y"), ("w", "vv"), ("y", "v"),
    ("ä", 'a"'), ("ö", 'o"'), ("ü", 'u"'), ("á", "a'"), ("é", "e'"), ("í", "i'"), ("ó", "o'"), ("ú", "u'"), ("ñ", "n~"),
]
#: Strokes shared by characters that are taken for each other; a text and its misreadings have equal strokes.
STROKES = str.maketrans(
    {
        "1": "i", "!": "i", "|": "i", "l": "i", "r": "i", "n": "ii", "u": "ii", "ü": "ii", "m": "iii", "w": "vv", "y": "v", "d": "ci", "e": "c", "b": "h",
        "8": "h", "4": "a", "0": "o", "5": "s", "t": "f", "ſ": "f", "q": "g", "ä": "a", "ö": "o", "á": "a", "é": "c", "í": "i", "ó": "o", "ú": "ii", "ñ": "ii", "'": "", '"': "", "~": "",
    }
)
#: The marks at a broken line's end, and the words for chapter and page.
MARKS = "-‐­¬"
CHAPTER = r"(?:chapter|capítulo|capitulo|kapitel|अध्याय|глава)"
PAGE = r"(?:p\.|pp\.|page|pág\.|página|seite|s\.|पृष्ठ|стр\.)"
EDGE = ".,;:?\"'()[]।“”‘’«»¿¡…"
DIGIT = "0-9०-९"
DIGITS = str.maketrans("०१२३४५६७८९lOoISs|!B", "0123456789100155118")
ROMAN = re.compile(r"^m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")
NUMBER = rf"[{DIGIT}lOoISs|!]*[{DIGIT}][{DIGIT}lOoISs|!]*"
PAGE_FORMS = re.compile(rf"^(?:\[\s*(\S+)\s*\]|[-–—~]\s*(\S+)\s*[-–—~]|{PAGE}\s*(\S+))$", re.I)
BARE = re.compile(rf"^({NUMBER}|[ivxlc!1|]{{1,7}})([.:)\]]?)$", re.I)
INLINE = re.compile(rf"^([{DIGIT}]+)\s*[.:)\]]?\s+\S")
TITLE = re.compile(rf"^{CHAPTER}\s+[{DIGIT}]+$", re.I)
WIDE = re.compile(r"\s\s|[^\S ]")
DIGITS_RUN = re.compile(rf"[{DIGIT}]+")
WHOLE_NUMBER = re.compile(NUMBER)
SPLIT_PAGE = re.compile(r"^(?:(\S+)\s{2,}(\S.*)|(.*\S)\s{2,}(\S+))$")


#: In streams: a line's end, one with a mark before it, and what parts words there.
LINE, MARKED = "\n", "\r"
BETWEEN = frozenset(EDGE.replace("'", "").replace('"', "") + " " + LINE + MARKED)
QUOTES = frozenset("'\"")
STROKE_OF = {chr(k): v for k, v in STROKES.items()}
#: A reading of a stream: (from, to, kind, ...) of each step.
Reading = list[tuple]


def strokes(text: str) -> str:
    return text.lower().translate(STROKES)


def is_roman(text: str) -> bool:
    text = text.lower().translate(str.maketrans("!1|", "iii"))
    return bool(text) and bool(ROMAN.match(text))


def page_number(text: str) -> str | None:
    """'form' for a number in a page number's form, 'bare' for a number or Roman numeral alone, None otherwise."""
    parts = text.split(None, 3)
    if len(parts) > 3:  # no form has more parts
        return None
    m = PAGE_FORMS.match(text)
    if m is None and len(parts) == 2 and strokes(parts[0]) in {strokes("page"), strokes("seite"), strokes("p.")}:
        inner = parts[1]
    elif m:
        inner = next(g for g in m.groups() if g is not None)
    else:
        m = BARE.match(text)
        if m is None:
            return None
        if is_roman(m[1]) and not m[1].isdigit():
            return "form" if m[2] in ("", ".") else None
        return "bare" if any(c.isdigit() for c in m[1]) else None
    return "form" if re.fullmatch(NUMBER, inner) or re.fullmatch(r"[lOoISs|!]+", inner) or is_roman(inner) else None


def as_int(text: str) -> int | None:
    digits = text.translate(DIGITS)
    return int(digits) if digits.isascii() and digits.isdigit() and len(digits) < 12 else None


def derivation(true: str, seen: str, most: int) -> list[int] | None:
    """Where in `seen` misreadings of `true` stand, by fewest confusions; None if `seen` can't come from `true`."""
    best: dict[tuple[int, int], tuple[int, tuple]] = {(0, 0): (0, ())}
    for i in range(len(true) + 1):
        for j in range(len(seen) + 1):
            if (i, j) not in best:
                continue
            cost, spots = best[i, j]
            moves = [(1, 1, 0)] if i < len(true) and j < len(seen) and true[i] == seen[j] else []
            moves += [(len(a), len(b), 1) for a, b in CONFUSIONS if true.startswith(a, i) and seen.startswith(b, j)]
            for a, b, extra in moves:
                new = cost + extra
                if new <= most and new < best.get((i + a, j + b), (99, ()))[0]:
                    best[i + a, j + b] = (new, (*spots, j) if extra else spots)
    got = best.get((len(true), len(seen)))
    return None if got is None else list(got[1])


class Lexicon:
    """Counted words of the corpus, the misreadings among them set apart, as a trie of strokes: words and their misreadings
    have equal strokes, so a stream of characters is looked up letter by letter without branching."""

    #: Costs in nats: a misread character, a blank lost or put in, a line's end within a word without a mark, a mark dropped
    #: or kept there, a sign between words, and an unknown word, each letter of it, each other character, and each beyond
    #: the length of most words.
    MISREAD, LOST, STRAY, BREAK, MARK, SIGN, UNKNOWN, LETTER, OTHER, BEYOND, USUAL = 5.0, 7.0, 7.0, 1.0, 0.5, 0.2, 7.0, 2.2, 7.0, 1.1, 12

    def __init__(self, counts: dict[str, int], ratio: float = 25.0):
        self.counts, self.total = counts, max(sum(counts.values()), 1)
        self.by_strokes: dict[str, list[str]] = {}
        for w in counts:
            self.by_strokes.setdefault(strokes(w), []).append(w)
        self.misread: dict[str, str] = {}
        for words in self.by_strokes.values():
            if len(words) > 1:
                words.sort(key=lambda w: (-counts[w], w))
                for w in words[1:]:
                    for v in words:
                        enough = counts[v] >= ratio * counts[w] or (counts[w] <= 3 and counts[v] >= 4 * counts[w])
                        if v != w and enough and v not in self.misread and derivation(v, w, 4):
                            self.misread[w] = v
                            break
        self.prefixes = {k[:i] for k in self.by_strokes for i in range(1, len(k) + 1)}
        self.cost = {w: -math.log(n / self.total) for w, n in counts.items() if w not in self.misread}
        # pairs of known words that are read as one
        self.pairs = {(w[:i], w[i:]) for w, c in self.cost.items() for i in range(1, len(w)) if w[:i] in self.cost and w[i:] in self.cost and c + self.STRAY < self.cost[w[:i]] + self.cost[w[i:]]}
        self.lefts = {a for a, _ in self.pairs}
        self.cache: dict[str, tuple[str, list[int]] | None] = {}
        self.clean: dict[str, tuple[bool, str, str]] = {}
        self.windows: dict[str, Reading] = {}

    def known(self, word: str) -> bool:
        return word in self.cost

    def settled(self, token: str) -> tuple[bool, str, str]:
        """Whether a token, with the signs around it, is a known word or holds no letters; and its word, if nothing stands
        behind it, and before it."""
        got = self.clean.get(token)
        if got is None:
            if len(self.clean) > 200_000:
                self.clean.clear()
            body = token.strip(EDGE).lower()
            got = self.clean[token] = (body in self.cost or not any(map(str.isalpha, body)), body if token[-1:] not in EDGE else "", body if token[:1] not in EDGE else "")
        return got

    def decode(self, word: str) -> tuple[str, list[int]] | None:
        """The word meant by a whole piece, and where it is misread (nowhere if it is known); None if nothing fits.

        Of the words with the same strokes from which it can come, the one of the least cost: its own, by its frequency,
        and that of the misread characters.
        """
        if word in self.cost:
            return word, []
        if word in self.cache:
            return self.cache[word]
        best = None
        for v in self.by_strokes.get(strokes(word), ()):
            if v != word and v in self.cost:
                spots = derivation(v, word, max(2, len(word) // 2))
                if spots is not None:
                    cost = self.cost[v] + self.MISREAD * len(spots)
                    if best is None or cost < best[0]:
                        best = (cost, v, spots)
        got = None if best is None else (best[1], best[2])
        if len(self.cache) > 200_000:
            self.cache.clear()
        self.cache[word] = got
        return got

    def read(self, stream: str) -> Reading:
        """The best joint reading of a stream of characters, see `_viterbi`; equal streams are read once."""
        got = self.windows.get(stream)
        if got is None:
            if len(self.windows) > 100_000:
                self.windows.clear()
            got = self.windows[stream] = self._viterbi(stream)
        return got

    def words_from(self, low: str, at: int) -> Iterator[tuple[int, str, list[int], float, list[tuple[int, str]]]]:
        """Known words that a stream may hold from a place on: (end, word, misread places, cost, line ends within it with
        what becomes of a mark there). Blanks and line ends are passed over; a mark before a line's end is dropped or kept."""
        n = len(low)
        stack: list[tuple[int, str, tuple[int, ...], float, tuple[tuple[int, str], ...]]] = [(at, "", (), 0.0, ())]
        while stack:
            j, shape, places, extra, breaks = stack.pop()
            while j < n:
                c = low[j]
                if c == " " or c == LINE:
                    if not places or j + 1 >= n or low[j + 1] in BETWEEN:
                        break
                    extra += self.STRAY + (self.BREAK if c == LINE else 0.0)
                    breaks += ((j, ""),) if c == LINE else ()
                    j += 1
                    continue
                if c == MARKED:
                    if not places or j + 1 >= n or low[j + 1] in BETWEEN:
                        break
                    if shape + "-" in self.prefixes:
                        stack.append((j + 1, shape + "-", (*places, j), extra + self.MARK, (*breaks, (j, "-"))))
                    extra += self.MARK
                    breaks += ((j, "drop"),)
                    j += 1
                    continue
                shape += STROKE_OF.get(c, c)
                if shape and shape not in self.prefixes:
                    break
                places += (j,)
                j += 1
                if shape in self.by_strokes:
                    seen = "".join("-" if low[k] == MARKED else low[k] for k in places)
                    got = self.decode(seen)
                    if got is not None:
                        yield j, got[0], [places[k] for k in got[1]], self.cost[got[0]] + self.MISREAD * len(got[1]) + extra, list(breaks)

    def _viterbi(self, stream: str) -> Reading:
        """The cheapest path through a stream: known words as they are, with misread characters, over stray blanks and line
        ends, with or without the mark there; blanks put in between words where they were lost; signs; unknown words, which
        end where blanks or signs are, or go on over a marked line end."""
        n, low = len(stream), stream.lower()
        if len(low) != n:
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in stream)
        best: list[float] = [0.0] + [math.inf] * n
        back: list[tuple | None] = [None] * (n + 1)
        letter = [c not in BETWEEN for c in low] + [False]
        inner = [0 < i < n and letter[i] and letter[i - 1] and low[i] not in QUOTES and low[i - 1] not in QUOTES for i in range(n + 1)]  # no blank or sign here
        spelled = list(accumulate((self.OTHER if c.isdigit() or c in "!|~" else self.LETTER for c in low), initial=0.0))
        ends = [n] * (n + 1)  # where the letters from here on end
        for i in range(n - 1, -1, -1):
            ends[i] = ends[i + 1] if letter[i] and letter[i + 1] else i + 1 if letter[i] else i

        def reach(i: int, j: int, cost: float, what: tuple) -> None:
            cost += best[i] + (self.LOST if inner[j] else 0.0)
            if cost < best[j]:
                best[j], back[j] = cost, (i, *what)

        for i in range(n):
            if best[i] == math.inf:
                continue
            c = low[i]
            if c == " " or c == LINE:
                reach(i, i + 1, 0.0, ("blank",))
                continue
            if not c.isalnum():
                reach(i, i + 1, self.SIGN if c in EDGE or c == "!" else 2.0, ("sign",))
            if c == MARKED:
                continue
            for j, word, spots, cost, breaks in self.words_from(low, i):
                reach(i, j, cost, ("word", word, spots, breaks))
            if letter[i]:
                j, cost, marks = ends[i], self.UNKNOWN + spelled[ends[i]] - spelled[i], []
                while True:
                    reach(i, j, cost + self.BEYOND * max(0, j - i - self.USUAL), ("unknown", marks))
                    if j >= n or low[j] != MARKED or not letter[j + 1]:
                        break
                    marks = [*marks, (j, "open")]
                    cost += self.MARK + spelled[ends[j + 1]] - spelled[j + 1]
                    j = ends[j + 1]
        out, j = [], n
        while j:
            i, *what = back[j]
            out.append((i, j, *what))
            j = i
        return out[::-1]


def word_counts(scripts: DataFrame, text: str = "raw_text", least_share: float = 2e-6) -> dict[str, int]:
    """Counts of the words of all lines, those of at least 2 and of `least_share` of all words.

    A line's first word and a broken last one are left out, being parts of words at times. At most 1 / least_share words
    reach the share, which bounds what is sent to the tasks. Counted with partial counts before the shuffle.
    """
    lines = scripts.select(F.explode(F.split(F.col(f"`{text}`"), "\n")).alias("line"))
    words = lines.select(F.posexplode(F.split(F.trim("line"), " ")).alias("pos", "word")).where("pos > 0 AND word <> ''")
    # a word that ends in a mark stands at a line's end; plain trimming is far cheaper here than a pattern for each word
    words = words.where(~F.substring("word", -1, 1).isin(*MARKS)).select(F.lower(F.btrim("word", F.lit(EDGE))).alias("w"))
    words = words.groupBy("w").agg(F.count("*").alias("n")).where(F.col("w").rlike(r"(?U)\p{L}"))
    words = words.persist()
    total = words.agg(F.sum("n")).first()[0] or 0
    least = max(2, math.ceil(total * least_share))
    counts: dict[str, int] = {}
    for r in words.where(F.col("n") >= least).collect():
        w = unicodedata.normalize("NFC", r.w)
        counts[w] = counts.get(w, 0) + r.n
    words.unpersist()
    return counts


class Names:
    """Names to be masked in lines; an automaton tells first whether a line holds any."""

    def __init__(self, names: list[str]):
        ordered = sorted({n for n in names if n}, key=lambda n: (-len(n), n))
        self.pattern = re.compile("|".join(map(re.escape, ordered)), re.I) if ordered else None
        self.any = ahocorasick.Automaton()
        for n in ordered:
            self.any.add_word(n.lower(), 1)
        if ordered:
            self.any.make_automaton()

    def mask(self, text: str) -> str:
        if self.pattern is None or next(self.any.iter(text.lower()), None) is None:
            return text
        return self.pattern.sub("◊", text)


def masked(line: str, names: Names) -> str:
    text = line.strip()
    if WIDE.search(text):
        text = re.sub(r"\s+", " ", text)
    return DIGITS_RUN.sub("9", names.mask(text))


def without_page(line: str) -> str | None:
    """A line without the page number at its start or end, set apart by a wide gap; None if it has none."""
    m = SPLIT_PAGE.match(line.strip())
    if not m:
        return None
    number, rest = (m[1], m[2]) if m[1] else (m[4], m[3])
    got = page_number(number)
    if got is None:  # both ends may be wide
        end = re.match(r"^(.*\S)\s{2,}(\S+)$", line.strip())
        if end and page_number(end[2]):
            return end[1]
        return None
    return rest


def page_lines(stripped: list[str]) -> tuple[list[bool], list[int], list[bool]]:
    """(which lines are page numbers, the lines with a number alone, which of these are verse numbers).

    Verses written in their lines leave the numbers alone to pages, unless those count up from 1 as well.
    """
    forms = [page_number(x) if x and not TITLE.match(x) else None for x in stripped]
    bare = [i for i, f in enumerate(forms) if f == "bare"]
    flags = split_numbers([as_int(re.sub(r"[.:)\]]$", "", stripped[i])) for i in bare]) if bare else []
    inline = sum(1 for x, f in zip(stripped, forms) if x and f is None and INLINE.match(x) and not TITLE.match(x))
    if inline > sum(flags):
        flags = [False] * len(bare)
    pages = [f == "form" for f in forms]
    for i, is_verse in zip(bare, flags):
        pages[i] = not is_verse
    return pages, bare, flags


def may_be_header(line: str) -> bool:
    """Whether a line doesn't end as sentences or broken lines do, and is no title."""
    return line[-1] not in ".,;!?।" and line[-1] not in MARKS and not TITLE.match(line)


def beside(stripped: list[str], pages: list[bool]) -> set[int]:
    """The lines nearest to page numbers, above and below, blank ones left out."""
    at = set()
    for i in (i for i, p in enumerate(pages) if p):
        for step in (-1, 1):
            k = i + step
            while 0 <= k < len(stripped) and not stripped[k]:
                k += step
            if 0 <= k < len(stripped) and not pages[k]:
                at.add(k)
    return at


def header_bodies(stripped: list[str], pages: list[bool], names: Names) -> Counter[str]:
    """Counts of what may be a running header beside page numbers, with names and numbers masked: the nearest lines above
    and below that aren't blank, and what stands in a line with a page number."""
    at, bodies = beside(stripped, pages), []
    for i, line in enumerate(stripped):
        rest = without_page(line) if WIDE.search(line) else None
        if rest is not None:
            bodies.append(rest)
        elif i in at:
            bodies.append(line)
    return Counter(masked(x, names) for x in bodies if may_be_header(x))


def header_templates(scripts: DataFrame, names: list[str], text: str = "raw_text", least_share: float = 0.001) -> list[str]:
    """Lines, with names and numbers masked, that stand beside page numbers in at least `least_share` of the scripts, 3 at
    least. A script's own headers, which recur within it, need no template (see classify).

    A running header stands right above or below a page number, but for blank lines, or in its line. Lines that end as
    sentences do are not taken, nor those that mostly stand elsewhere, of all their places in all scripts. Each script
    counts a template once, so there are at most (templates of a script) / least_share of them. Lines are counted by hash,
    with partial counts before the shuffle; only those seen beside a page number go along as text.
    """
    pattern = Names(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[int, list] = {}
            for raw in batch.column(0).to_pylist():
                stripped = [x.strip() for x in (raw or "").split("\n")]
                near = header_bodies(stripped, page_lines(stripped)[0], pattern)
                every = Counter(masked(x, pattern) for x in stripped if x and may_be_header(x))
                for t in near.keys() | every.keys():
                    was = counts.setdefault(xxhash.xxh64_intdigest(t) - 2**63, [None, 0, 0, 0])
                    if near[t]:
                        was[:3] = t, was[1] + 1, was[2] + near[t]
                    was[3] += max(near[t], every[t])
            columns = [pa.array([v[k] for v in counts.values()], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), *columns], ["h", "template", "n", "near", "all"])

    total = scripts.count()
    found = scripts.select(F.col(f"`{text}`")).mapInArrow(run, "h long, template string, n long, near long, all long")
    found = found.groupBy("h").agg(F.max("template").alias("template"), F.sum("n").alias("n"), F.sum("near").alias("near"), F.sum("all").alias("all"))
    least = max(3, math.ceil(total * least_share))
    return sorted(r.template for r in found.where((F.col("n") >= least) & (F.col("near") >= 0.3 * F.col("all"))).select("template").collect())


class Furniture:
    """Tells running headers, also misread ones, by templates and by strokes."""

    def __init__(self, templates: list[str], names: list[str]):
        self.pattern, self.templates = Names(names), set(templates)
        self.shapes: set[str] = set()
        for t in templates:
            for n in names if "◊" in t else [""]:
                self.shapes.add(self._shape(t.replace("◊", n)))
        by_size: dict[int, list[str]] = {}
        for s in self.shapes:
            by_size.setdefault(len(s), []).append(s)
        self.by_size = {k: sorted(v) for k, v in by_size.items()}
        self.openings = {s[:3] for s in self.shapes}
        self.cache: dict[str, bool] = {}
        self.begins: dict[str, bool] = {}

    @staticmethod
    def _shape(text: str) -> str:
        return " ".join("9" if WHOLE_NUMBER.fullmatch(w) else strokes(w) for w in text.split())

    def opens(self, line: str) -> bool:
        """Whether a header begins like a line, by its first words' strokes; remembered by the first word where it is long."""
        first = line.split(None, 1)[0]
        got = self.begins.get(first)
        if got is None:
            if len(self.begins) > 100_000:
                self.begins.clear()
            shape = self._shape(first)
            if len(shape) < 3:
                return self._shape(" ".join(line.split(None, 2)[:2]))[:3] in self.openings
            got = self.begins[first] = shape[:3] in self.openings
        return got

    def is_header(self, line: str, near: bool) -> bool:
        if not near and not self.opens(line):
            return False
        if masked(line, self.pattern) in self.templates:
            return True
        shape = self._shape(line)
        if shape in self.shapes:
            return True
        if not near or len(shape) < 8 or line[-1] in ".,;:?।" or line[-1] in MARKS:
            return False
        if shape not in self.cache:
            if len(self.cache) > 50_000:
                self.cache.clear()
            match = difflib.SequenceMatcher(None, "", shape, autojunk=False)
            hit = False
            for size in range(len(shape) - 3, len(shape) + 4):
                for s in self.by_size.get(size, ()):
                    match.set_seq1(s)
                    if match.real_quick_ratio() >= 0.86 and match.quick_ratio() >= 0.86 and match.ratio() >= 0.86:
                        hit = True
                        break
                if hit:
                    break
            self.cache[shape] = hit
        return self.cache[shape]


def split_numbers(numbers: list[int | None]) -> list[bool]:
    """For numbers standing alone on lines, which of them are verse numbers (the others are page numbers).

    Both kinds rise by one. The best division into two such runs is found over states (last verse, last page). Going on from
    another state costs 7 more at most, so what is dearer than the best by more can't be part of the best.
    """
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, -1): (0.0, ())}
    for n in numbers:
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (verse, page), (cost, back) in states.items():
            if n is None:
                options = [((verse, page + 1 if page >= 0 else -1), cost + 0.5, False)]
            else:
                options = [((n, page), cost + (0.0 if n == verse + 1 else 1.5 if verse < n <= verse + 3 else 4.0), True)]
                options.append(((verse, n), cost + (0.0 if n == page + 1 and page >= 0 else 0.9 if page < 0 else 3.0), False))
            for key, value, is_verse in options:
                if key not in new or value < new[key][0]:
                    new[key] = (value, (back, is_verse))
        least = min(c for c, _ in new.values())
        states = {k: v for k, v in new.items() if v[0] <= least + 7.0}
    back = min(states.values(), key=lambda x: x[0])[1]
    out = []
    while back:
        back, kind = back
        out.append(kind)
    return out[::-1]


def classify(lines: list[str], furniture: Furniture) -> tuple[list[str], list[int | None]]:
    """For each line blank, furniture, title, verse (a number alone) or text; and the verse number it opens.

    Besides the learned headers, a line that recurs within the script, three times and mostly beside page numbers, is one.
    """
    n = len(lines)
    kinds, verses = ["text"] * n, [None] * n
    stripped = [x.strip() for x in lines]
    pages, bare, flags = page_lines(stripped)
    for i, line in enumerate(stripped):
        if not line:
            kinds[i] = "blank"
        elif TITLE.match(line):
            kinds[i] = "title"
        elif pages[i]:
            kinds[i] = "furniture"
    for i, is_verse in zip(bare, flags):
        if is_verse:
            kinds[i], verses[i] = "verse", as_int(re.sub(r"[.:)\]]$", "", stripped[i]))
    own = set()
    if sum(pages) >= 3 and (often := {t: k for t, k in header_bodies(stripped, pages, furniture.pattern).items() if k >= 3 and t not in furniture.templates}):
        every = Counter(masked(x, furniture.pattern) for x in stripped if x)
        own = {t for t, k in often.items() if k >= 0.6 * every[t]}
    at = beside(stripped, pages) if own else set()
    for i, line in enumerate(stripped):
        if kinds[i] == "text":
            near = any(0 <= k < n and kinds[k] == "furniture" for k in (i - 1, i + 1)) or i == 0 or i == n - 1
            rest = without_page(line)
            if furniture.is_header(line, near) or (rest is not None and furniture.is_header(rest, True)) or ((i in at or (own and rest is not None)) and masked(line if rest is None else rest, furniture.pattern) in own):
                kinds[i] = "furniture"
            elif m := INLINE.match(line):
                verses[i] = as_int(m[1])
    return kinds, verses


def cased(word: str, like: str) -> str:
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() or (like[:1] in "|8501!4" and len(like) > 1 and like[1:2].isupper()) else word


class Token:
    """A token of a content line, and what parts it from the next one: a blank, a line's end, a marked one, or None."""

    __slots__ = ("line", "text", "mark", "gap", "fixed")

    def __init__(self, line: int, text: str, fixed: bool):
        self.line, self.text, self.mark, self.gap, self.fixed = line, text, "", " ", fixed


def runs(lines: list[str], kinds: list[str], verses: list[int | None], content: list[int]) -> Iterator[list[Token]]:
    """The content without line ends and furniture: tokens that may run on, up to a title, a verse number or the end."""
    run: list[Token] = []
    for k, i in enumerate(content):
        words = unicodedata.normalize("NFC", lines[i]).split()
        tokens = [Token(i, w, p == 0 and verses[i] is not None) for p, w in enumerate(words)]
        if not tokens:
            continue
        run += tokens
        j = content[k + 1] if k + 1 < len(content) else None
        if j is None or kinds[i] != "text" or kinds[j] != "text" or verses[j] is not None:
            run[-1].gap = None
            yield run
            run = []
            continue
        last = run[-1]
        last.gap = LINE
        if last.text[-1] in MARKS and len(last.text) > 1 and not last.fixed:
            last.text, last.mark, last.gap = last.text[:-1], last.text[-1], MARKED
    if run:
        run[-1].gap = None
        yield run


def windows(run: list[Token], lexicon: Lexicon) -> Iterator[tuple[int, int]]:
    """The stretches of a run that must be decoded: tokens that are no known words, broken ones, known ones that make up one
    word, and the neighbours that could belong to the same word. Between known words that can't be joined every reading
    has a word's limit, so nothing outside is decided by them."""
    n, at = len(run), 0
    state = [(True, "", "") if t.fixed else lexicon.settled(t.text) for t in run]

    def may_join(k: int) -> bool:
        """Whether a word may begin in token k and go on in the next one."""
        if k < 0 or k + 1 >= n or run[k].fixed or run[k + 1].fixed or not state[k][1] or not state[k + 1][2]:
            return False
        return strokes(state[k][1]) + strokes(state[k + 1][2][0]) in lexicon.prefixes

    k = 0
    while k < n:
        joined = run[k].gap == MARKED or (state[k][1] in lexicon.lefts and k + 1 < n and not run[k + 1].fixed and (state[k][1], state[k + 1][2]) in lexicon.pairs)
        if state[k][0] and not joined:
            k += 1
            continue
        a, b = k, k
        while a > at and (run[a - 1].gap == MARKED or may_join(a - 1)):
            a -= 1
        while b + 1 < n and (run[b].gap == MARKED or (joined and b == k) or may_join(b) or (not state[b + 1][0] and not run[b + 1].fixed and b + 1 < n and run[b].gap != LINE)):
            b += 1
        yield a, b + 1
        k = at = b + 1


def repair(raw: str, lexicon: Lexicon, furniture: Furniture) -> tuple[list[tuple[int, str]], list[tuple[int | None, str]]]:
    """The disturbed lines (number, kind of noise), and the paragraphs (verse, text) of one script."""
    lines = raw.split("\n")
    kinds, verses = classify(lines, furniture)
    found: list[tuple[int, str]] = [(i + 1, "furniture") for i, k in enumerate(kinds) if k == "furniture"]
    content = [i for i, k in enumerate(kinds) if k in ("text", "title", "verse")]
    glyph: set[int] = set()
    fixed: dict[int, list[str]] = {i: [] for i in content}
    for run in runs(lines, kinds, verses, content):
        at = 0
        for a, b in windows(run, lexicon):
            for t in run[at:a]:
                fixed[t.line].append(t.text)
            at = b
            decode(run[a:b], lexicon, fixed, glyph, found)
        for t in run[at:]:
            fixed[t.line].append(t.text)
    found += [(i + 1, "glyph") for i in sorted(glyph)]
    return found, paragraphs(lines, kinds, verses, content, fixed)


def decode(tokens: list[Token], lexicon: Lexicon, fixed: dict[int, list[str]], glyph: set[int], found: list[tuple[int, str]]) -> None:
    """Reads a stretch of tokens as one stream; adds its words to their lines, and the lines with noise. A word that runs
    over a line's end comes to stand in the later line."""
    stream, owner, marks = "", [], {}
    for k, t in enumerate(tokens):
        owner += [t.line] * (len(t.text) + 1)
        stream += t.text
        if k + 1 < len(tokens):
            stream += t.gap or " "
            if t.gap == MARKED:
                marks[len(stream) - 1] = t.mark
    tail = tokens[-1]
    reading, out = lexicon.read(stream), ""

    def flush(line: int) -> None:
        nonlocal out
        if out:
            fixed[line].append(out)
            out = ""

    for step, (i, j, kind, *what) in enumerate(reading):
        if kind == "blank":
            flush(owner[i])
        elif kind == "sign" and i in marks:
            before = reading[step - 1] if step else None
            behind = reading[step + 1] if step + 1 < len(reading) else None
            left = stream[before[0] : i] if before and before[2] in ("word", "unknown") else ""
            right = stream[j : behind[1]] if behind and behind[2] in ("word", "unknown") else ""
            hyphen = broken(left, right, marks[i], lexicon)
            if hyphen is None:
                out += marks[i]
                flush(owner[i])
            else:
                out += "" if hyphen else "-"
                if hyphen:
                    found.append((owner[i] + 1, "hyphen"))
        elif kind == "sign":
            out += stream[i]
        else:
            kept = []
            spots, breaks = (what[1], what[2]) if kind == "word" else ((), what[0])
            ends = dict(breaks)
            start = i
            for k in range(i, j):
                if k not in ends:
                    if stream[k] != " ":
                        kept.append(stream[k])
                    continue
                if ends[k] == "open":
                    nxt = next((x for x in sorted(ends) if x > k), j)
                    hyphen = broken(stream[start:k], stream[k + 1 : nxt], marks[k], lexicon)
                    start = k + 1
                    if hyphen is None:
                        kept.append(marks[k] + " ")
                        continue
                    ends[k] = "drop" if hyphen else "-"
                if ends[k] == "drop":
                    found.append((owner[k] + 1, "hyphen"))
                elif ends[k] == "-":
                    kept.append("-")
            text = "".join(kept)
            glyph.update(owner[k] for k in spots)
            out += cased(what[0], text) if spots else text
            if j < len(stream) and stream[j] not in BETWEEN and reading[step + 1][2] != "sign":
                out += " "
    if tail.gap == MARKED:
        out += tail.mark
    flush(tail.line)


def broken(left: str, right: str, mark: str, lexicon: Lexicon) -> bool | None:
    """Whether a mark at a line's end parts an unknown word; False for a compound's own hyphen, None if neither is likely."""
    if not left or not right:
        return None
    a, b = lexicon.decode(left.lower()), lexicon.decode(right.lower())
    compound = mark == "-" and "-" not in left and a and b and len(left) > 3 and len(right) > 3
    if not compound and (right[0].islower() or not right[0].isalpha()):
        return True
    return False if a and b else None


def paragraphs(lines: list[str], kinds: list[str], verses: list[int | None], content: list[int], fixed: dict[int, list[str]]) -> list[tuple[int | None, str]]:
    """Paragraphs by dynamic programming over the places between content lines.

    A boundary is rewarded for a verse number, a title, a blank line that is not a page break's and a short last line
    that ends a sentence, and charged elsewhere; a paragraph is charged if it ends within a sentence or is very long.
    """
    m = len(content)
    if not m:
        return []
    width = sorted(len(lines[i].rstrip()) for i in content)[int(m * 0.9) if m > 1 else 0]
    gain = [0.0] * (m + 1)
    for k in range(1, m):
        i, before = content[k], content[k - 1]
        last = lines[before].rstrip()
        blank = any(kinds[x] == "blank" for x in range(before + 1, i)) and not any(kinds[x] == "furniture" for x in range(before + 1, i))
        g = -2.0
        g += 6.0 if verses[i] is not None or kinds[i] != "text" or kinds[before] == "title" else 0.0
        g += 2.5 if blank else 0.0
        g += 1.0 if len(last) < 0.8 * width and last[-1:] in ".?!।" else 0.0
        g -= 8.0 if kinds[before] == "verse" else 0.0
        g -= 4.0 if last[-1:] not in ".?!।;:" and verses[i] is None and kinds[i] == "text" and not blank else 0.0
        gain[k] = g
    best, back, top = [0.0] * (m + 1), [0] * (m + 1), [0.0] * (m + 1)  # top: the best value with a boundary there or before
    for k in range(1, m + 1):
        best[k] = -math.inf
        for j in range(k - 1, -1, -1):
            length = 0.002 * max(0, k - j - 20) ** 2
            if top[j] - length <= best[k]:
                break  # no earlier boundary can be better
            value = best[j] + (gain[j] if j else 0.0) - length
            if value > best[k]:
                best[k], back[k] = value, j
        top[k] = max(top[k - 1], best[k] + gain[k])
    cuts, k = [], m
    while k:
        cuts.append((back[k], k))
        k = back[k]
    out: list[tuple[int | None, str]] = []
    for a, b in reversed(cuts):
        rows = content[a:b]
        verse = next((verses[i] for i in rows if verses[i] is not None), None)
        pieces: list[str] = []
        for i in rows:
            if kinds[i] == "verse":
                continue
            tokens = fixed[i]
            if verses[i] is not None and tokens:
                rest = re.sub(rf"^[{DIGIT}]+\s*[.:)\]]?\s*", "", " ".join(tokens))
                tokens = rest.split()
            pieces += tokens
        out.append((verse, " ".join(pieces)))
    return out


_ready: tuple = (None, None, None)


def _tools(shared: tuple) -> tuple[Lexicon, Furniture]:
    """The lexicon and furniture of what was sent to a Python worker, made once there."""
    global _ready
    if _ready[0] is not shared:
        _ready = (shared, Lexicon(shared[0]), Furniture(shared[1], shared[2]))
    return _ready[1:]


def repair_scripts(scripts: DataFrame, names: list[str], *, key: str = "script_id", text: str = "raw_text") -> DataFrame:
    """(key, noise array<struct<line_no, noise>>, paragraphs array<struct<para_no, verse, text>>) of each script.

    The words and running headers of all scripts are learned first (see word_counts and header_templates, which say why
    what is sent to the tasks is bounded). The content without furniture and line ends is then one stream of characters,
    from title or verse number to the next, and is decoded jointly into known words (see Lexicon): misread characters, words
    split by blanks or line ends, with or without a mark, words run together, and unknown words compete in one path. Hyphen
    and glyph lines are read off it. Known words of which no two make up one end every path, so only what lies between
    them is searched. Paragraphs are cut by dynamic programming. Words rarer than word_counts says are unknown words.

    A null or empty text gives empty arrays, and repeated scripts are repaired each. `names` are the titles that running
    headers may hold. Other columns don't matter.
    """
    rows = scripts.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("raw"))
    counts = word_counts(rows, "raw")
    templates = header_templates(rows, names, "raw")
    kind = "key {}, noise array<struct<line_no:bigint,noise:string>>, paragraphs array<struct<para_no:bigint,verse:bigint,text:string>>"
    schema = kind.format(rows.schema["key"].dataType.simpleString())
    shared = scripts.sparkSession.sparkContext.broadcast((counts, templates, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, furniture = _tools(shared.value)
        noise_type = pa.list_(pa.struct([("line_no", pa.int64()), ("noise", pa.string())]))
        para_type = pa.list_(pa.struct([("para_no", pa.int64()), ("verse", pa.int64()), ("text", pa.string())]))
        for batch in batches:
            made = [repair(t, lexicon, furniture) if t else ([], []) for t in batch.column(1).to_pylist()]
            noise = pa.array([[{"line_no": n, "noise": k} for n, k in a] for a, _ in made], noise_type)
            paras = pa.array([[{"para_no": p, "verse": v, "text": t} for p, (v, t) in enumerate(b, 1)] for _, b in made], para_type)
            yield pa.RecordBatch.from_arrays([batch.column(0), noise, paras], ["key", "noise", "paragraphs"])

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
