"""Finds template residue: unfilled placeholders, filler and stubs, error pages and notices that scripts are required."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .residue_pages import LOREM, SEGMENT, PageTemplates, automaton, dummy_share, isolation, page_cover, parts, plain, seeded, whole

#: Forms in which template languages, mail merges and authors write a value that is still to come.
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{1,300}\}\}|\$\{[^{}\n]{1,300}\}|\{%[^%\n]{1,300}%\}|<%=?[^%\n]{1,300}%>|\[\[[^\[\]\n]{1,300}\]\]|<<[^<>\n]{1,300}>{1,2}"
    r"|\[(?:insert|your|enter|add)\s[^\[\]\n]{1,300}\]|\[[A-Z][A-Z0-9 _]{1,40}\]|<[A-Za-z][A-Za-z _]{0,40}\shere>|@@[A-Za-z0-9_]{1,40}@@"
    r"|(?<![\w])__[A-Z][A-Z0-9_]{0,40}__(?![\w])|%[A-Z][A-Z0-9_]{1,40}%|#[A-Z][A-Z0-9_]{1,40}#|\{[A-Za-z][A-Za-z0-9_]{0,40}\}|(?<!\w)X{4,}(?!\w)"
    r"|_{4,}|\((?:[a-z]+\s){1,4}to\s(?:follow|come)\)|(?<!\w)(?:TBD|TBA|TBC)(?!\w)|\((?:tbd|tba|insert [a-z ]{1,40})\)|\[\s*\]|\[\.{3}\]",
    re.I,
)
#: Those of the forms above that are case-sensitive, and must be upper case.
UPPER = re.compile(r"^(?:\[[A-Z][A-Z0-9 _]+\]|__[A-Z][A-Z0-9_]*__|%[A-Z][A-Z0-9_]+%|#[A-Z][A-Z0-9_]+#|X{4,}|TB[DAC])$")
NEEDS_UPPER = re.compile(r"^(?:\[(?!(?i:insert|your|enter|add)\s)[A-Za-z][A-Za-z0-9 _]+\]|__\w+__|%\w+%|#\w+#|[Xx]{4,}|[Tt][Bb][DACdac])$")
#: Strings of which each placeholder holds one, and of which each suspect does, in lower case.
MAY_HOLD = automaton([*"{[<@%#", "__", "xxx", "to follow", "to come", "tba", "tbc", "tbd", "(insert"])
TOKEN = re.compile(r"\x01\d+\x02|[^\W\d_]+|\d+|[^\w\s]")
_NAMED = (
    r"(?:placeholder|field|tag|variable|token|macro|shortcode|platzhalter|feld|felder|variablen?|marcador|marcadores|campo|etiqueta|"
    r"заполнитель|поле|поля|тег|переменная|переменную|प्लेसहोल्डर|फ़ील्ड|टैग)s?"
)
#: What describes a placeholder, before it (its kind, or things such as it) and behind it (its kind, or that it is exchanged).
DESCRIBED_BEFORE = re.compile(
    r"(?:^|\s)(?:(?:placeholder|variable|tag|token|macro|shortcode|platzhalter|marcador|etiqueta|заполнитель|тег|переменная|प्लेसहोल्डर)"
    rf"|(?:{_NAMED}|directions|marks|brackets|codes|forms|signs|strings) (?:such as|like|wie|como|как|जैसे)(?: \S+){{0,5}}?)$"
)
DESCRIBED_BEHIND = re.compile(
    rf"^{_NAMED}(?:\s|$)"
    r"|^(?:[^\s.;◊]+ ){0,7}?(?:is|are|was|were|gets?|be|been) (?:swapped|replaced|substituted|exchanged|filled|expanded) (?:for|by|with|in)(?: [^\s◊]+){2}"
    r"|^(?:[^\s.;◊]+ ){0,7}?(?:wird|werden|wurde) (?:durch|mit) (?:[^\s◊]+ ){1,5}?(?:ersetzt|ausgetauscht|gefüllt)"
    r"|^(?:[^\s.;◊]+ ){0,7}?(?:se (?:sustituye|reemplaza|cambia)|заменяется|заменяют|заменяем)(?: [^\s◊]+){2}"
)
#: What a slot may be left with that isn't a placeholder by itself: a variable's name, bare or with the mark
#: of a query, shell or mail language, a field's name as its default, nothing. Residue only where values stand in the same
#: frame in other records.
SUSPECT = re.compile(
    r"(?<![\w$])\$[A-Za-z_]\w*|%\([A-Za-z_]\w*\)[a-z]|(?<!\S):[A-Za-z_]\w*(?![:\w])|\*\|\w+\|\*|(?<![\w~])~[A-Za-z_]+~(?![\w~])|(?<!\w)[Yy]our (?:[Ff]ull |[Ff]irst )?(?:[Nn]ame|[Tt]itle|[Nn]umber|[Dd]ate|[Aa]ddress)(?!\w)|"
    r"(?<![\w./\\@:#$%{<\[-])[A-Za-z]{2,}(?:_[A-Za-z]{2,})+(?![\w/\\@:%}>\]-]|\.\w)|(?<![\w{<\[])[A-Z][a-z]+\s(?:Name|Title|Number|Date|Address)(?![\w}>\]])"
    r"|(?<=[\w:])[ \t]+(?=[,.;!](?:\s|$))|(?<=:)(?=[,;](?:\s|$))|(?<=\w:)[ \t]*$"
)
MAY_SUSPECT = automaton([*"_$~", "%(", "*|", " :", "\n:", " name", " title", " number", " date", " address", *(f"{a}{b}" for a in (" ", "\t", ":") for b in ",.;!")])
ENDS_OPEN = re.compile(r":[ \t]*(?:\n|$|\s\|)")
QUOTES = frozenset("\"'`“”„‘’«»‹›")


def slots(text: str) -> list[tuple[str, str, bool, str]]:
    """(frame, filler, whether it is quoted or described, the frame's longest word) of each placeholder.

    Its frame are the two tokens before it and the two behind, in its sentence; placeholders beside it count as the same
    neighbour, whatever they hold, so records of one template share frames. Where no word stands in the frame, the
    placeholder isn't spoken of.
    """
    found = []
    if not may(MAY_HOLD, text.lower()):
        return found
    for segment in SEGMENT.split(text):
        if not may(MAY_HOLD, segment.lower()):
            continue
        spans = placeholders(segment)
        shape = shaped(segment, spans)
        for (a, b), i in zip(spans, [i for i, t in enumerate(shape) if t == "◊"]):
            before, behind = around(shape, i, i + 1)
            word = longest_word(before, behind)
            found.append((frame_of(before, behind), segment[a:b], bool(word) and ((before[1] in QUOTES and behind[0] in QUOTES) or described(shape, i)), word))
    return found


def suspects(text: str) -> list[tuple[str, str, bool, str]]:
    """As slots(), for what a slot may be left with that is no placeholder; all need values in their frames elsewhere."""
    found = []
    if not may(MAY_SUSPECT, text.lower()) and not ENDS_OPEN.search(text):
        return found
    for segment in SEGMENT.split(text):
        if not may(MAY_SUSPECT, segment.lower()) and not ENDS_OPEN.search(segment):
            continue
        marks = placeholders(segment)
        bare = bare_places(segment, marks)
        if not bare:
            continue
        spans = sorted(marks + bare)
        shape = shaped(segment, spans)
        for span, i in zip(spans, [i for i, t in enumerate(shape) if t == "◊"]):
            before, behind = around(shape, i, i + 1)
            if span in bare and (word := longest_word(before, behind)) and not described(shape, i):
                found.append((frame_of(before, behind), segment[span[0] : span[1]], True, word))
    return found


def may(strings: ahocorasick.Automaton, text: str) -> bool:
    return next(strings.iter(text), None) is not None


def placeholders(segment: str) -> list[tuple[int, int]]:
    return [m.span() for m in PLACEHOLDER.finditer(segment) if not (NEEDS_UPPER.match(m[0]) and not UPPER.match(m[0]))]


def bare_places(segment: str, marks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What looks like a slot's bare name, default or blank, outside placeholders."""
    return [m.span() for m in SUSPECT.finditer(segment) if not any(a <= m.end() and m.start() <= b for a, b in marks)]


def shaped(segment: str, spans: list[tuple[int, int]]) -> list[str]:
    """A sentence's tokens, with numbers and the given places masked."""
    marked, at = [], 0
    for k, (a, b) in enumerate(spans):
        marked.append(segment[at:a] + f" \x01{k}\x02 ")
        at = b
    tokens = TOKEN.findall("".join([*marked, segment[at:]]).lower())
    return ["◊" if t[0] == "\x01" else "9" if t.isdigit() else t for t in tokens]


def around(shape: list[str], i: int, j: int) -> tuple[list[str], list[str]]:
    """The two tokens before place i and the two from place j on, with marks at the sentence's ends."""
    return (["^", "^", *shape[max(0, i - 2) : i]])[-2:], [*shape[j : j + 2], "$", "$"][:2]


def frame_of(before: list[str], behind: list[str]) -> str:
    """The tokens beside a place; a slot as the farther one may hold anything."""
    return " ".join(("*" if before[0] == "◊" else before[0], before[1], "_", behind[0], "*" if behind[1] == "◊" else behind[1]))


def longest_word(before: list[str], behind: list[str]) -> str:
    return max((x for x in (*before, *behind) if x.isalpha() and x != "◊"), key=lambda x: (len(x), x), default="")


def described(shape: list[str], i: int) -> bool:
    return DESCRIBED_BEFORE.search(" ".join(shape[max(0, i - 9) : i])) is not None or DESCRIBED_BEHIND.search(" ".join(shape[i + 1 : i + 16])) is not None


def values(text: str, words: frozenset[str], automaton: ahocorasick.Automaton, longest: int = 6) -> list[str]:
    """The frames, with one of the words, in which up to `longest` tokens stand that hold no placeholder or bare name."""
    found = []
    low = text.lower()
    if next(automaton.iter(low), None) is None:
        return found
    for segment in SEGMENT.split(text):
        if next(automaton.iter(segment.lower()), None) is None:
            continue
        marks = placeholders(segment)
        shape = shaped(segment, sorted(marks + bare_places(segment, marks)))
        hits = [k for k, t in enumerate(shape) if t in words]
        gaps = {(i, i + n) for k in hits for i in (k + 1, k + 2) for n in range(1, longest + 1)}
        gaps |= {(j - n, j) for k in hits for j in (k, k - 1) for n in range(1, longest + 1)}
        for i, j in gaps:
            if 0 <= i and j <= len(shape) and "◊" not in shape[i:j]:
                (a, b), (c, d) = around(shape, i, j)
                found += {f"{x} {b} _ {c} {y}" for x in (a, "*") for y in (d, "*")}
    return found


def find_residue(docs: DataFrame, *, key: str = "doc_id", text: str = "text", value_share: float = 0.5, template_share: float = 0.001, word_share: float = 0.2) -> DataFrame:
    """(key, kinds): the documents with residue and what was found: 'slot', 'filler', 'stub', 'page', sorted.

    Slots: sentences of all records are aligned by the two tokens on either side of a place. A placeholder is residue
    unless it is spoken of, that is quoted, or described by the words beside it, as 'the {name} field' is; where values
    stand in at least `value_share` of the places with the same frame, it is a slot of a template nevertheless. So is, in
    such a frame, a variable's name, a default or nothing (see SUSPECT).

    Pages: standard phrases of servers and browsers are the seeds. Of all texts that hold one, sentences and lines are
    counted as skeletons, also with one span open, and what stands around seeds. Those in at least `template_share` of
    these texts are templates, at most (skeletons of a text) / template_share. A template belongs to pages where most
    texts with it consist of seeds and such templates otherwise, so a sentence that speaks of an error, and stands in
    prose, doesn't. A page is a text of which seeds and templates of pages cover nine tenths; a text without any seed is
    one only if its templates stand together with seeds in a tenth of the covered texts.

    Filler: dummy words are learned from texts with the standard passage, those in `word_share` of them. All limits are
    shares, so the answer doesn't depend on how many records there are, but below 3 texts nothing is learned.

    Null texts give no row, empty or blank ones are stubs; whole texts are read; repeated documents count each. Only found
    candidates, not texts, are shuffled, with partial counts, so a template that fills a third of the corpus isn't gathered
    anywhere. Besides templates, a word of each frame of a placeholder spoken of is sent to the tasks, no more than the
    vocabulary. Other columns don't matter.
    """
    spark = docs.sparkSession
    checkpoint_dir(spark)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")
    key_type = rows.schema["key"].dataType.simpleString()
    place = pa.list_(pa.struct([("frame", pa.string()), ("filler", pa.string()), ("spoken", pa.bool_()), ("word", pa.string())]))
    piece = pa.struct([("s", pa.string()), ("n", pa.int64())])
    segment = pa.list_(pa.struct([("keys", pa.list_(pa.string())), ("n", pa.int64()), ("closed", pa.int64()), ("pieces", pa.list_(piece))]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, t in enumerate(batch.column(1).to_pylist()):
                low = plain(t)
                kind, counts = whole(low)
                hit, dummy = seeded(low), dummy_share(counts)
                places = slots(t) + suspects(t)
                if kind or dummy >= 0.05 or hit or places:
                    out.append((i, kind, [dict(zip(("frame", "filler", "spoken", "word"), p)) for p in places], parts(hit) if hit else None, [{"s": w, "n": n} for w, n in counts.items()] if dummy >= 0.05 else None, dummy if dummy >= 0.05 else None))
            at, kinds, places, hits, words, shares = zip(*out) if out else ((),) * 6
            columns = [pa.array(kinds, pa.string()), pa.array(places, place), pa.array(hits, segment), pa.array(words, pa.list_(piece)), pa.array(shares, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], ["key", "kind", "places", "hits", "words", "share"])

    schema = (
        f"key {key_type}, kind string, places array<struct<frame:string,filler:string,spoken:boolean,word:string>>, "
        "hits array<struct<keys:array<string>,n:bigint,closed:bigint,pieces:array<struct<s:string,n:bigint>>>>, words array<struct<s:string,n:bigint>>, share double"
    )
    seen = rows.mapInArrow(scan, schema).checkpoint()
    found = seen.where("kind <> ''").select("key", "kind").unionByName(_filler(seen, word_share))
    places = seen.select("key", F.explode("places").alias("p")).select("key", "p.*")
    spoken = places.where("spoken")
    words = frozenset(r.word for r in spoken.select("word").distinct().collect())
    templates = _templates(seen, template_share)
    known = sorted(words)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One more reading for both: texts covered by templates, and the frames that hold values."""
        held = automaton(known)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            got = [(i, c) for i, t in enumerate(texts) if (c := page_cover(plain(t), templates))]
            counts = Counter(f for t in texts for f in values(t, words, held)) if words else Counter()
            n = len(counts)
            keys = pa.concat_arrays([batch.column(0).take(pa.array([i for i, _ in got], pa.int64())), pa.nulls(n, batch.column(0).type)])
            columns = [pa.array([c[0] for _, c in got] + [None] * n, pa.bool_()), pa.array([c[1] for _, c in got] + [None] * n, pa.list_(pa.string())), pa.array([None] * len(got) + list(counts), pa.string()), pa.array([None] * len(got) + list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays([keys, *columns], ["key", "seed", "used", "frame", "filled"])

    after = rows.mapInArrow(second, f"key {key_type}, seed boolean, used array<string>, frame string, filled long").checkpoint()
    unfilled = spoken.groupBy("frame").agg(F.count("*").alias("unfilled"))
    filled = after.where("frame IS NOT NULL").join(unfilled.select("frame"), "frame", "left_semi").groupBy("frame").agg(F.sum("filled").alias("filled"))
    template = unfilled.join(filled, "frame").where(F.col("filled") >= value_share * (F.col("filled") + F.col("unfilled"))).select("frame")
    slot = places.where("NOT spoken").select("key", F.lit("slot").alias("kind")).unionByName(spoken.join(template, "frame", "left_semi").select("key", F.lit("slot").alias("kind")))
    return found.unionByName(_pages(after.where("frame IS NULL"))).unionByName(slot).groupBy("key").agg(F.array_sort(F.collect_set("kind")).alias("kinds")).withColumnRenamed("key", key)


def _filler(seen: DataFrame, word_share: float, dense: float = 0.15) -> DataFrame:
    """(key, kind) of texts of which 0.7 are dummy words, of the standard passage or learned from texts dense in it."""
    dummies = seen.where("share IS NOT NULL")
    texts = dummies.where(F.col("share") >= dense)
    least = F.greatest(F.lit(2), F.ceil(F.lit(texts.count() * word_share)))
    learned = texts.select(F.explode("words").alias("w")).groupBy("w.s").agg(F.count("*").alias("n")).where(F.col("n") >= least).collect()
    known = F.array(*[F.lit(w) for w in sorted(LOREM | {r.s for r in learned})])
    total = lambda words: F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + w.n)
    filler = total(F.filter("words", lambda w: F.array_contains(known, w.s))) >= 0.7 * total(F.col("words"))
    return dummies.where(filler).select("key", F.lit("filler").alias("kind"))


def _templates(seen: DataFrame, share: float, rounds: int = 2) -> PageTemplates:
    """The skeletons that recur in texts with seeds, and which of them belong to pages."""
    hits = seen.where("hits IS NOT NULL").select("hits")
    least = max(3, math.ceil(share * hits.count()))
    keys = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.transform(F.concat(h["keys"], F.transform(h["pieces"], lambda p: p["s"])), lambda k: F.struct(k.alias("k"), (h["closed"] > 0).alias("seeded"))))))
    counted = hits.select(F.explode(keys).alias("x")).groupBy("x.k").agg(F.count("*").alias("n"), F.avg(F.col("x.seeded").cast("int")).alias("seeded")).where(F.col("n") >= least).collect()
    counts = {r.k: r.n for r in counted}
    # templates of sentences with seeds are taken for parts of pages at first, others not; then either kind is judged by the
    # other in turn, so that both settle
    rates = {r.k: float(r.seeded >= 0.5) for r in counted}
    kinds = [{r.k for r in counted if (r.seeded >= 0.5) == kind} for kind in (False, True)]
    for turn in range(2 * rounds if counts else 0):
        rates |= {k: v for k, v in _rates(hits, counts, rates).items() if k in kinds[turn % 2]}
    return PageTemplates({k: (counts[k], rates[k] >= 0.5) for k in counts})


def _pages(covered: DataFrame) -> DataFrame:
    """(key, kind) of the error pages and notices among the covered texts (key, seed, used)."""
    by_template = covered.select("seed", F.explode(F.array_distinct("used")).alias("k")).groupBy("k").agg(F.avg(F.col("seed").cast("int")).alias("rate"))
    sure = [r.k for r in by_template.where("rate >= 0.1").collect()]  # templates only, so bounded like these
    alone = F.forall("used", lambda k: k.isin(sure)) & F.exists("used", lambda k: F.size(F.split(k, " ")) >= 3) if sure else F.lit(False)
    return covered.where(F.col("seed") | alone).select("key", F.lit("page").alias("kind"))


def _rates(hits: DataFrame, counts: dict[str, int], rates: dict[str, float]) -> dict[str, float]:
    """Of the texts with a template and something else, the share in which the rest is closed (see isolation)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            closed: Counter[str] = Counter()
            texts: Counter[str] = Counter()
            for segments in batch.column(0).to_pylist():
                for k, v in isolation(segments, counts, rates).items():
                    texts[k] += 1
                    closed[k] += v
            yield pa.RecordBatch.from_arrays([pa.array(list(texts), pa.string()), pa.array([closed[k] for k in texts], pa.int64()), pa.array(list(texts.values()), pa.int64())], ["k", "closed", "texts"])

    sums = hits.mapInArrow(run, "k string, closed long, texts long").groupBy("k").agg(F.sum("closed").alias("closed"), F.sum("texts").alias("texts"))
    return {r.k: r.closed / r.texts for r in sums.collect()}
