"""What whole texts are: error pages and notices by recurring page templates, filler and stubs by their words."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick

#: The reason phrases of RFC 9110 for errors.
REASONS = (
    "bad request|unauthori[sz]ed|payment required|forbidden|not found|method not allowed|not acceptable|proxy authentication required|request time-?out|conflict|gone|length required|precondition failed|"
    "content too large|uri too long|unsupported media type|range not satisfiable|expectation failed|too many requests|internal server error|not implemented|bad gateway|service unavailable|gateway time-?out"
)
_JS = r"(?:java ?script|(?:active |browser )?script(?:s|ing)|cookies)(?: and (?:java ?script|scripts|cookies))?"
_ALLOW = r"(?:enable|activate|allow|turn on|switch on|unblock)"
_HERE = r"(?: (?:in|on) your browser| for this (?:site|page))?(?:,? and (?:reload|refresh)(?: (?:the|this) page)?)?"
_TAIL = r"(?:,? (?:to|so) [^\W\d]+(?: [^\W\d]+){0,4}(?=\W*$))?"
_WEB = r"(?:page|file|resource|site|website|web page|url|requested url|server)"
#: Standard phrases of web servers, browsers, content managers and run-time systems, in lower case. They are
#: the seeds; what else stands on such pages is learned (see find_residue).
SEEDS = [
    rf"(?:http(?:/\d(?:\.\d)?)?|status|error|http error|error code|code)(?: (?:status|error|code))?[ :#-]*[45]\d\d(?:[ :.-]*(?:{REASONS}))?|[45]\d\d[ :.-]*(?:{REASONS})|{REASONS}",
    r"access (?:(?:is|was|has been) )?denied", rf"{_WEB} not found",
    rf"(?:(?:we are |we're )?sorry[,!]? (?:but )?)?(?:the|this|that) {_WEB}(?: you (?:requested|are looking for|asked for))? was not found(?: on this server)?",
    r"(?:could not|can't|cannot) be (?:found|located|displayed|loaded|reached|shown)|does not exist|is no longer (?:available|here)|has expired|has been (?:moved|removed|deleted)|(?:was|has) moved(?=\W*$)", r"did not respond", r"you (?:must|need to) (?:be logged in|(?:sign|log) in)(?: to [^\W\d]+(?: [^\W\d]+){0,4}(?=\W*$))?",
    r"(?:oops[!,]? )?something went wrong", r"(?:request|connection|gateway|session) timed out", r"error establishing a database connection", r"connection (?:was )?(?:refused|reset)|refused (?:the connection|to connect)", r"took too long to (?:respond|answer)", r"(?:is )?(?:temporarily )?(?:overloaded|down for maintenance)", r"(?:encountered|ran into|met) an unexpected condition",
    r"(?:fatal error|parse error|syntax error|warning|notice|unhandled exception|uncaught exception|exception): [^\n]{1,200}? (?:(?:at|on|in) )?line \d+",
    r"service (?:is )?temporarily unavailable", r"(?:please )?try again (?:later|in a few (?:minutes|moments))",
    r"your session has (?:expired|ended|timed out)", r"please (?:sign|log) in again", r"you (?:are not (?:authori[sz]ed|allowed|permitted)|(?:do not|don't) have (?:permission|access)) to [^\W\d]+(?: [^\W\d]+){0,4}(?=\W*$)",
    r"checking your browser before (?:accessing|opening) [^\W\d]+(?: [^\W\d]+){0,2}(?=\W*$)",
    rf"(?:(?:please|kindly|[^\W\d]+ (?:must|(?:need|have) to)) )?{_ALLOW} {_JS}{_HERE}{_TAIL}", rf"{_JS} (?:is|are|must be|has been) (?:disabled|off|blocked|required|turned off|switched off|not enabled|allowed|enabled)",
    rf"without {_JS},? (?:it is not possible|[^\W\d]+ cannot|[^\W\d]+ can't)(?: [^\W\d]+){{1,6}}(?=\W*$)", rf"(?:this|our|the) [^\W\d]+ (?:needs|requires) {_JS}(?: to be (?:turned on|enabled|allowed))?{_HERE}{_TAIL}",
    rf"your browser (?:blocks|does not support|has disabled) {_JS}", rf"does not work without {_JS}",
    r"(?:seite|datei) nicht gefunden", r"zugriff verweigert", r"(?:die|ihre) sitzung ist abgelaufen", r"interner serverfehler", r"fehler \d{3}", r"der server antwortet nicht", r"bitte (?:aktivieren|erlauben) sie (?:javascript|skripte)(?:,? um [^\W\d]+(?: [^\W\d]+){0,3}(?=\W*$))?", r"ohne (?:javascript|skripte) kann(?: [^\W\d]+){2,6}(?=\W*$)",
    r"p[áa]gina no encontrada", r"acceso denegado", r"(?:su|la) sesi[óo]n ha (?:caducado|expirado)", r"error interno(?: del servidor)?", r"el servidor no responde", r"int[ée]ntelo (?:de nuevo )?m[áa]s tarde", r"(?:active|habilite) (?:javascript|los scripts)(?: para(?: [^\W\d]+){1,4}(?=\W*$))?", r"requiere (?:javascript|que los scripts est[ée]n habilitados)",
    r"страница не найдена", r"доступ запрещ[её]н", r"внутренняя ошибка сервера", r"сервер не отвечает", r"(?:ваша )?сессия истекла", r"включите (?:javascript|скрипты)(?:,? чтобы(?: [^\W\d]+){1,4}(?=\W*$))?", r"нужны скрипты", r"ошибка \d{3}",
    r"पृष्ठ नहीं मिला", r"पहुँच अस्वीकृत", r"सर्वर (?:में )?त्रुटि(?: हुई)?", r"बाद में (?:पुनः )?प्रयास करें", r"जावास्क्रिप्ट (?:चालू|सक्षम) करें", r"सत्र समाप्त(?: हो गया)?",
]
#: Strings without which a text holds no seed; each pattern above has one of them in every reading.
HINTS = [
    *(p for p in REASONS.replace("[sz]", "s").replace("-?", "").split("|")), "unauthorized", "time-out", "http", "error", "status 4", "status 5", "status: 4", "status: 5", "status code", "code 4", "code 5", "code: 4", "code: 5", "denied", "expired",
    "be found", "be located", "be displayed", "be loaded", "be reached", "be shown", "does not exist", "no longer", "been moved", "was moved", "has moved", "been removed", "been deleted", "went wrong", "timed out", "refused", "too long", "overloaded", "maintenance", "unexpected condition", "exception", "warning:", "notice:", "unavailable", "try again",
    "session has", "in again", "logged in", "sign in", "log in", "permission", "not allowed", "not authori", "not permitted", "don't have access", "not have access", "your browser", "javascript", "java script", "scripts", "scripting", "cookies", "did not respond",
    "nicht gefunden", "verweigert", "abgelaufen", "serverfehler", "fehler", "antwortet nicht", "skripte", "encontrada", "denegado", "caducado", "expirado", "interno", "responde", "tarde", "найдена", "запрещ", "ошибка", "отвечает", "истекла", "скрипты",
    "नहीं मिला", "अस्वीकृत", "त्रुटि", "प्रयास करें", "जावास्क्रिप्ट", "सत्र समाप्त",
]
#: Stubs that announce a text instead of holding one.
STUBS = [
    r"\(?(?:empty|blank) (?:template|page|document|section|chapter|note|notes|text)\)?", r"(?:notes|text|content|script|transcript|chapter|details|description|page|section|entry) (?:pending|to follow|to come|goes here|coming soon|missing|tba|tbd)",
    r"(?:please )?check back (?:later|soon)", r"coming soon", r"to be (?:added|written|completed|announced|done|continued)", r"todo:? [a-z ]{3,40}", r"todo", r"tbd", r"under construction", r"no (?:content|text|notes|description) (?:yet|available)",
    r"(?:write|add|insert|type|put) (?:your )?(?:text|content|notes|title|script)(?: text)? here", r"your text here", r"type the [a-z]+ here", r"replace this [a-z]+ with your own [a-z]+", r"placeholder(?: text)?", r"sample text", r"draft", r"no text yet", r"content to be added", r"this is (?:dummy|sample|placeholder) (?:content|text)(?: for (?:the )?layout)?", r"untitled", r"n/?a", r"null", r"undefined", r"none",
]
#: Words of which each stub phrase above holds one.
STUB_WORDS = frozenset(
    "empty blank pending follow come here soon missing tba tbd added written completed announced done continued todo construction yet available "
    "replace placeholder sample draft dummy untitled n na null undefined none".split()
)
#: The standard passage of dummy text. Other words of such texts are learned.
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
#: The letters of a keyboard's middle row.
KEYS = "asdfghjkl"
SEGMENT = re.compile(r"\n+|\s\|\s|(?<=[.!?।])\s+")
WORD = re.compile(r"[^\W\d_]+")
GAPS = re.compile(r"\s+")
HEX = re.compile(r"\b(?=[a-f]*\d)[0-9a-f]{6,}\b")
DIGIT = re.compile(r"\d")
PIECE = re.compile(r"(?:[^\W\d_]|[ऀ-ॿ])+|\d+|[^\w\s]")
_EDGE = r"(?<![^\W_])", r"(?![^\W_])"


def _cover(patterns: list[str]) -> re.Pattern:
    return re.compile("|".join(f"{_EDGE[0]}(?:{p}){_EDGE[1]}" for p in patterns))


SEED_RE, STUB_RE = _cover(SEEDS), _cover(STUBS)


def automaton(words: list[str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for w in words:
        made.add_word(w, w)
    made.make_automaton()
    return made


HINT = automaton(HINTS)
LONG_DUMMY = frozenset(w for w in LOREM if len(w) > 3)


def plain(text: str) -> str:
    return unicodedata.normalize("NFC", text).lower().strip()


def letters(text: str) -> int:
    return sum(map(str.isalnum, text))


def segments(text: str) -> Iterator[str]:
    """Sentences and lines, one after the other, so that a reader may stop early."""
    at = 0
    for m in SEGMENT.finditer(text):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


def tokens(piece: str) -> tuple[str, ...]:
    """The skeleton of a piece of a page: its words, with numbers and identifiers masked, without outer marks."""
    return trimmed(["9" if t.isdigit() else t for t in PIECE.findall(HEX.sub("9", piece) if DIGIT.search(piece) else piece)])


def frames(skeleton: tuple[str, ...], longest: int = 5) -> Iterator[tuple[str, str]]:
    """(frame, filling): the skeleton with one span of up to `longest` tokens open, where most of it and at least three
    tokens stay."""
    n = len(skeleton)
    for size in range(1, min(longest, n - 3, n // 2) + 1):
        for i in range(n - size + 1):
            yield " ".join((*skeleton[:i], "◊", *skeleton[i + size :])), " ".join(skeleton[i : i + size])


def masked(segment: str) -> tuple[str, bool]:
    """A segment with § for each seed in it, and whether there is one."""
    if next(HINT.iter(segment), None) is None:
        return segment, False
    left = SEED_RE.sub(" § ", GAPS.sub(" ", segment))
    return left, "§" in left


def pieces(skeleton: tuple[str, ...]) -> list[tuple[str, ...]]:
    """What stands between the seeds of a skeleton."""
    out: list[list[str]] = [[]]
    for t in skeleton:
        if t == "§":
            out.append([])
        else:
            out[-1].append(t)
    return [p for p in map(trimmed, out) if p]


def trimmed(got: list[str]) -> tuple[str, ...]:
    a, b = 0, len(got)
    while a < b and not (got[a][0].isalnum() or got[a] == "§"):
        a += 1
    while b > a and not (got[b - 1][0].isalnum() or got[b - 1] == "§"):
        b -= 1
    return tuple(got[a:b])


def size_of(skeleton: tuple[str, ...]) -> int:
    """Letters of a skeleton outside of seeds."""
    return sum([len(t) for t in skeleton if t[0].isalnum()])


def seeded(text: str) -> list[tuple[tuple[str, ...], int]] | None:
    """(skeleton, letters) of each sentence or line of a text that holds a seed; None for other texts."""
    if next(HINT.iter(text), None) is None:
        return None
    found, hit = [], False
    for segment in segments(text):
        left, has = masked(segment)
        hit = hit or has
        if skeleton := tokens(left):
            found.append((skeleton, letters(segment)))
    return found if hit else None


def parts(found: list[tuple[tuple[str, ...], int]]) -> list[dict]:
    """What is counted of a text with seeds, for each sentence or line: its skeleton and the frames of it (of texts of
    which sentences with seeds are a fifth, others can't be pages), its letters, those in seeds, and what stands around
    these."""
    total, seeds = sum(n for _, n in found), sum(n for s, n in found if "§" in s)
    out = []
    for skeleton, n in found:
        has = "§" in skeleton
        keys = [" ".join(skeleton)]
        if seeds >= 0.2 * total:
            keys += sorted({f for f, _ in frames(skeleton)})
        around = [{"s": " ".join(p), "n": size_of(p)} for p in pieces(skeleton)] if has and len(skeleton) > 1 else []
        out.append({"keys": keys, "n": n, "closed": max(n - size_of(skeleton), 0) if has else 0, "pieces": around})
    return out


def isolation(found: list[dict], counts: dict[str, int], rates: dict[str, float]) -> dict[str, bool]:
    """For each template in a text that holds something else: whether seeds and templates of pages are at least half of
    the rest. Of the templates a sentence fits, the most frequent decides whether it belongs to a page."""
    total, closed = sum(s["n"] for s in found), []
    page = lambda k: k in counts and rates[k] >= 0.5
    for s in found:
        best = max((k for k in s["keys"] if k in counts), key=lambda k: (counts[k], k), default=None)
        whole_ = best is not None and rates[best] >= 0.5
        closed.append((s["n"] if whole_ else s["closed"] + sum(p["n"] for p in s["pieces"] if page(p["s"])), whole_))
    all_closed = sum(c for c, _ in closed)
    out: dict[str, bool] = {}
    for s, (own, whole_) in zip(found, closed):
        rest = total - s["n"]
        if rest > 0:
            for k in s["keys"]:
                if k in counts:
                    out[k] = out.get(k, False) or all_closed - own >= 0.5 * rest
        for p in s["pieces"]:
            if p["s"] in counts and total > p["n"]:
                mine = p["n"] if whole_ or page(p["s"]) else 0
                out[p["s"]] = out.get(p["s"], False) or all_closed - mine >= 0.5 * (total - p["n"])
    return out


class PageTemplates:
    """Learned skeletons, whole or with an open slot: how often they stand in texts with seeds, and whether on pages.

    Of all templates that fit a sentence or line, the most frequent one decides. Where none fits, templates may cover it
    one after the other, seeds between them.
    """

    def __init__(self, learned: dict[str, tuple[int, bool]]):
        self.learned = learned
        self.starts: dict[str, list[tuple[str, ...]]] = {}
        for key in sorted(k for k, (_, good) in learned.items() if good and "◊" not in k):
            words = tuple(key.split(" "))
            self.starts.setdefault(words[0], []).append(words)
        slotted = [tuple(k.split(" ")) for k, (_, good) in learned.items() if good and "◊" in k]
        # a skeleton that fits a template or is covered by some has at least half of its letters in their words
        self.words = frozenset(w for k in (*slotted, *(k for x in self.starts.values() for k in x)) for w in k if w[0].isalnum())
        self.heads = {x[:2] for x in slotted if "◊" not in x[:2]}
        self.tails = {x[-2:] for x in slotted if "◊" not in x[-2:]}

    def fits(self, skeleton: tuple[str, ...]) -> tuple[str, bool] | None:
        """The most frequent template a skeleton fits as a whole, and whether it belongs to pages."""
        key, best, most = " ".join(skeleton), None, 0
        if skeleton[:2] in self.heads or skeleton[-2:] in self.tails or self.learned.get(key, (0, False))[1]:
            for frame in (key, *(f for f, _ in frames(skeleton))):
                n = self.learned.get(frame, (0, False))[0]
                if n > most:
                    best, most = frame, n
        return None if best is None else (best, self.learned[best][1])

    def covered(self, skeleton: tuple[str, ...]) -> tuple[int, list[str]]:
        """(letters left open, the templates that cover the others)."""
        size = size_of(skeleton)
        if sum([len(t) for t in skeleton if t in self.words]) < 0.5 * size:
            return size, []
        if (fit := self.fits(skeleton)) is not None:
            return (0, [fit[0]]) if fit[1] else (size, [])
        best: list[tuple[int, list[str]]] = [(0, [])] * (len(skeleton) + 1)
        for i in range(len(skeleton) - 1, -1, -1):
            left, used = best[i + 1]
            best[i] = (left + (len(skeleton[i]) if skeleton[i][0].isalnum() else 0), used)
            for words in self.starts.get(skeleton[i], ()):
                if skeleton[i : i + len(words)] == words and best[i + len(words)][0] < best[i][0]:
                    left, used = best[i + len(words)]
                    best[i] = (left, [" ".join(words), *used])
        return best[0]


def page_cover(text: str, templates: PageTemplates, share: float = 0.1) -> tuple[bool, list[str]] | None:
    """(whether a seed stands in it, the templates used) if seeds and templates cover a text but for a tenth of its
    letters; else None. Reading stops where too much is open for the whole text to be a page."""
    limit, seed, used, open_ = share * len(text), False, [], 0
    for segment in segments(text):
        left, has = masked(segment)
        if not has and open_ + sum([len(w) for w in segment.split() if w not in templates.words and w.isalpha()]) > max(limit, open_ + 0.5 * len(segment)):
            return None  # more than half of it are words of no template, so all of it is open
        if skeleton := tokens(left):
            got, keys = templates.covered(skeleton)
            seed = seed or has
            used += keys
            open_ += got
            if open_ > limit:
                return None
    return (seed, used) if (seed or used) and open_ <= share * letters(text) else None


def dummy_share(counts: Counter[str]) -> float:
    """The share of the long words of the standard passage in the counted words of a text."""
    return sum(counts[w] for w in LONG_DUMMY & counts.keys()) / max(counts.total(), 1)


def is_filler(text: str) -> tuple[bool, float, Counter[str]]:
    """Whether a whole text is filler (dummy words of the standard passage, keys of one row, one word or one line
    repeated), how many letters stub phrases can cover in it at most, by its words, and these, counted.

    Words are counted over the whole text, in one pass; reading stops early only where what is left, taken as words of one
    letter, couldn't bring any count to its limit, and none so far is of the standard passage. What stands beside the filler, like a heading, counts against it.
    """
    counts: Counter[str] = Counter()
    n = latin = long = keys = at = 0
    step = 8192
    while at < len(text):
        end = text.find(" ", at + step) if at + step < len(text) else -1
        end = len(text) if end < 0 else end
        step *= 2  # so that summing up stays linear in the text
        words = WORD.findall(text, at, end)
        at = end
        counts.update(words)
        n += len(words)
        dummy = LOREM & counts.keys()
        latin, long = sum(counts[w] for w in dummy), sum(counts[w] for w in dummy if len(w) > 3)
        keys = sum(counts[w] for w in counts if w[0] in KEYS and not w.strip(KEYS))
        left = (len(text) - at + 1) // 2
        if left and not long and latin + left < 0.7 * (n + left) and keys + left < 0.8 * (n + left) and len(counts) > 8 + 0.2 * (n + left):
            return False, math.inf, counts
    stub = sum(counts[w] for w in STUB_WORDS & counts.keys())
    stub *= 44 + 2 * max(map(len, counts)) if stub else 0  # the longest phrase, and two words that may be any
    if n < 3:
        return False, stub, counts
    if n >= 4 and ((len(counts) > 3 and latin >= 0.7 * n and long >= 0.3 * n) or keys >= 0.8 * n):
        return True, stub, counts
    if len(counts) * 3 > n or len(counts) > 8 + 0.2 * n:
        return False, stub, counts
    if n >= 4 and max(counts.values()) >= 0.8 * n:
        return True, stub, counts
    pieces = Counter(re.sub(r"\d+", "9", x).strip() for x in re.split(r"\n|;|[.!?](?:\s|$)", text) if letters(x))
    if len(counts) <= 8:
        return pieces.total() >= 3 and len(pieces) * 3 <= pieces.total(), stub, counts
    # a repeated line of few words under other text, which is a fifth of the words at most
    often = {x: WORD.findall(x) for x, k in pieces.items() if k >= 3}
    return sum(pieces[x] * len(w) for x, w in often.items()) >= 0.8 * n and len({w for x in often.values() for w in x}) <= 8, stub, counts


def is_stub(text: str, total: int) -> bool:
    """Whether stub phrases make up nine tenths of a whole text's letters; read until too many others were seen."""
    flat, at, others = GAPS.sub(" ", text), 0, 0
    for m in STUB_RE.finditer(flat):
        others += letters(flat[at : m.start()])
        if others > 0.1 * total:
            return False
        at = m.end()
    return others + letters(flat[at:]) <= 0.1 * total


def whole(text: str) -> tuple[str, Counter[str]]:
    """'filler', 'stub' or '' for a whole text in plain form, and its counted words: all of them, unless none of the
    standard passage was among the first ones of a long text that can't be filler."""
    filler, stub_letters, counts = is_filler(text)
    if filler:
        return "filler", counts
    total = letters(text) if stub_letters * 1.2 + 1 >= 0.45 * len(text) or not counts else len(text)
    if total == 0:
        return "stub", counts
    return "stub" if stub_letters >= 0.9 * total and is_stub(text, total) else "", counts
