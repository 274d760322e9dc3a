"""Text of labels, file names and scripts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Digits of ten scripts, and ranges of characters that count as punctuation when texts are compared.
NATIVE_DIGITS = "०१२३४५६७८९০১২৩৪৫৬৭৮৯੦੧੨੩੪੫੬੭੮੯૦૧૨૩૪૫૬૭૮૯୦୧୨୩୪୫୬୭୮୯௦௧௨௩௪௫௬௭௮௯౦౧౨౩౪౫౬౭౮౯೦೧೨೩೪೫೬೭೮೯൦൧൨൩൪൫൬൭൮൯"
PUNCTUATION = (
    r"[\u0000-\u002F\u003A-\u0040\u005B-\u0060\u007B-\u00BF\u0964\u0965\u2000-\u206F\u2E00-\u2E7F\u3000-\u303F\uFF00-\uFF0F\uFF1A-\uFF20\uFF3B-\uFF40\uFF5B-\uFF65]"
)


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def stem(path: Column) -> Column:
    """The file name without its last extension; a leading dot starts a name, not an extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def ascii_digits(c: Column) -> Column:
    """Digits of other scripts as 0 to 9."""
    return F.translate(c, NATIVE_DIGITS, "0123456789" * 9)


def label_kind(label: Column, title: str = "Chapter Title", heading: str = "Heading", verse: str = "Verse") -> Column:
    """'title', 'heading', 'verse', 'malformed' (begins with the verse word, no number) or 'unknown', in this order.

    Case and outer blanks don't matter; a null label counts as empty, thus unknown.
    """
    text = F.lower(strip(F.coalesce(label, F.lit(""))))
    t, h, v = (x.strip().lower() for x in (title, heading, verse))
    quote = lambda s: rf"\Q{s}\E"
    return (
        F.when(text == t, "title")
        .when(text.rlike(rf"(?U)^{quote(h)}\s*\d*\s*$"), "heading")
        .when(text.rlike(rf"(?U)^{quote(v)}\s*\d+\s*$"), "verse")
        .when(text.rlike(rf"(?U)^{quote(v)}\b"), "malformed")
        .otherwise("unknown")
    )


def verse_number(label: Column, verse: str = "Verse") -> Column:
    """The number of a verse label, leading zeros aside; null for any other label."""
    text = F.lower(strip(label))
    digits = F.regexp_extract(ascii_digits(text), rf"(?U)^\Q{verse.strip().lower()}\E\s*(\d+)\s*$", 1)
    return F.when(digits != "", digits.try_cast("bigint"))


def trailing_number(label: Column) -> Column:
    """The last word of a label if it is a number, else null."""
    last = F.regexp_extract(strip(label), r"(?U)(?:^|\s)(\d+)$", 1)
    return F.when(last != "", last.try_cast("bigint"))


def short_label(label: Column) -> Column:
    """What a narrow display shows: 'Chapter', 'Heading' or the digits, else the label."""
    kind = label_kind(label)
    digits = F.regexp_replace(label, "[^0-9]", "")
    return F.when(kind == "title", "Chapter").when(kind == "heading", "Heading").when(digits != "", digits).otherwise(label)


def preview(c: Column, length: int = 60) -> Column:
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit("..."))).otherwise(c)


#: The words for chapter that open a heading.
CHAPTER_WORDS = "chapter|अध्याय|அதிகாரம்|అధ్యాయము|ಅಧ್ಯಾಯ|അദ്ധ്യായം|অধ্যায়|ਅਧਿਆਇ|અધ્યાય|ଅଧ୍ୟାୟ"


def without_chapter_headings(text: Column, words: str = CHAPTER_WORDS) -> Column:
    """A text without the chapter word and number at the beginning of any of its lines."""
    return F.regexp_replace(text, rf"(?imU)^[^\S\n]*(?:{words})\s*\d+", "")


def loudness_summary(text: Column) -> tuple[Column, Column]:
    """Integrated loudness (the last 'I: x LUFS') and peak (the largest 'Peak: x dBFS') of a meter's printed summary."""
    level = F.regexp_extract_all(text, F.lit(r"I:\s*(-?[0-9]+(?:\.[0-9]+)?)\s*LUFS"), 1)
    peak = F.regexp_extract_all(text, F.lit(r"Peak:\s*(-?[0-9]+(?:\.[0-9]+)?)\s*dBFS"), 1)
    last = F.try_element_at(level, F.lit(-1)).try_cast("double")
    return last, F.array_max(F.transform(peak, lambda x: x.try_cast("double")))


def measured(value: Column) -> Column:
    """The number of a printed measurement such as '2.00s', 0 if there is none."""
    text = F.regexp_replace(value, r"s\s*$", "")
    return F.coalesce(F.when(text.rlike(r"^\s*[-+]?[0-9]*\.?[0-9]+\s*$"), text.try_cast("double")), F.lit(0.0))


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition, which no built-in offers; Arrow batches."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def comparable(text: Column) -> Column:
    """A text as it is compared: composed, lower case, punctuation as gaps, gaps as one blank. Null becomes ''."""
    bare = F.regexp_replace(F.lower(nfc(F.coalesce(text, F.lit("")))), PUNCTUATION, " ")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))
