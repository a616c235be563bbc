"""Scalar functions on labels, keys and addresses, as column expressions.

White space is what Unicode calls so (as opposed to SQL's trim), and word edges are ASCII word characters, wherever a
function mirrors rules that were written for such engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word edges that only ASCII letters, digits and underscores make.
EDGE, SPACE = "(?<![A-Za-z0-9_])", r"[\s   -     　﻿]"
#: Language names for codes, and codes for language names. Neither inverts the other.
LANGUAGE_OF_CODE = {
    "en": "English", "fr": "French", "de": "German", "es": "Spanish", "it": "Italian", "pt": "Portuguese", "nl": "Dutch", "sv": "Swedish", "no": "Norwegian",
    "da": "Danish", "fi": "Finnish", "ga": "Irish", "cy": "Welsh", "pl": "Polish", "cs": "Czech", "ru": "Russian", "el": "Greek", "grc": "Ancient Greek",
    "la": "Latin", "he": "Hebrew", "hbo": "Biblical Hebrew", "ar": "Arabic", "ja": "Japanese", "zh": "Chinese", "sa": "Sanskrit", "ang": "Old English", "non": "Old Norse",
}
CODE_OF_LANGUAGE = {
    "english": "en", "french": "fr", "german": "de", "spanish": "es", "italian": "it", "portuguese": "pt", "dutch": "nl", "swedish": "sv", "norwegian": "no",
    "danish": "da", "finnish": "fi", "irish": "ga", "welsh": "cy", "polish": "pl", "czech": "cs", "russian": "ru", "greek": "el", "ancient greek": "grc",
    "latin": "la", "hebrew": "he", "biblical hebrew": "hbo", "arabic": "ar", "aramaic": "arc", "old french": "fro", "middle english": "enm", "old english": "ang", "old norse": "non",
}
GENDER_OF_TYPE = {"Q12308941": "male", "Q11879590": "female", "Q3409032": "unisex"}


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key] if table else F.lit(None)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(trimmed(c), F.lit(""))


def collapsed(c: Column) -> Column:
    """Trimmed, every run of white space one space."""
    return F.regexp_replace(trimmed(c), f"{SPACE}+", " ")


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the lower-cased words, each padded by two spaces before and one after."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared over all trigrams; zero where neither has any."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))


def qid_of_uri(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(Q[0-9]+)$", 1), F.lit(""))


def qid_number(c: Column) -> Column:
    return F.regexp_extract(c, r"^Q([0-9]+)$", 1).try_cast("bigint")


def normalized_gender(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.contains("female"), "female").when(low.contains("male"), "male").when(low.contains("unisex"), "unisex").otherwise(low)


def page_url(word: Column) -> Column:
    """A dictionary page's address: spaces are underscores, all but a few marks are percent-encoded."""
    coded = F.url_encode(F.replace(word, F.lit(" "), F.lit("_")))
    for mark, code in (("!", "%21"), ("'", "%27"), ("(", "%28"), (")", "%29"), ("~", "%7E")):
        coded = F.replace(coded, F.lit(code), F.lit(mark))
    return F.concat(F.lit("https://en.wiktionary.org/wiki/"), coded)


def lemma_key(code: Column, label: Column) -> Column:
    return F.concat(F.lower(code), F.lit(":"), F.lower(label))


def displayable(c: Column) -> Column:
    """Two characters or more, not all of dashes and dots, with a letter in any script."""
    s = trimmed(F.coalesce(c, F.lit("")))
    return (F.char_length(s) >= 2) & ~s.rlike("^[-–—.*·•_…]+$") & s.rlike(r"\p{L}")


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def shown_name(label: Column, native: Column) -> Column:
    usable = lambda c: F.nullif(blank_to_null(c), F.lit("-"))
    return F.coalesce(usable(label), usable(native), F.lit("—"))
