"""Text functions: trimming, gates, redaction, language heuristic, lexicon tests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxmill.functions import lexicons as lex


# All white space, as ``str.isspace`` sees it.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip_space(text: Column) -> Column:
    """Remove white space of any kind at both ends (plain ``trim`` knows only blanks)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def passes_length(text: Column, max_chars: int = lex.MAX_CONTENT_LENGTH) -> Column:
    """Between 1 and ``max_chars`` characters once trimmed; null fails."""
    return F.length(strip_space(F.coalesce(text, F.lit("")))).between(1, max_chars)


def passes_characters(text: Column, allowed: str = lex.ALLOWED_CHARACTERS) -> Column:
    """Only allowed characters in the whole, untrimmed text."""
    return F.coalesce(text, F.lit("")).rlike(rf"(?U)^{allowed}$")


def is_clusterable(text: Column, min_chars: int = 3) -> Column:
    """More than ``min_chars`` characters once trimmed; null fails."""
    return F.length(strip_space(F.coalesce(text, F.lit("")))) > min_chars


def scrub_pii(text: Column) -> Column:
    """Replace e-mails, phones, IPs and handles, in that order; null becomes empty."""
    return reduce(
        lambda col, rule: F.regexp_replace(col, f"(?U){rule[1]}", rule[2]),
        lex.PII_PATTERNS,
        F.coalesce(text, F.lit("")),
    )


def count_pii(text: Column) -> dict[str, Column]:
    """Number of redactions per kind, counted the way ``scrub_pii`` makes them."""
    counts, rest = {}, F.coalesce(text, F.lit(""))
    for kind, pattern, token in lex.PII_PATTERNS:
        counts[kind] = F.regexp_count(rest, F.lit(f"(?U){pattern}"))
        rest = F.regexp_replace(rest, f"(?U){pattern}", token)
    return counts


def ascii_share(text: Column) -> Column:
    """Share of code points below 128; null for an empty text."""
    kept = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return kept / F.nullif(F.length(text), F.lit(0))


def is_likely_english(text: Column, threshold: float = lex.ENGLISH_ASCII_SHARE) -> Column:
    """ASCII share strictly above ``threshold``; an empty text counts as English."""
    return F.coalesce(ascii_share(text) > threshold, F.lit(True))


def needs_translation(text: Column, threshold: float = lex.ENGLISH_ASCII_SHARE) -> Column:
    """At least three characters once trimmed, and not likely English."""
    long_enough = F.length(strip_space(F.coalesce(text, F.lit("")))) >= 3
    return long_enough & ~is_likely_english(text, threshold)


def contains_any(lowered: Column, terms: Sequence[str], whole_word: bool = False) -> Column:
    """Does the lower-cased text contain one of the terms?

    By default a term may sit inside a longer word.
    """
    if whole_word:
        quoted = "|".join(rf"\Q{term}\E" for term in terms)
        return lowered.rlike(rf"(?U)\b(?:{quoted})\b")
    return reduce(lambda a, b: a | b, [lowered.contains(term) for term in terms])


def matching_tags(
    lowered: Column, lexicon: Mapping[str, Sequence[str]], whole_word: bool = False
) -> Column:
    """Labels whose terms occur in the lower-cased text, in lexicon order."""
    none = F.array().cast("array<string>")
    return F.concat(
        *[
            F.when(contains_any(lowered, terms, whole_word), F.array(F.lit(label))).otherwise(none)
            for label, terms in lexicon.items()
        ]
    )


def or_default(tags: Column, default: str = lex.DEFAULT_SEGMENT) -> Column:
    """The tags, or the default label alone if there are none."""
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit(default)))


def segment_tags(
    text: Column,
    lexicon: Mapping[str, Sequence[str]] = lex.SEGMENT_TERMS,
    default: str = lex.DEFAULT_SEGMENT,
    whole_word: bool = False,
) -> Column:
    """All matching labels in lexicon order, or the default label alone."""
    return or_default(matching_tags(F.lower(text), lexicon, whole_word), default)


def normal_name(name: Column) -> Column:
    """Lower case, trimmed, inner white space collapsed: the key of a theme."""
    return strip_space(F.regexp_replace(F.lower(name), r"(?U)\s+", " "))


def short_label(name: Column, limit: int = 20, keep: int = 18) -> Column:
    """Names over ``limit`` characters become the first ``keep`` plus dots."""
    return F.when(F.length(name) > limit, F.concat(F.substring(name, 1, keep), F.lit("..."))).otherwise(name)


def clean_quote(quote: Column) -> Column:
    """Strip quotation marks, white space and end marks from both ends."""
    edge = r"""["'\s.?!]+"""
    return F.regexp_replace(quote, f"^{edge}|{edge}$", "")
