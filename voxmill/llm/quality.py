"""Quality rules: how far a document's histograms lie from language references.

All of it is column functions: no Python runs on the executors and the only
shuffle is the aggregation of a handful of reference rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.llm.shared import SPACES, SPACES_REGEX, let, only
from voxmill.session import cut_lineage

SYMBOLS = "#*$%&|<>"
WINDOW = 5

# Frequent words of the languages that have a reference.
COMMON_WORDS: Mapping[str, Sequence[str]] = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was", "on", "by", "this"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "une", "que", "est", "pour", "dans", "qui", "au"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "nicht"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no", "una"),
}
VOCABULARY = sorted({word for words in COMMON_WORDS.values() for word in words})

# Guards: with less than this a histogram says nothing and does not reject.
MIN_CHARS = 100
MIN_WORDS = 40
# Largest distance (square root of the divergence in bits, 0 to 1) that is kept.
MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.40

# "bytes" are the bytes beyond one per character.
CHAR_CLASSES = ("lower", "upper", "digit", "space", "symbol", "punctuation", "bytes")


def _removed(text: Column, characters: str) -> Column:
    """How many of ``characters`` the text holds."""
    stripped = reduce(lambda col, c: F.replace(col, F.lit(c), F.lit("")), characters, text)
    return F.length(text) - F.length(stripped)


def _matched(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def text_words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES_REGEX))


def repeated_line_count(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def repeated_word_count(words: Column, window: int = WINDOW) -> Column:
    """Words in windows of ``window`` words that occur twice or more in the text.

    Windows are compared by 64-bit hash.  Texts without a repeated window, the
    many, cost one hash set; the others sort (hash, place) pairs.
    """

    def covered(places: Column) -> Column:
        steps = F.zip_with(
            F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0))),
            F.slice(places, 1, F.greatest(F.size(places) - 1, F.lit(0))),
            lambda after, before: F.least(after - before, F.lit(window)),
        )
        return F.aggregate(steps, F.lit(window), lambda total, step: total + step)

    def places(pairs: Column) -> Column:
        last = F.size(pairs) - 1
        same = F.filter(
            pairs,
            lambda pair, i: ((i > 0) & (pairs[F.greatest(i - 1, F.lit(0))]["h"] == pair["h"]))
            | ((i < last) & (pairs[F.least(i + 1, last)]["h"] == pair["h"])),
        )
        return F.sort_array(F.transform(same, lambda pair: pair["i"]))

    def count(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(F.sort_array(pairs), lambda p: let(places(p), covered))
        )

    def windows(hashed: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashed) - window)
        return F.transform(starts, lambda i: F.xxhash64(*(hashed[i + k] for k in range(window))))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < window, F.lit(0)).otherwise(let(hashed, lambda h: let(windows(h), count)))


def _char_counts(text: Column, spaces: Column, symbols: Column) -> Column:
    """Counts of the character classes.

    Lower-case letters and white space, the bulk, go in one pass over long
    runs; the classes are then counted in the short rest.
    """
    only_in = lambda rest, kept: F.length(F.regexp_replace(rest, f"[^{kept}]+", ""))

    def classes(rest: Column) -> Column:
        return F.array(
            F.length(text) - spaces - F.length(rest),
            only_in(rest, "A-Z"),
            only_in(rest, "0-9"),
            spaces,
            symbols,
            only_in(rest, r"!\"'()+,\-./:;=?@\[\\\]^_`{}~"),
            F.octet_length(text) - F.length(text),
        )

    return let(F.regexp_replace(text, r"[a-z\x20\u00DF-\u024F\x09-\x0D]+", ""), classes)


def _word_counts(words: Column) -> Column:
    """Counts of the common words, then of all other words."""
    found = F.concat(F.lit(" "), F.array_join(F.filter(words, lambda w: w.isin(VOCABULARY)), "  "), F.lit(" "))

    def count(joined: Column, word: str) -> Column:
        left = F.length(joined) - F.length(F.replace(joined, F.lit(f" {word} "), F.lit("")))
        return (left / F.lit(len(word) + 2)).cast("int")

    common = let(found, lambda joined: F.array(*(count(joined, word) for word in VOCABULARY)))
    total = lambda counts: F.aggregate(counts, F.lit(0), lambda a, b: a + b)
    return let(common, lambda c: F.concat(c, F.array(F.size(words) - total(c))))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = ("n_words", "n_repeat_words", "chars", "commons")
HISTOGRAMS = ("chars", "commons")


def describe(documents: DataFrame, fields: Sequence[str] = RULES, text: str = "text") -> DataFrame:
    """All columns of ``documents`` plus one struct column ``_q`` of counts.

    A null text counts as an empty one.  The struct comes out of a generator of
    one row, so that Catalyst neither repeats its expressions where they are
    used nor pushes filters on them below it.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    measures = {
        "n_words": lambda words, found: F.size(words),
        "n_repeat_words": lambda words, found: repeated_word_count(words),
        "commons": lambda words, found: _word_counts(words),
        "chars": lambda words, found: _char_counts(body, found[0], found[1]),
        "word_chars": lambda words, found: F.length(body) - found[0],
        "n_symbols": lambda words, found: found[1],
        "n_dup_lines": lambda words, found: repeated_line_count(body),
    }

    def counted(words: Column, found: Column) -> Column:
        return F.struct(*(measures[name](words, found).alias(name) for name in fields))

    found = F.array(_removed(body, SPACES), _removed(body, SYMBOLS))
    counts = let(text_words(body), lambda words: let(found, lambda pair: counted(words, pair)))
    return documents.select("*", F.explode(F.array(counts)).alias("_q"))


def _shares(counts: Column) -> Column:
    """Counts to shares; an empty histogram stays all zero."""
    total = F.aggregate(counts, F.lit(0), lambda a, b: a + b)
    return let(total, lambda n: F.transform(counts, lambda c: F.when(n == 0, F.lit(0.0)).otherwise(c / n)))


def fit_references(
    described: DataFrame,
    lang: str = "lang",
    languages: Sequence[str] = tuple(COMMON_WORDS),
) -> dict[str, tuple[list[float], list[float]]]:
    """Mean histograms of all documents of each language, long enough to count.

    Every such document weighs the same, so one very long text moves nothing.
    Only the languages asked for have a row, whatever the column holds: the
    result is at most ``len(languages)`` rows of fixed width.  A language
    without documents has no reference.
    """
    widths = {"chars": len(CHAR_CLASSES), "commons": len(VOCABULARY) + 1}
    long_enough = described.where(
        F.col(f"`{lang}`").isin(list(languages))
        & (F.aggregate("_q.chars", F.lit(0), lambda a, b: a + b) >= MIN_CHARS)
        & (F.aggregate("_q.commons", F.lit(0), lambda a, b: a + b) >= MIN_WORDS)
    ).select(
        F.col(f"`{lang}`").alias("lang"), *(_shares(F.col(f"_q.{name}")).alias(name) for name in widths)
    )
    means = [F.avg(F.col(name)[i]).alias(f"{name}{i}") for name, width in widths.items() for i in range(width)]
    rows = long_enough.groupBy("lang").agg(*means).collect()
    return {
        row["lang"]: tuple([row[f"{name}{i}"] for i in range(width)] for name, width in widths.items())
        for row in sorted(rows, key=lambda row: row["lang"])
    }


def _entropy(shares: Column) -> Column:
    terms = F.filter(shares, lambda p: p > 0)
    return F.aggregate(terms, F.lit(0.0), lambda total, p: total - p * F.log2(p))


def divergence(shares: Column, reference: Column) -> Column:
    """Jensen-Shannon distance, base 2: 0 for equal, 1 for disjoint histograms."""
    mixed = F.zip_with(shares, reference, lambda p, q: (p + q) / 2)
    found = _entropy(mixed) - (_entropy(shares) + _entropy(reference)) / 2
    return F.sqrt(F.greatest(found, F.lit(0.0)))


def _constants(shares: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(share)) for share in shares))


def _nearest(shares: Column, references: Mapping[str, Sequence[float]]) -> Column:
    """Distance to the nearest reference."""
    return F.array_min(F.array(*(divergence(shares, _constants(row)) for row in references.values())))


def _own(counts: Column, references: Mapping[str, Sequence[float]]) -> Column:
    """Distance to the reference of the language with most of its words in the text.

    Equal numbers go to the language that is first by name.
    """
    places = {
        lang: [VOCABULARY.index(word) for word in COMMON_WORDS[lang]] if lang in COMMON_WORDS else []
        for lang in references
    }
    hits = F.array(*(sum((counts[i] for i in found), F.lit(0)) for found in places.values()))
    rows = F.array(*(_constants(row) for row in references.values()))
    best = let(hits, lambda h: F.array_position(h, F.array_max(h)).cast("int") - 1)
    return divergence(_shares(counts), rows[best])


def judge(
    described: DataFrame,
    references: Mapping[str, tuple[Sequence[float], Sequence[float]]],
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """Add ``base_failed``, ``char_distance``, ``word_distance`` and ``kept``.

    The character distance is that to the nearest language, the word distance
    that to the language with most hits; either is null where the length guard holds (fewer than ``MIN_CHARS`` characters or ``MIN_WORDS`` words) or
    no reference exists; a null distance does not reject.  The document's own
    language column is not looked at.
    """
    n_words = F.col("_q.n_words").cast("long")
    base_failed = (n_words < 10) | (100 * F.col("_q.n_repeat_words").cast("long") > 20 * n_words)

    def distance(name: str, least: int, measure: Callable[[Column, Mapping], Column], which: int) -> Column:
        if not references:
            return F.lit(None).cast("double")
        counts = F.col(f"_q.{name}")
        enough = F.aggregate(counts, F.lit(0), lambda a, b: a + b) >= least
        return F.when(enough, measure(counts, {lang: rows[which] for lang, rows in references.items()}))

    chars = lambda counts, rows: let(_shares(counts), lambda s: _nearest(s, rows))

    measured = described.withColumn("base_failed", base_failed).withColumns(
        {
            "char_distance": F.when(~F.col("base_failed"), distance("chars", MIN_CHARS, chars, 0)),
            "word_distance": F.when(~F.col("base_failed"), distance("commons", MIN_WORDS, _own, 1)),
        }
    )
    far = F.coalesce(F.col("char_distance") > max_char_distance, F.lit(False)) | F.coalesce(
        F.col("word_distance") > max_word_distance, F.lit(False)
    )
    return measured.withColumn("kept", ~F.col("base_failed") & ~far)


def quality_table(documents: DataFrame) -> DataFrame:
    """One row per document: the base counts and the verdict.

    The counts are written once and read twice, for the references and for the
    verdict.  Repeated rows are judged each for itself; a null id stays null;
    an empty table gives an empty one.
    """
    fields = tuple(dict.fromkeys(COUNTS + RULES))
    rows = only(documents, doc_id="doc_id", text="text", lang="lang")
    described = cut_lineage(describe(rows, fields).drop("text"))
    counts = (F.col(f"_q.{name}").cast("long").alias(name) for name in COUNTS)
    return judge(described, fit_references(described)).select("doc_id", *counts, "base_failed", "kept")


def keep_good(documents: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns; needs ``text`` and ``lang``.

    The rows are read twice and never written: once for the references, which
    need the histograms only, and once for the verdicts.
    """
    references = fit_references(describe(only(documents, text="text", lang="lang"), HISTOGRAMS))
    rows = documents.select(F.struct(*(F.col(f"`{name}`") for name in documents.columns)).alias("row"))
    described = describe(rows.select("row", "row.text"))
    return judge(described, references).where("kept").select("row.*")
