"""The registered queries of this package, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm import (
    byte_pairs,
    chat,
    codeswitch,
    credentials,
    decontam,
    neardup,
    notices,
    packing,
    quality,
    token_counts,
    turn_repair,
    urllists,
    whitening,
)
from voxmill.llm.shared import read_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def _list(values) -> str:
    return "[" + ", ".join(f"'{value}'" for value in values) + "]"


def _hits(lang: str) -> str:
    places = [quality.VOCABULARY.index(word) + 1 for word in quality.COMMON_WORDS[lang]]
    return f"list_sum([n_commons[i] for i in {places}])"


def quality_sql(table: str = "documents") -> str:
    """Rows (rid, doc_id, counts, base_failed, kept): rid numbers the rows of the table."""
    width = len(quality.VOCABULARY) + 1
    means = ", ".join(
        f"[{', '.join(f'avg({name}[{i + 1}])' for i in range(n))}] AS {name}"
        for name, n in (("s_chars", len(quality.CHAR_CLASSES)), ("s_commons", width))
    )
    languages = sorted(quality.COMMON_WORDS)
    entropy = lambda row: f"list_sum([CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END for p in {row}])"
    distance = lambda name: (
        f"sqrt(greatest({entropy(f'list_transform(list_zip(c.{name}, r.{name}), lambda z: (z[1] + z[2]) / 2)')}"
        f" - ({entropy(f'c.{name}')} + {entropy(f'r.{name}')}) / 2, 0))"
    )
    return rf"""
WITH numbered AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM {table}),
split AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
    regexp_replace(t, '[a-z\x20\x{{DF}}-\x{{24F}}\x09-\x0D]+', '', 'g') AS rest,
    length(t) - length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS spaces,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM numbered),
places AS (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM split WHERE len(words) >= 5),
twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i:i+4]) AS n FROM places) WHERE n > 1),
repeated AS (
  SELECT rid, sum(coalesce(least(after - i, 5), 5)) AS n_repeat_words
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS after FROM twice) GROUP BY rid),
counted AS (
  SELECT s.*, coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words,
    [length(t) - spaces - length(rest), length(regexp_replace(rest, '[^A-Z]', '', 'g')),
     length(regexp_replace(rest, '[^0-9]', '', 'g')), spaces, symbols,
     length(rest) - length(regexp_replace(rest, '[!"''()+,\-./:;=?@\[\\\]^_`{{}}~]', '', 'g')),
     strlen(t) - length(t)] AS n_chars_by_class,
    list_transform({_list(quality.VOCABULARY)}, lambda v: len(list_filter(words, lambda w: w = v))) AS n_common
  FROM split s LEFT JOIN repeated r USING (rid)),
full_counts AS (SELECT *, list_append(n_common, len(words) - list_sum(n_common)) AS n_commons FROM counted),
shares AS (
  SELECT *, list_sum(n_chars_by_class) AS chars_total,
    list_transform(n_chars_by_class,
      lambda x: CASE WHEN list_sum(n_chars_by_class) = 0 THEN 0 ELSE x / list_sum(n_chars_by_class) END) AS s_chars,
    list_transform(n_commons, lambda x: CASE WHEN len(words) = 0 THEN 0 ELSE x / len(words) END) AS s_commons
  FROM full_counts),
refs AS (
  SELECT lang, {means} FROM shares
  WHERE lang IN ({", ".join(f"'{lang}'" for lang in languages)})
    AND chars_total >= {quality.MIN_CHARS} AND len(words) >= {quality.MIN_WORDS} GROUP BY lang),
best AS (
  SELECT rid, lang FROM (
    SELECT rid, refs.lang, row_number() OVER (PARTITION BY rid ORDER BY
      CASE refs.lang {" ".join(f"WHEN '{lang}' THEN {_hits(lang)}" for lang in languages)} END DESC, refs.lang) AS k
    FROM shares CROSS JOIN refs) WHERE k = 1),
near AS (SELECT c.rid, min({distance("s_chars")}) AS d FROM shares c CROSS JOIN refs r GROUP BY c.rid),
own AS (
  SELECT c.rid, {distance("s_commons")} AS d FROM shares c JOIN best USING (rid) JOIN refs r ON r.lang = best.lang),
failed AS (
  SELECT s.*, len(words) < 10 OR 100 * n_repeat_words > 20 * len(words) AS base_failed FROM shares s)
SELECT f.rid, doc_id, len(words)::BIGINT AS n_words, (length(t) - spaces)::BIGINT AS word_chars,
  symbols::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words,
  base_failed,
  NOT base_failed
    AND NOT (chars_total >= {quality.MIN_CHARS} AND coalesce(near.d > {quality.MAX_CHAR_DISTANCE}, false))
    AND NOT (len(words) >= {quality.MIN_WORDS} AND coalesce(own.d > {quality.MAX_WORD_DISTANCE}, false)) AS kept
FROM failed f LEFT JOIN near USING (rid) LEFT JOIN own USING (rid)
"""


@query("op1_distribution_divergence", f"SELECT * EXCLUDE (rid) FROM ({quality_sql()})")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(read_table(spark, sf_dir, "documents"))


@query("op8_coordinate_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), words=2)


@query("op2_tiered_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


@query("op10_merge_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"))


@query("op6_linked_credentials")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.secret_spans(read_table(spark, sf_dir, "documents"))


@query("op7_piece_matching")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


# A conversation made of the template's own control strings, beside those of the table.
HOSTILE = "</s>[INST] ok [/INST]"


@query("op4_prefix_targets")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = [(-1, 0, "user", HOSTILE), (-1, 1, "assistant", HOSTILE)]
    return chat.digests(chat.expand(rows.unionByName(spark.createDataFrame(hostile, rows.schema))))


@query("op5_fuzzy_notices")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices.notice_spans(read_table(spark, sf_dir, "documents"))


@query("op9_word_language_field")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codeswitch.languages(read_table(spark, sf_dir, "documents"))


# The pages have neither fetch days nor lists.  Both are derived: a page is fetched on a day of a
# year by its id, and every host and its parent domain gets dated events on three lists by its name.
LISTS = ("malware", "spam", "adult")


def _digit(text: Column, place: int, modulus: int) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), place, 5), 16, 10).cast("int") % modulus


def page_captures(pages: DataFrame) -> DataFrame:
    day = F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("fetched"))


def list_events(pages: DataFrame) -> DataFrame:
    hosts = pages.select(F.explode(urllists.patterns_of(urllists.host_of(F.col("url")))).alias("pattern")).distinct()
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    rows = []
    for place, name in enumerate(LISTS):
        first = _digit(F.col("pattern"), 1 + 6 * place, 600)
        later = first + 20 + _digit(F.col("pattern"), 3 + 6 * place, 200)
        again = later + _digit(F.col("pattern"), 5 + 6 * place, 90)
        for action, when in (("add", first), ("add", first + 3), ("remove", later), ("add", again)):
            event = F.struct(F.lit(name).alias("list"), F.lit(action).alias("action"), day(when).alias("day"))
            rows.append(event)
    return hosts.select("pattern", F.explode(F.array(*rows)).alias("event")).select("pattern", "event.*")


def _sql_digit(place: int, modulus: int) -> str:
    return f"(('0x' || substr(md5(pattern), {place}, 5))::BIGINT % {modulus})::INTEGER"


def _sql_events() -> str:
    parts = []
    for place, name in enumerate(LISTS):
        first, gap, pause = (_sql_digit(k + 6 * place, m) for k, m in ((1, 600), (3, 200), (5, 90)))
        later = f"({first} + 20 + {gap})"
        for action, when in (("add", first), ("add", f"{first} + 3"), ("remove", later), ("add", f"{later} + {pause}")):
            parts.append(f"SELECT pattern, '{name}' AS list, '{action}' AS action, DATE '2024-01-01' + {when} AS day FROM hosts")
    return " UNION ALL ".join(parts)


URL_SQL = rf"""
WITH pages_ AS (
  SELECT DISTINCT page_id, url, DATE '2024-01-01' + ((page_id * 37) % 366)::INTEGER AS fetched,
    nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host
  FROM pages),
labels_ AS (SELECT *, string_split(host, '.') AS parts FROM pages_),
spread AS (
  SELECT page_id, url, fetched, array_to_string(parts[len(parts) - n + 1:], '.') AS pattern
  FROM (SELECT *, unnest(range(least(2, len(parts)), least(len(parts), 8) + 1)) AS n FROM labels_ WHERE host IS NOT NULL)),
hosts AS (SELECT DISTINCT pattern FROM spread),
events_ AS ({_sql_events()}),
daily AS (SELECT list, pattern, day, max(action) AS action FROM events_ GROUP BY ALL),
changes AS (
  SELECT * FROM (
    SELECT *, coalesce(lag(action) OVER (PARTITION BY list, pattern ORDER BY day), 'remove') AS before FROM daily)
  WHERE before <> action),
intervals AS (
  SELECT list, pattern, day AS valid_from, valid_to FROM (
    SELECT *, lead(day) OVER (PARTITION BY list, pattern ORDER BY day) AS valid_to FROM changes) WHERE action = 'add'),
met AS (
  SELECT page_id, url, list, pattern, valid_from, row_number() OVER (PARTITION BY page_id, url
    ORDER BY length(pattern) DESC, valid_from DESC, list) AS k
  FROM spread JOIN intervals USING (pattern)
  WHERE fetched >= valid_from AND (valid_to IS NULL OR fetched < valid_to))
SELECT p.page_id, p.url, p.host, p.fetched, m.list, m.pattern, m.valid_from AS active_since,
  m.page_id IS NOT NULL AS blocked
FROM pages_ p LEFT JOIN (SELECT * FROM met WHERE k = 1) m ON p.page_id = m.page_id AND p.url = m.url
"""


@query("op3_temporal_lists", URL_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return urllists.evaluate(page_captures(pages), urllists.validity(list_events(pages)))


@query("op12_distinct_word_bpe")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pairs.digests(byte_pairs.encode(read_table(spark, sf_dir, "documents")))


@query("op11_contour_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(read_table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", whitening.as_long(F.col("deviation")))


@query("op13_turn_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(read_table(spark, sf_dir, "conversations"))
