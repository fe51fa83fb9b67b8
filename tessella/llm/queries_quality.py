"""Query of quality rules."""

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import read
from tessella.llm.quality import BOILERPLATE, PHRASE_SHARE, TEASER_WORDS, apply_quality_rules

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_failed_lines", "base_failed", "kept"]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_quality_rules(read(spark, sf_dir, "documents", "doc_id", "text")).select(*COLUMNS)


_COUNT = "(length({0}) - length(translate({0}, '{1}', '')))".format
_FAILS = f"""(({_COUNT('l', '|»›•')} >= 3 AND {_COUNT('l', '|»›•')} * 10 >= {_COUNT('l', ' ')} + 1)
 OR {_COUNT('l', '#*$%&<>=^~{}')} * 10 >= length(l)
 OR ({_COUNT('l', '!')} >= 3 AND {_COUNT('l', '!')} * 5 >= {_COUNT('l', ' ')} + 1)
 OR (regexp_matches(lower(l), '{BOILERPLATE}')
     AND (length(lower(l)) - length(regexp_replace(lower(l), '{BOILERPLATE}', '', 'g'))) * {PHRASE_SHARE} >= length(lower(l)))
 OR ((rtrim(l) LIKE '%...' OR rtrim(l) LIKE '%…') AND {_COUNT('l', ' ')} + 1 < {TEASER_WORDS})
 OR (len(string_split(l, ' ')) >= 4 AND
     2 * len(list_filter(string_split(l, ' '), lambda x, i: i > 1 AND x = string_split(l, ' ')[i - 1])) >= len(string_split(l, ' '))))"""

SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
twice AS (SELECT doc_id, g FROM g GROUP BY doc_id, g HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM g JOIN twice USING (doc_id, g)) GROUP BY doc_id),
j AS (SELECT doc_id, l, {_FAILS} AS failed FROM (SELECT doc_id, unnest(ls) AS l FROM l)),
v AS (SELECT doc_id, count(*) FILTER (failed) AS n_failed, count(*) - count(DISTINCT l) AS n_dup,
             coalesce(sum(length(l)) FILTER (NOT failed), 0) >= 0.5 * sum(length(l)) AS enough FROM j GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
             coalesce(r.n, 0) AS n_repeat_words, coalesce(n_failed, 0) AS n_failed_lines, coalesce(enough, TRUE) AS enough
      FROM w LEFT JOIN r USING (doc_id) LEFT JOIN v USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_failed_lines,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND enough AS kept
FROM m
"""
