"""Quality rules with verdicts on whole hosts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, let, prepare, table, words_of

SYMBOLS = "#*$%&|<>"
_POS_BITS = 24
_POS_MASK = (1 << _POS_BITS) - 1


def _same_window(windows, k, key):
    """Whether the sorted array's element k shares its key with a neighbour."""
    return key(windows[k]).eqNullSafe(key(F.get(windows, k - 1))) | key(windows[k]).eqNullSafe(key(F.get(windows, k + 1)))


def _repeat_words(words: Column, n_words: Column) -> Column:
    """Words covered by 3-word windows that a text holds twice or more.

    Windows are sorted by (40 hash bits, position) packed in one long, which keeps the sort
    primitive; those that meet an equal hash are then compared as strings, so the count is exact.
    """
    text_at = lambda i: F.concat_ws(" ", words[i], words[i + 1], words[i + 2])
    starts = F.sequence(F.lit(0), n_words - 3)
    pack = lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]).bitwiseAND(F.lit(~_POS_MASK)).bitwiseOR(i.cast("long"))
    meets = lambda s: F.filter(s, lambda x, k: _same_window(s, k, lambda v: F.shiftright(v, _POS_BITS)))
    by_hash = F.transform(let(F.sort_array(F.transform(starts, pack)), meets), lambda x: x.bitwiseAND(F.lit(_POS_MASK)).cast("int"))
    candidates = F.when(n_words <= _POS_MASK, by_hash).otherwise(starts)
    exact = lambda s: F.filter(s, lambda x, k: _same_window(s, k, lambda v: v["t"]))
    repeated = let(F.sort_array(F.transform(candidates, lambda i: F.struct(text_at(i).alias("t"), i.alias("i")))), exact)
    at = F.sort_array(F.transform(repeated, lambda x: x["i"]))
    gain = lambda p: F.transform(p, lambda x, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(p, k - 1))))
    covered = F.aggregate(let(at, gain), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(n_words < 3, F.lit(0).cast("long")).otherwise(covered)


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs) and n_lines.

    Null and empty texts measure 0 throughout. The measures of a row depend on its text alone, so
    repeated rows get equal ones. Columns of these names that the input has are replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    df = df.withColumn("_words", words_of(F.col(text))).withColumn("_n", F.size("_words")).withColumn("_lines", lines)
    return df.withColumns({
        "n_words": F.col("_n").cast("long"),
        "word_chars": F.length(F.translate(whole, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": _repeat_words(F.col("_words"), F.col("_n")),
    }).drop("_words", "_n", "_lines")


def rules() -> dict[str, Column]:
    """Rules over the measures; each is true where a document fails."""
    return {
        "base": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "symbols": 100 * F.col("n_symbols") > 30 * F.col("n_words"),
        "dup_lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
    }


def host_rates(df: DataFrame, host: str = "source", strength: float = 100.0) -> DataFrame:
    """One row per host: n_docs, n_failed, rate shrunk by an empirical beta prior.

    ``df`` has a boolean column ``failed``. The prior's mean m and variance v are those of the host
    rates (each host once); its strength is m(1-m)/v - 1, or ``strength`` where the hosts don't
    differ or differ more than a beta could (v = 0, or v >= m(1-m)). A null host is a host.
    Partial sums are made before the shuffle, so a host with a third of all rows costs no more.
    """
    hosts = df.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    one = hosts.agg(F.avg(F.col("n_failed") / F.col("n_docs")).alias("m"), F.var_pop(F.col("n_failed") / F.col("n_docs")).alias("v")).first()
    m, v = (one["m"] or 0.0, one["v"] or 0.0) if one else (0.0, 0.0)
    s = m * (1 - m) / v - 1 if 0 < v < m * (1 - m) else strength
    return hosts.withColumn("rate", (F.col("n_failed") + F.lit(m * s)) / (F.col("n_docs") + F.lit(s)))


def judge(df: DataFrame, text: str = "text", host: str = "source", most: float = 0.5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with measures, base_failed and kept.

    A document goes if it fails the base rule, or if its host's shrunk rate of documents that fail
    any rule exceeds ``most``. Only the slim measures are shuffled, never texts. An empty table
    gives an empty result; repeated rows are judged alike and all returned.
    """
    prepare(df.sparkSession)
    names = [*dict.fromkeys(keep)]
    slim = df.select(*names, F.col(host).alias("_host"), F.col(text).alias("_text"))
    slim = measure(slim, "_text").drop("_text")
    broken = rules()
    any_rule = F.lit(False)
    for rule in broken.values():
        any_rule = any_rule | rule
    slim = slim.withColumn("base_failed", broken["base"]).withColumn("failed", any_rule).checkpoint()
    hosts = host_rates(slim, "_host").select(F.col("_host").alias("_h"), (F.col("rate") > most).alias("_bad"))
    joined = slim.join(hosts, F.col("_host").eqNullSafe(F.col("_h")), "left")
    kept = ~(F.col("base_failed") | F.coalesce(F.col("_bad"), F.lit(False)))
    return joined.select(*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def op5_quality_rules(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"))


SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
windows AS (
  SELECT rid, unnest(range(1, len(words) - 1)) AS p, words FROM base WHERE len(words) >= 3),
marked AS (
  SELECT rid, p, count(*) OVER (PARTITION BY rid, words[p] || ' ' || words[p + 1] || ' ' || words[p + 2]) AS c FROM windows),
steps AS (
  SELECT rid, least(3, coalesce(p - lag(p) OVER (PARTITION BY rid ORDER BY p), 3)) AS step FROM marked WHERE c > 1),
repeats AS (SELECT rid, sum(step)::BIGINT AS n FROM steps GROUP BY rid),
lines AS (
  SELECT rid, count(*) AS n, count(DISTINCT line) AS d
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM base)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
measured AS (
  SELECT b.rid, doc_id, source, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(l.n, 0)::BIGINT AS n_lines, coalesce(l.n - l.d, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM base b LEFT JOIN lines l USING (rid) LEFT JOIN repeats r USING (rid)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured),
failing AS (
  SELECT *, base_failed OR 100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 30 * n_lines AS failed FROM judged),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (failed) AS f FROM failing GROUP BY source),
prior AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM hosts),
shaped AS (SELECT m, CASE WHEN v > 0 AND v < m * (1 - m) THEN m * (1 - m) / v - 1 ELSE 100.0 END AS s FROM prior),
verdicts AS (SELECT source, (f + m * s) / (n + s) > 0.5 AS bad FROM hosts CROSS JOIN shaped)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR bad) AS kept
FROM failing x JOIN verdicts v ON x.source IS NOT DISTINCT FROM v.source
"""
QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLES = {"op5_quality_rules": SQL}
