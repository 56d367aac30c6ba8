"""Document quality rules with cross-document line frequency, in built-in functions only.

One scan writes a small profile of each row: counts for the base rules, and per line
two 64-bit hashes of the normalised line (lower case, white space collapsed) and its
host, with its number of word characters.  A line counts once for each document of a
host that holds it (copies are documents too; the count is combined before the
shuffle).  Lines found in more than ``share`` of a host's documents, and in more than
``floor`` of them, are removed, and a document whose word characters fall under
``min_left`` of what it had is rejected as depleted.  Only hashes and counts are
shuffled, never texts.

Nulls: a null text has no words and fails the base rules; a null source is a host of
its own.  Rows are told apart by their place, so repeated rows and repeated doc_ids
each get their own verdict and each count as a document.  A line in exactly the limit
of documents stays.  Very long texts are arrays of their words and lines within one
row; nothing is cut.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, written

SHARE, FLOOR, MIN_LEFT, MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 0.02, 5, 0.3, 20, 30, 8
_WHITE = r"[\x20\x09-\x0D]+"


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(text, _WHITE), "")


def _word_chars(text: Column) -> Column:
    return F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), _WHITE, " "))


def _joined(hashes: Column, step: int) -> Column:
    """Hash i with hash i + step, for as long as both are there."""
    n = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))


def repeated_words(words: Column) -> Column:
    """Words inside ``WINDOW``-word windows that occur twice or more in the array, the first occurrence included."""

    def covered(flagged: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
        step = lambda acc, i: F.struct((acc.n + i + WINDOW - F.greatest(i, acc.to)).alias("n"), (i + WINDOW).alias("to"))
        return F.aggregate(flagged, start, step).n

    def flagged(sorted_: Column) -> Column:
        same = F.filter(sorted_, lambda x, j: (x.h == F.get(sorted_, j - 1).h) | F.coalesce(x.h == F.get(sorted_, j + 1).h, F.lit(False)))
        return F.sort_array(F.transform(same, lambda x: x.i))

    def of_windows(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(let(F.sort_array(pairs), flagged)))

    # windows of 8 words are pairs of 4, these pairs of 2
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda one: let(_joined(one, 1), lambda two: let(_joined(two, 2), lambda four: let(_joined(four, 4), of_windows))))


def profile(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row a document: row, doc_id, host (hash), base counts, and its lines with a word as (h1, h2, chars)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    place = F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"), place.alias("place"))
    measured = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"), _word_chars(x).alias("chars")))

    def hashed(x: Column) -> Column:
        return let(_normal(x.line), lambda s: F.struct(F.xxhash64(s, F.col("place")).alias("h1"), F.xxhash64(F.col("place"), s, F.lit(7)).alias("h2"), x.chars.alias("chars")))

    counts = F.struct(
        let(word_list(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        let(
            F.filter(measured, lambda x: x.chars > 0),
            lambda x: F.struct(
                F.aggregate(x, F.lit(0).cast("long"), lambda n, y: n + y.chars).alias("word_chars"),
                (F.size(x) - F.size(F.array_distinct(x["line"]))).cast("long").alias("n_dup_lines"),
                F.transform(x, hashed).alias("lines"),
            ),
        ).alias("l"),
    )
    counted = rows.select("row", "doc_id", F.xxhash64("place").alias("host"), F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), counts.alias("c"))
    return counted.select("row", "doc_id", "host", "c.w.n_words", "c.l.word_chars", "n_symbols", "c.l.n_dup_lines", "c.w.n_repeat_words", "c.l.lines")


def frequent_lines(profiles: DataFrame, share: float = SHARE, floor: int = FLOOR) -> DataFrame:
    """(h1, h2, host, n_docs) of the lines found in more than ``floor`` and more than ``share`` of the documents of a host."""
    # array_distinct compares structs pair by pair; sorted, equal ones are neighbours
    each = let(F.sort_array(F.arrays_zip("lines.h1", "lines.h2")), lambda s: F.filter(s, lambda x, i: ~x.eqNullSafe(F.get(s, i - 1))))
    lines = profiles.select("host", F.explode(each).alias("x"))
    found = lines.groupBy("host", F.col("x.h1").alias("h1"), F.col("x.h2").alias("h2")).agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > floor)
    hosts = profiles.groupBy("host").agg(F.count("*").alias("host_docs"))
    return found.join(hosts, "host").filter(F.col("n_docs") > share * F.col("host_docs")).select("h1", "h2", "host", "n_docs")


def line_verdicts(docs: DataFrame, host: str = "source", share: float = SHARE, floor: int = FLOOR, min_left: float = MIN_LEFT) -> DataFrame:
    """Base counts of every row with base_failed, n_frequent_lines, removed_chars and kept."""
    rows = written(profile(docs, host))
    frequent = written(frequent_lines(rows, share, floor).select("h1", "h2"))
    each = rows.select("row", F.explode("lines").alias("x")).select("row", "x.h1", "x.h2", "x.chars")
    hits = each.join(frequent, ["h1", "h2"]).groupBy("row").agg(F.count("*").alias("n_frequent_lines"), F.sum("chars").alias("removed_chars"))
    out = rows.select("row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").join(hits, "row", "left").na.fill(0, ["n_frequent_lines", "removed_chars"])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = (F.col("word_chars") - F.col("removed_chars")) < min_left * F.col("word_chars")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted).drop("row")


def without_frequent_lines(docs: DataFrame, host: str = "source", share: float = SHARE, floor: int = FLOOR) -> DataFrame:
    """The documents with their frequent lines cut from ``text``; all columns and rows stay."""
    place = F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit(""))
    frequent = written(frequent_lines(written(profile(docs, host)), share, floor).select("h1", "h2", F.lit(True).alias("often")))
    rows = written(docs.select(F.monotonically_increasing_id().alias("__row"), F.struct(*docs.columns).alias("__doc"), place.alias("__place")))
    lines = rows.select("__row", "__place", F.posexplode(F.split("__doc.text", "\n")).alias("at", "line"))
    keyed = lines.withColumn("s", _normal(F.col("line"))).withColumns({"h1": F.xxhash64("s", "__place"), "h2": F.xxhash64("__place", "s", F.lit(7))})
    kept = keyed.join(frequent, ["h1", "h2"], "left").filter((_word_chars(F.col("line")) == 0) | F.col("often").isNull())
    texts = kept.groupBy("__row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x.line), "\n").alias("__text"))
    whole = rows.join(texts, "__row", "left")
    text = F.when(F.col("__doc.text").isNotNull(), F.coalesce("__text", F.lit(""))).alias("text")
    return whole.select(*[text if c == "text" else F.col(f"__doc.`{c}`").alias(c) for c in docs.columns])


def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_verdicts(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_frequent_lines", "removed_chars")


OP7_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, array_to_string(words[i:i+7], ' ') AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY rid),
ln AS (SELECT rid, host, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')) AS s, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS chars FROM (SELECT rid, host, unnest(lines) AS x FROM w)),
often AS (SELECT host, s FROM ln JOIN (SELECT host, count(*) AS docs FROM d GROUP BY host) USING (host) GROUP BY host, s, docs HAVING count(DISTINCT rid) > 5 AND count(DISTINCT rid) > 0.02e0 * docs),
rem AS (SELECT rid, count(*) AS k, sum(chars) AS c FROM ln JOIN often USING (host, s) GROUP BY rid),
b AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(rem.k, 0) AS n_frequent_lines, CAST(coalesce(rem.c, 0) AS BIGINT) AS removed_chars
  FROM w LEFT JOIN cov USING (rid) LEFT JOIN rem USING (rid))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (word_chars - removed_chars < 0.3e0 * word_chars) AS kept FROM b
"""
