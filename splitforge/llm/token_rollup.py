"""Token totals by source, language and tokenizer version, kept up by signed batches.

A batch is a frame of changes: source, lang, tokenizer, docs (+1, 0 or -1) and
tokens (signed).  An insert adds a document and its tokens, a delete subtracts what
was added, a revision is the difference of new and old count, or a delete from one
key and an insert to another.  ``commit`` aggregates a batch (combined before the
shuffle) and writes its few totals under the batch's id, then marks the id as
committed.  A batch whose id is marked is skipped, and one that died half way is
simply written again, so retries and replays change nothing; one writer at a time
commits to a rollup.  Totals are the sum over committed batches (a semi-join with the
ledger); ``compact`` folds them into one batch and one ledger file.

Tokens are counted by a byte-pair vocabulary file (path is a parameter; the file is
read once on the driver and broadcast, a few hundred KB) or, as version "bytes", as UTF-8
bytes.  Nulls: a null text has no tokens; null source, lang are groups of their own;
changes with null counts add nothing.  Repeated rows count each time; there are no
ties.  Texts of any length are counted whole: runs of white space longer than
``_RUN``, on which the vocabulary's pattern would backtrack, are cut out and counted as
the one token piece that the pattern makes of them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_RUN = 5_000
_LONG_RUN = regex.compile(rf"\p{{White_Space}}{{{_RUN},}}")
KEYS = ["source", "lang", "tokenizer"]


def _encoder(lines: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(encoder, text: str) -> int:
    """Tokens of the whole text.

    The pattern takes a run of white space before another character as one piece but
    for its last character, which starts the next piece; a run that ends the text is
    one piece as a whole.
    """
    n = at = 0
    for run in _LONG_RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        n += len(encoder.encode_ordinary(text[at : run.start()]))
        n += len(encoder._encode_single_piece(text[run.start() : end]))
        at = end
    return n + len(encoder.encode_ordinary(text[at:]))


def count_tokens(docs: DataFrame, text: str, out: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs without ``text`` and with ``out``, the whole text's number of tokens."""
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    others = [c for c in docs.columns if c not in (text, out)]
    schema = docs.select(*others).withColumn(out, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            counts = [n_tokens(encoder, t.as_py()) if t.is_valid else 0 for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*batch.schema.names[:-1], out])

    return docs.select(*others, F.col(text)).mapInArrow(run, schema)


class Rollup:
    """Batch totals and the ledger of committed batches, as Parquet folders below ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, part: str, schema: str) -> DataFrame:
        """A part of the rollup, empty before the first commit."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def committed(self) -> DataFrame:
        """(id) of the committed batches."""
        return self._read("committed", "id long, batch long").select("id")

    def _mark(self, ids: DataFrame, batch: int) -> None:
        ids.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/committed/batch={batch}")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Adds a batch once; False if it was committed before."""
        if not self.committed().filter(F.col("id") == batch).isEmpty():
            return False
        totals = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        totals.write.mode("overwrite").parquet(f"{self.path}/totals/batch={batch}")
        self._mark(self.spark.range(batch, batch + 1), batch)
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) over committed batches; keys whose documents are all gone stay with zeros."""
        parts = self._read("totals", "source string, lang string, tokenizer string, docs long, tokens long, batch long")
        parts = parts.join(self.committed().select(F.col("id").alias("batch")), "batch", "left_semi")
        zero = F.lit(0).cast("long")
        return parts.groupBy(*KEYS).agg(F.coalesce(F.sum("docs"), zero).alias("docs"), F.coalesce(F.sum("tokens"), zero).alias("tokens"))

    def compact(self, path: str) -> Rollup:
        """A new rollup below ``path`` with the same totals in one batch and the same committed ids."""
        new, one = Rollup(self.spark, path), self.committed().agg(F.min("id")).first()[0]
        if one is not None:
            self.totals().write.parquet(f"{new.path}/totals/batch={one}")
            new._mark(self.committed(), one)
        return new


def op3_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted under two tokenizer versions; then, by md5 of doc_id, 1 in 16 deleted and 1 in 16 revised (its source's name is appended); the deletes come twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    fate = F.coalesce(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 1), F.lit("-"))
    revised = F.concat_ws("\n", F.col("text"), F.col("source"))
    texts = docs.select("source", "lang", fate.alias("fate"), F.explode(F.array(F.struct(F.lit(0).alias("version"), F.col("text").alias("text")), F.struct(F.lit(1).alias("version"), F.when(fate == "1", revised).alias("text")))).alias("x"))
    texts = texts.select("source", "lang", "fate", "x.version", F.coalesce(F.octet_length("x.text"), F.lit(0)).cast("long").alias("bytes"), "x.text").filter("version = 0 or fate = '1'")
    counts = written(count_tokens(texts, "text", "bpe"))
    each = counts.select("source", "lang", "fate", "version", F.explode(F.create_map(F.lit("byte_bpe_50k"), F.col("bpe"), F.lit("bytes"), F.col("bytes"))).alias("tokenizer", "n"))

    def changes(rows: DataFrame, n_docs: int, tokens) -> DataFrame:
        return rows.select(*KEYS, F.lit(n_docs).cast("long").alias("docs"), tokens.alias("tokens"))

    old, new = each.filter("version = 0"), each.filter("version = 1")
    deletes = changes(old.filter("fate = '0'"), -1, -F.col("n"))
    revisions = changes(old.filter("fate = '1'"), 0, -F.col("n")).unionByName(changes(new, 0, F.col("n")))
    rollup = Rollup(spark, shared_dir(spark))
    rollup.commit(0, changes(old, 1, F.col("n")))
    rollup.commit(1, deletes)
    rollup.commit(2, revisions)
    rollup.commit(1, deletes)
    return rollup.totals()
