r"""Secret scans with corpus-wide ownership frequency.

One scan finds candidates in every whole text, on its UTF-8 bytes: three base kinds
(assignments to a name like ``token``, access keys, long runs of hex digits), the
leftmost non-overlapping matches of each, and ``owned``: maximal runs of 20 or more
characters of ``[A-Za-z0-9+/_=-]`` that look live and lie in no base match.  A value
looks live if it has a letter and a digit, ``DISTINCT`` different characters or more,
and none of the words that examples are made of.

Candidates leave the scan as 128-bit hashes of their values (an assignment's is its
right-hand side).  A hash is counted over the corpus by distinct owners and distinct
repositories (owner and name); both counts are combined before the shuffle, first by
(hash, owner, repository), then by (hash, owner), then by hash, so a value that a third
of all rows hold is spread over its owners.  A value with ``min_owners`` owners or
more, or ``min_repos`` repositories or more, is a widely copied example; one with a
single owner that looks live is a credential of that owner.  Base spans always stay;
``owned`` candidates become spans only if they are such credentials.

A span is a whole match: start and end count code points, end exclusive.  Nulls: a null
text is empty; a null owner or repository is one of its own.  Rows are told apart by
their place, so repeated rows and repeated or missing doc_ids each get their row.  Very
long texts are scanned whole, one at a time; equal starts are ordered assign, access,
hex, owned.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .common import table, written

MIN_OWNERS, MIN_REPOS, DISTINCT = 3, 6, 8
KINDS = ("assign", "access", "hex", "owned")

# Fixed patterns of the base kinds, with their least lengths, and words that mark made-up values.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST, OWNED_LEAST = 6, 20, 24, 20
EXAMPLE = re.compile(rb"example|sample|dummy|changeme|placeholder|xxxx|your", re.I)
_LETTER, _DIGIT = re.compile(rb"[A-Za-z]"), re.compile(rb"[0-9]")

_HEX = B.table(b"0123456789abcdef")
_TOKEN = B.table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")


def looks_live(value: bytes) -> bool:
    return len(set(value)) >= DISTINCT and bool(_LETTER.search(value)) and bool(_DIGIT.search(value)) and not EXAMPLE.search(value)


def _runs(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(document, start, end) of the maximal runs of at least that many bytes."""
    start, end, doc = B.words(buf, offsets, inside)
    for k in np.flatnonzero(end - start >= least).tolist():
        yield int(doc[k]), int(start[k]), int(end[k])


def _found(buf: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, bytes]]:
    """(document, start, kind, end, value) of all candidates, in bytes of the buffer, in this order."""
    data, at, out = buf.tobytes(), offsets.tolist(), []
    for d, (lo, hi) in enumerate(zip(at, at[1:])):
        out += [(d, m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(data, lo, hi) if len(m[2]) >= ASSIGN_LEAST]
        if data.find(b"AKIA", lo, hi) >= 0:
            out += [(d, m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(data, lo, hi) if len(m[0]) >= ACCESS_LEAST]
    out += [(d, lo, 2, hi, data[lo:hi]) for d, lo, hi in _runs(buf, offsets, _HEX, HEX_LEAST)]
    base = np.zeros(len(buf) + 1, np.int32)  # how many base matches cover a byte
    for _, lo, _, hi, _ in out:
        base[lo] += 1
        base[hi] -= 1
    covered = np.append(0, np.cumsum(np.cumsum(base[:-1]) > 0)) if out else base
    more = [(d, lo, 3, hi, data[lo:hi]) for d, lo, hi in _runs(buf, offsets, _TOKEN, OWNED_LEAST) if covered[lo] == covered[hi]]
    return sorted(out + [x for x in more if looks_live(x[4])])


def candidates(docs: DataFrame, owner: str, repo: str) -> DataFrame:
    """(row, doc_id, base_sha256, spans array<kind, start, end, value, live>) of each row, with its owner and repository; value is a hash."""
    schema = "row long, doc_id long, owner string, repo string, base_sha256 string, spans array<struct<kind: int, start: long, end: long, value: binary, live: boolean>>"
    struct = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.binary()), ("live", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offsets in B.chunks(batches, "text"):
            point = np.append(0, np.cumsum((buf & 0xC0) != 0x80))
            spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for d, lo, kind, hi, value in _found(buf, offsets):
                first = point[offsets[d]]
                spans[d].append({"kind": kind, "start": int(point[lo] - first), "end": int(point[hi] - first), "value": xxhash.xxh128_digest(value), "live": looks_live(value)})
            base = [hashlib.sha256(",".join(f"{KINDS[x['kind']]}:{x['start']}:{x['end']}" for x in s if x["kind"] < 3).encode()).hexdigest() for s in spans]
            columns = [part.column(k) for k in range(4)] + [pa.array(base), pa.array(spans, pa.list_(struct))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "owner", "repo", "base_sha256", "spans"])

    own = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), own(owner)("owner"), own(repo)("repo"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, schema)


def ownership(found: DataFrame) -> DataFrame:
    """(value, n_owners, n_repos, n_found) of every candidate hash of ``candidates``."""
    each = found.select("owner", "repo", F.explode("spans.value").alias("value"))
    by_repo = each.groupBy("value", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("value", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_found"))


def scan(docs: DataFrame, owner: str = "source", repo: str = "lang", min_owners: int = MIN_OWNERS, min_repos: int = MIN_REPOS) -> DataFrame:
    """(doc_id, base_sha256, spans array<start, kind, end, n_owners, n_repos, verdict>): the base spans and the credentials of one owner.

    verdict is ``copied`` (a widely copied example), ``owned`` (one owner, looks live) or ``other``.
    """
    found = written(candidates(docs, owner, repo))
    counts = written(ownership(found))
    each = found.select("row", F.explode("spans").alias("s")).select("row", "s.*").join(counts, "value")
    copied = (F.col("n_owners") >= min_owners) | (F.col("n_repos") >= min_repos)
    verdict = F.when(copied, "copied").when((F.col("n_owners") == 1) & F.col("live"), "owned").otherwise("other")
    judged = each.withColumn("verdict", verdict).filter((F.col("kind") < 3) | (F.col("verdict") == "owned"))
    spans = judged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "n_owners", "n_repos", "verdict"))).alias("spans"))
    return found.select("row", "doc_id", "base_sha256").join(spans, "row", "left").select("doc_id", "base_sha256", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's owner is its source, its repository the source's documents of one language."""
    out = scan(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")
    said = lambda v: F.size(F.filter("spans", lambda s: s.verdict == v)).cast("long")
    name = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s.kind + 1), s.start, s.end)
    return out.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), "base_sha256", F.concat_ws(",", F.transform("spans", name)).alias("spans"),
        of(3).alias("n_added"), said("owned").alias("n_owned"), said("copied").alias("n_copied"),
    )


def _sql_found(kind: int, pattern: str, least: int, value: str) -> str:
    """Matches of one kind with their places: the text is cut after each match, so the next one begins where it is first found."""
    return f"""
SELECT rid, {kind} AS kind, a, b, {value} AS v FROM (
  WITH RECURSIVE r(rid, rest, base, a, b, m) AS (
    SELECT rid, t, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR) FROM d WHERE regexp_matches(t, '{pattern}')
    UNION ALL
    SELECT rid, substr(rest, p + length(n)), base + p + length(n) - 1, base + p - 1, base + p - 1 + length(n), n FROM
      (SELECT rid, rest, base, n, CAST(instr(rest, n) AS BIGINT) AS p FROM (SELECT rid, rest, base, regexp_extract(rest, '{pattern}') AS n FROM r) WHERE n <> ''))
  SELECT * FROM r WHERE m IS NOT NULL) WHERE length({value}) >= {least}"""


_NAMES = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
_ASSIGN_SQL = _NAMES + r"[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
_LIVE_SQL = "len(list_distinct(string_split(v, ''))) >= 8 AND regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]') AND NOT regexp_matches(v, '(?i)example|sample|dummy|changeme|placeholder|xxxx|your')"
_SPAN = "string_agg(concat(['assign', 'access', 'hex', 'owned'][kind + 1], ':', a, ':', b), ',' ORDER BY a, kind)"

OP11_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS owner, coalesce('=' || lang, '') AS repo, coalesce(text, '') AS t FROM documents),
base AS MATERIALIZED ({_sql_found(0, _ASSIGN_SQL, 6, "regexp_extract(m, '" + _ASSIGN_SQL + "', 1)")} UNION ALL {_sql_found(1, 'AKIA[A-Z0-9]+', 20, 'm')} UNION ALL {_sql_found(2, '[0-9a-f]{24,}', 24, 'm')}),
more AS (SELECT * FROM ({_sql_found(3, '[A-Za-z0-9+/_=-]{20,}', 20, 'm')}) x WHERE {_LIVE_SQL} AND NOT EXISTS (SELECT 1 FROM base y WHERE y.rid = x.rid AND y.a < x.b AND x.a < y.b)),
each AS MATERIALIZED (SELECT *, {_LIVE_SQL} AS live FROM (SELECT * FROM base UNION ALL SELECT * FROM more) JOIN d USING (rid)),
n AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT struct_pack(o := owner, r := repo)) AS repos FROM each GROUP BY v),
judged AS (SELECT rid, kind, a, b, CASE WHEN owners >= 3 OR repos >= 6 THEN 'copied' WHEN owners = 1 AND live THEN 'owned' ELSE 'other' END AS verdict FROM each JOIN n USING (v)),
kept AS (SELECT * FROM judged WHERE kind < 3 OR verdict = 'owned'),
s AS (SELECT rid, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex, {_SPAN} AS spans,
  {_SPAN} FILTER (WHERE kind < 3) AS base_spans, count(*) FILTER (WHERE kind = 3) AS n_added, count(*) FILTER (WHERE verdict = 'owned') AS n_owned, count(*) FILTER (WHERE verdict = 'copied') AS n_copied FROM kept GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_added, 0) AS n_added, coalesce(n_owned, 0) AS n_owned, coalesce(n_copied, 0) AS n_copied FROM d LEFT JOIN s USING (rid)
"""
