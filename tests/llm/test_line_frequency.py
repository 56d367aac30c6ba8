from __future__ import annotations

import random
import re
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from splitforge.llm import line_frequency as L

from .helpers import DOCS, awkward, frame, saved, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def norm(line):
    return " ".join(WORD.findall(line.lower()))


def brute(rows, share, floor):
    docs, size = defaultdict(set), defaultdict(int)
    for k, r in enumerate(rows):
        size[r[3]] += 1
        for line in (r[1] or "").split("\n"):
            if WORD.search(line):
                docs[r[3], norm(line)].add(k)
    out = []
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        at = defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        repeated = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
        often = [x for x in lines if len(docs[r[3], norm(x)]) > max(floor, share * size[r[3]])]
        chars, gone = sum(map(len, w)), sum(len(x) for line in often for x in WORD.findall(line))
        failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
        out.append((r[0], len(w), chars, sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated), len(often), gone, failed, not failed and not chars - gone < 0.3 * chars))
    return sorted(out, key=str)


def case(seed):
    rng = random.Random(seed)
    rows = awkward(seed)
    common, other = words(rng, 25), "  Copyright   #1 \t ALL  rights "
    for k in range(12):
        rows.append((600 + k, f"{common}\n{other}\n{words(rng, 3)}\n\n{words(rng, k)}\n{common.upper()}", "en", "host", 1))
    rows += [(700 + k, rows[-1][1], "en", "host", 1) for k in range(9)]  # exact copies are documents too
    rows += [(800 + k, f"{words(rng, 30)}\nonly copied here", "en", "s9", 1) for k in range(3)] + [(820 + k, "a\nb\na\na # $\n" + "rep eat " * 20, None, None, 1) for k in range(2)]
    return rows


def test_equals_brute_force(spark):
    for seed, share, floor in ((1, L.SHARE, L.FLOOR), (2, 0.5, 2), (3, 0.0, 500), (4, 12 / 21, 2)):
        rows = case(seed)
        out = L.line_verdicts(frame(spark, rows, extra=True), share=share, floor=floor)
        names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_frequent_lines", "removed_chars", "base_failed", "kept"]
        got = sorted((tuple(r) for r in out.select(*names).collect()), key=str)
        want = brute(rows, share, floor)
        assert got == want
        assert floor > 5 or any(not r[8] and not r[9] for r in want)  # some are depleted


def test_query_equals_sql_and_its_rule_acts(spark):
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    out = L.op7_line_frequency(spark, "/root/testdata/sf0.01").toPandas()
    want = con.execute(L.OP7_SQL).df()[list(out.columns)]
    assert out.sort_values("doc_id").to_dict("list") == want.sort_values("doc_id").to_dict("list")
    assert (out.n_frequent_lines > 0).sum() > 0


def test_very_long_text(spark):
    lines = [f"line {k} of a long text" for k in range(40_000)]
    rows = [(1, "\n".join(lines), "en", "s", 1), (2, "\n".join(lines[:20_000] * 2), "en", "s", 1)]
    out = {r.doc_id: r for r in L.line_verdicts(frame(spark, rows)).collect()}
    assert (out[1].n_words, out[1].n_dup_lines, out[1].n_repeat_words) == (240_000, 0, 0)
    assert (out[2].n_words, out[2].n_dup_lines, out[2].n_repeat_words) == (240_000, 20_000, 240_000)


def test_lines_are_removed(spark):
    rows = case(1)
    got = {r.doc_id: r.text for r in L.without_frequent_lines(frame(spark, rows), share=0.1).filter("doc_id between 600 and 611").collect()}
    first = next(r[1] for r in rows if r[0] == 600).split("\n")
    assert got[600] == "\n".join(first[2:-1])
    assert L.without_frequent_lines(frame(spark, rows), floor=500).join(frame(spark, rows).select("doc_id", F.col("text").alias("old")), "doc_id").filter("not text <=> old").count() == 0


def test_native_plan_and_empty(spark, tmp_path):
    empty = spark.createDataFrame([], DOCS)
    assert L.line_verdicts(empty).count() == 0
    assert L.without_frequent_lines(empty).count() == 0
    saved(frame(spark, case(1)), str(tmp_path), "documents")
    plan = L.op7_line_frequency(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
