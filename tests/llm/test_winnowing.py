from __future__ import annotations

import hashlib
import random
import re
import time

import pyarrow as pa

from splitforge.llm import bytesops as B
from splitforge.llm import winnowing as W

from .helpers import DOCS, awkward, frame, saved, words

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return WORD.findall((text or "").encode().translate(LOWER))


def brute(docs, items, window=10):
    out = []
    for doc_id, text, *_ in docs:
        w = tokens(text)
        hit, found = [False] * len(w), set()
        for item, item_text in items:
            t = tokens(item_text)
            n = min(window, len(t))
            if not n:
                continue
            grams = {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit[i : i + n] = [True] * n
                    if item is not None:
                        found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), sum(hit), len(found), digest, any(hit)))
    return sorted(out, key=str)


def case(seed=3):
    rng = random.Random(seed)
    docs = awkward(seed)
    long = [words(rng, 30) for _ in range(4)]
    items = [(f"b{k}", t) for k, t in enumerate(long)]
    items += [("short", "w1 w2"), ("one", "w7"), ("punct", "...!!"), ("null", None), (None, long[0]), ("b0", long[1]), ("b2", "Ünïcode ÀÉ wörds 漢字"), ("nine", " ".join(long[3].split()[:9])), ("tie", "a " * 30)]
    docs += [(500, "x " + long[0].upper() + " y", "en", "s", 1), (501, " ".join(long[1].split()[5:15]), "en", "s", 1), (502, " ".join(long[1].split()[5:14]), "en", "s", 1), (503, long[2].replace(" ", " - "), "en", "s", 1), (504, "a " * 12, "", "", 1), (505, long[3] + " " + long[3], "", "", 1)]
    return docs, items


def run(spark, tmp_path, docs, items, extra=False):
    saved(frame(spark, docs, extra), str(tmp_path), "documents")
    saved(spark.createDataFrame(items, "item_id string, text string"), str(tmp_path), "benchmark")
    return sorted((tuple(r) for r in W.op6_winnowing(spark, str(tmp_path)).collect()), key=str)


def test_equals_brute_force(spark, tmp_path):
    docs, items = case()
    want = brute(docs, items)
    assert sum(r[5] for r in want) > 5
    assert run(spark, tmp_path, docs, items, extra=True) == want


def test_repeated_words_and_long_texts(spark, tmp_path):
    docs = [(1, "a " * 1_000_000, "en", "s", 1), (2, "a b " * 50_000 + "a " * 9, "en", "s", 1), (3, "a " * 9, "en", "s", 1), (4, "x" * 2_000_000, "en", "s", 1)]
    items = [("many", "a " * 500), ("two", "a b " * 300), ("short", "a a a"), ("long", "x" * 2_000_000)]
    began = time.time()
    got = {r[0]: r for r in run(spark, tmp_path, docs, items)}
    assert time.time() - began < 60
    digest = lambda *x: hashlib.sha256(",".join(x).encode()).hexdigest()
    assert got[1][1:] == (1_000_000, 1_000_000, 2, digest("many", "short"), True)
    assert got[2][1:] == (100_009, 100_009, 2, digest("short", "two"), True)
    assert got[3][1:] == (9, 9, 1, digest("short"), True) and got[4][1:] == (1, 1, 1, digest("long"), True)


def test_hashes_only_find_candidates(monkeypatch):
    """With hashes that collide all the time the answers stay the same."""
    docs, items = case(6)
    monkeypatch.setattr(B.Hasher, "spans", lambda self, prefix, start, end: ((end - start) % 3).astype("uint64"))
    look = W.Lookup([(i, (t or "").encode()) for i, t in items], 10, 5)
    buf, at = B.buffers(pa.array([(d[1] or "")[:3000].encode() for d in docs]))
    buf = B.LOWER[buf]
    start, end, doc = B.words(buf, at, B.ALNUM)
    _, _, hit = look.hits(buf, start, end, doc, (end - start).astype("uint64") % 3)
    want = brute([(d[0], (d[1] or "").encode()[:3000].decode(errors="ignore")) for d in docs], items)
    assert sum(hit) == sum(r[2] for r in want)


def test_blocks_give_the_same(spark):
    docs, items = case(4)
    bench = spark.createDataFrame(items, "item_id string, text string")
    one = W.contamination(frame(spark, docs), bench)
    many = W.contamination(frame(spark, docs).repartition(5), bench, block_bytes=300)
    pick = lambda df: sorted(map(str, df.select("doc_id", "n_words", W.hit_count(df.hit_words).alias("n"), "items").collect()))
    assert pick(one) == pick(many)


def test_decontaminated_keeps_the_clean(spark):
    docs, items = case(5)
    bad = {r[0] for r in brute(docs, items) if r[5]}
    bench = spark.createDataFrame(items, "item_id string, text string")
    for size in (1 << 24, 300):
        got = W.decontaminated(frame(spark, docs), bench, block_bytes=size)
        assert got.columns == [c.split()[0] for c in DOCS.split(", ")]
        assert {r.doc_id for r in got.collect()} - {None} == {d[0] for d in docs} - bad - {None}


def test_empty_tables(spark, tmp_path):
    docs, items = case()
    assert run(spark, tmp_path, [], items) == []
    assert all(not r[5] for r in run(spark, tmp_path, docs, []))
