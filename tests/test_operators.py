"""Operators against plain Python versions of their rules, and their edge cases."""

from __future__ import annotations

import math
import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from splitforge.functions import clean_text, extracted_text
from splitforge.operators import clusters as C
from splitforge.operators import dedup as D
from splitforge.operators import greedy
from splitforge.operators import groups as G
from splitforge.operators import metrics as M
from splitforge.operators import pairs as P
from splitforge.operators import shared
from splitforge.operators import similarity as N
from splitforge.operators import splits as S
from splitforge.operators.shared import ranked
from splitforge.operators.sweep import sweep_tunable_splits


def sequential_butina(n, links, dynamic):
    near = {i: {i} for i in range(n)}
    for i, j in links:
        near[i].add(j)
        near[j].add(i)
    free, out = set(range(n)), {}
    fixed = {i: len(near[i]) for i in near}
    while free:
        center = min(free, key=lambda i: (-len(near[i] & free) if dynamic else -fixed[i], i))
        for i in near[center] & free:
            out[i] = center
        free -= near[center]
    return out


@pytest.mark.parametrize("most", [0, 20, C.LINKS])
@pytest.mark.parametrize("dynamic", [True, False])
def test_butina_equals_the_sequential_rule(spark, dynamic, most):
    rng = random.Random(3)
    n = 70
    links = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(90)}
    ids = spark.range(n).select(F.lit(0).alias("run"), "id")
    pairs = spark.createDataFrame([(0, i, j) for i, j in links], "run int, i long, j long")
    got = {r.id: r.center for r in C.butina_clusters(ids, pairs, ["run"], dynamic, most=most).collect()}
    want = sequential_butina(n, links, dynamic)
    sizes = Counter(want.values())
    same = {i: c for i, c in want.items() if sizes[c] > 1}
    assert got.keys() == want.keys()
    assert {i: got[i] for i in same} == same


@pytest.mark.parametrize("most", [0, C.LINKS])
@pytest.mark.parametrize("dynamic", [True, False])
def test_butina_of_classes(spark, dynamic, most):
    """Ids that stand for several alike entities give the clusters of the entities."""
    rng = random.Random(4)
    size = [rng.choice((1, 1, 2, 5)) for _ in range(30)]
    first = [sum(size[:k]) for k in range(30)]
    links = {tuple(sorted(rng.sample(range(30), 2))) for _ in range(35)}
    every = [(first[a] + p, first[b] + q) for a, b in links for p in range(size[a]) for q in range(size[b])]
    every += [(first[k] + p, first[k] + q) for k in range(30) for p in range(size[k]) for q in range(p)]
    want = sequential_butina(sum(size), every, dynamic)
    ids = spark.createDataFrame([(0, first[k], size[k]) for k in range(30)], "run int, id long, size long")
    pairs = spark.createDataFrame([(0, first[a], first[b]) for a, b in links], "run int, i long, j long")
    known = spark.createDataFrame([(first[k], 0) for k in range(30)], "node long, part long")
    of = spark.createDataFrame([(first[k] + p, first[k]) for k in range(30) for p in range(size[k])], "id long, of long")
    for parts in (None, known):
        found = C.of_members(C.butina_clusters(ids, pairs, ["run"], dynamic, most, parts), of, "id")
        sizes = Counter(want.values())
        assert {r.id: (r.center, r["size"]) for r in found.collect() if r["size"] > 1} == {i: (c, sizes[c]) for i, c in want.items() if sizes[c] > 1}


def test_butina_without_links(spark):
    ids = spark.range(3).select(F.lit(0).alias("run"), "id")
    none = spark.createDataFrame([], "run int, i long, j long")
    assert {(r.center, r.id, r["size"]) for r in C.butina_clusters(ids, none, ["run"]).collect()} == {(k, k, 1) for k in range(3)}


@pytest.mark.parametrize("finish", [0, shared.FINISH])
def test_components_name_the_least_node(spark, monkeypatch, finish):
    monkeypatch.setattr(shared, "FINISH", finish)
    rng = random.Random(15)
    links = [(g, *rng.sample(range(60), 2)) for g in "ab" for _ in range(35)] + [("c", k, k + 1) for k in range(40)] + [("c", 7, 7)]
    want = {}
    for g in "abc":
        near = {}
        for h, i, j in links:
            if h == g and i != j:
                near.setdefault(i, set()).add(j)
                near.setdefault(j, set()).add(i)
        for n in sorted(near):
            todo = [n] if (g, n) not in want else []
            while todo:
                k = todo.pop()
                if (g, k) not in want:
                    want[g, k] = n
                    todo += near[k]
    got = shared.components(spark.createDataFrame(links, "g string, i long, j long").repartition(4), ["g"]).collect()
    assert {(r.g, r.node): r.part for r in got} == want and len(got) == len(want)


def tanimoto(a, b):
    either = bin(a | b).count("1")
    return bin(a & b).count("1") / either if either else 1.0


@pytest.mark.parametrize("threshold", [0.05, 0.35, 1.0])
def test_tanimoto_pairs(spark, threshold):
    rng = random.Random(5)
    sig = [(k, [rng.getrandbits(30) & rng.getrandbits(30), rng.getrandbits(3)]) for k in range(60)] + [(100, [0, 0]), (101, [0, 0]), (102, [0]), (103, [7, 3]), (104, [7, 3])]
    sig += [(200 + k, [rng.getrandbits(62) & rng.getrandbits(62) & rng.getrandbits(62), -(1 << 63)]) for k in range(20)]
    df = spark.createDataFrame(sig, "id long, words array<long>")
    got = {(r.i, r.j): r.similarity for r in N.tanimoto_pairs(df, "id", threshold).collect()}
    least = {i: min(k for k, b in sig if b == a) for i, a in sig}
    value = lambda a, b: tanimoto(*(sum((w & (2**64 - 1)) << 64 * k for k, w in enumerate(x)) for x in (a, b)))
    want = {(i, j): value(a, b) for i, a in sig for j, b in sig if i < j and value(a, b) >= threshold and least[i] == i and least[j] in (i, j)}
    assert got == want and (100, 101) in want and (100, 102) in want and (103, 104) in want
    with pytest.raises(ValueError):
        N.tanimoto_pairs(df, "id", 0.0)


def test_few_signature_pairs_are_counted(spark):
    """Sparse and dense bits: far fewer pairs than there are pass the bounds, and none twice."""
    rng = random.Random(9)
    for width, most in ((400, 0.02), (64, 0.1)):
        sig = [(k, [sum(1 << b for b in range(62 if width > 64 else 32) if rng.random() < (0.04 if width > 64 else 0.5)) for _ in range(width // (62 if width > 64 else 32))]) for k in range(400)]
        found = N.signature_candidates(spark.createDataFrame(sig, "id long, words array<long>"), "id", 0.5)
        n = found.count()
        assert n == found.select("i", "j").distinct().count() and n < most * 400 * 399 / 2


def count_gap(x, y):
    active = [f for f in {*x, *y} if x.get(f) or y.get(f)]
    return sum(abs(x.get(f, 0) - y.get(f, 0)) / max(x.get(f, 0), y.get(f, 0)) for f in active) / max(len(active), 1)


@pytest.mark.parametrize(("features", "cutoff"), [(4, 0.0), (4, 0.3), (4, 0.7), (40, 0.12), (40, 0.49)])
def test_count_distance_pairs(spark, features, cutoff):
    """Few features have a sum each; more share sums, which then are a bound only."""
    rng = random.Random(6)
    draw = (lambda: rng.randrange(0, 4)) if features == 4 else (lambda: rng.choice((0, 0, 0, 0, 0, 1, 2, 9)))
    counts = {k: {f"f{f}": c for f in range(features) if (c := draw())} for k in range(45)}
    counts |= {100 + k: {f: c + (k > 2 and f == min(counts[k])) for f, c in counts[k].items()} for k in range(12)} | {200: {}, 201: {}}
    df = spark.createDataFrame([(k, {f: float(c) for f, c in m.items()}) for k, m in counts.items()], "id long, counts map<string,double>")
    least = {k: min(j for j, n in counts.items() if n == m) for k, m in counts.items()}
    want = {(i, j): d for i, x in counts.items() for j, y in counts.items() if i < j and (d := count_gap(x, y)) <= cutoff and least[i] == i and least[j] in (i, j)}
    got = {(r.i, r.j): r.distance for r in N.count_distance_pairs(df, "id", cutoff).collect()}
    assert got == pytest.approx(want) and got.keys() == want.keys() and any(j == 201 for _, j in got)


def test_two_distances_admit_what_a_weight_brings_near(spark):
    rng = random.Random(12)
    rows = [(k, [rng.getrandbits(14)], {f: float(rng.randrange(1, 4)) for f in "abc" if rng.random() < 0.8}) for k in range(40)] + [(99, [0], {}), (98, [0], {"a": 1.0})]
    df = spark.createDataFrame(rows, "id long, words array<long>, counts map<string,double>")
    for weights, cutoff in (([0.5], 0.4), ([0.0, 1.0], 0.3), ([0.2, 0.9], 0.6)):
        pair = lambda a, b: (1 - tanimoto(a[1][0], b[1][0]), count_gap(a[2], b[2]))
        want = {(a[0], b[0]): pair(a, b) for a in rows for b in rows if a[0] < b[0] and any(w * pair(a, b)[0] + (1 - w) * pair(a, b)[1] <= cutoff + 1e-6 for w in weights)}
        got = {(r.i, r.j): (r.d_structure, r.d_counts) for r in N.two_distances(df, "id", cutoff, weights).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_sweep_gives_every_combination(spark):
    rng = random.Random(7)
    rows = [(k, [rng.getrandbits(20)], {"a": float(rng.randrange(1, 4)), "b": 1.0}) for k in range(30)]
    entities = spark.createDataFrame(rows, "id long, words array<long>, counts map<string,double>")
    clusters, splits, summary = sweep_tunable_splits(entities, "id", [0.0, 0.5, 1.0], [0.2, 0.6])
    assert clusters.count() == 6 * 30 and summary.count() == 6
    assert {r.n for r in splits.groupBy("weight", "cutoff").agg(F.sum("n_rows").alias("n")).collect()} == {30}
    with pytest.raises(ValueError):
        sweep_tunable_splits(entities, "id", [1.5], [0.2])


def test_greedy_split_keeps_groups_and_targets(spark):
    rng = random.Random(8)
    rows = [("r", f"g{k:03}", rng.randrange(1, 30)) for k in range(80)]
    groups = spark.createDataFrame(rows, "run string, g string, n_rows long")
    for policy in S.POLICIES:
        got = S.greedy_split(groups, ["run"], "g", policy).collect()
        total = sum(r[2] for r in rows)
        have = Counter()
        for r in got:
            have[r.split] += r.n_rows
        assert len(got) == 80 and abs(have["train"] - 0.8 * total) <= 30 and abs(have["val"] - 0.1 * total) <= 30
    a, b = (sorted(map(str, S.greedy_split(groups, ["run"], "g", seed=s).collect())) for s in (1, 1))
    assert a == b
    with pytest.raises(ValueError):
        S.greedy_split(groups, ["run"], "g", ratios=(0.5, 0.5, 0.5))


def sequential_greedy(sizes, policy, ratios):
    """The rules as they are stated, one group after the other; sizes largest first."""
    target = greedy.targets(sum(sizes), ratios)
    have, out = [0, 0, 0], []
    for size in sizes:
        lack = [t - h for t, h in zip(target, have)]
        if policy == "quota":
            k = min(range(3), key=lambda k: (-Fraction(lack[k], max(target[k], 1)), -lack[k], k))
        else:
            k = min(range(3), key=lambda k: (lack[k] <= 0, abs(lack[k] - size), -lack[k], k))
        have[k] += size
        out.append(S.SPLITS[k])
    return out


def size_tables():
    rng = random.Random(11)
    tables = [[rng.choice((1, 2, 3, 50)) for _ in range(rng.randrange(1, 90))] for _ in range(12)]
    tables += [[1] * n for n in (1, 2, 9, 10, 300)] + [[7] * 40, [100, *[1] * 60], [3, 3, 3, 0, 0], [0, 0], [10**12 + k % 3 for k in range(30)]]
    return [sorted(t, reverse=True) for t in tables]


@pytest.mark.parametrize("ratios", [S.RATIOS, (0.5, 0.5, 0.0), (0.34, 0.33, 0.33), (0.0, 0.25, 0.75)])
@pytest.mark.parametrize("policy", list(S.POLICIES))
def test_greedy_split_equals_the_sequential_rule(spark, policy, ratios):
    tables = size_tables()
    groups = spark.createDataFrame([(r, k, n) for r, t in enumerate(tables) for k, n in enumerate(t)], "run long, g long, n_rows long")
    out = S.greedy_split(groups, ["run"], "g", policy, ratios=ratios)
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    got = {(r.run, r.g): r.split for r in out.collect()}
    assert len(got) == sum(map(len, tables))
    for r, t in enumerate(tables):
        assert [got[r, k] for k in range(len(t))] == sequential_greedy(t, policy, ratios), (r, t)


def test_greedy_split_of_missing_keys_and_nothing(spark):
    groups = spark.createDataFrame([(None, None, 4), (None, "b", 4), ("r", "c", 2)], "run string, g string, n_rows long")
    got = {(r.run, r.g): r.split for r in S.greedy_split(groups, ["run"], "g").collect()}
    assert got == {(None, None): "train", (None, "b"): "val", ("r", "c"): "train"}
    assert S.greedy_split(groups.limit(0), ["run"], "g").count() == 0


def test_target_counts_use_largest_remainders(spark):
    totals = spark.createDataFrame([(n, n) for n in (0, 1, 5, 9, 10, 1955, 2039)], "k long, total long")
    got = {(r.k, r.split): r.target for r in S.compute_target_counts(totals, ["k"]).collect()}
    assert [got[1955, s] for s in S.SPLITS] == [1564, 196, 195]
    for n in (0, 1, 5, 9, 10, 1955, 2039):
        assert [got[n, s] for s in S.SPLITS] == greedy.targets(n, S.RATIOS) and sum(got[n, s] for s in S.SPLITS) == n


def test_random_splits(spark):
    rows = spark.range(500).withColumnRenamed("id", "k")
    got = S.random_split(rows, "k", 3)
    assert {r.split: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 400, "val": 50, "test": 50}


def test_wide_signatures_and_vocabularies(spark):
    bits = [[float(x) for x in row] for row in ([1] * 64, [0] * 62 + [1, 1], [0] * 64, [0] * 64, [1] * 62 + [0, 0])]
    sig = spark.createDataFrame(list(enumerate(bits)), "id long, b array<double>").select("id", P.signature_words(F.col("b"), 64).alias("words"))
    got = {(r.i, r.j): r.similarity for r in N.tanimoto_pairs(sig, "id", 0.01).collect()}
    assert got == {(0, 1): 2 / 64, (0, 4): 62 / 64, (2, 3): 1.0}
    pair = sig.alias("a").crossJoin(sig.alias("b")).select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), P.tanimoto(F.col("a.words"), F.col("b.words")).alias("s"))
    assert {(r.i, r.j): r.s for r in pair.filter("i < j and s >= 0.01").collect()} == got
    many = spark.range(12).select(F.col("id").cast("string").alias("f"))
    assert P.vocabulary(many, "f", 12) == sorted(str(k) for k in range(12))
    with pytest.raises(ValueError):
        P.vocabulary(many, "f", 11)


def test_ranked_spreads_groups(spark):
    df = spark.range(300).select(F.lit("a").alias("g"), F.md5(F.col("id").cast("string").cast("binary")).alias("h"))
    got = [r.rank for r in ranked(df, ["g"], "h").orderBy("h").collect()]
    assert got == list(range(1, 301))


def test_duplicate_policies(spark):
    rows = [(0, "a", 1, None), (1, "a", 1, 2), (2, "b", 1, 1), (3, "b", 0, 1), (4, "c", None, None), (5, None, 1, 1), (6, None, 1, 1)]
    df = spark.createDataFrame(rows, "idx long, k string, x int, y int")
    assert {r.idx for r in D.keep_first(df, "k", "idx").collect()} == {0, 2, 4, 5}
    assert {r.idx: r.n_rows for r in D.drop_conflicts(df, "k", "idx", ["x", "y"]).collect()} == {4: 1, 5: 2}
    merged = {r.idx: (r.x, r.y) for r in D.merge_tasks(df, "k", "idx", ["x", "y"]).collect()}
    assert merged == {0: (1, 2), 4: (None, None), 5: (1, 1)}
    means = {r.idx: (r.x, r.y) for r in D.mean_labels(df, "k", "idx", ["x", "y"]).collect()}
    assert means == {0: (1.0, 2.0), 2: (0.5, 1.0), 4: (None, None), 5: (1.0, 1.0)}


def test_text_rules(spark):
    rows = [(k, t) for k, t in enumerate([" a ", "", "  ", "nan", "NaN", "None", "null", None, "x y"])]
    got = spark.createDataFrame(rows, "k int, t string").select("k", clean_text(F.col("t")).alias("a"), extracted_text(F.col("t")).alias("b")).orderBy("k").collect()
    assert [r.a for r in got] == ["a", None, None, None, None, None, None, None, "x y"]
    assert [r.b for r in got] == ["a", None, None, None, "NaN", "None", "null", None, "x y"]


def test_concentration_of_one_group_and_of_equal_groups(spark):
    counts = spark.createDataFrame([("one", "g", 10)] + [("even", f"g{k}", 2) for k in range(4)], "d string, g string, n_rows long")
    got = {r.d: r for r in G.concentration(counts, "g", ["d"]).collect()}
    assert (got["one"].top1_ratio, got["one"].gini) == (1.0, pytest.approx(0.0))
    assert (got["even"].doubleton_ratio, got["even"].top1_ratio, got["even"].gini) == (1.0, 0.25, pytest.approx(0.0))


def test_concentration_equals_ranked_groups(spark):
    rng = random.Random(13)
    sizes = {f"d{d}": [rng.choice((1, 1, 1, 2, 2, 3, 9, 40)) for _ in range(rng.randrange(1, 60))] for d in range(6)}
    counts = spark.createDataFrame([(d, f"g{k}" if k else G.NO_GROUP, n) for d, ns in sizes.items() for k, n in enumerate(ns)], "d string, g string, n_rows long")
    out = G.concentration(counts, "g", ["d"])
    assert "Window" not in out._jdf.queryExecution().toString()
    for r in out.collect():
        x = sorted(sizes[r.d])
        n, total = len(x), sum(x)
        assert (r.total_rows, r.total_groups, r.no_group_ratio) == (total, n, sizes[r.d][0] / total)
        assert (r.top1_ratio, r.top5_ratio, r.tripleton_ratio) == pytest.approx((x[-1] / total, sum(x[-5:]) / total, x.count(3) / n))
        assert r.gini == pytest.approx(2 * sum((k + 1) * v for k, v in enumerate(x)) / (n * total) - (n + 1) / n)


def test_areas_equal_the_plain_sums_on_ties(spark):
    rng = random.Random(14)
    rows = [(f"k{k % 3}", int(rng.random() < 0.4), rng.randrange(2), rng.choice((None, 0.1, 0.2, 0.2, 0.7, rng.random()))) for k in range(600)]
    got = {r.g: r for r in M.classification_metrics(spark.createDataFrame(rows, "g string, y int, pred int, score double"), ["g"]).collect()}
    for g in ("k0", "k1", "k2"):
        own = [(y, -1.0 if s is None else s) for k, y, _, s in rows if k == g]
        pos, neg = [s for y, s in own if y], [s for y, s in own if not y]
        roc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
        ap = sum(sum(p >= s for p in pos) / sum(t >= s for _, t in own) for s in pos) / len(pos)
        assert (got[g].roc_auc, got[g].pr_auc) == pytest.approx((roc, ap))


def test_metrics_of_one_class_are_null(spark):
    rows = spark.createDataFrame([("a", 1, 1, 0.5), ("a", 1, 0, 0.2), ("b", 1, 1, 0.9), ("b", 0, 0, 0.9), ("b", 0, 0, 0.1)], "g string, y int, pred int, score double")
    got = {r.g: r for r in M.classification_metrics(rows, ["g"]).collect()}
    assert got["a"].roc_auc is None and got["a"].pr_auc is None and got["a"].accuracy == 0.5
    assert got["b"].roc_auc == pytest.approx(0.75)  # a tie counts half


def test_pairs_in_blocks_equal_pairs_by_index(spark, monkeypatch):
    """Where indexes prune nothing, pairs come from blocks, with the pairs and values of the index; several blocks, empty rows, no hot key."""
    from splitforge.operators import blocks
    from splitforge.operators import similarity as N

    rng = random.Random(31)
    rows = [(k, [rng.getrandbits(24) | rng.getrandbits(24) if k % 40 else 0, rng.getrandbits(3) if k % 40 else 0], {f"f{f}": float(rng.randrange(1, 12)) for f in range(4) if rng.random() < 0.8}, k % 3 == 0) for k in range(240)]
    df = spark.createDataFrame(rows, "id long, words array<long>, counts map<string,double>, new boolean")
    monkeypatch.setattr(blocks, "BLOCK", 50)
    monkeypatch.setattr(blocks, "TILE", 700)

    def results(pruned):
        monkeypatch.setattr(N, "PRUNED", pruned)
        # the key of a block pair, unlike a frequent bit, never holds all rows
        found = [N.similar(df, "id", 0.6), N.similar(df, "id", 0.6, only="new"), N.near(df, "id", 0.25), N.near(df, "id", 0.6), N.two_distances(df, "id", 0.4, [0.0, 0.5, 1.0])]
        return [sorted(map(tuple, x.select(sorted(x.columns)).collect())) for x in found]

    made = []
    whole = N.block_pairs
    monkeypatch.setattr(N, "block_pairs", lambda *a, **k: made.append(1) or whole(*a, **k))
    dense = results(10**9)
    assert len(made) == 5
    index = results(0)
    assert len(made) == 5 and all(map(len, dense))
    for a, b in zip(dense, index):
        assert [r[-2:] if len(r) > 3 else r[1:] for r in a] == [r[-2:] if len(r) > 3 else r[1:] for r in b] and len(a) == len(b)
        assert all(math.isclose(x, y, abs_tol=1e-12) for p, q in zip(a, b) for x, y in zip(p, q))


@pytest.mark.parametrize("lead", [1, 150])
def test_large_components_take_many_centers_a_round(spark, monkeypatch, lead):
    """A dense graph is one component with hubs within two steps of all: rounds by distance found one center each."""
    monkeypatch.setattr(C, "LEAD", lead)
    rounds, own = [], C._leaders
    monkeypatch.setattr(C, "_leaders", lambda *a: rounds.append(1) or own(*a))
    rng, n = random.Random(8), 30
    links = [(i, j) for i in range(n) for j in range(i) if rng.random() < 0.15]
    ids = spark.createDataFrame([(0, i) for i in range(n)], "run int, id long")
    pairs = spark.createDataFrame([(0, i, j) for i, j in links], "run int, i long, j long")
    got = {r.id: r.center for r in C.butina_clusters(ids, pairs, ["run"], True, most=0).collect()}
    assert got == sequential_butina(n, links, True)
    assert 1 <= len(rounds) <= len(set(got.values())) and (lead == 1 or len(rounds) < len(set(got.values())))
