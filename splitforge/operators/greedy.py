"""Greedy rules that send whole groups to splits, folded over the histogram of group sizes.

Groups come largest first, and groups of one size are alike to the rules, so a rule only
has to say how many of each size go where, and in which turn.  The fold works on (size,
number of groups): n rows have at most sqrt(2 n) different sizes, whatever the number of
groups.  Each group then finds its split from its place among the groups of its size.

``share``: the split that lacks the largest share of its target comes next (then the one
that lacks more rows, then train before val before test).  While a size lasts, what a
split lacks goes down in equal steps, so the turns are three falling sequences merged,
and the place of any turn in the merged order is a quotient of whole numbers.  Shares
are compared exactly, as fractions.

``fill``: among splits below their target the one that a group brings nearest to it
(then the one that lacks more, then train before val before test).  A split that was chosen
and still has room for a whole group comes even nearer with the next one, so a size falls
into few stretches that each go to one split.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

RUNS = "array<struct<n_rows: long, lacks: array<long>, upto: array<long>, to: array<int>>>"


def targets(total: int, ratios: tuple[float, ...]) -> list[int]:
    """Whole numbers near total * ratio that sum to the total: largest remainders first, ties to the earlier split."""
    raw = [total * r for r in ratios]
    out = [int(x) for x in raw]
    for k in sorted(range(len(raw)), key=lambda k: (out[k] - raw[k], k))[: total - sum(out)]:
        out[k] += 1
    return out


def _place(turn, j: int, size, lacks, target):
    """Where in the merged order the turn-th take (from 0) of split j stands."""
    left = lacks[j] - turn * size
    sign = (left > 0) * 1 - (left < 0) * 1
    place = turn
    for i in range(len(lacks)):
        if i != j:
            ahead, step = lacks[i] * target[j] - left * target[i], size * target[j]
            more = sign * (target[i] - target[j])  # of equal shares the one that lacks more rows
            level = (ahead >= 0) & (ahead % step == 0) & ((more > 0) | ((more == 0) & (i < j)))
            place = place + np.maximum(-(-ahead // step), 0) + level
    return place


def _turns(place, j: int, size, lacks, target):
    """How many takes of split j stand before a place of the merged order."""
    low, high = place * 0, place + 0
    while (low < high).any():
        mid = (low + high) // 2
        far = _place(mid, j, size, lacks, target) >= place
        low, high = np.where(far, low, mid + 1), np.where(far, mid, high)
    return low


def _most_lacking(lacks, target):
    best = lacks[0] * 0
    most, of = lacks[0], target[0]
    for j in range(1, len(lacks)):
        more = (lacks[j] * of > most * target[j]) | ((lacks[j] * of == most * target[j]) & (lacks[j] > most))
        best, most, of = np.where(more, j, best), np.where(more, lacks[j], most), np.where(more, target[j], of)
    return best


def share_turns(place: np.ndarray, size: np.ndarray, lacks: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The split of the group at each place (from 0) of its size; lacks and target have a row a split."""
    wide = 4 * int(max(np.abs(lacks).max(initial=1), target.max(initial=1))) ** 2 >= 2**62
    place, size, lacks, target = (x.astype(object if wide else np.int64) for x in (place, size, lacks, np.maximum(target, 1)))
    out = _most_lacking(lacks, target)
    some = np.flatnonzero(size > 0)
    place, size, lacks, target = place[some], size[some], lacks[:, some], target[:, some]
    for j in range(len(lacks)):
        turn = _turns(place, j, size, lacks, target)
        out[some[(_place(turn, j, size, lacks, target) == place).astype(bool)]] = j
    return out.astype(np.int32)


def _share_run(size: int, n: int, lacks: list[int], target: list[int]) -> tuple[list[int], list[tuple[int, int]]]:
    one = lambda x: np.array([x], object)
    if not size:
        return lacks, []
    taken = [int(_turns(one(n), j, one(size), [one(x) for x in lacks], [one(max(t, 1)) for t in target])[0]) for j in range(len(lacks))]
    return [x - k * size for x, k in zip(lacks, taken)], []


def _fill_run(size: int, n: int, lacks: list[int], target: list[int]) -> tuple[list[int], list[tuple[int, int]]]:
    left, stretches, done = list(lacks), [], 0
    while done < n:
        j = min(range(len(left)), key=lambda k: (left[k] <= 0, abs(left[k] - size), -left[k], k))
        stretch = n - done if not size else min(n - done, max(left[j] // size, 1))
        left[j] -= stretch * size
        done += stretch
        stretches.append((done, j))
    return left, stretches


RULES = {"share": _share_run, "fill": _fill_run}


def runs(rule: str, ratios: tuple[float, ...]):
    """A function of an array of (n_rows, n): what the splits lack when each size begins, and its stretches."""

    def fold(sizes: list[dict]) -> tuple[list[dict], list[int]]:
        target = targets(sum(s["n_rows"] * s["n"] for s in sizes), ratios)
        lacks, out = target, []
        for s in sorted(sizes, key=lambda s: -s["n_rows"]):
            after, stretches = RULES[rule](s["n_rows"], s["n"], lacks, target)
            out.append({"n_rows": s["n_rows"], "lacks": lacks, "upto": [u for u, _ in stretches], "to": [j for _, j in stretches]})
            lacks = after
        return out, target

    @F.pandas_udf(f"struct<runs: {RUNS}, target: array<long>>")
    def folded(sizes: pd.Series) -> pd.DataFrame:
        done = [fold([dict(zip(("n_rows", "n"), (int(s["n_rows"]), int(s["n"])))) for s in one]) for one in sizes]
        return pd.DataFrame({"runs": [d[0] for d in done], "target": [d[1] for d in done]})

    return folded


@F.pandas_udf(IntegerType())
def _share_of(place: pd.Series, size: pd.Series, lacks: pd.Series, target: pd.Series) -> pd.Series:
    columns = [np.array(x.tolist(), np.int64).reshape(len(x), -1).T for x in (lacks, target)]
    return pd.Series(share_turns(place.to_numpy(), size.to_numpy(), *columns))


def chosen(rule: str, place: Column) -> Column:
    """The number of the split, from columns n_rows, lacks, target, upto and to."""
    if rule == "share":
        return _share_of(place, "n_rows", "lacks", "target")
    return F.get("to", F.size(F.filter("upto", lambda u: u <= place)))
