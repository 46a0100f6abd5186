"""Regions divided by pivots in Spark rounds equal brute force, and near copies stay cheap."""

from collections import defaultdict

import numpy as np
import pytest


def _components(n, edges):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a, b in edges:
        root[find(a)] = find(b)
    out = defaultdict(set)
    for i in range(n):
        out[find(i)].add(i)
    return sorted(map(sorted, out.values()))


def _clouds(rng, centres, each, drop):
    """Sets around a few centres that lie near one another: a region pivots can divide."""
    base = np.unique(rng.integers(0, 1 << 60, 120, dtype=np.uint64))
    out = []
    for _ in range(centres):
        centre = np.unique(np.r_[base[rng.random(len(base)) > 0.35], rng.integers(0, 1 << 60, 60, dtype=np.uint64)])
        for _ in range(each):
            keep = rng.random(len(centre)) > rng.choice(drop)
            out.append(np.unique(np.r_[centre[keep], rng.integers(0, 1 << 60, int(rng.integers(0, 4)), dtype=np.uint64)]))
    return out


@pytest.mark.parametrize("block,drop", [(25, [0.0, 0.04, 0.1]), (25, [0.01, 0.02]), (40, [0.1, 0.2])])
def test_pivot_cells_lose_no_link(spark, block, drop):
    from pozo.llm.jaccard import Rule, _join_region
    from pozo.llm.regions import divide, names
    rng = np.random.default_rng(len(drop) + block)
    rule = Rule(85)
    sets = _clouds(rng, 12, 30, drop) + [np.sort(rng.integers(0, 1 << 60, 50, dtype=np.uint64)) for _ in range(7)]
    rows = [(1 if i < 360 else 2, i * 1000003, -i, s.tobytes()) for i, s in enumerate(sets)]
    df = spark.createDataFrame([(r, a, b, bytearray(e)) for r, a, b, e in rows], "region long, s1 long, s2 long, elements binary").repartition(6)
    groups, links = divide(df, rule, block, 1 << 26)
    groups = groups.cache()
    per = defaultdict(set)
    for g in groups.select("cell", "_i", "_j", "s1").collect():
        per[g["cell"], g["_i"], g["_j"]].add(g["s1"])
    assert max(map(len, per.values())) <= 4 * block        # nothing meets as a whole
    assert len(per) > 12 or max(drop) < 0.04                # (near copies are connected by the pivots alone)
    at = {name: i for i, name in enumerate(names([r[1] for r in rows], [r[2] for r in rows]))}
    edges = groups.groupBy("cell", "_i", "_j").applyInArrow(_join_region(rule), "a string, b string").unionByName(links).collect()
    got = _components(len(sets), [(at[e["a"]], at[e["b"]]) for e in edges])
    want = []
    for i in range(len(sets)):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if (i < 360) == (j < 360) and rule.linked(n, len(sets[i]) + len(sets[j])):
                want.append((i, j))
    assert got == _components(len(sets), want) and len(got) < len(sets)
    assert all((at[e["a"]], at[e["b"]]) in want or (at[e["b"]], at[e["a"]]) in want for e in edges)


def test_near_copies_meet_no_other_near_copies(spark):
    from pozo.llm.jaccard import Rule
    from pozo.llm.regions import divide
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 60, 400, dtype=np.uint64))
    sets = [np.sort(np.r_[base[i % 5:], rng.integers(0, 1 << 60, 1, dtype=np.uint64)]) for i in range(2000)]
    df = spark.createDataFrame([(1, i, i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "region long, s1 long, s2 long, elements binary")
    groups, links = divide(df, Rule(80), 100, 1 << 26)
    # One component after the first pivots: no pair of blocks is left to compare.
    assert groups.count() == 0 and links.count() >= 1999


def test_small_regions_are_left_whole(spark):
    from pozo.llm.jaccard import Rule
    from pozo.llm.regions import divide
    df = spark.createDataFrame([(r, i, i, bytearray(8)) for r in (1, 2) for i in range(5)], "region long, s1 long, s2 long, elements binary")
    groups, links = divide(df, Rule(80), 5, 1 << 26)
    assert links is None and groups.select("cell").distinct().count() == 2 and groups.count() == 10
    heavy, _ = divide(df, Rule(80), 5, 16)
    assert heavy.select("cell", "_i", "_j").distinct().count() != 2
    assert divide(df.where("false"), Rule(80), 5, 16)[0].count() == 0
