"""The forest grows with the table: leaf sizes, recall against brute force, rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F


def _planted(rng, n, dim, m, low, high):
    """n random unit vectors and m partners at cosines between low and high of the first m."""
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = rng.uniform(low, high, m)[:, None]
    e = rng.standard_normal((m, dim))
    e -= (e * x[:m]).sum(1, keepdims=True) * x[:m]
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    return np.r_[x, c * x[:m] + np.sqrt(1 - c ** 2) * e]


def _frame(spark, x, labels):
    return spark.createDataFrame([(i, v.tolist(), int(lab)) for i, (v, lab) in enumerate(zip(x, labels))],
                                 "vec_id long, embedding array<double>, label int").repartition(8)


def test_recall_at_twenty_thousand_vectors(spark):
    from pozo.llm.rp_forest import near_duplicates
    rng = np.random.default_rng(5)
    x = _planted(rng, 16000, 64, 4000, 0.931, 0.95)
    labels = np.r_[np.arange(16000) % 2, np.arange(4000) % 2]
    wanted = sum(int(((x[labels == k] @ x[labels == k].T) >= 0.93).sum()) - int((labels == k).sum()) for k in (0, 1))
    got = near_duplicates(_frame(spark, x, labels)).agg(F.sum("n_links")).first()[0]
    assert wanted >= 8000 and 0.95 * wanted <= got <= wanted
    print("recall", got / wanted)


def test_leaves_stay_small_over_several_rounds(spark, monkeypatch):
    from pozo.llm import rp_forest
    rng = np.random.default_rng(6)
    x = _planted(rng, 3000, 24, 300, 0.94, 0.99)
    x = np.r_[x, np.repeat(x[:1], 40, axis=0) + 1e-3 * rng.standard_normal((40, 24))]      # a cluster no split can part
    labels = np.zeros(len(x), int)
    df = _frame(spark, x, labels)
    packed = df.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector")).mapInArrow(
        rp_forest._pack(), "id long, label int, dim int, packed binary").withColumn("k1", F.xxhash64("packed")).withColumn("k2", F.xxhash64(F.lit(7), "packed"))
    nodes = packed.select("label", "dim", "k1", "k2", "packed")
    made = rp_forest.forest(nodes, 0.93, trees=3, leaf=30, sample=200)       # samples of 200 carry a few levels a round
    leaves = made.select(F.explode("codes").alias("code")).groupBy("code").count().collect()
    assert made.count() == len(x) and len(leaves) > 150
    assert max(r["code"] & ((1 << 48) - 1) for r in leaves) >= 1 << 6
    assert np.median([r["count"] for r in leaves]) <= 60 and max(r["count"] for r in leaves) < 400
    seen = {r[0]: set(r[1]) for r in made.select("k1", "codes").collect()}
    assert all(len({c >> 48 for c in codes}) == 3 for codes in seen.values())             # every tree, every vector
    near = (x @ x.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None, :] >= 0.93
    got = sum(r["n_links"] for r in rp_forest.near_duplicates(df, trees=6, leaf=30, sample=200).collect())
    assert 0.95 * (near.sum() - len(x)) <= got <= near.sum() - len(x)


def test_small_tables_have_one_leaf_and_long_vectors_pass(spark):
    from pozo.llm import rp_forest
    rng = np.random.default_rng(7)
    x = rng.standard_normal((50, 3))
    nodes = _frame(spark, x, np.zeros(50, int)).select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector")).mapInArrow(
        rp_forest._pack(), "id long, label int, dim int, packed binary").select("label", "dim", F.xxhash64("packed").alias("k1"),
                                                                     F.lit(0).cast("long").alias("k2"), "packed")
    assert {tuple(r["codes"]) for r in rp_forest.forest(nodes, 0.93, leaf=64).collect()} == {(1,)}
    single = _frame(spark, x, np.zeros(50, int)).select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"), "label")
    y = x.astype(np.float32).astype(float)
    near = (y @ y.T) / np.linalg.norm(y, axis=1)[:, None] / np.linalg.norm(y, axis=1)[None, :] >= 0.93
    assert {r["vec_id"]: r["n_links"] for r in rp_forest.near_duplicates(single).collect()} == {i: int(near[i].sum()) - 1 for i in range(50)}
    long = rng.standard_normal((90, 20000))
    long[1] = long[0] + 0.01 * rng.standard_normal(20000)
    got = {r["vec_id"]: r["component_id"] for r in rp_forest.near_duplicates(_frame(spark, long, np.zeros(90, int))).collect()}
    assert got == {i: (0 if i == 1 else i) for i in range(90)}


@pytest.mark.parametrize("levels", [1, 3])
def test_routes_follow_the_thresholds(levels):
    from pozo.llm.rp_forest import grow, route
    rng = np.random.default_rng(8)
    place = rng.standard_normal((500, levels))
    cuts = grow(place, 0.1)
    rows, down, side = route(place, np.repeat(cuts[None], 500, axis=0), 0.1)
    want = set()
    for i in range(500):
        todo = [(0, 0, 0)]
        while todo:
            at, level, s = todo.pop()
            if level == levels or np.isnan(cuts[at]):
                want.add((i, level, s))
                continue
            if place[i, level] <= cuts[at] + 0.1:
                todo.append((2 * at + 1, level + 1, 2 * s))
            if place[i, level] > cuts[at] - 0.1:
                todo.append((2 * at + 2, level + 1, 2 * s + 1))
    assert set(zip(rows.tolist(), down.tolist(), side.tolist())) == want
