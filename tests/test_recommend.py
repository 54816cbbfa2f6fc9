from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkjourney.operators.recommend import (
    purchase_counts, user_neighbours, collab_scores, cooccurrence_scores, hybrid_scores,
    svd_neighbours,
)
from sparkjourney.operators.svd import truncated_svd

SCHEMA = "event_id long, user_id long, ts timestamp_ntz, event_type string, product_id string"


def _counts(spark, baskets):
    rows, i = [], 0
    for u, items in baskets.items():
        for p in items:
            rows.append((i, u, None, "purchase", p)); i += 1
    return purchase_counts(spark.createDataFrame(rows, SCHEMA))


def _brute_cooc(baskets, seed):
    co = defaultdict(Counter)
    for items in baskets.values():
        for a, b in combinations(sorted(set(items)), 2):
            co[a][b] += 1
            co[b][a] += 1
    mine = set(baskets[seed])
    out = Counter()
    for q in mine:
        for p, n in co[q].items():
            if p not in mine:
                out[p] += n
    return dict(out)


def test_pairs_fixture_symmetry_and_scores(spark):
    # user 1 buys A, A, B, C; user 2 buys A, B
    baskets = {1: ["A", "A", "B", "C"], 2: ["A", "B"], 3: ["C", "D"], 4: ["B", "D", "E"]}
    c = _counts(spark, baskets)
    got = {r.product_id: r.cooccur_score for r in cooccurrence_scores(c, F.lit(2)).collect()}
    assert got == _brute_cooc(baskets, 2)


def test_cooccurrence_matches_brute_force_random(spark):
    rng = np.random.default_rng(7)
    baskets = {u: [f"p{int(x)}" for x in rng.integers(0, 12, rng.integers(1, 8))] for u in range(30)}
    c = _counts(spark, baskets)
    for seed in (0, 5, 17):
        got = {r.product_id: r.cooccur_score for r in cooccurrence_scores(c, F.lit(seed)).collect()}
        assert got == _brute_cooc(baskets, seed)


def test_neighbours_collab_exclude_owned(spark):
    baskets = {1: ["A", "B"], 2: ["A", "B"], 3: ["A"], 4: ["Z"]}
    c = _counts(spark, baskets)
    nb = user_neighbours(c, k=2).collect()
    assert [r.neighbour for r in nb] == [2, 3] and abs(nb[0].similarity - 1.0) < 1e-12
    assert [r.rank for r in nb] == [1, 2]
    # neighbours 2 and 3 own nothing new -> empty collaborative list
    assert collab_scores(c, user_neighbours(c, k=2)).count() == 0


def test_hybrid_one_sided_scores_and_disjoint_from_owned(spark):
    baskets = {1: ["A"], 2: ["A", "B"], 3: ["C", "D"], 4: ["A", "E"]}
    c = _counts(spark, baskets)
    nb = user_neighbours(c, k=5)
    h = hybrid_scores(collab_scores(c, nb), cooccurrence_scores(c), n=None)
    got = {r.product_id: (r.collab_score, r.cooccur_score, r.hybrid_score) for r in h.collect()}
    assert "A" not in got
    assert got["B"] == (1.0, 1.0, 2.0) and got["C"] == (1.0, 0.0, 1.0)


def test_hot_product_bought_by_most_users(spark):
    rng = np.random.default_rng(9)
    baskets = {u: ["HOT"] * int(rng.integers(1, 4)) + [f"p{int(x)}" for x in rng.integers(0, 30, rng.integers(0, 5))]
               for u in range(120)}
    c = _counts(spark, baskets)
    for seed in (0, 7):
        got = {r.product_id: r.cooccur_score for r in cooccurrence_scores(c, F.lit(seed)).collect()}
        assert got == _brute_cooc(baskets, seed)


def test_recommend_both_similarities(spark):
    from sparkjourney.operators.recommend import recommend
    from sparkjourney.plans import tables as t
    from conftest import SMOKE
    ev = t.events(spark, SMOKE)
    for sim in ("sparse", "svd"):
        out = recommend(ev, similarity=sim, n=10).collect()
        assert 0 < len(out) <= 10
        assert all(r.hybrid_score == r.collab_score + r.cooccur_score for r in out)


@pytest.mark.parametrize("shape,factors", [((60, 25), 40), ((200, 60), 5), ((7, 3), 2)])
def test_svd_equals_dense(spark, shape, factors):
    rng = np.random.default_rng(sum(shape))
    a = rng.poisson(0.4, shape) * rng.integers(1, 6, shape)
    a[:, 0] += 1
    a[3] = a[2]  # rank one less
    t = spark.createDataFrame([(i, f"p{j}", int(a[i, j])) for i in range(shape[0]) for j in range(shape[1]) if a[i, j]], "u long, p string, n long")
    f, sigma = truncated_svd(t, "u", "p", "n", factors)
    u, s, _ = np.linalg.svd(a.astype(float), full_matrices=False)
    k = min(factors, int((s > 1e-6 * s[0]).sum()))
    assert np.allclose(sigma, s[:k], rtol=1e-6)
    got = np.array([x for _, x in sorted((r.u, r.f) for r in f.collect())])
    want = u[:, :k] * s[:k]
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-4 * s[0])


def test_svd_neighbours_equal_dense(spark):
    from sparkjourney.plans import tables as t
    from conftest import SMOKE
    counts = purchase_counts(t.events(spark, SMOKE))
    p = counts.toPandas().pivot(index="user_id", columns="product_id", values="n").fillna(0)
    u, s, _ = np.linalg.svd(p.to_numpy(), full_matrices=False)
    f = u[:, :8] * s[:8]
    sim = f[1:] @ f[0] / np.linalg.norm(f[1:], axis=1) / np.linalg.norm(f[0])
    got = svd_neighbours(counts, 5, 8).orderBy("rank").collect()
    assert np.allclose([r.similarity for r in got], np.sort(sim)[::-1][:5], atol=1e-4)
    assert [r.neighbour for r in got] == [int(p.index[1:][i]) for i in np.argsort(-sim)[:5]]
