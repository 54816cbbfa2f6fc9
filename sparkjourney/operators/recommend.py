"""Hybrid product recommendation: user-neighbour (collaborative) + co-occurrence.

Data model: long (user, product, n) purchase counts -- never a dense
user x product matrix and never a pivot over products.

* Neighbours: cosine similarity of the seed user's count vector with every
  other user's, computed sparsely: the seed's items join the counts on
  product (only users sharing a product get a dot product), norms come from
  one grouped aggregate, and users sharing nothing keep similarity 0.  The
  top k is a ``TakeOrderedAndProject`` (partial top-k per task).
* Collaborative score: neighbours' counts summed per product, minus what the
  seed already bought, positive only.
* Co-occurrence score: the analysis counts, for every pair of distinct
  products, the users who bought both, then sums those counts over the
  seed's products.  The same number is obtained without materializing any
  product pair:  score(p) = sum over users v of |S_seed & S_v| * [p in S_v]
  for p not owned by the seed.  That is two equi-joins and two grouped
  aggregates whose sizes are bounded by the (user, product) table, so a user
  with a huge basket costs rows linear in its basket, not quadratic.
* Hybrid: full outer join of both scores (missing side -> 0), top n.

The seed defaults to the smallest purchasing user id (the first row of the
analysis' user x product matrix), resolved once to a literal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sparkjourney import schema as S


def purchase_counts(events: DataFrame, purchase: str = S.PURCHASE, user: str = S.USER,
                    product: str = S.PRODUCT, event: str = S.EVENT) -> DataFrame:
    """(user, product, n) purchases per user and product (NULL products dropped)."""
    return (events.where((F.col(event) == F.lit(purchase)) & F.col(user).isNotNull() & F.col(product).isNotNull())
            .groupBy(user, product).agg(F.count(F.lit(1)).alias("n")))


def default_seed(counts: DataFrame, user: str = S.USER) -> Column:
    """Smallest purchasing user id, resolved once to a literal (one small
    aggregate job), so every use of the seed is a constant in the plans."""
    from sparkjourney.functions.scalar import fit_row
    return F.lit(fit_row(counts.select(F.min(user).alias("s")))["s"]).cast("bigint")


def _seed_items(counts: DataFrame, seed: Column, user: str, product: str) -> DataFrame:
    return counts.where(F.col(user) == seed).select(product, F.col("n").alias("n_seed"))


def user_neighbours(counts: DataFrame, seed: Column | None = None, k: int = 5, user: str = S.USER,
                    product: str = S.PRODUCT) -> DataFrame:
    """(seed_user, neighbour, similarity, rank): the k most similar other users.

    Ties on similarity go to the smaller user id.
    """
    seed = default_seed(counts, user) if seed is None else seed
    mine = _seed_items(counts, seed, user, product)
    seed_norm = mine.select(F.sqrt(F.sum(F.col("n_seed") * F.col("n_seed")))).scalar()
    norms = counts.groupBy(user).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    dots = counts.join(mine, product).groupBy(user).agg(F.sum(F.col("n") * F.col("n_seed")).alias("dot"))
    sim = (norms.join(dots, user, "left").where(F.col(user) != seed)
           .select(F.col(user).alias("neighbour"),
                   (F.coalesce(F.col("dot"), F.lit(0)) / (F.col("norm") * seed_norm)).alias("similarity")))
    top = sim.orderBy(F.desc("similarity"), F.asc("neighbour")).limit(k)
    # k rows: ranking them needs no partitioning
    return top.select(seed.alias("seed_user"), "neighbour", "similarity",
                      F.row_number().over(W.orderBy(F.desc("similarity"), F.asc("neighbour"))).alias("rank"))


def collab_scores(counts: DataFrame, neighbours: DataFrame, seed: Column | None = None, user: str = S.USER,
                  product: str = S.PRODUCT) -> DataFrame:
    """(product, collab_score): neighbours' purchase counts summed, seed's own
    products removed, positive only.  ``neighbours`` has k rows (broadcast)."""
    seed = default_seed(counts, user) if seed is None else seed
    nb = F.broadcast(neighbours.select(F.col("neighbour").alias(user)))
    s = counts.join(nb, user).groupBy(product).agg(F.sum("n").alias("collab_score"))
    return (s.join(_seed_items(counts, seed, user, product), product, "left_anti")
            .where(F.col("collab_score") > 0))


def cooccurrence_scores(counts: DataFrame, seed: Column | None = None, user: str = S.USER,
                        product: str = S.PRODUCT) -> DataFrame:
    """(product, cooccur_score) for the seed user, exact, without product pairs."""
    seed = default_seed(counts, user) if seed is None else seed
    mine = _seed_items(counts, seed, user, product).select(product)
    overlap = counts.join(mine, product).groupBy(user).agg(F.count(F.lit(1)).alias("overlap"))
    s = counts.join(overlap, user).groupBy(product).agg(F.sum("overlap").alias("cooccur_score"))
    return s.join(mine, product, "left_anti")


def hybrid_scores(collab: DataFrame, cooc: DataFrame, n: int | None = 10, product: str = S.PRODUCT) -> DataFrame:
    """(product, collab_score, cooccur_score, hybrid_score), top n by hybrid.

    Full outer join with 0 for a missing side; ties go to the smaller product.
    """
    j = collab.join(cooc, product, "full").select(
        product,
        F.coalesce(F.col("collab_score"), F.lit(0)).cast("double").alias("collab_score"),
        F.coalesce(F.col("cooccur_score"), F.lit(0)).cast("double").alias("cooccur_score"))
    j = j.withColumn("hybrid_score", F.col("collab_score") + F.col("cooccur_score"))
    return j.orderBy(F.desc("hybrid_score"), F.asc(product)).limit(n) if n else j


def recommend(events: DataFrame, seed: Column | None = None, neighbours: int = 5, n: int = 10,
              purchase: str = S.PURCHASE, similarity: str = "sparse", factors: int = 20) -> DataFrame:
    """Top-n hybrid recommendations for one user (default: smallest purchasing id).

    ``similarity='sparse'`` ranks neighbours by cosine of purchase counts,
    ``'svd'`` by cosine of ``factors`` truncated-SVD user factors.
    """
    from sparkjourney.session import materialize
    counts = materialize(purchase_counts(events, purchase))  # read by every branch below
    seed = default_seed(counts) if seed is None else seed
    if similarity == "sparse":
        nb = user_neighbours(counts, seed, neighbours)
    elif similarity == "svd":
        nb = svd_neighbours(counts, neighbours, factors, seed)
    else:
        raise ValueError(f"similarity must be 'sparse' or 'svd', not {similarity!r}")
    return hybrid_scores(collab_scores(counts, nb, seed), cooccurrence_scores(counts, seed), n)


def svd_neighbours(counts: DataFrame, k: int = 5, factors: int = 20, seed: Column | None = None,
                   user: str = S.USER, product: str = S.PRODUCT) -> DataFrame:
    """(seed_user, neighbour, similarity, rank) by cosine of truncated-SVD user factors.

    Factors are U * sigma (``svd.truncated_svd`` of the sparse counts); the seed's
    factor row (``factors`` numbers) is fetched and every other user's cosine with
    it is a column expression.
    """
    from sparkjourney.functions.scalar import fit_row
    from sparkjourney.operators.svd import truncated_svd
    from sparkjourney.session import materialize

    seed = default_seed(counts, user) if seed is None else seed
    fac = materialize(truncated_svd(counts, user, product, "n", factors)[0])
    sv = fit_row(fac.where(F.col(user) == seed).select(F.col("f").alias("_s")))["_s"]
    svec = F.array(*[F.lit(float(x)) for x in sv])
    dot = F.aggregate(F.zip_with("f", svec, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    norm = F.sqrt(F.aggregate(F.transform("f", lambda a: a * a), F.lit(0.0), lambda acc, x: acc + x))
    snorm = float(sum(x * x for x in sv)) ** 0.5
    sim = fac.where(F.col(user) != seed).select(
        F.col(user).alias("neighbour"),
        F.when(norm * F.lit(snorm) > 0, dot / (norm * F.lit(snorm))).otherwise(F.lit(0.0)).alias("similarity"))
    top = sim.orderBy(F.desc("similarity"), F.asc("neighbour")).limit(k)
    return top.select(seed.alias("seed_user"), "neighbour", "similarity",
                      F.row_number().over(W.orderBy(F.desc("similarity"), F.asc("neighbour"))).alias("rank"))
