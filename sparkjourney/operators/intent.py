"""High-intent users: the product each user viewed most, top users by views."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkjourney import schema as S


def view_counts(events: DataFrame, view: str = "product_view", user: str = S.USER, product: str = S.PRODUCT,
                event: str = S.EVENT) -> DataFrame:
    """(user, product, view_count)."""
    return (events.where((F.col(event) == F.lit(view)) & F.col(user).isNotNull() & F.col(product).isNotNull())
            .groupBy(user, product).agg(F.count(F.lit(1)).alias("view_count")))


def top_product_per_user(counts: DataFrame, user: str = S.USER, product: str = S.PRODUCT,
                         count: str = "view_count") -> DataFrame:
    """(user, product, count) of each user's most-viewed product (smallest id on ties).

    An arg-max aggregate (``min`` over the struct (-count, product)) instead
    of a per-user window: it aggregates partially before the shuffle, so a
    user with a huge number of products never sits whole in one task.
    """
    best = counts.groupBy(user).agg(F.min(F.struct((-F.col(count)).alias("neg"), F.col(product).alias("p"))).alias("b"))
    return best.select(user, F.col("b.p").alias(product), (-F.col("b.neg")).alias(count))


def high_intent(events: DataFrame, view: str = "product_view", n: int = 10) -> DataFrame:
    """Top-n users by their most-viewed product's view count (ties: smaller user id)."""
    top = top_product_per_user(view_counts(events, view))
    return top.orderBy(F.desc("view_count"), F.asc(S.USER)).limit(n)
