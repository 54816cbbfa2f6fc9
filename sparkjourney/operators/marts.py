"""Dashboard marts: overview KPIs, per-user summary, shares, segment tables.

All marts are one row per user (or smaller).  Every user-keyed join first
reduces its right side to distinct keys, so no join can multiply users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkjourney import schema as S
from sparkjourney.functions.scalar import regex_flag, relabel
from sparkjourney.operators.segments import CHURN_ACTION_PATTERN


def churn_from_action(actions: DataFrame, col: str = "marketing_action", name: str = "churn") -> DataFrame:
    """``churn = 1`` when the action text names a win-back / at-risk campaign."""
    return actions.withColumn(name, regex_flag(col, CHURN_ACTION_PATTERN))


def overview(churn: DataFrame, user: str = S.USER, label: str = "churn") -> DataFrame:
    """(total_users, churned_users, active_users), one row."""
    per_user = churn.groupBy(user).agg(F.max(label).alias(label))
    return per_user.agg(F.count(F.lit(1)).alias("total_users"),
                        F.coalesce(F.sum(label), F.lit(0)).cast("bigint").alias("churned_users")) \
        .withColumn("active_users", F.col("total_users") - F.col("churned_users"))


def segment_sizes(seg: DataFrame, cluster: str = "cluster", user: str = S.USER) -> DataFrame:
    """(cluster, user_count) for every cluster."""
    return seg.groupBy(cluster).agg(F.countDistinct(user).alias("user_count"))


def churn_table(actions_churn: DataFrame, cluster=None, cluster_col: str = "cluster") -> DataFrame:
    """(user, cluster, churn, marketing_action), optionally one cluster only."""
    out = actions_churn.select(S.USER, cluster_col, "churn", "marketing_action")
    return out.where(F.col(cluster_col) == F.lit(cluster)) if cluster is not None else out


def flag_members(df: DataFrame, members: DataFrame, name: str, user: str = S.USER) -> DataFrame:
    """Add a boolean column: is the user in ``members`` (existence join)."""
    keys = members.select(user).distinct().withColumn(name, F.lit(True))
    return df.join(keys, user, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def project_summary(seg: DataFrame, actions: DataFrame, rfm_anomalies: DataFrame, spikes: DataFrame,
                    user: str = S.USER) -> DataFrame:
    """Per user: cluster, churn (from the action text), rfm_anomaly, event_anomaly."""
    base = seg.select(user, "cluster").dropDuplicates([user, "cluster"])
    ch = churn_from_action(actions).groupBy(user).agg(F.max("churn").alias("churn"))
    out = base.join(ch, user, "left")
    out = flag_members(out, rfm_anomalies.where(F.col("anomaly") == -1), "rfm_anomaly", user)
    return flag_members(out, spikes, "event_anomaly", user)


def summary_totals(summary: DataFrame, user: str = S.USER) -> DataFrame:
    """One row: users, clusters, churned, RFM anomalies, spike anomalies."""
    return summary.agg(F.countDistinct(user).alias("total_users"),
                       F.countDistinct("cluster").alias("n_clusters"),
                       F.coalesce(F.sum("churn"), F.lit(0)).cast("bigint").alias("churned_users"),
                       F.count_if("rfm_anomaly").alias("rfm_anomalies"),
                       F.count_if("event_anomaly").alias("event_anomalies"))


def snapshot_shares(summary: DataFrame) -> DataFrame:
    """(dimension, value, users, share) for cluster, churn status and both anomaly flags."""
    dims = [
        ("cluster", F.concat(F.lit(S.CLUSTER_LABEL_PREFIX), F.col("cluster").cast("string"))),
        ("churn", relabel("churn", S.CHURN_LABELS)),
        ("rfm_anomaly", relabel("rfm_anomaly", S.RFM_ANOMALY_LABELS)),
        ("event_anomaly", relabel("event_anomaly", S.EVENT_ANOMALY_LABELS)),
    ]
    long = summary.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("value"))
                                              for d, v in dims])).alias("kv")).select("kv.*")
    counts = long.where(F.col("value").isNotNull()).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("users"))
    totals = counts.groupBy("dimension").agg(F.sum("users").alias("_t"))
    return counts.join(F.broadcast(totals), "dimension").select(
        "dimension", "value", "users", (F.col("users") / F.col("_t")).alias("share"))


def anomaly_counts(rfm_anomalies: DataFrame, spikes: DataFrame) -> DataFrame:
    """(kind, users) for RFM anomalies and event-spike users."""
    a = rfm_anomalies.where(F.col("anomaly") == -1).agg(F.count(F.lit(1)).alias("users")) \
        .select(F.lit(S.ANOMALY_KIND_LABELS[0]).alias("kind"), "users")
    b = spikes.agg(F.count(F.lit(1)).alias("users")).select(F.lit(S.ANOMALY_KIND_LABELS[1]).alias("kind"), "users")
    return a.unionByName(b)
