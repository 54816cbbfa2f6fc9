"""The end-to-end analysis as one batch job: every stage output and dashboard table.

``run_analysis`` computes the stages in dependency order and writes each
output once under ``out_dir`` (parquet by default).  The event-grain stage
(sessions + features) is written first and read back for everything
downstream, so the sessionization runs once and later stages start from a
written table in the shared output folder rather than from a long lineage.

Outputs (one directory each): preprocessed, feature_scaler, rfm, customer_marketing_actions,
clusters (partitioned by cluster), cluster_profile, action_counts,
funnel_flags, funnel_summary, funnel_dropoff, time_to_convert,
time_to_convert_by_cluster, cluster_transitions, user_funnel_table, recommendations, high_intent,
event_spike_anomalies, suspicious_timeline, spike_share, rfm_anomalies,
project_summary, snapshot_shares, overview, segment_sizes, anomaly_counts,
and with ``models=True`` model_metrics and feature_importance.

Command line: ``python -m sparkjourney.analysis --events PATH --out DIR
[--format csv|parquet] [--source events|clickstream-csv] [--ts-format parts|full]``.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from sparkjourney import schema as S
from sparkjourney.operators import anomaly, churn, funnel, intent, marts, recommend, rfm as rfm_ops, segments
from sparkjourney.operators.sessions import preprocess
from sparkjourney.operators.stats import scaler_stats
from sparkjourney.session import materialize
from sparkjourney.sources.writers import write_stage, write_by_cluster

SCALE_COLS = ("session_duration", "gap_seconds", "hour_of_day", "weekday")


@dataclass
class AnalysisConfig:
    stages: list = field(default_factory=lambda: list(S.CLICKSTREAM_STAGES))
    spike_types: list = field(default_factory=lambda: list(S.CLICKSTREAM_SPIKE_TYPES))
    view_event: str = "product_view"
    purchase_event: str = S.PURCHASE
    gap_seconds: float = 1800.0
    churn_days: int = 7
    ks: tuple = tuple(range(2, 11))
    n_init: int = 10
    spike_q: float = 0.95
    contamination: float = 0.02
    timeline_users: int = 3
    top_intent: int = 10
    neighbours: int = 5
    top_products: int = 10


# The same roles on the driver's `events` table.
EVENTS_CONFIG = AnalysisConfig(stages=list(S.EVENTS_STAGES), spike_types=list(S.EVENTS_SPIKE_TYPES),
                               view_event=S.EVENTS_VIEW, churn_days=1)


def run_analysis(events: DataFrame, out_dir: str, config: AnalysisConfig | None = None, fmt: str = "parquet",
                 models: bool = False) -> dict[str, str]:
    """Run every stage on canonical events and write the outputs; returns name -> path."""
    cfg = config or AnalysisConfig()
    spark: SparkSession = events.sparkSession
    out = out_dir.rstrip("/")
    paths: dict[str, str] = {}

    def put(name: str, df: DataFrame) -> None:
        paths[name] = f"{out}/{name}"
        write_stage(df, paths[name], fmt=fmt)

    # 1. event grain: sessions + features, written once and read back; the
    #    scaler is fitted on the written table (a scan and one aggregate, not a
    #    second sessionization) and stored as one row -- z-scores are a cheap
    #    transform (`apply_scaler`) wherever they are needed
    pre = preprocess(events, gap_seconds=cfg.gap_seconds)
    paths["preprocessed"] = f"{out}/preprocessed"
    write_stage(pre, paths["preprocessed"], fmt="parquet")
    sessions = spark.read.parquet(paths["preprocessed"])
    put("feature_scaler", scaler_stats(sessions, list(SCALE_COLS)))

    # 2. user grain: RFM, segments, actions
    prof = rfm_ops.rfm(sessions)
    put("rfm", prof)
    prof = spark.read.parquet(paths["rfm"]) if fmt == "parquet" else prof
    seg, sweep, _ = segments.segment(prof, ks=cfg.ks, n_init=cfg.n_init)
    seg = materialize(seg)  # user grain, like every table kept below: read by several outputs
    acts = marts.churn_from_action(segments.marketing_actions(seg))
    put("customer_marketing_actions", acts)
    paths["clusters"] = f"{out}/clusters"
    write_by_cluster(acts, paths["clusters"], fmt=fmt)
    put("cluster_profile", segments.cluster_profile(seg))
    put("action_counts", segments.action_counts(acts))
    put("kmeans_sweep", spark.createDataFrame(sweep, "k int, inertia double, silhouette double"))

    # 3. funnel
    times = materialize(funnel.stage_times(sessions, cfg.stages))
    flags = funnel.funnel_flags(times, cfg.stages)  # a projection
    put("funnel_flags", flags)
    put("funnel_summary", funnel.funnel_summary(flags, cfg.stages))
    put("funnel_dropoff", funnel.funnel_dropoff(flags, cfg.stages))
    put("time_to_convert", funnel.time_to_convert(times, cfg.stages))
    by_cluster = materialize(funnel.time_to_convert_by(times, seg, cfg.stages))
    put("time_to_convert_by_cluster", by_cluster)
    put("cluster_transitions", funnel.transitions_wide(by_cluster, cfg.stages))
    put("user_funnel_table", funnel.funnel_by(flags, seg, cfg.stages))

    # 4. recommendation and intent
    counts = materialize(recommend.purchase_counts(sessions, cfg.purchase_event))
    seed = recommend.default_seed(counts)
    nb = recommend.user_neighbours(counts, seed, cfg.neighbours)
    put("recommendations", recommend.hybrid_scores(recommend.collab_scores(counts, nb, seed),
                                                   recommend.cooccurrence_scores(counts, seed), cfg.top_products))
    put("high_intent", intent.high_intent(sessions, cfg.view_event, cfg.top_intent))

    # 5. anomalies
    spikes = materialize(anomaly.event_spikes(sessions, cfg.spike_types, cfg.spike_q))
    put("event_spike_anomalies", spikes)
    put("suspicious_timeline", anomaly.suspicious_timeline(sessions, spikes, cfg.timeline_users))
    put("spike_share", anomaly.spike_share(sessions, spikes))
    rfm_anom = materialize(anomaly.rfm_anomalies(prof, contamination=cfg.contamination))
    put("rfm_anomalies", rfm_anom.where("anomaly = -1"))

    # 6. marts
    summary = materialize(marts.project_summary(seg, acts, rfm_anom, spikes))
    put("project_summary", summary)
    put("snapshot_shares", marts.snapshot_shares(summary))
    put("overview", marts.overview(acts))
    put("segment_sizes", marts.segment_sizes(acts))
    put("anomaly_counts", marts.anomaly_counts(rfm_anom, spikes))

    # 7. churn models (optional: the slowest stage)
    if models:
        feats = churn.binary_label(rfm_ops.churn_label(rfm_ops.user_features(sessions), cfg.churn_days))
        rows, fitted = churn.train_churn(feats)
        put("model_metrics", spark.createDataFrame(
            rows, "model string, accuracy double, precision double, recall double, f1 double, roc_auc double"))
        put("feature_importance", spark.createDataFrame(
            churn.feature_importance(fitted["Random Forest"]), "feature string, importance double"))
    return paths


def main(argv=None) -> None:
    from sparkjourney.session import get_spark
    from sparkjourney.sources.readers import bind_events, clickstream_to_events, read_clickstream_csv

    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--events", required=True, help="driver events parquet, or the clickstream CSV")
    ap.add_argument("--out", required=True)
    ap.add_argument("--source", choices=["events", "clickstream-csv"], default="events")
    ap.add_argument("--ts-format", choices=["parts", "full"], default="full")
    ap.add_argument("--format", choices=["parquet", "csv"], default="parquet")
    ap.add_argument("--models", action="store_true")
    a = ap.parse_args(argv)
    spark = get_spark()
    if a.source == "events":
        ev, cfg = bind_events(spark.read.parquet(a.events)), EVENTS_CONFIG
    else:
        ev, cfg = clickstream_to_events(read_clickstream_csv(spark, a.events), a.ts_format), AnalysisConfig()
    for name, path in run_analysis(ev, a.out, cfg, fmt=a.format, models=a.models).items():
        print(f"{name}\t{path}")


if __name__ == "__main__":
    main()
