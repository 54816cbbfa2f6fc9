import dataclasses
import os
import tempfile

from pyspark.sql import functions as F

from conftest import SMOKE
from sparkjourney.analysis import run_analysis, EVENTS_CONFIG
from sparkjourney.plans import tables as t


def test_run_analysis_writes_consistent_outputs(spark):
    out = tempfile.mkdtemp(prefix="sj-analysis-", dir="/tmp")
    cfg = dataclasses.replace(EVENTS_CONFIG, ks=(2, 3, 4), n_init=1)
    ev = t.events(spark, SMOKE)
    paths = run_analysis(ev, out, cfg)
    for name in ("preprocessed", "rfm", "customer_marketing_actions", "clusters", "user_funnel_table",
                 "recommendations", "event_spike_anomalies", "rfm_anomalies", "project_summary", "overview"):
        assert os.path.isdir(paths[name]), name
    read = lambda n: spark.read.parquet(paths[n])
    n_events, n_users = ev.count(), ev.select("user_id").distinct().count()
    assert read("preprocessed").count() == n_events
    assert read("rfm").count() == n_users == read("customer_marketing_actions").count()
    assert read("project_summary").count() == n_users
    assert read("clusters").select("cluster").distinct().count() == read("cluster_profile").count()
    ov = read("overview").first()
    assert ov.total_users == n_users and ov.churned_users + ov.active_users == n_users
    fu = read("user_funnel_table").agg(*[F.sum(s) for s in cfg.stages]).first()
    fs = {r.stage: r.users_reached for r in read("funnel_summary").collect()}
    assert list(fu) == [fs[s] for s in cfg.stages]
    assert read("recommendations").count() <= cfg.top_products


def test_csv_ingestion_matches_parquet_binding(spark):
    """The events table written in the clickstream CSV layout and read back
    through the CSV reader gives the same sessions and RFM as the binding."""
    from sparkjourney.operators.rfm import rfm
    from sparkjourney.operators.sessions import sessionize
    from sparkjourney.sources import read_clickstream_csv, clickstream_to_events
    raw = spark.read.parquet(f"{SMOKE}/events.parquet")
    csv = raw.select(F.col("user_id").alias("UserID"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("Timestamp"),
                     F.col("event_type").alias("EventType"), F.get_json_object("props", "$.k").alias("ProductID"),
                     F.col("value").alias("Amount"), F.year("ts").alias("Year"), F.month("ts").alias("Month"),
                     F.dayofmonth("ts").alias("Day"))
    path = tempfile.mkdtemp(prefix="sj-csvin-", dir="/tmp") + "/clicks"
    csv.write.option("header", True).csv(path)
    ev = clickstream_to_events(read_clickstream_csv(spark, path), ts_format="full")
    a = rfm(sessionize(ev)).orderBy("user_id").collect()
    b = rfm(t.sessions(spark, SMOKE)).orderBy("user_id").collect()
    assert [(r.user_id, r.recency, r.frequency, round(r.monetary, 6)) for r in a] == \
        [(r.user_id, r.recency, r.frequency, round(r.monetary, 6)) for r in b]
