"""Canonical column names and the bindings of the driver's tables to them.

Operators work on a canonical event frame so the same code serves any event
source: a source is bound once with a projection (which Catalyst pushes into
the scan as column pruning), never by renaming inside every operator.
"""

from __future__ import annotations

from pyspark.sql import types as T

USER = "user_id"
TS = "ts"
EVENT = "event_type"
PRODUCT = "product_id"
AMOUNT = "amount"
EVENT_ID = "event_id"
SESSION = "session_id"

EVENT_COLUMNS = (EVENT_ID, USER, TS, EVENT, PRODUCT, AMOUNT)

# Columns of the clickstream CSV export that the analysis reads, with their
# types (SessionID is optional: it is always re-derived).
CLICKSTREAM_CSV_SCHEMA = T.StructType([
    T.StructField("UserID", T.LongType(), True),
    T.StructField("SessionID", T.LongType(), True),
    T.StructField("Timestamp", T.StringType(), True),
    T.StructField("EventType", T.StringType(), True),
    T.StructField("ProductID", T.StringType(), True),
    T.StructField("Amount", T.DoubleType(), True),
    T.StructField("Year", T.IntegerType(), True),
    T.StructField("Month", T.IntegerType(), True),
    T.StructField("Day", T.IntegerType(), True),
])

# ---------------------------------------------------------------------------
# Must equal the analysis' values for the same results.
# Funnel stages and spike event types of the clickstream export.
CLICKSTREAM_STAGES = ["login", "page_view", "product_view", "click", "add_to_cart", "purchase"]
CLICKSTREAM_SPIKE_TYPES = ["click", "login"]
# Cluster id -> marketing action.
MARKETING_ACTIONS = {
    0: "VIP Customers: Exclusive discounts & early sales access.",
    1: "Loyal Customers: Personalized product recommendations.",
    2: "At-Risk Customers: Win-back campaigns with incentives.",
    3: "Big Spenders: Premium upselling opportunities.",
    4: "New/Inactive Users: Engagement & onboarding initiatives.",
}
# Action texts that mean "churned" (matched case-insensitively).
CHURN_ACTION_PATTERN = "Win-Back|At-Risk"
# Labels of the summary tables.
SPIKE_SHARE_LABELS = ("Normal Users", "Event Spike Anomalies")
CHURN_LABELS = {0: "Active", 1: "Churned"}
RFM_ANOMALY_LABELS = {True: "Anomaly", False: "Normal"}
EVENT_ANOMALY_LABELS = {True: "Spike Detected", False: "Normal"}
ANOMALY_KIND_LABELS = ("RFM Anomalies", "Event Spikes")
CLUSTER_LABEL_PREFIX = "Cluster "
TRANSITION_ARROW = " → "
# ---------------------------------------------------------------------------

# The same roles on the driver's `events` table (signup plays login,
# view plays page/product view).
EVENTS_STAGES = ["signup", "view", "click", "purchase"]
EVENTS_SPIKE_TYPES = ["click", "signup"]
EVENTS_VIEW = "view"
PURCHASE = "purchase"
