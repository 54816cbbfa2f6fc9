"""Readers and bindings of source tables to the canonical event frame.

A binding is a plain projection: Catalyst prunes the scan to the columns used
and pushes any later filter (e.g. ``event_type IN (...)``) into the Parquet
reader, so binding costs nothing at scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sparkjourney import schema as S
from sparkjourney.functions.time import timestamp_from_parts, parse_timestamp


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables, e.g. ``read_table(spark, d, 'events')``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bind_events(events: DataFrame) -> DataFrame:
    """Driver ``events`` table -> canonical events.

    Product id comes from the JSON ``props`` column (``{"k": n}``).
    """
    return events.select(
        F.col("event_id").alias(S.EVENT_ID),
        F.col("user_id").alias(S.USER),
        F.col("ts").alias(S.TS),
        F.col("event_type").alias(S.EVENT),
        F.get_json_object("props", "$.k").try_cast("int").alias(S.PRODUCT),
        F.col("value").alias(S.AMOUNT),
    )


def bind_orders(orders: DataFrame) -> DataFrame:
    """Driver ``orders`` table -> canonical events, one purchase event per order.

    An order is one session, so ``session_id`` is the order key and every row
    starts its session (session counts are then plain counts, no distinct).
    """
    return orders.select(
        F.col("o_orderkey").alias(S.EVENT_ID),
        F.col("o_custkey").alias(S.USER),
        F.col("o_orderdate").alias(S.TS),
        F.lit(S.PURCHASE).alias(S.EVENT),
        F.lit(None).cast("int").alias(S.PRODUCT),
        F.col("o_totalprice").alias(S.AMOUNT),
        F.col("o_orderkey").alias(S.SESSION),
        F.lit(True).alias("is_session_start"),
    )


def bind_order_lines(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Purchases at line grain: (user, product) from ``lineitem`` joined to ``orders``.

    The join is on the order key, a many-to-one equi-join; Spark picks the
    strategy (AQE turns it into a broadcast only when ``orders`` is small).
    """
    o = orders.select(F.col("o_orderkey"), F.col("o_custkey").alias(S.USER),
                      F.col("o_orderdate").alias(S.TS))
    li = lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias(S.PRODUCT),
                         F.col("l_linenumber"))
    return (li.join(o, "o_orderkey")
            # line numbers are small (1..7 in the generator); x1000 keeps ids unique
            .select((F.col("o_orderkey") * 1000 + F.col("l_linenumber")).alias(S.EVENT_ID),
                    S.USER, S.TS, F.lit(S.PURCHASE).alias(S.EVENT), S.PRODUCT,
                    F.lit(None).cast("double").alias(S.AMOUNT),
                    F.col("o_orderkey").alias(S.SESSION)))


def _parsed(field: T.StructField):
    """The column's text as its type; integers may be written as whole floats (``2024.0``)."""
    text = F.col(field.name)
    value = text.try_cast(field.dataType)
    if isinstance(field.dataType, T.IntegralType):
        number = text.try_cast("double")
        value = F.coalesce(value, F.when(number == F.floor(number), number.try_cast(field.dataType)))
    return value


#: Why a row is set aside.
MALFORMED, BAD_VALUE, NO_USER, BAD_TIME = "malformed row", "unparseable value", "no user", "no time"


def read_clickstream_csv(spark: SparkSession, path: str, schema=S.CLICKSTREAM_CSV_SCHEMA) -> DataFrame:
    """The clickstream CSV export, columns matched by header name.

    Spark applies an explicit CSV schema by position, so the file is read as
    strings by header (one pass, no inference) and the used columns are cast
    by name to ``schema``'s types (unparseable values -> NULL).  Columns of
    ``schema`` missing from the file fail fast.
    """
    return _typed(_raw_csv(spark, path, schema), schema)


def _raw_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """All columns of the header as text, and ``_bad``: the line, if it has another number of fields."""
    columns = spark.read.option("header", True).csv(path).columns
    missing = [f.name for f in schema.fields if f.name not in columns and f.name not in ("SessionID",)]
    if missing:
        raise ValueError(f"clickstream CSV lacks columns {missing}; has {columns}")
    text = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "_bad"]])
    return spark.read.schema(text).option("header", True).option("columnNameOfCorruptRecord", "_bad").option(
        "columnPruning", False).csv(path)  # pruned, the fields of a line are not counted


def _typed(raw: DataFrame, schema) -> DataFrame:
    return raw.select(*[_parsed(f).alias(f.name) if f.name in raw.columns
                        else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_clickstream_checked(spark: SparkSession, path: str, ts_format: str = "parts",
                             schema=S.CLICKSTREAM_CSV_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """(events, quarantine) of the export: every row of the file is in one of them.

    The quarantine holds the columns as text, the ``line`` of a malformed row, and
    ``reason``, the first that applies: another number of fields than the header, a
    value that is no value of its type, no user, no time that exists."""
    raw = _raw_csv(spark, path, schema)
    used = [f for f in schema.fields if f.name in raw.columns]
    bad = F.lit(False)
    for f in used:
        bad = bad | (F.col(f.name).isNotNull() & _parsed(f).isNull())
    keep = _typed(raw, schema).columns
    typed = raw.select(F.struct(*[c for c in raw.columns if c != "_bad"]).alias("_text"), "_bad", bad.alias("_value"),
                       *[_parsed(f).alias(f.name) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
    reason = (F.when(F.col("_bad").isNotNull(), F.lit(MALFORMED)).when(F.col("_value"), F.lit(BAD_VALUE))
              .when(F.col("UserID").isNull(), F.lit(NO_USER)).when(_time_of(ts_format).isNull(), F.lit(BAD_TIME)))
    checked = typed.withColumn("reason", reason)
    events = clickstream_to_events(checked.where(F.col("reason").isNull()).select(*keep), ts_format)
    return events, checked.where(F.col("reason").isNotNull()).select("reason", F.col("_bad").alias("line"), "_text.*")


def quarantine_counts(quarantine: DataFrame) -> DataFrame:
    """(reason, rows) of the rows set aside."""
    return quarantine.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def _time_of(ts_format: str):
    if ts_format == "parts":
        return timestamp_from_parts("Year", "Month", "Day", "Timestamp")
    if ts_format == "full":
        return parse_timestamp("Timestamp")
    raise ValueError(f"ts_format must be 'parts' or 'full', not {ts_format!r}")


def with_event_ids(events: DataFrame, name: str = S.EVENT_ID) -> DataFrame:
    """Add an id that depends on the row alone: a hash of its values and of its ordinal
    among equal rows, so it is the same however the files are split.

    Equal rows are counted (combined in each task before they move) and laid out
    again, with ordinals from 0."""
    cols = events.columns
    counted = events.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    each = counted.select(*cols, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_k"))
    return each.select(F.xxhash64(*cols, "_k").alias(name), *cols)


def clickstream_to_events(raw: DataFrame, ts_format: str = "parts") -> DataFrame:
    """Clickstream export -> canonical events, with ids by ``with_event_ids``.

    ``ts_format='parts'`` rebuilds the time from Year/Month/Day and an
    ``mm:ss.f`` Timestamp (hour is always 0); ``'full'`` parses Timestamp as a
    complete timestamp.  Rows whose time cannot be built are dropped
    (``read_clickstream_checked`` keeps them apart).
    """
    rows = raw.select(
        F.col("UserID").alias(S.USER), _time_of(ts_format).alias(S.TS),
        F.col("EventType").alias(S.EVENT), F.col("ProductID").alias(S.PRODUCT),
        F.col("Amount").alias(S.AMOUNT)).where(F.col(S.TS).isNotNull())
    return with_event_ids(rows)


def with_defaults(df: DataFrame, columns, value=0) -> DataFrame:
    """Add each missing column as a constant (opt-in; a missing input column
    otherwise fails fast when an operator selects it)."""
    for c in columns:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(value))
    return df


def require_columns(df: DataFrame, columns) -> DataFrame:
    """Fail fast with the list of missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}; have {df.columns}")
    return df
