"""Multi-party perspective rotation of conversations, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that
speaker as the assistant and the others as named users, with the spans that a
model should be trained on (the speaker's own texts and their end marks).  A
conversation is cut every ``PART`` rows in turn order, so no row or group holds more
than ``PART`` turns, whatever the turn numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sparkjourney.llm.common import cut

PART = 64
#: Speakers who instruct and take no part: rendered as themselves, without a perspective.
NARRATORS = ("system",)
OPEN, CLOSE, NAMED = "<|im_start|>", "<|im_end|>\n", " name="


def _by_rows(turns: DataFrame, part: int) -> DataFrame:
    """(conv_id, part, turns) with ``part`` rows a part, in turn order.

    Rows are numbered by a two-level running total: equal rows are collapsed to one
    with their number, ranges of the order are scanned each by itself, and the totals
    of a conversation's earlier ranges are added."""
    order = ["turn", "role", "text"]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(turns.groupBy("conv_id", *order).agg(F.count("*").alias("copies"))
                 .repartitionByRange(n, "conv_id", *order).withColumn("range", F.spark_partition_id()))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = (ranged.groupBy("conv_id", "range").agg(F.sum("copies").alias("rows"))
              .select(F.col("conv_id").alias("_id"), F.col("range").alias("_range"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset")))
    before = Window.partitionBy("conv_id", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = (ranged.withColumn("before", F.coalesce(F.sum("copies").over(before), F.lit(0)))
              .join(totals, (F.col("range") == F.col("_range")) & F.col("conv_id").eqNullSafe(F.col("_id")))
              .withColumn("first", F.col("offset") + F.col("before")).withColumn("end", F.col("first") + F.col("copies")))
    cuts = F.sequence(F.floor(F.col("first") / part), F.floor((F.col("end") - 1) / part))
    # a row's copies within each part that they reach
    pieces = placed.select("conv_id", *order, "first", "end", F.explode(cuts).alias("part")).select(
        "conv_id", "part", *order, (F.least("end", (F.col("part") + 1) * part) - F.greatest("first", F.col("part") * part)).cast("int").alias("copies"))
    made = pieces.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct(*order, "copies"))).alias("rows"))
    repeat = lambda t: F.array_repeat(F.struct(*[t[c].alias(c) for c in order]), t["copies"])
    return made.select("conv_id", "part", F.flatten(F.transform("rows", repeat)).alias("turns"))


def perspectives(turns: DataFrame, part: int = PART, narrators=NARRATORS) -> DataFrame:
    """(conv_id, speaker, part, n_turns, rendered, spans) per conversation, participant
    and part; spans are (start, end) code points of ``rendered``.

    Turns are ordered by number (null first), then speaker, then text; part 0 holds the
    first ``part`` rows in that order, and so on; a null role is the speaker ``unknown``; a null text is empty; null
    conv_ids form one conversation; repeated rows are repeated turns; a conversation
    of narrators only has no perspective; an empty table gives no rows; other columns are ignored."""
    turns = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"),
                         F.coalesce("text", F.lit("")).alias("text"))
    speakers = (turns.where(~F.col("role").isin(*narrators)).select("conv_id", "role").distinct()
                .select(F.col("conv_id").alias("of"), F.col("role").alias("speaker")))
    crowded = cut(turns.groupBy("conv_id").count().where(F.col("count") > part).select(F.col("conv_id").alias("_id")))
    whole = lambda rows: rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")).select(
        "conv_id", F.lit(0).cast("long").alias("part"), "turns")
    if crowded.isEmpty():
        parts = whole(turns)
    else:
        same = F.col("conv_id").eqNullSafe(F.col("_id"))
        parts = whole(turns.join(crowded, same, "left_anti")).unionByName(_by_rows(turns.join(crowded, same, "left_semi"), part))
    both = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    # one segment a turn: its opening mark, its text with the end mark, and whether it is the speaker's own
    segments = F.transform("turns", lambda t: F.struct(
        F.when(t["role"] == F.col("speaker"), F.lit(f"{OPEN}assistant\n")).when(t["role"].isin(*narrators), F.concat(F.lit(OPEN), t["role"], F.lit("\n")))
        .otherwise(F.concat(F.lit(f"{OPEN}user{NAMED}"), t["role"], F.lit("\n"))).alias("head"),
        F.concat(t["text"], F.lit(CLOSE)).alias("body"), (t["role"] == F.col("speaker")).alias("own")))
    made = both.select("conv_id", "speaker", "part", segments.alias("segments"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, s):
        body = acc["at"] + F.length(s["head"])
        end = body + F.length(s["body"])
        own = F.array(F.struct(body.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(s["own"], F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    return made.select("conv_id", "speaker", "part", F.size("segments").cast("long").alias("n_turns"),
                       F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["body"])), "").alias("rendered"),
                       F.aggregate("segments", start, step)["spans"].alias("spans"))


def with_written_spans(rows: DataFrame) -> DataFrame:
    """``perspectives`` with the spans as text, start-end joined by commas."""
    return rows.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ","))


def perspectives_sql(part: int = PART, narrators=NARRATORS) -> str:
    """The same in SQL, with written spans, for the conversations table."""
    names = ", ".join(f"'{n}'" for n in narrators)
    close = CLOSE.replace("\n", "") + "' || chr(10)"
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1) // {part} AS part FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role NOT IN ({names})),
g AS (
  SELECT t.conv_id, s.speaker, t.part, t.turn, t.role, t.text, t.role = s.speaker AS own,
         '{OPEN}' || CASE WHEN t.role = s.speaker THEN 'assistant' WHEN t.role IN ({names}) THEN t.role
                          ELSE 'user{NAMED}' || t.role END || chr(10) AS head,
         t.text || '{close} AS body
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
o AS (
  SELECT *, row_number() OVER w AS i, sum(length(head) + length(body)) OVER w AS upto FROM g
  WINDOW w AS (PARTITION BY conv_id, speaker, part ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, speaker, part, count(*) AS n_turns, string_agg(head || body, '' ORDER BY i) AS rendered,
       coalesce(string_agg(CASE WHEN own THEN CAST(upto - length(body) AS BIGINT) || '-' || CAST(upto AS BIGINT) END, ',' ORDER BY i), '') AS spans
FROM o GROUP BY conv_id, speaker, part"""
