"""Benchmark decontamination with SimHash windows, in DataFrame functions only.

Items are cut into parts of at most ``PART`` word 5-shingles, so that a window
has the size of a part.  A shingle weighs 2, or 1 if several items hold it; in
fingerprints, shingles that no part holds weigh 0.  A window starts at every
document shingle that weighs something, once for each size of a part with that
shingle: any window that is similar to a part loses nothing by starting at the
first shingle they share.  Its 64-bit SimHash adds up weighted bits, and
RADIUS + 1 blocks of it are looked up: fingerprints within the radius agree on
one block at least, so all of them are found.  What is found is verified by the
exact weighted similarity of the window's and the part's shingles (with
multiplicity; unknown shingles of the window weigh 2).  Parts of a longer item only
name the documents to look at: there, windows of the whole item's size are verified
against the whole item, for all their starts at once by running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkjourney.llm.common import cut, without

WORDS = 5
PART = 60
RADIUS = 20
SIMILARITY = 80  # per cent
#: The benchmark's parts are broadcast up to this many shingle rows; beyond, they are joined.
BROADCAST_ROWS = 2_000_000
_SPAN = 64
_LANES = 0x0101010101010101
_SEVEN = 0x00FFFFFFFFFFFFFF
_TOPS = 0x0080808080808080


def shingled(df: DataFrame, key: str) -> DataFrame:
    """(key, body, size, pos, shingle): every 5-word shingle's hash, in place; a
    text of fewer words is one shingle.  ``body`` tells texts apart that repeat a key."""
    words = df.select(F.col(key).cast("long").alias(key), F.xxhash64("text").alias("body"),
                      F.transform(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("w"))
    n = F.size("w")
    some = words.where(n > 0).select(key, "body", "w", F.greatest(n - (WORDS - 1), F.lit(1)).alias("size"))
    at = lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WORDS)])
    return some.select(key, "body", "size", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("size") - 1), at)).alias("pos", "shingle"))


def _lane_sums(shingle: Column, weight: Column) -> list[Column]:
    """Eight packed numbers of eight one-byte counters each: the weights of a set bit.
    A part's weights sum to 120 at most, so a counter cannot overflow."""
    return [F.sum(F.expr(f"(shiftrightunsigned(shingle, {j}) & {_LANES}L) * weight")).alias(f"l{j}") for j in range(8)]


def _fingerprint() -> Column:
    """64 bits from the lane sums l0 .. l7 and the total weight: a bit is set where
    its counter exceeds half the total."""
    out = F.lit(0).cast("long")
    for j in range(8):
        # seven counters at once: adding 127 less half the total sets a counter's top bit; the eighth by itself, for the sign
        seven = F.expr(f"((l{j} & {_SEVEN}L) + (127 - total div 2) * {_LANES & _SEVEN}L) & {_TOPS}L")
        eighth = F.when(F.expr(f"shiftrightunsigned(l{j}, 56) > total div 2"), F.lit((1 << (56 + j)) - (1 << 64 if j == 7 else 0))).otherwise(0)
        out = out.bitwiseOR(F.shiftrightunsigned(seven, 7 - j)).bitwiseOR(eighth.cast("long"))
    return out


def _blocks(value: str) -> Column:
    """RADIUS + 1 (number, bits) pairs that partition the 64 bits."""
    n = RADIUS + 1
    edges = [64 * i // n for i in range(n + 1)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.expr(f"shiftrightunsigned({value}, {a}) & {(1 << (b - a)) - 1}L").alias("bits"))
                     for i, (a, b) in enumerate(zip(edges, edges[1:]))])


def item_parts(benchmark: DataFrame) -> DataFrame:
    """(item_id, item, part, cut, size, shingle, copies, weight) of every part's distinct
    shingles; ``item`` tells texts apart that repeat an id, ``cut`` whether it has several parts."""
    rows = shingled(benchmark.where("text is not null and item_id is not null"), "item_id")
    # parts of nearly equal size, PART shingles at most
    count = F.ceil(F.col("size") / PART)
    part = F.floor(F.col("pos") * count / F.col("size"))
    named = rows.select("item_id", F.xxhash64("item_id", "body").alias("item"), F.xxhash64("item_id", "body", part.alias("p")).alias("part"),
                        (count > 1).alias("cut"), "shingle")
    size = named.groupBy("part").agg(F.count("*").alias("size"))
    held = named.groupBy("item_id", "item", "part", "cut", "shingle").agg(F.count("*").alias("copies"))
    rare = held.select("item", "shingle").distinct().groupBy("shingle").agg(F.when(F.count("*") == 1, 2).otherwise(1).cast("long").alias("weight"))
    return held.join(rare, "shingle").join(size, "part").select("item_id", "item", "part", "cut", "size", "shingle", "copies", "weight")


def _whole_items(found: DataFrame, hits: DataFrame, parts: DataFrame, sent) -> DataFrame:
    """(doc_id, item_id, start, common, union) of every window of a long item's size
    that starts at a shingle of the item, in the documents where a part was found.

    An occurrence counts for the starts up to itself from which the window reaches it
    and holds fewer earlier ones than the item has copies; a running total over the
    ends of these ranges gives what the window and the item have in common."""
    items = parts.where("cut").groupBy("item_id", "item", "shingle", "weight").agg(F.sum("copies").alias("copies"))
    sizes = items.groupBy("item").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("weight")).alias("item_total"))
    near = cut(found.where("cut").select("doc_id", "body", "length", "item_id", "item").distinct().join(sent(sizes), "item"))
    pair = ["doc_id", "body", "length", "item_id", "item", "n", "item_total"]
    own = hits.select("doc_id", "body", "pos", "shingle", "weight")
    at = F.transform("at", lambda p, i: F.struct(p.alias("pos"), F.get("at", (i - F.col("copies")).cast("int")).alias("full")))
    shared = (near.join(own, ["doc_id", "body"]).join(sent(items.select("item", "shingle", "copies")), ["item", "shingle"])
              .groupBy(*pair, "shingle", "weight", "copies").agg(F.sort_array(F.collect_list("pos")).alias("at"))
              .select(*pair, "weight", F.explode(at).alias("o")).select(*pair, "weight", "o.pos", "o.full"))
    reach = F.greatest(F.col("pos") - F.col("n") + 1, F.lit(0))
    event = lambda at, common, light, start: F.struct(at.cast("long").alias("at"), common.cast("long").alias("common"), light.cast("long").alias("light"), F.lit(start).alias("is_start"))
    none = F.lit(0)
    meets = shared.select(*pair, F.explode(F.array(
        event(F.greatest(reach, F.coalesce(F.col("full") + 1, none)), F.col("weight"), none, 0), event(F.col("pos") + 1, -F.col("weight"), none, 0),
        event(F.col("pos"), none, none, 1))).alias("e"))
    # known shingles that weigh 1, so that the window's total is 2 for each of its shingles less these
    lights = near.join(own.where("weight = 1"), ["doc_id", "body"]).select(*pair, F.explode(F.array(
        event(reach, none, F.lit(1), 0), event(F.col("pos") + 1, none, F.lit(-1), 0))).alias("e"))
    summed = meets.unionByName(lights).groupBy(*pair, F.col("e.at").alias("start")).agg(
        F.sum("e.common").alias("common"), F.sum("e.light").alias("light"), F.max("e.is_start").alias("is_start"))
    upto = Window.partitionBy(*pair).orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = 2 * F.least(F.col("n"), F.col("length") - F.col("start")) - F.col("light")
    return (summed.select(*pair, "start", "is_start", F.sum("common").over(upto).alias("common"), F.sum("light").over(upto).alias("light"))
            .where("is_start = 1").select("doc_id", "item_id", "start", "common", (total + F.col("item_total") - F.col("common")).alias("union")))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start, similarity): documents with an item-sized window whose weighted
    similarity to the item is ``similarity`` per cent or more; the best
    window of each pair, the first among equals (start counts words).

    Null and empty texts or items match nothing; a null doc_id or item_id is left
    out; repeated documents or items give one row a pair; a text of fewer than five
    words matches an item of the same words only; empty tables give no rows; other
    columns are ignored."""
    parts = cut(item_parts(benchmark.select("item_id", "text")))
    small = parts.count() <= BROADCAST_ROWS
    sent = F.broadcast if small else lambda df: df
    rows = shingled(docs.select("doc_id", "text").where("doc_id is not null and text is not null"), "doc_id")
    known = parts.select("shingle", "weight").distinct()
    hits = rows.join(sent(known), "shingle").withColumn("span", F.floor(F.col("pos") / _SPAN)).select(
        "doc_id", "body", F.col("size").alias("length"), "pos", "span", "shingle", "weight").distinct()
    sizes = parts.select("shingle", F.col("size").cast("int").alias("size")).distinct()
    starts = hits.join(sent(sizes), "shingle").select("doc_id", "body", "length", F.col("pos").alias("start"), "size").distinct()
    last = F.col("start") + F.col("size") - 1
    spans = starts.withColumn("span", F.explode(F.sequence(F.floor(F.col("start") / _SPAN), F.floor(last / _SPAN))))
    inside = (spans.join(hits.select("doc_id", "body", "span", "pos", "shingle", "weight"), ["doc_id", "body", "span"])
              .where("pos >= start and pos < start + size").drop("span"))
    window = ["doc_id", "body", "start", "size"]
    prints = (inside.groupBy(*window, "length").agg(F.sum("weight").alias("total"), F.count("*").alias("known"), *_lane_sums(F.col("shingle"), F.col("weight")))
              .select(*window, "length", "total", "known", _fingerprint().alias("print")))
    own = (parts.withColumn("weight", F.col("weight") * F.col("copies")).groupBy("item_id", "item", "part", "cut", "size").agg(
        F.sum("weight").alias("total"), *_lane_sums(F.col("shingle"), F.col("weight")))
        .select("item_id", "item", "part", "cut", "size", F.col("total").alias("part_total"), _fingerprint().alias("part_print")))
    looked_up = own.withColumn("b", F.explode(_blocks("part_print"))).select("item_id", "item", "part", "cut", "size", "part_total", "part_print", "b.block", "b.bits")
    found = (prints.withColumn("b", F.explode(_blocks("print"))).select(*window, "length", "total", "known", "print", "b.block", "b.bits")
             .join(sent(looked_up), ["size", "block", "bits"])
             .where(F.bit_count(F.col("print").bitwiseXOR(F.col("part_print"))) <= RADIUS)
             .select(*window, "length", "total", "known", "item_id", "item", "part", "cut", "part_total").distinct())
    long = not parts.where("cut").isEmpty()
    found = cut(found) if long else found
    held = inside.groupBy(*window, "shingle", "weight").agg(F.count("*").alias("n"))
    common = (found.where("not cut").join(held, window).join(sent(parts.select("part", "shingle", "copies")), ["part", "shingle"])
              .groupBy(*window, "length", "total", "known", "item_id", "part", "part_total")
              .agg(F.sum(F.least("n", "copies") * F.col("weight")).alias("common")))
    unknown = 2 * (F.least(F.col("size").cast("long"), F.col("length") - F.col("start")) - F.col("known"))
    union = F.col("total") + unknown + F.col("part_total") - F.col("common")
    windows = common.select("doc_id", "item_id", "start", "common", union.alias("union"))
    if long:
        windows = windows.unionByName(_whole_items(found, hits, parts, sent))
    return (windows.where(100 * F.col("common") >= similarity * F.col("union"))
            .select("doc_id", "item_id", "start", (F.col("common") / F.col("union")).alias("similarity"))
            .groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
            .select("doc_id", "item_id", (-F.col("best.back")).cast("long").alias("start"), F.col("best.similarity").alias("similarity")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, all columns."""
    return without(docs, contaminated(docs, benchmark).select("doc_id").distinct())
