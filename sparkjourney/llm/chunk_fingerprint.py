"""Document fingerprints from content-defined chunks.

A gear hash over the last 32 bytes marks boundaries wherever its top bits are
zero; before the normal chunk size more bits are asked for than after it, which
keeps sizes near the normal one.  Boundaries depend on nearby bytes only, so an
insertion moves chunks without changing them.  A fingerprint is the set of
distinct chunk digests, each weighted by its chunk's length; the likeness of a
to b is the share of a's weight whose digests b contains."""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sparkjourney.llm.common import texts

SMALLEST, NORMAL, LARGEST = 16, 64, 256
STRICT_BITS, LOOSE_BITS = 7, 5
#: Ranges of doc_id for each shuffle partition.
RANGES = 4
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWER = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64


def _mixed(n: int) -> np.ndarray:
    """n well-mixed 64-bit numbers from a fixed rule."""
    z = np.arange(1, n + 1, dtype=np.uint64) * _STEP
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Chunker:
    def __init__(self):
        table = _mixed(512)
        self.gear, self.value = (table[:256] >> np.uint64(32)).astype(np.uint32), table[256:]
        self.forth = self.back = np.ones(1, np.uint64)

    def _powers(self, n: int):
        if len(self.forth) <= n:
            size = max(2 * n, 1 << 14)
            grow = lambda p: np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, p, np.uint64))))
            self.forth, self.back = grow(_POWER), grow(pow(_POWER, -1, 1 << 64))
        return self.forth, self.back

    def boundaries(self, data: np.ndarray) -> list[int]:
        """Ends of the chunks."""
        n = len(data)
        h = self.gear[data]
        for width in (1, 2, 4, 8, 16):  # doubles the window the hash covers
            h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        loose = np.flatnonzero(h >> np.uint32(32 - LOOSE_BITS) == 0)
        strict = (loose[h[loose] >> np.uint32(32 - STRICT_BITS) == 0] + 1).tolist()
        loose = (loose + 1).tolist()
        ends, start = [], 0
        while n - start > SMALLEST:
            i = bisect_left(strict, start + SMALLEST)
            if i < len(strict) and strict[i] <= start + NORMAL:
                start = strict[i]
            else:
                i = bisect_left(loose, start + NORMAL)
                start = loose[i] if i < len(loose) and loose[i] <= start + LARGEST else min(n, start + LARGEST)
            ends.append(start)
        if start < n:
            ends.append(n)
        return ends

    def fingerprint(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct 48-bit digests and their chunks' lengths."""
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        if not len(data):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        ends = np.array(self.boundaries(data))
        starts = np.concatenate(([0], ends[:-1]))
        forth, back = self._powers(len(data))
        upto = np.concatenate(([np.uint64(0)], np.cumsum(self.value[data] * forth[:len(data)])))
        d = (upto[ends] - upto[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _STEP
        d = (d ^ (d >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        digests, first = np.unique(d >> np.uint64(16), return_index=True)
        return digests, (ends - starts)[first]


def written(print_: tuple[np.ndarray, np.ndarray]) -> str:
    """14 hexadecimal digits a chunk: the digest and the length less one."""
    digests, lengths = print_
    packed = (digests << np.uint64(8)) | (lengths - 1).astype(np.uint64)
    return packed.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 1:].tobytes().hex()


def likeness(a, b) -> float:
    """Share of a's weight whose digests are in b; 1 if both are empty."""
    weight = int(a[1].sum())
    if not weight:
        return float(not len(b[0]))
    if not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    return float(a[1][b[0][at] == a[0]].sum() / weight)


def with_next(docs: DataFrame) -> DataFrame:
    """Documents dealt out by ranges of descending doc_id, so that each one's next
    document is in its range: (range, guest, order, doc_id, text).  The first
    document of a range is also a guest at the end of the range before it (the
    very first in the last).  The cut points are quantiles of doc_id; an id that holds
    more rows than twice a range's even share, as a null one may, is cut further by the
    hashes of its texts, which order equal ids.  The driver holds a few numbers a range.
    Null ids come last."""
    spark = docs.sparkSession
    docs = texts(docs).withColumn("order", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))).withColumn("h", F.xxhash64("text"))
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = np.unique(np.array(docs.where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n), np.float64)).astype(np.int64)

    @F.pandas_udf("int")
    def cut_of(order: pd.Series) -> pd.Series:
        return pd.Series((len(cuts) - np.searchsorted(cuts, order.to_numpy(), "left")).astype(np.int32))

    # a range can be over-full only by one id's rows; those ids are few, as each holds more than a range
    docs = docs.withColumn("cut", cut_of("order"))
    sizes = {r["cut"]: r["count"] for r in docs.groupBy("cut").count().collect()}
    even = max(1, sum(sizes.values()) // n)
    full = [c for c, k in sizes.items() if k > 2 * even]
    heavy = docs.where(F.col("cut").isin(full)).groupBy("order").count().where(F.col("count") > 2 * even).collect() if full else []
    pieces = {r["order"]: min(n, -(-r["count"] // even)) for r in heavy}
    ids = np.array(sorted(pieces), np.int64)
    more = np.array([pieces[i] for i in ids.tolist()], np.int64)
    above = np.concatenate([np.cumsum(more[::-1])[::-1], [0]])  # pieces of the ids from each on

    @F.pandas_udf("int")
    def range_of(cut: pd.Series, order: pd.Series, h: pd.Series) -> pd.Series:
        order = order.to_numpy()
        at = np.searchsorted(ids, order, "left")
        own = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == order) if len(ids) else np.zeros(len(order), bool)
        extra = above[at + own]  # every piece of an id above comes first
        if own.any():
            share = (h.to_numpy()[own].astype(float) + 2.0**63) / 2.0**64
            extra = extra.copy()
            extra[own] += np.minimum((share * more[at[own]]).astype(np.int64), more[at[own]] - 1)
        return pd.Series((cut.to_numpy() + extra).astype(np.int32))

    ranged = docs.withColumn("range", range_of("cut", "order", "h")).drop("cut")
    first = F.max(F.struct("order", F.bitwise_not("h").alias("last")))  # the highest id, of its texts the lowest hash
    firsts = sorted((r["range"], *r["first"]) for r in ranged.groupBy("range").agg(first.alias("first")).collect())
    hosts = spark.createDataFrame([(firsts[i - 1][0], order, ~last) for i, (_, order, last) in enumerate(firsts)], "_range int, _order long, _h long")
    guest = ranged.join(F.broadcast(hosts), (F.col("order") == F.col("_order")) & (F.col("h") == F.col("_h")))  # one row a range
    guest = guest.withColumn("range", F.col("_range")).drop("_range", "_order", "_h")
    both = ranged.withColumn("guest", F.lit(0)).unionByName(guest.withColumn("guest", F.lit(1)))
    return both.repartition("range").sortWithinPartitions("range", "guest", F.desc("order"), "h", "text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) per row.  The edited text has the last third (rounded
    down) of the code points replaced by as many of the next document's first ones
    (or all of them), by descending doc_id, after the last one the first.

    Null text counts as empty and has an empty fingerprint, which is like (1.0)
    an empty one only.  Repeated rows are their own next documents; null ids come last;
    an empty table gives no rows; other columns are ignored."""
    def run(batches):
        chunker, held = Chunker(), None

        def row(own, following):
            text, after = own[2], following[2]
            n = len(text)
            edited = text[:n - n // 3] + after[:n // 3]
            changed = chunker.fingerprint(edited)
            return (own[3], n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), written(own[4]), written(changed),
                    likeness(own[4], changed), likeness(own[4], following[4]))

        for b in batches:
            out = []
            for range_, guest, text, doc_id in zip(b["range"], b["guest"], b["text"], b["doc_id"]):
                now = (range_, guest, text, None if pd.isna(doc_id) else int(doc_id), chunker.fingerprint(text))
                if held is not None and held[0] == range_ and not held[1]:
                    out.append(row(held, now))
                held = now
            if out:
                yield pd.DataFrame(out, columns=names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return with_next(docs).mapInPandas(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                            "edited_fingerprint string, near_edited double, near_next double")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) per row; nulls as in ``edited_fingerprints``."""
    def run(batches):
        chunker = Chunker()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fingerprint": [written(chunker.fingerprint(t)) for t in b["text"]]})

    return texts(docs).mapInPandas(run, "doc_id long, fingerprint string")
