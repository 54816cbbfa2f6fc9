"""Exact Jaccard self join of documents over word 5-shingles, in a metric space.

Jaccard distance is a metric, and a link is a distance of at most 0.2.  With n
shingles on either side, a link needs 9 * common >= 4 * (n_x + n_y), so at most
(n_x + n_y) / 9 shingles may differ.

1. Equal sets collapse into one class; only class representatives go on.
2. Every set is ordered by one global order (shingles that are frequent in a
   hash sample of documents last, then by hash).  Linked sets share one of
   their first n // 5 + 1 shingles, so the documents that share such a shingle
   form the first regions.
3. Pivots: in each region the member with the smallest hash is the pivot, and
   every member's distance to it is computed exactly.  Members within 0.2 are
   linked, and whatever is already connected needs no more tests.
4. A region of at most ``LEAF`` unresolved members joins directly.  Larger ones are
   cut into size bands; those with the same pivot form its Voronoi region, with
   every boundary document replicated into each region whose pivot it met, and join
   recursively around a centre c: the shingles that most of a few members hold.
   Let E = x ^ c, i = |x & c| and g = n / 9 - |E|.  By the triangle inequality x
   and y are linked if g_x + g_y >= 0, so all such members are linked to the one
   with the largest g.  Any other linked pair shares elements outside c or of E:
   if i < 0.8 n for both, one lies among the first n // 5 + 1 of each one's
   shingles outside c; otherwise both have i >= 0.48 n (near) and one lies in a
   prefix of each E (``_window``).  These are the keys of the next, smaller regions:
   what the region had in common is in c and gone.

No step forms all pairs of a large group, no candidate is capped, and links
and components stay in Spark.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from sparkjourney.llm.common import Memo, cut, only, texts, tidy, without
from sparkjourney.llm.components import components

WORDS = 5
LEAF = 256
#: About so many members give a region's centre.
SAMPLED = 48
#: One document in so many is sampled to learn which shingles are frequent; this
#: only orders shingles (any order is exact) and is a fixed share of the input.
SAMPLE = 16
SAMPLE_COUNT = 3
#: At most so many frequent shingles are kept, in a bit map of at most 4 MB.
FREQUENT = 1 << 20

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
                dtype=np.uint64)


def shingle_hashes(text: str, memo) -> np.ndarray:
    """Sorted distinct 62-bit hashes of the word 5-shingles; the whole sequence
    when there are fewer words.  Only A-Z is lower-cased (as bytes do it), and
    words end at the ASCII white space that ``bytes.split`` knows."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    k = min(WORDS, len(words))
    n = len(words) - k + 1
    s = np.full(n, k, np.uint64)
    for i in range(k):
        s += h[i:i + n] * _MIX[i]
    s ^= s >> np.uint64(33)
    s *= np.uint64(0xFF51AFD7ED558CCD)
    s ^= s >> np.uint64(29)
    return np.unique((s >> np.uint64(2)).view(np.int64))


def _ordered(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The set as sorted numbers whose order is the global one: bit 62 is set on frequent shingles."""
    if not len(bits) or not len(hashes):
        return hashes
    often = (bits[(hashes >> 3) & (len(bits) - 1)] >> (hashes & 7)) & 1
    return np.sort(hashes | (often.astype(np.int64) << 62))


def _word_memo():
    return Memo(xxhash.xxh64_intdigest)


def _frequent(docs: DataFrame):
    """Bit map of the shingles that are frequent in a hash sample of the documents."""
    def hashes(batches):
        memo = _word_memo()
        for b in batches:
            sets = [shingle_hashes(t, memo) for t in b["text"]]
            yield pd.DataFrame({"h": np.concatenate(sets) if sets else np.empty(0, np.int64)})

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    found = (sample.mapInPandas(tidy(hashes), "h long").groupBy("h").agg(F.count("*").alias("n"))
             .where(F.col("n") >= SAMPLE_COUNT).orderBy(F.desc("n"), "h").limit(FREQUENT))
    often = found.select("h").toPandas()["h"].to_numpy(np.int64)
    size = 1 << max(10, int(np.ceil(np.log2(len(often) * 16 + 1))) - 3) if len(often) else 0
    bits = np.zeros(size, np.uint8)
    if len(often):
        np.bitwise_or.at(bits, (often >> 3) & (size - 1), (1 << (often & 7)).astype(np.uint8))
    return bits


def _signatures(docs: DataFrame, bits) -> DataFrame:
    def sign(batches):
        memo, often = _word_memo(), bits.value
        for b in batches:
            n, digest, keys = [], [], []
            for t in b["text"]:
                s = _ordered(shingle_hashes(t, memo), often)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                keys.append(s[:len(s) // WORDS + 1])
            yield pd.DataFrame({"doc_id": b["doc_id"], "n": n, "digest": digest, "keys": keys})

    return docs.mapInPandas(tidy(sign), "doc_id long, n long, digest binary, keys array<long>")


def _pruned(pairs: DataFrame, sig: DataFrame) -> DataFrame:
    """Pairs that their first shingles cannot rule out.  Up to the smaller of the
    two last keys both prefixes are complete, so their differences there count
    towards the (n_x + n_y) / 9 that a link allows.  Exact: drops no link."""
    def keep(batches):
        for b in batches:
            ok = np.zeros(len(b), bool)
            for i, (nx, ny, x, y) in enumerate(zip(b["nx"], b["ny"], b["kx"], b["ky"])):
                end = min(x[-1], y[-1])
                x, y = x[:np.searchsorted(x, end, "right")], y[:np.searchsorted(y, end, "right")]
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 9 * (len(x) + len(y) - 2 * common) <= nx + ny
            yield b.loc[ok, ["a", "b"]]

    sig = only(sig, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    x = sig.select(F.col("doc_id").alias("a"), F.col("n").alias("nx"), F.col("keys").alias("kx"))
    y = sig.select(F.col("doc_id").alias("b"), F.col("n").alias("ny"), F.col("keys").alias("ky"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "nx", "ny", "kx", "ky").mapInPandas(tidy(keep), "a long, b long")


def _window(own: int, n: int) -> int:
    """How many of the ``own`` elements of E, in order, must be keys.  A linked pair
    with differences E and F shares at least t = (|E| + |F| - D) / 2 of them, with
    D = (n_x + n_y) / 9 <= n_x / 4; |F| >= |E| - D by the triangle inequality, so
    t >= |E| - n_x // 4; and t > 0, as the pair is not linked through the centre alone."""
    return own - max(1, own - n // 4) + 1 if own else 0


def _next_keys(x: np.ndarray, centre: np.ndarray):
    """|E|, and the keys of a member in its region: shingles outside the centre
    unless the member holds 0.8 of its own in it, elements of E if it is near."""
    n, outside, apart = len(x), x[:0], x[:0]
    common = len(np.intersect1d(x, centre, assume_unique=True))
    own = n + len(centre) - 2 * common
    if 5 * common < 4 * n:
        outside = np.setdiff1d(x, centre, assume_unique=True)[:n // WORDS + 1]
    if 25 * common >= 12 * n:
        apart = np.setxor1d(x, centre, assume_unique=True)[:_window(own, n)]
    return own, outside, apart


def _sets(docs: DataFrame, ids: DataFrame, bits) -> DataFrame:
    """(doc_id, s): whole ordered sets of the documents among ``ids``, remade from their texts."""
    def remake(batches):
        memo, often = _word_memo(), bits.value
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "s": [_ordered(shingle_hashes(t, memo), often) for t in b["text"]]})

    return cut(only(docs, ids).mapInPandas(tidy(remake), "doc_id long, s array<long>"))


def _verified(pairs: DataFrame, docs: DataFrame, bits) -> DataFrame:
    """The pairs (a, b) that are linked: exact test on whole sets."""
    def test(batches):
        for b in batches:
            linked = np.zeros(len(b), bool)
            for i, (x, y) in enumerate(zip(b["sx"], b["sy"])):
                linked[i] = 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y))
            yield b.loc[linked, ["a", "b"]]

    sets = _sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), bits)
    return (pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sx")), "a")
            .join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sy")), "b").select("a", "b", "sx", "sy")
            .mapInPandas(tidy(test), "a long, b long"))


def _around_centres(region: DataFrame, docs: DataFrame, bits) -> tuple[DataFrame, DataFrame]:
    """Links, and the next regions' rows (rid, key, doc_id, n, own, pos), of regions (rid, doc_id)."""
    sets = _sets(docs, region.select("doc_id"), bits)
    few = region.join(region.groupBy("rid").agg(F.count("*").alias("members")), "rid").where(
        F.pmod(F.xxhash64("doc_id", "rid"), F.col("members")) < SAMPLED)

    def centre(group: pd.DataFrame) -> pd.DataFrame:
        found, times = np.unique(np.concatenate(group["s"].tolist()), return_counts=True)
        return pd.DataFrame({"rid": group["rid"].iloc[:1], "centre": [found[2 * times > len(group)]]})

    def place(batches):
        for b in batches:
            made = [_next_keys(x, c if c is not None else x[:0]) for x, c in zip(b["s"], b["centre"])]
            yield pd.DataFrame({"rid": b["rid"], "doc_id": b["doc_id"], "n": [len(x) for x in b["s"]], "own": [m[0] for m in made],
                                "outside": [m[1] for m in made], "apart": [m[2] for m in made]})

    # a region's centre needs about SAMPLED sets, whatever its size; any set is an exact centre
    centres = few.join(sets, "doc_id").groupBy("rid").applyInPandas(centre, "rid long, centre array<long>")
    placed = cut(region.join(sets, "doc_id").join(centres, "rid", "left").select("rid", "doc_id", "s", "centre")
                 .mapInPandas(tidy(place), "rid long, doc_id long, n long, own long, outside array<long>, apart array<long>")
                 .withColumn("g", F.col("n") - 9 * F.col("own")))
    best = placed.groupBy("rid").agg(F.max(F.struct("g", "doc_id")).alias("best")).select("rid", F.col("best.g").alias("most"), F.col("best.doc_id").alias("hub"))
    known = placed.join(best, "rid").withColumn("linked", F.col("g") + F.col("most") >= 0)
    links = known.where("linked and doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
    # of a linked member, E shares more than (most - g) / 18 elements with any that is not
    spare = F.when(F.col("linked"), F.greatest(F.col("own") - F.floor((F.col("most") - F.col("g")) / 18), F.lit(0))).otherwise(F.col("own"))
    rest = known.where("not linked and size(apart) > 0").select("rid").distinct()
    outside = known.select(F.xxhash64("rid", F.lit("outside")).alias("rid"), "doc_id", "n", F.col("n").alias("own"), F.posexplode("outside").alias("pos", "key"))
    apart = known.join(rest, "rid", "left_semi").select(
        F.xxhash64("rid", F.lit("apart")).alias("rid"), "doc_id", "n", "own",
        F.posexplode(F.slice("apart", F.lit(1), F.least(F.size("apart"), spare.cast("int")))).alias("pos", "key"))
    rows = outside.unionByName(apart)
    shared = rows.groupBy("rid", "key").agg(F.count("*").alias("size")).where("size > 1").drop("size")
    return links, rows.join(shared, ["rid", "key"])


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    comp = components(links).withColumnRenamed("node", "doc_id")
    return rows.join(comp, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def _pivots(rows: DataFrame) -> DataFrame:
    """Per region (rid, key): its size, whether it holds unconnected members, and its pivot."""
    return rows.groupBy("rid", "key").agg(
        F.count("*").alias("size"), (F.min("component") < F.max("component")).alias("open"),
        F.min(F.struct(F.xxhash64("rid", "doc_id").alias("h"), "doc_id", "n"))["doc_id"].alias("pivot"),
        F.min(F.struct(F.xxhash64("rid", "doc_id").alias("h"), "doc_id", "n"))["n"].alias("pivot_n"))


def _direct(leaf: DataFrame) -> DataFrame:
    """Unconnected pairs (a, b) that meet in a leaf region early enough to be linked.

    ``pos`` is a key's place in its member's ordered list: the set itself, what it has outside
    the centre (``own`` = n for both), or E (``own`` = |E|).  All before the first shared key of
    a pair is in one list only, which a link allows for (own_x - own_y + (n_x + n_y) / 9) / 2
    elements of x's list.  The lists are cut from the front, so a pair that shares any key
    shares its first one.  Exact: drops no link."""
    side = lambda doc, s: leaf.select("rid", "key", F.col("doc_id").alias(doc), *[F.col(c).alias(c + s) for c in ("n", "component", "pos", "own")])
    early = lambda x, y: 18 * F.col("pos" + x) <= 9 * (F.col("own" + x) - F.col("own" + y)) + F.col("nx") + F.col("ny")
    met = side("a", "x").join(side("b", "y"), ["rid", "key"]).where("a < b and componentx <> componenty")
    return met.where(_sizes_fit("nx", "ny")).where(early("x", "y")).where(early("y", "x")).select("a", "b").distinct()


def _sizes_fit(x: str, y: str):
    return (5 * F.least(x, y) >= 4 * F.greatest(x, y))


def link_table(docs: DataFrame, sig: DataFrame, bits) -> DataFrame:
    """Links (a, b) between representatives that connect what the join connects:
    every linked pair is listed or its two documents are connected by listed links."""
    keys = sig.select("doc_id", "n", F.posexplode("keys").alias("pos", "key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    rows = cut(keys.join(shared, "key").select(F.lit(0).cast("long").alias("rid"), "key", "doc_id", "n", F.col("n").alias("own"), "pos")
               .withColumn("component", F.col("doc_id")))
    # first pivots: one star a region, pruned by the first shingles before whole sets move
    star = (rows.join(_pivots(rows), ["rid", "key"]).where("doc_id <> pivot").where(_sizes_fit("n", "pivot_n"))
            .select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct())
    links = cut(_verified(cut(_pruned(star, sig)), docs, bits))
    while True:
        rows = _labelled(rows.drop("component"), links)
        stat = cut(_pivots(rows).where("open"))
        if stat.isEmpty():
            return links
        rows = cut(rows.join(stat, ["rid", "key"]))
        leaf, large = rows.where(F.col("size") <= LEAF), rows.where(F.col("size") > LEAF)
        direct = _direct(leaf)
        links = cut(links.unionByName(_verified(cut(_pruned(direct, sig)), docs, bits)))
        if large.isEmpty():
            return links
        # a size band and the next one hold every pair whose sizes allow a link
        band = F.floor(F.log("n") / F.log(F.lit(1.26)))
        banded = cut(large.drop("open", "pivot", "pivot_n", "size", "own", "pos").withColumn("band", F.explode(F.array(band, band + 1)))
                     .withColumn("key", F.xxhash64("key", "band")).drop("band"))
        # first regions with the same pivot are one; a later region stays by itself, as what all its
        # members share (or lack) is in (or out of) its centre and cannot be a key again: the recursion ends
        region = cut(banded.join(_pivots(banded).where("open"), ["rid", "key"])
                     .select(F.when(F.col("rid") == 0, F.xxhash64("rid", "pivot")).otherwise(F.xxhash64("rid", "key")).alias("rid"), "doc_id")
                     .distinct())
        more, rows = _around_centres(region, docs, bits)
        links = cut(links.unionByName(more))
        rows = cut(rows)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``.

    Null text counts as empty.  A document without words has no shingles and
    is linked with nothing: its component is its own doc_id.  Exact copies share a class;
    rows that repeat a doc_id count as one document (linked if any of its texts is).
    A row without doc_id is linked with nothing and has a null component.
    An empty table gives no rows.  Columns other than doc_id and text are ignored."""
    spark = docs.sparkSession
    docs = texts(docs)
    bits = spark.sparkContext.broadcast(_frequent(docs))
    sig = cut(_signatures(docs, bits))
    classes = cut(sig.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node")))
    reps = cut(sig.join(classes, "digest").where("doc_id = node").select("doc_id", "n", "keys"))
    sig = cut(sig.select("doc_id", "n", "digest"))
    links = link_table(docs, reps, bits)
    comp = components(links)
    named = classes.join(comp, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    return (sig.join(named, "digest", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id")).alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` less those linked, directly or not, with a smaller doc_id;
    of rows that repeat a doc_id one stays; all columns.  Rows without words or doc_id stay."""
    comp = jaccard_components(docs)
    rest = without(docs, comp.where("doc_id <> component_id").select("doc_id").distinct())
    again = cut(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return rest
    return without(rest, again).unionByName(rest.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
