"""Ranked lexical search by one automaton over the texts.

The terms of all items, each between two guards, form an Aho-Corasick automaton that
is broadcast.  A text is folded byte by byte (every separator becomes the guard), so a
match is a whole term and the term frequencies come straight from the text, without
an index of the documents.  The first scan adds up the corpus statistics, the second
scores: a match leads to the items that hold its term.  A task keeps each item's best."""

from __future__ import annotations

import itertools
import math

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sparkjourney.llm.common import cut, shipped

GUARD = b" "
#: Term bytes are ASCII letters and digits and all bytes of other characters; A-Z are folded, other bytes become the guard.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else GUARD[0] for b in range(256))
#: Items are scored in blocks of at most so many bytes of text (or one item); a block's automaton is what is broadcast.
BLOCK_BYTES = 1 << 23
#: Bytes of text and cells of the (document, item) table worked on at once in a task.
AT_ONCE, CELLS = 1 << 22, 1 << 21
#: An item's best of all tasks are first merged in so many parts.
PARTS = 64
#: Rows of the first scan that stand for the number of documents and of terms.
DOCUMENTS, TERMS = -1, -2


def folded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(FOLD)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Block:
    """The automaton of some items' terms; ``item[first[t]:first[t + 1]]`` hold term t, ``times`` times each."""

    def __init__(self, texts: list[str]):
        numbers: dict[bytes, int] = {}
        held: list[list[tuple[int, int]]] = []
        for i, text in enumerate(texts):
            words, counts = np.unique(np.array(folded(text).split() or [b""], object), return_counts=True)
            for w, n in zip(words, counts.tolist()):
                if w:
                    t = numbers.setdefault(w, len(held))
                    if t == len(held):
                        held.append([])
                    held[t].append((i, n))
        self.items, self.terms = len(texts), len(held)
        self.first = np.cumsum([0, *map(len, held)])
        self.item, self.times = np.array([x for of in held for x in of], "i8").reshape(-1, 2).T
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for w, t in numbers.items():
            self.automaton.add_word((GUARD + w + GUARD).decode("latin-1"), t)
        if held:
            self.automaton.make_automaton()

    def scan(self, texts: list[str]):
        """(n, document, term, tf): the number of terms of each text, and the frequencies of the block's."""
        own = [folded(t) for t in texts]
        line = GUARD + GUARD.join(own) + GUARD
        ends = np.cumsum([len(t) + 1 for t in own])
        guard = np.frombuffer(line, "u1") == GUARD[0]
        begun = np.concatenate([[0], np.cumsum(guard[:-1] & ~guard[1:])])
        n = np.diff(begun[np.concatenate([[0], ends])])
        if not self.terms:
            return n, *np.zeros((3, 0), "i8")
        found = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(line.decode("latin-1"))), "i8").reshape(-1, 2)
        keys, tf = np.unique(np.searchsorted(ends, found[:, 0]) * self.terms + found[:, 1], return_counts=True)
        return n, *np.divmod(keys, self.terms), tf


def pieces(batches, cells: int):
    """(doc_ids, texts) of some rows at a time: few bytes, and few enough rows for ``cells`` cells each."""
    for b in batches:
        step = max(1, min(CELLS // max(1, cells), AT_ONCE * b.num_rows // max(1, b.column(1).nbytes)))
        for k in range(0, b.num_rows, step):
            yield b.column(0).slice(k, step).to_pylist(), b.column(1).slice(k, step).to_pylist()


def _statistics(docs: DataFrame, block) -> dict[int, int]:
    """Documents, terms, and df of every term of the block: bounded by the block."""
    def run(batches):
        own = block()
        df, n_docs, n_terms = np.zeros(own.terms, "i8"), 0, 0
        for _, texts in pieces(batches, 1):
            n, _, term, _ = own.scan(texts)
            df += np.bincount(term, minlength=own.terms)
            n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[DOCUMENTS, TERMS], some])), pa.array(np.concatenate([[n_docs, n_terms], df[some]]))], names=["term", "n"])

    return dict(docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).toPandas().itertuples(index=False, name=None))


class Best:
    """Every item's ``top`` best of the documents seen: highest score, then smallest doc_id, nulls last."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items, "i8")
        self.rows = np.zeros((4, 0), "i8")  # item, -score, null, doc_id

    def add(self, ids: list, scores: np.ndarray):
        doc, item = np.nonzero(scores >= self.least)
        null = np.array([i is None for i in ids], "i8")
        ids = np.array([i or 0 for i in ids], "i8")
        rows = np.concatenate([self.rows, np.stack([item, -scores[doc, item], null[doc], ids[doc]])], 1)
        rows = rows[:, np.lexsort(rows[::-1])]
        begin = np.searchsorted(rows[0], np.arange(len(self.least) + 1))
        place = np.arange(rows.shape[1]) - begin[rows[0]]
        self.rows = rows[:, place < self.top]
        full = np.flatnonzero(np.diff(begin) >= self.top)
        self.least[full] = -rows[1, begin[full] + self.top - 1]


def _scores(docs: DataFrame, block, numbers, documents: int, terms: int, top: int) -> DataFrame:
    """(number, doc_id, score): each task's best of every item of the block."""
    def run(batches):
        own, (weights, numbered) = block(), numbers()
        best = Best(own.items, top)
        for ids, texts in pieces(batches, own.items):
            n, doc, term, tf = own.scan(texts)
            m = np.array([75 + 25 * x * documents // terms for x in n.tolist()], "i8")
            part = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
            each = own.first[term + 1] - own.first[term]
            at = np.repeat(own.first[term] - np.cumsum(each) + each, each) + np.arange(each.sum())
            scores = np.zeros(len(ids) * own.items, "i8")
            np.add.at(scores, np.repeat(doc, each) * own.items + own.item[at], np.repeat(part, each) * own.times[at])
            best.add(ids, scores.reshape(-1, own.items))
        item, score, null, doc_id = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(numbered[item]), pa.array(doc_id, mask=null.astype(bool)), pa.array(-score)], names=["number", "doc_id", "score"])

    return docs.mapInArrow(run, "number long, doc_id long, score long")


def blocks(items: DataFrame, most: int = BLOCK_BYTES):
    """Lists of (item_id, text) of at most ``most`` bytes of text, or of one item."""
    held, size = [], 0
    for x in items.toLocalIterator():
        n = len((x.text or "").encode("utf-8", "surrogatepass"))
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append((x.item_id, x.text or ""))
        size += n
    if held:
        yield held


def ranked(docs: DataFrame, items: DataFrame, top: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` best documents with a score above 0.

    A term is a maximal run of characters that are no ASCII character but letters and
    digits; only A-Z are lower-cased.  With N documents that hold terms, L terms in all,
    n of the document, df documents that hold the term and tf of it in the document:
    w = floor(1000 ln((2N+2)/(2df+1))), m = 75 + (25 n N div L), and the score is the sum
    over the item's terms, repeats included, of w * (10^9 tf div (1000 tf + 12 m)).

    Equal scores rank by doc_id, nulls last; rows with equal ids and scores rank in any
    order.  Every row of ``docs`` is a document; a null or empty text has no terms.  Equal
    rows of ``items`` are one item, equal ids with different texts are several, a null
    item_id stays null; an item without terms, and empty tables, give no rows.  Other
    columns are ignored.  Items are scored in blocks, each by two scans of the texts."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    found, number = [], 0
    for held in blocks(items, block_bytes):
        block = Block([t for _, t in held])
        ship = shipped(spark, block)
        seen = _statistics(docs, ship)
        if seen.get(TERMS, 0):
            weights = np.array([weight(seen[DOCUMENTS], seen.get(t, 0)) for t in range(block.terms)], "i8")
            ids = spark.createDataFrame([(number + k, i) for k, (i, _) in enumerate(held)], "number long, item_id long")
            own = shipped(spark, (weights, np.arange(number, number + len(held))))
            scores = _scores(docs, ship, own, seen[DOCUMENTS], seen[TERMS], top)
            found.append(_merged(scores, top).join(F.broadcast(ids), "number"))
            if len(found) > 1:  # later blocks go over the texts anew
                found[-1] = cut(found[-1])
        number += len(held)
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("item_id", "rank", "doc_id", "score")


def _merged(scores: DataFrame, top: int) -> DataFrame:
    """An item's best of all tasks, merged in two steps, so that no task gets all of them."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    parted = scores.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    some = parted.withColumn("rank", F.row_number().over(Window.partitionBy("number", "part").orderBy(*order))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order))).where(F.col("rank") <= top).drop("part")


def ranked_sql(top: int = 20) -> str:
    """The rows of ``ranked`` in DuckDB's SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = rf"unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, text FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark) u),
t AS (SELECT k, {words} AS term FROM d),
b AS (SELECT q, term, count(*) AS times FROM (SELECT q, {words} AS term FROM i) u GROUP BY q, term),
n AS (SELECT k, count(*) AS n FROM t GROUP BY k),
s AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM n),
tf AS (SELECT k, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM b) GROUP BY k, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term),
p AS (SELECT tf.k, tf.term, w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (100 - 25 + ((25 * n.n * s.nn) // s.ll)))) AS part
      FROM tf JOIN w ON w.term = tf.term JOIN n ON n.k = tf.k CROSS JOIN s),
r AS (SELECT b.q, p.k, sum(b.times * p.part)::BIGINT AS score FROM b JOIN p ON p.term = b.term GROUP BY b.q, p.k)
SELECT i.item_id, x.rank::INTEGER AS rank, x.doc_id, x.score FROM (
  SELECT r.q, d.doc_id, r.score, row_number() OVER (PARTITION BY r.q ORDER BY r.score DESC, d.doc_id ASC NULLS LAST) AS rank
  FROM r JOIN d ON d.k = r.k WHERE r.score > 0) x JOIN i ON i.q = x.q WHERE x.rank <= {top}"""
