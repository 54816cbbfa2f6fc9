"""Line deduplication over range-partitioned line hashes.

Every line becomes a row (hash, document, position), without text.  The rows are
partitioned by ranges of all of these and sorted within, so a range streams each
line's occurrences in order of document and position, and a line that stands in a
third of all documents is spread over many ranges.  A stream decides what it sees
whole; only the first and the last line of a range can go on in another one.  Their
counts (at most two lines a range) are put together, and the few occurrences that
waited for them are decided by a broadcast join.  The outcome is one compressed
bitmap a document, made of the positions that go."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from sparkjourney.llm.common import cut

BLANKS = " \t\n\x0b\x0c\r"
#: What the stream says of an occurrence: it goes; it goes if its line is frequent; it goes if its line began in
#: an earlier range; both of these; and, for the first and last line of a range: where it begins and ends there.
GOES, IF_FREQUENT, IF_NOT_FIRST, IF_BOTH, BEGINS, ENDS = range(6)
STREAMED = "part int, kind int, h1 long, h2 long, doc_id long, row long, pos int"
#: Bytes of text that are split at once in a task.
AT_ONCE = 1 << 22


def ascii_lower(text):
    """A-Z in lower case; other letters stay."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def _document(docs: DataFrame) -> DataFrame:
    """The documents with a text that is never null and ``__line_row``, a hash of it."""
    docs = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.withColumn("__line_row", F.xxhash64("text"))


def line_rows(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(h1, h2, doc_id, row, pos) of every line with a key of at least ``min_chars``
    code points; two hashes of 64 bits stand for the key."""
    docs = _document(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    lines = docs.select("doc_id", F.col("__line_row").alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc_id", "row", "pos", F.btrim("line", F.lit(BLANKS)).alias("key")).where(F.char_length("key") >= min_chars)
    keys = keys.withColumn("key", ascii_lower(F.col("key")))
    return keys.select(F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"), "doc_id", "row", "pos")


class Stream:
    """Occurrences in order of (line, document, position), batch by batch.

    Held are the occurrences of one line, while fewer than ``min_docs`` documents
    have been seen to hold it: no more than the lines of so many documents."""

    def __init__(self, part: int, min_docs: int, keep_first: bool):
        self.part, self.min_docs, self.keep_first = part, min_docs, keep_first
        self.last = None       # the last occurrence: (h1, h2, doc, row, pos)
        self.heads = True      # its line is the first of the range
        self.docs = 0          # documents that hold the line, so far
        self.waiting = []      # occurrences of the line not yet decided
        self.first = None      # its first occurrence, as a batch of one row

    def _rows(self, kind: int, rows: pa.RecordBatch) -> pa.RecordBatch:
        n = rows.num_rows
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, self.part, "i4")), pa.array(np.full(n, kind, "i4")), *rows.columns], names=[x.split()[0] for x in STREAMED.split(", ")])

    def _frequent(self, rows: pa.RecordBatch):
        if rows.num_rows:
            yield self._rows(GOES, rows)

    def _go_on(self, rows: pa.RecordBatch, new_docs: int):
        """More occurrences of the line at hand."""
        was = self.docs
        self.docs += new_docs
        if self.docs < self.min_docs:
            self.waiting.append(rows)
            return
        if was < self.min_docs:  # just now frequent
            if self.keep_first and self.heads:
                yield self._rows(IF_NOT_FIRST, self.first)
            for held in self.waiting:
                yield from self._frequent(held)
            self.waiting = []
        yield from self._frequent(rows)

    def _begin(self, rows: pa.RecordBatch, new_docs: int):
        self.docs, self.waiting, self.first = 0, [], rows.slice(0, 1)
        yield from self._go_on(rows.slice(1) if self.keep_first else rows, new_docs)

    def _edge(self, last_row: pa.RecordBatch):
        """The line at hand is the first or last of the range: others may go on with it."""
        begins = self._rows(BEGINS, self.first)
        yield begins.set_column(begins.schema.get_field_index("pos"), "pos", pa.array([min(self.docs, 2**31 - 1)], pa.int32()))
        yield self._rows(ENDS, last_row)
        if self.docs < self.min_docs:
            if self.keep_first and self.heads:
                yield self._rows(IF_BOTH, self.first)
            for held in self.waiting:
                if held.num_rows:
                    yield self._rows(IF_FREQUENT, held)

    def read(self, batch: pa.RecordBatch):
        names = ["h1", "h2", "doc_id", "row", "pos"]
        columns = [pc.fill_null(batch.column(n), -2**63).to_numpy() if n == "doc_id" else batch.column(n).to_numpy() for n in names]

        def differs(k):
            c = columns[k]
            before = np.empty(len(c), bool)
            before[1:] = c[1:] != c[:-1]
            before[0] = self.last is None or c[0] != self.last[k]
            return before

        new_key = differs(0) | differs(1)
        new_doc = new_key | differs(2) | differs(3)
        once = new_doc | differs(4)
        if not once.all():  # repeated rows count once
            batch = batch.filter(pa.array(once))
            new_key, new_doc = new_key[once], new_doc[once]
        previous, self.last = self.last, tuple(c[-1] for c in columns)
        if not batch.num_rows:
            return
        starts = np.flatnonzero(new_key)
        head = starts[0] if len(starts) else len(new_key)
        if head:
            yield from self._go_on(batch.slice(0, head), int(new_doc[:head].sum()))
            self.end = batch.slice(head - 1, 1)
        if not len(starts):
            return
        if previous is not None and self.heads:
            yield from self._edge(self.end)
            self.heads = False
        elif previous is None:
            second = starts[1] if len(starts) > 1 else len(new_key)
            yield from self._begin(batch.slice(0, second), int(new_doc[:second].sum()))
            self.end = batch.slice(second - 1, 1)
            if len(starts) == 1:
                return
            yield from self._edge(self.end)
            self.heads = False
            starts = starts[1:]
        if len(starts) > 1:  # lines that begin and end in this batch
            a, z = starts[0], starts[-1]
            docs = np.add.reduceat(new_doc[a:z].astype("i8"), starts[:-1] - a)
            goes = np.repeat(docs >= self.min_docs, np.diff(starts))
            if self.keep_first:
                goes[starts[:-1] - a] = False
            if goes.any():
                yield from self._frequent(batch.slice(a, z - a).filter(pa.array(goes)))
        z = starts[-1]
        yield from self._begin(batch.slice(z), int(new_doc[z:].sum()))
        self.end = batch.slice(batch.num_rows - 1, 1)

    def close(self):
        if self.last is not None:
            yield from self._edge(self.end)


def dropped_lines(docs: DataFrame, min_docs: int, keep_first: bool, min_chars: int = 1) -> DataFrame:
    """(doc_id, row, pos) of the lines that go, each once."""
    order = ["h1", "h2", "doc_id", "row", "pos"]
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = line_rows(docs, min_chars).repartitionByRange(ranges, *order).sortWithinPartitions(*order)

    def run(batches):
        stream = Stream(TaskContext.get().partitionId(), min_docs, keep_first)
        for b in batches:
            if b.num_rows:
                yield from stream.read(b)
        yield from stream.close()

    said = cut(ranged.mapInArrow(run, STREAMED))
    line = Window.partitionBy("h1", "h2").orderBy("part")
    edges = said.where(F.col("kind") == BEGINS).select("part", "h1", "h2", F.struct("doc_id", "row").alias("begins"), F.col("pos").cast("long").alias("n"))
    ends = said.where(F.col("kind") == ENDS).select(F.col("part").alias("p"), F.col("h1").alias("a"), F.col("h2").alias("b"), F.struct("doc_id", "row").alias("ends"))
    edges = edges.join(ends, (F.col("part") == F.col("p")) & (F.col("h1") == F.col("a")) & (F.col("h2") == F.col("b")))
    same = F.col("begins").eqNullSafe(F.lag("ends").over(line)) & F.lag("p").over(line).isNotNull()
    lines = edges.withColumn("n", F.col("n") - same.cast("int")).groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min("part").alias("first_part"))
    lines = F.broadcast(lines)  # two lines a range at most
    open_ = said.where(F.col("kind").isin(IF_FREQUENT, IF_NOT_FIRST, IF_BOTH)).join(lines, ["h1", "h2"])
    frequent, later = F.col("n") >= min_docs, F.col("part") > F.col("first_part")
    open_ = open_.where(((F.col("kind") == IF_FREQUENT) & frequent) | ((F.col("kind") == IF_NOT_FIRST) & later) | ((F.col("kind") == IF_BOTH) & frequent & later))
    return said.where(F.col("kind") == GOES).select("doc_id", "row", "pos").unionByName(open_.select("doc_id", "row", "pos"))


def packed(positions) -> bytes:
    """A keep bitmap, 1 for a line that stays, up to the last line that goes; deflated."""
    keep = np.ones(int(max(positions)) // 8 * 8 + 8, bool)
    keep[positions] = False
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def unpacked(bitmap: bytes | None, n: int) -> np.ndarray:
    """The keep flags of a document of n lines; without a bitmap all stay."""
    keep = np.ones(n, bool)
    if bitmap:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), "u1"))[:n]
        keep[:len(bits)] = bits
    return keep


def keep_bitmaps(docs: DataFrame, min_docs: int = 2, keep_first: bool = True, min_chars: int = 1) -> DataFrame:
    """(doc_id, row, n_dropped, bitmap) of every document that loses lines: a bit per
    line, 1 where the line stays (``packed``); lines after the last bit stay.

    A line's key is the line without blanks at its ends and with A-Z lower-cased; keys
    under ``min_chars`` code points never go.  Lines whose key is found in at least
    ``min_docs`` documents go everywhere, but for the first occurrence in order of
    (doc_id, text's hash, position) where ``keep_first`` is set.

    A document is a doc_id with its text (``row`` is the text's xxhash64): repeated
    rows are one document, equal ids with different texts are several, and a null
    doc_id, which sorts first, is told apart by its text.  A null or empty text is one
    empty line, which never goes.  Other columns are ignored; an empty table gives no rows.
    The positions collected for a bitmap are those of one document's lines."""
    drops = dropped_lines(docs, min_docs, keep_first, min_chars).groupBy("doc_id", "row").agg(F.collect_list("pos").alias("at"))

    def run(batches):
        for b in batches:
            at = b.column(2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pc.list_value_length(at).cast(pa.int64()),
                                              pa.array([packed(x.values.to_numpy()) for x in at], pa.binary())], names=["doc_id", "row", "n_dropped", "bitmap"])

    return drops.mapInArrow(run, "doc_id long, row long, n_dropped long, bitmap binary")


def with_kept_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` (before) and ``n_dropped``: the lines whose bit
    stays, joined by \\n.  One row per row; columns of these three names are replaced."""
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    marked = bitmaps.select(F.col("doc_id").alias("__line_id"), F.col("row").alias("__line_of"), F.col("bitmap").alias("__line_bitmap"))
    both = _document(docs).join(marked, F.col("doc_id").cast("long").eqNullSafe(F.col("__line_id")) & (F.col("__line_row") == F.col("__line_of")), "left").drop("__line_id", "__line_of", "__line_row")
    schema = both.drop("__line_bitmap").schema.add("kept_text", "string").add("n_lines", "long").add("n_dropped", "long")
    text_at, bitmap_at = both.columns.index("text"), both.columns.index("__line_bitmap")

    def kept(text, bitmap):
        if bitmap is None:
            return text, text.count("\n") + 1, 0
        lines = text.split("\n")
        keep = unpacked(bitmap, len(lines))
        return "\n".join([x for x, k in zip(lines, keep.tolist()) if k]), len(lines), int(len(lines) - keep.sum())

    def run(batches):
        for b in batches:
            step = max(1, AT_ONCE * b.num_rows // max(1, b.column(text_at).nbytes))
            for k in range(0, b.num_rows, step):
                part = b.slice(k, step)
                new = list(zip(*map(kept, part.column(text_at).to_pylist(), part.column(bitmap_at).to_pylist())))
                own = [c for i, c in enumerate(part.columns) if i != bitmap_at]
                yield pa.RecordBatch.from_arrays([*own, pa.array(new[0], own[text_at].type), pa.array(new[1], pa.int64()), pa.array(new[2], pa.int64())],
                                                 names=schema.names)

    return both.mapInArrow(run, schema)


def line_digests(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row, where keys found in
    ``min_docs`` documents lose all their lines; ``keep_bitmaps`` says what counts."""
    docs = docs.select("doc_id", "text")
    kept = with_kept_lines(docs, keep_bitmaps(docs, min_docs, False, min_chars))
    return kept.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def line_digests_sql(min_docs: int = 10, min_chars: int = 1) -> str:
    """The rows of ``line_digests`` in DuckDB's SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT k, doc_id, md5(array_to_string(lines, chr(10))) AS row, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line FROM d),
t AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{upper}', '{upper.lower()}') AS key FROM l),
f AS (SELECT key FROM (SELECT DISTINCT key, doc_id, row FROM t WHERE length(key) >= {min_chars}) u GROUP BY key HAVING count(*) >= {min_docs}),
m AS (SELECT t.k, t.pos, t.line, f.key IS NOT NULL AS goes FROM t LEFT JOIN f ON t.key = f.key),
a AS (SELECT k, count(*) AS n_lines, count(*) FILTER (WHERE goes) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT goes), '')) AS kept_sha256 FROM m GROUP BY k)
SELECT d.doc_id, a.n_lines, a.n_dropped, a.kept_sha256 FROM d JOIN a ON a.k = d.k"""
