"""Line deduplication, ranked search and the Merkle manifest against brute force and SQL, with edge inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from sparkjourney.llm import line_dedup, merkle, ranked_search

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _kept(rows, min_docs, keep_first):
    """{(doc_id, text): (kept text, lines, dropped)}"""
    held, kept = defaultdict(list), {}
    for d, text in sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0)):
        for pos, line in enumerate((text or "").split("\n")):
            held[line.strip(BLANKS).translate(LOWER)].append((d, text, pos))
    goes = set()
    for key, at in held.items():
        if key and len({(d, t) for d, t, _ in at}) >= min_docs:
            goes |= set(at[1:] if keep_first else at)
    for d, text in rows:
        lines = (text or "").split("\n")
        stay = [x for pos, x in enumerate(lines) if (d, text, pos) not in goes]
        kept[d, text] = ("\n".join(stay), len(lines), len(lines) - len(stay))
    return kept


@pytest.mark.parametrize("batch", [3, 10_000])
@pytest.mark.parametrize("min_docs,keep_first", [(10, False), (2, True), (1, True), (4, True), (3, False)])
def test_lines_against_brute_force(spark, batch, min_docs, keep_first):
    r = random.Random(min_docs)
    pool = [f"Line {i}" for i in range(60)] + ["", " \t", "Ünïque É", "ünïque É", "hot"]
    rows = [(i, "\n".join([*r.choices(pool, k=r.randrange(9)), "  HOT ", f"own {i}", *(["hot"] * (i % 3))])) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "\n\n"), (403, "Line 1\n" * 500)]
    if not keep_first:  # the order among equal ids is that of their hashes
        rows += [(None, "hot\nLine 2"), (None, "hot\nLine 3"), (7, "hot\nsecond text of 7")]
    rows += rows[:20]
    df = spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, n_lines string").repartition(5)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = line_dedup.with_kept_lines(df, line_dedup.keep_bitmaps(df, min_docs, keep_first)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert len(got) == len(rows)
    want = _kept(rows, min_docs, keep_first)
    want.update({(d, t or ""): v for (d, t), v in want.items()})
    for x in got:
        assert (x.kept_text, x.n_lines, x.n_dropped) == want[x.doc_id, x.text], x.doc_id


def test_a_line_over_many_ranges(spark):
    """One line in every document: each range holds a piece of it."""
    rows = [(i, f"same line\nother {i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    first = line_dedup.keep_bitmaps(df, 2, True).collect()
    assert {x.doc_id for x in first} == set(range(1, 2000)) and all(x.n_dropped == 1 for x in first)
    assert line_dedup.keep_bitmaps(df, 2001, False).count() == 0
    assert line_dedup.keep_bitmaps(df, 2000, False).count() == 2000


def test_bitmaps_round_trip():
    r = random.Random(1)
    for n in (1, 7, 8, 9, 1000):
        at = sorted(r.sample(range(n), r.randrange(1, n + 1)))
        keep = line_dedup.unpacked(line_dedup.packed(at), n)
        assert [i for i in range(n) if not keep[i]] == at
    assert line_dedup.unpacked(None, 3).all()


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _ranked(docs, items, top):
    words = lambda t: WORDS.findall((t or "").translate(LOWER))
    own = [(d, Counter(words(t))) for d, t in docs]
    own = [(d, c, c.total()) for d, c in own if c]
    n_docs, n_terms = len(own), sum(n for *_, n in own)
    df = Counter(w for _, c, _ in own for w in c)
    out = []
    for i, text in set(items):
        scored = []
        for d, c, n in own:
            m = 75 + 25 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in words(text) if c[w])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(i, k + 1, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [40, 1 << 20])
def test_search_against_brute_force(spark, block_bytes):
    r = random.Random(2)
    pool = ["alpha", "beta", "Ärger", "ärger", "x1", "漢字", "the", "a", "éa", "gamma delta", "d"]
    text = lambda n: "".join(r.choice(pool) + r.choice([" ", ", ", "\n", "-", "", "\x00"]) for _ in range(n))
    docs = [(i, text(r.randrange(40))) for i in range(200)] + [(900, None), (901, ""), (902, "..."), (None, "alpha beta"), (903, "alpha " * 30000)]
    docs += docs[:12]
    items = [(i, text(r.randrange(1, 12))) for i in range(12)] + [(50, None), (51, "!!"), (52, "nowhere found"), (None, "alpha"), (3, "beta beta"), (3, "beta beta")]
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, score int").repartition(7)
    got = ranked_search.ranked(df, spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, rank int"), 20, block_bytes)
    assert sorted((tuple(x) for x in got.collect()), key=str) == _ranked(docs, items, 20)


def test_search_many_documents_of_one_word(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "'same words' as text").repartition(9)
    item = spark.createDataFrame([(1, "other same")], "item_id long, text string")
    assert ranked_search.ranked(docs, item).collect() == []  # a word of every document weighs nothing
    more = docs.union(spark.range(9000, 9900).selectExpr("id", "'other'"))
    got = sorted(ranked_search.ranked(more, item).collect(), key=lambda x: x.rank)
    assert [x.doc_id for x in got] == list(range(9000, 9020)) and len({x.score for x in got}) == 1


def _tree(digests):
    """Levels of a tree over a list of digests."""
    levels = [digests]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i:i + 16])) for i in range(0, len(now), 16)])
    return levels


def _siblings(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 16 * 16:i // 16 * 16 + 16]
        out.append((run[:i % 16], run[i % 16 + 1:]))
        i //= 16
    return out


def _manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, text, lang, source, n: sha("".join(map(field, (d, source, lang, n, text))))
    trees = defaultdict(list)
    for x in rows:
        hit = x[0] is not None and zlib.crc32(str(x[0]).encode()) % 5 == 0 and x[1] is not None
        trees[x[3]].append((x[0] is not None, x[0] or 0, leaf(*x), leaf(x[0], x[1].translate(LOWER), *x[2:]) if hit else leaf(*x)))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: _tree([x[2] for x in sorted(trees[s])]) for s in order}
    over = _tree([built[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (known, d, own, tampered) in enumerate(sorted(trees[s])):
            way = _siblings(built[s], i) + _siblings(over, k)
            folded = tampered
            for left, right in way:
                folded = sha("".join([*left, folded, *right]))
            proof = sha("".join("".join([*left, *right]) for left, right in way))
            out.append((d if known else None, own, built[s][-1][0], over[-1][0], proof, folded, folded == over[-1][0]))
    return sorted(out, key=str)


def _documents(seed, sizes):
    r = random.Random(seed)
    rows = []
    for source, n in sizes:
        for _ in range(n):
            text = r.choice([None, "", "ÉA b", "Some Text", f"text {r.random()}", "x" * 5000])
            rows.append((r.choice([None, r.randrange(-50, 10**6)]) if source == "nulls" else r.randrange(10**9), text, r.choice([None, "de", "fr"]), source, r.choice([None, len(text or "")])))
    return rows


@pytest.mark.parametrize("sizes", [[("a", 1)], [("a", 16)], [("a", 17), ("b", 1)], [(None, 5), ("", 2), ("é", 33), ("z", 600), ("nulls", 40)], [(f"s{i}", 1 + i % 3) for i in range(40)]])
@pytest.mark.parametrize("shared", [1, 64])
def test_manifest_against_brute_force(spark, monkeypatch, sizes, shared):
    monkeypatch.setattr(merkle, "SHARED_BY", shared)
    rows = _documents(len(sizes), sizes)
    rows += rows[:3] if len(rows) > 20 else []  # repeated rows
    df = spark.createDataFrame([(*x, "extra", 1) for x in rows], DOCS + ", leaf string, n int").repartition(4)
    got = merkle.manifest(df)
    assert sorted((tuple(x) for x in got.collect()), key=str) == _manifest(rows)
    if shared == 64:
        db = duckdb.connect()
        db.register("documents", df.select(*[c.split()[0] for c in DOCS.split(", ")]).toArrow())
        assert sorted(db.sql(merkle.manifest_sql()).fetchall(), key=str) == _manifest(rows)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert line_dedup.line_digests(docs).collect() == []
    assert merkle.manifest(docs).collect() == []
    assert ranked_search.ranked(docs, spark.createDataFrame([(1, "a")], "item_id long, text string")).collect() == []
    assert ranked_search.ranked(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).collect() == []
