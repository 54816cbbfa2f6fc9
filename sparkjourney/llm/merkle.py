"""Merkle manifest of a table: hash trees by source, and a tree over their roots.

Leaves are numbered within their source by ranges (no source is one task).  Every 16
nodes of a level become one of the next; a built level is stored as parent-linked node
rows: a node, its parent, and what stands left and right of it in its run.  A recursive
query then climbs from every run of leaves to the root: each step appends the siblings
to the proof and folds the hash that every one of the run's leaves would give by itself.
The 16 leaves of a run share the row and all siblings above it; their own hashes are
folded one by one, where they differ."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F

from sparkjourney.llm.common import cut
from sparkjourney.llm.line_dedup import ascii_lower

RUN = 16
#: A node is stored once for so many runs of leaves below it, so that no climb meets in one row.
SHARED_BY = 64
#: Tables up to this size (rows and bytes are counted) are broadcast, larger ones are joined by shuffle.
BROADCAST_BYTES = 16 << 20
#: The tree over the sources.
TOP = -1
NODE = ["tree", "level", "idx"]


def _hash(digests):
    """H of joined digests.  Digests are 32 bytes everywhere; their hex text is what is hashed and shown."""
    return F.unhex(F.sha2(_text(digests).cast("binary"), 256))


def _text(digests):
    return F.lower(F.hex(digests))


def _field(column):
    """The value with its UTF-8 byte count in front, or - for null."""
    text = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_rows(docs: DataFrame) -> DataFrame:
    """(source, doc_id, leaf, tampered): the tampered leaf is null where nothing is tampered with."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"), "text")
    head = [_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = lambda text: F.unhex(F.sha2(F.concat(*head, _field(text)).cast("binary"), 256))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return docs.select("source", "doc_id", leaf(F.col("text")).alias("leaf"), F.when(hit, leaf(ascii_lower(F.col("text")))).alias("tampered"))


def ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows dealt by ranges of ``order``, with ``part`` (the range) and ``at`` (the place in it)."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    return rows.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))


def starts(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, part, shift, n): ``at + shift`` is a row's place in its group, n the group's size.
    The windows go over one row a range and group."""
    counts = rows.groupBy(*group, "part").agg(F.count("*").alias("own"), F.min("at").alias("low"))
    by = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    earlier = F.sum("own").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return counts.select(*group, "part", (F.coalesce(earlier, F.lit(0)) - F.col("low")).alias("shift"), F.sum("own").over(by).alias("n"))


def checked(small: DataFrame) -> DataFrame:
    """The table, to be broadcast if it is small enough."""
    small = cut(small)
    strings = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c, kind in small.dtypes if kind in ("string", "binary")]
    size = small.agg(sum(strings, F.count("*") * 8 * len(small.columns))).first()[0]
    return F.broadcast(small) if size <= BROADCAST_BYTES else small


def placed(docs: DataFrame) -> DataFrame:
    """Leaves with ``tree`` (the source's number, null first, then bytewise), ``n_trees``,
    ``idx`` (their place in it, by doc_id, then leaf) and ``n`` (its leaves)."""
    leaves = ranged(cut(leaf_rows(docs)), ["source", "doc_id", "leaf"])
    own = cut(starts(leaves, ["source"]))
    sources = ranged(own.select("source").distinct(), ["source"])
    numbers = sources.join(checked(starts(sources, []).withColumnRenamed("n", "n_trees")), "part").select(
        F.col("source").alias("_source"), (F.col("at") + F.col("shift")).alias("tree"), "n_trees")
    own = own.join(checked(numbers), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    own = checked(own.select(F.col("source").alias("_source"), F.col("part").alias("_part"), "shift", "n", "tree", "n_trees"))
    both = leaves.join(own, F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part")))
    return both.select("tree", "n_trees", "n", (F.col("at") + F.col("shift")).alias("idx"), "doc_id", "leaf", "tampered")


def _joined(members, field: str, first=None, n=None):
    """The members' digests in ``field``, joined; those from ``first`` (1 up), n of them."""
    some = members if first is None else F.slice(members, first, n)
    return F.aggregate(some, F.lit(b""), lambda joined, x: F.concat(joined, x[field]))


def leaf_runs(leaves: DataFrame) -> DataFrame:
    """(tree, n_trees, n, run, members, hashes, which): every 16 consecutive leaves of a
    source, and the hashes that its leaves give, each by itself, at the node above the
    run (a lone leaf of a source is a node itself).  Equal hashes, as those of all leaves
    not tampered with, are listed once; ``which`` is a leaf's hash, from 1."""
    member = F.struct("idx", "doc_id", "leaf", "tampered")
    runs = leaves.groupBy("tree", "n_trees", "n", F.expr(f"idx div {RUN}").alias("run")).agg(F.sort_array(F.collect_list(member)).alias("members"))
    members, lone = F.col("members"), F.col("n") == 1

    def alone(x, j):
        leaf = F.coalesce(x["tampered"], x["leaf"])
        return F.when(lone, leaf).otherwise(_hash(F.concat(_joined(members, "leaf", F.lit(1), j), leaf, _joined(members, "leaf", j + 2, F.lit(RUN)))))

    listed = F.transform(F.array(F.transform(members, alone)), lambda each: F.struct(
        F.array_distinct(each).alias("hashes"), F.transform(each, lambda h: F.array_position(F.array_distinct(each), h)).alias("which")))[0]
    return runs.withColumn("_listed", listed).select("*", "_listed.*").drop("_listed")


def level_up(nodes: DataFrame, top: bool) -> tuple[DataFrame, DataFrame]:
    """The node rows of a level, linked to their parents, and the nodes of the next level.

    ``nodes``: tree, level, idx, digest, runs (of leaves below), n (nodes of the level
    in this tree).  With ``top`` they are the sources' roots, numbered by source."""
    up = [F.lit(TOP).cast("long").alias("up_tree"), F.lit(1).alias("up_level"), F.expr(f"tree div {RUN}").alias("up_idx")] if top else [
        F.col("tree").alias("up_tree"), (F.col("level") + 1).alias("up_level"), F.expr(f"idx div {RUN}").alias("up_idx")]
    of = F.col("n_trees") if top else F.col("n")
    member = F.struct(F.col("tree" if top else "idx").alias("place"), *NODE, "digest", "runs")
    families = cut(nodes.groupBy(*up, of.alias("n"), "n_trees").agg(F.sort_array(F.collect_list(member)).alias("members"), F.sum("runs").alias("runs")))
    copies = lambda runs: F.ceil(runs / SHARED_BY).cast("long")
    rows = families.select("up_tree", "up_level", "up_idx", copies(F.col("runs")).alias("up_copies"), "members", F.posexplode("members").alias("j", "m"))
    rows = rows.select(*[F.col("m")[c].alias(c) for c in NODE], "up_tree", "up_level", "up_idx", "up_copies",
                       _joined(F.col("members"), "digest", F.lit(1), F.col("j")).alias("left"), _joined(F.col("members"), "digest", F.col("j") + 2, F.lit(RUN)).alias("right"),
                       F.explode(F.sequence(F.lit(0).cast("long"), copies(F.col("m")["runs"]) - 1)).alias("copy"))
    after = families.select(F.col("up_tree").alias("tree"), F.col("up_level").alias("level"), F.col("up_idx").alias("idx"),
                            _hash(_joined(F.col("members"), "digest")).alias("digest"), "runs", F.expr(f"(n + {RUN - 1}) div {RUN}").alias("n"), "n_trees")
    return rows, after


def climb(anchor: DataFrame, nodes: DataFrame) -> DataFrame:
    """(run_tree, run, folded, proof, tree, level, idx) at every node on each run's way up."""
    spark, name = anchor.sparkSession, uuid.uuid4().hex
    anchor.createOrReplaceTempView(f"anchor_{name}")
    nodes.createOrReplaceTempView(f"nodes_{name}")
    climbed = spark.sql(f"""
        WITH RECURSIVE climb(run_tree, run, spread, folded, proof, tree, level, idx, copy) AS (
          SELECT run_tree, run, spread, folded, proof, tree, level, idx, copy FROM anchor_{name}
          UNION ALL
          SELECT c.run_tree, c.run, c.spread, transform(c.folded, x -> unhex(sha2(lower(hex(concat(n.left, x, n.right))), 256))), concat(c.proof, n.left, n.right),
                 n.up_tree, n.up_level, n.up_idx, pmod(c.spread, n.up_copies)
          FROM climb c JOIN nodes_{name} n ON c.tree = n.tree AND c.level = n.level AND c.idx = n.idx AND c.copy = n.copy)
        SELECT run_tree, run, folded, proof, tree, level, idx FROM climb""")
    spark.catalog.dropTempView(f"anchor_{name}")
    spark.catalog.dropTempView(f"nodes_{name}")
    return climbed


#: Spark ends a recursion beyond this many rows; the climb's rows are bounded by the tree's height times the runs.
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"
COLUMNS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def height(n: int) -> int:
    """Levels above n nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // RUN), levels + 1
    return levels


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    H is the lowercase hex SHA-256 of the inputs, concatenated (digests as hex text).  A
    leaf is H of doc_id, source, lang, n_chars and text, each as ``bytes:value`` or - for
    null.  In a source leaves ascend by doc_id (null first; equal ids by leaf); every 16
    consecutive nodes of a level become their H until one remains, the subroot (a lone
    leaf itself).  The subroots in the order of their sources (null first, bytewise) give
    the root likewise.  proof_sha256 is H of the siblings, level by level, left to right;
    folded_root comes from the leaf of the row with A-Z lower-cased in its text where 5
    divides crc32 of its decimal doc_id, else from the leaf (also for a null doc_id), and
    its original siblings; verified says whether it is the root.

    Repeated rows are leaves of their own, side by side; null and empty texts differ;
    columns other than the five are ignored; an empty table gives no rows."""
    spark = docs.sparkSession
    runs = cut(leaf_runs(placed(docs)))
    facts = runs.agg(F.max("n"), F.max("n_trees"), F.max("tree")).first()
    if facts[0] is None:
        return spark.createDataFrame([], COLUMNS)
    most, trees = facts[0], facts[1]
    members, lone = F.col("members"), F.col("n") == 1
    leaf = _joined(members, "leaf")
    bottom = runs.select("tree", F.when(lone, 0).otherwise(1).alias("level"), F.col("run").alias("idx"), F.when(lone, leaf).otherwise(_hash(leaf)).alias("digest"),
                         F.lit(1).cast("long").alias("runs"), F.expr(f"(n + {RUN - 1}) div {RUN}").alias("n"), "n_trees")
    rows, roots, level = [], [bottom.where("n = 1")], bottom.where("n > 1")
    for _ in range(height(most) - 1):
        linked, level = level_up(level, False)
        rows.append(linked)
        roots.append(level.where("n = 1"))
        level = level.where("n > 1")
    subroots = roots[0]
    for more in roots[1:]:
        subroots = subroots.unionByName(more)
    subroots = cut(subroots)
    level = subroots
    for k in range(height(trees)):
        linked, level = level_up(level, k == 0)
        rows.append(linked)
    root = level.first()
    climbed = runs.select(F.col("tree").alias("run_tree"), "run", F.xxhash64("tree", "run").alias("spread"), F.col("hashes").alias("folded"),
                          F.lit(b"").alias("proof"), "tree", F.when(lone, 0).otherwise(1).alias("level"), F.col("run").alias("idx"), F.lit(0).cast("long").alias("copy"))
    if rows:
        nodes = rows[0]
        for more in rows[1:]:
            nodes = nodes.unionByName(more)
        limit = spark.conf.get(ROW_LIMIT, None)
        spark.conf.set(ROW_LIMIT, "-1")
        try:
            climbed = cut(climb(climbed, checked(nodes)).where((F.col("tree") == root["tree"]) & (F.col("level") == root["level"]) & (F.col("idx") == root["idx"])))
        finally:
            spark.conf.unset(ROW_LIMIT) if limit is None else spark.conf.set(ROW_LIMIT, limit)
    own = checked(subroots.select("tree", F.col("digest").alias("subroot")))
    held = runs.select("tree", "run", "members", "which").join(own, "tree")
    up = climbed.select(F.col("run_tree").alias("tree"), "run", "folded", "proof")
    each = held.join(up, ["tree", "run"]).select("subroot", "folded", "proof", "members", "which", F.posexplode("members").alias("j", "m"))
    siblings = F.concat(_joined(members, "leaf", F.lit(1), F.col("j")), _joined(members, "leaf", F.col("j") + 2, F.lit(RUN)), F.col("proof"))
    folded = F.element_at("folded", F.element_at("which", F.col("j") + 1).cast("int"))
    top = F.lit(bytes(root["digest"]))
    return each.select(F.col("m")["doc_id"].alias("doc_id"), _text(F.col("m")["leaf"]).alias("leaf"), _text(F.col("subroot")).alias("subroot"), _text(top).alias("root"),
                       _text(_hash(siblings)).alias("proof_sha256"), _text(folded).alias("folded_root"), (folded == top).alias("verified"))


def manifest_sql() -> str:
    """The rows of ``manifest`` in DuckDB's SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    head = " || ".join(map(field, ("doc_id", "source", "lang", "n_chars")))
    up = f"""SELECT {{key}}, level + 1 AS level, idx // {RUN} AS idx, sha256(string_agg(digest, '' ORDER BY idx)) AS digest, (n + {RUN - 1}) // {RUN} AS n
      FROM {{name}} WHERE n > 1 GROUP BY {{key}}, level, idx // {RUN}, n"""
    kin = f"""SELECT a.{{key}}, a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS l,
      coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS r
      FROM {{name}} a JOIN {{name}} b ON a.{{key}} = b.{{key}} AND a.level = b.level AND a.idx // {RUN} = b.idx // {RUN} WHERE a.n > 1 GROUP BY a.{{key}}, a.level, a.idx"""
    climb = """SELECT c.k, c.{key}, c.level + 1 AS level, c.idx // {run} AS idx, sha256(s.l || c.folded || s.r) AS folded, c.proof || s.l || s.r AS proof
      FROM {name} c JOIN {kin} s ON s.{key} = c.{key} AND s.level = c.level AND s.idx = c.idx"""
    return f"""
WITH RECURSIVE bits(i, step, v) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i) UNION ALL
  SELECT i, step + 1, xor(v >> 1, 3988292384 * (v & 1)) FROM bits WHERE step < 8),
crc AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE step = 8),
d AS (SELECT row_number() OVER () AS k, * FROM documents),
bytes AS (SELECT k, unnest(range(1, length(CAST(doc_id AS VARCHAR)) + 1)) AS p, CAST(doc_id AS VARCHAR) AS s FROM d WHERE doc_id IS NOT NULL),
chars AS (SELECT k, list(ord(substr(s, p, 1))::BIGINT ORDER BY p) AS own FROM bytes GROUP BY k),
sums AS (SELECT k, xor(list_reduce(list_prepend(4294967295::BIGINT, own), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS crc FROM chars CROSS JOIN crc),
src AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER () AS trees FROM (SELECT DISTINCT source FROM documents) u),
h AS (SELECT k, doc_id, tree, sha256({head} || {field('text')}) AS leaf,
  CASE WHEN crc % 5 = 0 THEN sha256({head} || {field(f"translate(text, '{upper}', '{upper.lower()}')")}) END AS tampered
  FROM (SELECT d.*, sums.crc, src.tree FROM d LEFT JOIN sums ON sums.k = d.k JOIN src ON src.source IS NOT DISTINCT FROM d.source) u),
f AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM h),
t(tree, level, idx, digest, n) AS (SELECT tree, 0, idx, leaf, n FROM f UNION ALL {up.format(key='tree', name='t')}),
sub AS (SELECT tree, level, digest FROM t WHERE n = 1),
o(one, level, idx, digest, n) AS (SELECT 1, 0, sub.tree, sub.digest, src.trees FROM sub JOIN src ON src.tree = sub.tree UNION ALL {up.format(key='one', name='o')}),
tk AS ({kin.format(key='tree', name='t')}),
ok AS ({kin.format(key='one', name='o')}),
c(k, tree, level, idx, folded, proof) AS (SELECT k, tree, 0, idx, coalesce(tampered, leaf), '' FROM f UNION ALL {climb.format(key='tree', name='c', kin='tk', run=RUN)}),
e(k, one, level, idx, folded, proof) AS (SELECT c.k, 1, 0, c.tree, c.folded, c.proof FROM c JOIN sub ON sub.tree = c.tree AND sub.level = c.level UNION ALL {climb.format(key='one', name='e', kin='ok', run=RUN)}),
top AS (SELECT level, digest FROM o WHERE n = 1)
SELECT f.doc_id, f.leaf, sub.digest AS subroot, top.digest AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = top.digest AS verified
FROM f JOIN e ON e.k = f.k JOIN top ON top.level = e.level JOIN sub ON sub.tree = f.tree"""
