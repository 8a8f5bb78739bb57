"""Merkle manifest of a dataset: every row's digest, the roots above it and a proof that it belongs to them.

A leaf is the digest of a row's fields. The leaves of a source stand in ascending order of doc_id and every FAN
consecutive nodes become one, level by level, until one is left, the source's subroot; the subroots in order of
source become the root in the same way. Digests are lowercase hexadecimal SHA-256 and are concatenated as text.

Blocks of FAN ** DEPTH consecutive nodes are arrays; inside a block ``aggregate`` adds level after level, each made by
``sequence``, ``slice`` and ``transform``. The roots of blocks are the nodes of the next round, until each group has a
single block. On the way down each block gets the siblings above it and passes them on with those of its own levels.

Scale: rows are hashed once and written, then range-sorted by (source, doc_id, leaf), so that a hot source is spread over many tasks;
the place of a row in its source is its place in its sorted part plus the rows of the source's parts before, one row for each part and
source. All later exchanges are by (source, block): equal, bounded groups. A round's table is 1 / 729 of the one
before. Nothing is collected but the largest count of a group, which gives the number of rounds.

Nulls: a null field counts as ``-``; a null source is a source, the first; a null doc_id comes first and is
tampered with in the query, like any even checksum. Ties and repeated rows: equal ids stand by leaf, equal rows next to each other, each a
leaf of its own. Empty text: ``0:``. Empty table: no rows. A null text can't be tampered with. Columns beyond those named are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc_mod, drop, of_columns, save, table

FAN = 3
#: Levels that a block collapses; 729 nodes.
DEPTH = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(**changed: Column) -> Column:
    """The leaf of a row of documents, with some fields changed."""
    return digest(*[field(changed.get(c, F.col(c))) for c in FIELDS])


def in_order(rows: DataFrame, group: str, order: tuple[str, ...], tag: str) -> DataFrame:
    """``rows`` with ``pos``, the place of a row in its group from 0 on, and ``n``, the group's rows."""
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    rows = save(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), tag)
    part = F.shiftright("at", 33)
    runs = rows.groupBy(F.col(group).alias("g_"), part.alias("part_")).agg(F.min("at").alias("first_"), F.count("*").alias("run_"))
    same = W.partitionBy("g_")
    before = F.coalesce(F.sum("run_").over(same.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = save(runs.select("g_", "part_", (before - F.col("first_")).alias("shift_"), F.sum("run_").over(same).alias("n")), f"{tag}-runs")
    joined = rows.join(runs, F.col(group).eqNullSafe(F.col("g_")) & (part == F.col("part_")))
    return joined.select(*[c for c in rows.columns if c != "at"], (F.col("at") + F.col("shift_")).alias("pos"), "n")


def collapse(nodes: Column, fan: int = FAN) -> Column:
    """The next level: the digest of every ``fan`` consecutive nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fan).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * fan + 1, fan), ""), 256))


def levels_of(nodes: Column, n: Column, fan: int = FAN, depth: int = DEPTH) -> Column:
    """All levels of a block from its nodes on; ``n`` counts the nodes of its group. A group of one block ends at one node."""
    rise = sum((F.when(n > fan**t, 1).otherwise(0) for t in range(depth)), F.lit(0))
    steps = F.filter(F.sequence(F.lit(1), F.lit(depth)), lambda i: i <= rise)
    return F.aggregate(steps, F.array(nodes), lambda levels, _: F.concat(levels, F.array(collapse(F.element_at(levels, -1), fan))))


class Forest:
    """A tree over the rows of each group: ``roots`` are its roots, ``paths`` the siblings of each row.

    rows: ``group``, the columns of ``order``, ``h`` (the node's digest) and any others, which ``paths`` returns with the node.
    """

    def __init__(self, rows: DataFrame, group: str, order: tuple[str, ...], tag: str, fan: int = FAN, depth: int = DEPTH):
        self.fan, self.depth, size = fan, depth, fan**depth
        ordered = nodes = in_order(rows, group, order, tag)
        self.carry = [c for c in rows.columns if c not in (group, "h")]
        self.rounds: list[DataFrame] = []
        while True:
            more = [c for c in nodes.columns if c not in ("g", group, "pos", "n")]
            nodes = nodes.withColumnRenamed(group, "g")
            items = F.sort_array(F.collect_list(F.struct("pos", *more)))
            found = nodes.groupBy("g", F.floor(F.col("pos") / size).alias("block")).agg(F.max("n").alias("n"), items.alias("items"))
            found = found.withColumn("levels", levels_of(F.transform("items", lambda x: x["h"]), F.col("n"), fan, depth))
            self.rounds.append(save(found, f"{tag}-blocks"))
            if len(self.rounds) == 1:
                drop(ordered)
            most = self.rounds[-1].agg(F.max("n")).first()[0]
            if most is None or most <= size:
                break
            root = F.element_at(F.element_at("levels", -1), 1)
            nodes = self.rounds[-1].select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / size).alias("n"), root.alias("h"))

    def roots(self) -> DataFrame:
        """g, root: a row for each group."""
        return self.rounds[-1].select("g", F.element_at(F.element_at("levels", -1), 1).alias("root"))

    def _siblings(self, t: Column, j: Column) -> Column:
        """left, right: the run's nodes before and after node ``j`` of the block's level ``t`` as text."""
        at = F.floor(j / F.pow(F.lit(self.fan), t)).cast("int")
        place = at % self.fan
        run = F.slice(F.element_at("levels", t + 1), at - place + 1, self.fan)
        return F.struct(F.array_join(F.slice(run, 1, place), "").alias("left"), F.array_join(F.slice(run, place + 2, self.fan), "").alias("right"))

    def paths(self, above: DataFrame | None = None) -> DataFrame:
        """g, the row's own columns, h, path (left and right siblings from the leaf up) and the columns of ``above``.

        above: g, path above the group's root (of a tree of roots), and others that all rows of the group get.
        """
        names = [] if above is None else [c for c in above.columns if c not in ("g", "path")]
        if above is not None:
            above = above.withColumn("block", F.lit(0).cast("long"))
        for k, blocks in reversed(list(enumerate(self.rounds))):
            if above is not None:
                up = above.withColumnsRenamed({"g": "g_", "block": "block_", "path": "up_"})
                blocks = blocks.join(up, F.col("g").eqNullSafe(F.col("g_")) & (F.col("block") == F.col("block_")))
            heights = F.filter(F.sequence(F.lit(0), F.lit(self.depth - 1)), lambda t: t < F.size("levels") - 1)
            more = self.carry if k == 0 else []

            def placed(x: Column, j: Column) -> Column:
                own = F.transform(heights, lambda t: self._siblings(t, j))
                path = own if above is None else F.concat(own, F.col("up_"))
                return F.struct(x["pos"].alias("block"), x["h"].alias("h"), path.alias("path"), *[x[c].alias(c) for c in more])

            above = blocks.select("g", *names, F.inline(F.transform("items", placed)))
            if k:
                above = above.drop("h")
        return above.withColumnRenamed("block", "pos")


def proof(path: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, x: digest(x["left"], h, x["right"]))


def manifest(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The manifest of ``rows``: source, the columns of ``order``, h (the leaf) and others.

    Returns them with path, subroot and root: what a reader needs to verify a row by itself."""
    leaves = Forest(rows, "source", order, "leaves")
    subroots = save(leaves.roots().select(F.col("g").alias("source"), F.col("root").alias("h"), F.lit(0).alias("all")), "subroots")
    tops = Forest(subroots, "all", ("source",), "subroots-in-order")
    root = tops.roots().select(F.col("root"), F.col("g").alias("all_"))
    above = tops.paths().join(root, F.col("g") == F.col("all_")).select(F.col("source").alias("g"), F.col("h").alias("subroot"), "root", "path")
    return leaves.paths(above).withColumnRenamed("g", "source")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    docs = of_columns(table(spark, sf_dir, "documents"), *FIELDS)
    bare = F.when(crc_mod(2) == 0, leaf_of(text=F.replace("text", F.lit("\n"), F.lit(""))))
    rows = docs.select("source", "doc_id", leaf_of().alias("h"), bare.alias("tampered"), F.monotonically_increasing_id().alias("tie"))
    rows = save(rows, "digests")
    known = manifest(rows, ("doc_id", "h", "tie"))
    drop(rows)
    out = known.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", proof(F.col("path")).alias("proof_sha256"), fold(F.coalesce("tampered", "h"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field_sql(c: str, value: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({value}) || ':' || {value} END"


def _leaf_sql(text: str = "text") -> str:
    return "sha256(" + " || ".join(_field_sql(c, text if c == "text" else f"{c}::VARCHAR") for c in FIELDS) + ")"


_CRC = """xor(list_reduce([4294967295::BIGINT] || [ascii(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')],
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"""


def _tree_sql(name: str, base: str) -> str:
    """All levels above ``base`` (g, pos, h); the recursion ends where each group has one node."""
    return f"""{name} AS (
  SELECT 0 AS level, g, pos, h, count(*) OVER (PARTITION BY g) AS n FROM {base}
  UNION ALL
  SELECT level + 1, g, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM {name} WHERE n > 1 GROUP BY level, g, pos // 3)"""


def _path_sql(name: str, tree: str) -> str:
    """For each node of level 0 the pairs of left and right siblings, from below."""
    return f"""{name} AS (
  SELECT g, pos, list(pair ORDER BY level) AS pairs FROM (
    SELECT a.g, a.pos, b.level, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos // pow(3, b.level)::BIGINT), '') || '|'
      || coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos // pow(3, b.level)::BIGINT), '') AS pair
    FROM {tree} a JOIN {tree} b ON a.g = b.g AND a.level = 0 AND b.n > 1 AND b.pos // 3 = a.pos // pow(3, b.level + 1)::BIGINT
    GROUP BY a.g, a.pos, b.level) GROUP BY g, pos)"""


ORACLE_OP11 = f"""
WITH RECURSIVE digests AS (
  SELECT doc_id, source, {_leaf_sql()} AS h, CASE WHEN doc_id IS NULL OR {_CRC} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} END AS tampered FROM documents),
sources AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT source FROM digests)),
leaves AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, h, doc_id, tampered FROM digests d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source),
{_tree_sql("tree", "leaves")},
subroots AS (SELECT g AS pos, 0 AS g, h FROM tree WHERE n = 1),
{_tree_sql("tops", "subroots")},
{_path_sql("low", "tree")},
{_path_sql("high", "tops")},
known AS (
  SELECT l.doc_id, l.h AS leaf, l.tampered, s.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root,
    coalesce(low.pairs, []) || coalesce(high.pairs, []) AS pairs
  FROM leaves l JOIN subroots s ON s.pos = l.g LEFT JOIN low ON low.g = l.g AND low.pos = l.pos LEFT JOIN high ON high.pos = l.g),
folded AS (
  SELECT *, list_reduce([coalesce(tampered, leaf)] || pairs, lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) AS folded_root FROM known)
SELECT doc_id, leaf, subroot, root, sha256(replace(coalesce(array_to_string(pairs, ''), ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
