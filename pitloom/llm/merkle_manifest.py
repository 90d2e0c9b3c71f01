"""Operator 11: a Merkle manifest of a dataset, by sibling-shift self-joins.

Every row is a leaf: the sha256 of its fields, each with its length, so that no two rows share an encoding. The leaves of a
group are numbered by key. A level is one equijoin per sibling: node ``at`` looks up the nodes of its run of ``arity``
neighbours by their computed numbers (``at XOR 1`` in a binary tree, else the slots behind its own, modulo the arity), and
the rows of slot zero emit the parents. A group ends in its subroot; the subroots, ordered by group, are the leaves of one
more tree, which ends in the root. The siblings met on the way up are the proof of a row; folding a row's digest with
them must give the root.

Join keys are (group, node number), which are unique: a group that holds any share of the rows is spread like the others.
Leaves are numbered by ranges over (group, key, digest, row), so equal keys are split as well. Every level is a table in
the shared folder, so a lost executor repeats one level at most.

Defined results: a null field is ``-``; a null group is one of its own and comes first; null keys come first; rows of equal
keys are ordered by digest, and equal rows are leaves of their own; an empty table has no nodes, no proofs and a null root;
columns that are no field are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitloom.llm.common import stored

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "array<struct<left: string, right: string>>"


def digest_of(*inputs: Column) -> Column:
    """Lowercase hex sha256 of the inputs, concatenated."""
    return F.sha2(F.concat(*inputs), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: list[Column]) -> Column:
    return digest_of(*[field(v) for v in values])


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    return F.aggregate(steps, leaf, lambda node, step: digest_of(step["left"], node, step["right"]))


def proof_digest(steps: Column) -> Column:
    """One digest over a path's siblings, level by level, left to right."""
    return digest_of(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""))


def _numbered(leaves: DataFrame) -> DataFrame:
    """(tree, key, digest, row, ...) with ``at``, the row's number in its tree, and ``n``, the leaves of the tree."""
    order = [F.col("tree"), F.col("key").asc_nulls_first(), F.col("digest"), F.col("row")]
    # Written once: the ranges of a second evaluation could be cut elsewhere. The number holds range and place in it.
    spots = stored(
        leaves.repartitionByRange(*order).sortWithinPartitions(*order).drop("row").withColumn("spot", F.monotonically_increasing_id()),
        "merkle",
    ).withColumn("part", F.shiftright("spot", 33))
    # A row for each range and tree: a tree's window holds as many rows as there are ranges.
    runs = spots.groupBy("part", "tree").agg(F.min("spot").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("n", F.sum("rows").over(Window.partitionBy("tree"))).select(
        "part", "tree", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"), "n"
    )
    return spots.join(runs, ["part", "tree"]).withColumn("at", F.col("spot") + F.col("shift")).drop("part", "spot", "shift")


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` with ``left`` and ``right``: the joined digests of the run's other nodes before and behind each."""
    slot = F.col("at") % arity
    found = nodes
    for k in range(1, arity):
        other = F.col("at").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("at") - slot + (slot + k) % arity
        side = nodes.select(F.col("tree").alias("_tree"), F.col("at").alias("_at"), F.col("digest").alias(f"_{k}"))
        found = found.join(side, (F.col("tree") == F.col("_tree")) & (F.col("_at") == other), "left").drop("_tree", "_at")
    # The node of slot j is the one that was looked up j - slot places on, round the run.
    at_slot = [F.coalesce(*[F.when((slot + k) % arity == j, F.col(f"_{k}")) for k in range(1, arity)], F.lit("")) for j in range(arity)]
    left = F.concat(*[F.when(slot > j, at_slot[j]).otherwise("") for j in range(arity)])
    right = F.concat(*[F.when(slot < j, at_slot[j]).otherwise("") for j in range(arity)])
    return found.withColumns({"left": left, "right": right}).drop(*[f"_{k}" for k in range(1, arity)])


def _climb(leaves: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels with two nodes or more a tree, with siblings; and (tree, level, digest) of each tree's last node."""
    levels: list[DataFrame] = []
    nodes = stored(_numbered(leaves), "merkle")
    tops = nodes.filter("n = 1").select("tree", F.lit(0).alias("level"), "digest")
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(stored(_with_siblings(nodes.filter("n > 1"), arity), "merkle"))
        nodes = levels[-1].filter(F.col("at") % arity == 0).select(
            "tree",
            F.expr(f"at div {arity}").alias("at"),
            F.expr(f"(n + {arity - 1}) div {arity}").alias("n"),
            digest_of(F.col("digest"), F.col("right")).alias("digest"),
        )
        tops = tops.unionAll(nodes.filter("n = 1").select("tree", F.lit(len(levels)), "digest"))
        most = -(-most // arity)
    return levels, tops


def _descend(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """``leaves`` with ``steps``, the siblings on the way to the root; ``tops``: (tree, level, digest, steps)."""
    extra = [c for c in leaves.columns if c not in ("row", "key")]
    own = ("subroot", "steps")

    def ended(level: int) -> DataFrame:
        return tops.filter(F.col("level") == level).select(F.col("tree").alias("_tree"), F.lit(0).cast("long").alias("_at"), *own)

    above = ended(len(levels))
    for level in range(len(levels) - 1, -1, -1):
        step = F.array(F.struct("left", "right"))
        found = levels[level].join(above, (F.col("tree") == F.col("_tree")) & (F.expr(f"at div {arity}") == F.col("_at")))
        kept = extra if level == 0 else []
        rows = found.withColumn("steps", F.concat(step, "steps")).select(*(kept or ["tree", "at"]), *own)
        if level == 0:
            above = rows
        else:
            above = rows.withColumnsRenamed({"tree": "_tree", "at": "_at"}).unionByName(ended(level))
    return above


@dataclass(frozen=True)
class Manifest:
    """``leaves``: the carried columns of each row, digest, subroot, steps. ``nodes``: tree, level, at, digest of every node below
    the subroots. ``subroots``: group, digest, in no order. ``root``: hex text, null for an empty table."""

    leaves: DataFrame
    nodes: DataFrame | None
    subroots: DataFrame
    root: str | None


def build(rows: DataFrame, key: str, group: str, digest: Column, carry: dict[str, Column] | None = None, arity: int = ARITY) -> Manifest:
    """The manifest of ``rows``, whose leaf digest is ``digest``: leaves ascend by ``key`` in each ``group``.

    ``carry`` columns are worked out beside the digest, in the one pass over the rows, and handed on with each leaf.
    """
    carry = carry or {}
    name = F.col(group).cast("string")
    leaves = stored(
        rows.select(
            F.coalesce(F.concat(F.lit("+"), name), F.lit("")).alias("tree"),  # the null group comes first
            F.col(key).alias("key"),
            digest.alias("digest"),
            *[c.alias(f"c_{k}") for k, c in carry.items()],
            F.monotonically_increasing_id().alias("row"),
        ),
        "merkle",
    )
    levels, tops = _climb(leaves, arity)
    heads = tops.select(
        F.lit("").alias("tree"), F.col("tree").alias("key"), "digest", F.col("tree").alias("group"), "level", F.lit(0).cast("long").alias("row")
    )
    heads = stored(heads, "merkle")
    over, last = _climb(heads, arity)
    top = last.first()
    root = top["digest"] if top else None
    none = F.array().cast(_STEP).alias("steps")
    crown = last.select("tree", "level", F.lit("").alias("subroot"), none)
    paths = _rooted(heads, over, crown, arity)
    subroots = stored(paths.select(F.col("group").alias("tree"), "level", F.col("digest").alias("subroot"), "steps"), "merkle")
    found = _rooted(leaves, levels, subroots, arity)
    named = found.select("tree", "digest", "subroot", "steps", *[F.col(f"c_{k}").alias(k) for k in carry])
    nodes = None
    for level, frame in enumerate(levels):
        part = frame.select("tree", F.lit(level).alias("level"), "at", "digest")
        nodes = part if nodes is None else nodes.unionAll(part)
    return Manifest(named, nodes, subroots.select("tree", "subroot"), root)


def _rooted(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """Every leaf with its subroot and steps: those of trees with siblings, and the lone leaves."""
    lone = tops.filter("level = 0").select(F.col("tree").alias("_tree"), "subroot", "steps")
    alone = leaves.join(lone, F.col("tree") == F.col("_tree")).drop("_tree", "row", "key")
    return alone if not levels else alone.unionByName(_descend(leaves, levels, tops, arity))


def verified_documents(docs: DataFrame) -> DataFrame:
    """The manifest's proofs of ``documents``, each tried against a copy of its row that may have been tampered with:
    where 2 divides crc32(doc_id), the copy's text has lost its newlines."""
    cast = {c: F.col(c).cast("string") for c in FIELDS}
    leaf = leaf_digest(list(cast.values()))
    changed = (F.crc32(cast["doc_id"].cast("binary")) % 2 == 0) & F.contains(cast["text"], F.lit("\n"))
    other = leaf_digest([*list(cast.values())[:-1], F.replace(cast["text"], F.lit("\n"), F.lit(""))])
    # Only the other digests are kept: most copies are as the original.
    made = build(docs, "doc_id", "source", leaf, {"doc_id": F.col("doc_id"), "other": F.when(changed, other)})
    folded = fold(F.coalesce("other", "digest"), F.col("steps"))
    root = F.lit(made.root).cast("string")
    rows = made.leaves.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), proof_digest(F.col("steps")).alias("proof_sha256"),
        folded.alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE_SQL = r"""
WITH RECURSIVE poly AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)),
                        lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
  FROM range(256) AS r(i))),
d AS (
  SELECT doc_id, source,
         concat(CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END,
                CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
                CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END,
                CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END) AS head,
         text, replace(text, chr(10), '') AS bare, hex(encode(doc_id::VARCHAR)) AS x FROM documents),
c AS (
  SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
         sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(bare) || ':' || bare END) AS bare_leaf,
         xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(x)::BIGINT, 2), lambda k: ('0x' || substr(x, k, 2))::BIGINT)),
                         lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295) AS crc
  FROM d, poly),
leaves AS (
  SELECT *, CASE WHEN crc % 2 = 0 THEN bare_leaf ELSE leaf END AS given,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM c),
nodes AS (
  SELECT source AS tree, 0 AS level, pos, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1
  GROUP BY tree, level, pos // 3, n),
heads AS (
  SELECT tree, level, digest, row_number() OVER (ORDER BY tree IS NOT NULL, tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
over_nodes AS (
  SELECT 0 AS level, pos, n, digest FROM heads
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM over_nodes WHERE n > 1
  GROUP BY level, pos // 3, n),
kin AS (
  SELECT l.doc_id, l.leaf, l.given, h.digest AS subroot, s.level, s.pos AS sat, l.pos // (3 ** s.level)::BIGINT AS own, s.digest
  FROM leaves l JOIN heads h ON l.source IS NOT DISTINCT FROM h.tree
  LEFT JOIN nodes s ON l.source IS NOT DISTINCT FROM s.tree AND s.n > 1 AND s.pos // 3 = l.pos // (3 ** (s.level + 1))::BIGINT
  UNION ALL
  SELECT l.doc_id, l.leaf, l.given, h.digest, 1000 + s.level, s.pos, h.pos // (3 ** s.level)::BIGINT, s.digest
  FROM leaves l JOIN heads h ON l.source IS NOT DISTINCT FROM h.tree
  JOIN over_nodes s ON s.n > 1 AND s.pos // 3 = h.pos // (3 ** (s.level + 1))::BIGINT),
steps AS (
  SELECT doc_id, leaf, given, subroot, level, coalesce(string_agg(digest, '' ORDER BY sat) FILTER (sat < own), '') AS l,
         coalesce(string_agg(digest, '' ORDER BY sat) FILTER (sat > own), '') AS r
  FROM kin GROUP BY doc_id, leaf, given, subroot, level),
paths AS (
  SELECT doc_id, leaf, given, subroot, coalesce(list({'l': l, 'r': r} ORDER BY level) FILTER (level IS NOT NULL), []) AS p
  FROM steps GROUP BY doc_id, leaf, given, subroot),
roots AS (SELECT digest AS root FROM over_nodes WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(list_reduce(list_prepend('', list_transform(p, lambda s: s.l || s.r)), lambda a, b: a || b), '')) AS proof_sha256,
       list_reduce(list_prepend({'l': given, 'r': ''}, p), lambda a, s: {'l': sha256(s.l || a.l || s.r), 'r': ''}).l AS folded_root,
       folded_root = root AS verified
FROM paths, roots
"""
