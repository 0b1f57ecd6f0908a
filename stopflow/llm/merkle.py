"""Merkle manifest of a table: trees of digests whose nodes are labelled by the leaf ranks they cover."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stopflow.llm.frames import fold_of, stored

FANOUT = 16
# What a leaf covers, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """A value in a leaf's input: `-` if null, else UTF-8 byte count, `:`, value."""
    s = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


@dataclass(frozen=True)
class Forest:
    """`nodes[k]`: (tree, lo, hi, digest) of level k, the leaves being level 0 and
    [lo, hi] the leaf ranks that a node covers. Leaves keep their other columns,
    nodes above them their children. `roots`: (tree, digest, size)."""

    nodes: list[DataFrame]
    roots: DataFrame
    fanout: int


def ranked(leaves: DataFrame, by: list[str], name: str) -> DataFrame:
    """The leaves with their `rank` in their tree (from 0, ascending by `by`).

    Rows are sorted into ranges of (tree, by), so a tree of any size spreads over
    tasks; a rank is the place in the range plus the tree's rows in the ranges
    before, which are as few as ranges and trees.
    """
    dealt = leaves.repartitionByRange("tree", *by).sortWithinPartitions("tree", *by)
    placed = stored(dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), name)
    held = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    # a tree with rows in many ranges: at most as many rows as ranges
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = held.select("tree", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(shift, ["tree", "part"]).withColumn("rank", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def grow(leaves: DataFrame, name: str, fanout: int = FANOUT) -> Forest:
    """Trees over leaves (tree, rank, digest): while several nodes of a tree remain,
    every `fanout` consecutive ones become their digest. A tree that is down to
    one node stops there, so a lone leaf is its own root."""
    level = stored(leaves.withColumnRenamed("rank", "lo").withColumn("hi", F.col("lo")), f"{name}-0")
    sizes = stored(level.groupBy("tree").agg(F.count("*").alias("size")), f"{name}-sizes")
    most = sizes.agg(F.max("size")).first()[0] or 0
    nodes, roots, width = [level], [], 1
    while True:
        # a node that covers its whole tree is the root and has no parent
        done = F.col("lo").eqNullSafe(0) & (F.col("hi") == F.col("size") - 1)
        sized = level.join(sizes, "tree")
        roots.append(sized.where(done).select("tree", "digest", "size"))
        if width >= most:
            break
        width *= fanout
        family = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest")))
        above = sized.where(~done).groupBy("tree", F.floor(F.col("lo") / width).alias("bucket")).agg(family.alias("family"))
        level = stored(above.select("tree", F.col("family")[0]["lo"].alias("lo"), F.element_at("family", -1)["hi"].alias("hi"), digest(F.array_join(F.transform("family", lambda c: c["digest"]), "")).alias("digest"), "family"), f"{name}-{len(nodes)}")
        nodes.append(level)
    out = roots[0]
    for r in roots[1:]:
        out = out.union(r)
    return Forest(nodes, stored(out, f"{name}-roots"), fanout)


def _steps(parent: str = "family", lo: str = "lo", hi: str = "hi") -> Column:
    """What a proof needs of one level: the siblings to the left and to the right,
    found as the parent's interval without the node's own."""
    left = F.filter(parent, lambda c: c["hi"] < F.col(lo))
    right = F.filter(parent, lambda c: c["lo"] > F.col(hi))
    return F.struct(F.array_join(F.transform(left, lambda c: c["digest"]), "").alias("left"), F.array_join(F.transform(right, lambda c: c["digest"]), "").alias("right"))


def attach(forest: Forest, above: DataFrame) -> DataFrame:
    """The leaves with their `path`: the siblings of the leaf and of each of its
    ancestors, lowest first, and then those of `above` (tree, path).

    Down from the roots, each node meets the node of the next level whose
    interval contains its own. The join's bucket is the interval's place at that
    level, so a key has at most as many rows as a node has children, and a proof
    grows by one step a level.
    """
    path = None
    for k in range(len(forest.nodes) - 1, -1, -1):
        width = forest.fanout ** (k + 1)
        # only leaves have more to carry down
        kept = [c for c in forest.nodes[k].columns if k == 0 or c in ("tree", "lo", "hi")]
        node = forest.nodes[k].select(*kept, F.floor(F.col("lo") / width).alias("bucket"))
        top = forest.roots.select("tree", "size").join(above, "tree")
        roots = node.join(top, "tree").where("lo = 0 AND hi = size - 1").select(*kept, "path")
        if path is None:
            path = roots
        else:
            parent = forest.nodes[k + 1].select("tree", F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), "family").join(path.withColumnsRenamed({"lo": "p_lo", "hi": "p_hi"}), ["tree", "p_lo", "p_hi"]).withColumn("bucket", F.floor(F.col("p_lo") / width))
            inside = node.join(parent, ["tree", "bucket"]).where("p_lo <= lo AND hi <= p_hi")
            path = roots.union(inside.select(*kept, F.concat(F.array(_steps()), "path").alias("path")))
        if k:
            path = stored(path, f"paths-{k}")
    return path


def proof(path: str = "path") -> Column:
    """Digest of the siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def fold(leaf: str, path: str = "path") -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, F.col(leaf), lambda d, s: digest(s["left"], d, s["right"]))


def chosen(doc_id: str) -> Column:
    """Rows that are tampered with: 5 divides the CRC-32 of the id."""
    return F.col(doc_id).isNotNull() & (fold_of(doc_id) == 0)


def lower(text: Column) -> Column:
    """The text as it is tampered with: A-Z in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def manifest(docs: DataFrame, fanout: int = FANOUT, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified) of
    every row: one tree per source over its rows by ascending id, and one over
    the sources' roots. `folded_root` is folded up from the row, as tampered
    with if it is `chosen`; `verified` says whether it is the root.

    Every row is a leaf: repeated rows are leaves next to each other. Rows with
    equal ids are ordered by their digests, rows without an id come first and
    are not tampered with, and so does the tree of rows without a source. A null
    and an empty text differ. A text of any length is only ever its digest after
    the scan. Other columns are ignored, whatever their names. An empty table
    gives no rows.
    """
    doc_id, source, text = columns[0], columns[1], columns[-1]
    plain = [field(F.col(c)) for c in columns]
    # null before any text, the empty one included
    tree = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("")).alias("tree")
    rows = docs.select(F.col(doc_id).alias("doc_id"), tree, digest(*plain).alias("digest"), F.when(chosen(doc_id), digest(*plain[:-1], field(lower(F.col(text))))).alias("given"))
    # texts are read once: what follows sorts digests
    trees = grow(ranked(stored(rows, "digests"), ["doc_id", "digest"], "leaves"), "tree", fanout)
    subroots = trees.roots.select(F.lit(0).alias("tree"), F.col("tree").alias("source"), "digest")
    top = grow(ranked(subroots, ["source"], "subroots"), "top", fanout)
    nothing = top.roots.select("tree", F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    to_root = attach(top, nothing).join(top.roots.select("tree", F.col("digest").alias("root")), "tree")
    to_root = stored(to_root.select(F.col("source").alias("tree"), F.col("digest").alias("subroot"), "root", "path"), "to-root")
    # a leaf's path goes no further than its digest
    ends = attach(trees, to_root.select("tree", "path")).withColumn("given", F.coalesce("given", "digest"))
    ends = ends.select("tree", "doc_id", F.col("digest").alias("leaf"), proof().alias("proof_sha256"), fold("given").alias("folded_root"))
    out = ends.join(to_root.select("tree", "subroot", "root"), "tree").withColumn("source", F.expr("CASE WHEN tree <> '' THEN substr(tree, 2) END"))
    return out.select("doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
