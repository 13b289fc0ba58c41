"""Merkle manifest of a dataset: leaves per source, a tree of 16 children over each source and over all sources.

Every level is one table of nodes (tree, place, hash). Windows give each node its neighbours by fixed offsets: lag and
lead 1 to 15, masked by the node's slot in its run of 16 and by the run's length. The first child of a run hashes the
run into the parent, which makes the next level's table. A path is what stands before and after a node on each level up
to the root; folding a leaf along its path gives the root again.

A window holds one run, and the order within a source comes from ranges (`operators.ordered`), so no task and no window
holds a source. Each level is a written table of a sixteenth of the rows below it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelwright.operators.ordered import positions
from panelwright.session import stage

FANOUT = 16
#: Rows in a range when leaves are put in order; no more ranges than shuffle partitions, unless they would be too long.
RANGE_ROWS = 4_096
LONGEST_RANGE = 1_000_000
TAMPER_EVERY = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def tampered_text(text: Column) -> Column:
    """A-Z lower-cased; nulls stay."""
    return F.translate(text, UPPER, LOWER)


def tree_key(source: Column) -> Column:
    """Sorts as null first, then bytewise; never null."""
    return F.coalesce(F.concat(F.lit("+"), source.cast("string")), F.lit(""))


def range_number(df: DataFrame) -> int:
    """Parallel ranges for a table, from its row count alone."""
    rows = df.count()
    wide = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, -(-rows // LONGEST_RANGE), min(wide, -(-rows // RANGE_ROWS)))


def with_siblings(nodes: DataFrame) -> DataFrame:
    """nodes: (tree, at, h, ...), `at` from 0 without gaps in each tree. Adds run, slot, width, before and after.

    before and after are the hashes of the run's other nodes, left to right, joined without a mark.
    """
    placed = nodes.withColumns({"run": F.floor(F.col("at") / FANOUT), "slot": (F.col("at") % FANOUT).cast("int")})
    near, offsets = Window.partitionBy("tree", "run").orderBy("at"), range(1, FANOUT)
    columns = {f"_l{k}": F.lag("h", k).over(near) for k in offsets} | {f"_r{k}": F.lead("h", k).over(near) for k in offsets}
    seen = placed.withColumns(columns).withColumn("width", F.count("*").over(Window.partitionBy("tree", "run")))
    before = F.concat(*[F.when(F.col("slot") >= k, F.col(f"_l{k}")).otherwise("") for k in reversed(offsets)])
    after = F.concat(*[F.when(F.col("slot") + k < F.col("width"), F.col(f"_r{k}")).otherwise("") for k in offsets])
    return seen.select(*nodes.columns, "run", "slot", "width", before.alias("before"), after.alias("after"))


def alone() -> Column:
    """The tree has one node on this level: its first run has length 1."""
    return (F.col("run") == 0) & (F.col("width") == 1)


def parents(siblings: DataFrame) -> DataFrame:
    """First children hash their runs; trees that have come down to one node do not go on."""
    return siblings.where((F.col("slot") == 0) & ~alone()).select("tree", F.col("run").alias("at"), F.sha2(F.concat("h", "after"), 256).alias("h"))


def levels(leaves: DataFrame) -> list[DataFrame]:
    """Node tables from the leaves up, until no tree has more than one node; log16 of the largest tree of them."""
    found = [leaves.select("tree", "at", "h")]
    while True:
        above = stage(parents(with_siblings(found[-1])))
        if above.isEmpty():
            return found
        found.append(above)


def tops(nodes: list[DataFrame]) -> DataFrame:
    """(tree, h): the last node of every tree, on whichever level it comes down to one."""
    single = lambda n: n.groupBy("tree").agg(F.max("at").alias("_last")).where("_last = 0").select("tree")
    return reduce(DataFrame.unionByName, [n.where("at = 0").select("tree", "h").join(single(n), "tree") for n in nodes])


def paths(nodes: list[DataFrame], starts: DataFrame) -> DataFrame:
    """The rows of nodes[0] with the columns of starts. starts: (tree, ..., path) of the trees' last nodes.

    path lists what stands before and after on each level with more than one node, lowest level first. The windows and
    the join of a level share one exchange by (tree, run).
    """
    extra, known = [c for c in starts.columns if c not in ("tree", "path")], None
    for level in reversed(nodes):
        around = with_siblings(level)
        found = around.where(alone()).join(starts, "tree").select(*level.columns, *extra, "path")
        if known is not None:
            above = known.select(F.col("tree").alias("_tree"), F.col("at").alias("_run"), *extra, "path")
            under = around.where(~alone()).join(above, (F.col("tree") == F.col("_tree")) & (F.col("run") == F.col("_run")))
            here = F.concat(F.array(F.struct("before", "after")), F.col("path"))
            found = found.unionByName(under.select(*level.columns, *extra, here.alias("path")))
        known = found if level is nodes[0] else stage(found)
    return known


def folded(start: Column, path: Column) -> Column:
    """The hash that a node leads to along its path."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def proof_hash(path: Column) -> Column:
    return F.sha2(F.aggregate(path, F.lit(""), lambda text, s: F.concat(text, s["before"], s["after"])), 256)


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf covers `fields` in that order; leaves ascend by id within a group, null ids first, rows that repeat an id by
    their leaf. Null values are `-` in the leaf, an empty text is `0:`, long texts are hashed whole. Null groups are a
    tree of their own, before all others. Every document whose crc32 of the id is a multiple of TAMPER_EVERY (never a
    null id) is folded from a leaf with its text's A-Z lower-cased. An empty table gives no rows; columns of other
    names are not read.
    """
    mapped = dict.fromkeys(fields)
    original = leaf_hash([F.col(f) for f in mapped])
    changed = leaf_hash([tampered_text(F.col(f)) if f == text_col else F.col(f) for f in mapped])
    tampers = F.crc32(F.col(id_col).cast("string")) % TAMPER_EVERY == 0
    hashed = stage(docs.select(F.col(id_col).alias("doc_id"), tree_key(F.col(group_col)).alias("tree"), original.alias("h"), F.when(tampers, changed).alias("changed")))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h").asc()]
    leaves = stage(positions(hashed, ["tree"], order, "at", range_number(hashed)))

    nodes = levels(leaves)
    groups = stage(tops(nodes).select(F.lit("").alias("all"), "tree", "h"))
    order = positions(groups, ["all"], [F.col("tree").asc()], "at", range_number(groups))
    ranked = stage(order.select(F.col("all").alias("tree"), "at", "h", F.col("tree").alias("group")))
    upper = levels(ranked)
    nothing = F.array().cast("array<struct<before:string,after:string>>")
    top = paths([ranked, *upper[1:]], tops(upper).select("tree", F.col("h").alias("root"), nothing.alias("path")))
    starts = stage(top.select(F.col("group").alias("tree"), F.col("h").alias("subroot"), "root", "path"))

    found = paths([leaves, *nodes[1:]], starts)
    return found.select(
        F.col("doc_id").alias(id_col), F.col("h").alias("leaf"), "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("changed", "h"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
