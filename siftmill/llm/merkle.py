"""Merkle manifest of a table of documents that stores only every few levels.

Documents of a source are the leaves of its tree, the roots of the trees are the
leaves of one more. A tree is cut into aligned subtrees of ``STRIDE`` levels.
Stored are the nodes at their borders; what lies between is recomputed from
the stored nodes below whenever a proof needs it, and thrown away again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.session import written

ARITY = 3
STRIDE = 3  # levels from one stored level to the next
FIELDS = ("source", "lang", "n_chars", "text")

_STEP = "struct<left:string,right:string>"


def digest(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of the fields: ``-`` for null, else UTF-8 byte count, colon, value."""
    values = [field.cast("string") for field in fields]
    shown = [F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")) for value in values]
    return F.sha2(F.concat(*shown), 256)


def tree_key(source: Column) -> Column:
    """A source as a key without nulls that sorts as sources do: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def leaves(docs: DataFrame, *, tampered: Column | None = None, id_col: str = "doc_id", text_col: str = "text", fields: Sequence[str] = FIELDS) -> DataFrame:
    """doc_id, tree, node (the leaf's digest) and changed, the digest with the text ``tampered``, or null."""

    def of(text: Column) -> Column:
        return digest(F.col(id_col), *[text if name == text_col else F.col(name) for name in fields])

    changed = F.lit(None).cast("string")
    if tampered is not None:
        changed = F.when(~tampered.eqNullSafe(F.col(text_col)), of(tampered))
    return docs.select(F.col(id_col).alias("doc_id"), tree_key(F.col("source")).alias("tree"), of(F.col(text_col)).alias("node"), changed.alias("changed"))


def numbered(nodes: DataFrame, order: Sequence[str], purpose: str) -> DataFrame:
    """The rows with idx, their place within their tree in ``order``, and height, the levels of that tree.

    The table is sorted by ranges, so that rows of a hot tree lie in many tasks,
    and written with a running number. One small row per task and tree then
    tells how many rows of the tree lie before. Rows equal in ``order`` are told
    apart by where they were read, so that repeated rows spread over tasks too.
    """
    given = nodes.withColumn("_read", F.monotonically_increasing_id())
    by = ["tree", *order, "_read"]
    placed = written(given.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).drop("_read"), purpose)
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    of_tree = Window.partitionBy("tree")
    before = of_tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy("_part", "tree").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    runs = runs.select(
        "_part",
        "tree",
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        height(F.sum("_rows").over(of_tree)).alias("height"),
    )
    return placed.join(runs, ["_part", "tree"]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def height(n: Column) -> Column:
    """Levels above the leaves until one node remains."""
    powers = F.array(*[F.lit(ARITY**level).cast("bigint") for level in range(39)])
    return F.size(F.filter(powers, lambda power: power < n))


def _above(nodes: Column) -> Column:
    """Digests of every ``ARITY`` consecutive nodes; the last run may be shorter."""
    last = F.floor((F.size(nodes) - 1) / ARITY).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda run: F.sha2(F.array_join(F.slice(nodes, run * ARITY + 1, ARITY), ""), 256))


def _subtrees(nodes: DataFrame, level: int, extra: Sequence[str] = ()) -> DataFrame:
    """One row per aligned subtree: tree, height, block, steps, members in order (``ARITY`` to the power of ``STRIDE`` at most)."""
    width = ARITY**STRIDE
    member = F.struct((F.col("idx") % width).alias("at"), "node", *extra)
    grouped = nodes.groupBy("tree", "height", F.expr(f"idx div {width}").alias("block")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    return grouped.withColumn("steps", F.least(F.lit(STRIDE), F.col("height") - level))


class Forest:
    """Stored levels of many trees: leaves, and nodes every ``STRIDE`` levels above.

    ``stored[j]`` holds the subtrees whose lowest nodes are at level j · STRIDE;
    ``roots`` has tree, node. Each stored level is made from the one below by
    groups of at most ``ARITY`` ** ``STRIDE`` nodes, so no tree meets in one task.
    """

    def __init__(self, numbered_leaves: DataFrame, purpose: str, extra: Sequence[str] = ()):
        self.stored: list[DataFrame] = []
        finished: list[DataFrame] = []
        nodes, level = numbered_leaves, 0
        while True:
            kept = written(_subtrees(nodes, level, extra if level == 0 else ()), f"{purpose}-{level}")
            self.stored.append(kept)
            members = F.transform("members", lambda m: m["node"])
            tops = kept.withColumn("a0", members)
            for step in range(1, STRIDE + 1):  # one projection a level keeps the expressions small
                tops = tops.withColumn(f"a{step}", F.when(F.col("steps") >= step, _above(F.col(f"a{step - 1}"))).otherwise(F.col(f"a{step - 1}")))
            tops = tops.select("tree", "height", F.col("block").alias("idx"), F.col(f"a{STRIDE}")[0].alias("node"))
            level += STRIDE
            finished.append(tops.filter(F.col("height") <= level).select("tree", "node"))
            nodes = tops.filter(F.col("height") > level)
            tallest = kept.agg(F.max("height")).first()[0]
            if tallest is None or tallest <= level:
                break
        self.roots = reduce(DataFrame.unionByName, finished)

    def paths(self, tops: DataFrame | None, level: int, purpose: str) -> DataFrame:
        """Subtrees of a stored level with ``path``, the steps from their top to the root of all.

        ``tops`` has tree, path and what else every leaf shall have, for the
        root of each tree; without it the only tree's root is the root of all.
        Levels are walked from the top: members of the subtrees above are the
        tops of those below.
        """
        here = self.stored[level].withColumn("_last", F.col("height") <= (level + 1) * STRIDE)
        above = None
        if level + 1 < len(self.stored):
            higher = with_steps(self.paths(tops, level + 1, purpose), [])
            higher = higher.withColumn("block", F.col("idx")).withColumn("_last", F.lit(False)).drop("idx", "node", "height")
            above = written(higher, f"{purpose}-paths")
        if tops is not None:
            ends = tops.withColumn("block", F.lit(0).cast("bigint")).withColumn("_last", F.lit(True))
            above = ends if above is None else above.unionByName(ends)
        if above is None:
            return here.withColumn("path", F.array().cast(f"array<{_STEP}>")).drop("_last")
        return here.join(above, ["tree", "block", "_last"]).drop("_last")


def with_steps(subtrees: DataFrame, extra: Sequence[str]) -> DataFrame:
    """One row per member of subtrees with a path: tree, height, idx, node, path and the rest.

    A step is what stands left and right of a node among its siblings. The
    levels between the stored ones are recomputed here, in the row, and dropped.
    """
    rows = subtrees.withColumn("a0", F.transform("members", lambda m: m["node"]))
    for step in range(1, STRIDE):
        rows = rows.withColumn(f"a{step}", F.when(F.col("steps") > step, _above(F.col(f"a{step - 1}"))).otherwise(F.lit(None)))
    rows = rows.withColumn("member", F.explode("members"))
    steps = []
    for step in range(STRIDE):
        nodes = F.col(f"a{step}")
        place = F.expr(f"cast(member.at div {ARITY**step} as int)")
        first = place - place % ARITY
        left = F.array_join(F.slice(nodes, first + 1, place - first), "")
        right = F.array_join(F.slice(nodes, place + 2, first + ARITY - 1 - place), "")
        steps.append(F.when(F.col("steps") > step, F.array(F.struct(left.alias("left"), right.alias("right")))).otherwise(F.array().cast(f"array<{_STEP}>")))
    width = ARITY**STRIDE
    kept = [c for c in subtrees.columns if c not in ("members", "steps", "block", "path")]
    return rows.select(
        *kept,
        (F.col("block") * width + F.col("member.at")).alias("idx"),
        F.col("member.node").alias("node"),
        *[F.col(f"member.{name}").alias(name) for name in extra],
        F.concat(*steps, F.col("path")).alias("path"),
    )


def proof_text(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of a path give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def manifest(docs: DataFrame, *, tampered: Column | None = None, id_col: str = "doc_id", text_col: str = "text", fields: Sequence[str] = FIELDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, path, folded_root, verified.

    A leaf is the digest of the id and ``fields``. Leaves of a source ascend by
    id; every three consecutive nodes become one until one remains, the subroot.
    Subroots, ordered by source, give the root likewise. ``path`` holds the
    siblings left and right at every level; ``folded_root`` is what leaf and
    path give, with the leaf of the text ``tampered`` where that differs from
    the text. ``verified`` says whether it is the root.

    Nulls are values of their own: a null id comes first, a null source is a
    source, null fields count as ``-``. Empty and very long texts are
    hashed whole. Rows that repeat an id follow each other by digest, equal
    rows in any order, as they give the same leaves. An empty table gives an
    empty result. Other columns are not looked at.
    """
    made = written(leaves(docs, tampered=tampered, id_col=id_col, text_col=text_col, fields=fields), "merkle-leaves")
    ordered = numbered(made, ["doc_id", "node"], "merkle-sorted")
    forest = Forest(ordered, "merkle", ["doc_id", "changed"])
    subroots = written(forest.roots, "merkle-subroots")
    # the tree of subroots: its leaves are numbered by their source
    upper = Forest(_one_tree(subroots), "merkle-top", ["source"])
    row = upper.roots.first()
    root = F.lit(row["node"] if row else None).cast("string")
    sources = with_steps(upper.paths(None, 0, "merkle-top"), ["source"]).select(F.col("source").alias("tree"), F.col("node").alias("subroot"), "path")
    rows = with_steps(forest.paths(written(sources, "merkle-tops"), 0, "merkle"), ["doc_id", "changed"])
    rows = rows.select("doc_id", F.col("node").alias("leaf"), "subroot", root.alias("root"), "path", fold(F.coalesce("changed", "node"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _one_tree(subroots: DataFrame) -> DataFrame:
    whole = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "node")
    return numbered(whole, ["source"], "merkle-sources")
