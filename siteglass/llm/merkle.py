"""Merkle manifest of a dataset, with an inclusion proof for every row.

Rows are leaves, in groups ordered by group and id. Leaves are appended to their group's
tree one after the other. Each leaf holds a witness: the siblings on its way up, as far as
they are complete. While a subtree is open, the witnesses of its leaves wait; as soon as its
sibling completes, both sides' witnesses grow by one step.

A group is cut into aligned blocks of ``2**BLOCK_LEVELS`` leaves. Tasks append the leaves of
whole blocks as they stream by, and give each leaf its witness up to the block's root. The
block roots are appended in turn as leaves of the next level, until one node per group is
left; the groups' roots at last are appended like leaves too. A leaf's whole witness is that
of its block followed by that of the block's root. No task ever holds more than one block,
and a group of any share of the rows is spread by its blocks. Positions come from a range
sort and the row count of its partitions, so no group is ever sorted as one.

Nodes: every two consecutive nodes become sha256 of their two lowercase hex digests joined;
a last node without partner becomes sha256 of its own digest alone.

Odd rows: null fields are ``-``; null ids come first, a null group comes first and is a group
of its own; rows with the same id and group are ordered by their leaf, and equal rows are a
leaf each. A null id is never tampered with. An empty table gives no rows, a single row has
an empty proof. Columns other than the fields are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, stored

#: Levels that one task completes: blocks of 1024 nodes.
BLOCK_LEVELS = 10
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]

#: A step up: the digest to the left of the node, or to its right, or neither.
_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])
_PATH = "path array<struct<left: string, right: string>>"


def field_text(c: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field_text(c) for c in fields]), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


class Witnesses:
    """A tree that grows by appended digests and keeps a witness for each of them.

    ``open_at[k]`` is the complete subtree of ``2**k`` nodes that waits for a sibling, with
    the places of its first leaf and of the end. Its leaves' witnesses are extended when the
    sibling completes.
    """

    def __init__(self):
        self.paths: list[list[dict]] = []
        self.open_at: dict[int, tuple[str, int, int]] = {}

    def append(self, digest: str) -> None:
        place = len(self.paths)
        self.paths.append([])
        self._completed(0, digest, place, place + 1)

    def _extend(self, start: int, end: int, left: str | None, right: str | None) -> None:
        step = {"left": left, "right": right}
        for path in self.paths[start:end]:
            path.append(step)

    def _completed(self, level: int, digest: str, start: int, end: int) -> None:
        """A subtree is complete: join it to the open sibling, or leave it open."""
        while level in self.open_at:
            sibling, first, middle = self.open_at.pop(level)
            self._extend(first, middle, None, digest)
            self._extend(start, end, sibling, None)
            digest, start, level = _hash(sibling + digest), first, level + 1
        self.open_at[level] = (digest, start, end)

    def close(self, levels: int | None = None) -> str:
        """The root once nothing more comes.

        Open subtrees climb without a partner. With ``levels`` the climb goes on to that
        level even when one node is left, as for a block among others.
        """
        while True:
            level = min(self.open_at)
            digest, start, end = self.open_at[level]
            if levels is None and len(self.open_at) == 1 or level == levels:
                return digest
            del self.open_at[level]
            self._extend(start, end, None, None)
            self._completed(level + 1, _hash(digest), start, end)


def _append_blocks(
    tables: Iterator[pa.RecordBatch], levels: int, names: list[str]
) -> Iterator[pa.RecordBatch]:
    """Streams nodes sorted by (grp, block, pos); gives each its path, the first one the root."""
    now, tree, held, kind = None, Witnesses(), [], None

    def flushed() -> pa.RecordBatch:
        grp, block, several = now
        root = tree.close(levels if several else None)
        n = len(held)
        columns = [
            pa.array([grp] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array(held, kind),
            pa.array(tree.paths, pa.list_(_STEP)), pa.array([root] + [None] * (n - 1), pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    for table in tables:
        kind = table["row"].type
        columns = [table[c].to_pylist() for c in ("grp", "block", "several", "row", "node")]
        for grp, block, several, row, node in zip(*columns):
            if (grp, block, several) != now:
                if held:
                    yield flushed()
                now, tree, held = (grp, block, several), Witnesses(), []
            tree.append(node)
            held.append(row)
    if held:
        yield flushed()


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """grp, block, row, path, root (at each block's first row) of nodes grp, pos, n, node, row."""
    block = F.shiftright("pos", levels)
    placed = nodes.select(
        "grp", "pos", "node", "row", block.alias("block"), (F.col("n") > (1 << levels)).alias("several")
    )
    dealt = placed.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")
    row = placed.schema["row"].dataType.simpleString()
    schema = f"grp string, block long, row {row}, {_PATH}, root string"
    names = ["grp", "block", "row", "path", "root"]
    return dealt.mapInArrow(lambda tables: _append_blocks(tables, levels, names), schema)


def numbered(rows: DataFrame, grp: Column, order: list[str]) -> DataFrame:
    """Adds grp, pos (from 0 in the order of the columns ``order``) and n (of the group).

    Rows are range-sorted; a row's place is its place in its partition plus the sizes of the
    partitions before. Only counts by partition and group are summed up along the order.
    Equal rows are told apart by their place in the stored table, so no run of them is too
    long for a task.
    """
    given = stored(rows.withColumns({"grp": grp, "_id": F.monotonically_increasing_id()}), "rows")
    by = ["grp", *order, "_id"]
    sorted_rows = given.repartitionByRange(*by).sortWithinPartitions(*by).drop("_id")
    placed = {"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}
    slices = stored(sorted_rows.withColumns(placed), "leaves")
    discard(given)
    along = Window.partitionBy("grp").orderBy("_part")
    sizes = slices.groupBy("grp", "_part").agg(F.count("*").alias("_size"), F.min("_at").alias("_start"))
    sizes = sizes.select(
        "grp", "_part", "_start",
        (F.sum("_size").over(along) - F.col("_size")).alias("_before"),
        F.sum("_size").over(Window.partitionBy("grp")).alias("n"),
    )
    pos = F.col("_at") - F.col("_start") + F.col("_before")
    return slices.join(sizes, ["grp", "_part"]).withColumn("pos", pos).drop("_part", "_at", "_start", "_before")


def _grown(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Stored witnesses by rising level of blocks, and the root of each group (grp, node)."""
    tables = []
    while True:
        tables.append(stored(_blocks(nodes, levels), "witnesses"))
        roots = tables[-1].where("root is not null")
        roots = roots.select("grp", F.col("block").alias("pos"), F.col("root").alias("node"))
        if roots.where("pos > 0").isEmpty():
            return tables, roots.select("grp", "node")
        sizes = roots.groupBy("grp").agg(F.count("*").alias("n"))
        nodes = roots.join(sizes, "grp").withColumn("row", F.col("pos"))


def _whole_paths(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """row, path and the columns of ``above`` (grp, path, ...) for the lowest nodes."""
    more = [c for c in above.columns if c not in ("grp", "path")]
    above = above.withColumnRenamed("path", "_on")
    keys = ["grp"]
    for table in reversed(tables):
        joined = table.drop("root").join(above, keys)
        paths = joined.select("grp", "row", F.concat("path", "_on").alias("path"), *more)
        above = paths.withColumnsRenamed({"row": "block", "path": "_on"})
        keys = ["grp", "block"]
    return paths


def _joined(step: Column, node: Column) -> Column:
    return F.concat(F.coalesce(step["left"], F.lit("")), node, F.coalesce(step["right"], F.lit("")))


def folded(node: Column, path: Column) -> Column:
    """The root that a node and its witness lead to."""
    return F.aggregate(path, node, lambda at, step: F.sha2(_joined(step, at), 256))


def proof_digest(path: Column) -> Column:
    """sha256 of the siblings, in order from the leaf up."""
    siblings = F.transform(path, lambda s: F.coalesce(s["left"], s["right"], F.lit("")))
    return F.sha2(F.array_join(siblings, ""), 256)


def manifest(
    docs: DataFrame,
    fields: list[str] | None = None,
    group: str = "lang",
    order: str = "doc_id",
    claims: dict[str, Column] | None = None,
    levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """``order``, leaf, claim, path (the witness), subroot and root of every row.

    ``claim`` is the leaf with fields replaced by the columns of ``claims``, the leaf itself
    without any. Folding it with the path verifies a row that may have changed.
    """
    fields = fields or FIELDS
    at = {name: F.col(f"`{name}`") for name in fields}
    leaf = leaf_digest(list(at.values()))
    rows = docs.select(
        at[order].alias("id"),
        F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("")).alias("_group"),
        leaf.alias("leaf"),
        (leaf_digest([claims.get(n, c) for n, c in at.items()]) if claims else leaf).alias("claim"),
    )
    leaves = numbered(rows, F.col("_group"), ["id", "leaf", "claim"])
    leaves = leaves.select("grp", "pos", "n", F.col("leaf").alias("node"), F.struct("id", "leaf", "claim").alias("row"))
    tables, subroots = _grown(leaves, levels)
    subroots = subroots.select(F.col("grp").alias("row"), "node")
    nodes = numbered(subroots, F.lit(""), ["row"])
    top_tables, root = _grown(nodes, levels)
    end = root.select("grp", F.array().cast(_PATH.partition(" ")[2]).alias("path"), F.col("node").alias("root"))
    tops = _whole_paths(top_tables, end).select(F.col("row").alias("grp"), "path", "root")
    above = tops.join(subroots.select(F.col("row").alias("grp"), F.col("node").alias("subroot")), "grp")
    paths = _whole_paths(tables, above)
    return paths.select(F.col("row.id").alias(order), "row.leaf", "row.claim", "path", "subroot", "root")


def verified(rows: DataFrame) -> DataFrame:
    """Adds proof_sha256, folded_root and verified to rows of ``manifest``."""
    done = rows.withColumn("folded_root", folded(F.col("claim"), F.col("path")))
    return done.withColumns(
        {"proof_sha256": proof_digest(F.col("path")), "verified": F.col("folded_root") == F.col("root")}
    )
