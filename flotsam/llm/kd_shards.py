"""Sharding by k-d tree partitioning over row metadata."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flotsam.llm.common import key_number, row_key, running_before, text_of
from flotsam.session import materialise

CODE_BITS = 31


@dataclass
class Node:
    """A box of the tree; ``leaves`` of it are still to be cut apart. An inner node has ``dim`` and ``cut``."""
    leaves: int
    dim: int = -1
    cut: int = -1
    left: Node | None = None
    right: Node | None = None
    shard: int = -1


def string_code(c: Column) -> Column:
    """First six bytes of a string as a number: follows the order of the strings."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")


def document_dims() -> dict[str, Column]:
    """Metadata of ``documents`` that the tree may cut along."""
    return {"bytes": F.octet_length(text_of()).cast("double"), "n_chars": F.col("n_chars").cast("double"), "doc_id": F.col("doc_id").cast("double"),
            "source": string_code(F.col("source")), "lang": string_code(F.col("lang"))}


def _leaf(tree: Node, keys: list[Column], value) -> Column:
    if tree.left is None:
        return F.lit(value(tree))
    return F.when(keys[tree.dim] <= tree.cut, _leaf(tree.left, keys, value)).otherwise(_leaf(tree.right, keys, value))


def _open(tree: Node) -> list[Node]:
    if tree.left is None:
        return [tree] if tree.leaves > 1 else []
    return _open(tree.left) + _open(tree.right)


def _cuts(rows: DataFrame, keys: list[Column], tree: Node) -> None:
    """Cut every open node of the tree once: one statistics job and four histogram jobs, whatever the size.

    The weighted median of a node is found digit by digit (15 or 16 bits of the cut key each time): sums of bytes per
    node and digit are combined before the shuffle, and only rows that share the digits found so far go on.
    """
    todo = _open(tree)
    for i, n in enumerate(todo):
        n.shard = i
    d = rows.withColumn("_node", _leaf(tree, keys, lambda n: n.shard if n.leaves > 1 else -1)).where(F.col("_node") >= 0)
    dims = range(len(keys))
    for r in d.groupBy("_node").agg(*[(F.max(F.shiftright(k, 32)) - F.min(F.shiftright(k, 32))).alias(f"w{i}") for i, k in enumerate(keys)]).collect():
        todo[r["_node"]].dim = max(dims, key=lambda i: (r[f"w{i}"], -i))      # at most one row per open node
    key = F.element_at(F.array(*keys), F.element_at(F.array(*[F.lit(n.dim + 1) for n in todo]), F.col("_node") + 1))
    d = d.select("_node", "_bytes", key.alias("_k"))
    total = {r["_node"]: r["b"] for r in d.groupBy("_node").agg(F.sum("_bytes").alias("b")).collect()}
    found = {i: 0 for i in total}
    base = {i: 0 for i in total}
    for shift in (48, 32, 16, 0):
        if shift < 48:
            d = d.where(F.shiftright("_k", shift + 16) == F.element_at(F.array(*[F.lit(found.get(i, -1)).cast("bigint") for i in range(len(todo))]), F.col("_node") + 1))
        h = d.groupBy("_node", F.shiftright("_k", shift).alias("_digit")).agg(F.sum("_bytes").alias("b"))
        run = F.sum("b").over(Window.partitionBy("_node").orderBy("_digit").rowsBetween(Window.unboundedPreceding, 0))
        goal = F.element_at(F.array(*[F.lit(total.get(i, 0) * (n.leaves // 2) / n.leaves - base.get(i, 0)) for i, n in enumerate(todo)]), F.col("_node") + 1)
        over = h.withColumn("_upto", run).where(F.col("_upto") >= goal)
        for r in over.groupBy("_node").agg(F.min(F.struct("_digit", "_upto", "b")).alias("x")).collect():
            found[r["_node"]] = r["x"]["_digit"]
            base[r["_node"]] += r["x"]["_upto"] - r["x"]["b"]
    for i, n in enumerate(todo):
        n.cut = found.get(i, 0)
        n.left, n.right = Node(n.leaves // 2), Node(n.leaves - n.leaves // 2)


def kd_shards(rows: DataFrame, dims: list[str], size: str, leaves: int) -> tuple[DataFrame, Node]:
    """``rows`` with ``shard`` 0 .. leaves-1 and ``slot`` (gapless from 0 in every shard), and the tree.

    ``rows`` must hold numeric columns ``dims`` (null sorts first), ``size`` and ``_key32``, a number spread evenly over
    32 bits. A box that stands for k leaves is cut along its widest dimension (its extent as a share of the table's)
    where its bytes are parted as k//2 to k - k//2. Ties of the dimension are parted by ``_key32``, so a value that a
    third of all rows share is cut like any other. The tree has at most 2 * leaves nodes and is an expression
    of the metadata: new rows are placed without a join.
    """
    spans = rows.agg(*[f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)]).first()
    keys = []
    for d in dims:
        lo, hi = spans[f"min_{d}"], spans[f"max_{d}"]
        code = F.lit(0).cast("bigint")
        if lo is not None and hi > lo:
            code = F.coalesce(F.floor((F.col(d) - lo) / (hi - lo) * (2 ** CODE_BITS - 2)).cast("bigint") + 1, F.lit(0))
        keys.append(F.shiftleft(code, 32) + F.col("_key32"))
    names = [f"_k{i}" for i in range(len(dims))]
    thin = materialise(rows.select(*[k.alias(n) for k, n in zip(keys, names)], F.col(size).alias("_bytes")))
    tree = Node(leaves)
    while _open(tree):
        _cuts(thin, [F.col(n) for n in names], tree)
    numbers = iter(range(leaves))
    stack = [tree]
    while stack:
        n = stack.pop()
        if n.left is None:
            n.shard = next(numbers)
        else:
            stack += [n.right, n.left]
    placed = rows.withColumn("shard", _leaf(tree, keys, lambda n: n.shard))
    return placed, tree


def shard_documents(docs: DataFrame, target_bytes: int | None = None, leaves: int | None = None, overhead: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every document; give the wanted bytes of a shard or their number.

    Size: UTF-8 bytes of the text plus ``overhead``. Null text has no bytes and crc32 0; null metadata sorts before all
    values; repeated rows are rows like all others and get slots of their own. A table without rows gives no rows.
    Other columns are ignored.
    """
    rows = docs.select("doc_id", (F.octet_length(text_of()) + overhead).cast("bigint").alias("size"), F.crc32(F.encode(text_of(), "UTF-8")).alias("text_crc32"),
                       row_key().alias("_key"), *[c.alias(f"_dim_{n}") for n, c in document_dims().items()])
    rows = materialise(rows.withColumn("_key32", key_number(F.col("_key"))))
    if leaves is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        leaves = max(1, -(-total // target_bytes))
    placed, _ = kd_shards(rows, [f"_dim_{n}" for n in document_dims()], "size", leaves)
    placed = placed.select("doc_id", "size", "text_crc32", "shard", "_key", "_key32", F.lit(1).cast("bigint").alias("_one"))
    return running_before(placed, ["shard"], "_key32", ["_key"], {"slot": "_one"}).select("doc_id", "size", "text_crc32", "shard", "slot")
