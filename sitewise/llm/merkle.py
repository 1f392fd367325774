"""Merkle manifest of a table: a persistent tree per source, built in aligned blocks, with path-copied versions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.llm.common import settle

FANOUT = 3
HEIGHT = 6  # levels a block of leaves is folded in one task
BLOCK = FANOUT**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """Lower-case hex sha256 of the fields in order: '-' for null, else the length in UTF-8 bytes, ':' and the value."""
    coded = []
    for field in fields:
        text = field.cast("string")
        coded.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*coded).cast("binary"), 256)


@dataclass
class PersistentBlock:
    """An immutable tree over the consecutive nodes of one aligned block.

    levels: digests by level, the given nodes first. `lone` says that the block is all of its tree,
    which then stops at its single top; every other block has HEIGHT levels above the nodes, so the
    last, shorter one lines up with the rest.
    """

    levels: list[list[str]]

    @staticmethod
    def build(nodes: list[str], lone: bool) -> "PersistentBlock":
        levels = [nodes]
        while len(levels[-1]) > 1 if lone else len(levels) <= HEIGHT:
            below = levels[-1]
            levels.append([digest(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
        return PersistentBlock(levels)

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def path(self, at: int) -> list[tuple[str, str]]:
        """(digests left of, digests right of) the node and each of its ancestors but the top."""
        out = []
        for nodes in self.levels[:-1]:
            first = at - at % FANOUT
            out.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + FANOUT])))
            at //= FANOUT
        return out


def copied(node: str, path: list[tuple[str, str]]) -> list[str]:
    """New digests of the ancestors of a replaced node; the siblings along the path are the shared ones."""
    out = []
    for left, right in path:
        node = digest([left, node, right])
        out.append(node)
    return out


def pack_path(path: list[tuple[str, str]]) -> bytes:
    """A path as bytes: per level one byte (nodes to the left * FANOUT + nodes to the right) and the digests."""
    return b"".join(
        bytes([len(left) // 64 * FANOUT + len(right) // 64]) + bytes.fromhex(left + right) for left, right in path
    )


def unpack_path(packed: bytes) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(packed):
        n_left, n_right = divmod(packed[at], FANOUT)
        middle, end = at + 1 + 32 * n_left, at + 1 + 32 * (n_left + n_right)
        out.append((packed[at + 1 : middle].hex(), packed[middle:end].hex()))
        at = end
    return out


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with pos, their place (from 0) in their tree, and n, the tree's rows.

    One range sort over all trees, so a tree that holds most rows spans many partitions; what is
    counted beside it is one row per tree and partition.
    """
    ordered = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ordered = settle(ordered.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    parts = settle(ordered.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("m")))
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.groupBy("part").agg(F.sum("m").alias("size"), F.min("first").alias("low"))  # one row per partition
    starts = starts.select("part", (F.coalesce(before, F.lit(0)) - F.col("low")).alias("shift"))
    spans = parts.join(starts, "part").withColumn("shift", F.col("shift").cast("bigint"))
    trees = spans.groupBy("tree").agg(F.min(F.col("first") + F.col("shift")).alias("start"), F.sum("m").alias("n"))
    spans = spans.join(trees, "tree").select("tree", "part", (F.col("shift") - F.col("start")).alias("shift"), "n")
    return ordered.join(spans, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _fold(nodes: DataFrame, carry: str = "") -> DataFrame:
    """nodes: tree, pos, n, node, changed (null: unchanged), and the columns of the DDL string `carry`.

    Adds path, the way up inside the node's aligned block, top, the block's top node, and version,
    the top of the version that has `changed` in the node's place. A task sees one block at a time.
    """
    kept = [x.split()[0] for x in carry.split(",") if x]
    schema = f"tree string, pos long, n long, node string, changed string, path binary, top string, version string{',' * bool(kept)}{carry}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names = None, [f.split()[0] for f in schema.split(",")]

        def blocks(rows: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
            """What is ready: every block that a later one follows, or all of them at the end."""
            at, pos = rows.column("tree").to_pylist(), rows.column("pos").to_pylist()
            cuts = [i for i in range(len(pos)) if not i or at[i] != at[i - 1] or pos[i] // BLOCK != pos[i - 1] // BLOCK]
            ends = [*cuts[1:], len(pos)] if last else cuts[1:]
            out = []
            node, sizes, changed = (rows.column(c).to_pylist() for c in ("node", "n", "changed"))
            paths, tops, versions = [], [], []
            for a, b in zip(cuts, ends, strict=False):
                block = PersistentBlock.build(node[a:b], sizes[a] <= BLOCK)
                for i in range(a, b):
                    path = block.path(i - a)
                    paths.append(pack_path(path))
                    tops.append(block.top)
                    versions.append(None if changed[i] is None else [changed[i], *copied(changed[i], path)][-1])
            if paths:
                ready = rows.slice(0, len(paths))
                ready = ready.append_column("path", pa.array(paths, pa.binary())).append_column("top", pa.array(tops, pa.string()))
                out = ready.append_column("version", pa.array(versions, pa.string())).select(names).combine_chunks().to_batches()
            return out, rows.slice(len(paths))

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            ready, held = blocks(pa.concat_tables([held, rows]) if held is not None else rows, False)
            yield from ready
        if held is not None:
            yield from blocks(held, True)[0]

    block = F.floor(F.col("pos") / BLOCK)
    grouped = nodes.withColumn("block", block).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    return grouped.select("tree", "pos", "n", "node", "changed", *kept).mapInArrow(run, schema)


def _tree(nodes: DataFrame, carry: str = "") -> tuple[DataFrame, DataFrame]:
    """(nodes folded in their blocks, way from each block up: tree, block, upper, root) of placed nodes."""
    rounds = [settle(_fold(nodes, carry))]
    while True:
        heads = rounds[-1].where((F.col("pos") % BLOCK == 0) & (F.col("n") > BLOCK))
        if heads.isEmpty():
            break
        up = heads.select(
            "tree", F.expr(f"pos div {BLOCK}").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("node"),
            F.lit(None).cast("string").alias("changed"),
        )
        rounds.append(settle(_fold(up)))
    none = F.lit(b"")
    above = None
    for folded in reversed(rounds[1:]):
        here = folded.select("tree", "pos", "path", "top", F.expr(f"pos div {BLOCK}").alias("block"))
        if above is not None:
            here = here.join(above, ["tree", "block"], "left")
        else:
            here = here.withColumns({"upper": none, "root": F.lit(None).cast("string")})
        above = here.select(
            "tree", F.col("pos").alias("block"), F.concat("path", F.coalesce("upper", none)).alias("upper"), F.coalesce("root", "top").alias("root")
        )
    blocks = rounds[0].where(F.col("pos") % BLOCK == 0).select("tree", F.expr(f"pos div {BLOCK}").alias("block"), "top")
    if above is None:
        return rounds[0], blocks.select("tree", "block", none.alias("upper"), F.col("top").alias("root"))
    joined = blocks.join(above, ["tree", "block"], "left")
    return rounds[0], joined.select("tree", "block", F.coalesce("upper", none).alias("upper"), F.coalesce("root", "top").alias("root"))


def manifest(docs: DataFrame, tampered: Column | None = None, changed_text: Column | None = None, with_nodes: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves of a source ascend by doc_id (null first), equal ids by leaf; sources by UTF-8 bytes, null
    first. Each leaf for which `tampered` holds makes a version of the tree in which its text is
    `changed_text`: inside its aligned block of 3^6 leaves only its ancestors are copied, and the
    version goes on from the block's top along the blocks above it, in the task that holds the row.
    folded_root is that version's root, or the root folded anew from an untampered leaf. With
    with_nodes, `copied` lists the digests of the copied nodes, lowest first (none if untampered).

    Null fields are '-'; an empty text is '0:'. Rows that are equal in all five fields are equal
    leaves, each with its own place. Columns other than those five are ignored; an empty table
    gives no rows. A task holds one block at a time whatever the size of a source.
    """
    fields = [F.col(c) for c in FIELDS]
    source = F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit(""))  # sorts as the sources do, null first
    broken = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    replaced = leaf_digest([*fields[:-1], changed_text if changed_text is not None else fields[-1]])
    kind = docs.schema["doc_id"].dataType.simpleString()
    leaves = settle(docs.select("doc_id", source.alias("tree"), leaf_digest(fields).alias("node"), F.when(broken, replaced).alias("changed")))
    folded, blocks = _tree(_placed(leaves, ["doc_id", "node"]), f" doc_id {kind}")
    blocks = settle(blocks)
    subroots = blocks.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("node"))
    tops, above = _tree(_placed(subroots, ["name"]).withColumn("changed", F.lit(None).cast("string")), " name string")
    tops = tops.withColumn("block", F.expr(f"pos div {BLOCK}")).join(above, ["tree", "block"])
    tops = tops.select(F.col("name").alias("tree"), F.concat("path", "upper").alias("way"), F.col("root").alias("whole"))
    ways = blocks.join(tops, "tree").select(
        "tree", "block", F.concat("upper", "way").alias("upper"), F.col("root").alias("subroot"), F.col("whole").alias("root")
    )
    rows = folded.withColumn("block", F.expr(f"pos div {BLOCK}")).join(ways, ["tree", "block"])

    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, copied array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            proofs, roots, nodes = [], [], []
            columns = [batch.column(i).to_pylist() for i in range(1, 7)]
            for leaf, changed, version, path, upper, root in zip(*columns, strict=True):
                inside, higher = unpack_path(path), unpack_path(upper)
                proofs.append(digest([left + right for left, right in inside + higher]))
                begin, rest = (leaf, inside + higher) if version is None else (version, higher)
                further = copied(begin, rest)
                roots.append([begin, *further][-1])
                nodes.append([*copied(changed, inside), *further] if with_nodes and changed is not None else [])
            root = batch.column(6)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(7), root, pa.array(proofs, pa.string()), pa.array(roots, pa.string()),
                    pa.array([a == b for a, b in zip(roots, root.to_pylist(), strict=True)], pa.bool_()), pa.array(nodes, pa.list_(pa.string())),
                ],
                ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "copied"],
            )

    checked = rows.select("doc_id", "node", "changed", "version", "path", "upper", "root", "subroot").mapInArrow(run, schema)
    return checked if with_nodes else checked.drop("copied")
