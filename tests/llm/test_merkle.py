"""The manifest against a plain recursive tree, over several blocks, sources, nulls and repeats."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sitewise.llm import merkle, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def code(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain(leaves):
    """(root, siblings and places by leaf) of a list of digests."""
    ways = [[] for _ in leaves]
    level, at = list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k - k % 3 : k - k % 3 + 3]
            ways[i].append((run[: k % 3], run[k % 3 + 1 :]))
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
        at = [k // 3 for k in at]
    return level[0], ways


def fold(node, way):
    for left, right in way:
        node = h(*left, node, *right)
    return node


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, h(*map(code, r))))
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [[r for r in rows if r[1] == s] for s in sources]
    trees = [plain([h(*map(code, r)) for r in group]) for group in groups]
    root, tops = plain([t[0] for t in trees])
    out = []
    for group, (subroot, ways), top in zip(groups, trees, tops, strict=True):
        for r, way in zip(group, ways, strict=True):
            leaf, whole = h(*map(code, r)), way + top
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            changed = h(*map(code, [*r[:4], r[4].replace("\n", "") if r[4] is not None else None])) if bad else leaf
            got = fold(changed, whole)
            proof = h(*[x for left, right in whole for x in left + right])
            out.append((r[0], leaf, subroot, root, proof, got, got == root))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
BIG = [(i, "big", "en", i % 5, f"a\nb{i}" if i % 3 else f"c{i}") for i in range(2 * merkle.BLOCK + 5)]
ODD = [
    (7, None, None, None, None), (8, None, "de", 3, "ü\n"), (None, None, "de", 0, "\n"), (None, "a", None, None, ""), (5, "a", "x", 1, "\n\n"),
    (5, "a", "x", 1, "\n\n"), (5, "a", "y", 1, "z"), (6, "é", "x", 1, "t"), (9, "", "x", 1, "t\n" * 5000),
]


@pytest.mark.parametrize("rows", [ODD, BIG + ODD, ODD[-1:], BIG[: merkle.BLOCK], BIG[: merkle.BLOCK + 1]], ids=["odd", "blocks", "one", "full", "over"])
def test_query_against_plain_trees(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("tree", F.lit(1)).withColumn("pos", F.lit("x"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_merkle_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected(rows), key=key)


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_versions_share_all_but_the_copied_nodes(spark):
    docs = spark.createDataFrame(BIG, SCHEMA)
    rows = merkle.manifest(docs, F.col("doc_id") == 800, F.lit("other"), with_nodes=True).collect()
    changed = [r for r in rows if r["copied"]]
    assert [r["doc_id"] for r in changed] == [800] and len(changed[0]["copied"]) == merkle.HEIGHT + 1
    assert changed[0]["copied"][-1] == changed[0]["folded_root"] != changed[0]["root"]
    assert all(r["verified"] for r in rows if r["doc_id"] != 800)
    block = merkle.PersistentBlock.build([h(str(i)) for i in range(merkle.BLOCK)], False)
    assert merkle.unpack_path(merkle.pack_path(block.path(500))) == block.path(500)
    assert merkle.copied(h("500"), block.path(500)) == [nodes[500 // 3 ** (i + 1)] for i, nodes in enumerate(block.levels[1:])]
