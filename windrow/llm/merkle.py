"""Merkle manifest of a dataset: a tree of digests per language, a tree over their roots, and a proof for every row.

A digest is SHA-256 in lower-case hex; a node is the digest of its children's hex texts in a row. Of the nodes of one level
every ``fanout`` consecutive ones become one, the last run may be shorter, until one is left; a lone leaf is its own root.

1. *Leaves* are hashed by DataFrame functions where the rows lie. Texts are never shuffled.
2. *Positions.* One range sort by (language, doc_id, leaf), written; then positions within a language are row numbers less
   those of the languages before, from a count per partition and language.
3. *Blocks.* A block is an aligned stretch of ``fanout ** BLOCK_LEVELS`` leaves of a tree, the partition of this job, and
   reduces to the root of its subtree.
4. *Butterfly.* In round r aligned groups of ``fanout ** GROUP_LEVELS`` blocks, that many rounds' stride apart, swap the subtree
   roots they hold. Each block gets all of its group, hashes the ancestors on its own, and keeps the siblings on its way.
   After log(blocks) rounds every block holds the root and its whole upper proof: nothing is handed down again. Where the last
   subtree has fewer blocks than the others, its blocks stand in for those that are not there, in turn.
5. The roots of the languages are the leaves of one more tree, by the same steps.
6. Each block folds its own leaves: local siblings, then the block's, then those of its language.

No task holds more than a block, or the roots of a group. Rows that share language and doc_id go by their leaf, rows without a
doc_id come last, and equal rows are leaves of their own. Columns other than the hashed ones do not matter. An empty table
has no rows, and no root. A long text costs its own hash only.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.llm.common import attach
from windrow.operators.positions import place
from windrow.storage import materialize

FANOUT = 2
#: The fields of a leaf, in order, and the one that names the tree.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves of a block and subtrees of a group, at most; both are cut to a power of the fanout.
BLOCK_LEAVES, GROUP = 1024, 16
_HEX = 64
#: So many trees, of about 100 bytes each, are broadcast to their rows.
FEW_TREES = 100_000


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _height(nodes: int, fanout: int) -> int:
    """Levels above ``nodes`` nodes."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // fanout), levels + 1
    return levels


def levels_under(most: int, fanout: int) -> int:
    """Levels of the largest whole subtree of at most ``most`` leaves, one at least."""
    levels = 1
    while fanout ** (levels + 1) <= most:
        levels += 1
    return levels


def subtree(nodes: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The nodes of all levels, from ``nodes`` up."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([digest("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return out


def siblings(tree: list[list[str]], index: int, fanout: int) -> list[str]:
    """The others of each run on the way up from ``index``, left to right."""
    out = []
    for nodes in tree[:-1]:
        first = index // fanout * fanout
        out += nodes[first:index] + nodes[index + 1 : first + fanout]
        index //= fanout
    return out


def fold(leaf: str, proof: list[str], index: int, count: int, fanout: int = FANOUT) -> tuple[str, int]:
    """The root that a leaf and its siblings give in a tree of ``count`` leaves, and how many siblings that took."""
    used = 0
    while count > 1:
        before = index % fanout
        others = min(fanout, count - index + before) - 1
        own = proof[used : used + others]
        leaf = digest("".join(own[:before]) + leaf + "".join(own[before:]))
        used += others
        index, count = index // fanout, -(-count // fanout)
    return leaf, used


def _hexes(text: str) -> list[str]:
    return [text[i : i + _HEX] for i in range(0, len(text), _HEX)]


def leaf_digest(changes: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS) -> Column:
    """Of each field ``-`` if it is null, else its bytes in UTF-8, a colon and its value; all in a row, hashed."""
    parts = []
    for name in fields:
        value = (changes or {}).get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _placed(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with their place ``pos`` in their tree of ``n``; and the trees: tree, n, rank."""
    numbered, _ = place(leaves, ["tree", "doc_nulls_last", "doc_id", "leaf"], "row")
    numbered = materialize(numbered.drop("doc_nulls_last"), "merkle-places")
    trees = materialize(numbered.groupBy("tree").agg(F.count("*").alias("n"), F.min("row").alias("first")), "merkle-trees")
    # few trees are broadcast; of many, those with very many leaves are still not shuffled by their name
    if trees.count() <= FEW_TREES:
        rows = numbered.join(F.broadcast(trees), "tree")
    else:
        rows = attach(numbered, trees, ["tree"], numbered.count(), "inner", "n")
    ranked, _ = place(trees, ["tree"], "rank")
    return rows.withColumn("pos", F.col("row") - F.col("first")).drop("row", "first"), ranked.drop("first")


def _block_roots(nodes: DataFrame, fanout: int, block_leaves: int) -> DataFrame:
    """One row per block: tree, block, n, root (of its subtree)."""
    block_levels = levels_under(block_leaves, fanout)

    def reduce(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        n = group["n"][0].as_py()
        top = subtree(group["leaf"].to_pylist(), min(block_levels, _height(n, fanout)), fanout)[-1]
        assert len(top) == 1
        return group.slice(0, 1).select(["tree", "block", "n"]).append_column("root", pa.array(top))

    return nodes.groupBy("tree", "block").applyInArrow(reduce, "tree string, block long, n long, root string")


def butterfly(blocks: DataFrame, fanout: int = FANOUT, block_leaves: int = BLOCK_LEAVES, group: int = GROUP) -> DataFrame:
    """Blocks (tree, block, n, root) with the root of the tree and ``upper``, the siblings above the block in a row.

    Runs a job for each round.
    """
    block_levels, group_levels = levels_under(block_leaves, fanout), levels_under(group, fanout)
    size, group = fanout**block_levels, fanout**group_levels
    state = blocks.withColumns({"n_blocks": F.expr(f"(n + {size - 1}) div {size}"), "upper": F.lit("")})
    state = materialize(state, "merkle-round")
    most = state.agg(F.max("n_blocks")).first()[0] or 0
    stride, height = 1, block_levels
    while stride < most:
        open_ = F.col("n_blocks") > stride
        done = state.filter(~open_)
        # the last subtree may have fewer blocks than the stride: each stands in for every so many lanes
        held = F.expr(f"n_blocks - (n_blocks - 1) div {stride} * {stride}")
        is_last = F.expr(f"block div {stride} = (n_blocks - 1) div {stride}")
        lane, seat = F.expr(f"block % {stride}"), F.expr(f"block div {stride} % {group}")
        lanes = F.when(is_last & (seat > 0) & (held < stride), F.sequence(lane, F.lit(stride - 1).cast("long"), held)).otherwise(F.array(lane))
        sent = state.filter(open_).select("*", F.expr(f"block div {stride * group}").alias("meeting"), lane.alias("own"), seat.alias("seat"), F.explode(lanes).alias("lane"))
        is_own = F.col("lane") == F.col("own")
        holder = F.when(is_own, F.struct("block", "n", "n_blocks", "seat", "upper"))
        met = sent.groupBy("tree", "meeting", "lane").agg(
            F.sort_array(F.collect_list(F.struct("seat", "root"))).alias("swapped"), F.collect_list(holder).alias("holders")
        )
        members = met.select("tree", F.expr("transform(swapped, x -> x.root)").alias("roots"), F.explode("holders").alias("h")).select("tree", "roots", "h.*")
        state = materialize(members.mapInArrow(_climb(height, group_levels, fanout), "tree string, block long, n long, n_blocks long, root string, upper string").unionByName(done), "merkle-round")
        stride, height = stride * group, height + group_levels
    return state


def _climb(height: int, group_levels: int, fanout: int):
    """Each block hashes the ancestors over the roots of its group, and adds the siblings on its way."""

    def climb(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                levels = min(group_levels, _height(row["n"], fanout) - height)
                tree = subtree(row["roots"], levels, fanout)
                assert len(tree[-1]) == 1
                upper = row["upper"] + "".join(siblings(tree, row["seat"], fanout))
                out.append((row["tree"], row["block"], row["n"], row["n_blocks"], tree[-1][0], upper))
            if out:
                names = ["tree", "block", "n", "n_blocks", "root", "upper"]
                types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return climb


def _with_blocks(nodes: DataFrame, fanout: int, block_leaves: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {fanout ** levels_under(block_leaves, fanout)}"))


def _proved(nodes: DataFrame, blocks: DataFrame, finish, schema: str, fanout: int, block_leaves: int) -> DataFrame:
    """``finish(rows, block)`` for each block's rows, which get ``proof``: the siblings up to the root of the tree, in order."""
    block_levels = levels_under(block_leaves, fanout)

    def prove(rows: pa.Table, block: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        (own,) = block.to_pylist()
        leaves = rows["leaf"].to_pylist()
        tree = subtree(leaves, min(block_levels, _height(own["n"], fanout)), fanout)
        upper = _hexes(own["upper"])
        return finish(rows.to_pylist(), [siblings(tree, k, fanout) + upper for k in range(len(leaves))], own)

    return nodes.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(prove, schema)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def manifest(
    docs: DataFrame,
    fanout: int = FANOUT,
    changed: Column | None = None,
    digests: bool = False,
    block_leaves: int = BLOCK_LEAVES,
    group: int = GROUP,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, folded_root, verified, and its proof.

    The proof is ``proof``, the siblings from the leaf up to the root, left to right on each level, with ``pos`` and ``n``
    (place and number of leaves in the tree of the language) and ``rank`` and ``n_trees`` to fold them; with
    ``digests`` it is ``proof_sha256``, of these siblings in a row. ``folded_root`` is what the leaf as found now and the
    siblings give; ``changed`` is that leaf if it is not the one the tree was made of.

    Runs jobs when called; its tables are removed by the surrounding ``intermediates`` block.
    """
    leaf = leaf_digest()
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    ids = F.col("doc_id").cast("long")
    leaves = docs.select(tree.alias("tree"), ids.alias("doc_id"), ids.isNull().alias("doc_nulls_last"), leaf.alias("leaf"), (leaf if changed is None else F.coalesce(changed, leaf)).alias("found"))
    leaves = materialize(leaves, "merkle-leaves")
    nodes, trees = _placed(leaves)
    nodes = _with_blocks(nodes, fanout, block_leaves)
    blocks = butterfly(_block_roots(nodes, fanout, block_leaves), fanout, block_leaves, group)

    # the tree over the roots of the languages
    n_trees = trees.count()
    roots = blocks.filter("block = 0").select("tree", F.col("root").alias("leaf"))
    tops = trees.join(roots, "tree").select(
        F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("n").alias("n_rows"), F.col("rank").alias("pos"), F.lit(n_trees).cast("long").alias("n"), "leaf"
    )
    tops = materialize(_with_blocks(tops, fanout, block_leaves), "merkle-tops")
    top_blocks = butterfly(_block_roots(tops, fanout, block_leaves), fanout, block_leaves, group)
    schema = pa.schema([("of", pa.string()), ("n_rows", pa.int64()), ("rank", pa.int64()), ("top", pa.string()), ("above", pa.string())])

    def of_trees(rows, proofs, own):
        return _table([(r["of"], r["n_rows"], r["pos"], own["root"], "".join(p)) for r, p in zip(rows, proofs)], schema)

    above = _proved(tops, top_blocks, of_trees, "of string, n_rows long, rank long, top string, above string", fanout, block_leaves)
    above = materialize(above.withColumnRenamed("of", "tree"), "merkle-above")
    blocks = blocks.join(F.broadcast(above.drop("n_rows")), "tree") if n_trees <= FEW_TREES else attach(blocks, above, ["tree"], nodes.count(), "inner").drop("n_rows")

    kind = [("proof_sha256", pa.string())] if digests else [("proof", pa.list_(pa.string())), ("pos", pa.int64()), ("n", pa.int64()), ("rank", pa.int64()), ("n_trees", pa.int64())]
    names = [("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), *kind, ("folded_root", pa.string()), ("verified", pa.bool_())]
    fields = pa.schema(names)
    spark_type = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean", pa.list_(pa.string()): "array<string>"}

    def of_rows(rows, proofs, own):
        higher, out = _hexes(own["above"]), []
        for r, proof in zip(rows, proofs):
            folded, used = fold(r["found"], proof, r["pos"], own["n"], fanout)
            assert used == len(proof)
            folded, _ = fold(folded, higher, own["rank"], n_trees, fanout)
            whole = proof + higher
            told = (digest("".join(whole)),) if digests else (whole, r["pos"], own["n"], own["rank"], n_trees)
            out.append((r["doc_id"], r["leaf"], own["root"], own["top"], *told, folded, folded == own["top"]))
        return _table(out, fields)

    return _proved(nodes, blocks, of_rows, ", ".join(f"{n} {spark_type[t]}" for n, t in names), fanout, block_leaves)
