"""Parent-child links to full hierarchies by parallel tree contraction.

Every round rakes the leaves and compresses an independent set of unary chain
nodes, so a tree of n nodes is gone after O(log n) rounds whatever its depth.
Each removed node is recorded with the node it hung on, the number of steps and
the path between them.  A record hangs on a node removed in a later round, so a
chain of records is no longer than the number of rounds and doubling resolves it
in a few joins.  What cannot contract away is a self-loop: the core of a cycle.
Rounds work on (long id, long parent) rows only; names come back at the end.  Per
round one state is written in the checkpoint folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from srcloom.runtime import cut


def parent_links(edges: DataFrame, edge_type: str = "reexport") -> DataFrame:
    """One row (repo_id, file_path, parent) per file named in a row of the edge type.

    A null source says the target has no parent, a null target only that the source
    exists.  Repeated rows collapse.  Should a file have several parents, the smallest
    path wins; a parent wins over a row without one.  Null repo_id is a repository of
    its own.  Extra columns are ignored.
    """
    e = edges.where(F.col("edge_type") == edge_type).select("repo_id", "source_file", "target_file")
    below = e.where(F.col("target_file").isNotNull()).select("repo_id", F.col("target_file").alias("file_path"), F.col("source_file").alias("parent"))
    above = e.where(F.col("source_file").isNotNull()).select("repo_id", F.col("source_file").alias("file_path"), F.lit(None).cast("string").alias("parent"))
    return below.unionByName(above).groupBy("repo_id", "file_path").agg(F.min("parent").alias("parent"))


def _draw(c: Column, round_no: int) -> Column:
    return F.xxhash64(c, F.lit(round_no))


def contract(links: DataFrame, with_paths: bool = True) -> DataFrame:
    """(id, name, p) rows -> (id, root, depth, path); root and path null and depth -1 on or below a cycle.

    p is the id of the parent, null for a root; a parent that has no row of its own is
    not allowed.  path lists the names from the root to the node.
    """
    seg = F.array(F.col("name")) if with_paths else F.array().cast("array<string>")
    open_ = F.col("p").isNotNull() & (F.col("p") != F.col("id"))
    live = cut(links.select("id", "p", F.lit(1).cast("long").alias("w"), seg.alias("seg")))
    records: list[DataFrame] = []
    left = live.where(open_).limit(1).count()
    while left:
        round_no = len(records) + 1
        children = live.where("p IS NOT NULL").groupBy(F.col("p").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("child"))
        # Of the nodes with one child those that draw higher than both neighbours are an independent set.
        mine = _draw(F.col("id"), round_no)
        high = (F.col("n") == 1) & open_ & (mine > _draw(F.col("p"), round_no)) & ((F.col("child") == F.col("p")) | (mine > _draw(F.col("child"), round_no)))
        marked = live.join(children, "id", "left").select("id", "p", "w", "seg", (F.col("p").isNotNull() & F.col("n").isNull()).alias("leaf"), F.coalesce(high, F.lit(False)).alias("gone"))
        hop = marked.where("gone").select(F.col("id").alias("p"), F.col("p").alias("up"), F.col("w").alias("w_up"), F.col("seg").alias("seg_up"))
        lifted = marked.join(hop, "p", "left").select(
            "id", F.coalesce("up", "p").alias("p"), (F.col("w") + F.coalesce("w_up", F.lit(0))).alias("w"),
            F.when(F.col("up").isNull(), F.col("seg")).otherwise(F.concat("seg_up", "seg")).alias("seg"), (~F.col("leaf") & ~F.col("gone")).alias("alive"),
        )
        seen = Observation()
        state = cut(lifted.observe(seen, F.count(F.when(F.col("alive") & open_, 1)).alias("open")))
        left = seen.get["open"]
        records.append(state.where("NOT alive").drop("alive"))
        live = state.where("alive").drop("alive")

    is_root = F.col("p").isNull()
    done = live.select(
        "id", F.when(is_root, F.col("id")).alias("root"), F.when(is_root, F.lit(0)).otherwise(F.lit(-1)).cast("long").alias("depth"),
        F.when(is_root, F.col("seg")).alias("path"),
    )
    if not records:
        return done
    chain = reduce(DataFrame.unionByName, records)
    for _ in range((len(records) - 1).bit_length()):  # doubling: every step halves what is left of a chain
        up = chain.select(F.col("id").alias("p"), F.col("p").alias("up"), F.col("w").alias("w_up"), F.col("seg").alias("seg_up"))
        chain = cut(chain.join(up, "p", "left").select(
            "id", F.coalesce("up", "p").alias("p"), (F.col("w") + F.coalesce("w_up", F.lit(0))).alias("w"), F.when(F.col("up").isNull(), F.col("seg")).otherwise(F.concat("seg_up", "seg")).alias("seg"),
        ))
    top = done.select(F.col("id").alias("p"), "root", F.col("path").alias("above"))
    hung = chain.join(top, "p").select(
        "id", "root", F.when(F.col("root").isNull(), F.lit(-1)).otherwise(F.col("w")).cast("long").alias("depth"), F.when(F.col("root").isNotNull(), F.concat("above", "seg")).alias("path")
    )
    return done.unionByName(hung)


def hierarchy(edges: DataFrame, edge_type: str = "reexport", with_paths: bool = True) -> DataFrame:
    """Root, depth and path of every file named in a row of the edge type.

    Columns repo_id, file_path, root_file, depth, path.  A root is its own root at depth
    0.  A file on a cycle or below one has root_file '', depth -1 and a null path.  An
    empty table gives an empty result.  path is null throughout when with_paths is off.
    """
    # Ids must not change between uses, so the numbered table is cut.
    nodes = cut(parent_links(edges, edge_type).withColumn("id", F.monotonically_increasing_id()))
    ids = nodes.select("repo_id", F.col("file_path").alias("parent"), F.col("id").alias("p"))
    links = nodes.alias("n").join(
        ids.alias("i"), F.col("n.repo_id").eqNullSafe(F.col("i.repo_id")) & (F.col("n.parent") == F.col("i.parent")), "left"
    ).select("n.id", F.col("n.file_path").alias("name"), "i.p")
    solved = contract(links, with_paths)
    roots = nodes.select(F.col("id").alias("root"), F.col("file_path").alias("root_file"))
    return (
        nodes.join(solved, "id").join(roots, "root", "left")
        .select("repo_id", "file_path", F.coalesce("root_file", F.lit("")).alias("root_file"), F.col("depth").cast("int").alias("depth"),
                (F.col("path") if with_paths else F.lit(None).cast("array<string>")).alias("path"))
    )


def descendants(tree: DataFrame) -> DataFrame:
    """All (repo_id, file_path, descendant, distance) pairs of hierarchy()'s result, nearest or farthest.

    The pairs are the steps of the paths, so nothing is joined; files without a path have none.
    """
    return (
        tree.where(F.size("path") > 1)
        .select("repo_id", F.col("file_path").alias("descendant"), "depth", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("level", "file_path"))
        .select("repo_id", "file_path", "descendant", (F.col("depth") - F.col("level")).cast("int").alias("distance"))
    )
