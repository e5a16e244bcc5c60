"""Nested co-clustering: groups by merging and splitting, and groups of groups in levels.

A round updates the labels of both sides in turn until they settle, then merges groups on the block
matrix of each sector to the shortest nested description (`merging`), and splits every group in two
for the next round, as long as a sector's description gets shorter. All sectors and starts run in
the same jobs; a sector that has settled leaves them. The number of groups has no fixed end: it
doubles by splitting and falls by merging.

Levels are rows (sector, kind, level, node, grp): level 0 are the groups of documents and words,
level l + 1 the groups of the groups of level l. The statistics of a level are those of
`operators.graph` on the labels that `at_level` takes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorlens.operators.cocluster import full_pass, moved_share, start_labels
from sectorlens.operators.merging import nested_groups
from sectorlens.session import bucketed, cut

KINDS = ("doc", "word")
TREE = "sector string, run int, level int, kind string, grp int, parent int, length double"


def _matrix_of(rows: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The block matrix of one sector and run, the sizes of both sides' groups, and their labels."""
    sides = [rows[rows["kind"] == kind].sort_values("a") for kind in KINDS]
    labels = [side["a"].to_numpy() for side in sides]
    edges = rows[rows["kind"] == "edge"]
    matrix = np.zeros([len(x) for x in labels])
    places = [np.searchsorted(x, edges[c].to_numpy()) for x, c in zip(labels, ("b", "a"))]
    np.add.at(matrix, tuple(places), edges["x"].to_numpy())
    return matrix, [side["x"].to_numpy() for side in sides], labels


def _merge_one(rows: pd.DataFrame) -> pd.DataFrame:
    matrix, sizes, labels = _matrix_of(rows)
    length, levels = nested_groups(matrix, *sizes)
    out = []
    for level, parents in enumerate(levels):
        for kind, own, above in zip(KINDS, labels, parents):
            out.append(pd.DataFrame({"level": level, "kind": kind, "grp": own, "parent": above}))
        labels = [np.arange(int(p.max()) + 1) for p in parents]
    tree = pd.concat(out)
    return tree.assign(sector=rows["sector"].iloc[0], run=rows["run"].iloc[0], length=length)[
        ["sector", "run", "level", "kind", "grp", "parent", "length"]
    ]


def group_tree(blocks: DataFrame, docs: DataFrame, words: DataFrame) -> DataFrame:
    """``(sector, run, level, kind, grp, parent, length)``: the merged groups and the levels above them.

    ``blocks`` is (sector, run, label, other, e) with word groups as ``label``; docs and words hold
    arrays of labels, one per run. At level 0 ``grp`` is a label, above it a group of the level
    below. A task holds the block matrix of a sector, whose size follows the groups and not the data.
    """
    sides = [
        side.select("sector", F.posexplode("labels").alias("run", "a")).groupBy("sector", "run", "a").agg(F.count("*").cast("double").alias("x"))
        .select("sector", "run", F.lit(kind).alias("kind"), "a", F.lit(0).alias("b"), "x")
        for kind, side in zip(KINDS, (docs, words))
    ]
    edges = blocks.select("sector", "run", F.lit("edge").alias("kind"), F.col("label").alias("a"), F.col("other").alias("b"), F.col("e").cast("double").alias("x"))
    return reduce(DataFrame.unionByName, [edges, *sides]).groupBy("sector", "run").applyInPandas(_merge_one, TREE)


def _maps(tree: DataFrame, kind: str, runs: int) -> DataFrame:
    """``(sector, maps)``: per run the new label of each label; a row per sector, of as many entries as groups."""
    per_run = (
        tree.where((F.col("level") == 0) & (F.col("kind") == kind)).groupBy("sector", "run")
        .agg(F.map_from_entries(F.collect_list(F.struct("grp", "parent"))).alias("m"))
    )
    by_run = per_run.groupBy("sector").agg(F.map_from_entries(F.collect_list(F.struct("run", "m"))).alias("r"))
    return by_run.select("sector", F.array(*[F.try_element_at("r", F.lit(i)) for i in range(runs)]).alias("maps"))


def _relabelled(nodes: DataFrame, node: str, maps: DataFrame) -> DataFrame:
    new = F.zip_with("labels", "maps", lambda a, m: F.try_element_at(m, a))
    return nodes.join(F.broadcast(maps), "sector").select("sector", node, new.alias("labels"))  # a row per sector


def _split(nodes: DataFrame, node: str, turn: int) -> DataFrame:
    """Every group in two halves by the hash of the node, other ones each round and run."""

    def halved(label: Column, run: Column) -> Column:
        half = F.pmod(F.xxhash64(F.col(node), F.lit(turn), run), F.lit(2))
        return (label * 2 + half).cast("int")

    return nodes.select("sector", node, F.transform("labels", halved).alias("labels"))


def _settled(edges: DataFrame, docs: DataFrame, words: DataFrame, sizes: tuple[list[int], list[int]], max_iter: int, epsilon: float):
    """Labels and blocks after passes over both sides, until fewer than ``epsilon`` of the documents move in any sector and run."""
    blocks = None
    for _ in range(max_iter):
        docs, words, blocks = full_pass(edges, docs, words, sizes[0], sizes[1], blocks=blocks)
        most = moved_share(docs).agg(F.max("moved")).first()[0]
        if most is None or most < epsilon:
            break
    return docs, words, blocks


def fit_levels(
    edges: DataFrame, start_groups: int = 8, n_init: int = 1, max_iter: int = 4, epsilon: float = 0.01, patience: int = 3, max_rounds: int = 20
) -> tuple[DataFrame, DataFrame]:
    """``(levels, report)`` of the edges (sector, doc_id, word, cnt).

    Levels are (sector, kind, level, node, grp), nodes as text. The report has a row per sector: the
    shortest nested description, the number of levels, and the groups of level 0. A sector leaves
    after ``patience`` rounds without a shorter description, or after ``max_rounds``.
    """
    numbered = cut(edges.select("sector", "word").distinct().withColumn("number", F.monotonically_increasing_id()))
    rest = bucketed(edges.join(numbered, ["sector", "word"]).select("sector", "doc_id", F.col("number").alias("word"), "cnt"), "sector", "word")
    seeds = list(range(n_init))
    first = [start_groups] * n_init
    docs = cut(start_labels(rest.select("sector", "doc_id").distinct(), "doc_id", first, seeds))
    words = cut(
        start_labels(numbered.withColumnRenamed("word", "name"), "name", first, seeds)
        .select("sector", F.col("number").alias("word"), "labels")
    )
    sizes = (first, first)
    rounds: list[tuple[DataFrame, DataFrame, DataFrame]] = []
    best = None  # (sector, length, round): the shortest description over the rounds so far, of any run
    for turn in range(max_rounds):
        docs, words, blocks = _settled(rest, docs, words, sizes, max_iter, epsilon)
        tree = cut(group_tree(blocks, docs, words))
        docs, words = (cut(_relabelled(side, node, _maps(tree, kind, n_init))) for side, node, kind in ((docs, "doc_id", "doc"), (words, "word", "word")))
        rounds.append((tree, docs, words))
        lengths = tree.groupBy("sector").agg(F.min("length").alias("length")).withColumn("round", F.lit(turn))
        before, best = best, cut(lengths if best is None else _shorter(best, lengths))
        going = best.where(F.col("round") > turn - patience).select("sector")
        if turn == max_rounds - 1 or going.isEmpty():
            break
        # The next round splits the best labels so far.
        docs, words = (
            reduce(DataFrame.unionByName, [done[i].join(F.broadcast(best.where(F.col("round") == r)), "sector", "left_semi") for r, done in enumerate(rounds)])
            for i in (1, 2)
        )
        docs, words = (cut(_split(side.join(F.broadcast(going), "sector", "left_semi"), node, turn)) for side, node in ((docs, "doc_id"), (words, "word")))
        sizes = tuple([_most(side)] * n_init for side in (docs, words))
        rest = rest.join(F.broadcast(going), "sector", "left_semi")
    return _found(rounds, best, numbered)


def _shorter(best: DataFrame, lengths: DataFrame) -> DataFrame:
    """The earlier description unless the new one is shorter by more than rounding."""
    new = lengths.withColumnsRenamed({"length": "_length", "round": "_round"})
    wins = F.coalesce(F.col("_length") < F.col("length") - 1e-6, F.lit(False))
    return best.join(new, "sector", "left").select(
        "sector", F.when(wins, F.col("_length")).otherwise(F.col("length")).alias("length"), F.when(wins, F.col("_round")).otherwise(F.col("round")).alias("round")
    )


def _most(nodes: DataFrame) -> int:
    """One more than the largest label."""
    return (nodes.agg(F.max(F.array_max("labels"))).first()[0] or 0) + 1


def _found(rounds, best: DataFrame, numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    trees, docs, words = (
        reduce(DataFrame.unionByName, [frames[i].withColumn("round", F.lit(r)) for r, frames in enumerate(rounds)]) for i in range(3)
    )
    chosen = cut(
        trees.join(F.broadcast(best.select("sector", "round")), ["sector", "round"], "left_semi")
        .groupBy("sector", "round").agg(F.min_by("run", F.struct("length", "run")).alias("run"), F.min("length").alias("length"))
    )
    keys = F.broadcast(chosen.select("sector", "round", "run"))  # a row per sector
    tree = cut(trees.join(keys, ["sector", "round", "run"], "left_semi").select("sector", "level", "kind", "grp", "parent"))
    labels = docs.join(keys, ["sector", "round"]).select("sector", F.lit("doc").alias("kind"), F.col("doc_id").cast("string").alias("node"), F.get("labels", "run").alias("grp"))
    named = words.join(keys, ["sector", "round"]).select("sector", F.col("word").alias("number"), F.get("labels", "run").alias("grp"))
    named = numbered.join(named, ["sector", "number"]).select("sector", F.lit("word").alias("kind"), F.col("word").alias("node"), "grp")
    levels = project_levels(labels.unionByName(named), tree.where("level > 0"))
    sizes = tree.where("level = 0").groupBy("sector", "kind").agg(F.countDistinct("parent").alias("n"))
    report = (
        chosen.select("sector", F.round("length", 6).alias("description_length"))
        .join(tree.groupBy("sector").agg((F.max("level") + 1).alias("n_levels")), "sector")
        .join(sizes.where("kind = 'doc'").select("sector", F.col("n").alias("n_doc_groups")), "sector")
        .join(sizes.where("kind = 'word'").select("sector", F.col("n").alias("n_word_groups")), "sector")
    )
    return levels, report


# Levels as rows.


def project_levels(labels: DataFrame, parents: DataFrame) -> DataFrame:
    """``(sector, kind, level, node, grp)``: the group of every node on every level.

    ``labels`` is (sector, kind, node, grp) of level 0; ``parents`` (sector, kind, level, grp,
    parent) tells for each level above which group a group of the level below joins. The chains of
    groups are put together first, so the nodes are joined once, with as many rows as groups.
    """
    depth = parents.agg(F.max("level")).first()[0] or 0
    chain = labels.select("sector", "kind", F.col("grp").alias("start")).distinct().withColumn("grps", F.array("start"))
    for level in range(1, depth + 1):  # levels halve at least, so they are few
        above = parents.where(F.col("level") == level).select("sector", "kind", F.col("grp").alias("last"), "parent")
        chain = (
            chain.withColumn("last", F.when(F.size("grps") == level, F.element_at("grps", -1))).join(above, ["sector", "kind", "last"], "left")
            .select("sector", "kind", "start", F.when(F.col("parent").isNull(), F.col("grps")).otherwise(F.concat("grps", F.array("parent"))).alias("grps"))
        )
    joined = labels.withColumnRenamed("grp", "start").join(chain, ["sector", "kind", "start"])
    return joined.select("sector", "kind", "node", F.posexplode("grps").alias("level", "grp")).select("sector", "kind", "level", "node", "grp")


def at_level(levels: DataFrame, level: int, doc_id: str = "string") -> tuple[DataFrame, DataFrame]:
    """``(doc_groups, word_groups)`` of a level, for the statistics of `operators.graph`.

    ``doc_id`` is the type of the documents' ids. Sectors without the level have no rows; a level
    below 0 is an error.
    """
    if level < 0:
        raise ValueError(f"levels start at 0, not {level}")
    own = levels.where(F.col("level") == level)
    return (
        own.where("kind = 'doc'").select("sector", F.col("node").cast(doc_id).alias("doc_id"), F.col("grp").alias("doc_group")),
        own.where("kind = 'word'").select("sector", F.col("node").alias("word"), F.col("grp").alias("word_group")),
    )
