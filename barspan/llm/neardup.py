"""Near-duplicate documents by a chosen-path set-similarity join.

A document's set is that of its hashed word shingles; documents with equal sets are one class.
Independent trees branch the classes: at every level a node's members go to two children each,
named by the smallest hash of their set under one of two hash functions of that tree and level.
Nodes of one member end; small nodes are compared exhaustively, first by sketches and then on
full sets; large nodes branch again.  With two branches a pair of similarity 0.85 stays together
in a tree with probability over 0.96 at any depth (0.93 at 0.8), so four trees miss less than
one pair in 100,000 (50,000).

Large nodes that hold a family of near copies would never fall apart, so families are settled
first.  A family's most central member, the one in the largest nodes, is its pivot.  Exact
similarities to the pivot p give an inner ring (a: J >= 2t - 1, for the threshold t) and an
outer ring (b: J >= 3t - 2).  1 - J is a metric, so a partner of an inner member lies in the
outer ring: members that link to p are connected, the others of both rings are compared with the
whole outer ring in blocks of many thousands, and after that the links of an inner member within a
node of the pivot are known but for those that the sketches miss (RING_TAIL).  Where a node holds
but few documents outside the rings, these are compared with each other and the outer ring's rim,
and the node is done.  Else the documents that are inner to no pivot of their node branch on.  What
is still large after the last level is compared in blocks, every member outside the node's largest
group with every member of the node.

Within a block most pairs need no look.  Let c be the shingles that most members hold; a member
lacks some of them (M) and adds others (B).  If f and y link and f does not link to c, then
100 |M_y| + P |B_y| < (100 + P) (|M_f & M_y| + |B_f & B_y|): where y adds as much as it lacks, the
two share an addition.  So members that link to c, or lack more than they add, are compared with
all, and every other one with those that share an addition with it or are both near c and shorter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ChunkCache, cut, map_groups, mix64, only_near, read_table, small_batches, texts_of, tidy
from .components import components

TREES, BRANCHES, LEVELS = 4, 2, 4
HASHES = TREES * BRANCHES * LEVELS
#: So many times at most members of large nodes are taken as pivots of families.
FAMILY_TURNS = 2
#: Of the 32 smallest hashes so many agree at least, or a pair is not looked at: fewer agree in
#: about 6 of ten million pairs at similarity 0.85 and, scaled to 15, in 7 of a million at 0.8.
AGREE = 16
#: Shingles that a block of compared members holds on average at most, however long its texts are.
BLOCK_SHINGLES = 1 << 20
#: Members of the outer ring of which fewer smallest hashes agree with the pivot's: so few at most.
RING_TAIL = 2.5e-5

_RNG = np.random.default_rng(20_240_601)
_MULTIPLY = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def word_cache() -> ChunkCache:
    return ChunkCache(xxhash.xxh3_64_intdigest, 300_000)


def shingle_set(text: bytes, width: int, cache: ChunkCache) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text (A-Z lower-cased).

    Words are what stands between the six ASCII white-space characters.  Fewer words than the
    width are one shingle; no words give an empty set.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def smallest_hashes(s: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, ~np.uint64(0))
    for a in range(0, len(s), 8192):
        part = s[a : a + 8192, None] * _MULTIPLY + _ADD
        out = np.minimum(out, (part ^ (part >> np.uint64(31))).min(axis=0))
    return out


def sketch(docs: DataFrame, *, id_col: str, text_col: str, width: int) -> DataFrame:
    """doc_id, n_shingles, set_hash, mins (smallest hashes) and sig (16 bits of each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache()
        for batch in batches:
            sets = [shingle_set(t, width, cache) for t in texts_of(batch.column("text"))]
            mins = [smallest_hashes(s) for s in sets]
            flat = np.concatenate(mins) if mins else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, HASHES), pa.int32()), pa.array(flat.view(np.int64))),
                    pa.array([(m & np.uint64(0xFFFF)).astype(np.uint16).tobytes() for m in mins], pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_hash", "mins", "sig"],
            )

    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, n_shingles bigint, set_hash binary, mins array<bigint>, sig binary")


class Union:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.find(i)] = self.find(j)


def _agreeing(sigs: list[bytes], agree: int) -> np.ndarray:
    m = np.frombuffer(b"".join(sigs), np.uint16).reshape(len(sigs), HASHES)
    return (m[:, None, :] == m[None, :, :]).sum(axis=2) >= agree


def _sketch_parts(agree: int):
    """Parts of a node that agreeing sketches connect; members without partner leave."""

    def run(g: dict[str, list]) -> list[tuple]:
        near = _agreeing(g["sig"], agree)
        union = Union(len(near))
        for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
            union.join(int(i), int(j))
        parts: dict[int, list[int]] = {}
        for i in range(len(near)):
            parts.setdefault(union.find(i), []).append(g["rep"][i])
        out = []
        for members in parts.values():
            if len(members := sorted(set(members))) > 1:
                name = hashlib.blake2b(np.array(members, np.int64).tobytes(), digest_size=8).digest()
                out += [(int.from_bytes(name, "little", signed=True), r) for r in members]
        return out

    return run


def _intersections(sets: list[np.ndarray]):
    """A function giving the sizes of the intersections of set i with all sets, or those at some places, at once."""
    vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum([len(x) for x in sets])
    starts = ends - np.array([len(x) for x in sets])
    present = np.zeros(len(vocabulary), bool)

    def of(i: int, some: np.ndarray | None = None) -> np.ndarray:
        own = flat[starts[i] : ends[i]]
        present[own] = True
        if some is None:
            out = np.add.reduceat(present[flat], starts, dtype=np.int64)
        else:
            out = np.array([np.count_nonzero(present[flat[starts[j] : ends[j]]]) for j in some], np.int64)
        present[own] = False
        return out

    return of


def _sets(g: dict[str, list], width: int, held: dict) -> tuple[list[np.ndarray], list[int]]:
    """Sets of a group and the rows they belong to, without empty ones."""
    cache = held.setdefault("words", word_cache())
    sets = [shingle_set(t or b"", width, cache) for t in g["text"]]
    rows = [i for i, x in enumerate(sets) if len(x)]
    return [sets[i] for i in rows], rows


def _worth_a_look(sets: list[np.ndarray], percent: int):
    """For each member the places of those it can link to, or None for all of them."""
    vocabulary, flat, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    size = np.array([len(x) for x in sets])
    ends = np.cumsum(size)
    starts = ends - size
    common = counts > len(sets) / 2
    held = np.add.reduceat(common[flat], starts, dtype=np.int64)
    near = 100 * held >= percent * (size + common.sum() - held)
    shorter = size - held < common.sum() - held
    order = np.argsort(flat, kind="stable")
    owner = np.repeat(np.arange(len(sets)), size)[order]
    firsts = np.concatenate([[0], np.cumsum(counts)])
    both = np.flatnonzero(near & shorter)

    def of(i: int) -> np.ndarray | None:
        if near[i] or shorter[i]:
            return None
        own = flat[starts[i] : ends[i]]
        return np.unique(np.concatenate([both, *[owner[firsts[e] : firsts[e + 1]] for e in own[~common[own]]]]))

    return of


def _exact(width: int, percent: int):
    """Links within a group on full sets, as (u, v): each member's smallest connected member.

    Members with side 0 are compared with all, those with side 1 with side 0 only; members that
    share a label are connected already, and a member is not looked at once all are.
    """
    held: dict = {}

    def run(g: dict[str, list]) -> list[tuple]:
        sets, rows = _sets(g, width, held)
        if len(sets) < 2:
            return []
        reps, labels, sides = ([g[c][i] for i in rows] for c in ("rep", "label", "side"))
        n, first, union, size = len(sets), {}, Union(len(sets)), np.array([len(x) for x in sets])
        for i, label in enumerate(labels):
            union.join(i, first.setdefault(label, i))
        of, worth = _intersections(sets), _worth_a_look(sets, percent) if n > 64 else lambda i: None
        for i in sorted(range(n), key=lambda i: (-size[i], reps[i])):
            if sides[i] == 0:
                some = worth(i)
                both, other = (of(i), size) if some is None else (of(i, some), size[some])
                for j in np.flatnonzero(100 * both >= percent * (size[i] + other - both)):
                    union.join(i, int(j if some is None else some[j]))
        low: dict[int, int] = {}
        for i in range(n):
            root = union.find(i)
            low[root] = min(low.get(root, reps[i]), reps[i])
        return list({(reps[i], low[union.find(i)]) for i in range(n) if reps[i] != low[union.find(i)]})

    return run


def _similar(width: int):
    """(pivot, rep, both, either, n_shingles): sizes of the intersection and union with the group's pivot, and of the set."""
    held: dict = {}

    def run(g: dict[str, list]) -> list[tuple]:
        sets, rows = _sets(g, width, held)
        reps, sides = [g["rep"][i] for i in rows], [g["side"][i] for i in rows]
        if not sets or 0 not in sides:
            return []
        i, size = sides.index(0), np.array([len(x) for x in sets])
        both = _intersections(sets)(i)
        return [(reps[i], reps[j], int(both[j]), int(size[i] + size[j] - both[j]), int(size[j])) for j in range(len(sets)) if sides[j]]

    return run


def _compare(groups: DataFrame, docs: DataFrame, *, width: int, percent: int, name: str) -> DataFrame:
    """groups(grp, rep, label, side) -> links(u, v), with the texts of the members only."""
    members = groups.select("rep").distinct()
    texts = only_near(docs, "rep", members)
    rows = groups.join(texts, "rep").select("grp", "rep", "label", "side", "text")
    return cut(map_groups(rows, "grp", _exact(width, percent), "u bigint, v bigint").distinct(), name)


def _node_rows(members: DataFrame, level: int) -> DataFrame:
    """members(rep, mins[, tree, node]) -> (node, tree, rep) of the next level."""
    if level == 0:
        picks = [(t, b) for t in range(TREES) for b in range(BRANCHES)]
        made = [F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.lit(b), F.col("mins")[t * BRANCHES + b]).alias("node")) for t, b in picks]
    else:
        base = level * TREES * BRANCHES
        at = [F.col("tree") * BRANCHES + F.lit(base + b) for b in range(BRANCHES)]
        made = [F.struct("tree", F.xxhash64("node", F.lit(b), F.element_at("mins", (i + 1).cast("int"))).alias("node")) for b, i in enumerate(at)]
    return members.select("rep", F.explode(F.array(*made)).alias("x")).select("x.node", "x.tree", "rep")


def _leaf_groups(small: DataFrame, sigs: DataFrame, agree: int) -> DataFrame:
    """Distinct sketch-connected parts of the small nodes, as (grp, rep); equal nodes are looked at once."""
    once = small.groupBy("n", "low", "mark").agg(F.min("node").alias("node"))
    members = small.select("node", "rep").join(once.select("node"), "node", "semi").distinct()
    sketched = members.join(sigs, "rep").select("node", "rep", "sig")
    return cut(map_groups(sketched, "node", _sketch_parts(agree), "grp bigint, rep bigint").distinct(), "leaves")


def _counted(rows: DataFrame, leaf: int, name: str) -> tuple[DataFrame, DataFrame]:
    """rows(node, tree, rep) of the small and of the large nodes, each with n and what tells nodes of equal members (low, mark).

    Both are read from one table, so nothing is joined again where they are used.
    """
    sizes = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("rep").alias("low"), F.expr("bit_xor(xxhash64(rep))").alias("mark")).filter("n > 1")
    met = cut(rows.join(cut(sizes, f"sizes-{name}"), "node"), f"met-{name}")
    return met.filter(F.col("n") <= leaf).select("node", "rep", "n", "low", "mark"), met.filter(F.col("n") > leaf).select("node", "tree", "rep", "n")


def _labels(links: list[DataFrame]) -> DataFrame:
    return cut(components(reduce(DataFrame.unionByName, links)), "labels")


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    agree: int | None = None,
    leaf: int = 64,
    block: int = 8192,
) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable), kept.

    Links are confirmed on full sets: 100 * intersection >= percent * union.  Null and empty
    texts have an empty set and no link.  Rows with a null id are returned with component_id
    null and kept, and take no part in links; rows that repeat an id are one document whose
    links are those of all its texts.  Only id and text are read; an empty table gives an empty
    result.
    """
    agree = AGREE * percent // 85 if agree is None else agree
    spark = docs.sparkSession
    small_batches(spark)
    tidy(spark)
    sketched = cut(sketch(docs, id_col=id_col, text_col=text_col, width=width), "sketch")
    texts = docs.select(F.col(id_col).cast("bigint").alias("rep"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    usable = sketched.filter("n_shingles > 0 and doc_id is not null")
    classes = cut(usable.groupBy("set_hash").agg(F.min("doc_id").alias("rep")), "classes")
    reps = cut(usable.join(classes, [usable["set_hash"] == classes["set_hash"], usable["doc_id"] == classes["rep"]]).select("rep", "mins", "sig", "n_shingles"), "reps")
    sigs = reps.select("rep", "sig", "n_shingles")

    first, big = _counted(cut(_node_rows(reps, 0), "nodes-0"), leaf, "0")
    small = [first]
    # Rows that repeat an id with several texts tie their sets together.
    same = usable.join(classes, "set_hash").filter("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    repeated = usable.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select(F.col("doc_id").alias("u"))
    links = [same.join(repeated, "u", "semi").select("u", "v")]

    stars: list[DataFrame] = []
    for turn in range(FAMILY_TURNS):
        found = None if big.isEmpty() else _families(big, sigs, texts, width=width, percent=percent, leaf=leaf, block=block, turn=turn)
        if found is None:
            break
        stars.append(found[1][0])
        links += found[1]
        rows = cut(big.select("node", "tree", "rep").join(found[0], ["node", "rep"], "anti"), f"rest-{turn}")
        fallen, big = _counted(rows, leaf, f"family-{turn}")
        small.append(fallen)  # nodes that have become small are leaves like any other
        tidy(spark)
    for level in range(1, LEVELS + 1):
        if big.isEmpty():
            break
        if level == LEVELS:
            links.append(_rest_links(big, stars, sigs, texts, width=width, percent=percent, block=block))
            break
        rows = cut(_node_rows(big.select("node", "tree", "rep").join(reps.select("rep", "mins"), "rep"), level).distinct(), f"nodes-{level}")
        fallen, big = _counted(rows, leaf, f"{level}")
        small.append(fallen)
    tidy(spark)
    groups = _leaf_groups(reduce(DataFrame.unionByName, small), sigs, agree)
    leaves = groups.select("grp", "rep", F.col("rep").alias("label"), F.lit(0).alias("side"))
    links.append(_compare(leaves, texts, width=width, percent=percent, name="links-leaves"))
    tidy(spark)
    labels = _labels(links)
    named = classes.join(labels.withColumnRenamed("u", "rep"), "rep", "left").select("set_hash", F.coalesce("label", "rep").alias("component_id"))
    out = sketched.select("doc_id", "n_shingles", "set_hash").join(named, "set_hash", "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def ring_bar(percent: int) -> int:
    """Smallest hashes that agree at least: at the outer ring's least similarity, 3t - 2, fewer do in a share of RING_TAIL at most."""
    least = max(0.0, (3 * percent - 200) / 100)
    bar, below = 0, 0.0
    while bar < HASHES:
        below += comb(HASHES, bar) * least**bar * (1 - least) ** (HASHES - bar)
        if below > RING_TAIL:
            break
        bar += 1
    return bar


def _agreement(rows: DataFrame, sigs: DataFrame) -> DataFrame:
    """rows(pivot, rep) with k, the number of smallest hashes that agree, and n_shingles of rep."""

    @F.pandas_udf("int")
    def agreeing(a: pd.Series, b: pd.Series) -> pd.Series:
        x = np.frombuffer(b"".join(a), np.uint16).reshape(len(a), HASHES)
        y = np.frombuffer(b"".join(b), np.uint16).reshape(len(b), HASHES)
        return pd.Series((x == y).sum(axis=1).astype(np.int32))

    both = rows.join(sigs, "rep").join(sigs.select(F.col("rep").alias("pivot"), F.col("sig").alias("other")), "pivot")
    return both.select("pivot", "rep", agreeing("sig", "other").alias("k"), "n_shingles")


def _span(block: int, only: Column | None = None) -> Column:
    """Of rows with n_shingles, or those of them that `only` holds for: so many blocks keep each near `block` rows and BLOCK_SHINGLES."""
    weight = F.greatest(F.lit(1 / block), F.col("n_shingles") / BLOCK_SHINGLES)
    return F.ceil(F.sum(weight if only is None else F.when(only, weight))).cast("int")


def _place(blocks: str) -> Column:
    return F.pmod(F.xxhash64("rep"), blocks).cast("int")


def _blocks(rows: DataFrame, key: str, block: int) -> DataFrame:
    """rows(key, rep, n_shingles) with blocks, their number for the key, and b, the row's."""
    return rows.join(rows.groupBy(key).agg(_span(block).alias("blocks")), key).withColumn("b", _place("blocks"))


def _families(big: DataFrame, sigs: DataFrame, texts: DataFrame, *, width: int, percent: int, leaf: int, block: int, turn: int):
    """(settled places of members, links) of the families in large nodes, or None if there is no family.

    An inner member is settled in the nodes that hold its pivot too: all others there were compared
    with the pivot.  In its other nodes it branches on.  Every member of a node that is done is settled.
    Rows of the groups grow in proportion to a family until it fills several blocks.
    """
    central = big.groupBy("rep").agg(F.sum("n").alias("c"))
    # Beside the most central member two others by hash, so that a node with several families loses more than one.
    others = [F.max_by("rep", F.xxhash64(F.lit(turn), F.lit(k), "rep")) for k in range(2)]
    heads = big.join(central, "rep").groupBy("node").agg(F.array_distinct(F.array(F.max_by("rep", F.struct("c", -F.col("rep"))), *others)).alias("pivots"))
    heads = heads.select("node", F.explode("pivots").alias("pivot"))
    near = _agreement(big.join(heads, "node").select("pivot", "rep").distinct(), sigs).filter(F.col("k") >= HASHES * percent // 100)
    pivots = near.groupBy("pivot").agg(F.count("*").alias("n")).filter(F.col("n") > leaf // 2).select("pivot")
    pivots = cut(pivots.join(central.withColumnRenamed("rep", "pivot"), "pivot"), f"pivots-{turn}")
    if pivots.isEmpty():
        return None
    nodes = cut(big.select("node", F.col("rep").alias("pivot")).join(pivots, "pivot"), f"pivots-at-{turn}")
    # One pivot for a family: it goes where a more central one is much like it.
    rivals = nodes.join(nodes.select("node", F.col("pivot").alias("rep"), F.col("c").alias("d")), "node").filter("struct(c, -pivot) > struct(d, -rep)").select("pivot", "rep").distinct()
    beaten = _agreement(rivals, sigs).filter(F.col("k") >= AGREE + 4).select(F.col("rep").alias("pivot")).distinct()
    nodes = cut(nodes.join(beaten, "pivot", "anti").select("node", "pivot"), f"pivot-nodes-{turn}")
    # In each of its nodes a pivot meets every member once, in one table for all that follows.
    around = cut(nodes.join(big.select("node", "rep"), "node").filter("rep <> pivot"), f"around-{turn}")
    pairs = _agreement(around.select("pivot", "rep").distinct(), sigs).filter(F.col("k") >= ring_bar(percent)).select("pivot", "rep", "n_shingles")
    placed = _blocks(cut(pairs, f"pivot-pairs-{turn}"), "pivot", block)
    members = placed.select("rep", F.xxhash64("pivot", "b").alias("grp"), F.lit(1).alias("side"))
    leads = placed.select(F.col("pivot").alias("rep"), F.xxhash64("pivot", "b").alias("grp"), F.lit(0).alias("side")).distinct()
    groups = cut(members.unionByName(leads), f"pivot-groups-{turn}")
    with_text = groups.join(only_near(texts, "rep", groups.select("rep").distinct()), "rep").select("grp", "rep", "side", "text")
    ring = map_groups(with_text, "grp", _similar(width), "pivot bigint, rep bigint, both bigint, either bigint, n_shingles bigint")
    least = lambda p: (100 * F.col("both") >= p * F.col("either")).alias(f"at_{p}")
    linked, inner, outer = (f"at_{p}" for p in (percent, 2 * percent - 100, 3 * percent - 200))
    ring = cut(ring.select("pivot", "rep", "n_shingles", least(percent), least(2 * percent - 100), least(3 * percent - 200)).filter(outer), f"rings-{turn}")
    # Both rings, without what links to the pivot, against the whole outer ring; each row knows its pivot's blocks of either side.
    counts = ring.groupBy("pivot").agg(_span(block).alias("blocks"), _span(block, ~F.col(linked)).alias("asking")).filter("asking is not null")
    asked = cut(ring.join(counts, "pivot").select("pivot", "rep", linked, "blocks", "asking", _place("blocks").alias("b"), _place("asking").alias("own")), f"asked-{turn}")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.filter(f"not {linked}").select("pivot", F.col("own").alias("o"), every("blocks").alias("b"), "rep", F.col("rep").alias("label"), F.lit(0).alias("side"))
    label = F.when(F.col(linked), F.col("pivot")).otherwise(F.col("rep")).alias("label")
    right = asked.select("pivot", every("asking").alias("o"), "b", "rep", label, F.lit(1).alias("side"), linked, "own")
    # An asking member lies in the groups of its own asking block already, and meets all members there.
    right = right.filter(F.col(linked) | (F.col("o") != F.col("own"))).drop(linked, "own")
    across = left.unionByName(right).select(F.xxhash64("pivot", "o", "b").alias("grp"), "rep", "label", "side")
    # Nodes that hold few others beside a family are done with once these meet the rim: no inner member links to them.
    strangers = cut(around.join(ring, ["pivot", "rep"], "anti").select("node", "pivot", "rep"), f"strangers-{turn}")
    few = strangers.groupBy("node", "pivot").agg(F.count("*").alias("k"))
    done = nodes.join(few, ["node", "pivot"], "left").filter(F.coalesce("k", F.lit(0)) <= leaf).groupBy("node").agg(F.min("pivot").alias("pivot"))
    done = cut(done, f"done-{turn}")
    rim = around.join(done, ["node", "pivot"], "semi").join(ring.filter(f"not {inner}").select("pivot", "rep", "n_shingles"), ["pivot", "rep"])
    rim = rim.groupBy("node", "rep").agg(F.max("n_shingles").alias("n_shingles"))
    rim = cut(_blocks(cut(rim, f"rim-rows-{turn}"), "node", block).select("node", "rep", "b", "blocks"), f"rim-{turn}")
    in_blocks = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("b")
    meets = strangers.join(done, ["node", "pivot"], "semi").join(rim.select("node", "blocks").distinct(), "node", "left").select("node", "rep", in_blocks).withColumn("side", F.lit(0))
    meets = meets.unionByName(rim.select("node", "rep", "b").withColumn("side", F.lit(1)))
    meets = meets.select(F.xxhash64(F.lit("rim"), "node", "b").alias("grp"), "rep", F.col("rep").alias("label"), "side")
    found = _compare(cut(across.unionByName(meets), f"ring-groups-{turn}"), texts, width=width, percent=percent, name=f"links-rings-{turn}")
    places = around.join(ring.filter(inner).select("pivot", "rep"), ["pivot", "rep"], "semi").select("node", "rep").unionByName(nodes.select("node", F.col("pivot").alias("rep")))
    settled = places.unionByName(big.join(done, "node", "semi").select("node", "rep")).distinct()
    return settled, [ring.filter(linked).select(F.col("rep").alias("u"), F.col("pivot").alias("v")), found]


def _rest_links(big: DataFrame, stars: list[DataFrame], sigs: DataFrame, texts: DataFrame, *, width: int, percent: int, block: int) -> DataFrame:
    """In nodes that are still large and mixed: members outside the largest group against all, in blocks.

    Members that link to one pivot are a group already.
    """
    last = big.select("node", "rep").distinct()
    if stars:
        labels = reduce(DataFrame.unionByName, stars).groupBy(F.col("u").alias("rep")).agg(F.min("v").alias("label"))
        last = last.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    else:
        last = last.withColumn("label", F.col("rep"))
    by_label = last.groupBy("node", "label").agg(F.count("*").alias("k"))
    main = by_label.groupBy("node").agg(F.max_by("label", F.struct("k", "label")).alias("main"))
    own = cut(_blocks(last.join(main, "node").join(sigs.select("rep", "n_shingles"), "rep"), "node", block).drop("n_shingles"), "rest-rows")
    outside = own.filter("label <> main")
    out_blocks = outside.select("node", F.col("b").alias("o")).distinct()
    span = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("a")
    left = outside.select("node", "rep", "label", F.col("b").alias("o"), "blocks").select("node", "rep", "label", "o", span).withColumn("side", F.lit(0))
    # A member outside the largest group lies in its own block's groups already, and meets all members there.
    right = own.withColumnRenamed("b", "a").join(out_blocks, "node").filter("label = main or o <> a").select("node", "rep", "label", "o", "a").withColumn("side", F.lit(1))
    both = left.select("node", "o", "a", "rep", "label", "side").unionByName(right.select("node", "o", "a", "rep", "label", "side"))
    groups = both.select(F.xxhash64("node", "o", "a").alias("grp"), "rep", "label", "side")
    return _compare(cut(groups, "rest-groups"), texts, width=width, percent=percent, name="links-rest")


def op8_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), width=3, percent=85)
