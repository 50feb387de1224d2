"""Near duplicates by MinHash with tensored banding.

A text is the set of its five-word shingles. Two small collections of half keys are made from each
set, ``HALVES`` on either side, each of ``ROWS`` minimum hashes. A table of the search is a pair of
one half key from either side, so 2 x HALVES x ROWS minimum hashes serve HALVES ** 2 tables. A pair
of resemblance J shares a table with probability (1 - (1 - J ** ROWS) ** HALVES) ** 2; at 0.75 and
the values here that is 0.9997 and at 0.8 it is above 0.99999.

Texts with the same set are one node. Half keys that only one node has are dropped. Each node is
first compared with the leader it shares the most half keys with, which connects most groups, then with
the hub of half keys that still have nodes of several components: the node that shares the most with
others. What is left are half keys with nodes of several components. The nodes outside the largest component of
a half key are queries; tables are made of these half keys only, and every node that shares a table
bucket with a block of queries is compared on full sets with the whole block, by an index of the
block's shingles. So each two nodes of a bucket are compared or already connected, and a node meets
a block once, not once for each pair: a bucket of thousands of copies costs its size.

Odd input: a text without words is linked with nothing. Rows with a null id are not linked, get a
null component and are kept. Rows with equal texts share a component. Repeated ids give one output
row for each input row; when an id has several texts, each row follows its own text: nodes have
numbers of their own, and the least id of each is carried beside.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm import common as C

HALVES = 16
ROWS = 3
#: Query nodes of a block and their shingles, about; a task holds one block and a part of the rows.
BLOCK_NODES = 256
BLOCK_SHINGLES = 400_000

_ODD = np.random.default_rng(20240229).integers(0, 1 << 63, size=2 * HALVES * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def half_keys(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 2 x HALVES half keys for each set; zeros for an empty one."""
    out = np.zeros((len(sets), 2 * HALVES), dtype=np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat = np.concatenate([sets[i] for i in full])
    starts = np.cumsum([0, *[len(sets[i]) for i in full[:-1]]])
    key = None
    for k, odd in enumerate(_ODD):
        least = C.mix(np.minimum.reduceat(flat * odd, starts))
        key = least if k % ROWS == 0 else C.mix(key * np.uint64(3) + least)
        if k % ROWS == ROWS - 1:
            out[full, k // ROWS] = key
    return out


def _digests(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())


def _sketches(texts: list[bytes]) -> list[pa.Array]:
    sets = [C.shingles(t) for t in texts]
    keys = half_keys(sets).view(np.int64)
    return [
        pa.array([len(s) for s in sets], pa.int64()),
        _digests(sets),
        C.list_array(list(keys), pa.int64()),
    ]


def _sets(texts: list[bytes]) -> list[pa.Array]:
    sets = [C.shingles(t) for t in texts]
    return [_digests(sets), C.list_array([s.view(np.int64) for s in sets], pa.int64())]


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, v) whose full sets are near."""
    a = sets.select(F.col("node").alias("u"), F.col("shingles").alias("su"))
    b = sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv"))
    both = F.size(F.array_intersect("su", "sv"))
    return (
        pairs.join(a, "u")
        .join(b, "v")
        .where(both * 100 >= (F.size("su") + F.size("sv") - both) * C.NEAR_PERCENT)
        .select("u", "v")
    )


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (least id reachable over links), kept."""
    C.prepare(docs.sparkSession)
    root = F.coalesce("component", "id")
    return _components(docs, id_col, text_col).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), root).alias("component_id"),
        F.coalesce(F.col("id") == root, F.lit(True)).alias("kept"),
    )


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n and digest of each row, with the least id of its component and the digest that keeps it."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # Texts are read once here; later steps use this table, about a tenth of the text's size.
    rows = C.map_texts(base, "text", _sketches, "n long, digest binary, half array<long>", keep=["id"]).checkpoint()
    # Equal sets are one node; their half keys are the same. An id may be the least of several nodes.
    known = rows.where("id IS NOT NULL AND digest IS NOT NULL")
    least = known.groupBy("digest").agg(F.min("id").alias("least")).select("least", F.col("digest").alias("own"))
    nodes = known.join(least, (F.col("digest") == F.col("own")) & (F.col("id") == F.col("least"))).select("digest", "least", "n", "half").dropDuplicates(["digest"])
    # The numbers are fixed by the checkpoint.
    nodes = nodes.withColumn("node", F.monotonically_increasing_id()).checkpoint()
    stars = _stars(nodes, base)
    named = (
        nodes.select("digest", "node", "least")
        .join(stars.withColumnRenamed("u", "node"), "node", "left")
        .select("digest", "least", F.coalesce("root", "node").alias("root"))
    )
    keepers = named.groupBy("root").agg(F.min(F.struct("least", "digest")).alias("keeper"))
    named = named.join(keepers, "root").select("digest", F.col("keeper.least").alias("component"), F.col("keeper.digest").alias("keeper"))
    return rows.select("id", "n", "digest").join(named, "digest", "left")


def _stars(nodes: DataFrame, base: DataFrame) -> DataFrame:
    """Stars (u, root) of the confirmed links between nodes."""
    slots = ["slot", "h"]
    half = nodes.select("node", F.posexplode("half").alias("slot", "h"))
    shared = half.groupBy(*slots).agg(F.min("node").alias("lead"), F.max("node").alias("hi")).where("lead < hi").drop("hi").checkpoint()
    # First each node with the leader that it shares the most half keys with.
    votes = half.join(shared, slots).groupBy("node", "lead").count()
    best = votes.groupBy("node").agg(F.max(F.struct("count", F.negative("lead").alias("less"))).alias("best"))
    firsts = best.select(F.col("node").alias("u"), F.negative("best.less").alias("v")).checkpoint()
    sets = _node_sets(base, nodes, firsts.select(F.col("u").alias("node")))
    tree = C.tree_roots(_confirmed(firsts.where("u != v"), sets))
    # What is left: half keys with nodes of several components. There each node is compared with the
    # node that shares the most with others, as the text that many copies were made of does.
    known = tree.select("u", F.col("root").alias("v"))
    hubs = _hubs(_open_half(nodes, tree, shared).checkpoint())
    known = known.union(_confirmed(hubs, sets)).checkpoint()
    open_half = _open_half(nodes, C.min_label_edges(known), shared)
    sides = (
        open_half.groupBy("node", "n")
        .agg(
            F.min("lead").alias("lead"),
            F.bool_or(F.col("root") != F.col("major")).alias("query"),
            F.collect_list(F.struct(*slots)).alias("halves"),  # at most 2 x HALVES
        )
        .checkpoint()
    )
    links = _confirmed_in_blocks(_blocked(sides), sets)
    return C.min_label_edges(known.union(links))


def _open_half(nodes: DataFrame, stars: DataFrame, shared: DataFrame) -> DataFrame:
    """Half keys that nodes of several components have, with each node's root and the largest component.

    Of two nodes in different components, one at least is outside the component that has most nodes of
    their half key: a query node.
    """
    slots = ["slot", "h"]
    rooted = nodes.join(stars.withColumnRenamed("u", "node"), "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"), "half")
    rooted = rooted.select("node", "n", "root", F.posexplode("half").alias("slot", "h")).join(shared, slots)
    sizes = rooted.groupBy(*slots, "root").count().groupBy(*slots).agg(F.max(F.struct("count", "root")).alias("most"), F.count(F.lit(1)).alias("roots"))
    return rooted.join(sizes.where("roots > 1").select(*slots, F.col("most.root").alias("major")), slots)


def _hubs(half: DataFrame) -> DataFrame:
    """Each node (u) with the node (v) of another component that it shares the most half keys with, among
    those that share the most of all in a half key.
    """
    slots = ["slot", "h"]
    sizes = half.groupBy(*slots).agg(F.count(F.lit(1)).alias("size"))
    weights = half.join(sizes, slots).groupBy("node").agg(F.sum("size").alias("weight"))
    hub = half.join(weights, "node").groupBy(*slots).agg(F.max(F.struct("weight", "node", "root")).alias("hub"))
    votes = half.join(hub.select(*slots, "hub.node", "hub.root").toDF(*slots, "v", "to"), slots).where("root != to")
    counts = votes.groupBy("node", "v").count()
    best = counts.groupBy("node").agg(F.max(F.struct("count", "v")).alias("best"))
    return best.select(F.col("node").alias("u"), F.col("best.v").alias("v"))


def _blocked(sides: DataFrame) -> DataFrame:
    """Adds the block of the query nodes: neighbours by leader, about BLOCK_NODES or BLOCK_SHINGLES a block."""
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_NODES, F.sum("n") / BLOCK_SHINGLES))
    counts = sides.where("query").groupBy("lead").agg(parts.alias("parts"))
    block = F.when(F.col("query"), F.xxhash64("lead", F.pmod(F.xxhash64("node"), F.col("parts"))))
    return sides.join(counts, "lead", "left").select("node", "n", "halves", block.alias("block"))


def _confirmed_in_blocks(sides: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) between query nodes and all nodes that share a bucket of a table with their block."""
    # A table's key is a pair (a, b) of half keys, one from either side. A node is in a bucket with a
    # block if it shares a half key of each side with it; side a is looked up first, side b only for
    # what side a has left, so no node is written out under its HALVES ** 2 keys.
    half = sides.select("node", "n", "block", F.explode("halves").alias("k")).select("node", "n", "block", "k.slot", "k.h")
    asked = half.where("block IS NOT NULL").select("slot", "h", F.col("block").alias("query_block")).distinct()
    first = half.where(F.col("slot") < HALVES).join(asked, ["slot", "h"]).select("node", F.col("query_block").alias("block")).distinct()
    # What a block asks for on side b is one list, at most HALVES for each of its nodes.
    wanted = asked.where(F.col("slot") >= HALVES).groupBy("query_block").agg(F.collect_list(F.struct("slot", "h")).alias("wanted"))
    paired = first.join(sides.select("node", "n", "halves"), "node").join(wanted.withColumnRenamed("query_block", "block"), "block")
    near = paired.where(F.arrays_overlap("halves", "wanted")).select("node", "n", "block").checkpoint()
    salts = F.ceil(F.greatest(F.count(F.lit(1)) / (8 * BLOCK_NODES), F.sum("n") / (8 * BLOCK_SHINGLES))).cast("int")
    counts = near.groupBy("block").agg(salts.alias("salts")).checkpoint()
    rows = near.join(counts, "block").join(sets, "node").select("block", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), "node", "shingles")
    own = sets.select(F.col("node").alias("query"), F.col("shingles").alias("query_shingles"))
    blocks = (
        sides.where("block IS NOT NULL")
        .select(F.col("node").alias("query"), "block")
        .join(counts, "block")
        .select("query", F.col("block").alias("query_block"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("query_salt"))
        .join(own, "query")
        .select("query_block", "query_salt", "query", "query_shingles")
    )
    return blocks.groupBy("query_block", "query_salt").cogroup(rows.groupBy("block", "salt")).applyInArrow(_links_of_block, "u long, v long")


def _node_sets(base: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Full sets (node, shingles) of the wanted nodes, from the texts that have them."""
    known = nodes.select("digest", "node", F.col("least").alias("id")).join(wanted, "node", "left_semi")
    own = base.join(C.id_filter(known.select(F.col("id").alias("least")).distinct()), F.col("id") == F.col("least"), "left_semi")
    sets = C.map_texts(own, "text", _sets, "digest binary, shingles array<long>", keep=["id"])
    # An id that stands for a node may have other texts as well.
    return sets.join(known, ["id", "digest"]).dropDuplicates(["node"]).select("node", "shingles").checkpoint()


def _links_of_block(queries: pa.Table, rows: pa.Table) -> pa.Table:
    """Links that connect what near pairs of a block's sets and the rows' sets connect.

    Pairs are found by one sorted index of the block's shingles. Only those that join two groups are
    given, so a call makes fewer links than it has queries and rows, however many pairs are near.
    """
    C.use(__name__)
    nodes = queries["query"].to_numpy()
    place = {node: i for i, node in enumerate(nodes.tolist())}
    group = np.arange(len(nodes))
    lists = queries["query_shingles"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(flat, kind="stable")
    index, owner = flat[order], np.repeat(np.arange(len(nodes)), sizes)[order]
    us, vs = [], []
    for node, own in zip(rows["node"].to_pylist(), (r.values for r in rows["shingles"])):
        own = own.to_numpy(zero_copy_only=False)
        lo, hi = np.searchsorted(index, own, "left"), np.searchsorted(index, own, "right")
        hit = hi > lo
        # Every position of the index that one of the row's shingles has.
        count = hi[hit] - lo[hit]
        at = np.repeat(lo[hit] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        both = np.bincount(owner[at], minlength=len(nodes))
        near = both * 100 >= (sizes + len(own) - both) * C.NEAR_PERCENT
        mine = place.get(node)
        at = np.flatnonzero(near)
        groups, first = np.unique(group[at], return_index=True)
        if mine is not None:
            first = first[groups != group[mine]]
        us.append(np.full(len(first), node, dtype=np.int64))
        vs.append(nodes[at[first]])
        if len(groups) > 1:
            group[np.isin(group, groups)] = groups[0]
    none = np.empty(0, dtype=np.int64)
    return pa.table({"u": np.concatenate([none, *us]), "v": np.concatenate([none, *vs])})


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near copies: of each component the text with the least id stays.

    Repeated rows stay once; rows with a null id all stay. Texts go, not ids: another text of an id
    stays if it is no near copy.
    """
    C.prepare(docs.sparkSession)
    found = _components(docs, id_col, text_col).where("id IS NOT NULL")
    gone = F.coalesce((F.col("id") != F.col("component")) | (F.col("digest") != F.col("keeper")), F.lit(False))
    found = found.select("id", "digest", gone.alias("gone")).checkpoint()
    ids = found.groupBy("id").agg(F.bool_and("gone").alias("all"), F.bool_or("gone").alias("some"))
    row = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("_id"))
    kept = row.join(C.id_filter(ids.where("all").select(F.col("id").alias("_gone"))), F.col("_id") == F.col("_gone"), "left_anti")
    # Ids with texts of both kinds: only theirs are hashed again.
    mixed = ids.where("some AND NOT `all`").select(F.col("id").alias("_mixed")).checkpoint()
    if not mixed.isEmpty():
        mixed = C.id_filter(mixed)
        texts = kept.join(mixed, F.col("_id") == F.col("_mixed"), "left_semi").withColumn("text", F.col(f"row.`{text_col}`"))
        texts = C.map_texts(texts, "text", lambda t: [_digests([C.shingles(x) for x in t])], "digest binary", keep=["row", "_id"])
        pairs = found.where("gone").select(F.col("id").alias("_id"), "digest").distinct()
        kept = kept.join(mixed, F.col("_id") == F.col("_mixed"), "left_anti").union(texts.join(pairs, ["_id", "digest"], "left_anti").select("row", "_id"))
    # Only rows whose id comes up again can repeat each other; the others need not be compared.
    again = row.where("_id IS NOT NULL").groupBy("_id").count().where("count > 1").select(F.col("_id").alias("_again"))
    again = C.id_filter(again)
    once = kept.join(again, F.col("_id") == F.col("_again"), "left_anti")
    more = kept.join(again, F.col("_id") == F.col("_again"), "left_semi").dropDuplicates(["_id", "row"])
    return once.union(more).select("row.*")
