"""Average-linkage clusters of unit vectors, close pairs, medoids and cosine ranking.

For unit vectors the mean cosine distance between two clusters is ``1 - mean_a . mean_b``, so a
cluster is fully described by its size and mean; no pair table is kept. Average linkage is
reducible: two clusters that are each other's nearest may merge at once, whatever happens
elsewhere, and a cluster without a neighbour inside the cut never gets one. Merging all mutual
nearest pairs per round, and retiring clusters without a neighbour, gives the clusters of the
one-merge-at-a-time rule in a logarithmic number of rounds.

A cluster whose nearest neighbour has not merged keeps it, as no merged cluster is nearer than its nearer part: only the others
look for one again, among all.

Vectors are packed by blocks, a row each, and a task compares some blocks of one side with some of the other, in
slices; it keeps one nearest neighbour of each vector, so what is sent and held doesn't follow the number of pairs.
Brands of many blocks are searched by an index of pivots. Each vector belongs to the cell of the pivot it has the
least angle with, and a cell knows its widest angle. Two vectors can be within the cut only if the angle
between them is at most that of the cut (means are no longer than 1, so this holds for them as well), and
angles obey the triangle inequality: cells can hold such vectors only if their pivots are at most that angle farther
from each other than both cells are wide, and at most twice that angle farther than twice the narrower one.
Neighbouring cells share blocks; blocks without two such cells never meet. With wide cuts all do.

Brands whose distinct vectors fit one block run all rounds inside one task, also when that is so only
after some rounds. Equal vectors are merged before anything else, so a pile of copies is one row.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot import config
from earshot.functions import scalars as S
from earshot.operators.ranking import top_per_group
from earshot.settings import keep, store

BLOCK = 2048
_NEAREST = "brand string, cid string, d double, other string"
_MERGED = "brand string, child string, parent string"


def with_unit_vectors(vectors: DataFrame) -> DataFrame:
    """F33, and a short key that is equal for equal vectors."""
    unit = vectors.withColumn("unit", S.unit_vector("vector"))
    return unit.withColumn("vkey", F.md5(F.to_json(F.struct("unit"))))


def distinct_vectors(unit: DataFrame) -> DataFrame:
    """One row per brand and vector, named by its lowest mention id, with its copies counted."""
    return unit.groupBy("brand", "vkey").agg(
        F.min("mention_id").alias("cid"),
        F.count(F.lit(1)).alias("size"),
        F.first("unit").alias("mean"),
    )


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _rows(brand: str, **columns) -> pd.DataFrame:
    """A result frame with plain object columns for text, whatever the number of rows."""
    n = len(next(iter(columns.values())))
    out = {"brand": np.full(n, brand, dtype=object)}
    for name, values in columns.items():
        values = np.asarray(values)
        out[name] = values.astype(object) if values.dtype.kind in "OUT" or n == 0 else values
    return pd.DataFrame(out)


def _distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    d = left @ right.T
    np.subtract(1.0, d, out=d)
    return np.clip(d, 0.0, 2.0, out=d)


#: Pivots for each block of a brand, and pivots of a brand at most; larger cells have more blocks.
PIVOTS_PER_BLOCK = 4
MAX_PIVOTS = 1024
#: Brands of at most so many blocks need no pivots: all pairs of their blocks meet.
PLAIN_BLOCKS = 16
#: Rows that are compared with the pivots in one task.
CHUNK = 16_384
#: Bytes of vectors on one side of a task, one block at least; distances that are held at once.
SIDE_BYTES = 1 << 23
SLICE = 1 << 20
#: Angles are taken a little wider, as they come from rounded cosines.
_SLACK = 1e-6
#: With cuts beyond this angle hardly any cells are too far from each other, so that there are none.
_WIDE = np.pi / 3


def _widest(cut: float) -> float:
    """The widest angle of two vectors within ``cut``; beyond a right angle short means know no bound."""
    return float(np.arccos(1.0 - cut)) + _SLACK if 0 <= cut < 1 else np.pi


def _slices(n: int, width: int) -> Iterator[slice]:
    """Runs of ``n`` rows, each with about ``SLICE`` values of ``width`` others."""
    step = max(1, SLICE // max(1, width))
    return (slice(at, min(at + step, n)) for at in range(0, n, step))


def _angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    long = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.arccos(np.clip(rows / np.where(long > 0, long, 1.0) @ pivots.T, -1.0, 1.0))


def _with_pivots(rows: DataFrame, pivots: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(rows, pivots)`` for each chunk of a brand's rows and all pivots of the brand."""
    sizes = rows.groupBy("brand").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("_n"))
    chunk = F.pmod(F.xxhash64("cid"), F.col("_n")).cast("int")
    dealt = rows.join(sizes, "brand").withColumn("_chunk", chunk).drop("_n")
    # The sides share ancestors, so their keys need names of their own.
    every = pivots.join(sizes, "brand").withColumn("_for", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    every = every.select(F.col("brand").alias("_of"), "_for", *[F.col(c).alias(c) for c in pivots.columns if c != "brand"])
    return dealt.groupBy("brand", "_chunk").cogroup(every.groupBy("_of", "_for")).applyInPandas(fn, schema)


def _cells(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Vectors with their cell, and the cells: (brand, cell, held, pivot, radius)."""
    counted = rows.groupBy("brand").agg(F.count(F.lit(1)).alias("_n"))
    wanted = F.when(F.col("_n") <= block, 1).otherwise(F.least(F.lit(MAX_PIVOTS), F.ceil(PIVOTS_PER_BLOCK * F.col("_n") / block)))
    ranked = top_per_group(rows.select("brand", "cid"), ["brand"], [F.xxhash64("cid"), F.col("cid")], MAX_PIVOTS, "_rank")
    chosen = ranked.join(counted, "brand").filter(F.col("_rank") <= wanted).select("brand", "cid", (F.col("_rank") - 1).cast("int").alias("cell"))
    pivots = keep(chosen.join(rows.select("brand", "cid", "mean"), ["brand", "cid"]).select("brand", "cell", F.col("mean").alias("pivot")))
    schema = "brand string, cid string, size long, mean array<double>, fresh boolean, cell int, angle double"

    def settle(pdf: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        near = near.sort_values("cell", ignore_index=True)
        mean, pivot = _matrix(pdf["mean"]), _unit_matrix(near["pivot"])
        own, least = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf))
        for part in _slices(len(pdf), len(pivot)):
            angles = _angles(mean[part], pivot)
            own[part], least[part] = angles.argmin(axis=1), angles.min(axis=1)
        return pdf[["brand", "cid", "size", "mean", "fresh"]].assign(cell=near["cell"].to_numpy()[own], angle=least)

    settled = keep(_with_pivots(rows, pivots, settle, schema))
    radii = settled.groupBy("brand", "cell").agg(F.count(F.lit(1)).alias("held"), F.max("angle").alias("radius"))
    return settled.drop("angle"), pivots.join(radii, ["brand", "cell"]).select("brand", "cell", "held", "pivot", "radius")


def _unit_matrix(column: pd.Series) -> np.ndarray:
    m = _matrix(column)
    long = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(long > 0, long, 1.0)


def _chain(angles: np.ndarray) -> list[int]:
    """All cells, from each to the nearest that is left."""
    left, order = np.ones(len(angles), dtype=bool), [0]
    left[0] = False
    for _ in range(len(angles) - 1):
        order.append(int(np.where(left, angles[order[-1]], np.inf).argmin()))
        left[order[-1]] = False
    return order


def _filled(held: np.ndarray, order: list[int], block: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The first block of each cell, how many it has, and the blocks of all; small cells that follow share one."""
    first, many = np.zeros(len(held), dtype=np.int64), np.ones(len(held), dtype=np.int64)
    at, room = -1, 0
    for cell in order:
        if held[cell] > block:
            first[cell], many[cell], room = at + 1, -(-held[cell] // block), 0
            at += many[cell]
            continue
        if held[cell] > room:
            at, room = at + 1, block
        first[cell], room = at, room - held[cell]
    return first, many, at + 1


_PLACED = "brand string, cell int, first int, many int, _cell int, _guests int, _side int, _block int, meets array<int>"


def _plan(cut: float, block: int):
    """For the cells of one brand: their blocks, and which blocks each task holds and compares.

    A task is a run of blocks (``_cell``) and the same or a later one (``_guests``); ``meets`` of a block of its first run
    (``_side`` 0) are the blocks it is compared with, itself or later ones.
    """
    wide = _widest(cut)

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell", ignore_index=True)
        near, order = np.ones((len(pdf), len(pdf)), dtype=bool), list(range(len(pdf)))
        if len(pdf) > 1:
            pivots, radius = _unit_matrix(pdf["pivot"]), pdf["radius"].to_numpy()
            angles = _angles(pivots, pivots)
            far = np.minimum(radius[:, None] + radius[None, :] + wide, 2 * np.minimum(radius[:, None], radius[None, :]) + 2 * wide)
            near = (angles <= far + 2 * _SLACK) | np.eye(len(pdf), dtype=bool)
            order = _chain(angles)
        first, many, n = _filled(pdf["held"].to_numpy(), order, block)
        cell_of, block_of = np.repeat(np.arange(len(pdf)), many), np.concatenate([np.arange(f, f + m) for f, m in zip(first, many)])
        within = np.zeros((len(pdf), n), dtype=np.float32)
        within[cell_of, block_of] = 1
        by_block = near.astype(np.float32) @ within
        run = max(1, min(SIDE_BYTES // (8 * max(1, int(pdf["dims"].iloc[0])) * block), -(-n // 8)))
        rows = [(int(c), int(f), int(m), None, None, None, None, None) for c, f, m in zip(pdf["cell"], first, many)]
        for low in range(0, n, run):
            # Blocks of this run by all later ones.
            met = within[:, low : low + run].T @ by_block[:, low:] > 0
            met &= np.arange(n - low)[None, :] >= np.arange(len(met))[:, None]
            for high in range(low, n, run):
                some = met[:, high - low : high - low + run]
                if not some.any():
                    continue
                at = (low // run, high // run)
                rows += [(None, None, None, *at, 0, low + int(i), (high + np.flatnonzero(some[i])).tolist()) for i in np.flatnonzero(some.any(axis=1))]
                if high > low:
                    rows += [(None, None, None, *at, 1, high + int(j), []) for j in np.flatnonzero(some.any(axis=0))]
        names = ["cell", "first", "many", "_cell", "_guests", "_side", "_block", "meets"]
        out = pd.DataFrame(rows, columns=names, dtype=object)
        return out.astype(dict.fromkeys(names[:-1], "Int32")).assign(brand=pdf["brand"].iloc[0])[["brand", *names]]

    return plan


_TASK = ["brand", "_cell", "_guests"]


def block_tasks(rows: DataFrame, cut: float, block: int) -> DataFrame:
    """Blocks of vectors dealt to tasks: a run of blocks (``_side`` 0) and a later run that it is compared with (1).

    Each row is a block: its names in order, sizes, and all numbers as one binary; ``meets`` as in ``_plan``. A run by itself
    has no other side. A brand's blocks are sent once for each run of blocks they meet, in runs of ``SIDE_BYTES``.
    Where ``rows`` tell which are ``fresh``, only those look for others.
    """
    fresh = F.col("fresh") if "fresh" in rows.columns else F.lit(True)
    named = rows.select("brand", "cid", "size", "mean", fresh.alias("fresh"))
    counted = named.groupBy("brand").agg(F.count(F.lit(1)).alias("held"), F.max(F.size("mean")).alias("dims"))
    limit = PLAIN_BLOCKS * block if _widest(cut) <= _WIDE else 2**62
    large = (counted.agg(F.max("held")).first()[0] or 0) > limit
    zero = F.lit(0).cast("int")
    # A brand of one block meets itself alone; one of few blocks is one cell.
    single = counted.filter(F.col("held") <= block).select(
        "brand", zero.alias("_cell"), zero.alias("_guests"), zero.alias("_side"), zero.alias("_block"), F.array(zero).alias("meets")
    )
    plain = counted.filter((F.col("held") > block) & (F.col("held") <= limit))
    plain = plain.select("brand", zero.alias("cell"), "held", "dims", F.lit(None).cast("array<double>").alias("pivot"), F.lit(0.0).alias("radius"))
    cells = lambda df: df.groupBy("brand").applyInPandas(_plan(cut, block), _PLACED)
    places = single.unionByName(cells(plain).filter("cell is null").select(*single.columns))
    own = lambda many: F.pmod(F.xxhash64("cid"), many).cast("int")
    few = named.join(counted.filter(F.col("held") <= limit).select("brand", "held"), "brand")
    dealt = few.withColumn("_block", own(F.ceil(F.col("held") / block))).drop("held")
    if large:
        sizes = counted.filter(F.col("held") > limit).select("brand", "dims")
        home, wide = _cells(named.join(sizes.select("brand"), "brand", "left_semi"), block)
        planned = keep(cells(wide.join(sizes, "brand")))
        places = places.unionByName(planned.filter("cell is null").select(*single.columns))
        where = planned.filter("cell is not null").select("brand", "cell", "first", "many")
        placed = home.join(where, ["brand", "cell"]).withColumn("_block", F.col("first") + own(F.col("many")))
        dealt = dealt.unionByName(placed.select(*dealt.columns))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid", ignore_index=True)
        held = {"cids": [pdf["cid"].tolist()], "sizes": [pdf["size"].tolist()], "fresh": [pdf["fresh"].tolist()]}
        held["numbers"] = [_matrix(pdf["mean"]).tobytes()]
        return pd.DataFrame({"brand": pdf["brand"].iloc[:1], "_block": pdf["_block"].iloc[:1]} | held)

    schema = "brand string, _block int, cids array<string>, sizes array<long>, fresh array<boolean>, numbers binary"
    return places.join(dealt.groupBy("brand", "_block").applyInPandas(pack, schema), ["brand", "_block"])


def _dealt(tasks: DataFrame):
    """``block_tasks`` by task, over a fixed number of partitions, as few rows stand for much work."""
    return tasks.repartition(4 * tasks.sparkSession.sparkContext.defaultParallelism, *_TASK).groupBy(*_TASK)


class _Side:
    """The blocks of one side of a task as one table in the order of names."""

    def __init__(self, pdf: pd.DataFrame):
        names = np.concatenate([np.array(list(c), dtype=object) for c in pdf["cids"]])
        order = np.argsort(names, kind="stable")
        self.names = names[order]
        self.sizes = np.concatenate([np.asarray(s, dtype=np.int64) for s in pdf["sizes"]])[order]
        self.fresh = np.concatenate([np.asarray(f, dtype=bool) for f in pdf["fresh"]])[order]
        self.block = np.repeat(pdf["_block"].to_numpy(), [len(c) for c in pdf["cids"]])[order]
        self.mean = np.concatenate([np.frombuffer(x).reshape(len(c), -1) for c, x in zip(pdf["cids"], pdf["numbers"])])[order]


def _meetings(pdf: pd.DataFrame) -> tuple[_Side, _Side, Iterator]:
    """The two sides of a task, and for each slice of a block of the first: its rows, those it meets, and their distances."""
    left = _Side(pdf[pdf["_side"] == 0])
    right = _Side(pdf[pdf["_side"] == 1]) if (pdf["_side"] == 1).any() else left

    def slices():
        for block, meets in zip(pdf["_block"], pdf["meets"]):
            if len(meets):
                mine, theirs = left.block == block, np.isin(right.block, meets)
                # Fresh rows look for all, the others are only found by fresh ones.
                for one, two in ((mine & left.fresh, theirs), (mine & ~left.fresh, theirs & right.fresh)):
                    one, two = np.flatnonzero(one), np.flatnonzero(two)
                    others = right.mean if len(two) == len(right.mean) else right.mean[two]
                    for part in _slices(len(one) if len(two) else 0, len(two)):
                        yield one[part], two, _distances(left.mean[one[part]], others)

    return left, right, slices()


def close_pairs(unit: DataFrame, cut: float = config.TOPIC_CUT, block: int = BLOCK) -> DataFrame:
    """V01. Pairs of distinct vectors of one brand within ``cut``, with both copy counts.

    Pairs leave a task slice by slice.
    """
    schema = "brand string, a string, b string, distance double, copies_a long, copies_b long"

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True)
        left, right, slices = _meetings(pdf)
        for mine, theirs, d in slices:
            i, j = np.nonzero(d <= cut)
            distance, i, j = d[i, j], mine[i], theirs[j]
            if left is right:
                # A block by itself meets both ways.
                once = (left.block[i] != left.block[j]) | (i < j)
                distance, i, j = distance[once], i[once], j[once]
            one, two, n_one, n_two = left.names[i], right.names[j], left.sizes[i], right.sizes[j]
            swap = (one > two).astype(bool)
            yield _rows(
                pdf["brand"].iloc[0],
                a=np.where(swap, two, one),
                b=np.where(swap, one, two),
                distance=distance,
                copies_a=np.where(swap, n_two, n_one),
                copies_b=np.where(swap, n_one, n_two),
            )

    rows = keep(distinct_vectors(unit).drop("vkey"))
    return _dealt(block_tasks(rows, cut, block)).applyInPandas(pairs, schema)


class _Near:
    """The nearest other so far of each row of a side, ties by the lower name."""

    def __init__(self, n: int):
        self.d = np.full(n, np.inf)
        self.name = np.full(n, None, dtype=object)

    def add(self, rows: np.ndarray, d: np.ndarray, names: np.ndarray) -> None:
        tied = np.flatnonzero((d == self.d[rows]) & np.isfinite(d))
        lower = [k for k in tied if names[k] < self.name[rows[k]]]
        take = d < self.d[rows]
        take[lower] = True
        self.d[rows[take]], self.name[rows[take]] = d[take], names[take]


def _nearest(rows: DataFrame, cut: float, block: int) -> DataFrame:
    """Each cluster's nearest neighbour within ``cut``; ties by the lowest pair of names.

    A task gives one row for each of its vectors at most. Rows that aren't ``fresh`` have theirs in ``a`` and ``b``.
    """

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, slices = _meetings(pdf)
        of_left = _Near(len(left.names))
        of_right = of_left if left is right else _Near(len(right.names))
        for mine, theirs, d in slices:
            if left is right:
                own = np.searchsorted(theirs, mine)
                here = own < len(theirs)
                here[here] = theirs[own[here]] == mine[here]
                d[np.flatnonzero(here), own[here]] = np.inf
            at = d.argmin(axis=1)
            of_left.add(mine, d[np.arange(len(mine)), at], right.names[theirs[at]])
            # The others' nearest are looked for where they can be nearer than before.
            least = d.min(axis=0)
            nearer = np.flatnonzero((least <= of_right.d[theirs]) & (least <= cut))
            at = d[:, nearer].argmin(axis=0)
            of_right.add(theirs[nearer], least[nearer], left.names[mine[at]])
        sides = [(left, of_left)] if left is right else [(left, of_left), (right, of_right)]
        within = [(side, near, side.fresh & (near.d <= cut)) for side, near in sides]
        cid, d, other = (np.concatenate(x) for x in zip(*((side.names[at], near.d[at], near.name[at]) for side, near, at in within)))
        return _rows(pdf["brand"].iloc[0], cid=cid, d=d, other=other)

    found = _dealt(block_tasks(rows, cut, block)).applyInPandas(best, _NEAREST)
    # Of pairs with one name in common, the lowest has the lowest other name.
    nearest = found.groupBy("brand", "cid").agg(F.min(F.struct("d", "other")).alias("near"))
    nearest = nearest.select("brand", "cid", F.least("cid", "near.other").alias("a"), F.greatest("cid", "near.other").alias("b"))
    return nearest.unionByName(rows.filter("not fresh").select("brand", "cid", "a", "b")) if "fresh" in rows.columns else nearest


def _merge_in_task(cut: float):
    """All rounds for one small brand; yields (child, final parent) pairs of names."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid", ignore_index=True)
        names, size = pdf["cid"].to_numpy(dtype=object), pdf["size"].to_numpy(dtype=np.float64)
        mean = _matrix(pdf["mean"])
        active = root = np.arange(len(names))
        while len(active) > 1:
            d = _distances(mean[active], mean[active])
            np.fill_diagonal(d, np.inf)
            near, dist = d.argmin(axis=1), d.min(axis=1)
            inside = dist <= cut
            mine = np.arange(len(active))
            mutual = inside & (near[near] == mine) & (mine < near)
            if not mutual.any():
                break
            a, b = active[mine[mutual]], active[near[mutual]]
            total = size[a] + size[b]
            mean[a] = (mean[a] * size[a, None] + mean[b] * size[b, None]) / total[:, None]
            size[a] = total
            into = np.arange(len(names))
            into[b] = a
            root = into[root]
            active = np.setdiff1d(active[inside], b)
        moved = root != np.arange(len(names))
        return _rows(pdf["brand"].iloc[0], child=names[moved], parent=names[root[moved]])

    return run


def _in_tasks(rows: DataFrame, cut: float, small: int, *more: str) -> tuple[DataFrame, DataFrame]:
    """(merges of the brands with at most ``small`` clusters, the clusters of the others)."""
    sizes = rows.groupBy("brand").agg(F.count(F.lit(1)).alias("_n"))
    sized = rows.select("brand", "cid", "size", "mean", *more).join(sizes, "brand")
    done = sized.filter(F.col("_n") <= small).drop("_n", *more).groupBy("brand").applyInPandas(_merge_in_task(cut), _MERGED)
    return done, sized.filter(F.col("_n") > small).drop("_n")


def _merge_rounds(rows: DataFrame, cut: float, block: int, small: int) -> DataFrame:
    """The rounds as Spark jobs; each round's clusters are stored, which cuts the plan."""
    spark = rows.sparkSession
    merged = spark.createDataFrame([], _MERGED)
    active = store(rows)
    while True:
        near = store(_nearest(active, cut, block))
        pairs = near.groupBy("brand", "a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n = 2")
        step = store(pairs.select("brand", F.col("b").alias("child"), F.col("a").alias("parent")))
        if step.isEmpty():
            return merged
        merged = merged.unionByName(step)
        # Clusters without a neighbour are final. Merged pairs become one row: two at most meet.
        alive = active.select("brand", "cid", "size", "mean").join(near, ["brand", "cid"])
        gone = step.select("brand", F.explode(F.array("child", "parent")).alias("_other"), F.lit(True).alias("_gone"))
        joined = alive.join(step.withColumnRenamed("child", "cid"), ["brand", "cid"], "left").withColumn(
            "_other", F.when(F.col("cid") == F.col("a"), F.col("b")).otherwise(F.col("a"))
        ).join(gone, ["brand", "_other"], "left").select(
            "brand", F.coalesce("parent", "cid").alias("cid"), "size", F.coalesce("_gone", F.lit(False)).alias("_gone"), "a", "b",
            F.transform("mean", lambda x: x * F.col("size")).alias("total"),
        )
        both = joined.groupBy("brand", "cid").agg(
            F.sum("size").alias("size"), F.collect_list("total").alias("totals"), F.bool_or("_gone").alias("fresh"),
            F.min("a").alias("a"), F.min("b").alias("b"),
        )
        added = F.when(F.size("totals") == 1, F.col("totals")[0]).otherwise(
            F.zip_with(F.col("totals")[0], F.col("totals")[1], lambda x, y: x + y)
        )
        rest = store(both.select(
            "brand", "cid", "size", F.transform(added, lambda x: x / F.col("size")).alias("mean"), "fresh", "a", "b"
        ))
        active = rest
        if small > 0:
            # A brand that now fits a block is finished in one task.
            done, large = _in_tasks(rest, cut, small, "fresh", "a", "b")
            merged = merged.unionByName(store(done))
            active = store(large)


def _roots(merged: DataFrame) -> DataFrame:
    """child -> final parent, by doubling the steps until nothing moves."""
    links = store(merged)
    while True:
        up = links.select("brand", F.col("child").alias("parent"), F.col("parent").alias("_up"))
        stepped = store(links.join(up, ["brand", "parent"], "left").select(
            "brand", "child", F.coalesce("_up", "parent").alias("parent"),
            F.col("_up").isNotNull().alias("_moved"),
        ))
        links = stepped.drop("_moved")
        if stepped.filter("_moved").isEmpty():
            return links


def average_linkage(
    unit: DataFrame, cut: float = config.TOPIC_CUT, block: int = BLOCK, small: int = BLOCK
) -> DataFrame:
    """V02. (brand, mention_id, cid): the cluster of every mention, named by its lowest id.

    Brands with at most ``small`` distinct vectors are clustered in one task each, others in
    rounds over blocks of ``block``; both give the same clusters.
    """
    rows = keep(distinct_vectors(unit))
    # What one task merges has its final names at once.
    roots, large = _in_tasks(rows, cut, small)
    large = keep(large)
    if not large.isEmpty():
        roots = _roots(roots.unionByName(_merge_rounds(large, cut, block, small)))
    roots = roots.withColumnRenamed("child", "cid")
    named = rows.select("brand", "vkey", "cid").join(roots, ["brand", "cid"], "left").select(
        "brand", "vkey", F.coalesce("parent", "cid").alias("cid")
    )
    return unit.join(named, ["brand", "vkey"]).select("brand", "mention_id", "cid")


def centroids(members: DataFrame) -> DataFrame:
    """Mean of the members' unit vectors per (brand, cid), scaled to length one.

    Vectors are summed per Arrow batch before the exchange, one row per cluster and batch.
    """
    fields = "brand string, cid string, total array<double>"

    def sums(frames):
        for pdf in frames:
            if not pdf.empty:
                group, keys = pd.factorize(pd.MultiIndex.from_frame(pdf[["brand", "cid"]]))
                rows = _matrix(pdf["unit"])
                total = np.zeros((len(keys), rows.shape[1]))
                np.add.at(total, group, rows)
                yield pd.DataFrame({"brand": [k[0] for k in keys], "cid": [k[1] for k in keys], "total": list(total)})

    # The mean's direction is that of the sum.
    each = members.select("brand", "cid", "unit").mapInPandas(sums, fields)
    summed = each.groupBy("brand", "cid").applyInPandas(
        lambda pdf: pd.DataFrame({"brand": pdf["brand"][:1], "cid": pdf["cid"][:1], "total": [_matrix(pdf["total"]).sum(axis=0)]}), fields
    )
    return summed.select("brand", "cid", S.unit_vector("total").alias("centroid"))


def medoids(members: DataFrame, k: int = config.TOPIC_EXEMPLARS) -> DataFrame:
    """W11. The ``k`` members nearest the centroid, nearest first, ties by id."""
    near = members.join(centroids(members), ["brand", "cid"]).withColumn(
        "distance", 1.0 - S.dot("unit", "centroid")
    )
    return top_per_group(near, ["brand", "cid"], [F.asc("distance"), F.asc("mention_id")], k).select(
        "brand", "cid", "mention_id", "distance", "rank"
    )


def cosine_top_k(vectors: DataFrame, question, k: int = config.TOP_K) -> DataFrame:
    """V04. The ``k`` unit vectors nearest one question vector, ties by id."""
    asked = F.array(*[F.lit(float(x)) for x in question])
    score = S.dot("unit", S.unit_vector(asked))
    return vectors.withColumn("score", score).orderBy(F.desc("score"), F.asc("mention_id")).limit(k)


#: Questions of a block, and questions that one pass over the vectors answers.
QUESTION_BLOCK = 1024
MAX_QUESTIONS = 32_768


def _packed(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """One row per batch of vectors: their names in order, and all numbers as one binary."""

    def pack(frames):
        for pdf in frames:
            for at in range(0, len(pdf), rows):
                part = pdf.iloc[at : at + rows].sort_values(id_col)
                yield pd.DataFrame({"ids": [part[id_col].tolist()], "numbers": [_matrix(part["unit"]).tobytes()]})

    return df.select(id_col, "unit").mapInPandas(pack, "ids array<string>, numbers binary")


class _Best:
    """The best ``k`` vectors so far for each question of a block, ties by name."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.least = np.full(n, -np.inf)
        self.question = np.empty(0, dtype=np.int64)
        self.score = np.empty(0)
        self.exact = np.empty(0)
        self.name = np.empty(0, dtype=str)

    def add(self, exact: np.ndarray, names: np.ndarray) -> None:
        """Scores (question, vector) of one batch."""
        scores = np.round(exact, 12)
        rows = scores.shape[1]
        floor = self.least
        if rows > self.k:
            floor = np.maximum(floor, np.partition(scores, rows - self.k, axis=1)[:, rows - self.k])
        q, v = np.nonzero(scores >= floor[:, None])
        question = np.concatenate([self.question, q])
        score = np.concatenate([self.score, scores[q, v]])
        exact = np.concatenate([self.exact, exact[q, v]])
        name = np.concatenate([self.name, names[v]])
        order = np.lexsort((name, -score, question))
        question = question[order]
        start = np.searchsorted(question, np.arange(len(self.least)))
        keep_ = np.arange(len(question)) - start[question] < self.k
        self.question, self.score, self.name = question[keep_], score[order][keep_], name[order][keep_]
        self.exact = exact[order][keep_]
        last = np.searchsorted(self.question, np.arange(len(self.least)), side="right") - 1
        full = np.bincount(self.question, minlength=len(self.least)) >= self.k
        self.least = np.where(full, self.score[np.maximum(last, 0)], -np.inf)


def cosine_top_k_many(vectors: DataFrame, questions: DataFrame, k: int = config.TOP_K) -> DataFrame:
    """V04 for a table of questions (question_id, unit): (question_id, mention_id, score, rank).

    Questions stay a table: packed into blocks, they are sent to the tasks that scan the vectors, up to
    ``MAX_QUESTIONS`` a pass. Each task keeps the best ``k`` of each question while it reads, so what is
    exchanged is at most questions x k x tasks rows, whatever the number of vectors. Scores that agree to
    12 places are ties, which go to the lower id.
    """
    from pyspark.sql import Window

    passes = max(1, -(-questions.count() // MAX_QUESTIONS))
    schema = "question_id string, mention_id string, score double"
    scanned = _packed(vectors, "mention_id", 4096).select(F.col("ids").alias("names"), F.col("numbers").alias("rows"))
    scanned = keep(scanned) if passes > 1 else scanned

    def best(frames):
        held: dict[str, tuple] = {}
        for pdf in frames:
            for ids, numbers, names, rows in zip(pdf["ids"], pdf["numbers"], pdf["names"], pdf["rows"]):
                key = ids[0]
                if key not in held:
                    held[key] = (list(ids), np.frombuffer(numbers).reshape(len(ids), -1), _Best(len(ids), k))
                _, asked, found = held[key]
                found.add(asked @ np.frombuffer(rows).reshape(len(names), -1).T, np.array(list(names), dtype=str))
        for ids, _, found in held.values():
            yield pd.DataFrame({"question_id": np.array(ids, dtype=object)[found.question], "mention_id": found.name.astype(object), "score": found.exact})

    place = F.pmod(F.xxhash64("question_id"), F.lit(passes))
    local = None
    for at in range(passes):
        asked = questions.select("question_id", "unit").filter(place == at).repartitionByRange("question_id")
        blocks = keep(_packed(asked, "question_id", QUESTION_BLOCK))
        # MAX_QUESTIONS vectors at most, a row for each block: the query set against all rows, in blocks.
        found = scanned.crossJoin(F.broadcast(blocks)).mapInPandas(best, schema)
        local = found if local is None else local.unionByName(found)
    ranked = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 12)), F.asc("mention_id"))
    return local.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def embedding_misses(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """J04. Texts to embed: one row per key, without those the cache holds."""
    keyed = texts.select(S.embedding_key(model, "text").alias("key"), "text")
    first = keyed.groupBy("key").agg(F.first("text").alias("text"))
    return first.join(cache.select("key"), "key", "left_anti")


def embed_misses(misses: DataFrame, embed) -> DataFrame:
    """X02. Run a user-supplied ``embed(list of texts) -> list of vectors`` on the cache misses, batch by batch."""

    def run(batches):
        for pdf in batches:
            yield pdf[["key"]].assign(vector=[[float(x) for x in v] for v in embed(list(pdf["text"]))])

    return misses.select("key", "text").mapInPandas(run, "key string, vector array<double>")
