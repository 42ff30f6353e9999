"""Clusters of alike series by bisecting k-means, joined across leaves by verified likeness.

A series is described by its daily course. Courses become unit vectors, so that Pearson correlation r is squared
distance 2 (1 - r). Nodes that are too wide are split in two by k-means, all of a level in one pass over the data, until
each holds few enough vectors for one task, which splits it further until every leaf is compact: within half the
distance at which two series count as alike, so that all members of a leaf are alike. What remains are links between
leaves. A node's ball tells which vectors can have a partner in it; those are compared, and leaves with a verified link
are joined to clusters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from tidemill.functions.joins import sized_join
from tidemill.functions.ranks import grouped_percentiles
from tidemill.llm.neighbours import _lists, _matrix, unit_rows
from tidemill.operators.readings import valid_readings
from tidemill.sources.scratch import materialise

HOURS = 24
HOUR_MS = 3_600_000
#: Vectors that one task splits on its own.
LOCAL_ROWS = 4096
#: Vectors compared with those of one node at a time.
VISITORS = 20_000
LLOYD = 2
#: Edges that are united in memory at a time, and steps after which components count as unsettled.
EDGES = 2_000_000
ROUNDS = 100
ALIKE = 0.95


def daily_courses(points: DataFrame, periods: DataFrame, least: int = 3) -> DataFrame:
    """``series_id, course``: the 24 medians of the valid readings by UTC hour of day, of series with a period of at
    most one hour and at least ``least`` valid readings in each hour.

    A series of up to a million readings is ordered by hour. Of longer ones the readings of an hour are counted by size before
    they are shuffled, and only those in the cell of the median are put in order, split further where they are many: no task
    sees such a series, or an hour of one, whole.
    """
    fit = periods.where(F.col("period").between(1, HOUR_MS)).select("series_id").distinct()
    readings = valid_readings(sized_join(points.select("series_id", "t", "v", "recv_ms"), fit, "series_id"))
    hour = F.expr(f"pmod(floor(t / {HOUR_MS}), {HOURS})").cast("int")
    values = materialise(readings.select("series_id", hour.alias("hour"), "v"), "hours")
    medians = grouped_percentiles(values, ["series_id", "hour"], {"median": 0.5}, sparse=True)
    whole = medians.groupBy("series_id").agg(
        F.min("n").alias("n"), F.array_sort(F.collect_list(F.struct("hour", "median"))).alias("course")
    )
    kept = whole.where((F.size("course") == HOURS) & (F.col("n") >= least))
    return kept.select("series_id", F.transform("course", lambda x: x["median"]).alias("course"))


class Nodes:
    """The tree of splits. A node's rows are nearer to its centre than to its sibling's."""

    def __init__(self, width: int) -> None:
        self.centre = [np.zeros(width)]
        self.child: list[tuple[int, int] | None] = [None]
        self.size, self.radius, self.group = [0], [np.inf], [-1]

    def split(self, node: int, seeds: np.ndarray) -> None:
        self.child[node] = (len(self.centre), len(self.centre) + 1)
        for seed in seeds:
            self.centre.append(seed)
            self.child.append(None)
            self.size.append(0)
            self.radius.append(np.inf)
            self.group.append(self.group[node])

    def leaves(self) -> list[int]:
        return [k for k, c in enumerate(self.child) if c is None]

    def of(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), dtype=np.int64)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if self.child[node] is None or not len(at):
                out[at] = node
                continue
            left, right = self.child[node]
            a, b = self.centre[left], self.centre[right]
            nearer = rows[at] @ (a - b) >= (a @ a - b @ b) / 2
            todo += [(left, at[nearer]), (right, at[~nearer])]
        return out

    def near(self, rows: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaves whose balls, widened by ``reach``, hold them: down the tree as far as the balls of inner nodes do."""
        found, todo = [(np.zeros(0, np.int64), 0)], [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            off = rows[at] - self.centre[node]
            at = at[(off * off).sum(axis=1) <= (self.radius[node] + reach) ** 2 + 1e-9]
            if not len(at):
                continue
            if self.child[node] is None:
                if self.size[node]:
                    found.append((at, node))
            else:
                todo += [(side, at) for side in self.child[node]]
        return np.concatenate([at for at, _ in found]), np.concatenate([np.full(len(at), node, dtype=np.int64) for at, node in found])


def _spread(nodes: Nodes, rows: DataFrame, width: int) -> dict[int, tuple[int, np.ndarray, float, np.ndarray]]:
    """Of each leaf: rows, mean, greatest distance to its centre, and the row that far away. One pass; a partition sends
    one row per leaf."""
    schema = StructType([StructField("node", LongType()), StructField("n", LongType()), StructField("total", ArrayType(DoubleType())), StructField("far2", DoubleType()), StructField("far", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(pa.chunked_array([batch.column(0)]), width)
            node = nodes.of(x)
            names, at = np.unique(node, return_inverse=True)
            centres = np.stack([nodes.centre[k] for k in names]) if len(names) else np.zeros((0, width))
            d2 = ((x - centres[at]) ** 2).sum(axis=1)
            total = np.zeros((len(names), width))
            np.add.at(total, at, x)
            order = np.lexsort((d2, at))
            last = order[np.cumsum(np.bincount(at, minlength=len(names))) - 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array(np.bincount(at, minlength=len(names))), _lists(total), pa.array(d2[last]), _lists(x[last])],
                schema.names,
            )

    sums = [F.sum(F.col("total")[j]).alias(f"s{j}") for j in range(width)]
    merged = rows.select("unit").mapInArrow(run, schema).groupBy("node").agg(
        F.sum("n").alias("n"), F.array(*sums).alias("total"), F.max("far2").alias("far2"), F.max_by("far", "far2").alias("far")
    )
    return {r["node"]: (r["n"], np.array(r["total"]) / r["n"], r["far2"] ** 0.5, np.array(r["far"])) for r in merged.collect()}


def _seeds(centre: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Two centres whose dividing plane goes through the mean, across the direction of the farthest row."""
    return np.stack([centre + (far - centre) / 2, centre - (far - centre) / 2])


def grow(rows: DataFrame, width: int, limit: float, local_rows: int) -> Nodes:
    """Splits nodes of more than ``local_rows`` vectors, the widest and all others of a level in one pass. A node that
    is compact is noted as a group: its parts need no comparison with each other."""
    nodes = Nodes(width)
    for _ in range(200):
        seen = _spread(nodes, rows, width)
        wide = []
        for node in nodes.leaves():
            n, mean, radius, far = seen.get(node, (0, nodes.centre[node], 0.0, nodes.centre[node]))
            nodes.size[node], nodes.radius[node] = n, radius
            if nodes.group[node] < 0 and radius <= limit:
                nodes.group[node] = node
            if n > local_rows and radius > 0:
                wide.append((node, mean, far))
        if not wide:
            return nodes
        for node, mean, far in wide:
            nodes.split(node, _seeds(mean, far))
        for _ in range(LLOYD - 1):
            seen = _spread(nodes, rows, width)
            for node, _, _ in wide:
                for side in nodes.child[node]:
                    if side in seen:
                        nodes.centre[side] = seen[side][1]
    raise RuntimeError("the vectors could not be split")


def bisect(x: np.ndarray, limit: float) -> np.ndarray:
    """The compact leaf of each row: the widest parts are split in two until all lie within ``limit`` of their mean."""
    leaf, count, todo = np.zeros(len(x), dtype=np.int64), 0, [np.arange(len(x))]
    while todo:
        at = todo.pop()
        part = x[at]
        centre = part.mean(axis=0)
        d2 = ((part - centre) ** 2).sum(axis=1)
        if d2.max() <= limit * limit:
            leaf[at] = count
            count += 1
            continue
        seeds = _seeds(centre, part[int(d2.argmax())])
        for _ in range(LLOYD + 1):
            left = part @ (seeds[0] - seeds[1]) >= (seeds[0] @ seeds[0] - seeds[1] @ seeds[1]) / 2
            if left.all() or not left.any():
                break
            seeds = np.stack([part[left].mean(axis=0), part[~left].mean(axis=0)])
        if left.all() or not left.any():
            left = np.arange(len(at)) == int(d2.argmax())
        todo += [at[left], at[~left]]
    return leaf


def compact_leaves(rows: DataFrame, nodes: Nodes, width: int, limit: float, local_rows: int) -> DataFrame:
    """``rep, unit, node, leaf`` of rows ``rep, unit``: each node's rows split to compact leaves in one task. The parts
    of a compact node are one leaf."""
    schema = StructType([rows.schema["rep"], rows.schema["unit"], StructField("node", LongType()), StructField("leaf", LongType())])
    placed_schema = StructType([*schema.fields[:3]])
    group = np.array(nodes.group)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = nodes.of(_matrix(pa.chunked_array([batch.column(1)]), width))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node)], placed_schema.names)

    def split(table: pa.Table) -> pa.Table:
        node = table.column("node")[0].as_py()
        if group[node] >= 0:
            leaf = np.full(table.num_rows, group[node] << 24)
        else:
            leaf = (node << 24) + bisect(_matrix(table.column("unit"), width), limit)
        return table.append_column("leaf", pa.array(leaf))

    placed = rows.select("rep", "unit").mapInArrow(place, placed_schema)
    return placed.groupBy("node").applyInArrow(split, schema)


def leaf_links(leaves: DataFrame, nodes: Nodes, width: int, link: float) -> DataFrame:
    """``a, b``: pairs of leaves (smaller first) that hold two vectors at most ``link`` apart.

    A vector visits the nodes whose ball it can reach, of two nodes only the later one, and none of its own group. A
    node with many visitors takes them in parts, so that no task meets more than ``VISITORS`` or so.
    """
    names = np.array([k for k in nodes.leaves() if nodes.size[k]])
    groups = np.array([nodes.group[k] for k in names])

    def visits(table: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x, home = _matrix(pa.chunked_array([table.column("unit")]), width), table.column("node").to_numpy()
        who, node = nodes.near(x, link)
        to, own = np.searchsorted(names, node), groups[np.searchsorted(names, home)][who]
        keep = (node > home[who]) & ((own < 0) | (own != groups[to]))
        return who[keep], to[keep]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, node = visits(batch)
            number = np.bincount(node, minlength=len(names))
            busy = np.flatnonzero(number)
            yield pa.RecordBatch.from_arrays([pa.array(names[busy]), pa.array(number[busy])], ["node", "n"])

    busy = leaves.mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") > VISITORS)
    parts = {r["node"]: -(-r["n"] // VISITORS) for r in busy.collect()}
    times = np.array([parts.get(int(k), 1) for k in names], dtype=np.int64)
    schema = StructType([StructField("node", LongType()), StructField("part", LongType()), StructField("home", LongType()), leaves.schema["leaf"], leaves.schema["unit"]])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, node = visits(batch)
            key = pc.cast(batch.column("h"), pa.int64()).to_numpy()
            own = np.searchsorted(names, batch.column("node").to_numpy())
            copies = times[own]
            mine = np.repeat(np.arange(len(own)), copies)
            part = np.arange(len(mine)) - np.repeat(np.cumsum(copies) - copies, copies)
            at, to = np.concatenate([mine, who]), np.concatenate([own[mine], node])
            part = np.concatenate([part, key[who] % times[node]])
            home = np.concatenate([np.ones(len(mine), np.int64), np.zeros(len(who), np.int64)])
            taken = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[to]), pa.array(part), pa.array(home), taken.column("leaf"), taken.column("unit")], schema.names
            )

    def meet(table: pa.Table) -> pa.Table:
        x, leaf = _matrix(table.column("unit"), width), table.column("leaf").to_numpy()
        home = table.column("home").to_numpy() == 1
        mine, mine_leaf = x[home], leaf[home]
        found = []
        if len(mine):
            lone = int(table.column("part")[0].as_py()) == 0
            for low in range(0, len(x), 2048):
                y, y_leaf = x[low : low + 2048], leaf[low : low + 2048]
                use = ~home[low : low + 2048] | lone  # residents meet each other in the first part only
                near = (y @ mine.T >= 1 - link * link / 2) & use[:, None] & (y_leaf[:, None] != mine_leaf[None, :])
                i, j = np.nonzero(near)
                a, b = y_leaf[i], mine_leaf[j]
                found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.Table.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    hashed = leaves.withColumn("h", F.pmod(F.xxhash64("rep"), F.lit(1 << 40)))
    return hashed.mapInArrow(send, schema).groupBy("node", "part").applyInArrow(meet, "a long, b long").distinct()


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges as stars around the smallest node of each connected part."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        x, y = parent[a], parent[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if (low == high).all():
            break
        np.minimum.at(parent, high, low)
        while (parent[parent] != parent).any():
            parent = parent[parent]
    leaf = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[parent[leaf]], nodes[leaf]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars, so many at a time that they stay small in memory."""

    def emit(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in range(2))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _stars(a, b)], ["a", "b"])

    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= EDGES:
            yield emit(held)
            held, count = [], 0
    if count:
        yield emit(held)


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of all nodes on edges ``a, b``; a component is named after its smallest node.

    Large-star and small-star steps in turn, each preceded by a union within partitions, until nothing changes; the
    edges are written to the shared folder at each turn, nothing of them comes to the driver. The edges of a hub are
    spread where its smallest neighbour is joined to them. Steps that come to no end are an error.
    """
    name = ["a", "b"]
    now = materialise(edges.select(F.least(*name).alias("a"), F.greatest(*name).alias("b")).mapInArrow(_forest, "a long, b long"), "edges")

    def state(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    before = state(now)
    for _ in range(ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = sized_join(both.where("b > a"), least, "a").select(F.col("m").alias("a"), "b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = sized_join(large, least, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e")).select("e.*")
        now = materialise(small.where("a <> b").distinct().mapInArrow(_forest, "a long, b long"), "edges")
        after = state(now)
        if after == before:
            members = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
            return members.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        before = after
    raise RuntimeError(f"the components were not settled after {ROUNDS} rounds")


def alike_clusters(courses: DataFrame, alike: float = ALIKE, width: int = HOURS, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """``series_id, cluster_id, size, leaf, unit``: clusters of series joined by likeness.

    ``courses`` has ``series_id, course`` (arrays of ``width`` values). Two series are alike if the Pearson correlation
    of their courses is at least ``alike``; a cluster is named after its smallest ``series_id``. A series alike to no
    other is a cluster of one. Courses that are NULL, constant, of another length, or hold NULL, NaN or an infinity
    take no part. Equal courses are represented by one. Of rows repeating a ``series_id`` the greatest course counts.
    An empty table gives no rows.
    """
    link = float(np.sqrt(2 * (1 - alike))) * (1 + 1e-12)
    limit = link / 2 * (1 - 1e-9)
    schema = StructType([StructField("series_id", StringType()), StructField("unit", ArrayType(DoubleType()))])

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, at = unit_rows(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), _lists(unit)], schema.names)

    once = courses.where(F.col("series_id").isNotNull()).groupBy("series_id").agg(F.max("course").alias("course"))
    units = materialise(once.mapInArrow(scale, schema), "units")
    same = units.groupBy("unit").agg(F.min("series_id").alias("rep"))
    reps = materialise(same.select("rep", "unit"), "reps")
    nodes = grow(reps, width, limit, local_rows)
    leaves = materialise(compact_leaves(reps, nodes, width, limit, local_rows), "leaves")
    joined = components(leaf_links(leaves, nodes, width, link))
    whole = leaves.join(joined, leaves["leaf"] == joined["node"], "left").select(
        leaves["unit"], "leaf", F.coalesce("component", "leaf").alias("component")
    )
    members = materialise(sized_join(units, whole, "unit"), "members")  # copies of one course are spread or the others broadcast
    named = members.groupBy("component").agg(F.min("series_id").alias("cluster_id"), F.count(F.lit(1)).alias("size"))
    return sized_join(members, named, "component").select("series_id", "cluster_id", "size", "leaf", "unit")


def typical_members(clusters: DataFrame, width: int = HOURS, k: int = 3) -> DataFrame:
    """Per cluster: ``cluster_id, size, leaves, spread, typical`` (the k members nearest to the cluster's centre, the
    nearest first, ties by id; ``spread`` is the mean squared distance to the centre). Each task keeps no more than k
    members of a cluster before they meet."""
    means = clusters.groupBy("cluster_id").agg(
        *(F.avg(F.col("unit")[j]).alias(f"m{j}") for j in range(width)), F.countDistinct("leaf").alias("leaves")
    )
    centres = materialise(means.select("cluster_id", "leaves", F.array(*(f"m{j}" for j in range(width))).alias("centre")), "centres")
    off = F.aggregate(F.zip_with("unit", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    rows = sized_join(clusters.select("cluster_id", "size", "series_id", "unit"), centres.select("cluster_id", "centre"), "cluster_id")
    rows = rows.select("cluster_id", "size", "series_id", F.round(off, 9).alias("off"))
    near = Window.partitionBy("cluster_id").orderBy("off", "series_id")
    first = rows.withColumn("place", F.row_number().over(near)).where(F.col("place") <= k)
    typical = first.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "series_id"))), lambda x: x["series_id"]).alias("typical"))
    spread = rows.groupBy("cluster_id", "size").agg(F.avg("off").alias("spread"))
    return spread.join(typical, "cluster_id").join(centres.select("cluster_id", "leaves"), "cluster_id").select("cluster_id", "size", "leaves", "spread", "typical")
