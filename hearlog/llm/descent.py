"""Near-duplicate vectors by NN-descent (operator 13)."""

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearlog.llm.blocks import mix
from hearlog.llm.components import components
from hearlog.llm.vectors import finite
from hearlog.session import durable

#: Nodes whose neighbour lists one group of a join holds at a time.
OWNERS = 2000

#: Cosines that a task computes at a time.
COSINES = 1 << 22

#: Spaces (labels) up to which their sizes are sent to every executor.
BROADCAST_SPACES = 1_000_000

#: Vectors whose links are counted against all others to estimate recall.
AUDITED = 512

#: Slack of bounds on angles; pairs within it are compared exactly.
SLACK = 1e-6

_LISTS = "node long, space long, vec binary, room int, worst double, others array<long>, cosines array<double>, fresh array<boolean>, moved int"
_UPDATES = "node long, other long, cosine double"


def units(vecs: list[bytes]) -> np.ndarray:
    """Unit vectors, in double precision, of vectors of one length as bytes of doubles."""
    rows = np.frombuffer(b"".join(vecs), np.float64).reshape(len(vecs), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _by_length(column: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) of the vectors of each length."""
    vecs = column.to_pylist()
    lengths = np.array([len(vec) for vec in vecs])
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        yield at, units([vecs[i] for i in at])


def _updates(node: np.ndarray, other: np.ndarray, cosine: np.ndarray) -> pa.Table:
    return pa.table({"node": pa.array(node, pa.int64()), "other": pa.array(other, pa.int64()), "cosine": pa.array(cosine, pa.float64())})


def _distinct(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    node, other, cosine = (np.concatenate([part[i] for part in found]) for i in range(3))
    order = np.lexsort((other, node))
    node, other, cosine = node[order], other[order], cosine[order]
    first = np.concatenate(([True], (node[1:] != node[:-1]) | (other[1:] != other[:-1])))[:len(node)]
    return [(node[first], other[first], cosine[first])]


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, arrays of numbers, as bytes of doubles."""
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        values, offsets = column.values.cast(pa.float64()).to_numpy(), column.offsets.to_numpy()
        vecs = [values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.record_batch([*batch.columns[:-1], pa.array(vecs, pa.binary())], names=batch.schema.names)


def _placed(trees: range, leaf: int):
    """Each point once per tree, with the signs of its projections and one more projection.

    And once at a drawn place: lists that trees alone fill may be closed among themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            members = np.array(table.column("members"), np.float64)
            bits = np.ceil(np.log2(np.maximum(1, 2 * members / leaf))).astype(np.int64).clip(0, 60)
            for at, rows in _by_length(table.column("vec")):
                part = batch.take(pa.array(at))
                drawn = mix(part["node"].to_numpy().view(np.uint64) ^ np.uint64(trees.start + 1)).astype(np.float64)
                orders = [(-1 - trees.start, np.zeros(len(at), np.int64), drawn)]
                for tree in trees:
                    planes = np.random.default_rng((rows.shape[1], tree)).standard_normal((rows.shape[1], 61))
                    sides = rows @ planes
                    signs = np.zeros(len(at), np.int64)
                    for bit in range(bits[at].max()):
                        signs = np.where(bit < bits[at], signs * 2 + (sides[:, bit] > 0), signs)
                    orders.append((tree, signs, sides[:, 60]))
                for tree, signs, side in orders:
                    yield pa.record_batch(
                        [part["space"], pa.array(np.full(len(at), tree), pa.int32()), pa.array(signs), pa.array(side),
                         part["node"], part["vec"]],
                        names=["space", "tree", "signs", "side", "node", "vec"],
                    )

    return run


def _runs(leaf: int, most: int):
    """Of neighbours in a tree's order, up to ``leaf`` at a time, the ``most`` nearest to each."""

    def near(table: pa.Table) -> pa.RecordBatch:
        nodes = table.column("node").to_numpy()
        rows = units(table.column("vec").to_pylist())
        cosine = rows @ rows.T
        np.fill_diagonal(cosine, -np.inf)
        count = min(most, len(nodes) - 1)
        best = np.argpartition(-cosine, count - 1, axis=1)[:, :count] if count else np.empty((len(nodes), 0), np.int64)
        return _updates(np.repeat(nodes, count), nodes[best].ravel(), np.take_along_axis(cosine, best, axis=1).ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, table]) if rest is not None and rest.num_rows else table
            space, tree = rest.column("space").to_numpy(), rest.column("tree").to_numpy()
            cuts = np.flatnonzero((space[1:] != space[:-1]) | (tree[1:] != tree[:-1])) + 1
            edges = [0, *cuts.tolist(), rest.num_rows]
            for number, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                last = number == len(edges) - 2
                while b - a >= 2 * leaf or not last and b > a:
                    cut = min(b, a + leaf) if b - a >= 2 * leaf else b
                    yield from near(rest.slice(a, cut - a)).to_batches()
                    a = cut
            rest = rest.slice(a)
        if rest is not None and rest.num_rows:
            yield from near(rest).to_batches()

    return run


def _merged(threshold: float, longest: int):
    """Neighbour lists with the updates of their nodes, the nearest first.

    A list holds up to ``room`` neighbours. One filled by links alone is doubled, up to
    ``longest``.
    """

    def run(lists: pa.Table, updates: pa.Table) -> pa.Table:
        if not lists.num_rows:
            return lists
        nodes = lists.column("node").to_numpy()
        lists = lists.take(pa.array(np.argsort(nodes, kind="stable"))).combine_chunks()
        nodes = lists.column("node").to_numpy()
        held = lists.column("others").combine_chunks()
        lengths = np.diff(held.offsets.to_numpy())
        row = np.concatenate((np.repeat(np.arange(len(nodes)), lengths), np.searchsorted(nodes, updates.column("node").to_numpy())))
        other = np.concatenate((held.flatten().to_numpy(), updates.column("other").to_numpy()))
        cosine = np.concatenate((lists.column("cosines").combine_chunks().flatten().to_numpy(), updates.column("cosine").to_numpy()))
        new = np.arange(len(row)) >= lengths.sum()
        order = np.lexsort((new, other, row))
        order = order[np.concatenate(([True], (row[order][1:] != row[order][:-1]) | (other[order][1:] != other[order][:-1])))[:len(order)]]
        row, other, cosine, new = row[order], other[order], cosine[order], new[order]
        order = np.lexsort((other, -cosine, row))
        row, other, cosine, new = row[order], other[order], cosine[order], new[order]
        count = np.bincount(row, minlength=len(nodes))
        linked = np.bincount(row[cosine >= threshold], minlength=len(nodes))
        room = lists.column("room").to_numpy().astype(np.int64)
        while (full := (linked >= room) & (room < longest)).any():
            room[full] = np.minimum(room[full] * 2, longest)
        start = np.concatenate(([0], np.cumsum(count)[:-1]))
        kept = np.arange(len(row)) - start[row] < room[row]
        row, other, cosine, new = row[kept], other[kept], cosine[kept], new[kept]
        count = np.bincount(row, minlength=len(nodes))
        offsets = np.concatenate(([0], np.cumsum(count)))
        worst = np.full(len(nodes), -np.inf)
        full = count == room
        worst[full] = cosine[offsets[1:][full] - 1]

        def listed(values: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))

        return pa.table({
            "node": nodes, "space": lists.column("space"), "vec": lists.column("vec"), "room": pa.array(room, pa.int32()),
            "worst": worst, "others": listed(other), "cosines": listed(cosine), "fresh": listed(new),
            "moved": pa.array(np.bincount(row[new], minlength=len(nodes)), pa.int32()),
        })

    return run


def _joined(table: pa.Table) -> pa.Table:
    """Pairs of neighbours of one node, one of them fresh, that improve the list of either."""
    table = table.take(pa.array(np.lexsort((
        ~table.column("fresh").to_numpy(), table.column("member").to_numpy(), table.column("owner").to_numpy()
    )))).combine_chunks()
    owner, member = table.column("owner").to_numpy(), table.column("member").to_numpy()
    first = np.concatenate(([True], (owner[1:] != owner[:-1]) | (member[1:] != member[:-1])))
    table = table.filter(pa.array(first))
    owners, members = table.column("owner").to_numpy(), table.column("member").to_numpy()
    news, worsts = table.column("fresh").to_numpy(), table.column("worst").to_numpy()
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for at, rows in _by_length(table.column("vec")):
        rows = np.concatenate((rows, np.zeros((1, rows.shape[1]))))
        _, starts, counts = np.unique(owners[at], return_index=True, return_counts=True)
        padded = -(-counts // 8) * 8
        for size in np.unique(padded):
            chosen = np.flatnonzero(padded == size)
            step = max(1, COSINES // int(size * size))
            for begin in range(0, len(chosen), step):
                some = chosen[begin:begin + step]
                local = starts[some][:, None] + np.arange(size)
                blank = np.arange(size) >= counts[some][:, None]
                local = np.where(blank, len(at), local)
                place = np.append(at, 0)[local]
                unit = rows[local]
                cosine = unit @ unit.transpose(0, 2, 1)
                fresh = news[place] & ~blank
                better = cosine > np.where(blank, np.inf, worsts[place])[:, None, :]
                better &= (fresh[:, :, None] | fresh[:, None, :]) & ~blank[:, :, None]
                better[:, np.arange(size), np.arange(size)] = False
                g, i, j = np.nonzero(better)
                found.append((members[place[g, j]], members[place[g, i]], cosine[g, i, j]))
                if sum(len(part[0]) for part in found[1:]) > COSINES:
                    found = _distinct(found)
    return _updates(*_distinct(found)[0])


def _round(lists: DataFrame, neighbours: int, shards: int, number: int) -> DataFrame:
    """Updates from one join of neighbours of neighbours.

    A node's neighbours are those of its list, as many of those that list it, and itself.
    Which ones list it is drawn by hash, task by task before the shuffle, so a node that
    a third of all others list costs no more than any other.
    """
    entries = lists.select("node", F.explode(F.arrays_zip("others", "fresh")).alias("e")).select(
        "node", F.col("e.others").alias("other"), F.col("e.fresh").alias("fresh")
    )
    forward = entries.select(F.col("node").alias("owner"), F.col("other").alias("member"), "fresh")
    drawn = Window.partitionBy("owner").orderBy(~F.col("fresh"), F.xxhash64(F.lit(number), "owner", "member"), "member")
    reverse = (
        entries.select(F.col("other").alias("owner"), F.col("node").alias("member"), "fresh")
        .withColumn("turn", F.row_number().over(drawn)).where(F.col("turn") <= neighbours).drop("turn")
    )
    members = durable(forward.union(reverse))
    active = members.where("fresh").select("owner").distinct()
    members = members.union(active.select("owner", F.col("owner").alias("member"), F.lit(False).alias("fresh"))).join(active, "owner", "left_semi")
    vecs = lists.select(F.col("node").alias("member"), "vec", "worst")
    return (
        members.join(vecs, "member").withColumn("shard", F.pmod(F.xxhash64("owner"), F.lit(shards)))
        .groupBy("shard").applyInArrow(_joined, _UPDATES)
    )


def _merge(lists: DataFrame, updates: DataFrame, threshold: float, longest: int, shards: int) -> DataFrame:
    shard = F.pmod(F.xxhash64("node"), F.lit(shards))
    run = _merged(threshold, longest)
    return durable(
        lists.withColumn("shard", shard).groupBy("shard").cogroup(updates.withColumn("shard", shard).groupBy("shard"))
        .applyInArrow(lambda one, two: run(one.drop_columns(["shard"]), two), _LISTS)
    )


def _chunked(size: int):
    """Runs of up to ``size`` points of one component: its points, and the cone around them."""
    schema = pa.schema([
        ("root", pa.int64()), ("chunk", pa.int64()), ("nodes", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64())),
        ("vecs", pa.list_(pa.binary())), ("centre", pa.binary()), ("radius", pa.float64()),
    ])

    def chunk(table: pa.Table) -> pa.RecordBatch:
        nodes, vecs = table.column("node").to_pylist(), table.column("vec").to_pylist()
        rows = units(vecs)
        centre = rows.mean(axis=0)
        centre = centre / max(np.linalg.norm(centre), 1e-300)
        radius = float(np.arccos(np.clip(rows @ centre, -1, 1)).max())
        row = [table.column("root")[0].as_py(), nodes[0], nodes, table.column("n").to_pylist(), vecs, centre.tobytes(), radius]
        return pa.record_batch([pa.array([value], field.type) for value, field in zip(row, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, table]) if rest is not None and rest.num_rows else table
            roots = rest.column("root").to_numpy()
            edges = [0, *(np.flatnonzero(roots[1:] != roots[:-1]) + 1).tolist(), rest.num_rows]
            for number, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                while b - a >= size or number < len(edges) - 2 and b > a:
                    yield chunk(rest.slice(a, min(size, b - a)))
                    a += min(size, b - a)
            rest = rest.slice(a)
        if rest is not None and rest.num_rows:
            yield chunk(rest)

    return run


def _near_chunks(threshold: float):
    """Of pairs of chunks those that may hold links, and whether all their points are linked."""
    wide = math.acos(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = np.array([np.frombuffer(c, np.float64) for c in batch["centre_a"].to_pylist()])
            two = np.array([np.frombuffer(c, np.float64) for c in batch["centre_b"].to_pylist()])
            if not len(one):
                continue
            apart = np.arccos(np.clip((one * two).sum(axis=1), -1, 1))
            spread = batch["radius_a"].to_numpy() + batch["radius_b"].to_numpy()
            at = np.flatnonzero(apart - spread <= wide + SLACK)
            whole = (apart + spread <= wide - SLACK)[at]
            yield pa.record_batch([batch["a"].take(pa.array(at)), batch["b"].take(pa.array(at)), pa.array(whole)], names=["a", "b", "whole"])

    return run


def _counted(threshold: float):
    """Links per point, weighted by copies, from pairs of chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, whole, nodes_a, copies_a, vecs_a, nodes_b, copies_b, vecs_b in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                linked = np.ones((len(nodes_a), len(nodes_b)), bool) if whole else units(vecs_a) @ units(vecs_b).T >= threshold
                if a == b:
                    np.fill_diagonal(linked, False)
                sides = [(nodes_a, linked @ np.array(copies_b))] + ([] if a == b else [(nodes_b, linked.T @ np.array(copies_a))])
                for nodes, n in sides:
                    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(n, pa.int64())], names=["node", "n"])

    return run


def _dense_counts(points: DataFrame, roots: DataFrame, saturated: DataFrame, threshold: float, chunk: int) -> DataFrame:
    """Links of every point in a component that holds a saturated one, compared chunk by chunk.

    Chunks are runs in the order of one projection. Cones around two chunks tell if no or
    all pairs are linked; only others are compared. Rows grow with points times chunks of
    one component, never with its pairs.
    """
    dense = roots.join(saturated, "node", "left_semi").select("root").distinct()
    members = roots.join(dense, "root", "left_semi").join(points.select("node", "n", "vec"), "node")

    def sided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = np.zeros(batch.num_rows)
            for at, rows in _by_length(pa.chunked_array([batch["vec"]])):
                side[at] = rows @ np.random.default_rng(rows.shape[1]).standard_normal(rows.shape[1])
            yield pa.record_batch([*batch.columns, pa.array(side)], names=[*batch.schema.names, "side"])

    sided_members = durable(members.select("root", "node", "n", "vec").mapInArrow(sided, "root long, node long, n long, vec binary, side double"))
    chunks = durable(
        sided_members.repartitionByRange("root", "side").sortWithinPartitions("root", "side", "node").drop("side")
        .select("root", "node", "n", "vec")
        .mapInArrow(_chunked(chunk), "root long, chunk long, nodes array<long>, copies array<long>, vecs array<binary>, centre binary, radius double")
    )
    heads = chunks.select("root", "chunk", "centre", "radius")
    one = heads.withColumnsRenamed({"chunk": "a", "centre": "centre_a", "radius": "radius_a"})
    two = heads.withColumnsRenamed({"chunk": "b", "centre": "centre_b", "radius": "radius_b"})
    pairs = durable(
        one.join(two, "root").where("a <= b").drop("root").mapInArrow(_near_chunks(threshold), "a long, b long, whole boolean")
    )

    def bodies(side: str) -> DataFrame:
        return chunks.select(F.col("chunk").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("nodes", "copies", "vecs")])

    compared = (
        pairs.repartition(max(1, pairs.count() // 64)).join(bodies("a"), "a").join(bodies("b"), "b")
        .select("a", "b", "whole", "nodes_a", "copies_a", "vecs_a", "nodes_b", "copies_b", "vecs_b")
    )
    return compared.mapInArrow(_counted(threshold), "node long, n long").groupBy("node").agg(F.sum("n").alias("linked"))


def _audit(points: DataFrame, lists: DataFrame, threshold: float, audited: int) -> DataFrame:
    """``(node, linked)`` of a bounded sample of nodes, counted against all points."""
    sample = lists.orderBy(F.xxhash64("node"), "node").limit(audited).select("node", "space", "vec").toArrow()
    groups = []
    for space in np.unique(sample.column("space").to_numpy()):
        part = sample.filter(pa.array(sample.column("space").to_numpy() == space))
        groups.append((space, part.column("node").to_numpy(), units(part.column("vec").to_pylist())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spaces = batch["space"].to_numpy()
            for space, nodes, rows in groups:
                at = np.flatnonzero(spaces == space)
                if not len(at):
                    continue
                some = batch.take(pa.array(at))
                linked = rows @ units(some["vec"].to_pylist()).T >= threshold
                linked &= nodes[:, None] != some["node"].to_numpy()[None]
                yield pa.record_batch([pa.array(nodes), pa.array(linked @ some["n"].to_numpy())], names=["node", "n"])

    return points.select("node", "space", "n", "vec").mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("truly"))


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.93,
    neighbours: int = 12,
    longest: int = 48,
    trees: int = 12,
    leaf: int = 128,
    rounds: int = 12,
    settled: float = 0.001,
    recall: float = 0.99,
    attempts: int = 4,
    chunk: int = 1024,
) -> DataFrame:
    """One row per row: id, ``n_links``, ``component_id`` and ``kept``.

    Linked are rows of equal label whose vectors have a cosine of ``threshold`` or more, in
    double precision; equal vectors are links too. ``n_links`` counts the other rows linked
    directly, ``component_id`` is the smallest id that links reach, the row's own included;
    kept is the row of that id. Rows without label, and vectors that are null, zero or
    without finite components throughout, link with nothing, nor do vectors of different
    length. Rows of equal ids stay rows of their own, and are kept or not together. Null ids
    are never the smallest; where no linked row has an id, ``component_id`` is null and the
    rows are kept. Extra columns are not read; an empty table gives no rows.

    Equal vectors are one node. Every node starts from the nearest in runs of ``leaf`` nodes
    along ``trees`` random-projection orders and a drawn one. Rounds compare neighbours of neighbours, one
    of them new, until fewer than ``settled`` of the list entries change. Lists hold
    ``neighbours`` nodes; a list of links only is enlarged, up to ``longest``. Components of
    nodes whose lists are saturated even so are compared as a whole, chunk by chunk. Then
    the links of ``AUDITED`` nodes are counted against all; below a mean ``recall``, the
    search goes on from more trees, ``attempts`` times in all. A recall that stays below
    is a warning.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("doc"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    usable = F.col("label").isNotNull() & finite(F.col("vector")) & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    kinds = rows.withColumn("usable", usable)
    nodes = durable(
        kinds.where("usable").groupBy("label", "vector").agg(F.count("*").alias("n"), F.min("doc").alias("first"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    spaces = durable(
        nodes.groupBy("label", F.size("vector").alias("size")).agg(F.count("*").alias("members"))
        .withColumn("space", F.monotonically_increasing_id())
    )
    sizes = F.broadcast(spaces) if spaces.count() <= BROADCAST_SPACES else spaces
    points = durable(
        nodes.withColumn("size", F.size("vector")).join(sizes, ["label", "size"]).select("node", "space", "members", "n", "vector")
        .mapInArrow(_as_bytes, "node long, space long, members long, n long, vec binary")
    )
    count = points.count()
    shards = max(1, count // OWNERS)
    lists = points.select(
        "node", "space", "vec", F.lit(neighbours).alias("room"), F.lit(float("-inf")).alias("worst"),
        F.array().cast("array<long>").alias("others"), F.array().cast("array<double>").alias("cosines"),
        F.array().cast("array<boolean>").alias("fresh"), F.lit(0).alias("moved"),
    )
    planted = 0
    for attempt in range(attempts):
        grown = range(planted, planted + trees * 2 ** attempt)
        planted = grown.stop
        runs = (
            points.select("node", "space", "members", "vec")
            .mapInArrow(_placed(grown, leaf), "space long, tree int, signs long, side double, node long, vec binary")
            .repartitionByRange("space", "tree", "signs", "side").sortWithinPartitions("space", "tree", "signs", "side", "node")
            .select("space", "tree", "node", "vec")
        )
        lists = _merge(lists, runs.mapInArrow(_runs(leaf, max(1, neighbours // 2)), _UPDATES), threshold, longest, shards)
        for number in range(rounds):
            moved = lists.agg(F.sum("moved")).first()[0] or 0
            if moved <= settled * count * neighbours:
                break
            lists = _merge(lists, _round(lists, neighbours, shards, number), threshold, longest, shards)
        linked = durable(_linked(points, lists, threshold, longest, chunk))
        truth = durable(_audit(points, lists, threshold, AUDITED))
        reached = (
            truth.where("truly > 0").join(linked, "node", "left")
            .agg(F.avg(F.coalesce("linked", F.lit(0)) / F.col("truly"))).first()[0]
        )
        if reached is None or reached >= recall:
            break
    else:
        warnings.warn(f"the audit finds a recall of {reached:.3f}, below {recall}", stacklevel=2)

    groups = nodes.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = groups.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component_id"))
    results = groups.join(least, F.col("root") == F.col("r")).select(
        "label", "vector", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
    )
    found = kinds.where("usable").select("doc", "label", "vector").join(results, ["label", "vector"]).select("doc", "n_links", "component_id")
    alone = kinds.where("NOT usable").select("doc", F.lit(0).cast("long").alias("n_links"), F.col("doc").alias("component_id"))
    return found.union(alone).select(
        F.col("doc").alias(id_col), "n_links", "component_id", F.col("doc").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _linked(points: DataFrame, lists: DataFrame, threshold: float, longest: int, chunk: int) -> DataFrame:
    """``(node, root, linked)`` of the nodes that have links."""
    entries = (
        lists.select("node", F.explode(F.arrays_zip("others", "cosines")).alias("e")).where(F.col("e.cosines") >= threshold)
        .select("node", F.col("e.others").alias("other"))
    )
    links = durable(entries.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct())
    roots = durable(components(links))
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
    listed = both.join(points.select(F.col("node").alias("other"), "n"), "other").groupBy("node").agg(F.sum("n").alias("linked"))
    saturated = durable(lists.where((F.col("room") >= longest) & (F.col("worst") >= threshold)).select("node"))
    found = roots.join(listed, "node")
    if saturated.isEmpty():
        return found
    exact = _dense_counts(points, roots, saturated, threshold, chunk)
    return found.join(exact.withColumnRenamed("linked", "exactly"), "node", "left").select(
        "node", "root", F.coalesce("exactly", "linked").alias("linked")
    )
