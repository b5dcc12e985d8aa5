"""Product-quantisation codes by Lloyd rounds over partition-local cover trees (operator 11)."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearlog.llm.vectors import BLOCK, blocks, digest, finite, packed, scaled, summed, unpacked, with_total
from hearlog.session import durable

#: Distinct points that a node may hold without being split further.
LEAF = 8

#: Slack of comparisons between rounded square roots; what lies within is compared exactly.
SLACK = 1e-6


@dataclass
class CoverTree:
    """Distinct points in the order of the tree; a node covers the points ``start`` to ``end``.

    Node 0 is the root and nodes lie level by level, the children of one node side by side.
    ``sums`` and ``counts`` are of all points under a node, copies counted.
    """

    points: np.ndarray
    copies: np.ndarray
    start: np.ndarray
    end: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    children: np.ndarray
    sums: np.ndarray
    counts: np.ndarray


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lengths = ends - starts
    return np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())


def cover_tree(rows: np.ndarray, leaf: int = LEAF) -> tuple[CoverTree, np.ndarray]:
    """The tree of integer ``rows``, and the place in it of each row.

    Covering radii halve from level to level. Within a node, the first point that no child
    covers yet becomes the centre of one more child, for all nodes of a level at once.
    """
    points, place, copies = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    count = len(points)
    order = np.arange(count)
    reach = float(np.sqrt(((points - points[:1]) ** 2).sum(axis=1).max(initial=0)))
    levels = [(np.array([0]), np.array([count]), np.array([0]))]
    links = []
    while True:
        start, end, centre = levels[-1]
        reach /= 2
        split = np.flatnonzero(end - start > leaf)
        first, children = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        links.append((first, children))
        if not len(split):
            break
        at = _ranges(start[split], end[split])
        owner = np.repeat(np.arange(len(split)), (end - start)[split])
        held = order[at]
        child, chosen = np.full(len(at), -1), []
        waiting, turn = np.arange(len(at)), 0
        while len(waiting):
            _, heads = np.unique(owner[waiting], return_index=True)
            lead = np.zeros(len(split), np.int64)
            lead[owner[waiting[heads]]] = held[waiting[heads]]
            apart = ((points[held[waiting]] - points[lead[owner[waiting]]]) ** 2).sum(axis=1)
            near = apart <= reach * reach
            child[waiting[near]] = turn
            chosen.append(lead)
            waiting, turn = waiting[~near], turn + 1
        keys, inverse = np.unique(owner * turn + child, return_inverse=True)
        moved = np.argsort(inverse, kind="stable")
        order[at] = held[moved]
        sizes = np.bincount(inverse)
        offset = at[np.concatenate(([0], np.cumsum(sizes)[:-1]))]
        levels.append((offset, offset + sizes, np.array(chosen)[keys % turn, keys // turn]))
        children[split] = np.bincount(keys // turn, minlength=len(split))
        first[split] = np.concatenate(([0], np.cumsum(children[split])[:-1]))
    sizes = [len(level[0]) for level in levels]
    for number, (first, children) in enumerate(links):
        first[children > 0] += sum(sizes[:number + 1])
    start, end, centre = (np.concatenate([level[i] for level in levels]) for i in range(3))
    points, copies, rank = points[order], copies[order], np.argsort(order)
    spread = np.sqrt(((points[_ranges(start, end)] - np.repeat(points[rank[centre]], end - start, axis=0)) ** 2).sum(axis=1))
    upto = np.concatenate((np.zeros((1, points.shape[1]), np.int64), np.cumsum(points * copies[:, None], axis=0)))
    many = np.concatenate(([0], np.cumsum(copies)))
    tree = CoverTree(
        points, copies, start, end, points[rank[centre]],
        np.maximum.reduceat(spread, np.concatenate(([0], np.cumsum(end - start)[:-1]))),
        np.concatenate([link[0] for link in links]), np.concatenate([link[1] for link in links]),
        upto[end] - upto[start], many[end] - many[start],
    )
    return tree, rank[place.ravel()]


def assign(tree: CoverTree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry per point of the tree, sums per entry, counts per entry); ties to the first.

    An entry whose distance to a node's centre exceeds the nearest one's by more than the
    node's diameter is nearest to none of its points. A node with one entry left goes to it
    whole, by its sums; the points of leaves with several are compared exactly with those.
    """
    codes = np.zeros(len(tree.points), np.int64)
    sums, counts = np.zeros_like(entries), np.zeros(len(entries), np.int64)
    nodes, open_ = np.array([0]), np.ones((1, len(entries)), bool)
    while len(nodes):
        apart = np.sqrt(((tree.centre[nodes][:, None, :] - entries[None]) ** 2).sum(axis=2))
        apart[~open_] = np.inf
        least = apart.min(axis=1)
        open_ = apart <= (least + 2 * tree.radius[nodes] + SLACK * (1 + least))[:, None]
        sure = open_.sum(axis=1) == 1
        done, code = nodes[sure], open_[sure].argmax(axis=1)
        codes[_ranges(tree.start[done], tree.end[done])] = np.repeat(code, (tree.end - tree.start)[done])
        np.add.at(sums, code, tree.sums[done])
        np.add.at(counts, code, tree.counts[done])
        leaf = ~sure & (tree.children[nodes] == 0)
        at = _ranges(tree.start[nodes[leaf]], tree.end[nodes[leaf]])
        among = np.repeat(open_[leaf], (tree.end - tree.start)[nodes[leaf]], axis=0)
        exact = ((tree.points[at][:, None, :] - entries[None]) ** 2).sum(axis=2)
        codes[at] = np.where(among, exact, np.iinfo(np.int64).max).argmin(axis=1)
        np.add.at(sums, codes[at], tree.points[at] * tree.copies[at][:, None])
        np.add.at(counts, codes[at], tree.copies[at])
        deeper = ~sure & ~leaf
        below = nodes[deeper]
        open_ = np.repeat(open_[deeper], tree.children[below], axis=0)
        nodes = _ranges(tree.first[below], tree.first[below] + tree.children[below])
    return codes, sums, counts


def _planted(parts: int, size: int, scale: int, block: int, leaf: int, schema: pa.Schema):
    """One row per block of vectors: the columns kept, as lists, and the trees of its parts."""
    names = schema.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, rows in blocks(batches, size, scale, block):
            arrays = {}
            for part, piece in enumerate(np.split(rows, parts, axis=1)):
                tree, place = cover_tree(piece, leaf)
                arrays[f"{part}.place"] = place.astype(np.int32)
                for name, value in vars(tree).items():
                    arrays[f"{part}.{name}"] = value
            lists = [pa.array([table.column(name).to_pylist()], schema.field(name).type) for name in names]
            yield pa.record_batch([*lists, pa.array([packed(arrays)], pa.binary())], schema=schema)

    return run


def _trees(data: bytes, parts: int) -> list[tuple[CoverTree, np.ndarray]]:
    arrays = unpacked(data)
    names = CoverTree.__dataclass_fields__
    return [(CoverTree(*[arrays[f"{p}.{name}"] for name in names]), arrays[f"{p}.place"]) for p in range(parts)]


_PARTIAL = "part int, entry int, place int, sum long, n long"


def _round(books: np.ndarray):
    """Sums and counts per codebook entry over all blocks of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for data in batch.column(0):
                for part, (tree, _) in enumerate(_trees(data.as_py(), len(books))):
                    _, more, n = assign(tree, books[part])
                    sums[part] += more
                    counts[part] += n
        part, entry, place = (axis.ravel() for axis in np.indices(books.shape))
        used = counts[part, entry] > 0
        columns = [part.astype(np.int32), entry.astype(np.int32), place.astype(np.int32), sums.ravel(), counts[part, entry]]
        yield pa.record_batch([pa.array(c[used]) for c in columns], names=["part", "entry", "place", "sum", "n"])

    return run


def _encoded(books: np.ndarray, schema: pa.Schema):
    """Rows of (columns kept, code, error) of all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                codes, errors = [], 0
                for part, (tree, place) in enumerate(_trees(batch.column(batch.num_columns - 1)[row].as_py(), len(books))):
                    code = assign(tree, books[part])[0]
                    apart = ((tree.points - books[part][code]) ** 2).sum(axis=1)
                    codes.append(code[place])
                    errors = errors + apart[place]
                hexed = [bytes(line).hex() for line in np.stack(codes, axis=1).astype(np.uint8)]
                kept = [batch.column(i)[row].values for i in range(batch.num_columns - 1)]
                yield pa.record_batch([*kept, pa.array(hexed), pa.array(errors, pa.int64())], schema=schema)

    return run


def encode(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
    block: int = BLOCK,
    leaf: int = LEAF,
) -> tuple[DataFrame, np.ndarray]:
    """(one row per kept vector: id, label, ``code``, ``error``, ``label_error``; the codebooks).

    Components become integers floor(scale * x), saturated at 2^26, and vectors are cut into
    ``parts`` equal parts. The codebook of a part position starts as that part of the
    ``entries`` vectors of smallest id and is moved ``rounds`` times to the floor of the mean
    of the parts nearest to each entry (ties to the first entry; unused entries stay).
    ``code`` has two hexadecimal digits per part, ``error`` is the squared distance to the
    coded vector, ``label_error`` its sum over equal labels.

    Dropped are null vectors and those with a null or non-finite component, without
    components, or of another length than most (of equally frequent lengths that ``parts``
    divides, the smallest). Null ids come last when codebooks start, equal ids in the order
    of their vectors; rows with equal or null ids are coded each. Null labels are one label.
    Sums stop at the largest long. Extra columns are not read; no kept vectors give no rows
    and empty codebooks.

    Each task builds cover trees over blocks of ``block`` vectors, once, and stores them.
    A round sends the codebooks to the blocks and gets sums and counts back, so its
    shuffle depends on the codebooks' size alone.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hexadecimal digits names 1 to 256 entries")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    kept = rows.where(finite(F.col("vector")) & (F.size("vector") % parts == 0))
    lengths = kept.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = lengths["size"] if lengths else parts
    starts = (
        kept.where(F.size("vector") == size).select("id", F.col("vector").cast("array<double>").alias("vector"))
        .orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    )
    start = scaled(np.array([row["vector"] for row in starts], np.float64).reshape(len(starts), size), scale)
    books = np.stack(np.split(start, parts, axis=1))

    plain = rows.select("id", "label").schema
    arrow = pa.schema([(name, pa.list_(field.type)) for name, field in zip(plain.names, _arrow(spark, plain), strict=True)])
    arrow = arrow.append(pa.field("trees", pa.binary()))
    label = plain["label"].dataType.simpleString()
    trees = durable(rows.mapInArrow(
        _planted(parts, size, scale, block, leaf, arrow), f"id array<bigint>, label array<{label}>, trees binary"
    ))
    for _ in range(rounds if len(starts) else 0):
        moved = books.copy()
        for part, entry, place, total, n in summed(trees.select("trees").mapInArrow(_round(books), _PARTIAL), ["part", "entry", "place"]):
            moved[part, entry, place] = total // n
        books = moved
    flat = pa.schema([*_arrow(spark, plain), ("code", pa.string()), ("error", pa.int64())])
    coded = durable(trees.mapInArrow(_encoded(books, flat), f"id bigint, label {label}, code string, error bigint"))
    return with_total(coded, "label", "error", "label_error").withColumnsRenamed({"id": id_col, "label": label_col}), books


def _arrow(spark, schema) -> pa.Schema:
    return spark.createDataFrame([], schema).toArrow().schema


def codes(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", **settings) -> DataFrame:
    """``encode`` with the SHA-256 of all codebooks' integers beside every code."""
    coded, books = encode(vectors, id_col=id_col, label_col=label_col, **settings)
    return coded.drop(label_col).withColumn("codebooks_sha256", F.lit(digest(books)))
