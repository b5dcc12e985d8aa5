"""Near copies: SimHash links, and beside them all pairs of similar shingle sets.

Texts whose word shingles overlap by a Jaccard similarity of t or more share a shingle among
the first (1 - t) of both, in any one order of all shingles. In an order from rare to common
ones few others meet there. What meets and is not connected yet is tested by sketches that
never rule out a similar pair, and what is left is compared exactly, the closest first.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearlog.llm.blocks import by_shard, mix, pack, unpack
from hearlog.llm.common import record_batches, trimmed
from hearlog.llm.components import components
from hearlog.llm.simhash import BITS, fingerprint_bits, near_links
from hearlog.session import durable, temporary_tables

#: Members of a group of sets that one task compares with one another.
CHUNK = 512

#: One text in so many is asked for common shingles, those that SEEN of them hold.
SAMPLED, SEEN = 20, 3

#: Common shingles that are sent to every executor (12 bytes each); the others count as
#: rarer than they, which costs more comparisons and changes no result.
MOST_COMMON = 500_000

#: Sets that share a shingle, by the sample, from which they are no longer gathered by it.
GATHERED = 1 << 20

#: Bits of a sketch at most.
SKETCH = 4096

#: Texts to compare up to which their digests are sent to every executor (64 MB at most).
BROADCAST_TEXTS = 4_000_000

#: Entries that a task packs at a time, and members that a group of tasks' rows holds.
PACKED = 1 << 20
MEMBERS = 20_000

def shingle_set(text: bytes | None, words: int = 5) -> np.ndarray:
    """Ascending distinct 64-bit codes of the shingles of a UTF-8 text.

    Words are those of ``simhash.fingerprint_bits``. Texts of fewer words have their whole
    sequence as the only shingle; texts without words have none.
    """
    parts = (text or b"").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    span = min(words, len(parts))
    count = len(parts) - span + 1
    codes = np.full(count, span, np.uint64)
    for k in range(span):
        codes = mix(codes * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + count])
    return np.unique(codes)


def _node(codes: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(codes.tobytes()))


def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def _counts(codes: np.ndarray, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """How often the sample has each code; 0 where it is not common (ascending ``common``)."""
    if not len(common):
        return np.zeros(len(codes), np.int64)
    at = np.minimum(np.searchsorted(common, codes), len(common) - 1)
    return np.where(common[at] == codes, often[at], 0)


def sketch(codes: np.ndarray) -> np.ndarray:
    """Parities of the codes that fall on each of 64 to SKETCH bits, as bytes.

    Two sketches differ in no more bits than their sets in codes.
    """
    bits = min(SKETCH, max(64, 1 << max(0, len(codes) - 1).bit_length()))
    parity = np.bincount((codes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8))


def folded(sketches: np.ndarray, size: int) -> np.ndarray:
    """Sketches (one per row) as those of ``size`` bytes."""
    while sketches.shape[1] > size:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def prefix_size(count: int, similarity: float) -> int:
    """How many codes of a set may come before the first that a similar set shares."""
    return count - math.ceil(similarity * count - 1e-9) + 1 if count else 0


def _described(words: int, similarity: float, common: np.ndarray, often: np.ndarray):
    arrow = pa.schema([
        ("doc", pa.int64()), ("text_sha256", pa.string()), ("key", pa.int64()), ("print", pa.int64()), ("node", pa.int64()),
        ("n", pa.int32()), ("sketch", pa.binary()), ("prefix", pa.binary()),
    ])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for doc, digest, key, text in zip(*batch.columns, strict=True):
                text = text.as_py()
                codes = shingle_set(text, words)
                order = np.argsort(_counts(codes, common, often), kind="stable")[:prefix_size(len(codes), similarity)]
                yield (doc.as_py(), digest.as_py(), key.as_py(), _signed(fingerprint_bits(text)), _node(codes), len(codes),
                       sketch(codes).tobytes(), codes[order].tobytes())

    return lambda batches: record_batches(rows(batches), arrow, 512)


def _codes(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                codes = shingle_set(text.as_py(), words).view(np.int64)
                yield pa.record_batch([pa.array(codes, pa.int64())], names=["code"])

    return run


def _sets(words: int):
    arrow = pa.schema([("node", pa.int64()), ("codes", pa.list_(pa.int64()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for text in batch.column(0):
                codes = shingle_set(text.as_py(), words)
                yield _node(codes), codes.view(np.int64)

    return lambda batches: record_batches(rows(batches), arrow, 128)


def _dealt(shards: int, hot: np.ndarray):
    """Prefixes cut into entries (code, node), packed for the code's shard; ``hot`` ones apart."""
    arrow = pa.schema([("shard", pa.int32()), ("codes", pa.binary()), ("nodes", pa.binary())])

    def packed(waiting: list[tuple]) -> Iterator[tuple]:
        codes = np.concatenate([codes for _, codes in waiting])
        nodes = np.repeat(np.array([node for node, _ in waiting], np.int64), [len(codes) for _, codes in waiting])
        apart = _counts(codes, hot, np.ones(len(hot), np.int64)) > 0
        if apart.any():
            yield None, pack(codes[apart]), pack(nodes[apart])
        codes, nodes = codes[~apart], nodes[~apart]
        for shard, at in by_shard(codes, (mix(codes) % np.uint64(shards)).astype(np.int64)):
            yield shard, pack(codes[at]), pack(nodes[at])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        waiting, size = [], 0
        for batch in batches:
            for node, prefix in zip(*[batch.column(i).to_pylist() for i in range(2)], strict=True):
                waiting.append((node, np.frombuffer(prefix, np.uint64)))
                size += len(prefix) // 8
                if size >= PACKED:
                    yield from packed(waiting)
                    waiting, size = [], 0
        if waiting:
            yield from packed(waiting)

    return lambda batches: record_batches(rows(batches), arrow, 64)


def _met(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    return trimmed(_meetings(table))


def _meetings(table: pa.Table) -> pa.Table:
    """``(met, node)`` of the sets that share a code; once for codes shared by the same sets."""
    codes = np.concatenate([unpack(x.as_py(), np.uint64) for x in table.column("codes")])
    nodes = np.concatenate([unpack(x.as_py(), np.int64) for x in table.column("nodes")])
    order = np.argsort(codes, kind="stable")
    codes, nodes = codes[order], nodes[order]
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    ends = np.append(starts[1:], len(codes))
    # Different sets of the same digest would only be compared together.
    met = np.add.reduceat(mix(nodes.view(np.uint64)), starts)
    few = np.flatnonzero(ends - starts > 1)
    few = few[np.unique(met[few], return_index=True)[1]]
    at = np.concatenate([np.arange(starts[i], ends[i]) for i in few]) if len(few) else np.empty(0, np.int64)
    return pa.table({"met": np.repeat(met[few].view(np.int64), (ends - starts)[few]), "node": nodes[at]})


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for codes, nodes in zip(batch.column(0), batch.column(1), strict=True):
            yield pa.record_batch([unpack(codes.as_py(), np.int64), unpack(nodes.as_py(), np.int64)], names=["met", "node"])


_PAIRS = "a long, b long, root_a long, root_b long"


def _cell(table: pa.Table, similarity: float, most: int) -> np.ndarray:
    """Pairs of rows of one cell that may be similar and are not connected: the closest to each row."""
    none = np.empty((0, 2), np.int64)
    roots = table.column("root").to_numpy()
    if (roots == roots[0]).all():
        return none
    nodes, sizes, sides = (table.column(c).to_numpy() for c in ("node", "n", "side"))
    across = table.column("i")[0].as_py() != table.column("j")[0].as_py()
    bits = [np.frombuffer(x, np.uint8) for x in table.column("sketch").to_pylist()]
    widths = np.array([len(x) for x in bits])
    order = np.argsort(sizes, kind="stable")
    ordered = sizes[order]
    ends = np.searchsorted(ordered, ordered / similarity + 1e-9, side="right")
    found, rows = [], None
    for place, at in enumerate(order.tolist()):
        if rows is None or rows.shape[1] != widths[at]:
            # Widths grow with the sizes: rows from here on are at least as wide.
            rows, first = np.concatenate([folded(bits[i][None], widths[at]) for i in order[place:]]), place
        window = order[place + 1:ends[place]]
        apart = roots[window] != roots[at]
        if across:
            apart &= sides[window] != sides[at]
        if not apart.any():
            continue
        differ = np.bitwise_count(rows[place + 1 - first:ends[place] - first] ^ rows[place - first]).sum(axis=1, dtype=np.int64)
        fits = apart & (differ <= (1 - similarity) / (1 + similarity) * (sizes[window] + sizes[at]) + 1e-9)
        if fits.any():
            found.append(np.stack([np.full(fits.sum(), at), window[fits], differ[fits]]))
    if not found:
        return none
    one, two, differ = np.concatenate(found, axis=1)
    failed = table.column("failed").to_pylist()
    if any(failed):
        place = {node: at for at, node in enumerate(nodes.tolist())}
        known = [at * len(nodes) + place[other] for at, others in enumerate(failed) for other in others or () if other in place]
        fresh = ~np.isin(one * len(nodes) + two, known) & ~np.isin(two * len(nodes) + one, known)
        one, two, differ = one[fresh], two[fresh], differ[fresh]
    row, other, differ = np.concatenate((one, two)), np.concatenate((two, one)), np.concatenate((differ, differ))
    order = np.lexsort((nodes[other], differ, row))
    row, other = row[order], other[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    chosen = rank < most
    return np.unique(np.sort(np.stack([row[chosen], other[chosen]], axis=1), axis=1), axis=0)


def _proposed(similarity: float, most: int):
    """For every row the ``most`` closest that its cells hold, may be similar and are not connected."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return trimmed(closest(table))

    def closest(table: pa.Table) -> pa.Table:
        cells = [table.column(c).to_numpy() for c in ("j", "i", "met")]
        order = np.lexsort(cells)
        table = table.take(pa.array(order)).combine_chunks()
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for cell in cells:
            new[1:] |= np.diff(cell[order]) != 0
        starts = np.flatnonzero(new)
        nodes, roots = table.column("node").to_numpy(), table.column("root").to_numpy()
        pairs = [np.empty((0, 2), np.int64)]
        for start, end in zip(starts, np.append(starts[1:], table.num_rows), strict=True):
            if end - start > 1:
                pairs.append(_cell(table.slice(start, end - start), similarity, most) + start)
        one, two = np.concatenate(pairs).T
        low = nodes[one] < nodes[two]
        a, b = np.where(low, one, two), np.where(low, two, one)
        _, first = np.unique(np.stack([nodes[a], nodes[b]]), axis=1, return_index=True)
        a, b = a[first], b[first]
        return pa.table({"a": nodes[a], "b": nodes[b], "root_a": roots[a], "root_b": roots[b]})

    return run


def _compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` with ``similar``, by the sets themselves."""
    first = sets.select(F.col("node").alias("a"), F.col("codes").alias("one"))
    second = sets.select(F.col("node").alias("b"), F.col("codes").alias("two"))
    shared = F.size(F.array_intersect("one", "two"))
    similar = shared >= (F.size("one") + F.size("two") - shared) * F.lit(similarity) - F.lit(1e-9)
    return pairs.join(first, "a").join(second, "b").select(*pairs.columns, similar.alias("similar"))


def _cells(members: DataFrame, roots: DataFrame, chunk: int, within: bool) -> DataFrame:
    """Members of groups that are not connected, once per cell: two chunks of the group that meet.

    The members of a group's largest component are chunks apart, which only meet chunks of
    the others. ``within`` has every chunk meet itself alone.
    """
    rooted = members.join(roots, "node")
    shares = rooted.groupBy("met", "root").agg(F.count("*").alias("n"))
    groups = (
        shares.groupBy("met").agg(F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("largest"), F.count("*").alias("roots"))
        .where("roots > 1")
    )
    def chunks(count):
        return F.ceil(count / F.lit(chunk)).cast("long")

    draw = F.xxhash64("node", F.lit("chunk"))
    rooted = rooted.join(groups, "met")
    if within:
        side = F.pmod(draw, chunks(F.col("all")))
        return rooted.withColumn("side", side).select("met", "node", "root", "side", F.col("side").alias("i"), F.col("side").alias("j"))
    rest, most = chunks(F.col("all") - F.col("largest.n")), chunks(F.col("largest.n"))
    side = F.when(F.col("root") == F.col("largest.root"), rest + F.pmod(draw, most)).otherwise(F.pmod(draw, rest))
    last = F.when(F.col("side") < F.col("rest"), F.col("rest") + F.col("most")).otherwise(F.col("rest")) - 1
    return (
        rooted.withColumns({"rest": rest, "most": most, "side": side})
        .select("met", "node", "root", "side", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("with"))
        .select("met", "node", "root", "side", F.least("side", "with").alias("i"), F.greatest("side", "with").alias("j"))
    )


def set_roots(
    rows: DataFrame, described: DataFrame, links: DataFrame, words: int, similarity: float, hot: np.ndarray, chunk: int
) -> DataFrame:
    """``(node, root)``: what ``links`` and similar shingle sets connect, directly or over others.

    Each round compares, for every set, the closest of those that it meets, that may be
    similar by their sketches, and that are not connected with it; later rounds compare
    more of them. It ends when none are left, so all similar sets end up connected, and
    sets of one component are not compared any more.
    """
    spark = rows.sparkSession
    shards = min(max(64, int(spark.conf.get("spark.sql.shuffle.partitions"))), 4096)
    nodes = durable(described.groupBy("node").agg(F.min("n").alias("n"), F.min("key").alias("key"), F.min("sketch").alias("sketch")))
    dealt = (
        described.where("n > 0").select("node", "prefix").dropDuplicates(["node"])
        .mapInArrow(_dealt(shards, hot), "shard int, codes binary, nodes binary")
    )
    if len(hot):
        dealt = durable(dealt)
    members = dealt.where("shard IS NOT NULL").groupBy("shard").applyInArrow(_met, "met long, node long")
    if len(hot):
        members = members.union(dealt.where("shard IS NULL").select("codes", "nodes").mapInArrow(_spread, "met long, node long"))
    members = durable(members.distinct())
    groups = max(shards, members.count() // MEMBERS)

    first = components(links)
    roots = durable(
        nodes.select("node").join(first.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
        .select("node", F.coalesce("root", "node").alias("root"))
    )
    sets = failed = None
    turn = 0
    while True:
        state = nodes.select("node", "n", "sketch")
        if failed is None:
            state = state.withColumn("failed", F.lit(None).cast("array<long>"))
        else:
            both = failed.select(F.col("a").alias("of"), F.col("b").alias("other")).union(failed.select("b", "a"))
            state = state.join(both.groupBy("of").agg(F.collect_list("other").alias("failed")), F.col("node") == F.col("of"), "left").drop("of")
        proposals = durable(
            _cells(members, roots, chunk, turn == 0).join(state, "node")
            .withColumn("shard", F.pmod(F.xxhash64("met", "i", "j"), F.lit(groups)))
            .groupBy("shard").applyInArrow(_proposed(similarity, 4 ** max(0, turn - 1)), _PAIRS)
            .dropDuplicates(["a", "b"])
        )
        if proposals.isEmpty():
            if turn:
                return roots
            turn += 1
            continue
        wanted = proposals.select(F.col("a").alias("node")).union(proposals.select("b")).distinct()
        if sets is not None:
            wanted = wanted.join(sets, "node", "left_anti")
        keys = durable(nodes.join(wanted, "node", "left_semi").select("key").distinct())
        if keys.count() <= BROADCAST_TEXTS:
            keys = F.broadcast(keys)
        more = durable(
            rows.join(keys, "key", "left_semi").select("text").mapInArrow(_sets(words), "node long, codes array<long>").dropDuplicates(["node"])
        )
        sets = more if sets is None else sets.union(more)
        compared = durable(_compared(proposals, sets, similarity))
        refuted = compared.where("NOT similar").select("a", "b")
        failed = refuted if failed is None else failed.union(refuted)
        merged = components(compared.where("similar").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
        roots = durable(
            roots.join(merged.select(F.col("node").alias("of"), F.col("root").alias("to")), F.col("root") == F.col("of"), "left")
            .select("node", F.coalesce("to", "root").alias("root"))
        )
        turn += 1


def near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    similarity: float = 0.8,
    chunk: int = CHUNK,
    gathered: int = GATHERED,
) -> DataFrame:
    """One row per row of ``docs``: its id, ``text_sha256`` and ``kept``.

    Two texts are linked if their sets of ``words``-word shingles have a Jaccard similarity
    of ``similarity`` or more (compared exactly, but for equal 64-bit codes of different
    shingles), or by operator 8's fingerprints. Of the rows that links connect, directly or
    over others, those of the smallest id stay, and of the smallest digest where texts share
    that id; null ids come last. Rows are told apart by id and text, so rows with equal or
    null ids are judged by their own text; rows equal in both stay or go together. Null and
    empty texts, and others without words, are copies of one another.
    """
    content = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc"), F.sha2(content.cast("binary"), 256).alias("text_sha256"),
        F.xxhash64(content).alias("key"), content.cast("binary").alias("text"),
    )
    with temporary_tables(docs.sparkSession) as outlast:
        sample = (
            rows.where(F.pmod(F.xxhash64(F.lit("common"), "text_sha256"), F.lit(SAMPLED)) == 0).select("text")
            .mapInArrow(_codes(words), "code long").groupBy("code").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN)
            .orderBy(F.desc("n"), "code").limit(MOST_COMMON).toArrow().sort_by("code")
        )
        common, often = sample.column("code").to_numpy().view(np.uint64), sample.column("n").to_numpy()
        order = np.argsort(common)
        common, often = common[order], often[order]
        described = durable(rows.mapInArrow(
            _described(words, similarity, common, often),
            "doc long, text_sha256 string, key long, print long, node long, n int, sketch binary, prefix binary",
        ))
        prints = durable(described.groupBy("print").agg(F.min("node").alias("a")))
        simhash = (
            near_links(prints.select("print")).withColumnsRenamed({"a": "p", "b": "q"})
            .join(prints.select(F.col("print").alias("p"), "a"), "p")
            .join(prints.select(F.col("print").alias("q"), F.col("a").alias("b")), "q").select("a", "b")
        )
        equal = described.select("print", F.col("node").alias("b")).distinct().join(prints, "print").select("a", "b")
        roots = set_roots(
            rows, described, simhash.union(equal), words, similarity, common[often * SAMPLED >= gathered], chunk
        )
        labelled = outlast(
            described.select("doc", "text_sha256", "node").join(roots, "node").select("doc", "text_sha256", "root")
        )
    best = durable(labelled.groupBy("root").agg(
        F.min(F.struct(F.col("doc").isNull().alias("no_id"), "doc", "text_sha256")).alias("best")
    ))
    return labelled.join(best, "root").select(
        F.col("doc").alias(id_col), "text_sha256",
        (F.col("doc").eqNullSafe(F.col("best.doc")) & (F.col("text_sha256") == F.col("best.text_sha256"))).alias("kept"),
    )
