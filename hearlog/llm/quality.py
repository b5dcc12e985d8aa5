"""Quality by an interpolated modified Kneser-Ney model of trusted text (operator 1).

The model predicts each UTF-8 byte from the bytes before it, per language. Its counts are
dealt to shards by the two bytes before the predicted one. A shard then has all contexts of
two and more bytes whole, with all their continuations, and can evaluate the recursion down
to order 3 by itself; orders 2 and 1 are tables of at most 257 * 257 numbers a language.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearlog.llm.blocks import (
    Block,
    blocks_of,
    by_shard,
    mix,
    pack,
    pack_sorted,
    pack_texts,
    unpack,
    unpack_sorted,
    unpack_texts,
)
from hearlog.llm.common import record_batches, trimmed
from hearlog.session import durable

ORDER = 5
PAD = 0xFF  # never a byte of UTF-8; stands for what precedes a document
PIECE = 1 << 20
SYMBOLS = 257

#: Trusted ids up to which they are sent to every executor (64 MB at most); beyond it,
#: documents and trusted ids are joined by shuffling both.
BROADCAST_IDS = 4_000_000

_U8 = np.uint64(8)


def grams(text: bytes) -> Iterator[np.ndarray]:
    """The codes of all windows of ORDER bytes that end in a byte of the text, in pieces."""
    data = np.frombuffer(bytes([PAD]) * (ORDER - 1) + text, np.uint8)
    for start in range(0, len(text), PIECE):
        size = min(PIECE, len(text) - start)
        codes = data[start:start + size].astype(np.uint64)
        for k in range(1, ORDER):
            codes <<= _U8
            codes |= data[start + k:start + k + size]
        yield codes


def block_pieces(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Codes of many texts, in pieces of about PIECE."""
    waiting, size = [], 0
    for text in texts:
        if size and size + len(text) > PIECE:
            yield _joined(waiting)
            waiting, size = [], 0
        if len(text) > PIECE:
            yield from grams(text)
        else:
            waiting.append(text)
            size += len(text)
    if size:
        yield _joined(waiting)


def _joined(texts: list[bytes]) -> np.ndarray:
    """Codes of several texts at once; windows that end in padding between them are left out."""
    pad = bytes([PAD]) * (ORDER - 1)
    whole = pad + pad.join(texts)
    data = np.frombuffer(whole, np.uint8)
    codes = data[:len(data) - ORDER + 1].astype(np.uint64)
    for k in range(1, ORDER):
        codes <<= _U8
        codes |= data[k:len(data) - ORDER + 1 + k]
    return codes[data[ORDER - 1:] != PAD]


def distinct_grams(texts: list[bytes], counted: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Ascending distinct codes of a block, with how often each occurs if ``counted``."""
    seen = np.empty(0, np.uint64)
    counts = np.empty(0, np.int64)
    for codes in block_pieces(texts):
        if counted:
            places, found = pd.factorize(codes)
            table = pd.Series(np.bincount(places), index=found)
            both = pd.concat([pd.Series(counts, index=seen), table]).groupby(level=0).sum()
            seen, counts = both.index.to_numpy(np.uint64), both.to_numpy(np.int64)
        else:
            seen = pd.unique(np.concatenate([seen, pd.unique(codes)]))
    if not counted:
        return np.sort(seen), None
    return seen, counts


def shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    """By the two bytes before the last one."""
    return (mix((codes >> _U8) & np.uint64(0xFFFF)) % np.uint64(shards)).astype(np.int64)


def merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate(codes)
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], np.concatenate(counts)[order]
    starts = _starts(keys)
    return keys[starts], np.add.reduceat(values, starts)


def lower_orders(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, its codes, in how many different bytes they continue a longer code), 4 and 3."""
    for order in range(ORDER - 1, 2, -1):
        suffix = np.sort(codes & np.uint64((1 << (8 * order)) - 1))
        starts = _starts(suffix)
        codes = suffix[starts]
        yield order, codes, np.diff(np.append(starts, len(suffix)))


def counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == n).sum()) for n in (1, 2, 3, 4)]


def discounts(n: list[int]) -> np.ndarray:
    """Discounts for counts 1, 2 and 3 or more, by Chen and Goodman's estimate.

    Where too few counts of a size exist for it: 0.5, 1 and 1.5.
    """
    plain = np.array([0.5, 1.0, 1.5])
    if min(n) <= 0:
        return plain
    y = n[0] / (n[0] + 2 * n[1])
    found = np.array([1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]])
    return np.where((found > 0) & (found < np.array([1, 2, 3])), found, plain)


def _starts(ascending: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    if not len(ascending):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], ascending[1:] != ascending[:-1])))


class Level:
    """One order of the model: its codes, and what each context keeps and passes down."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, discount: np.ndarray):
        self.codes = codes
        if not len(codes):
            return
        context = codes >> _U8
        starts = _starts(context)
        self.contexts = context[starts]
        taken = discount[np.minimum(counts, 3) - 1]
        total = np.add.reduceat(counts, starts).astype(float)
        self.passed = np.add.reduceat(taken, starts) / total
        self.kept = (counts - taken) / np.repeat(total, np.diff(np.append(starts, len(codes))))

    def over(self, codes: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Probabilities of ``codes`` given those of the next lower order."""
        if not len(self.codes):
            return lower
        kept, passed = np.zeros(len(codes)), np.ones(len(codes))
        place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        hit = self.codes[place] == codes
        kept[hit] = self.kept[place[hit]]
        context = codes >> _U8
        place = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        hit = self.contexts[place] == context
        passed[hit] = self.passed[place[hit]]
        return kept + passed * lower


def pair_probabilities(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Order 2 over order 1 over the uniform distribution, for all codes of two bytes."""
    order = np.argsort(pairs)
    pairs, counts = pairs[order].astype(np.uint64), counts[order].astype(np.int64)
    last = np.bincount((pairs & np.uint64(0xFF)).astype(np.int64), minlength=256)
    seen = np.flatnonzero(last)
    single = Level(seen.astype(np.uint64), last[seen], discounts(counts_of_counts(last[seen])))
    one = single.over(np.arange(256, dtype=np.uint64), np.full(256, 1.0 / SYMBOLS))
    every = np.arange(65536, dtype=np.uint64)
    level = Level(pairs, counts, discounts(counts_of_counts(counts)))
    return level.over(every, one[(every & np.uint64(0xFF)).astype(np.int64)])


def log_probabilities(asked, codes, counts, tables: list[np.ndarray], pair: np.ndarray) -> np.ndarray:
    """Natural logarithms for ascending codes; ``tables``: discounts of orders 3, 4 and 5."""
    levels = [(order, *rest) for order, *rest in lower_orders(codes)][::-1] + [(ORDER, codes, counts)]
    found = pair[(asked & np.uint64(0xFFFF)).astype(np.int64)]
    for (order, own, own_counts), discount in zip(levels, tables, strict=True):
        mask = np.uint64((1 << (8 * order)) - 1)
        found = Level(own, own_counts, discount).over(asked & mask, found)
    return np.log(found).astype(np.float32)


_COUNTED = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("shard", T.IntegerType()),
    T.StructField("codes", T.BinaryType()), T.StructField("counts", T.BinaryType()),
])
_MODEL = (
    "lang string, shard int, codes binary, counts binary, pairs array<int>, pair_counts array<int>, "
    "n array<array<long>>"
)


def _count(shards: int):
    arrow = pa.schema([
        ("lang", pa.string()), ("shard", pa.int32()), ("codes", pa.binary()), ("counts", pa.binary()),
    ])

    def rows(batches):
        for block in blocks_of(batches):
            codes, counts = distinct_grams(block.texts, True)
            for shard, at in by_shard(codes, shard_of(codes, shards)):
                yield block.key, shard, pack_sorted(codes[at]), pack(counts[at])

    return lambda batches: record_batches(rows(batches), arrow, 256)


def _merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield trimmed(_shard(key, batches))


def _shard(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> pa.RecordBatch:
    """One shard's counts from all blocks', a few at a time."""
    codes, counts, waiting = [], [], 0
    for batch in batches:
        for row in range(batch.num_rows):
            codes.append(unpack_sorted(batch.column("codes")[row].as_py()))
            counts.append(unpack(batch.column("counts")[row].as_py(), np.int64))
            waiting += len(codes[-1])
            if waiting > 1 << 21:
                one, two = merged(codes, counts)
                codes, counts, waiting = [one], [two], 0
    own, total = merged(codes, counts)
    orders = list(lower_orders(own))
    three = orders[-1][1]
    pairs, places = np.unique(three & np.uint64(0xFFFF), return_counts=True)
    n = [counts_of_counts(c) for _, _, c in orders[::-1]] + [counts_of_counts(total)]
    return pa.record_batch(
        [
            pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int32()),
            pa.array([pack_sorted(own)], pa.binary()), pa.array([pack(total)], pa.binary()),
            pa.array([pairs.astype(np.int32).tolist()], pa.list_(pa.int32())),
            pa.array([places.astype(np.int32).tolist()], pa.list_(pa.int32())),
            pa.array([n], pa.list_(pa.list_(pa.int64()))),
        ],
        names=["lang", "shard", "codes", "counts", "pairs", "pair_counts", "n"],
    )


def _ask(shards: int, parts: int):
    arrow = pa.schema([
        ("lang", pa.string()), ("shard", pa.int32()), ("part", pa.int32()),
        ("block", pa.string()), ("codes", pa.binary()),
    ])

    def rows(batches):
        for block in blocks_of(batches):
            codes, _ = distinct_grams(block.texts, False)
            part = sum(block.name.encode()) % parts
            for shard, at in by_shard(codes, shard_of(codes, shards)):
                yield block.key, shard, part, block.name, pack_sorted(codes[at])

    return lambda batches: record_batches(rows(batches), arrow, 256)


def _answer(key, model: pa.Table, questions: pa.Table) -> pa.Table:
    return trimmed(_answers(key, model, questions))


def _answers(key, model: pa.Table, questions: pa.Table) -> pa.Table:
    """The shard's log probabilities for each block's codes; none where there is no model."""
    names, shards, answers = [], [], []
    if model.num_rows:
        row = model.to_pylist()[0]
        codes, counts = unpack_sorted(row["codes"]), unpack(row["counts"], np.int64)
        tables = [discounts(n) for n in row["n"]]
        pair = pair_probabilities(np.array(row["pairs"], np.int64), np.array(row["pair_counts"], np.int64))
        for number in range(questions.num_rows):
            asked = unpack_sorted(questions.column("codes")[number].as_py())
            names.append(questions.column("block")[number].as_py())
            shards.append(key[1].as_py())
            answers.append(pack(log_probabilities(asked, codes, counts, tables, pair)))
    return pa.table(
        [pa.array(names, pa.string()), pa.array(shards, pa.int32()), pa.array(answers, pa.binary())],
        names=["block", "shard", "answers"],
    )


def _texts(batches):
    arrow = pa.schema([
        ("block", pa.string()), ("lang", pa.string()), ("ids", pa.binary()), ("no_id", pa.binary()),
        ("texts", pa.binary()), ("lengths", pa.binary()),
    ])

    def rows(batches):
        for block in blocks_of(batches):
            ids = np.array([0 if i is None else i for i in block.ids], np.int64)
            missing = np.array([i is None for i in block.ids], np.bool_)
            yield block.name, block.key, pack(ids), pack(missing), *pack_texts(block.texts)

    return record_batches(rows(batches), arrow, 1)


def block_scores(block: Block, codes: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """The sum of log probabilities over each document."""
    index = pd.Index(codes)
    sums = np.zeros(len(block.texts))
    at = 0
    while at < len(block.texts):
        to, size = at, 0
        while to < len(block.texts) and (to == at or size + len(block.texts[to]) <= PIECE):
            size += len(block.texts[to])
            to += 1
        owner = np.repeat(np.arange(to - at), [len(text) for text in block.texts[at:to]])
        done = 0
        for piece in block_pieces(block.texts[at:to]):
            place = index.get_indexer(piece)
            if len(place) and place.min() < 0:
                raise RuntimeError(f"block {block.name} holds codes it never asked for; run the job again")
            sums[at:to] += np.bincount(owner[done:done + len(piece)], weights=logs[place], minlength=to - at)
            done += len(piece)
        at = to
    return sums


def _score(shards: int):
    def run(key, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        return trimmed(scored(key, blocks, answers))

    def scored(key, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        ids, langs, sizes, sums = [], [], [], []
        if answers.num_rows and not blocks.num_rows:
            raise RuntimeError(f"block {key[0].as_py()} has changed between two scans; run the job again")
        if blocks.num_rows:
            row = blocks.to_pylist()[0]
            block = Block(row["block"], row["lang"], texts=unpack_texts(row["texts"], row["lengths"]))
            missing = unpack(row["no_id"], np.bool_)
            ids = [None if none else i for i, none in zip(unpack(row["ids"], np.int64).tolist(), missing, strict=True)]
            langs = [row["lang"]] * len(ids)
            sizes = [len(text) for text in block.texts]
            if answers.num_rows:
                codes, _ = distinct_grams(block.texts, False)
                logs = np.zeros(len(codes))
                packed = dict(zip(answers.column("shard").to_pylist(), answers.column("answers"), strict=True))
                for shard, at in by_shard(codes, shard_of(codes, shards)):
                    # A shard of which the model holds nothing was not asked about these codes.
                    logs[at] = unpack(packed[shard].as_py(), np.float32)
                sums = block_scores(block, codes, logs).tolist()
            else:
                sums = [None] * len(ids)
        return pa.table(
            [pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(sizes, pa.int64()),
             pa.array(sums, pa.float64())],
            names=["doc", "lang", "bytes", "log_probability"],
        )

    return run


def _with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id is among ``ids(doc)``."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc", "left_semi")


def scores(docs: DataFrame, training_ids: DataFrame) -> DataFrame:
    """``(doc, lang, bytes, log_probability)`` of every row of ``docs(doc, text, lang)``.

    The model of a language is trained on its documents among ``training_ids(doc)``. Texts
    are binary. The sum is null for languages without any training text, and 0 for
    documents without bytes.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = min(max(64, partitions), 4096)
    parts = -(-partitions // shards)

    counted = _with_ids(docs, training_ids).where(F.length("text") > 0).mapInArrow(_count(shards), _COUNTED)
    model = durable(counted.groupBy("lang", "shard").applyInArrow(_merge, _MODEL))
    per_lang = model.groupBy("lang").agg(
        *[F.sum(F.col("n")[i][j]).alias(f"n{i}{j}") for i in range(ORDER - 2) for j in range(4)]
    ).select("lang", F.array(*[
        F.array(*[F.col(f"n{i}{j}") for j in range(4)]) for i in range(ORDER - 2)
    ]).alias("n"))
    pairs = (
        model.select("lang", F.explode(F.arrays_zip("pairs", "pair_counts")).alias("p"))
        .groupBy("lang", F.col("p.pairs").alias("pair")).agg(F.sum("p.pair_counts").cast("int").alias("places"))
        .groupBy("lang").agg(F.collect_list(F.struct("pair", "places")).alias("list"))  # at most 65,792 a language
        .select("lang", F.col("list.pair").alias("pairs"), F.col("list.places").alias("pair_counts"))
    )
    tables = durable(
        per_lang.join(pairs.withColumnRenamed("lang", "pair_lang"), F.col("lang").eqNullSafe(F.col("pair_lang")))
        .select(F.col("lang").alias("table_lang"), "n", "pairs", "pair_counts")
    )
    # Every shard a language could be asked about, those without counts of their own included.
    slots = tables.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("table_shard")
    )
    empty = pack_sorted(np.empty(0, np.uint64)), pack(np.empty(0, np.int64))
    ready = (
        slots.join(
            model.select("lang", "shard", "codes", "counts"),
            F.col("lang").eqNullSafe(F.col("table_lang")) & (F.col("shard") == F.col("table_shard")), "left",
        )
        .select(
            F.col("table_lang").alias("lang"), F.col("table_shard").cast("int").alias("shard"),
            F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
            F.coalesce("codes", F.lit(empty[0])).alias("codes"),
            F.coalesce("counts", F.lit(empty[1])).alias("counts"), "n", "pairs", "pair_counts",
        )
    )
    rows = docs.select("doc", "text", "lang")
    questions = rows.mapInArrow(
        _ask(shards, parts), "lang string, shard int, part int, block string, codes binary"
    )
    answers = (
        ready.groupBy("lang", "shard", "part").cogroup(questions.groupBy("lang", "shard", "part"))
        .applyInArrow(_answer, "block string, shard int, answers binary")
    )
    blocks = rows.mapInArrow(
        _texts, "block string, lang string, ids binary, no_id binary, texts binary, lengths binary"
    )
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _score(shards), "doc long, lang string, bytes long, log_probability double"
    )


def judge(
    docs: DataFrame,
    trusted_ids: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    held_out: int = 5,
    shrink_bytes: int = 200,
    length_power: float = 0.25,
    clean_loss: float = 0.02,
    fence: float = 2.0,
) -> DataFrame:
    """One row per document: ``lang``, ``bytes``, ``perplexity``, ``high``, ``kept``.

    ``trusted_ids`` has one column, the ids of trusted documents. Of these, one in
    ``held_out`` (by a digest of the id) is kept from training and sets the thresholds.
    The perplexity is per byte. It is drawn towards the language's mean as if the document
    had ``shrink_bytes`` more bytes of average text, so that a few words are not judged by
    chance. Log perplexities of long documents lie closer together; their distance from
    the mean is multiplied by (bytes + ``shrink_bytes``) ** ``length_power`` to make it
    comparable. A language's threshold for it is what all but ``clean_loss`` of its
    held-out documents stay within; what is beyond is unlike the trusted text and goes.
    How far a quantile of few documents can be trusted grows with their number: it is
    drawn, as if 1 / ``clean_loss`` documents said so, to their third quartile plus
    ``fence`` times twice the way from the median to it (at least 5 % of the mean above it,
    at the shortest length), where that is higher. ``high`` is the threshold as a
    perplexity, for the document's length.

    Documents without bytes, and those of a language without trusted text (null is a
    language of its own), are kept; their perplexity is null where there is no model.
    Rows with equal ids are rows of their own, and null ids are never trusted. Extra
    columns are not read. ``docs`` has to be a stored table (see ``blocks``).
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
        F.col(lang_col).alias("lang"),
    )
    ids = trusted_ids.select(F.col(trusted_ids.columns[0]).cast("long").alias("doc")).where("doc IS NOT NULL").distinct()
    checks = F.pmod(F.xxhash64(F.lit("held out"), "doc"), F.lit(held_out)) == 0
    scored = durable(scores(rows, durable(ids.where(~checks))))

    held = (
        scored.where("bytes > 0 AND log_probability IS NOT NULL")
        .join(ids.where(checks).withColumnRenamed("doc", "id"), F.col("doc") == F.col("id"))
    )
    means = held.groupBy("lang").agg((-F.sum("log_probability") / F.sum("bytes")).alias("mean"))
    drawn = (F.lit(float(shrink_bytes)) * F.col("mean") - F.col("log_probability")) / (F.col("bytes") + shrink_bytes)
    stretch = F.pow(F.col("bytes") + F.lit(float(shrink_bytes)), F.lit(length_power))
    distance = (drawn - F.col("mean")) * stretch

    def with_table(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(
            right.withColumnRenamed("lang", "table_lang"), F.col("lang").eqNullSafe(F.col("table_lang")), "left"
        ).drop("table_lang")

    least = 0.05 * F.col("mean") * float(shrink_bytes) ** length_power
    bounds = (
        with_table(held, means).groupBy("lang", "mean")
        .agg(
            F.percentile_approx(distance, [0.5, 0.75, 1 - clean_loss], 10_000).alias("q"), F.count("*").alias("held")
        )
        .withColumn("reach", F.greatest(fence * 2 * (F.col("q")[1] - F.col("q")[0]), least))
        .withColumn("told", F.col("held") / (F.col("held") + 1 / clean_loss))
        .select(
            "lang", "mean",
            (F.col("told") * F.col("q")[2] + (1 - F.col("told")) * F.greatest(F.col("q")[2], F.col("q")[1] + F.col("reach"))).alias("most"),
        )
    )
    return with_table(scored, bounds).select(
        F.col("doc").alias(id_col),
        F.col("lang").alias(lang_col),
        "bytes",
        F.exp(drawn).alias("perplexity"),
        F.exp(F.col("mean") + F.col("most") / stretch).alias("high"),
        F.coalesce(distance <= F.col("most"), F.lit(True)).alias("kept"),
    )
