"""SimHash near-duplicates with pigeonring filtering (operator 8)."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearlog.llm.common import record_batches
from hearlog.llm.components import components
from hearlog.session import durable

BITS = 64

#: Up to this many fingerprints that share a chain are compared with one another; larger
#: groups are linked through shared one-bit variants, which is exact too and grows linearly.
PAIRED = 64


def fingerprint_bits(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """The fingerprint of one UTF-8 text as an unsigned number.

    A-Z are lower-cased; words are runs of bytes other than space and 9 to 13. A bit is
    set if more than half of the hashes of the word shingles have it. Texts of fewer words
    have their whole sequence as the only shingle; texts without words have fingerprint 0.
    """
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(part) + 1 for part in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(words, len(parts))
    count = len(parts) - span + 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, count, 1 << 15):
        to = min(count, at + (1 << 15))
        hashes = np.fromiter(
            (
                digest(joined[a:b], seed)
                for a, b in zip(starts[at:to].tolist(), ends[at + span - 1:to + span - 1].tolist(), strict=True)
            ),
            dtype=np.uint64, count=to - at,
        )
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > count).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = 3, seed: int = 42) -> DataFrame:
    """``(doc, print)`` per row of ``docs``; the print's 64 bits are held in a signed long."""
    arrow = pa.schema([("doc", pa.int64()), ("print", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                bits = fingerprint_bits(text.as_py(), words, seed)
                yield doc.as_py(), bits - (1 << BITS) if bits >> (BITS - 1) else bits

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(
        lambda batches: record_batches(rows(batches), arrow), "doc long, print long"
    )


def segments(count: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of ``count`` segments of nearly equal width."""
    cuts = [BITS * i // count for i in range(count + 1)]
    return [(low, high - low) for low, high in zip(cuts, cuts[1:], strict=False)]


def _mask(parts: list[tuple[int, int]]) -> int:
    bits = 0
    for low, width in parts:
        bits |= ((1 << width) - 1) << low
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def _differing(mask: int) -> Column:
    return F.bit_count(F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(F.lit(mask)))


def near_links(prints: DataFrame, distance: int = 2, parts: int = 5) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints, enough to connect all near ones.

    The segments lie on a ring. If two fingerprints differ in at most ``distance`` bits,
    some segment starts a chain of which every prefix of n segments differs in at most
    n * distance / parts bits. Prefixes whose budget is below one bit have to be equal:
    they are the join key (two of five segments for distance 2). The longer prefixes prune
    what shares a key, and the full Hamming distance decides.

    Where more than ``PAIRED`` fingerprints share a key, pairs are not formed. Each
    fingerprint is put under itself and under each of its one-bit variants outside the
    key. Fingerprints under one variant differ in at most two bits, and any two that
    differ in one or two bits meet under one; each is linked to the smallest there.
    """
    if not 0 <= distance <= 2:
        raise ValueError("the links of large groups are exact for distances from 0 to 2")
    if parts <= distance:
        raise ValueError("there have to be more segments than differing bits")
    ring = segments(parts)
    budget = {n: n * distance // parts for n in range(1, parts + 1)}
    equal = max(n for n in budget if budget[n] == 0)
    chains = []
    for start in range(parts):
        order = [ring[(start + i) % parts] for i in range(parts)]
        chains.append({
            "key": _mask(order[:equal]),
            "longer": [(_mask(order[:n]), budget[n]) for n in range(equal + 1, parts + 1)],
            "free": [low + i for low, width in order[equal:] for i in range(width)],
        })
    keyed = durable(prints.select(
        F.col("print"),
        F.posexplode(F.array(*[F.col("print").bitwiseAND(F.lit(c["key"])) for c in chains])).alias("chain", "key"),
    ))
    groups = keyed.groupBy("chain", "key").agg(F.count("*").alias("members")).where("members > 1")
    shared = durable(keyed.join(groups, ["chain", "key"]))

    few = shared.where(F.col("members") <= PAIRED)
    within = F.lit(False)
    for number, chain in enumerate(chains):
        fits = F.col("chain") == number
        for mask, most in chain["longer"]:
            fits = fits & (_differing(mask) <= most)
        within = within | fits
    pairs = (
        few.select("chain", "key", F.col("print").alias("a"))
        .join(few.select("chain", "key", F.col("print").alias("b")), ["chain", "key"])
        .where(F.col("a") < F.col("b")).where(within)
        .where(_differing(-1) <= distance)
        .select("a", "b")
    )
    many = shared.where(F.col("members") > PAIRED)
    flips = [[1 << bit if bit < BITS - 1 else -(1 << bit) for bit in c["free"]] for c in chains]
    if distance == 0:
        flips = [[] for _ in chains]
    masks = F.get(F.array(*[F.array(F.lit(0), *[F.lit(f) for f in row]).cast("array<long>") for row in flips]),
                  F.col("chain"))
    variants = many.select(
        "chain", "key", "print", F.explode(masks).alias("flip")
    ).withColumn("variant", F.col("print").bitwiseXOR(F.col("flip")))
    # Under distance 1 only the variant's own fingerprint is near to all the others there.
    centre = F.min("print") if distance == 2 else F.min(F.when(F.col("flip") == 0, F.col("print")))
    smallest = variants.groupBy("chain", "variant").agg(centre.alias("least"), F.count("*").alias("n"))
    stars = (
        variants.join(smallest.where("n > 1"), ["chain", "variant"])
        .where(F.col("print") != F.col("least"))
        .select(F.col("least").alias("a"), F.col("print").alias("b"))
    )
    return pairs.union(stars).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    seed: int = 42,
    distance: int = 2,
    parts: int = 5,
) -> DataFrame:
    """One row per document: ``fingerprint`` (16 hexadecimal digits) and ``component_id``.

    Documents are linked if their fingerprints differ in at most ``distance`` bits;
    ``component_id`` is the smallest id that links lead to, the document's own included.
    Null and empty texts have fingerprint 0 and link like any other. Rows with equal ids
    stay rows of their own; null ids take part and are never the smallest (null only where
    no linked row has an id). Extra columns are not read; an empty table gives no rows.

    Equal fingerprints are one node, however many documents have it.
    """
    table = durable(fingerprints(docs, id_col, text_col, words, seed))
    nodes = table.groupBy("print").agg(F.min("doc").alias("first"))
    roots = components(near_links(nodes.select("print"), distance, parts))
    labelled = nodes.join(roots, F.col("print") == F.col("node"), "left").select(
        "print", "first", F.coalesce("root", "print").alias("root")
    )
    least = labelled.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component_id"))
    components_of = labelled.join(least, F.col("root") == F.col("r")).select("print", "component_id")
    return table.join(components_of, "print").select(
        F.col("doc").alias(id_col),
        F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        "component_id",
    )
