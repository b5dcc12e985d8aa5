"""Repeated substrings, removed by bucket-pointer refinement (operator 4).

A string of ``length`` bytes is refined from its two halves of q bytes. The first bucket of
a position is the identifier of the q bytes there; the bucket of the whole string is the
pair of identifiers at the position and q bytes later. Only buckets with several members are
refined, and whole runs of positions are refined at once:

* Of the q-grams in a string, the one with the smallest identifier is its anchor. Equal
  strings have equal anchors at equal places, and neighbouring strings mostly share theirs,
  so the text falls into runs of strings with one anchor (on average q / 2 of them).
* First round: an anchor's bucket that no other run has ends there; nothing in it repeats.
  Where whole runs are equal (identifiers of all later offsets), all their strings repeat.
* Second round, for what is left: each string of a run whose anchor repeats but which is not
  repeated as a whole, compared by the pair of identifiers it is refined to.

Identifiers are 64-bit digests of the bytes, so no global numbering is needed; shards sort
them and find the buckets with several members.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearlog.llm.blocks import blocks_of, by_shard, mix, pack, pack_sorted, pack_texts, unpack, unpack_sorted, unpack_texts
from hearlog.llm.common import record_batches
from hearlog.session import durable

BLOCK = 8 << 20
PIECE = 1 << 18
_PLACE = np.uint64((1 << 20) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(20)
_VALUES = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _digests(data: np.ndarray, q: int) -> np.ndarray:
    """Identifiers of the q bytes at each position of a piece."""
    powers = _powers(_BASE, len(data))
    inverse = _powers(pow(_BASE, -1, 1 << 64), len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * powers, out=sums[1:])
    return mix((sums[q:] - sums[:-q]) * inverse[:len(data) - q + 1])


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of ``width`` values."""
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def _pieces(data: np.ndarray, q: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first position, number of strings that start here, q-gram identifiers) of each piece."""
    total = len(data) - 2 * q + 1
    for start in range(0, max(0, total), PIECE):
        count = min(PIECE, total - start)
        yield start, count, _digests(data[start:start + count + 2 * q - 1], q)


def _inside(start: int, count: int, ends: np.ndarray, length: int) -> np.ndarray:
    """Which strings that start in the piece lie within one document."""
    inside = np.ones(count, bool)
    first = np.searchsorted(ends, start, side="right")
    for end in ends[first:].tolist():
        if end - length + 1 >= start + count:
            break
        inside[max(0, end - length + 1 - start):max(0, end - start)] = False
    return inside


def runs(data: np.ndarray, ends: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one anchor: first and last position, anchor and run identifiers."""
    found = []
    for start, count, ids in _pieces(data, q):
        packed = (ids & ~_PLACE) | np.arange(len(ids), dtype=np.uint64)
        anchor = (_smallest(packed, q + 1) & _PLACE).astype(np.int64)[:count]
        inside = _inside(start, count, ends, 2 * q)
        change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])) + 1
        first = np.concatenate(([0], change))
        last = np.concatenate((change, [count])) - 1
        kept = inside[first]
        first, last = first[kept], last[kept]
        whole = mix(
            ids[first] * _STEP + mix(ids[first + q] * _STEP + mix(ids[last + q] + (last - first).astype(np.uint64)))
        )
        found.append((first + start, last + start, ids[anchor[first]], whole))
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def strings(data: np.ndarray, wanted: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions marked in ``wanted``, and the identifiers that their strings are refined to."""
    places, refined = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for start, count, ids in _pieces(data, q):
        at = np.flatnonzero(wanted[start:start + count])
        places.append(at + start)
        refined.append(mix(ids[at] * _STEP + ids[at + q]))
    return np.concatenate(places), np.concatenate(refined)


def _marked(size: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bytes that the spans from ``first`` to ``end`` (exclusive) cover."""
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, first, 1)
    np.add.at(steps, end, -1)
    return np.cumsum(steps[:-1]) > 0


def _members(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


_ASKED = pa.schema([
    ("kind", pa.string()), ("shard", pa.int32()), ("block", pa.string()),
    ("keys", pa.binary()), ("counts", pa.binary()),
])
_ASKED_DDL = "kind string, shard int, block string, keys binary, counts binary"


def _shards(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys % np.uint64(shards)).astype(np.int64)


def _asked(kind: str, block: str, keys: np.ndarray, shards: int) -> Iterator[tuple]:
    keys, counts = _members(keys)
    for shard, at in by_shard(keys, _shards(keys, shards)):
        own = counts[at]
        # Most keys occur once in a block; then nothing is sent for their counts.
        yield kind, shard, block, pack_sorted(keys[at]), pack(own) if (own > 1).any() else None


def _ends(texts: list[bytes]) -> np.ndarray:
    return np.cumsum([len(text) for text in texts], dtype=np.int64)


def _first_round(q: int, shards: int, block_bytes: int):
    def rows(batches):
        for block in blocks_of(batches, block_bytes):
            data = np.frombuffer(b"".join(block.texts), np.uint8)
            _, _, anchors, wholes = runs(data, _ends(block.texts), q)
            yield from _asked("anchor", block.name, anchors, shards)
            yield from _asked("run", block.name, wholes, shards)

    return lambda batches: record_batches(rows(batches), _ASKED, 128)


def _several(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """For each block, its keys with several members anywhere, their number, and whether the
    block is the first of those that hold the key."""
    order = np.argsort(np.array(table.column("block").to_pylist(), dtype=object), kind="stable").tolist()
    blocks = [table.column("block")[i].as_py() for i in order]
    keys = [unpack_sorted(table.column("keys")[i].as_py()) for i in order]
    given = [table.column("counts")[i].as_py() for i in order]
    counts = [
        np.ones(len(own), np.int64) if packed is None else unpack(packed, np.int64)
        for own, packed in zip(keys, given, strict=True)
    ]
    every = np.concatenate(keys)
    distinct, first, place = np.unique(every, return_index=True, return_inverse=True)
    totals = np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)
    at, out = 0, {name: [] for name in ("kind", "block", "keys", "counts", "first")}
    for block, own in zip(blocks, keys, strict=True):
        here = place[at:at + len(own)]
        many = np.flatnonzero(totals[here] > 1)
        if len(many):
            out["kind"].append(key[0].as_py())
            out["block"].append(block)
            out["keys"].append(pack_sorted(own[many]))
            out["counts"].append(pack(totals[here[many]]))
            out["first"].append(pack(first[here[many]] == at + many))
        at += len(own)
    types = {"kind": pa.string(), "block": pa.string(), "keys": pa.binary(), "counts": pa.binary(), "first": pa.binary()}
    return pa.table({name: pa.array(values, types[name]) for name, values in out.items()})


_SEVERAL_DDL = "kind string, block string, keys binary, counts binary, first binary"


def _answers(table: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All shards' answers of one kind, by ascending key."""
    rows = [row for row in table.to_pylist() if row["kind"] == kind]
    keys = np.concatenate([np.empty(0, np.uint64), *[unpack_sorted(row["keys"]) for row in rows]])
    counts = np.concatenate([np.empty(0, np.int64), *[unpack(row["counts"], np.int64) for row in rows]])
    first = np.concatenate([np.empty(0, bool), *[unpack(row["first"], bool) for row in rows]])
    order = np.argsort(keys)
    return keys[order], counts[order], first[order]


def _look_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray, other) -> np.ndarray:
    if not len(known):
        return np.full(len(keys), other, dtype=values.dtype)
    place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[place] == keys, values[place], other)


_TEXTS = pa.schema([
    ("block", pa.string()), ("ids", pa.binary()), ("no_id", pa.binary()), ("texts", pa.binary()), ("lengths", pa.binary()),
])
_TEXTS_DDL = "block string, ids binary, no_id binary, texts binary, lengths binary"


def _texts(block_bytes: int):
    def rows(batches):
        for block in blocks_of(batches, block_bytes):
            ids = np.array([0 if i is None else i for i in block.ids], np.int64)
            missing = np.array([i is None for i in block.ids], np.bool_)
            yield block.name, pack(ids), pack(missing), *pack_texts(block.texts)

    return lambda batches: record_batches(rows(batches), _TEXTS, 1)


_RESULT = [
    ("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
    ("kept_sha256", pa.string()), ("kept", pa.binary()),
]
_RESULT_DDL = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_SECOND = pa.schema([
    *_RESULT, *_ASKED, ("ids", pa.binary()), ("no_id", pa.binary()), ("texts", pa.binary()), ("lengths", pa.binary()),
    ("repeated", pa.binary()), ("waiting", pa.binary()),
])
_SECOND_DDL = (
    f"{_RESULT_DDL}, {_ASKED_DDL}, ids binary, no_id binary, texts binary, lengths binary, repeated binary, waiting binary"
)


def _result(doc, text: bytes, marked: np.ndarray | None, keep_text: bool) -> tuple:
    if marked is None or not marked.any():
        kept, removed, spans = text, 0, 0
    else:
        kept = np.frombuffer(text, np.uint8)[~marked].tobytes()
        removed = int(marked.sum())
        spans = int(marked[0]) + int((marked[1:] & ~marked[:-1]).sum())
    return doc, len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None


def _row_table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _second_round(q: int, shards: int, keep_text: bool):
    def run(key: tuple[pa.Scalar, ...], blocks: pa.Table, answers: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            raise RuntimeError(f"block {key[0].as_py()} has changed between two scans; run the job again")
        row = blocks.to_pylist()[0]
        texts = unpack_texts(row["texts"], row["lengths"])
        missing = unpack(row["no_id"], np.bool_)
        ids = [None if none else i for i, none in zip(unpack(row["ids"], np.int64).tolist(), missing, strict=True)]
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = _ends(texts)
        first, last, anchors, wholes = runs(data, ends, q)
        known, counts, _ = _answers(answers, "anchor")
        sharing = _look_up(anchors, known, counts, 1)
        known, counts, firsts = _answers(answers, "run")
        alike = _look_up(wholes, known, counts, 1)
        repeated = alike > 1
        waiting = (sharing > 1) & ~repeated
        # One of several equal runs stands for all, where other runs have the same anchor.
        elected = repeated & (sharing != alike) & _look_up(wholes, known, firsts, False)
        places = np.flatnonzero(elected)
        elected[:] = False
        elected[places[np.unique(wholes[places], return_index=True)[1]]] = True

        rows: list[tuple] = []
        blank = (None,) * len(_SECOND)
        ask = waiting | elected
        if ask.any():
            _, refined = strings(data, _marked(len(data), first[ask], last[ask] + 1), q)
            for asked in _asked("string", row["block"], refined, shards):
                rows.append((*blank[:6], *asked, *blank[11:]))
        marked = _marked(len(data), first[repeated], last[repeated] + 2 * q)
        owner = np.searchsorted(ends, first, side="right")
        unfinished = np.zeros(len(texts), bool)
        unfinished[owner[waiting]] = True
        starts = ends - np.array([len(text) for text in texts], np.int64)
        for number in np.flatnonzero(~unfinished).tolist():
            own = marked[starts[number]:ends[number]]
            rows.append((*_result(ids[number], texts[number], own, keep_text), *blank[6:]))
        if unfinished.any():
            left = np.flatnonzero(unfinished)
            # positions in the joined texts of the documents left
            shift = np.zeros(len(texts), np.int64)
            shift[left] = np.cumsum([0, *[len(texts[i]) for i in left[:-1]]]) - starts[left]
            done = repeated & unfinished[owner]
            move = lambda at, of: at[of] + shift[owner[of]]
            rows.append((
                *blank[:8], row["block"], None, None,
                pack(np.array([ids[i] or 0 for i in left], np.int64)),
                pack(np.array([ids[i] is None for i in left], np.bool_)),
                *pack_texts([texts[i] for i in left]),
                pack(np.concatenate((move(first, done), move(last, done)))),
                pack(np.concatenate((move(first, waiting), move(last, waiting)))),
            ))
        return _row_table(rows, _SECOND)

    return run


def _last_round(q: int, keep_text: bool):
    schema = pa.schema(_RESULT)

    def run(key: tuple[pa.Scalar, ...], blocks: pa.Table, answers: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        for row in blocks.to_pylist():  # one, or none where only others wait for this block
            texts = unpack_texts(row["texts"], row["lengths"])
            missing = unpack(row["no_id"], np.bool_)
            ids = unpack(row["ids"], np.int64).tolist()
            data = np.frombuffer(b"".join(texts), np.uint8)
            first, last = unpack(row["repeated"], np.int64).reshape(2, -1)
            marked = _marked(len(data), first, last + 2 * q)
            first, last = unpack(row["waiting"], np.int64).reshape(2, -1)
            places, refined = strings(data, _marked(len(data), first, last + 1), q)
            known, counts, _ = _answers(answers, "string")
            found = places[_look_up(refined, known, counts, 1) > 1]
            marked |= _marked(len(data), found, found + 2 * q)
            at = 0
            for doc, none, text in zip(ids, missing, texts, strict=True):
                rows.append(_result(None if none else doc, text, marked[at:at + len(text)], keep_text))
                at += len(text)
        return _row_table(rows, schema)

    return run


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, keep_text: bool = False,
    block_bytes: int = BLOCK,
) -> DataFrame:
    """One row per document: ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    A byte goes if a string of ``length`` bytes (an even number) covers it that also starts
    anywhere else, in the same document or another; strings do not cross documents and are
    judged on the input. ``n_spans`` counts the maximal removed runs of a document,
    ``kept_sha256`` is the digest of the remaining bytes; with ``keep_text`` they are
    returned as ``kept``. A null text is empty; texts shorter than ``length`` lose nothing.
    Rows with equal ids are documents of their own, so their texts repeat. Extra columns
    are not read. ``docs`` has to be a stored table (see ``blocks``).

    Texts move once, compressed, and those of documents that reach the last round once
    more. Per shard there is at most one row of keys a block, so a string that a third of
    all documents hold is one key a block.
    """
    if length % 2 or length < 2:
        raise ValueError("length has to be an even number")
    q = length // 2
    shards = max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(
        F.col(id_col).cast("long"), F.col(text_col).cast("binary"), F.lit(None).cast("string").alias("key")
    )

    def several(asked: DataFrame) -> DataFrame:
        return asked.groupBy("kind", "shard").applyInArrow(_several, _SEVERAL_DDL)

    first = several(rows.mapInArrow(_first_round(q, shards, block_bytes), _ASKED_DDL))
    second = durable(
        rows.mapInArrow(_texts(block_bytes), _TEXTS_DDL).groupBy("block").cogroup(first.groupBy("block"))
        .applyInArrow(_second_round(q, shards, keep_text), _SECOND_DDL)
    )
    strings_asked = second.where("keys IS NOT NULL").select("kind", "shard", "block", "keys", "counts")
    last = (
        second.where("texts IS NOT NULL")
        .select("block", "ids", "no_id", "texts", "lengths", "repeated", "waiting")
        .groupBy("block").cogroup(several(strings_asked).groupBy("block"))
        .applyInArrow(_last_round(q, keep_text), _RESULT_DDL)
    )
    done = second.where("kept_sha256 IS NOT NULL").select("doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    return done.union(last).select(
        F.col("doc").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])
    )
