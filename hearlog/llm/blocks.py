"""Documents in blocks, and questions that blocks put to a table too large to send to them.

A block is a run of neighbouring documents of one stored table. A block asks each distinct
key once. Keys are dealt to shards, a shard answers all blocks' questions about its keys,
and the answers meet the block again. So what moves are the distinct keys of blocks, packed
into arrays, and the texts at most once more, compressed.

Blocks are formed twice from the same scan. They come out alike because a task reads its
rows of a stored table in the same order whenever it runs; should that ever fail, the
block's name, which holds a digest of its texts, finds no answers and the job stops.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

from hearlog.llm.common import BLOCK_BYTES

_ZSTD = pa.Codec("zstd")


@dataclass
class Block:
    name: str
    key: str | None
    ids: list = field(default_factory=list)
    texts: list[bytes] = field(default_factory=list)


def blocks_of(batches: Iterator[pa.RecordBatch], block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of the task's rows ``(id, text as binary, key)``; a block has rows of one key.

    A null text is empty. A document is never split, so a longer one is a block by itself.
    """
    task = TaskContext.get().partitionId()
    open_blocks: dict[str | None, tuple[Block, int]] = {}
    made = 0

    def named(block: Block, number: int) -> Block:
        digest = 0
        for text in block.texts:
            digest = zlib.crc32(text, digest)
        block.name = f"{task}-{number}-{len(block.ids)}-{digest:08x}"
        return block

    for batch in batches:
        for doc, text, key in zip(*[batch.column(i) for i in range(3)], strict=True):
            key, text = key.as_py(), text.as_py() or b""
            block, size = open_blocks.pop(key, None) or (Block("", key), 0)
            if block.ids and size + len(text) > block_bytes:
                yield named(block, made)
                made += 1
                block, size = Block("", key), 0
            block.ids.append(doc.as_py())
            block.texts.append(text)
            open_blocks[key] = block, size + len(text)
    for block, _ in open_blocks.values():
        yield named(block, made)
        made += 1


def _packed(raw: bytes) -> bytes:
    """Compressed behind its length; a few bytes, which would only grow, behind a zero."""
    if len(raw) < 256:
        return b"\0" + raw
    return b"\1" + len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _unpacked(data: bytes) -> bytes:
    if data[0] == 0:
        return data[1:]
    size = int.from_bytes(data[1:9], "little")
    return _ZSTD.decompress(data[9:], decompressed_size=size, asbytes=True)


def pack(array: np.ndarray) -> bytes:
    """An array as bytes, compressed if that pays."""
    return _packed(np.ascontiguousarray(array).tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(_unpacked(data), dtype=dtype)


def pack_sorted(array: np.ndarray) -> bytes:
    """An ascending uint64 array, as differences cut into planes of equal bytes."""
    steps = np.diff(array, prepend=np.uint64(0)).astype("<u8")
    return pack(steps.view(np.uint8).reshape(-1, 8).T)


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = unpack(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_texts(texts: list[bytes]) -> tuple[bytes, bytes]:
    """Texts in one compressed piece, and their lengths."""
    return _packed(b"".join(texts)), pack(np.array([len(text) for text in texts], dtype=np.int64))


def unpack_texts(data: bytes, lengths: bytes) -> list[bytes]:
    raw = _unpacked(data)
    ends = np.cumsum(unpack(lengths, np.int64)).tolist()
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def mix(values: np.ndarray) -> np.ndarray:
    """Spreads uint64 values over all 64 bits (an invertible finaliser)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def by_shard(keys: np.ndarray, shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places of its keys) for ascending keys; the places ascend as well."""
    if not len(keys):
        return
    order = np.argsort(shard, kind="stable")
    numbers, starts = np.unique(shard[order], return_index=True)
    for number, places in zip(numbers.tolist(), np.split(order, starts[1:]), strict=True):
        yield number, places
