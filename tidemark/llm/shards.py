"""Training order on disk: every sequence gets a global slot by a keyed permutation, shards hold slots at a fixed stride.

Token lists are laid end to end, an end mark after each, and cut into sequences of one length. They are made once and kept packed in the
shared folder; counts per partition give every sequence an index without gaps. A Feistel network permutes
the indices; cycle-walking keeps it within their number. Slot s lies in shard ``s // slots_per_shard`` at a byte position
that follows from s alone, so a reader can begin anywhere and read on.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import staged, written

from .words import mix

ROUNDS = 6


def round_keys(key: str) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(f"{key}/{r}".encode(), digest_size=8).digest(), "little") for r in range(ROUNDS)]


def permute(index: np.ndarray, size: int, key: str) -> np.ndarray:
    """The slots of ``index`` in a keyed permutation of 0 .. size - 1."""
    half = np.uint64(max(1, ((size - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, keys = index.astype(np.uint64), [np.uint64(k) for k in round_keys(key)]
    walking = np.arange(len(x))
    while len(walking):
        left, right = x[walking] >> half, x[walking] & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        x[walking] = left << half | right
        walking = walking[x[walking] >= size]
    return x.astype(np.int64)


@dataclass(frozen=True)
class Layout:
    """Ids per sequence, sequences per shard, bytes per id, and the ids that end a list and fill the last sequence."""

    length: int = 2048
    slots_per_shard: int = 4096
    dtype: str = "<u2"
    end_id: int = 50256
    fill_id: int = 50256

    @property
    def stride(self) -> int:
        return self.length * np.dtype(self.dtype).itemsize

    def place(self, slot: int) -> tuple[int, int]:
        """Shard and byte position of a slot."""
        return slot // self.slots_per_shard, slot % self.slots_per_shard * self.stride


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _sequences(tokens: Callable[[pa.Array], pa.ListArray], layout: Layout, key: str, text: str):
    """Yields ``(sequence, key of the list it begins in, ids that are not filling)`` of one partition, in order."""
    def run(batches: Iterator[pa.RecordBatch]):
        rest, rest_key = np.zeros(0, layout.dtype), None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists, keys = tokens(part[text]), part[key].to_pylist()
                offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
                for i, name in enumerate(keys):
                    ids = flat[offsets[i]:offsets[i + 1]]
                    if not len(ids):
                        continue
                    if ids.min() < 0 or ids.max() > np.iinfo(layout.dtype).max:
                        raise ValueError("an id does not fit the layout")
                    whole = np.concatenate([rest, ids.astype(layout.dtype), np.array([layout.end_id], layout.dtype)])
                    begin = rest_key if len(rest) else name
                    full = len(whole) // layout.length
                    for j in range(full):
                        yield whole[j * layout.length:(j + 1) * layout.length], (begin if j == 0 else name), layout.length
                    rest, rest_key = whole[full * layout.length:], (name if full or not len(rest) else rest_key)
        if len(rest):
            fill = np.full(layout.length - len(rest), layout.fill_id, layout.dtype)
            yield np.concatenate([rest, fill]), rest_key, len(rest)

    return run


#: Sequences that are packed together before they have their slots.
GROUP = 256
_GROUP = "part int, start long, first_key array<string>, n_ids array<long>, body binary"


def write_shards(docs: DataFrame, tokens: Callable[[pa.Array], pa.ListArray], path: str, layout: Layout = Layout(), seed: str = "order",
                 key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the sequences of all rows below ``path``; returns ``slot, shard, position, first_key, n_ids``, a row per sequence.

    ``tokens`` makes lists of ids from a column, batch by batch, once; null and empty lists give nothing. Repeated rows and rows
    with equal keys are written as often as they come; other columns are ignored, whatever their names. An empty table writes nothing. A shard appears
    whole, under its name, by a rename; a repeated task writes the same bytes and leaves no other file.
    """
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    cut = _sequences(tokens, layout, "key", "text")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, held, pack = TaskContext.get().partitionId(), 0, [], zstandard.ZstdCompressor(3).compress

        def group() -> pa.RecordBatch:
            ids, keys, used = zip(*held)
            return pa.record_batch({"part": pa.array([part], pa.int32()), "start": pa.array([start], pa.int64()),
                                    "first_key": pa.array([[None if k is None else str(k) for k in keys]], pa.list_(pa.string())),
                                    "n_ids": pa.array([list(used)], pa.list_(pa.int64())), "body": pa.array([pack(np.concatenate(ids).tobytes())], pa.binary())})

        for x in cut(batches):
            held.append(x)
            if len(held) == GROUP:
                yield group()
                start += len(held)
                held.clear()
        if held:
            yield group()

    with written(d.mapInArrow(packed, _GROUP)) as groups:
        # two numbers per partition
        counted = sorted(tuple(r) for r in groups.groupBy("part").agg(F.sum(F.size("n_ids"))).collect())
        first = dict(zip((p for p, _ in counted), np.concatenate([[0], np.cumsum([n for _, n in counted])]).tolist()))
        total = sum(n for _, n in counted)
        return _dealt(groups, path, layout, seed, first, total)


def _dealt(groups: DataFrame, path: str, layout: Layout, seed: str, first: dict[int, int], total: int) -> DataFrame:
    shards = -(-total // layout.slots_per_shard)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(3).compress, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in batch.to_pylist():
                whole, n = unpack(row["body"]), len(row["n_ids"])
                slots = permute(np.arange(n) + first[row["part"]] + row["start"], total, seed)
                body = [pack(whole[i * layout.stride:(i + 1) * layout.stride]) for i in range(n)]
                yield pa.record_batch({"slot": pa.array(slots), "shard": pa.array((slots // layout.slots_per_shard).astype(np.int32)),
                                       "first_key": pa.array(row["first_key"], pa.string()), "n_ids": pa.array(row["n_ids"], pa.int64()),
                                       "body": pa.array(body, pa.binary())})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        open_, shard, temporary, unpack = None, None, "", zstandard.ZstdDecompressor().decompress

        def close():
            open_.close()
            final = f"{root}/{shard_name(shard)}"
            if store.get_file_info(final).type == fs.FileType.NotFound:
                store.move(temporary, final)
            else:  # an attempt before this one wrote the same bytes
                store.delete_file(temporary)

        try:
            for batch in batches:
                numbers, slots = batch["shard"].to_pylist(), batch["slot"].to_pylist()
                for n, slot, body in zip(numbers, slots, batch["body"].to_pylist(), strict=True):
                    if n != shard:
                        if open_:
                            close()
                        shard, temporary = n, f"{root}/.{shard_name(n)}-{uuid.uuid4().hex}"
                        open_ = store.open_output_stream(temporary)
                    if open_.tell() != layout.place(slot)[1]:
                        raise ValueError("a slot is missing")
                    open_.write(unpack(body))
                at = np.array(slots, dtype=np.int64) % layout.slots_per_shard * layout.stride
                yield pa.record_batch({"slot": batch["slot"], "shard": batch["shard"], "position": pa.array(at), "first_key": batch["first_key"], "n_ids": batch["n_ids"]})
            if open_:
                close()
        except BaseException:
            if open_ and store.get_file_info(temporary).type != fs.FileType.NotFound:
                store.delete_file(temporary)
            raise

    if total:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root)
    sequences = groups.mapInArrow(number, "slot long, shard int, first_key string, n_ids long, body binary")
    dealt = sequences.repartitionById(max(1, shards), "shard").sortWithinPartitions("slot")
    return staged(dealt.mapInArrow(write, "slot long, shard int, position long, first_key string, n_ids long"))


def read_slots(path: str, layout: Layout, start: int, stop: int) -> Iterator[np.ndarray]:
    """The sequences of slots ``start`` to ``stop - 1``, each shard read forward from its first wanted one."""
    store, root = fs.FileSystem.from_uri(path)
    while start < stop:
        shard, position = layout.place(start)
        n = min(stop - start, layout.slots_per_shard - start % layout.slots_per_shard)
        with store.open_input_file(f"{root}/{shard_name(shard)}") as f:
            f.seek(position)
            for _ in range(n):
                yield np.frombuffer(f.read(layout.stride), dtype=layout.dtype)
        start += n


def stored(slot: Column, path: str, layout: Layout) -> Column:
    """The bytes of a slot, read from its shard; runs of neighbouring slots are read in one go."""
    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for slots in batches:
            values = slots.to_numpy()
            runs = np.split(values, np.flatnonzero(np.diff(values) != 1) + 1) if len(values) else []
            yield pa.array([s.tobytes() for r in runs for s in read_slots(path, layout, int(r[0]), int(r[-1]) + 1)], pa.binary())

    return run(slot)
