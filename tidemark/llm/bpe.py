"""Byte-level BPE: distinct words are encoded once for the whole corpus, ids come back and fall into place.

Texts are cut into pre-tokens. A block of texts keeps the positions of its distinct words as codes and sends each
distinct word, with its code, to the word's bucket. A bucket gets its words from all blocks and encodes each once.
The ids return to the block, and the codes are replaced by them in order. A frequent word is one entry per block, however
often it occurs, so no word is hot. Codes, words and ids travel packed and compressed, as rows per block and bucket.
Decoding joins the token-byte table, which has one row per vocabulary entry.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import handing_back

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Ids that are put in place together.
PLACE_IDS = 1 << 19

_ROWS = pa.schema([("goes_to", pa.int64()), ("block", pa.int64()), ("is_text", pa.bool_()), ("body", pa.binary())])
_ROWS_SQL = "goes_to long, block long, is_text boolean, body binary"
_encodings: dict[tuple[bytes, str], object] = {}


class Vocabulary:
    """Ranks of byte strings, read on the driver from a rank file and sent to the workers once. Its size is fixed."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        self.pattern, self.size = pattern, len(ranks)
        self._ranks = spark.sparkContext.broadcast(ranks)
        self._key = hashlib.sha256(repr(sorted(ranks.items())).encode()).digest()

    def encoder(self, whole: bool = False):
        """A function from one pre-token, or from a whole text, to its ids."""
        pattern = self.pattern if whole else "(?s).+"
        if (self._key, pattern) not in _encodings:
            import tiktoken

            made = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self._ranks.value, special_tokens={})
            _encodings[self._key, pattern] = made.encode_ordinary
        return _encodings[self._key, pattern]

    def token_bytes(self) -> pa.Array:
        """The token-byte table: entry i holds the bytes of id i, null where there is no such id."""
        table: list[bytes | None] = [None] * (max(self._ranks.value.values(), default=-1) + 1)
        for token, rank in self._ranks.value.items():
            table[rank] = token
        return pa.array(table, pa.binary())


class _Codes(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(body: pa.Buffer | bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(body).read_next_batch()


def _steps(codes: np.ndarray) -> pa.Array:
    """Ascending codes as the differences between them, two bytes each if that is enough."""
    step = np.diff(codes, prepend=0)
    return pa.array(step.astype(np.uint16 if step.max(initial=0) < 1 << 16 else np.uint32))


def _pretokens(pattern: str, key: str, text: str, buckets: int, texts: bool):
    """Rows of one block after another: its texts as codes (``texts``), or its distinct words by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall

        def block() -> pa.RecordBatch:
            flat = np.concatenate(held) if held else np.zeros(0, np.uint32)
            at = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64)
            # the more frequent a word, the smaller its code: most bytes but the lowest are then zero, and pack well
            order = np.argsort(-np.bincount(flat, minlength=len(codes)), kind="stable")
            code = np.empty(len(order), dtype="<u4")
            code[order] = np.arange(len(order))
            flat, words = code[flat], np.array(list(codes), dtype=object)[order]
            # the block's name: words never mix with texts that another attempt has cut otherwise; equal blocks share it
            mark = hashlib.blake2b(flat.tobytes(), digest_size=8)
            mark.update("\0".join(words).encode())
            name = int.from_bytes(mark.digest(), "little", signed=True)
            rows = []
            if texts:
                planes = np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4).T)
                parts = {"keys": _packed(pa.record_batch({"key": pa.concat_arrays(keys)})), "at": at.tobytes()}
                parts |= {f"byte{i}": x.tobytes() for i, x in enumerate(planes)}
                rows.append((name, name, True, _packed(pa.record_batch({k: pa.array([x], pa.binary()) for k, x in parts.items()}))))
            else:
                bucket = np.array([zlib.crc32(x.encode()) % buckets for x in words], dtype=np.int64)
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cut)).tolist():
                    part = order[cut[b]:cut[b + 1]]
                    pack = pa.record_batch({"step": _steps(part), "word": pa.array(words[part], pa.large_string())})
                    rows.append((b, name, False, _packed(pack)))
            if not rows:
                return pa.RecordBatch.from_pylist([], schema=_ROWS)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROWS, strict=True)], schema=_ROWS)

        held, keys, codes, size = [], [], _Codes(), 0
        for batch in batches:
            for i, t in enumerate(batch[text].to_pylist()):
                if size and size + len(t or "") > BLOCK_BYTES:
                    yield block()
                    held, keys, codes, size = [], [], _Codes(), 0
                held.append(np.fromiter(map(codes.__getitem__, find(t or "")), dtype=np.uint32))
                keys.append(batch[key].slice(i, 1))
                size += len(t or "")
        if keys:
            yield block()

    return run


def _encode_words(vocabulary: Vocabulary):
    """Replaces the words of a bucket by their ids, each distinct word encoded once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary.encoder()
        known: dict[str, list[int]] = {}
        for batch in batches:
            body = []
            for b in batch["body"]:
                rows = _unpacked(b.as_buffer())
                words = rows["word"].to_pylist()
                for w in words:
                    if w not in known:
                        known[w] = encode(w)
                ids = pa.array([known[w] for w in words], pa.list_(pa.int32()))
                body.append(_packed(pa.record_batch({"step": rows["step"], "ids": ids})))
            yield pa.RecordBatch.from_arrays([batch["goes_to"], batch["block"], batch["is_text"], pa.array(body, pa.binary())], schema=_ROWS)

    return run


def _place(key: str, kind: pa.DataType):
    """Texts of each block as ids. A block's words come before its texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, by_bucket = None, {}
        for batch in batches:
            for to, name, is_text, b in zip(*(batch[c].to_pylist() for c in ("goes_to", "block", "is_text")), batch["body"], strict=True):
                if name != block:
                    block, by_bucket = name, {}
                if not is_text:
                    by_bucket[to] = _unpacked(b.as_buffer())
                    continue
                parts = list(by_bucket.values())
                rows = _unpacked(b.as_buffer())
                code = np.concatenate([np.cumsum(p["step"].to_numpy(), dtype=np.int64) for p in parts]) if parts else np.zeros(0, np.int64)
                planes = [np.frombuffer(rows[f"byte{i}"][0].as_buffer(), dtype=np.uint8) for i in range(4)]
                codes = np.stack(planes, axis=1).reshape(-1).view("<u4")
                keys, at = _unpacked(rows["keys"][0].as_buffer())["key"], np.frombuffer(rows["at"][0].as_buffer(), dtype=np.int64)
                if len(code) != (int(codes.max()) + 1 if len(codes) else 0):
                    raise ValueError("a block's words are not complete: its texts changed between attempts")
                flat = np.concatenate([p["ids"].values.to_numpy() for p in parts]) if parts else np.zeros(0, np.int32)
                size = np.concatenate([p["ids"].value_lengths().to_numpy() for p in parts]) if parts else np.zeros(0, np.int64)
                first, length = np.empty(len(code), np.int64), np.empty(len(code), np.int64)
                first[code], length[code] = np.cumsum(size) - size, size
                ends = np.concatenate([[0], np.cumsum(length[codes])])[at]
                row = 0
                while row < len(keys):
                    stop = max(row + 1, int(np.searchsorted(ends, ends[row] + PLACE_IDS, side="right")) - 1)
                    c = codes[at[row]:at[stop]]
                    n = length[c]
                    ids = flat[np.repeat(first[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    lists = pa.ListArray.from_arrays(pa.array(ends[row:stop + 1] - ends[row], pa.int32()), pa.array(ids, pa.int32()))
                    yield pa.RecordBatch.from_arrays([keys.slice(row, stop - row).cast(kind), lists], [key, "ids"])
                    row = stop

    return run


def encode(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """``key, ids``: the token ids of each row's whole text, without special tokens; null texts and empty ones have none.

    Rows are kept one by one, also where keys repeat or are null; an empty table gives no rows; other columns are ignored.
    ``buckets`` is the session's number of shuffle partitions unless given.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(key, text)
    kind = pa_type(d.schema[key].dataType)
    # in a fixed order, as the texts are cut once for their words and once for their codes
    d = d.sortWithinPartitions(key, F.xxhash64(text))
    words, texts = (d.mapInArrow(handing_back(_pretokens(vocabulary.pattern, key, text, buckets, x)), _ROWS_SQL) for x in (False, True))
    ids = words.repartition(buckets, "goes_to").mapInArrow(handing_back(_encode_words(vocabulary)), _ROWS_SQL)
    placed = ids.unionByName(texts).repartition(buckets, "block").sortWithinPartitions("block", "is_text")
    out = T.StructType([T.StructField(key, d.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    return placed.mapInArrow(handing_back(_place(key, kind)), out)


def pa_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _joined(lists: pa.ListArray, table: pa.Array) -> pa.Array:
    at = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)[at[0]:at[-1]]
    fine = (flat >= 0) & (flat < len(table))
    tokens = table.take(pa.array(np.where(fine, flat, 0), pa.int64())) if len(table) else pa.nulls(len(flat), pa.large_binary())
    fine &= tokens.is_valid().to_numpy(zero_copy_only=False)
    bad = np.diff(np.concatenate([[0], np.cumsum(~fine)])[at - at[0]]) > 0
    edge = np.frombuffer(tokens.buffers()[1], dtype=np.int64)[at - at[0]] if len(flat) else np.zeros(len(at), np.int64)
    body = tokens.buffers()[2] or pa.py_buffer(b"")
    whole = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(edge.tobytes()), body])
    missing = pa.array(bad | lists.is_null().to_numpy(zero_copy_only=False))
    return pc.if_else(missing, pa.scalar(None, pa.large_binary()), whole).cast(pa.binary())


def decode(ids: Column, vocabulary: Vocabulary) -> Column:
    """The bytes of each list of ids, by a join with the token-byte table; null for null and for ids it doesn't have."""
    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = vocabulary.token_bytes().cast(pa.large_binary())
        for lists in batches:
            at, row = lists.offsets.to_numpy(), 0
            while row < len(lists):  # a bounded number of ids, or one list
                stop = max(row + 1, int(np.searchsorted(at, at[row] + PLACE_IDS, side="right")) - 1)
                yield _joined(lists.slice(row, stop - row), table)
                row = stop

    return run(ids)


def whole_texts(vocabulary: Vocabulary):
    """A function from texts to lists of ids, text by text on one worker, for users that need no shuffle of words."""
    def run(texts: pa.Array) -> pa.ListArray:
        ids = [encode(t) if t else [] for t in texts.to_pylist()]
        return pa.array(ids, pa.list_(pa.int32()))

    def encode(text: str) -> list[int]:
        return vocabulary.encoder(whole=True)(text)

    return run


def digests(encoded: DataFrame, vocabulary: Vocabulary, key: str = "doc_id") -> DataFrame:
    """Per row: number of ids, and the hashes of the ids as text and of the decoded bytes."""
    d = encoded.select(key, "ids", decode(F.col("ids"), vocabulary).alias("decoded"))
    return d.select(key, F.size("ids").cast("long").alias("n_tokens"),
                    F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                    F.sha2("decoded", 256).alias("decoded_sha256"))
