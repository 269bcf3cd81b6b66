"""Alignment of two tokenizers: where tokens of both end together, and which ids that links across the corpus.

Each text is encoded by both tokenizers. Two dictionaries give the token that ends at a byte; the ends both have, sorted, cut
the two lists of ids into groups, and the last tokens of a group are linked. A block of texts is written once, packed, with a row
for each distinct pair of linked ids and its number of links. These rows are summed over the corpus, compared with
the highest count of their second id, and return to the block, where each link finds its count. A frequent pair
is one row per block, however often it occurs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import scratch_path

from .bpe import _packed, _unpacked, pa_type

#: Characters of text in a block; a longer text is a block of its own.
BLOCK_CHARS = 4 << 20
#: Characters that are encoded together; a longer text is encoded by itself.
ENCODE_CHARS = 1 << 18
#: Bytes of a text whose token ends are in the dictionaries at a time.
ENDS_BYTES = 1 << 20
#: Tokens that leave a task together.
OUT_TOKENS = 1 << 20

_ROWS = pa.schema([("block", pa.int64()), ("pair", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])
_PLACED = pa.schema([("block", pa.int64()), ("pair", pa.int64()), ("n", pa.int64()), ("best", pa.bool_()), ("body", pa.binary())])
_loaded: dict[bytes, tuple] = {}


def byte_level_table(vocabulary: dict[str, int]) -> list[bytes]:
    """Bytes per id of a byte-level vocabulary: bytes that print stand for themselves, the others follow from 256 on in order."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters = {chr(b): b for b in prints}
    letters |= {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in prints)}
    table = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        table[i] = bytes(letters[c] for c in token)
    return table


def piece_table(pieces: list[str]) -> list[bytes]:
    """Bytes per id of a vocabulary of pieces with byte fallback: U+2581 is a space, <0xHH> the byte HH."""
    def one(p: str) -> bytes:
        if len(p) == 6 and p.startswith("<0x") and p.endswith(">"):
            return bytes([int(p[3:5], 16)])
        return p.replace("▁", " ").encode()

    return [one(p) for p in pieces]


#: Fixed value: how a byte-level pre-tokenizer with its own pattern cuts a text.
BYTE_LEVEL_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_level_encoder(text: str):
    """An encoder of texts into ids without special tokens, and the vocabulary, from a tokenizer's json.

    A plain byte-level BPE whose merges make its ids in order is one of ranks: tiktoken then gives the same ids at a quarter of the time.
    """
    import tokenizers

    whole = tokenizers.Tokenizer.from_str(text)
    whole.encode_special_tokens = True
    vocabulary, spec = whole.get_vocab(with_added_tokens=True), json.loads(text)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (model.get("type") == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
             and not spec.get("normalizer") and not model.get("ignore_merges") and not model.get("dropout")
             and not any(model.get(x) for x in ("continuing_subword_prefix", "end_of_word_suffix")))
    added = {t["content"] for t in spec.get("added_tokens") or []}
    if plain and all(t.get("special") for t in spec.get("added_tokens") or []):
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        table = byte_level_table({t: i for t, i in model["vocab"].items() if t not in added})
        if made == sorted(made) and len(made) == len(set(made)) and len(made) + 256 == len([t for t in table if t]):
            import tiktoken

            ranks = {t: i for i, t in enumerate(table) if t}
            own = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
            return (lambda texts: [own.encode_to_numpy(t, disallowed_special=()) for t in texts]), vocabulary
    return (lambda texts: [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]), vocabulary


class Tokenizers:
    """A byte-level BPE as json (A) and a sentencepiece model (B), read on the driver and sent to the workers once."""

    def __init__(self, spark: SparkSession, byte_level: str, pieces: str):
        with open(byte_level, "rb") as f, open(pieces, "rb") as g:
            files = f.read(), g.read()
        self._files = spark.sparkContext.broadcast(files)
        self._key = hashlib.sha256(b"".join(hashlib.sha256(x).digest() for x in files)).digest()

    def load(self):
        """Both encoders, from texts to lists of ids, and both tables of token bytes. A encodes a space and the text; B adds it itself."""
        if self._key not in _loaded:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            import sentencepiece

            a, b = self._files.value
            encode, vocabulary = byte_level_encoder(a.decode())
            second = sentencepiece.SentencePieceProcessor(model_proto=b)
            tables = (pa.array(t, pa.large_binary()) for t in (
                byte_level_table(vocabulary), piece_table([second.id_to_piece(i) for i in range(second.get_piece_size())])))
            _loaded[self._key] = (lambda texts: encode([" " + t for t in texts]), lambda texts: second.encode(texts, num_threads=1), *tables)
        return _loaded[self._key]


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of two ascending lists of cumulative ends, the places in each of the ends both have."""
    in_a, in_b, low = [], [], 0
    top = int(max(a[-1], b[-1])) if len(a) and len(b) else 0
    while low < top:  # equal ends lie in the same stretch of bytes
        i, j = (np.searchsorted(x, [low, low + ENDS_BYTES], side="right") for x in (a, b))
        first = dict(zip(a[i[0]:i[1]].tolist(), range(i[0], i[1])))
        second = dict(zip(b[j[0]:j[1]].tolist(), range(j[0], j[1])))
        both = sorted(first.keys() & second.keys())
        in_a += map(first.__getitem__, both)
        in_b += map(second.__getitem__, both)
        low += ENDS_BYTES
    return np.array(in_a, np.int64), np.array(in_b, np.int64)


def _least(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the smallest type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


class _Side:
    """Ids of texts by one tokenizer, and where in the joined token bytes they end."""

    def __init__(self, ids: list, table: pa.Array):
        self.ids = np.concatenate([np.asarray(x, dtype=np.int64) for x in ids])
        self.at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        tokens = table.take(pa.array(self.ids))
        self.ends = np.frombuffer(tokens.buffers()[1], np.int64)[1:len(self.ids) + 1] if len(self.ids) else np.zeros(0, np.int64)
        self.bytes = memoryview(tokens.buffers()[2] or b"").cast("B")
        self.edge = np.append(0, self.ends)[self.at]

    def spells(self, i: int, text: bytes) -> bool:
        return self.bytes[self.edge[i]:self.edge[i + 1]] == text

    def text(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.at[i], self.at[i + 1])
        return self.ids[at], self.ends[at] - self.edge[i]


def _align(texts: list[str], loaded) -> list[tuple[np.ndarray, ...]]:
    """Per text its ids by A and by B and how many of each make a group; all empty where a tokenizer's bytes are not the text's."""
    encode_a, encode_b, table_a, table_b = loaded
    a, b = _Side(encode_a(texts), table_a), _Side(encode_b(texts), table_b)
    out = []
    for i, t in enumerate(texts):
        whole = b" " + t.encode()
        if a.spells(i, whole) and b.spells(i, whole):
            (ids_a, ends_a), (ids_b, ends_b) = a.text(i), b.text(i)
            last_a, last_b = common_ends(ends_a, ends_b)
            out.append((ids_a, ids_b, np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)))
        else:
            out.append((np.zeros(0, np.int64),) * 4)
    return out


_NAMES = ("a_ids", "b_ids", "a_group", "b_group")


def _links(ids_a: np.ndarray, ids_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The linked pair of each group: its last tokens. Group sizes add up to the ids, so texts may follow one another."""
    return ids_a[np.cumsum(size_a) - 1] << 32 | ids_b[np.cumsum(size_b) - 1]


def _blocks(tokenizers: Tokenizers, key: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = tokenizers.load()
        empty = (np.zeros(0, np.int64),) * 4
        # the rows are written once, so a number per task tells blocks apart
        name = TaskContext.get().partitionId() << 32
        keys, done, waiting, chars, size = [], [], [], 0, 0

        def encode() -> None:
            nonlocal chars
            if waiting:
                for (i, _), x in zip(waiting, _align([t for _, t in waiting], loaded), strict=True):
                    done[i] = x
            waiting.clear()
            chars = 0

        def block() -> Iterator[pa.RecordBatch]:
            encode()
            flat = [np.concatenate(x) for x in zip(*done)]
            lengths = [np.array([len(x) for x in part]) for part in zip(*done)]
            columns = {n: _least(x) for n, x in zip(_NAMES, flat)} | {f"n_{n}": _least(x) for n, x in zip(_NAMES, lengths)}
            pairs, n = np.unique(_links(*flat), return_counts=True)
            for i in range(0, len(pairs), 1 << 16):
                part = slice(i, i + (1 << 16))
                size = len(pairs[part])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, name)), pa.array(pairs[part]), pa.array(n[part]),
                                                  pa.nulls(size, pa.binary())], schema=_ROWS)
            packs = {k: pa.array([x.tobytes()], pa.large_binary()) for k, x in columns.items()}
            packs |= {f"t_{k}": pa.array([x.dtype.str]) for k, x in columns.items()}
            body = _packed(pa.record_batch({"keys": pa.array([_packed(pa.record_batch({"key": pa.concat_arrays(keys)}))], pa.large_binary()), **packs}))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([body], pa.binary())], schema=_ROWS)

        for batch in batches:
            for i, t in enumerate(batch[text].to_pylist()):
                n = len(t or "")
                if keys and size + n > BLOCK_CHARS:
                    yield from block()
                    keys, done, size, name = [], [], 0, name + 1
                if chars + n > ENCODE_CHARS:
                    encode()
                keys.append(batch[key].slice(i, 1))
                done.append(empty)
                if t:
                    waiting.append((len(done) - 1, t))
                    chars += n
                size += n
        if keys:
            yield from block()

    return run


def _placed(key: str, kind: pa.DataType, finish):
    """Texts of each block with the counts of their links. A block's pairs come before its texts, in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, pairs, counts, best = None, [], [], []
        for batch in batches:
            name = batch["block"].to_numpy()
            texts = np.flatnonzero(batch["pair"].is_null().to_numpy(zero_copy_only=False))
            at = 0
            for stop in [*texts.tolist(), len(name)]:
                if stop > at:
                    if name[at] != block:
                        block, pairs, counts, best = name[at], [], [], []
                    part = batch.slice(at, stop - at)
                    pairs.append(part["pair"].to_numpy())
                    counts.append(part["n"].to_numpy())
                    best.append(part["best"].to_numpy(zero_copy_only=False))
                if stop < len(name):
                    known = [np.concatenate(x) if x and name[stop] == block else np.zeros(0, np.int64) for x in (pairs, counts, best)]
                    yield from _texts(batch["body"][stop].as_buffer(), *known, key, kind, finish)
                    block, pairs, counts, best = None, [], [], []
                at = stop + 1

    return run


def _texts(body, pairs, counts, best, key: str, kind: pa.DataType, finish) -> Iterator[pa.RecordBatch]:
    pack = _unpacked(body)
    keys = _unpacked(pack["keys"][0].as_buffer())["key"]
    get = {k: np.frombuffer(pack[k][0].as_buffer(), pack[f"t_{k}"][0].as_py()).astype(np.int64) for n in _NAMES for k in (n, f"n_{n}")}
    at = {n: np.concatenate([[0], np.cumsum(get[f"n_{n}"])]) for n in _NAMES}
    row = 0
    while row < len(keys):
        stop = max(row + 1, int(np.searchsorted(at["a_ids"], at["a_ids"][row] + OUT_TOKENS, side="right")) - 1)
        part = {n: get[n][at[n][row]:at[n][stop]] for n in _NAMES}
        cut = {n: at[n][row:stop + 1] - at[n][row] for n in _NAMES}
        linked = np.searchsorted(pairs, _links(*(part[n] for n in _NAMES)))
        sums = [np.append(0, np.cumsum(x[linked])) for x in (best, counts)]
        n_links = np.diff(cut["a_group"])
        n_best, count_sum = (np.diff(s[cut["a_group"]]) for s in sums)
        columns = {key: keys.slice(row, stop - row).cast(kind)} | finish(part, cut)
        columns |= {n: pa.array(x.astype(np.int64)) for n, x in (("n_groups", n_links), ("n_links", n_links), ("n_best", n_best), ("count_sum", count_sum))}
        yield pa.record_batch(columns)
        row = stop


def _lists(part: dict[str, np.ndarray], cut: dict[str, np.ndarray]) -> dict[str, pa.Array]:
    return {n: pa.ListArray.from_arrays(pa.array(cut[n], pa.int32()), pa.array(part[n], pa.int32())) for n in _NAMES}


def _hashes():
    tables: dict[str, pa.Array] = {}

    def table(top: int, ends: tuple[str, ...]) -> pa.Array:
        return pa.array([f"{i}{e}" for e in ends for i in range(top)], pa.large_string())

    def finish(part: dict[str, np.ndarray], cut: dict[str, np.ndarray]) -> dict[str, pa.Array]:
        """Number of ids, and the hash of each text's groups as text: ids of A, a bar, ids of B, a semicolon between groups."""
        rows = len(cut["a_ids"]) - 1
        size_a, size_b = part["a_group"], part["b_group"]
        top = int(max(part["a_ids"].max(initial=-1), part["b_ids"].max(initial=-1))) + 1
        if "all" not in tables or len(tables["all"]) < 4 * top:
            tables["all"] = table(top, (",", "|", ";", ""))
        strings = tables["all"]
        top = len(strings) // 4
        begin = np.cumsum(size_a + size_b) - (size_a + size_b)
        place = np.empty(len(part["a_ids"]) + len(part["b_ids"]), np.int64)
        last = np.cumsum(size_a) - 1
        which = part["a_ids"].copy()
        which[last] += top
        place[np.repeat(begin - (last + 1 - size_a), size_a) + np.arange(len(which))] = which
        last = np.cumsum(size_b) - 1
        which = part["b_ids"].copy()
        which[last] += 2 * top
        ends = cut["b_ids"][1:][np.diff(cut["b_ids"]) > 0] - 1
        which[ends] += top
        place[np.repeat(begin + size_a - (last + 1 - size_b), size_b) + np.arange(len(which))] = which
        tokens = strings.take(pa.array(place))
        edge = np.frombuffer(tokens.buffers()[1], np.int64)[:len(place) + 1] if len(place) else np.zeros(1, np.int64)
        edge = edge[cut["a_ids"] + cut["b_ids"]].tolist()
        body = memoryview(tokens.buffers()[2] or b"")
        hashes = [hashlib.sha256(body[edge[i]:edge[i + 1]]).hexdigest() if edge[i + 1] > edge[i] else "" for i in range(rows)]
        return {"n_a": pa.array(np.diff(cut["a_ids"])), "n_b": pa.array(np.diff(cut["b_ids"])), "groups_sha256": pa.array(hashes, pa.string())}

    return finish


def _aligned(docs: DataFrame, tokenizers: Tokenizers, key: str, text: str, finish, fields: list[T.StructField]) -> DataFrame:
    spark = docs.sparkSession
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    path = scratch_path(spark, "aligned")
    d.mapInArrow(_blocks(tokenizers, "key", "text"), "block long, pair long, n long, body binary").write.parquet(path, compression="none")
    rows = spark.read.schema("block long, pair long, n long, body binary").parquet(path)
    pairs = rows.where("pair is not null").select("block", "pair", "n")
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    second = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    top = counts.groupBy(second.alias("b")).agg(F.max("n").alias("top"))
    counts = counts.join(top, second == F.col("b")).select(F.col("pair").alias("p"), F.col("n").alias("count"), (F.col("n") == F.col("top")).alias("best"))
    known = pairs.join(counts, F.col("pair") == F.col("p")).select("block", "pair", F.col("count").alias("n"), "best", F.lit(None).cast("binary").alias("body"))
    bodies = rows.where("pair is null").select("block", "pair", "n", F.lit(None).cast("boolean").alias("best"), "body")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = known.unionByName(bodies).repartition(parts, "block").sortWithinPartitions("block", F.col("pair").asc_nulls_last())
    kind = docs.schema[key].dataType
    long = [T.StructField(n, T.LongType()) for n in ("n_groups", "n_links", "n_best", "count_sum")]
    out = placed.mapInArrow(_placed("key", pa_type(kind), finish), T.StructType([T.StructField("key", kind), *fields, *long]))
    return out.withColumnRenamed("key", key)


def align(docs: DataFrame, tokenizers: Tokenizers, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``key``, the ids ``a_ids`` and ``b_ids``, how many of each make a group (``a_group``, ``b_group``),
    and n_groups, n_links, n_best, count_sum.

    A link's count is the number of links of its two ids in the whole corpus; it is best if no other id of A is linked with its
    id of B more often. Null and empty texts, and texts that a tokenizer's token bytes do not spell, have no ids and zeros.
    Rows are kept one by one, also where keys repeat or are null; an empty table gives no rows; other columns are ignored.
    Runs a job when called: the blocks are written below the shared folder.
    """
    fields = [T.StructField(n, T.ArrayType(T.IntegerType(), False)) for n in _NAMES]
    return _aligned(docs, tokenizers, key, text, _lists, fields)


def digests(docs: DataFrame, tokenizers: Tokenizers, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``align`` with n_a, n_b and the hash of the groups' text in place of ids and groups."""
    fields = [T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()), T.StructField("groups_sha256", T.StringType())]
    return _aligned(docs, tokenizers, key, text, _hashes(), fields)
