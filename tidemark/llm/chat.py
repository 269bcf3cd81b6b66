"""Chat formatting: schema fingerprints choose a mapping to canonical turns; a reversible template marks them."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import handing_back

#: The marks of the template.
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
LEARNED = "assistant"
#: Bytes of roles, texts and marks after which a long conversation is cut.
PIECE_BYTES = 1 << 16

TURNS = "array<struct<role:string,text:string>>"
SPANS = "array<struct<start:bigint,stop:bigint>>"


def paths(value: object, at: str = "") -> set[str]:
    """Nested field paths of a JSON value; items of a list share one path."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, at + "[]")} or {at + "[]"}
    return {at}


def fingerprint(field_paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(field_paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns: a list of objects, or one field per role, in order."""

    name: str
    items: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    def fingerprints(self) -> list[str]:
        if self.items:
            return [fingerprint({f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"}), fingerprint({f"{self.items}[]"})]
        return [fingerprint({f for _, f in self.fields})]

    def turns(self, record: dict) -> list[tuple[str, str]]:
        if self.items:
            found = [(m[self.role], m[self.text]) for m in record[self.items]]
        else:
            found = [(role, record[f]) for role, f in self.fields]
        return [(self.roles.get(r, r) or "", t or "") for r, t in found]


#: Field names of common layouts.
MAPPINGS = (
    Mapping("messages", "messages", "role", "content"),
    Mapping("from_value", "conversations", "from", "value", roles={"human": "user", "gpt": "assistant"}),
    Mapping("prompt", fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("instruction", fields=(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
)


def canonical(record: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """A struct of ``fingerprint``, ``layout`` and ``turns`` from JSON text.

    Null or broken JSON, and a fingerprint no mapping has, give null layout and turns; the row stays. Null roles and
    texts become empty.
    """
    known = {f: m for m in mappings for f in m.fingerprints()}

    def one(text: str | None) -> dict:
        try:
            value = json.loads(text) if text is not None else None
        except ValueError:
            value = None
        if value is None:
            return {"fingerprint": None, "layout": None, "turns": None}
        mark = fingerprint(paths(value))
        m = known.get(mark)
        return {"fingerprint": mark, "layout": m and m.name,
                "turns": [{"role": r, "text": t} for r, t in m.turns(value)] if m else None}

    kind = pa.struct([("fingerprint", pa.string()), ("layout", pa.string()),
                      ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])

    @F.arrow_udf(f"struct<fingerprint:string,layout:string,turns:{TURNS}>")
    def turns(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([one(t) for t in texts.to_pylist()], kind)

    return turns(record)


def escape(text: str) -> str:
    """No ``<|`` is left: a backslash more goes between the two characters, also where there are some already."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


def render(turns: list[dict]) -> tuple[str, list[dict]]:
    """The formatted conversation, and the spans of assistant texts in it, in code points."""
    parts, spans, at = [], [], 0
    for t in turns:
        head, body = f"{BEGIN}{_role_out(t['role'])}\n", escape(t["text"])
        if t["role"] == LEARNED:
            spans.append({"start": at + len(head), "stop": at + len(head) + len(body)})
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted conversation; the inverse of ``render``."""
    found = []
    for part in formatted.split(BEGIN)[1:]:
        role, _, text = part.partition("\n")
        if not text.endswith(END):
            raise ValueError("a turn has no end mark")
        found.append((_role_in(role), unescape(text[:-len(END)])))
    return found


def formatted(turns: Column) -> Column:
    """A struct of ``formatted`` (text) and ``loss`` (spans in code points); null turns give nulls."""
    kind = pa.struct([("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])

    @F.arrow_udf(f"struct<formatted:string,loss:{SPANS}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            made = [(None, None) if t is None else render(t) for t in rows.to_pylist()]
            yield pa.array([{"formatted": f, "loss": s} for f, s in made], kind)

    return run(turns)


def read_back(text: Column, loss: Column) -> Column:
    """A struct of ``turns`` and ``learned`` (all text under the mask, unescaped), from formatted text and its mask."""
    kind = pa.struct([("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("learned", pa.string())])

    def one(f: str | None, spans: list[dict] | None) -> dict:
        if f is None:
            return {"turns": None, "learned": None}
        return {"turns": [{"role": r, "text": t} for r, t in parse(f)],
                "learned": "".join(unescape(f[s["start"]:s["stop"]]) for s in spans or [])}

    @F.arrow_udf(f"struct<turns:{TURNS},learned:string>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, masks in batches:
            yield pa.array([one(f, s) for f, s in zip(texts.to_pylist(), masks.to_pylist(), strict=True)], kind)

    return run(text, loss)


def records(rows: DataFrame) -> DataFrame:
    """``conv_id, piece, record``: the rows of a conversation by turn as JSON in the layout that fits its roles.

    Rows without a turn come first; equal turns go by role and text; null roles and texts are empty. A conversation of
    more than three turns is cut between turns about every ``PIECE_BYTES``, so no row grows with it: its pieces are
    numbered upwards from 0 (numbers may be left out), have one layout and follow each other. All of them are in one partition.
    """
    turn = ("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    size = F.octet_length("role") + F.octet_length("text") + len(BEGIN + END)
    before = F.coalesce(F.sum(size.cast("long")).over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = rows.select("conv_id", *turn).select(
        "*", F.count("*").over(whole).alias("n"), F.min(F.col("role").isin("system", "user", "assistant")).over(whole).alias("plain"), before.alias("before"))
    d = d.withColumn("piece", F.when(F.col("n") <= 3, F.lit(0)).otherwise(F.floor(F.col("before") / PIECE_BYTES)).cast("long"))
    d = d.groupBy("conv_id", "piece", "n", "plain").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    roles, text = F.transform("t", lambda x: x["role"]), lambda i: F.col("t")[i]["text"]
    is_ = lambda *names: (F.col("n") == len(names)) & (roles == F.array(*map(F.lit, names)))
    speaker = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    record = (F.when(is_("user", "assistant"), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("completion"))))
              .when(is_("system", "user", "assistant"),
                    F.to_json(F.struct(text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output"))))
              .when(F.col("plain") & (F.col("conv_id") % 2 == 1), F.to_json(F.struct(F.transform(
                  "t", lambda x: F.struct(speaker(x["role"]).alias("from"), x["text"].alias("value"))).alias("conversations"))))
              .otherwise(F.to_json(F.struct(F.transform(
                  "t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))))
    return d.select("conv_id", "piece", record.alias("record"))


def digests(pieces: DataFrame) -> DataFrame:
    """One row per conversation from ``conv_id, piece, turns, learned, formatted``, the pieces of a conversation in one partition.

    A hash runs over the pieces in order, so a task holds one batch of them, however long the conversation is; a hash
    cannot be dealt out, so a conversation does go through one task.
    """
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    d = pieces.select("conv_id", "piece", F.size("turns").cast("long").alias("n_turns"), F.concat_ws("", lines).cast("binary").alias("lines"),
                      F.length("learned").cast("long").alias("loss_chars"), F.col("learned").cast("binary").alias("learned"),
                      F.length("formatted").cast("long").alias("formatted_chars")).sortWithinPartitions("conv_id", "piece")
    conv_type = pieces.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, -1
        kind = None

        def rows(done: list[list]) -> pa.RecordBatch:
            made = [[c, n, said.hexdigest(), chars, loss.hexdigest(), size] for c, n, said, chars, loss, size in done]
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*made, strict=True), kind, strict=True)], names)

        for batch in batches:
            kind = kind or [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            done = []
            for i in range(batch.num_rows):
                conv, piece, n, said, chars, learned, size = (c[i].as_py() for c in batch.columns)
                if now is None or conv != now[0]:
                    if now is not None:
                        done.append(now)
                    now, last = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0], -1
                if (piece == 0) != (last < 0) or piece <= last:
                    raise ValueError(f"the pieces of conversation {conv} are not together")
                now[1] += n
                now[2].update(said)
                now[3] += chars
                now[4].update(learned)
                now[5] += size
                last = piece
            if done:
                yield rows(done)
        if now is not None:
            yield rows([now])

    return d.mapInArrow(run, f"conv_id {conv_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
