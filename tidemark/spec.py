"""What to synchronise: modes, keys, field mapping. Small driver-side configuration only."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from enum import IntEnum
from typing import Any


class SyncMode(IntEnum):
    MERGE = 1
    INSERT_ONLY = 2
    CLEAN_INSERT = 3

    @classmethod
    def of(cls, code: int | None) -> SyncMode:
        """Unknown and missing codes mean MERGE."""
        try:
            return cls(code)
        except ValueError:
            return cls.MERGE


class RunStatus(IntEnum):
    RUNNING = 1
    SUCCESS = 2
    FAILED = 3


@dataclass(frozen=True)
class MappedField:
    source: str
    target: str
    is_key: bool = False


def parse_mapping(text: str | None) -> list[MappedField]:
    """A JSON object ``{"SRC": "TGT"}`` or an array of ``{srcField, tgtField, isPk}``; blank means identity."""
    if not text or not text.strip():
        return []
    data = json.loads(text)
    if isinstance(data, dict):
        return [MappedField(s, t) for s, t in data.items() if s and t]
    return [MappedField(i["srcField"], i["tgtField"], bool(i.get("isPk")))
            for i in data if i.get("srcField") and i.get("tgtField")]


def parse_keys(text: str | None) -> list[str]:
    return [k.strip() for k in (text or "").split(",") if k.strip()]


# Name patterns of a key column and of a reference to another table.
KEY_NAME = re.compile(r"\bid$", re.IGNORECASE)
REFERENCE_NAME = re.compile(r"^\w*_?(fk|ref|parent|up)\w*$", re.IGNORECASE)


def looks_like_key(name: str) -> bool:
    return bool(KEY_NAME.search(name)) and not REFERENCE_NAME.search(name)


@dataclass(frozen=True)
class SyncSpec:
    """One source-to-target task."""
    task_id: str
    keys: tuple[str, ...] = ()
    marker: str | None = None
    mapping: tuple[MappedField, ...] = ()
    where: str | None = None
    mode: SyncMode = SyncMode.MERGE
    no_update: bool = False
    order: tuple[str, ...] = field(default=())
    rows_per_batch: int = 2000
    task_name: str | None = None

    def __post_init__(self):
        keys = self.keys or tuple(m.target for m in self.mapping if m.is_key)
        if not keys and self.mode == SyncMode.MERGE:
            raise ValueError(f"task {self.task_id}: a merge needs key columns")
        object.__setattr__(self, "keys", tuple(keys))

    @classmethod
    def from_row(cls, row: dict[str, Any]) -> SyncSpec:
        """From a configuration row; strategy ``full`` means replace without a marker, ``cdc`` a plain merge."""
        mapping = tuple(parse_mapping(row.get("field_mapping")))
        keys = tuple(parse_keys(row.get("custom_pk")) or parse_keys(row.get("primary_keys")))
        strategy = (row.get("strategy") or "incremental").lower()
        mode = {"full": SyncMode.CLEAN_INSERT, "cdc": SyncMode.MERGE}.get(strategy, SyncMode.of(row.get("sync_mode")))
        return cls(task_id=str(row["id"]), keys=keys, mapping=mapping, where=row.get("source_where"), mode=mode,
                   marker=None if strategy == "full" else (row.get("marker_field") or None),
                   no_update=bool(row.get("no_update")), rows_per_batch=row.get("batch_size") or 2000,
                   task_name=row.get("name"))

    def marker_in_target(self) -> str | None:
        """The marker under its target name."""
        if self.marker is None:
            return None
        return next((m.target for m in self.mapping if m.source.lower() == self.marker.lower()), self.marker)
