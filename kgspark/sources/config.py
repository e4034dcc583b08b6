"""Declarative sync configurations, read from JSON into dataclasses, checked and ordered."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


@dataclass
class Fetcher:
    name: str
    tool: str = ""
    result_path: str = ""
    record_type: str | None = None
    depends_on: list[str] = field(default_factory=list)
    date_path: str | None = None
    tool_class: str = "read"


@dataclass
class RecordType:
    """How records of one kind are told and mapped."""

    name: str
    fetcher: str | None = None
    condition: str | None = None
    id_field: str | None = None
    fields: dict[str, Any] = field(default_factory=dict)
    entities: list[dict] = field(default_factory=list)
    relationships: list[dict] = field(default_factory=list)
    grouping: dict | None = None


@dataclass
class SyncConfig:
    source: str
    fetchers: list[Fetcher] = field(default_factory=list)
    record_types: list[RecordType] = field(default_factory=list)
    sync_order: list[str] = field(default_factory=list)


def load(path: str) -> SyncConfig:
    """A configuration from a JSON file."""
    return from_dict(json.loads(Path(path).read_text()))


def load_all(folder: str) -> dict[str, SyncConfig]:
    """Every configuration of a folder by its file's name."""
    return {p.stem: load(str(p)) for p in sorted(Path(folder).glob("*.json"))}


def from_dict(d: dict) -> SyncConfig:
    """A configuration from plain data; unknown keys are ignored."""
    pick = lambda cls, x: cls(**{k: v for k, v in x.items() if k in cls.__dataclass_fields__})
    return SyncConfig(
        d.get("source", ""), [pick(Fetcher, f) for f in d.get("fetchers", [])], [pick(RecordType, r) for r in d.get("record_types", [])], list(d.get("sync_order", []))
    )


def ordered_fetchers(config: SyncConfig) -> list[Fetcher]:
    """Those named in sync_order first, then the rest (J5); write tools are left out, and search tools that none needs."""
    needed = {d for f in config.fetchers for d in f.depends_on}
    use = [f for f in config.fetchers if f.tool_class != "write" and (f.tool_class != "search" or f.name in needed)]
    rank = {n: i for i, n in enumerate(config.sync_order)}
    return sorted(use, key=lambda f: rank.get(f.name, len(rank)))


def levels(fetchers: list[Fetcher], rounds: int = 10) -> dict[str, int]:
    """How deep each fetcher's inputs go (J3); 999 where they cannot be resolved."""
    out: dict[str, int] = {}
    for _ in range(rounds):
        for f in fetchers:
            if f.name not in out and all(d in out for d in f.depends_on):
                out[f.name] = 1 + max((out[d] for d in f.depends_on), default=-1)
    return {f.name: out.get(f.name, 999) for f in fetchers}


def types_of(config: SyncConfig, fetcher: Fetcher) -> list[RecordType]:
    """The record types that a fetcher's rows may have."""
    return [r for r in config.record_types if r.fetcher == fetcher.name or (r.fetcher is None and r.name == fetcher.record_type)]


def problems(config: SyncConfig) -> list[tuple[str, str]]:
    """Code and subject of each fault (J1, J2): orphan record types, unknown inputs, missing ids, placeholders."""
    names = {f.name for f in config.fetchers}
    kinds = {f.record_type for f in config.fetchers if f.record_type}
    found = [("MISSING_FETCHER", d) for f in config.fetchers for d in f.depends_on if d not in names]
    found += [("ORPHAN_RECORD_TYPE", r.name) for r in config.record_types if kinds and r.name not in kinds]
    found += [("MISSING_ID_FIELD", r.name) for r in config.record_types if not r.id_field]
    for r in config.record_types:
        found += [("PLACEHOLDER", f"{r.name}.{k}") for k, v in r.fields.items() if isinstance(v, dict) and "TODO" in json.dumps(v)]
    return found


def repaired(config: SyncConfig) -> SyncConfig:
    """Without fetchers that feed neither a record type nor another fetcher."""
    kinds = {r.name for r in config.record_types}
    needed = {d for f in config.fetchers for d in f.depends_on}
    return SyncConfig(config.source, [f for f in config.fetchers if f.record_type in kinds or f.name in needed], config.record_types, config.sync_order)
