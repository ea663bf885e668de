"""What a version of a store is: for each table its schema, key, files and deltas."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

from tidemark.operators.index import Index
from tidemark.operators.reads import Bound


@dataclass(frozen=True)
class TableDef:
    """A table's name, schema and key; with `auto` the single long key column is numbered from 1."""

    name: str
    schema: T.StructType | str
    key: tuple[str, ...]
    auto: bool = False

    @property
    def struct(self) -> T.StructType:
        out = T.StructType.fromDDL(self.schema) if isinstance(self.schema, str) else self.schema
        return T.StructType([T.StructField(f.name, f.dataType, f.name not in self.key) for f in out])


@dataclass
class DataFile:
    """A Parquet file with its number of rows and the least and greatest first key column."""

    path: str
    rows: int
    low: object = None
    high: object = None

    def meets(self, lower: Bound | None, upper: Bound | None) -> bool:
        if self.low is None:
            return True
        return not (lower is not None and self.high < lower.value[0] or upper is not None and self.low > upper.value[0])


@dataclass
class TableState:
    schema: dict
    key: list[str]
    auto: bool = False
    next_id: int | None = None
    files: list[DataFile] = field(default_factory=list)
    deltas: list[str] = field(default_factory=list)  # oldest first; each holds a row or a deletion for a key once
    indexes: list[dict] = field(default_factory=list)

    @classmethod
    def of(cls, d: TableDef) -> TableState:
        return cls(json.loads(d.struct.json()), list(d.key), d.auto, 1 if d.auto else None)

    @property
    def struct(self) -> T.StructType:
        return T.StructType.fromJson(self.schema)

    def index_list(self) -> list[Index]:
        return [Index(i["name"], tuple(i["on"]), i["unique"]) for i in self.indexes]

    def copy(self) -> TableState:
        return TableState(self.schema, list(self.key), self.auto, self.next_id, list(self.files), list(self.deltas), [dict(i) for i in self.indexes])

    def paths(self) -> Iterable[str]:
        yield from (f.path for f in self.files)
        yield from self.deltas


@dataclass
class Manifest:
    version: int = 0
    base: int = 0
    tables: dict[str, TableState] = field(default_factory=dict)
    writes: dict[str, str] = field(default_factory=dict)  # the delta of each table that this version wrote by key
    deleted: list[str] = field(default_factory=list)
    installed: list[str] = field(default_factory=list)
    indexed: list[str] = field(default_factory=list)
    tokens: dict[str, int] = field(default_factory=dict)  # last batch of each stream that is held

    def to_json(self) -> str:
        return json.dumps(asdict(self), separators=(",", ":"), default=str)

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        raw = json.loads(text)
        raw["tables"] = {n: TableState(**{**t, "files": [DataFile(**f) for f in t["files"]]}) for n, t in raw["tables"].items()}
        return cls(**raw)

    def paths(self) -> Iterable[str]:
        for t in self.tables.values():
            yield from t.paths()
        yield from self.writes.values()

    def touched(self) -> set[str]:
        return {*self.writes, *self.deleted, *self.installed}
