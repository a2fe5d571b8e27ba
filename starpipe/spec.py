"""Declarative descriptions of facts, dimensions and rules.

Operators take a DataFrame and one of these records; no operator names a trip column
itself. `starpipe.trips` holds the one instance this repository ships.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Column:
    """One canonical column: its Spark type, the source names it may arrive under
    (the first one present wins) and the value that replaces null, if any."""

    name: str
    type: str
    sources: tuple[str, ...] = ()
    default: object = None

    def names(self) -> tuple[str, ...]:
        return self.sources or (self.name,)


@dataclass(frozen=True)
class FactSpec:
    """A fact table: columns plus the roles the generic operators need to know."""

    columns: tuple[Column, ...]
    start_ts: str
    end_ts: str
    start_date_id: str
    end_date_id: str
    distance: str
    total: str
    passengers: str
    flag: str
    flag_values: tuple[str, ...]
    flag_unknown: str
    hash_column: str
    hash_inputs: tuple[str, ...]
    output: tuple[str, ...]
    export: tuple[str, ...]
    duplicate_keys: tuple[str, ...]

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)


@dataclass(frozen=True)
class DimSpec:
    """A dimension: canonical key and attributes with the source names of each."""

    name: str
    key: str
    key_type: str
    key_sources: tuple[str, ...]
    attributes: Mapping[str, tuple[str, ...]]


@dataclass(frozen=True)
class Layout:
    """Folder layout of the layers: root/layer/area/exp=/[trial=/]year=/month=."""

    root: str
    experiment: str
    trial: int | None = None
    area: str = "s3"

    def month(self, layer: str, year: int, month: int, *, with_trial: bool = True) -> str:
        parts = [self.root.rstrip("/"), layer, self.area, f"exp={self.experiment}"]
        if with_trial and self.trial is not None:
            parts.append(f"trial={self.trial}")
        return "/".join([*parts, f"year={year}", f"month={month}"])

    def candidates(self, layer: str, year: int, month: int) -> list[str]:
        """The trial folder first, then the same folder without a trial."""
        paths = [self.month(layer, year, month)]
        if self.trial is not None:
            paths.append(self.month(layer, year, month, with_trial=False))
        return paths

    def dictionary(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/ref/{name}/{name}.parquet"


@dataclass(frozen=True)
class RunSettings:
    """The tuning knobs of one run."""

    aqe: bool = True
    codec: str = "snappy"
    shuffle_partitions: int = 64
    max_partition_bytes: int = 128 * 1024 * 1024
    broadcast_small: bool = True
    files_per_month: int | None = None
    export_mode: str = "parallel_parts"
    export_compression: str | None = None


@dataclass(frozen=True)
class GatePolicy:
    """Largest accepted percentage of each rule, by step, and the steps that stop a run."""

    limits: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    gated: Sequence[str] = ()
