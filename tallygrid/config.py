"""Settings of a search, and of the online service."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path


class InvalidConfiguration(ValueError):
    """A setting is missing, of the wrong type or out of range."""


@dataclass(frozen=True)
class Config:
    """k results for each of the first num_of_queries queries; query_range: how far a value may lie from the query's."""

    k: int = 0
    num_of_queries: int = 0
    query_range: int | None = None
    count_cap: int | None = None
    pad: bool = False

    def validate(self) -> Config:
        if self.k <= 0 or self.num_of_queries <= 0:
            raise InvalidConfiguration("k and num_of_queries must be above 0")
        if self.query_range is not None and self.query_range <= 0:
            raise InvalidConfiguration("query_range must be above 0 where it is given")
        if self.count_cap is not None and self.count_cap <= 0:
            raise InvalidConfiguration("count_cap must be above 0 where it is given")
        return self

    @classmethod
    def from_file(cls, path: str) -> Config:
        """JSON, or lines of key = value (with # comments and [sections] left out); names may have dashes."""
        text = Path(path).read_text()
        try:
            data = json.loads(text)
        except ValueError:
            lines = (x.split("#")[0].strip() for x in text.splitlines())
            data = dict(map(str.strip, x.split("=", 1)) for x in lines if "=" in x)
        known = {f.name for f in fields(cls)}
        data = {name: v for k, v in data.items() if (name := k.replace("-", "_")) in known}
        try:
            return cls(**{k: bool(v) if k == "pad" else None if v is None else int(v) for k, v in data.items()}).validate()
        except (TypeError, ValueError) as e:
            raise InvalidConfiguration(str(e)) from e


@dataclass(frozen=True)
class OnlineConfig:
    """Of the online service; adaptive ranges are used where selectivity is above 0."""

    data_file: str
    dim: int
    count_threshold: int
    data_type: int
    search_type: int
    max_data_size: int
    num_of_cluster: int
    data_format: int
    radius: int
    selectivity: float

    @property
    def adaptive(self) -> bool:
        return self.selectivity > 0

    @classmethod
    def from_file(cls, path: str) -> OnlineConfig:
        """Every setting is required, and of its type."""
        data = json.loads(Path(path).read_text())
        kinds = {f.name: {"str": str, "int": int, "float": (int, float)}[f.type] for f in fields(cls)}
        for name, kind in kinds.items():
            if not isinstance(data.get(name), kind) or isinstance(data.get(name), bool):
                raise InvalidConfiguration(f"{name} is missing or of the wrong type")
        return cls(**{k: data[k] for k in kinds})
