"""Configuration on the driver: layered mappings, class names, split shares, augmentation plans."""

from __future__ import annotations

import copy
import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

MIN_IMAGE_SIZE = 32


def merged(*layers: Mapping[str, Any]) -> dict[str, Any]:
    """Later layers over earlier ones: mappings merge key by key, lists and scalars replace."""
    out: dict[str, Any] = {}
    for layer in layers:
        for key, value in layer.items():
            both = isinstance(value, Mapping) and isinstance(out.get(key), Mapping)
            out[key] = merged(out[key], value) if both else copy.deepcopy(value)
    return out


def load(*paths: str, overrides: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """JSON files (YAML too where a parser is installed), then `overrides`."""
    layers = []
    for p in paths:
        text = Path(p).read_text()
        if p.endswith((".yaml", ".yml")):
            import yaml

            layers.append(yaml.safe_load(text) or {})
        else:
            layers.append(json.loads(text))
    return merged(*layers, overrides or {})


@dataclass(frozen=True)
class ClassSpec:
    name: str
    directory: str
    aliases: tuple[str, ...] = ()


@dataclass(frozen=True)
class CurationConfig:
    """The settings that operators take; raises ValueError for those that can't be."""

    classes: tuple[ClassSpec, ...]
    split: Mapping[str, float] = field(default_factory=lambda: {"train": 0.75, "validation": 0.125, "test": 0.125})
    seed: int = 42
    image_size: int = 224
    batch_size: int = 32
    near_duplicate_bits: int = 5
    confidence_threshold: float = 0.60

    def __post_init__(self) -> None:
        for what in ("name", "directory"):
            values = [getattr(c, what) for c in self.classes]
            if len(set(values)) < len(values):
                raise ValueError(f"classes share a {what}")
        if self.image_size < MIN_IMAGE_SIZE:
            raise ValueError(f"image_size must be at least {MIN_IMAGE_SIZE}")
        if self.batch_size < 1:
            raise ValueError("batch_size must be at least 1")
        if not self.split or min(self.split.values()) < 0 or sum(self.split.values()) <= 0:
            raise ValueError("split shares must be positive")

    @property
    def shares(self) -> dict[str, float]:
        """Split shares that sum to 1."""
        total = sum(self.split.values())
        return {k: v / total for k, v in self.split.items()}

    def class_table(self, spark: SparkSession) -> DataFrame:
        """(idx, class_name, class_dir, aliases) in the order of the configuration."""
        rows = [(k, c.name, c.directory, list(c.aliases)) for k, c in enumerate(self.classes)]
        return spark.createDataFrame(rows, "idx int, class_name string, class_dir string, aliases array<string>")


def augmentation_problems(plan: Mapping[str, Any], classes: list[str], sources: list[str]) -> list[str]:
    """What is wrong with an augmentation plan; nothing if it can be carried out."""
    out = [f"unknown class {c}" for c in plan.get("classes", []) if c not in classes]
    out += [f"unknown background source {s}" for s in plan.get("background_sources", []) if s not in sources]
    harvest = plan.get("harvest_from")
    if "harvested" in plan.get("background_sources", []):
        if not harvest:
            out.append("no class to harvest from")
        elif harvest not in classes:
            out.append(f"unknown class {harvest} to harvest from")
    if harvest and harvest in plan.get("classes", []):
        out.append("the harvested class is among those augmented")
    return out
