"""A survey package as a plan: lazily derived frames in their fixed order, and the record of what was made.

Each step reads the frames before it and makes a new one; nothing is rewritten
in place. A package is planned once and may be re-derived from stored frames.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.functions import categories as K
from sitewright.operators import tiles

#: The order in which frames are derived. Footprints are fused before anything reads them, and boundary lines come last, so that they are not taken for footprints.
STEPS = ("elements", "fused", "categories", "heights", "roofs", "canopy", "boundaries")
PATH_LIMIT = 240


@dataclass(frozen=True)
class Request:
    """What is asked for; values are checked when it is made."""

    west: float
    south: float
    east: float
    north: float
    sources: tuple[str, ...]
    categories: tuple[str, ...] | None = None
    tile_size: float = 2_000.0
    overlap: float = 100.0
    region: str = "region"
    site: str = "site"
    day: date = field(default_factory=date.today)

    def __post_init__(self) -> None:
        if not (-180 <= self.west < self.east <= 180 and -90 <= self.south < self.north <= 90):
            raise ValueError("a box needs west below east and south below north, in degrees")
        if not self.sources:
            raise ValueError("no source is selected")
        K.check(self.categories)

    @classmethod
    def parse(cls, box: str, **rest: object) -> Request:
        """From ``west,south,east,north``; corners may come in either order."""
        a, b, c, d = (float(v) for v in box.split(","))
        return cls(min(a, c), min(b, d), max(a, c), max(b, d), **rest)  # type: ignore[arg-type]

    def stem(self) -> str:
        return f"{slug(self.site)}_{self.day.isoformat()}"


def slug(name: str) -> str:
    out = re.sub("-{2,}", "-", re.sub("[^A-Za-z0-9-]", "", re.sub(r"\s+", "-", name.strip()))).strip("-")[:40].strip("-")
    if not out:
        raise ValueError(f"the name {name!r} has no usable characters")
    return out


def check_paths(root: str, names: Iterable[str], limit: int = PATH_LIMIT) -> None:
    """An error before anything is fetched if an output's path would be too long."""
    if long := [n for n in names if len(f"{root}/{n}") > limit]:
        raise ValueError(f"{len(long)} paths would be longer than {limit} characters, such as {long[0]}")


def plan_tiles(spark: SparkSession, request: Request) -> DataFrame:
    box = F.struct(*[F.lit(v).alias(n) for v, n in zip((request.west, request.south, request.east, request.north), ("x0", "y0", "x1", "y1"))])
    return tiles.build(spark.range(1).select(box.alias("box")), request.tile_size, request.overlap)


class Pipeline:
    """Named steps over named frames, run on demand; a step that fails is recorded and the others go on."""

    def __init__(self) -> None:
        self.steps: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = {}
        self.records: dict[str, dict] = {}

    def step(self, name: str) -> Callable:
        if name in self.steps or name not in STEPS:
            raise ValueError(f"step {name!r} is unknown or there already")

        def add(f: Callable[[dict[str, DataFrame]], DataFrame]) -> Callable:
            self.steps[name] = f
            return f

        return add

    def run(self, frames: dict[str, DataFrame], stop: Callable[[], bool] = lambda: False, progress: Callable[[str, str], None] = lambda step, what: None) -> dict[str, DataFrame]:
        """All frames after the steps, in the fixed order; ``stop`` is asked between them."""
        have = dict(frames)
        for name in STEPS:
            if name not in self.steps:
                continue
            if stop():
                self.records[name] = {"ran": False, "reason": "stopped"}
                continue
            progress(name, "started")
            try:
                have[name] = self.steps[name](have)
                self.records[name] = {"ran": True}
            except (ValueError, KeyError) as e:  # an input that this package lacks
                self.records[name] = {"ran": False, "reason": str(e)}
            progress(name, "ended")
        return have

    def manifest(self, spark: SparkSession, request: Request) -> DataFrame:
        """One row that says what was asked for and what ran."""
        row = {
            "stem": request.stem(), "bbox": {"west": request.west, "south": request.south, "east": request.east, "north": request.north}, "sources": list(request.sources),
            "categories": list(request.categories or ()), "steps": [{"step": k, "ran": v["ran"], "reason": v.get("reason")} for k, v in self.records.items()],
        }
        schema = "stem string, bbox struct<west:double,south:double,east:double,north:double>, sources array<string>, categories array<string>, steps array<struct<step:string,ran:boolean,reason:string>>"
        return spark.createDataFrame([row], schema)
