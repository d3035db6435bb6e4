"""Data sources as plug-ins: what they are, a registry, and Spark sources over staged tiles, pages and zip members."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition


@dataclass(frozen=True)
class Source:
    """What a survey needs to know of a source; ``tier`` and ``covers`` take part in choosing one for a category."""

    id: str
    name: str
    licence: str = ""
    attribution: str = ""
    needs_key: bool = False
    tiers: dict[str, int] = field(default_factory=dict)
    covers: Callable[[tuple[float, float, float, float]], str] = lambda box: "full"
    reader: type[DataSource] | None = None


_SOURCES: dict[str, Source] = {}


def register(source: Source, spark: SparkSession | None = None) -> Source:
    """Add a source; its id must be new. With a session its reader can be used by ``spark.read.format``."""
    if source.id in _SOURCES:
        raise ValueError(f"a source {source.id!r} is registered already")
    _SOURCES[source.id] = source
    if spark is not None and source.reader is not None:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        spark.dataSource.register(source.reader)
    return source


def get(source_id: str) -> Source:
    try:
        return _SOURCES[source_id]
    except KeyError:
        raise ValueError(f"no source {source_id!r}; there are {sorted(_SOURCES)}") from None


def all_sources() -> list[Source]:
    return [_SOURCES[k] for k in sorted(_SOURCES)]


class _Tile(InputPartition):
    def __init__(self, path: str, tile: str):
        self.path, self.tile = path, tile


class StagedTiles(DataSource):
    """Feature collections staged as one JSON file per tile; a partition reads one tile.

    Options: ``path``, a folder that driver and executors share, and ``tiles``,
    comma-separated. An equality on tile_id is pushed down and prunes the files.
    """

    @classmethod
    def name(cls) -> str:
        return "staged_tiles"

    def schema(self) -> str:
        return "tile_id string, id string, props string, geometry string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _TileReader(self.options)


class _TileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.tiles = [t for t in options["tiles"].split(",") if t]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("tile_id",):
                self.tiles = [t for t in self.tiles if t == f.value]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_Tile(f"{self.folder}/{t}.json", t) for t in self.tiles]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8") as f:  # type: ignore[attr-defined]
            data = json.load(f)
        for x in data["features"]:
            props = x.get("properties") or {}
            yield partition.tile, str(x.get("id", props.get("id"))), json.dumps(props), json.dumps(x.get("geometry"))  # type: ignore[attr-defined]


class ZipMembers(DataSource):
    """Members of a zip in a shared folder, a partition to a member: only its own bytes are read and inflated.

    Options: ``path``, and ``suffix`` that names must end with.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "member string, content binary"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _ZipReader(self.options)


class _ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", "")

    def partitions(self) -> list[InputPartition]:
        with zipfile.ZipFile(self.path) as z:
            return [_Tile(self.path, n) for n in sorted(z.namelist()) if n.endswith(self.suffix) and not n.endswith("/")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with zipfile.ZipFile(partition.path) as z:  # type: ignore[attr-defined]
            yield partition.tile, z.read(partition.tile)  # type: ignore[attr-defined]


class StagedPages(DataSource):
    """Pages of a feature service staged as layer/0.json, layer/1.json, ...; a partition follows one layer's pages.

    A page names the next one in ``next``; more than ``max_pages`` is an error.
    Options: ``path``, ``layers``, ``max_pages``.
    """

    @classmethod
    def name(cls) -> str:
        return "staged_pages"

    def schema(self) -> str:
        return "layer string, page int, id string, props string, geometry string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _PageReader(self.options)


class _PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.layers, self.most = options["path"], options["layers"].split(","), int(options.get("max_pages", "500"))

    def partitions(self) -> list[InputPartition]:
        return [_Tile(f"{self.folder}/{name}", name) for name in self.layers]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page: int | None = 0
        seen = 0
        while page is not None:
            seen += 1
            if seen > self.most:
                raise ValueError(f"layer {partition.tile} has more than {self.most} pages")  # type: ignore[attr-defined]
            with open(f"{partition.path}/{page}.json", encoding="utf-8") as f:  # type: ignore[attr-defined]
                data = json.load(f)
            for x in data["features"]:
                yield partition.tile, page, str(x.get("id")), json.dumps(x.get("properties")), json.dumps(x.get("geometry"))  # type: ignore[attr-defined]
            page = data.get("next")
