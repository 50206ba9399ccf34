"""Reading and writing Zarr stores of format 2 in a folder that all executors share.

Each array is a folder with ``.zarray`` and ``.zattrs`` in JSON and a file for
each chunk; ``_ARRAY_DIMENSIONS`` names its dimensions.  Chunks are plain or
zlib-compressed.
"""

from __future__ import annotations

import itertools
import json
import os
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, StructField, StructType

from cubeweave.cube import Cube


def _meta(path: str, name: str) -> tuple[dict, dict]:
    with open(f"{path}/{name}/.zarray") as f:
        array = json.load(f)
    attrs = {}
    if os.path.exists(f"{path}/{name}/.zattrs"):
        with open(f"{path}/{name}/.zattrs") as f:
            attrs = json.load(f)
    return array, attrs


def _chunk(path: str, name: str, meta: dict, at: tuple[int, ...]) -> np.ndarray:
    """A chunk, full where no file stands for it."""
    shape = tuple(meta["chunks"])
    file = f"{path}/{name}/" + meta.get("dimension_separator", ".").join(map(str, at))
    if not os.path.exists(file):
        fill = meta["fill_value"]
        return np.full(shape, np.nan if fill in (None, "NaN") else fill, float)
    with open(file, "rb") as f:
        raw = f.read()
    kind = (meta.get("compressor") or {}).get("id")
    if kind in ("zlib", "gzip"):
        raw = zlib.decompress(raw, 47)
    elif kind is not None:
        raise ValueError(f"no decoder for {kind}")
    return np.frombuffer(raw, meta["dtype"]).reshape(shape, order=meta.get("order", "C")).astype(float)


class Part(InputPartition):
    def __init__(self, at: tuple[int, ...]) -> None:
        super().__init__(None)
        self.at = at


class ZarrReader(DataSourceReader):
    """A partition for each chunk of the arrays of the most dimensions."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"].removeprefix("file://").removeprefix("file:").rstrip("/")
        metas = {n: _meta(self.path, n) for n in sorted(os.listdir(self.path)) if os.path.exists(f"{self.path}/{n}/.zarray")}
        dims = {n: tuple(a.get("_ARRAY_DIMENSIONS", [f"dim_{k}" for k in range(len(m["shape"]))])) for n, (m, a) in metas.items()}
        data = [n for n in metas if dims[n] != (n,)]
        self.dims = max((dims[n] for n in data), key=len, default=())
        self.names = [n for n in data if dims[n] == self.dims]
        self.metas = {n: m for n, (m, _) in metas.items()}

    def partitions(self) -> list[Part]:
        m = self.metas[self.names[0]]
        counts = [-(-s // c) for s, c in zip(m["shape"], m["chunks"])]
        return [Part(at) for at in itertools.product(*map(range, counts))]

    def labels(self, dim: str, size: int) -> np.ndarray:
        if dim not in self.metas:
            return np.arange(size, dtype=float)
        m = self.metas[dim]
        return np.concatenate([_chunk(self.path, dim, m, (k,)) for k in range(-(-m["shape"][0] // m["chunks"][0]))])[: m["shape"][0]]

    def read(self, part: Part) -> Iterator[tuple]:
        m = self.metas[self.names[0]]
        starts = [k * c for k, c in zip(part.at, m["chunks"])]
        sizes = [min(c, s - a) for c, s, a in zip(m["chunks"], m["shape"], starts)]
        axes = [self.labels(d, s)[a : a + n] for d, s, a, n in zip(self.dims, m["shape"], starts, sizes)]
        blocks = [_chunk(self.path, n, self.metas[n], part.at) for n in self.names]
        for at in np.ndindex(*sizes):
            yield (*[float(x[i]) for x, i in zip(axes, at)], *[None if np.isnan(b[at]) else float(b[at]) for b in blocks])


class ZarrSource(DataSource):
    """``spark.read.format("zarr").load(folder)``, in long form."""

    @classmethod
    def name(cls) -> str:
        return "zarr"

    def schema(self) -> StructType:
        r = ZarrReader(self.options)
        return StructType([*[StructField(d, DoubleType(), True, {"role": "dim"}) for d in r.dims], *[StructField(n, DoubleType()) for n in r.names]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return ZarrReader(self.options)


def write(cube: Cube, path: str, chunks: Mapping[str, int]) -> None:
    """Write a cube's variables as doubles.  Cells meet by chunk, so each chunk's file has one writer; absent chunks have no file."""
    axes = {d: [r[0] for r in cube.index(d).orderBy("pos").select(F.col(d).cast("double")).collect()] for d in cube.dims}
    shape = [len(axes[d]) for d in cube.dims]
    sizes = [min(chunks.get(d, s), s) or 1 for d, s in zip(cube.dims, shape)]
    frame = cube.frame
    for d in cube.dims:
        frame = frame.join(cube.index(d).withColumnRenamed("pos", f"__p_{d}"), d)
    frame = frame.select(*[F.floor(F.col(f"__p_{d}") / c).alias(f"c_{d}") for d, c in zip(cube.dims, sizes)], *[(F.col(f"__p_{d}") % c).alias(f"i_{d}") for d, c in zip(cube.dims, sizes)], *[F.col(n).cast("double").alias(n) for n in cube.names])
    dims, names = cube.dims, cube.names
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/.zgroup", "w") as f:
        json.dump({"zarr_format": 2}, f)
    for n, own, size, count in [(n, dims, sizes, shape) for n in names] + [(d, (d,), [len(axes[d]) or 1], [len(axes[d])]) for d in dims]:
        os.makedirs(f"{path}/{n}", exist_ok=True)
        with open(f"{path}/{n}/.zarray", "w") as f:
            json.dump({"zarr_format": 2, "shape": list(count), "chunks": list(size), "dtype": "<f8", "compressor": {"id": "zlib", "level": 1}, "fill_value": "NaN", "order": "C", "filters": None}, f)
        with open(f"{path}/{n}/.zattrs", "w") as f:
            json.dump({"_ARRAY_DIMENSIONS": list(own)}, f)
    for d in dims:
        with open(f"{path}/{d}/0", "wb") as f:
            f.write(zlib.compress(np.asarray(axes[d], "<f8").tobytes(), 1))

    def put(key: tuple, pdf):
        import pandas as pd

        for n in names:
            block = np.full(sizes, np.nan)
            block[tuple(pdf[f"i_{d}"].to_numpy(int) for d in dims)] = pdf[n].to_numpy(float)
            name = f"{path}/{n}/" + ".".join(str(int(k)) for k in key)
            with open(f"{name}.part", "wb") as f:
                f.write(zlib.compress(block.astype("<f8").tobytes(), 1))
            os.replace(f"{name}.part", name)
        return pd.DataFrame({"cells": [len(pdf)]})

    frame.groupBy(*[f"c_{d}" for d in dims]).applyInPandas(put, "cells long").count()
