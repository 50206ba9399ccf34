"""A reader of classic netCDF files (versions 1, 2 and 5) as a Spark data source.

The layout follows the published format description: a header of dimensions,
attributes and variables, then the variables' big-endian data, record variables
interleaved by record.
"""

from __future__ import annotations

import json
import mmap
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, StructField, StructType

from cubeweave.cube import Cube
from cubeweave.functions.dates import us

#: The format's type numbers.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
#: Cells that one partition reads at most.
PART_CELLS = 1_000_000


@dataclass
class Variable:
    name: str
    dims: tuple[int, ...]
    attrs: dict
    kind: str
    begin: int


class Header:
    """The header of a file."""

    def __init__(self, data: bytes) -> None:
        if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
            raise ValueError("no classic netCDF file")
        self.data, self.at, self.version = data, 4, data[3]
        self.records = self.count()
        self.dims = [(self.name(), self.count()) for _ in range(self.tagged(DIMENSION))]
        self.attrs = self.attributes()
        self.variables: list[Variable] = []
        for _ in range(self.tagged(VARIABLE)):
            name = self.name()
            dims = tuple(self.count() for _ in range(self.count()))
            attrs = self.attributes()
            kind = TYPES[self.int4()]
            self.count()
            begin = self.int4() if self.version == 1 else self.int8()
            self.variables.append(Variable(name, dims, attrs, kind, begin))
        recs = [v for v in self.variables if self.is_record(v)]
        sizes = [np.dtype(v.kind).itemsize * int(np.prod([self.dims[d][1] for d in v.dims[1:]], dtype=np.int64)) for v in recs]
        # A lone record variable is not padded.
        self.record_size = sizes[0] if len(recs) == 1 else sum(-(-s // 4) * 4 for s in sizes)

    def int4(self) -> int:
        (x,) = struct.unpack_from(">i", self.data, self.at)
        self.at += 4
        return x

    def int8(self) -> int:
        (x,) = struct.unpack_from(">q", self.data, self.at)
        self.at += 8
        return x

    def count(self) -> int:
        return self.int8() if self.version == 5 else self.int4()

    def tagged(self, tag: int) -> int:
        found, n = self.int4(), self.count()
        if found not in (0, tag):
            raise ValueError("the header is damaged")
        return n

    def padded(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        self.at += -(-n // 4) * 4
        return out

    def name(self) -> str:
        return self.padded(self.count()).decode()

    def attributes(self) -> dict:
        out = {}
        for _ in range(self.tagged(ATTRIBUTE)):
            name, kind, n = self.name(), TYPES[self.int4()], self.count()
            raw = self.padded(n * np.dtype(kind).itemsize)
            values = raw.decode(errors="replace").rstrip("\0") if kind == "S1" else np.frombuffer(raw, kind).tolist()
            out[name] = values[0] if isinstance(values, list) and len(values) == 1 else values
        return out

    def is_record(self, v: Variable) -> bool:
        return bool(v.dims) and self.dims[v.dims[0]][1] == 0

    def shape(self, v: Variable) -> tuple[int, ...]:
        return tuple(self.records if self.dims[d][1] == 0 else self.dims[d][1] for d in v.dims)

    def rows(self, v: Variable, start: int, stop: int) -> np.ndarray:
        """The variable's entries [start, stop) along its first dimension."""
        shape, kind = self.shape(v), np.dtype(v.kind)
        inner = int(np.prod(shape[1:], dtype=np.int64))
        if not v.dims:
            return np.frombuffer(self.data, kind, 1, v.begin)
        if self.is_record(v):
            parts = [np.frombuffer(self.data, kind, inner, v.begin + r * self.record_size) for r in range(start, stop)]
            return np.stack(parts).reshape(stop - start, *shape[1:]) if parts else np.zeros((0, *shape[1:]), kind)
        return np.frombuffer(self.data, kind, inner * (stop - start), v.begin + start * inner * kind.itemsize).reshape(stop - start, *shape[1:])


def mapped(path: str) -> Header:
    """A file's header over its mapped pages: only what is read is loaded."""
    with open(path, "rb") as f:
        return Header(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


class Part(InputPartition):
    def __init__(self, start: int, stop: int) -> None:
        super().__init__(None)
        self.start, self.stop = start, stop


class NetcdfReader(DataSourceReader):
    """Partitions are ranges of the first dimension."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.schema = options["path"].removeprefix("file://").removeprefix("file:"), schema
        self.wanted = options.get("variables", "")

    def chosen(self, h: Header) -> tuple[list[Variable], tuple[int, ...]]:
        names = [n for n in self.wanted.split(",") if n]
        dim_names = {n for n, _ in h.dims}
        data = [v for v in h.variables if v.dims and v.name not in dim_names and v.kind != "S1" and (not names or v.name in names)]
        most = max((len(v.dims) for v in data), default=0)
        dims = next((v.dims for v in data if len(v.dims) == most), ())
        return [v for v in data if v.dims == dims], dims

    def partitions(self) -> list[Part]:
        h = mapped(self.path)
        data, _ = self.chosen(h)
        if not data:
            return [Part(0, 0)]
        shape = h.shape(data[0])
        step = max(1, PART_CELLS // max(1, int(np.prod(shape[1:], dtype=np.int64))))
        return [Part(a, min(shape[0], a + step)) for a in range(0, shape[0], step)] or [Part(0, 0)]

    def read(self, part: Part) -> Iterator[tuple]:
        h = mapped(self.path)
        data, dims = self.chosen(h)
        by_name = {v.name: v for v in h.variables}
        labels = []
        for k, d in enumerate(dims):
            name, size = h.dims[d][0], h.shape(data[0])[k]
            v = by_name.get(name)
            labels.append(h.rows(v, 0, size).astype(float) if v is not None and v.kind != "S1" else np.arange(size))
        blocks = [h.rows(v, part.start, part.stop).astype(float).reshape(-1) for v in data]
        fills = [v.attrs.get("_FillValue") for v in data]
        shape = (part.stop - part.start, *h.shape(data[0])[1:]) if data else (0,)
        for flat, at in enumerate(np.ndindex(shape)):
            keys = [float(labels[k][i + (part.start if k == 0 else 0)]) for k, i in enumerate(at)]
            values = [None if b[flat] == f or np.isnan(b[flat]) else float(b[flat]) for b, f in zip(blocks, fills)]
            yield (*keys, *values)


class NetcdfSource(DataSource):
    """``spark.read.format("netcdf").load(path)``: the variables of the most dimensions, in long form."""

    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def schema(self) -> StructType:
        reader = NetcdfReader(self.options, StructType())
        h = mapped(reader.path)
        data, dims = reader.chosen(h)
        keys = [StructField(h.dims[d][0], DoubleType(), True, {"role": "dim"}) for d in dims]
        if keys:
            # Where the opener of a cube looks for its description.
            told = {"dims": [k.name for k in keys], "attrs": h.attrs, "var_attrs": {v.name: v.attrs for v in h.variables if v.attrs}}
            keys[0].metadata["cubeweave"] = json.dumps(told)
        return StructType([*keys, *[StructField(v.name, DoubleType()) for v in data]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return NetcdfReader(self.options, schema)


def _counted(data: bytes) -> bytes:
    return struct.pack(">i", len(data)) + data + b"\0" * (-len(data) % 4)


def _attributes(attrs: dict) -> bytes:
    if not attrs:
        return struct.pack(">ii", 0, 0)
    out = struct.pack(">ii", ATTRIBUTE, len(attrs))
    for k, v in attrs.items():
        out += _counted(k.encode())
        if isinstance(v, str):
            out += struct.pack(">i", 2) + _counted(v.encode())
        else:
            values = np.atleast_1d(np.asarray(v, ">f8"))
            out += struct.pack(">ii", 6, len(values)) + values.tobytes()
    return out


def encode(dims: dict[str, np.ndarray], variables: dict[str, np.ndarray], attrs: dict, var_attrs: dict) -> bytes:
    """A file of version 2: doubles, dimensions of fixed length, NaN for missing."""
    whole = {**{d: ((d,), x) for d, x in dims.items()}, **{n: (tuple(dims), x) for n, x in variables.items()}}
    names = list(dims)
    head = b"CDF\x02" + struct.pack(">i", 0) + struct.pack(">ii", DIMENSION, len(dims))
    for d, x in dims.items():
        head += _counted(d.encode()) + struct.pack(">i", len(x))
    head += _attributes(attrs) + struct.pack(">ii", VARIABLE, len(whole))
    described = []
    for n, (over, x) in whole.items():
        text = _counted(n.encode()) + struct.pack(f">i{len(over)}i", len(over), *[names.index(d) for d in over]) + _attributes(var_attrs.get(n, {}))
        size = x.size * 8
        described.append(text + struct.pack(">ii", 6, min(size, 2**31 - 4)))
    # The place of each variable's data: all headers, each with its 8 bytes of place, then data in order.
    at = len(head) + sum(len(t) + 8 for t in described)
    for text, (_, x) in zip(described, whole.values()):
        head += text + struct.pack(">q", at)
        at += x.size * 8
    return head + b"".join(np.ascontiguousarray(x, ">f8").tobytes() for _, x in whole.values())


def write(cube: Cube, path: str, dim: str | None, size: int) -> int:
    """Write numeric variables over numeric or time dimensions; a task writes a whole file and then names it.

    With ``dim`` the folder ``path`` gets a file for each ``size`` labels of it, so
    tasks hold a block each; without, one task holds all cells.  A file is named only
    when it is whole, so a task that runs again does no harm.  Folders have to be
    mounted on all executors, as for reading.
    """
    kinds = dict(cube.frame.dtypes)
    times = [d for d in cube.dims if kinds[d].startswith(("timestamp", "date"))]
    var_attrs = {n: dict(a) for n, a in cube.var_attrs.items()} | {d: {"units": "microseconds since 1970-01-01 00:00:00"} for d in times}
    dense = cube.densify()
    labels = {d: (us(F.col(d)) if d in times else F.col(d)).cast("double").alias(d) for d in cube.dims}
    block = F.floor(F.col("__pos") / F.lit(size)).cast("bigint") if dim else F.lit(0).cast("bigint")
    cells = (dense.with_pos(dim) if dim else dense.frame).select(block.alias("__block"), *labels.values(), *[F.col(n).cast("double").alias(n) for n in cube.names])
    dims, names, attrs = list(cube.dims), list(cube.names), dict(cube.attrs)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["__block"].iloc[0])
        pdf = pdf.sort_values(dims)
        axes = {d: np.unique(pdf[d].to_numpy()) for d in dims}
        shape = [len(x) for x in axes.values()]
        data = encode(axes, {n: pdf[n].to_numpy(float).reshape(shape) for n in names}, attrs, var_attrs)
        target = os.path.join(path, f"part-{number:06d}.nc") if dim else path
        os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
        draft = f"{target}.{os.getpid()}.tmp"
        with open(draft, "wb") as f:
            f.write(data)
        os.replace(draft, target)
        return pd.DataFrame({"block": [number], "bytes": [len(data)]})

    return cells.groupBy("__block").applyInPandas(one, "block long, bytes long").agg(F.count(F.lit(1))).first()[0]
