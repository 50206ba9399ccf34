"""Reading and writing cubes."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeweave.cube import Cube
from cubeweave.sources.netcdf import NetcdfSource
from cubeweave.sources.zarr import ZarrSource
from cubeweave.tree import CubeTree

#: Readers by file ending.
FORMATS = {".parquet": "parquet", ".orc": "orc", ".csv": "csv", ".json": "json", ".jsonl": "json", ".nc": "netcdf", ".nc3": "netcdf", ".cdf": "netcdf", ".zarr": "zarr"}
PLUGINS: dict[str, type] = {"netcdf": NetcdfSource, "zarr": ZarrSource}
META = "cubeweave"


def register(spark: SparkSession, name: str | None = None, source: type | None = None) -> None:
    """Make this package's data sources, or another one, known to the session."""
    if source is not None:
        PLUGINS[name or source.name()] = source
    for s in PLUGINS.values():
        spark.dataSource.register(s)


def guess_format(path: str) -> str:
    for end, kind in FORMATS.items():
        if path.rstrip("/").endswith(end):
            return kind
    raise ValueError(f"no reader for {path}")


def open_cube(spark: SparkSession, path: str, dims: Sequence[str] | None = None, engine: str | None = None, drop_variables: Sequence[str] = (), **options: Any) -> Cube:
    """A lazy scan of one store.

    Dimensions come from the store's own metadata where it has them; column
    pruning and filters on keys reach Parquet and ORC.
    """
    kind = engine or guess_format(path)
    if kind in PLUGINS:
        register(spark)
    reader = spark.read.format(kind).options(**options)
    if kind == "csv" and "header" not in options:
        reader = reader.option("header", "true").option("inferSchema", "true")
    frame = reader.load(path).drop(*drop_variables)
    meta = next((f.metadata[META] for f in frame.schema if META in f.metadata), None)
    saved = json.loads(meta) if meta else {}
    dims = dims or saved.get("dims") or [f.name for f in frame.schema if f.metadata.get("role") == "dim"]
    if not dims:
        raise ValueError("the store doesn't name its dimensions; give dims")
    coords = {c: tuple(d) for c, d in saved.get("coords", {}).items()}
    names = tuple(c for c in frame.columns if c not in dims and c not in coords and c != "block")
    return Cube(frame, tuple(dims), names, coords, saved.get("attrs", {}), saved.get("var_attrs", {}))


def open_variable(spark: SparkSession, path: str, **options: Any) -> Cube:
    """A store of exactly one variable."""
    cube = open_cube(spark, path, **options)
    if len(cube.names) != 1:
        raise ValueError(f"{path} has {len(cube.names)} variables")
    return cube


def open_many(spark: SparkSession, paths: Sequence[str], concat_dim: str | None = None, preprocess: Callable[[Cube], Cube] | None = None, errors: str = "raise", **options: Any) -> Cube:
    """Several stores as one cube: united along ``concat_dim``, or by their labels."""
    cubes = []
    for p in paths:
        try:
            c = open_cube(spark, p, **options)
            cubes.append(preprocess(c) if preprocess else c)
        except Exception:
            if errors == "raise":
                raise
    frame = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [c.frame for c in cubes])
    return cubes[0].with_frame(frame, names=list(dict.fromkeys(n for c in cubes for n in c.names)))


def open_groups(spark: SparkSession, paths: Mapping[str, str], **options: Any) -> dict[str, Cube]:
    """``{group: store}`` as cubes."""
    return {g: open_cube(spark, p, **options) for g, p in paths.items()}


def open_tree(spark: SparkSession, paths: Mapping[str, str], **options: Any) -> CubeTree:
    return CubeTree.from_dict(open_groups(spark, paths, **options))


def load_cube(spark: SparkSession, path: str, **options: Any) -> Cube:
    """Open and keep in memory: one job."""
    cube = open_cube(spark, path, **options).persist()
    cube.frame.count()
    return cube


def load_variable(spark: SparkSession, path: str, **options: Any) -> Cube:
    """As :func:`open_variable`, kept in memory: one job."""
    cube = open_variable(spark, path, **options).persist()
    cube.frame.count()
    return cube


def load_tree(spark: SparkSession, paths: Mapping[str, str], **options: Any) -> CubeTree:
    """As :func:`open_tree`, each group kept in memory: a job for each."""
    return CubeTree.from_dict({g: load_cube(spark, p, **options) for g, p in paths.items()})


def from_frame(frame: DataFrame, dims: Sequence[str], **attrs: Any) -> Cube:
    return Cube.from_spark(frame, dims, **attrs)


def _described(cube: Cube) -> DataFrame:
    """The frame with the cube's description in its first column's metadata, which Parquet keeps."""
    meta = json.dumps({"dims": list(cube.dims), "coords": {c: list(d) for c, d in cube.coords.items()}, "attrs": dict(cube.attrs), "var_attrs": {k: dict(v) for k, v in cube.var_attrs.items()}}, default=str)
    first = cube.dims[0] if cube.dims else cube.names[0]
    return cube.frame.withMetadata(first, {META: meta})


def to_parquet(cube: Cube, path: str, mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    """Write a cube; ``mode`` append adds labels along a dimension."""
    _described(cube).write.mode(mode).partitionBy(*partition_by).parquet(path) if partition_by else _described(cube).write.mode(mode).parquet(path)


def append_dim(cube: Cube, path: str, dim: str) -> None:
    """Append along a dimension; labels that are there already raise (one job)."""
    spark = cube.frame.sparkSession
    old = open_cube(spark, path)
    if not cube.labels(dim).join(old.labels(dim), dim, "left_semi").isEmpty():
        raise ValueError(f"labels of {dim} are there already")
    to_parquet(cube, path, "append")


def write_blocks(cube: Cube, path: str, dim: str, size: int, region: bool = False) -> None:
    """Write in blocks of a dimension's integer labels, one folder each; with ``region`` only the blocks that the cube has are replaced."""
    frame = _described(cube).withColumn("block", F.floor(F.col(dim) / size))
    writer = frame.repartition("block").sortWithinPartitions(*cube.dims).write.partitionBy("block")
    writer.mode("overwrite").option("partitionOverwriteMode", "dynamic" if region else "static").parquet(path)


def save_many(cubes: Sequence[Cube], paths: Sequence[str]) -> None:
    for c, p in zip(cubes, paths, strict=True):
        to_parquet(c, p, "overwrite")


def to_netcdf(cube: Cube, path: str, dim: str | None = None, size: int = 1024) -> int:
    """Write classic netCDF: one file, or with ``dim`` one for each ``size`` of its labels.  Returns the number of files."""
    from cubeweave.sources.netcdf import write

    return write(cube, path, dim, size)


def to_zarr(cube: Cube, path: str, chunks: Mapping[str, int]) -> None:
    """Write one-variable-per-array chunks; a task writes whole chunks."""
    from cubeweave.sources.zarr import write

    write(cube, path, chunks)


def with_attrs(cube: Cube, **attrs: Any) -> Cube:
    return replace(cube, attrs={**cube.attrs, **attrs})
