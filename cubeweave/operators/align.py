"""Alignment, joins by label, as-of lookups, merging and concatenation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeweave.cube import AlignmentError, Cube
from cubeweave.operators.nearest import nearest_points  # noqa: F401
from cubeweave.ranges import dealt, is_small, kept


def fingerprint(cube: Cube, dim: str) -> tuple:
    """Count and order-free hash of a dimension's labels, for comparing indexes.  Runs a job."""
    row = cube.labels(dim).agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(dim)), F.min(dim), F.max(dim)).first()
    return tuple(row)


def joined_labels(cubes: Sequence[Cube], dim: str, join: str) -> DataFrame:
    sides = [c.labels(dim) for c in cubes if dim in c.dims]
    if join == "left":
        return sides[0]
    if join == "right":
        return sides[-1]
    if join == "inner":
        return reduce(lambda a, b: a.join(b, dim, "left_semi"), sides)
    return reduce(lambda a, b: a.union(b), sides).distinct()


def align(*cubes: Cube, join: str = "inner", exclude: Sequence[str] = (), fill_value: Any = None) -> tuple[Cube, ...]:
    """Cubes on common labels of each shared dimension.

    inner, outer, left and right choose the labels; exact raises
    :class:`AlignmentError` where they differ (a job for each dimension);
    override needs equal sizes and takes the first cube's labels by position.
    """
    shared = [d for d in dict.fromkeys(d for c in cubes for d in c.dims) if d not in exclude and sum(d in c.dims for c in cubes) > 1]
    out = list(cubes)
    for d in shared:
        having = [c for c in out if d in c.dims]
        if join == "exact":
            if len({fingerprint(c, d) for c in having}) > 1:
                raise AlignmentError(f"indexes along {d} differ")
            continue
        if join == "override":
            first = having[0].index(d)
            for k, c in enumerate(out):
                if d in c.dims and c is not having[0]:
                    old = c.index(d).withColumnRenamed(d, "__old")
                    if old.count() != first.count():
                        raise AlignmentError(f"sizes along {d} differ")
                    moved = c.frame.withColumnRenamed(d, "__old").join(old.join(first, "pos"), "__old")
                    out[k] = replace(c.with_frame(moved), orders={}, spines={})
            continue
        labels = joined_labels(having, d, join)
        for k, c in enumerate(out):
            if d in c.dims:
                frame = c.frame.join(labels, d, "left_semi") if join != "outer" else c.frame
                out[k] = replace(c.with_frame(frame), spines={**c.spines, d: labels}, orders={x: f for x, f in c.orders.items() if x != d})
    if fill_value is not None:
        out = [c.densify().fillna(fill_value) for c in out]
    return tuple(out)


def binary(a: Cube, b: Cube, op: Callable[[Column, Column], Column], join: str = "inner") -> Cube:
    """Arithmetic between cubes: join on shared dimensions, repeat over the others.

    Variables of one name meet; a cube of one variable meets all of the other's.
    A side without dimensions of its own is small by nature of what it lacks, and
    Spark picks a broadcast for it by its size.
    """
    shared = [d for d in a.dims if d in b.dims]
    dims = [*a.dims, *[d for d in b.dims if d not in a.dims]]
    pairs = [(n, n) for n in a.names if n in b.names] or ([(n, b.names[0]) for n in a.names] if len(b.names) == 1 else [(a.names[0], n) for n in b.names])
    right = b.frame.select(*b.dims, *[F.col(n).alias(f"__{n}") for n in dict.fromkeys(y for _, y in pairs)])
    how = {"inner": "inner", "outer": "full", "left": "left", "right": "right"}[join]
    left = a.frame.select(*a.dims, *dict.fromkeys(x for x, _ in pairs))
    both = left.join(right, shared, how) if shared else left.crossJoin(right)
    out = both.select(*dims, *[op(F.col(x), F.col(f"__{y}")).alias(x if x == y or len(b.names) == 1 else y) for x, y in pairs])
    names = [c for c in out.columns if c not in dims]
    return Cube(out, tuple(dims), tuple(names), {}, a.attrs)


def asof(targets: DataFrame, sources: DataFrame, key: str, method: str = "pad", tolerance: Any = None, by: Sequence[str] = ()) -> DataFrame:
    """For each target key its neighbour among source keys: ``__found`` beside the targets' columns.

    pad takes the last at or before, backfill the first at or after, nearest the
    closer (the greater on a tie); within ``tolerance`` if given.  Both sides are
    put in one ordered stream and a window carries the last or next source along.
    Beyond small frames the stream is dealt out by range of ``by`` and key, once (a
    job), and each range takes over the nearest source before and after it, so
    neither one key nor all rows meet in one task.  A null key finds nothing.
    """
    method = {"ffill": "pad", "bfill": "backfill"}.get(method, method)
    by = list(by)
    s = sources.select(*by, F.col(key).alias("__k"), F.col(key).alias("__s"), F.lit(0).alias("__t")).distinct()
    t = targets.withColumn("__k", F.col(key)).withColumn("__t", F.lit(1))
    stream = s.unionByName(t, allowMissingColumns=True)
    whole = is_small(sources) and is_small(targets)
    if whole:
        part = by
    else:
        stream = dealt(stream, [*by, "__k", "__t"])
        part = [*by, "__part"]
    back = Window.partitionBy(*part).orderBy("__k", "__t").rowsBetween(Window.unboundedPreceding, 0)
    # Ahead is back in reverse order: a frame that ends unbounded is computed anew for each row.
    ahead = Window.partitionBy(*part).orderBy(F.col("__k").desc(), "__t").rowsBetween(Window.unboundedPreceding, 0)
    low, high = F.last("__s", ignorenulls=True).over(back), F.last("__s", ignorenulls=True).over(ahead)
    out = stream.withColumn("__low", low).withColumn("__high", high)
    if not whole:
        # One row for each range (of a key): its last and first source, and from these those of the ranges around it.
        ends = stream.groupBy(*part).agg(F.max("__s").alias("__last"), F.min("__s").alias("__first"))
        w, back = [Window.partitionBy(*by).orderBy(c).rowsBetween(Window.unboundedPreceding, -1) for c in (F.col("__part"), F.col("__part").desc())]
        around = ends.select(*[F.col(c).alias(f"__by{k}") for k, c in enumerate(by)], F.col("__part").alias("__p"), F.last("__last", ignorenulls=True).over(w).alias("__before"), F.last("__first", ignorenulls=True).over(back).alias("__after"))
        # Only keys that lie in several ranges take anything over; of ranges cut inside a key there are fewer than ranges.
        around = around.where(F.col("__before").isNotNull() | F.col("__after").isNotNull())
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__by{k}")) for k, c in enumerate(by)], F.col("__part") == F.col("__p"))
        out = out.join(F.broadcast(around), same, "left").withColumn("__low", F.coalesce("__low", "__before")).withColumn("__high", F.coalesce("__high", "__after"))
    numeric = dict(sources.dtypes)[key] in ("double", "float", "int", "bigint", "smallint", "tinyint") or dict(sources.dtypes)[key].startswith("decimal")
    gap = (lambda x, y: x - y) if numeric else (lambda x, y: F.timestamp_diff("MICROSECOND", y.cast("timestamp_ntz"), x.cast("timestamp_ntz")))
    k = F.col("__k")
    if method == "pad":
        found = F.col("__low")
    elif method == "backfill":
        found = F.col("__high")
    else:
        nearer_low = F.col("__high").isNull() | (gap(k, F.col("__low")) < gap(F.col("__high"), k))
        found = F.when(F.col("__low").isNotNull() & nearer_low, F.col("__low")).otherwise(F.col("__high"))
    found = F.when(k.isNotNull(), found)
    if tolerance is not None:
        limit = tolerance if numeric else int(tolerance.total_seconds() * 1e6)
        found = F.when(F.abs(gap(k, found)) <= limit, found)
    return out.where("__t = 1").withColumn("__found", found).select(*targets.columns, "__found")


def reindex(cube: Cube, method: str | None = None, tolerance: Any = None, fill_value: Any = None, **labels: DataFrame | Sequence[Any]) -> Cube:
    """Conform to new labels; those without cells are missing, or take a neighbour's by ``method``."""
    for dim, new in labels.items():
        wanted = new if isinstance(new, DataFrame) else cube.frame.sparkSession.createDataFrame([(x,) for x in new], cube.frame.select(dim).schema)
        rest = cube.rest(dim)
        if method:
            wanted = asof(wanted, cube.labels(dim), dim, method, tolerance)
            facts = cube.frame.withColumnRenamed(dim, "__found")
            frame = wanted.join(facts, "__found", "left").drop("__found")
        else:
            frame = wanted.join(cube.frame, dim, "left")
        if rest:
            # A label without any cell has no other keys; it stays in the spine.
            frame = frame.where(reduce(lambda a, b: a & b, [F.col(d).isNotNull() for d in rest]))
        cube = replace(cube.with_frame(frame), spines={**cube.spines, dim: wanted.select(dim)}, orders={d: f for d, f in cube.orders.items() if d != dim})
    return cube.densify().fillna(fill_value) if fill_value is not None else cube


def reindex_like(cube: Cube, other: Cube, method: str | None = None, tolerance: Any = None, fill_value: Any = None) -> Cube:
    return reindex(cube, method, tolerance, fill_value, **{d: other.labels(d) for d in cube.dims if d in other.dims})


def broadcast(a: Cube, b: Cube) -> tuple[Cube, Cube]:
    """Both cubes over the union of their dimensions."""
    a, b = align(a, b, join="outer")

    def widen(c: Cube, o: Cube) -> Cube:
        frame = c.frame
        for d in o.dims:
            if d not in c.dims:
                frame = frame.crossJoin(o.labels(d))
        return c.with_frame(frame, dims=[*c.dims, *[d for d in o.dims if d not in c.dims]])

    return widen(a, b), widen(b, a)


def merge(*cubes: Cube, compat: str = "no_conflicts", join: str = "outer") -> Cube:
    """One cube with all variables, joined on the dimensions that the cubes have in common.

    Of variables with one name: no_conflicts needs equal values where both are
    present and takes either; equals and identical need equal cells; override
    takes the first.  The check is one job.
    """
    how = {"inner": "inner", "outer": "full", "left": "left", "right": "right"}

    def two(a: Cube, b: Cube) -> Cube:
        keys = [d for d in a.dims if d in b.dims]
        both_names = [n for n in b.names if n in a.names]
        right = b.frame.select(*b.dims, *[F.col(n).alias(f"__{n}") if n in both_names else F.col(n) for n in b.names])
        if join == "exact":
            align(a, b, join="exact")
        frame = a.frame.select(*a.dims, *a.names).join(right, keys, how.get(join, "inner")) if keys else a.frame.crossJoin(right)
        if both_names and compat != "override":
            differ = [(F.col(n) != F.col(f"__{n}")) if compat in ("no_conflicts", "minimal") else ~F.col(n).eqNullSafe(F.col(f"__{n}")) for n in both_names]
            if compat == "minimal":
                clash = [n for n, c in zip(both_names, differ) if not frame.where(c).isEmpty()]
                frame = frame.drop(*clash, *[f"__{n}" for n in clash])
                both_names = [n for n in both_names if n not in clash]
            elif not frame.where(reduce(lambda x, y: x | y, differ)).isEmpty():
                raise ValueError(f"variables {both_names} conflict")
        frame = frame.withColumns({n: F.coalesce(F.col(n), F.col(f"__{n}")) for n in both_names}).drop(*[f"__{n}" for n in both_names]) if both_names else frame
        dims = [*a.dims, *[d for d in b.dims if d not in a.dims]]
        return Cube(frame, tuple(dims), tuple(c for c in frame.columns if c not in dims), {}, merge_attrs([a.attrs, b.attrs], "override"))

    return reduce(two, cubes)


def merge_attrs(attrs: Sequence[Mapping[str, Any]], how: str = "override") -> dict[str, Any]:
    """Attributes of several cubes as one: drop, override, no_conflicts, drop_conflicts or identical."""
    if how == "drop" or not attrs:
        return {}
    if how == "override":
        return dict(attrs[0])
    if how == "identical":
        if any(dict(a) != dict(attrs[0]) for a in attrs):
            raise ValueError("attributes differ")
        return dict(attrs[0])
    out: dict[str, Any] = {}
    clash = set()
    for a in attrs:
        for k, v in a.items():
            if k in out and out[k] != v:
                clash.add(k)
            out.setdefault(k, v)
    if clash and how == "no_conflicts":
        raise ValueError(f"attributes {sorted(clash)} conflict")
    return {k: v for k, v in out.items() if k not in clash}


def update(cube: Cube, other: Cube) -> Cube:
    """Overwrite with the other's variables, on this cube's labels."""
    keys = [d for d in cube.dims if d in other.dims]
    kept = cube.frame.drop(*[n for n in other.names if n in cube.names])
    names = [*[n for n in cube.names if n not in other.names], *other.names]
    return cube.with_frame(kept.join(other.frame.select(*other.dims, *other.names), keys, "left"), names=names)


def combine_first(a: Cube, b: Cube) -> Cube:
    """Outer join; the first cube's values win where present."""
    return merge_values(a, b, lambda x, y: F.coalesce(x, y))


def merge_values(a: Cube, b: Cube, pick: Callable[[Column, Column], Column]) -> Cube:
    names = list(dict.fromkeys([*a.names, *b.names]))
    left = a.frame.select(*a.dims, *[F.col(n).alias(f"a_{n}") for n in a.names])
    right = b.frame.select(*b.dims, *[F.col(n).alias(f"b_{n}") for n in b.names])
    both = left.join(right, list(a.dims), "full")
    col = lambda s, c, n: F.col(f"{s}_{n}") if n in c.names else F.lit(None)
    return Cube(both.select(*a.dims, *[pick(col("a", a, n), col("b", b, n)).alias(n) for n in names]), a.dims, tuple(names), {}, a.attrs)


def concat(cubes: Sequence[Cube], dim: str, labels: Sequence[Any] | None = None, join: str = "outer") -> Cube:
    """Union along a dimension; with ``labels`` along a new one."""
    if labels is not None:
        parts = [c.frame.withColumn(dim, F.lit(x)) for c, x in zip(cubes, labels, strict=True)]
        dims = (dim, *cubes[0].dims)
    else:
        if join in ("inner", "exact"):
            cubes = align(*cubes, join=join, exclude=[dim])
        parts, dims = [c.frame for c in cubes], cubes[0].dims
    frame = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = list(dict.fromkeys(n for c in cubes for n in c.names))
    return Cube(frame.select(*dims, *names), tuple(dims), tuple(names), {}, cubes[0].attrs)


def combine_nested(nested: Sequence, dims: Sequence[str]) -> Cube:
    """Nested lists of cubes, joined along one dimension for each level."""
    if not dims:
        return nested
    return concat([combine_nested(x, dims[1:]) for x in nested], dims[0]) if len(dims) else nested


def combine_by_coords(cubes: Sequence[Cube], dim: str) -> Cube:
    """Order cubes by their first label along ``dim`` (one small job for each), check that they don't overlap, and join them."""
    spans = [tuple(c.labels(dim).agg(F.min(dim), F.max(dim)).first()) for c in cubes]
    order = sorted(range(len(cubes)), key=lambda k: spans[k])
    if any(spans[a][1] >= spans[b][0] for a, b in zip(order, order[1:])):
        raise ValueError(f"labels along {dim} overlap")
    return concat([cubes[k] for k in order], dim)
