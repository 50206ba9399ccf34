"""Conventions for stored variables: fill values, packing, units of time, flags, characters."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from cubeweave.cube import Cube
from cubeweave.functions.dates import MICROS, from_us, us

#: Unit names in time attributes.
UNITS = {"microseconds": "us", "milliseconds": "ms", "seconds": "s", "second": "s", "minutes": "min", "minute": "min", "hours": "h", "hour": "h", "days": "D", "day": "D", "weeks": "W"}


def decode_mask(x: Column, attrs: Mapping[str, Any]) -> Column:
    fills = [attrs[k] for k in ("_FillValue", "missing_value") if k in attrs]
    return F.when(~x.isin(fills), x) if fills else x


def decode_scale(x: Column, attrs: Mapping[str, Any]) -> Column:
    """Stored number to value: times the factor, plus the offset; always a double."""
    if "scale_factor" not in attrs and "add_offset" not in attrs:
        return x
    return x.cast("double") * float(attrs.get("scale_factor", 1.0)) + float(attrs.get("add_offset", 0.0))


def encode_scale(x: Column, attrs: Mapping[str, Any], kind: str = "int") -> Column:
    """Value to stored number, rounded half to even; missing becomes the fill value."""
    packed = (x - float(attrs.get("add_offset", 0.0))) / float(attrs.get("scale_factor", 1.0))
    out = F.rint(packed).cast(kind)
    return F.coalesce(out, F.lit(attrs["_FillValue"]).cast(kind)) if "_FillValue" in attrs else out


def _time_units(text: str) -> tuple[int, str]:
    m = re.fullmatch(r"\s*(\w+)\s+since\s+(.+?)\s*", text)
    if not m or m[1] not in UNITS:
        raise ValueError(f"no time units: {text}")
    return MICROS[UNITS[m[1]]], m[2].replace("T", " ").removesuffix("Z")


def decode_time(x: Column, units: str) -> Column:
    """``"days since 2000-01-01"`` numbers to timestamps."""
    step, start = _time_units(units)
    return from_us(us(F.lit(start).cast("timestamp_ntz")) + F.rint(x.cast("double") * step).cast("bigint"))


def encode_time(x: Column, units: str) -> Column:
    step, start = _time_units(units)
    return (us(x) - us(F.lit(start).cast("timestamp_ntz"))) / step


def decode_duration(x: Column, units: str) -> Column:
    """Numbers with a unit to microseconds."""
    return F.rint(x.cast("double") * MICROS[UNITS[units]]).cast("bigint")


def encode_duration(x: Column, units: str) -> Column:
    return x / MICROS[UNITS[units]]


def decode_bool(x: Column) -> Column:
    return x.cast("boolean")


def encode_bool(x: Column) -> Column:
    return x.cast("tinyint")


def decode_enum(x: Column, meanings: Mapping[int, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for kv in meanings.items() for v in kv]), x)


def join_characters(x: Column) -> Column:
    """An array of characters to a string, without trailing zero bytes."""
    return F.rtrim(F.array_join(x, ""), F.lit("\x00"))


def split_characters(x: Column, width: int) -> Column:
    return F.split(F.rpad(x, width, "\x00"), "")


def decode_cf(cube: Cube, mask_and_scale: bool = True, decode_times: bool = True) -> Cube:
    """All decoders that the variables' attributes ask for, in order: mask, scale, time, flags, booleans."""
    out: dict[str, Column] = {}
    for n in cube.names:
        attrs, x = cube.var_attrs.get(n, {}), F.col(n)
        if mask_and_scale:
            x = decode_scale(decode_mask(x, attrs), attrs)
        units = str(attrs.get("units", ""))
        if decode_times and " since " in units:
            x = decode_time(x, units)
        if attrs.get("dtype") == "bool":
            x = decode_bool(x)
        if "flag_values" in attrs and "flag_meanings" in attrs:
            x = decode_enum(x, dict(zip(attrs["flag_values"], str(attrs["flag_meanings"]).split())))
        out[n] = x
    if decode_times:
        out |= {d: decode_time(F.col(d), str(a["units"])) for d in cube.dims if " since " in str((a := cube.var_attrs.get(d, {})).get("units", ""))}
    return cube.with_frame(cube.frame.withColumns(out))
