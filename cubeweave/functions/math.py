"""Element-wise functions with IEEE results where ANSI mode would raise or give NULL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_nan = lambda: F.lit(float("nan"))
_inf = lambda: F.lit(float("inf"))


def _c(x: Column | float | int | str) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def nn(x: Column) -> Column:
    """NaN as NULL."""
    return F.when(~F.isnan(x), x)


def signbit(x: Column) -> Column:
    """Whether the sign is minus; that of -0.0 is."""
    x = _c(x).cast("double")
    return (x < 0) | ((x == 0) & x.cast("string").startswith("-"))


def whole(x: Column, rounded: Callable[[Column], Column]) -> Column:
    """Rounding to whole numbers; a double of 2**52 or more is one, and bigint couldn't hold it."""
    x = _c(x).cast("double")
    return F.when(F.abs(x) < 2.0**52, rounded(x).cast("double")).otherwise(x)


def divide(a: Column, b: Column) -> Column:
    """Float division: by zero gives an infinity of the signs' product, or NaN for 0/0."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    at_zero = F.when((a == 0) | F.isnan(a), _nan()).when((a > 0) == ~signbit(b), _inf()).when(a.isNotNull(), -_inf())
    return F.when(b == 0, at_zero).otherwise(a / F.nullif(b, F.lit(0.0)))


def ratio(a: Column, b: Column) -> Column:
    """Division for aggregates: missing where the divisor is zero."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def floordiv(a: Column, b: Column) -> Column:
    """How often the divisor goes into what :func:`mod` leaves of ``a``; by zero as :func:`divide`."""
    a, b = _c(a), _c(b)
    rest = F.try_mod(a, b)
    times = divide(a - rest, b) - F.when((rest != 0) & ((rest < 0) != (b < 0)), 1.0).otherwise(0.0)
    return F.when(b == 0, divide(a, b)).otherwise(whole(times, F.rint))


def mod(a: Column, b: Column) -> Column:
    """Remainder with the divisor's sign, missing for a divisor of zero; exact for whole numbers of 64 bits."""
    rest = F.try_mod(_c(a), _c(b))
    return F.when((rest != 0) & ((rest < 0) != (_c(b) < 0)), rest + _c(b)).otherwise(rest).cast("double")


def fmod(a: Column, b: Column) -> Column:
    """Remainder with the dividend's sign."""
    return F.try_mod(_c(a), _c(b))


def log(x: Column, base: Callable[[Column], Column] = F.ln) -> Column:
    """Logarithm: minus infinity at 0, missing below."""
    x = _c(x)
    return F.when(x == 0, -_inf()).when(x > 0, base(x))


def round_half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def _binade(x: Column) -> Column:
    """The greatest power of two that is at most x > 0; the logarithm may be one off beside powers of two."""
    guess = F.pow(F.lit(2.0), F.least(F.greatest(F.floor(F.log2(x)), F.lit(-1074)), F.lit(1023)))
    return F.when(guess > x, guess / 2).when(guess * 2 <= x, guess * 2).otherwise(guess)


def _ulp(x: Column) -> Column:
    """Distance from x >= 0 to the next greater double."""
    return F.when(x == 0, F.lit(5e-324)).otherwise(F.greatest(_binade(F.when(x > 0, x)) * 2.0**-52, F.lit(5e-324)))


def spacing(x: Column) -> Column:
    """Distance to the next double of greater magnitude, with the sign of ``x``; infinite for the greatest double, NaN for infinities."""
    x = _c(x).cast("double")
    size = F.when(F.isnan(x) | (F.abs(x) == float("inf")), _nan()).when(F.abs(x) == 1.7976931348623157e308, F.lit(float("inf"))).otherwise(_ulp(F.abs(x)))
    return F.when(x < 0, -size).otherwise(size)


def nextafter(a: Column, b: Column) -> Column:
    """The next double from ``a`` towards ``b``."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    up, size = b > a, F.abs(a)
    most = 1.7976931348623157e308
    # Towards zero the step from a power of two is half as wide.
    below = F.when(size == float("inf"), F.lit(most)).when(size == _binade(F.when(size > 0, size)), size - F.greatest(_ulp(size) / 2, F.lit(5e-324))).otherwise(size - _ulp(size))
    above = F.when(size == most, _inf()).otherwise(size + _ulp(size))
    moved = F.when(size == 0, F.when(up, F.lit(5e-324)).otherwise(F.lit(-5e-324))).when((a > 0) == up, F.when(a > 0, above).otherwise(-above)).otherwise(F.when(a > 0, below).otherwise(-below))
    return F.when(F.isnan(a) | F.isnan(b), _nan()).when(a == b, b).when(a.isNotNull() & b.isNotNull(), moved)


def logaddexp(a: Column, b: Column) -> Column:
    """ln(exp(a) + exp(b)); equal ones, infinities too, have no difference to take."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    return F.when(a == b, a + F.ln(F.lit(2.0))).otherwise(F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b))))


def complex_(re: Column, im: Column) -> Column:
    return F.struct(_c(re).cast("double").alias("re"), _c(im).cast("double").alias("im"))


def conj(z: Column) -> Column:
    return complex_(z["re"], -z["im"])


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by Euclid's steps; 92 of them suffice for 64 bits."""
    start = F.struct(F.abs(_c(a).cast("bigint")).alias("x"), F.abs(_c(b).cast("bigint")).alias("y"))

    def step(s: Column, _: Column) -> Column:
        return F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.try_mod(s["x"], s["y"]).alias("y")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["x"])


def lcm(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(F.try_divide(_c(a), gcd(a, b)).cast("bigint") * _c(b)), F.lit(0).cast("bigint"))


def strict(pick: Callable[..., Column], a: Column, b: Column) -> Column:
    """greatest or least that is missing if either is."""
    a, b = _c(a), _c(b)
    return F.when(a.isNotNull() & b.isNotNull(), pick(a, b))


UNARY: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs, "absolute": F.abs, "fabs": F.abs, "acos": F.acos, "arccos": F.acos, "acosh": F.acosh, "arccosh": F.acosh, "asin": F.asin, "arcsin": F.asin,
    "asinh": F.asinh, "arcsinh": F.asinh, "atan": F.atan, "arctan": F.atan, "atanh": F.atanh, "arctanh": F.atanh, "bitwise_count": F.bit_count,
    "bitwise_invert": F.bitwise_not, "bitwise_not": F.bitwise_not, "invert": F.bitwise_not, "cbrt": F.cbrt, "ceil": lambda x: whole(x, F.ceil),
    "conj": conj, "conjugate": conj, "cos": F.cos, "cosh": F.cosh, "deg2rad": F.radians, "radians": F.radians, "rad2deg": F.degrees, "degrees": F.degrees,
    "exp": F.exp, "exp2": lambda x: F.pow(F.lit(2.0), x), "expm1": F.expm1, "floor": lambda x: whole(x, F.floor),
    "isfinite": lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)), "isinf": lambda x: F.coalesce(F.abs(x) == float("inf"), F.lit(False)),
    "isnan": lambda x: x.isNull() | F.isnan(x), "isnat": lambda x: x.isNull(), "log": log, "log10": lambda x: log(x, F.log10), "log1p": F.log1p,
    "log2": lambda x: log(x, F.log2), "logical_not": lambda x: ~(x.cast("double") != 0), "negative": lambda x: -x, "positive": lambda x: x,
    "reciprocal": lambda x: divide(F.lit(1.0), x), "rint": F.rint, "sign": F.signum, "signbit": signbit, "sin": F.sin, "sinh": F.sinh,
    "spacing": spacing, "sqrt": lambda x: F.sqrt(F.when(x >= 0, x)), "square": lambda x: x * x, "tan": F.tan, "tanh": F.tanh,
    "trunc": lambda x: whole(x, lambda y: F.when(y < 0, F.ceil(y)).otherwise(F.floor(y))), "angle": lambda z: F.atan2(z["im"], z["re"]),
    "isreal": lambda z: z["im"] == 0, "iscomplex": lambda z: z["im"] != 0, "real": lambda z: z["re"], "imag": lambda z: z["im"],
}
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": divide, "true_divide": divide, "floor_divide": floordiv,
    "remainder": mod, "mod": mod, "fmod": fmod, "power": F.pow, "pow": F.pow, "float_power": lambda a, b: F.pow(a.cast("double"), b.cast("double")),
    "arctan2": F.atan2, "atan2": F.atan2, "hypot": F.hypot, "bitwise_and": lambda a, b: a.bitwiseAND(b), "bitwise_or": lambda a, b: a.bitwiseOR(b),
    "bitwise_xor": lambda a, b: a.bitwiseXOR(b), "bitwise_left_shift": lambda a, b: F.call_function("shiftleft", a, b), "left_shift": lambda a, b: F.call_function("shiftleft", a, b),
    "bitwise_right_shift": lambda a, b: F.call_function("shiftright", a, b), "right_shift": lambda a, b: F.call_function("shiftright", a, b),
    "copysign": lambda a, b: F.abs(a) * F.when(signbit(b), -1).otherwise(1), "equal": lambda a, b: F.coalesce(a == b, F.lit(False)), "not_equal": lambda a, b: F.coalesce(a != b, F.lit(True)),
    "greater": lambda a, b: F.coalesce(a > b, F.lit(False)), "greater_equal": lambda a, b: F.coalesce(a >= b, F.lit(False)), "less": lambda a, b: F.coalesce(a < b, F.lit(False)),
    "less_equal": lambda a, b: F.coalesce(a <= b, F.lit(False)), "fmax": F.greatest, "fmin": F.least, "maximum": lambda a, b: strict(F.greatest, a, b),
    "minimum": lambda a, b: strict(F.least, a, b), "gcd": gcd, "lcm": lcm, "heaviside": lambda x, h: F.when(x < 0, 0.0).when(x == 0, h).when(x > 0, 1.0),
    "ldexp": lambda x, n: x * F.pow(F.lit(2.0), n), "logaddexp": logaddexp, "logaddexp2": lambda a, b: logaddexp(a * F.ln(F.lit(2.0)), b * F.ln(F.lit(2.0))) / F.ln(F.lit(2.0)),
    "logical_and": lambda a, b: (a.cast("double") != 0) & (b.cast("double") != 0), "logical_or": lambda a, b: (a.cast("double") != 0) | (b.cast("double") != 0),
    "logical_xor": lambda a, b: (a.cast("double") != 0) != (b.cast("double") != 0), "nextafter": nextafter,
}
