"""Arithmetic with the float rules of array libraries: no errors, NaN and infinities instead of nulls."""

from pyspark.sql import functions as F

from busfleet.functions.bits import _n

NAN, INF = float("nan"), float("inf")


def divide(a, b):
    """a / b; division by zero gives NaN or an infinity."""
    a, b = _n(a).cast("double"), _n(b).cast("double")
    return F.when(a.isNull() | b.isNull(), None).when(b != 0, a / F.nullif(b, F.lit(0.0))).when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))


def _logarithm(f):
    def of(x):
        x = _n(x).cast("double")
        return F.when(x > 0, f(x)).when(x == 0, F.lit(-INF)).when(x.isNotNull(), F.lit(NAN))

    return of


MATH = {
    "sqrt": lambda x: F.sqrt(_n(x).cast("double")), "abs": lambda x: F.abs(_n(x)), "log10": _logarithm(F.log10), "ln": _logarithm(F.ln),
    "exp": lambda x: F.exp(_n(x)), "sin": lambda x: F.sin(_n(x)), "cos": lambda x: F.cos(_n(x)), "tan": lambda x: F.tan(_n(x)),
}
COMBINE = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": divide,
    "max": lambda a, b: F.greatest(a, b), "min": lambda a, b: F.least(a, b),
}
COMPARE = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


def truncate(x, decimals):
    """Drops digits behind ``decimals``, towards zero."""
    k = 10.0**decimals
    v = _n(x).cast("double") * k
    return F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("double") / k


def round_even(x, decimals):
    """Rounds halves to the even digit."""
    return F.bround(_n(x).cast("double"), decimals)


def transform(x, step):
    """One transform of a derived signal: (name, arguments...).

    scale k, offset k, abs, clamp low high, round n, truncate n, math name,
    conditional (op, threshold, (k1, o1), (k2, o2)): k1 * x + o1 where x op threshold, else k2 * x + o2.
    """
    name, *args = step
    x = _n(x)
    if name == "scale":
        return x * float(args[0])
    if name == "offset":
        return x + float(args[0])
    if name == "clamp":
        return F.least(F.greatest(x, F.lit(float(args[0]))), F.lit(float(args[1])))
    if name == "round":
        return round_even(x, int(args[0]))
    if name == "truncate":
        return truncate(x, int(args[0]))
    if name == "conditional":
        op, threshold, (k1, o1), (k2, o2) = args
        return F.when(COMPARE[op](x, F.lit(float(threshold))), x * float(k1) + float(o1)).otherwise(x * float(k2) + float(o2))
    return MATH[args[0] if name == "math" else name](x)
