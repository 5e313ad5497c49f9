"""Rounding as the scores are defined: half to even on the exact binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkspan.functions.binding import once


def round_exact(x: Column, digits: int = 1) -> Column:
    """``x`` to ``digits`` (0 to 2) places; a tie goes to the even digit, and only a value that is a tie in binary is one.

    F.round rounds ties up and reads 0.15 as a tie, though the double lies below it. Here |x| = m / 2**e with whole m,
    and m * 10**digits is divided in whole numbers. Null stays null.
    """
    def rounded(x: Column) -> Column:
        size = F.abs(x)
        parts = lambda e: F.struct(((size * F.pow(F.lit(2.0), e)).cast("long") * F.lit(10**digits).cast("long")).alias("m"), F.call_function("shiftleft", F.lit(1).cast("long"), e).alias("whole"))

        def value(p: Column, r: Column) -> Column:
            q = ((p["m"] - r) / p["whole"]).cast("long")  # divides without remainder, so the quotient is exact
            up = (r > p["whole"] - r) | ((r == p["whole"] - r) & (F.pmod(q, F.lit(2)) == 1))
            return F.signum(x) * (q + up.cast("long")) / F.lit(float(10**digits))

        found = once((F.lit(53) - F.floor(F.log2(size))).cast("int"), lambda e: once(parts(e), lambda p: once(F.pmod(p["m"], p["whole"]), lambda r: value(p, r))))
        return F.when((size >= 2.0**52) | F.isnan(x), x).when(size < 2.0**-8, F.lit(0.0)).otherwise(found)

    return once(x.cast("double"), rounded)
