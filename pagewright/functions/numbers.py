"""Numbers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column, places: int = 0) -> Column:
    """To so many decimal places by a number's exact binary value, ties to the even neighbour: 2.675 is 2.67 (it lies below its
    decimal text) and 0.125 is 0.12, where the built-in ``round`` rounds the text half up. Up to seven places."""
    scale = float(10**places)
    x = c.cast("double")
    product = x * scale
    whole = F.floor(product).cast("double")
    rest = product - whole
    # the product's own rounding error, exactly: x in two halves of 26 bits, the scale has no more than 24
    high = x * 134217729.0 - (x * 134217729.0 - x)
    error = (high * scale - product) + (x - high) * scale
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (F.pmod(whole, F.lit(2.0)) == 1))))
    return F.when(F.abs(product) < 4503599627370496.0, (whole + up.cast("double")) / scale).otherwise(x)
