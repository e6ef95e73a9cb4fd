"""Numeric helpers: tolerant comparison and guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanlake.functions.text import strip

# Fixed value: absolute tolerance when both texts are numbers.
TOLERANCE = 1e-3


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 when whole is 0 or null."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def matches(left: Column, right: Column) -> Column:
    """Numbers equal within the tolerance, otherwise texts equal without case."""
    difference = F.abs(left.try_cast("double") - right.try_cast("double"))
    return F.coalesce(difference < TOLERANCE, F.lower(strip(left)) == F.lower(strip(right)))


def calculate(operation: Column, left: Column, right: Column) -> Column:
    """Result of add, subtract, multiply, divide, exp (power) or greater (1 or 0); null for anything else."""
    return (
        F.when(operation == "add", left + right)
        .when(operation == "subtract", left - right)
        .when(operation == "multiply", left * right)
        .when(operation == "divide", F.try_divide(left, right))
        .when(operation == "exp", F.pow(left, right))
        .when(operation == "greater", (left > right).cast("double"))
    )
