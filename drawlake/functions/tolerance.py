"""Declared tolerance policies: midpoint target, admissible interval, check and residual."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: slack of the final interval check.
CHECK_SLACK = 1e-7


def _problem(dim: Column) -> Column:
    one_missing = dim["upper"].isNull() != dim["lower"].isNull()
    return (
        F.when(dim["nominal"].isNull() | (dim["nominal"] <= 0), "invalid_source_dimension_nominal")
        .when(one_missing | F.coalesce(dim["lower"] > dim["upper"], F.lit(False)), "invalid_source_dimension_tolerance")
    )


def target(dim: Column) -> Column:
    """Midpoint construction target; a radius and a bare nominal keep the nominal."""
    banded = dim["upper"].isNotNull() & (dim["kind"] != "radius")
    middle = dim["nominal"] + (dim["lower"] + dim["upper"]) / 2
    problem = F.coalesce(_problem(dim), F.when(banded & (middle <= 0), "nonpositive_source_tolerance_target"))
    return F.struct(
        F.when(problem.isNull(), F.when(banded, middle).otherwise(dim["nominal"])).alias("target"),
        F.when(problem.isNull() & banded, dim["nominal"] + dim["lower"]).alias("minimum"),
        F.when(problem.isNull() & banded, dim["nominal"] + dim["upper"]).alias("maximum"),
        problem.alias("problem"),
    )


def interval(dim: Column) -> Column:
    """Nominal with its admissible interval and no midpoint."""
    banded = dim["upper"].isNotNull() & (dim["kind"] != "radius")
    problem = F.coalesce(
        _problem(dim), F.when(banded & (dim["nominal"] + dim["upper"] <= 0), "invalid_source_dimension_interval")
    )
    return F.struct(
        F.when(problem.isNull(), dim["nominal"]).alias("nominal"),
        F.when(problem.isNull() & banded, dim["nominal"] + dim["lower"]).alias("minimum"),
        F.when(problem.isNull() & banded, dim["nominal"] + dim["upper"]).alias("maximum"),
        problem.alias("problem"),
    )


def inside(actual: Column, minimum: Column, maximum: Column) -> Column:
    return F.abs(actual).between(minimum - CHECK_SLACK, maximum + CHECK_SLACK)


def residual(actual: Column, minimum: Column, maximum: Column) -> Column:
    """Signed distance of the magnitude to the interval, zero inside."""
    return F.abs(actual) - F.least(F.greatest(F.abs(actual), minimum), maximum)


def directed_residual(actual: Column, value: Column, below: float, above: float) -> Column:
    """Signed distance to the interval around a value whose sign is a direction: a span the other way does not pass."""
    along = F.signum(value) * actual
    return along - F.least(F.greatest(along, F.abs(value) - below), F.abs(value) + above)
