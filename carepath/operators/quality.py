"""Data-quality flags and expectations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flag_patients(df: DataFrame) -> DataFrame:
    """Adds _dq_valid and _dq_issues; no row is dropped. Valid: a name, a birth date, an age from 0 to 120."""
    age = F.col("age_at_processing")
    no_name = F.coalesce(F.length(F.trim("first_name")) == 0, F.lit(True)) | F.coalesce(F.length(F.trim("last_name")) == 0, F.lit(True))
    checks = {
        "missing_name": no_name,
        "missing_dob": F.col("date_of_birth").isNull(),
        "invalid_age": F.coalesce(~age.between(0, 120), F.lit(False)),
        "unknown_gender": F.coalesce(F.col("gender") == "Unknown", F.lit(True)),
        "missing_state": F.col("state").isNull(),
        "invalid_zip": ~F.coalesce(F.col("zip5").rlike("^[0-9]{5}$"), F.lit(False)),
    }
    issues = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    valid = ~no_name & F.col("date_of_birth").isNotNull() & F.coalesce(age.between(0, 120), F.lit(False))
    return df.withColumns({"_dq_valid": valid, "_dq_issues": issues})


@dataclass(frozen=True)
class Expectation:
    name: str
    violated: Column


class ExpectationError(ValueError):
    """Rows broke an expectation."""


def expect(df: DataFrame, *expectations: Expectation) -> DataFrame:
    """Count the rows that violate each expectation, in one pass; raise if there are any."""
    found = df.agg(*[F.count_if(e.violated).alias(e.name) for e in expectations]).first().asDict()
    broken = {k: v for k, v in found.items() if v}
    if broken:
        raise ExpectationError(f"violated: {broken}")
    return df
