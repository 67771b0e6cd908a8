"""Column expressions: demographics, stages, regimens, responses, biomarkers, dates. All are built-ins."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import codes


def _cases(pairs: Iterable[tuple[Column, str | Column]], default: Column) -> Column:
    pairs = [(c, v if isinstance(v, Column) else F.lit(v)) for c, v in pairs]
    if not pairs:
        return default
    first, *rest = pairs
    return reduce(lambda acc, p: acc.when(*p), rest, F.when(*first)).otherwise(default)


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def state_code(state: Column) -> Column:
    """Two-letter code of a valid code or full state name, else null."""
    trimmed = F.trim(state)
    code = F.upper(trimmed)
    names = _map({name.lower(): c for c, name in codes.STATES.items()})
    return F.when(code.isin(list(codes.STATES)), code).otherwise(F.try_element_at(names, F.lower(trimmed)))


def gender(value: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(codes.GENDERS), F.lower(F.trim(value))), F.lit("Unknown"))


def insurance_type(value: Column) -> Column:
    text = F.lower(F.trim(value))
    return F.when(value.isNull(), "Unknown").otherwise(_cases([(text.contains(k), v) for k, v in codes.INSURANCES], F.lit("Other")))


def race_ethnicity(value: Column) -> Column:
    text = F.lower(F.trim(value))
    return F.when(value.isNull(), "Unknown").otherwise(_cases([(text.contains(k), v) for k, v in codes.RACES], F.lit("Unknown")))


def urban_rural(zip5: Column) -> Column:
    """By the first three digits; anything but five digits is Unknown."""
    prefix = F.substring(zip5, 1, 3).try_cast("int")
    within = lambda ranges: reduce(Column.__or__, [prefix.between(a, b) for a, b in ranges])
    return F.when(zip5.rlike("^[0-9]{5}$"), _cases([(within(codes.URBAN), "Urban"), (within(codes.SUBURBAN), "Suburban")], F.lit("Rural"))).otherwise("Unknown")


def age(born: Column, today: Column) -> Column:
    return F.floor(F.datediff(today, born) / 365.25).cast("int")


def date_key(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd").cast("int")


def key(*parts: Column) -> Column:
    """Deterministic key of natural key parts; a null part counts as a mark of its own."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts]), 256)


def state_name(code: Column) -> Column:
    """The name of a state's code; null for others."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in codes.STATES.items() for x in pair]), code)


def stage(value: Column) -> Column:
    """LS-SCLC or ES-SCLC by whole words, limited first; else Unknown."""
    text = F.lower(F.coalesce(value, F.lit("")))
    limited = text.rlike(r"\blimited\b|\bls(-sclc)?\b|\bi{1,3}[abc]?\b")
    extensive = text.rlike(r"\bextensive\b|\bes(-sclc)?\b|\biv[abc]?\b")
    return _cases([(limited, "LS-SCLC"), (extensive, "ES-SCLC")], F.lit("Unknown"))


def stage_legacy(value: Column) -> Column:
    """The loose patterns, for parity: parts of words count."""
    text = F.lower(F.coalesce(value, F.lit("")))
    return _cases([(text.rlike("limited|ls|i$|ii$|iii$"), "LS-SCLC"), (text.rlike("extensive|es|iv"), "ES-SCLC")], F.lit("Unknown"))


def regimen_category(chemo: Column, immuno: Column, targeted: Column, radiation: Column) -> Column:
    return _cases([(chemo & immuno, "Chemo+IO"), (immuno, "IO Monotherapy"), (targeted, "Targeted Therapy"), (chemo, "Chemo Only"), (radiation, "Radiation")], F.lit("Other"))


def line_label(line: Column) -> Column:
    return _cases([(line == 1, "1st line"), (line == 2, "2nd line")], F.lit("3rd line+"))


def response(value: Column) -> Column:
    """CR, PR, SD, PD or NE: exact names first, then words, else NE."""
    text = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.coalesce(F.try_element_at(_map(codes.RESPONSES), text), _cases([(text.contains(k), v) for k, v in codes.RESPONSE_WORDS.items()], F.lit("NE")))


def response_rank(value: Column) -> Column:
    return _cases([(value == r, F.lit(k + 1)) for k, r in enumerate(codes.RESPONSE_ORDER)], F.lit(5))


def biomarker_positive(kind: Column, number: Column, note: Column) -> Column:
    """By the number where there is one, else by the note; null for other kinds."""
    text = F.lower(F.coalesce(note, F.lit("")))
    return _cases(
        [
            (kind == "PD-L1", F.coalesce(number >= 1, text.rlike("positive|high"))),
            (kind == "TMB", F.coalesce(number >= 10, text.rlike("high"))),
            (kind == "NGS", text.rlike("positive|mutation.*detected|pathogenic")),
        ],
        F.lit(None).cast("boolean"),
    )


def ttt_bucket(days: Column) -> Column:
    return _cases([(days.between(a, b), label) for label, a, b, _ in codes.BUCKETS], F.lit(None).cast("string"))


def rate(part: Column, whole: Column, places: int = 2) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole, places)).otherwise(F.lit(0.0))


def median(column: str) -> Column:
    """The exact lower median of a column, by name."""
    return F.expr(f"cast(percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}`) AS double)")


def upper_median(column: str) -> Column:
    """The exact upper median: of an even number of values the larger middle one."""
    return F.expr(f"cast(-percentile_disc(0.5) WITHIN GROUP (ORDER BY -`{column}`) AS double)")
