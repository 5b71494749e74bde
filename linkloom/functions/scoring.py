"""Scoring factors as column expressions. All take the time of reference as
as_of, so that results do not change with the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ACCOUNT_TRACKING, DECISIVE_KINDS, DEFAULT_WEIGHT, SELECTOR_WEIGHTS, TRACKING_WEIGHTS, Config

CONFIG = Config()


def one_of(value: Column, table: dict[str, float], default: Column | None = None) -> Column:
    """Look a value up in a small fixed table."""
    out = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value)
    return out if default is None else F.coalesce(out, default)


def instant(text: Column) -> Column:
    """Timestamp of an ISO text: whole, its first 19 or its first 10 characters,
    whichever reads; without an offset it is UTC; else null."""
    text = F.trim(text)
    zoned = F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & (F.length(text) > 10), text)
    plain = F.concat(F.substring(text, 1, 19), F.lit("Z"))
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.concat(F.substring(text, 1, 10), F.lit("T00:00:00Z")))
    return F.coalesce(*[x.try_cast("timestamp") for x in (zoned, F.when(F.length(text) > 10, plain), day)])


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days, rounded down."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000.0))


def rarity(degree: Column, cfg: Config = CONFIG) -> Column:
    """1 for a value that fewer than two share, else 1 / log2, with a floor."""
    return F.when(F.coalesce(degree, F.lit(0)) < 2, F.lit(1.0)).otherwise(F.greatest(F.lit(cfg.rarity_floor), F.lit(1.0) / F.log2(degree.cast("double"))))


def overlap(a_first: Column, a_last: Column, b_first: Column, b_last: Column, cfg: Config = CONFIG) -> Column:
    """1 if two windows (timestamps) meet or an end is unknown, else less by the
    gap between them, with a floor. Windows given backwards are turned."""
    start = F.greatest(F.least(a_first, a_last), F.least(b_first, b_last))
    end = F.least(F.greatest(a_first, a_last), F.greatest(b_first, b_last))
    unknown = a_first.isNull() | a_last.isNull() | b_first.isNull() | b_last.isNull()
    return F.when(unknown | (start <= end), F.lit(1.0)).otherwise(F.greatest(F.lit(cfg.overlap_floor), F.lit(1.0) - days_between(start, end) / F.lit(cfg.gap_days)))


def recency(last: Column, as_of: Column, cfg: Config = CONFIG) -> Column:
    """1 while last (a timestamp) is recent or unknown, then down to a floor."""
    age = days_between(as_of, last)
    return F.when(last.isNull() | (age <= cfg.full_credit_days), F.lit(1.0)).otherwise(F.greatest(F.lit(cfg.recency_floor), F.lit(1.0) - (age - cfg.full_credit_days) / F.lit(cfg.decay_days)))


def base_weight(kind: Column, value: Column, weights: dict[str, float] | None = None) -> Column:
    """Weight of a kind; tracking ids are graded by the provider before the bar."""
    plain = one_of(kind, weights or SELECTOR_WEIGHTS, F.lit(DEFAULT_WEIGHT))
    return F.when(kind == "tracking_id", one_of(F.split_part(value, F.lit("|"), F.lit(1)), TRACKING_WEIGHTS, plain)).otherwise(plain)


def confidence(score: Column) -> Column:
    """0 to 100, never reached: 100 s / (s + 65), half to even."""
    s = F.greatest(F.lit(0.0), F.coalesce(score, F.lit(0.0)))
    return F.bround(F.lit(100.0) * s / (s + F.lit(65.0))).cast("int")


def is_decisive(kind: Column, attributing: Column, weight: Column) -> Column:
    return kind.isin(*DECISIVE_KINDS) & attributing & (weight >= 50)


def strength(score: Column, decisive: Column) -> Column:
    return F.when(decisive | (score >= 65), "strong").when(score >= 30, "moderate").otherwise("weak")


def degree_ceiling(kind: Column, value: Column, cfg: Config = CONFIG) -> Column:
    """Above so many entities a selector is noise; values bound to an account
    may cover more."""
    account = (kind == "site_verification") | ((kind == "tracking_id") & F.split_part(value, F.lit("|"), F.lit(1)).isin(*ACCOUNT_TRACKING))
    return F.when(account, F.lit(cfg.account_degree_ceiling)).otherwise(F.lit(cfg.degree_ceiling))


def certificate_status(not_before: Column, not_after: Column, as_of: Column) -> Column:
    """expired, not yet valid, or valid; null without an end."""
    return F.when(not_after.isNull(), None).when(not_after < as_of, "expired").when(not_before > as_of, "not yet valid").otherwise("valid")


def recency_note(factor: Column) -> Column:
    return F.when(factor < 0.85, "last seen long ago: weaker for the present")
