"""Scores and bands as column expressions."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tieweave.config import BAND_HIGH, BAND_LOW, BAND_MEDIUM, WEIGHTS


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 for an empty whole."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def value_score(overlap_ratio: Column, cover_a: Column, cover_b: Column, jaccard: Column) -> Column:
    return 0.40 * overlap_ratio + 0.35 * F.greatest(cover_a, cover_b) + 0.25 * jaccard


def string_score(categorical: Column, token: Column, overlap: Column, weak: Column) -> Column:
    score = 0.45 * categorical + 0.30 * token + 0.25 * overlap
    return F.round(F.when(weak, score * 0.5).otherwise(score), 4)


def type_score(decision: Column) -> Column:
    return (
        F.when(~decision["compatible"], F.lit(0.0))
        .when(decision["risk"] == "cast_required", F.lit(0.7))
        .otherwise(F.lit(1.0))
    )


def alignment(left: Column, right: Column) -> Column:
    """Closeness of two ratios; 0 when one of the profiles is missing."""
    return F.coalesce(F.greatest(F.lit(0.0), 1.0 - F.abs(left - right)), F.lit(0.0))


def confidence(
    name: Column,
    type_: Column,
    value: Column,
    uniqueness: Column,
    null: Column,
    weights: Mapping[str, float] = WEIGHTS,
) -> Column:
    return (
        weights["name"] * name
        + weights["type"] * type_
        + weights["value"] * value
        + weights["uniqueness"] * uniqueness
        + weights["null"] * null
    )


def band(
    score: Column, high: float = BAND_HIGH, medium: float = BAND_MEDIUM, low: float = BAND_LOW
) -> Column:
    return (
        F.when(score >= high, "high")
        .when(score >= medium, "medium")
        .when(score >= low, "low")
        .otherwise("reject")
    )


def response_band(score: Column, high: float = BAND_HIGH, medium: float = BAND_MEDIUM) -> Column:
    """Band of an edge read from a response; such edges are never rejected."""
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")
