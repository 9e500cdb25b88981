"""Quality masks of satellite products, as predicates on their QA columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def qa_value_ok(qa: Column, threshold: float = 0.5) -> Column:
    return qa >= threshold


def aerosol_qa_ok(qa: Column) -> Column:
    """Cloud field says clear and adjacency field is zero."""
    return (qa.bitwiseAND(F.lit(0x07)) == 1) & (qa.bitwiseAND(F.lit(0x0F00)) == 0)


def fire_confidence_ok(code: Column, level: str = "nominal") -> Column:
    """Fixed confidence codes of the two fire products: high 2 and 104; low 0 and 108."""
    if level == "high":
        return code.isin(2, 104)
    if level == "nominal":
        return ~code.isin(0, 108)
    if level == "low":
        return F.lit(True)
    raise ValueError(f"unknown confidence level: {level}")


def _bits_clear(qa: Column, bits: tuple[int, ...]) -> Column:
    return qa.bitwiseAND(F.lit(sum(1 << b for b in bits))) == 0


def optical_clear(qa: Column) -> Column:
    """Opaque cloud (bit 10) and cirrus (bit 11) are both off."""
    return _bits_clear(qa, (10, 11))


def optical_reflectance(band: Column) -> Column:
    return band / F.lit(10000.0)


def surface_clear(qa: Column) -> Column:
    """Cloud, shadow and snow bits (3, 4, 5) are all off."""
    return _bits_clear(qa, (3, 4, 5))
