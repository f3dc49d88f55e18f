"""Name weights and the lookup."""

import pytest

from helpers import by, names, payroll
from wagelens.operators.names import (
    UNMATCHED_DROP,
    UNMATCHED_KEEP,
    UNMATCHED_ZERO,
    attach_weights,
    name_sex_counts,
    name_spread,
    name_weights,
    weights_from_spread,
)


@pytest.fixture
def reg(spark):
    return names(
        spark,
        [
            ("NY", "F", 2000, "Mary", 3),
            ("NY", "F", 2001, "MARY", 2),
            ("NJ", "M", 2000, "Mary", 1),
            ("NY", "F", 2000, "ANN", 4),  # one-sex name
            ("NY", "M", 2000, "JOHN", 2),
            ("NJ", "M", 1999, "JOHN", 3),
            ("NY", "M", 2003, "JOHN", 5),  # several years and states: one summed row
            ("NY", "X", 2000, "ZED", 3),  # no F or M registrations: weights undefined
        ],
    )


def test_counts_merge_case_variants(spark, reg):
    got = by(name_sex_counts(reg), "name", "sex")
    assert got[("MARY", "F")]["count"] == 5
    assert got[("MARY", "M")]["count"] == 1
    assert got[("JOHN", "M")]["count"] == 10
    assert ("Mary", "F") not in got


def test_spread_fills_missing_sex_with_zero(spark, reg):
    got = by(name_spread(name_sex_counts(reg)), "name")
    assert (got["ANN"]["F"], got["ANN"]["M"]) == (4, 0)
    assert (got["JOHN"]["F"], got["JOHN"]["M"]) == (0, 10)


def test_weights(spark, reg):
    got = by(name_weights(reg), "name")
    assert got["MARY"]["M_weight"] == pytest.approx(1 / 6)
    assert got["MARY"]["F_weight"] == pytest.approx(5 / 6)
    assert (got["ANN"]["M_weight"], got["ANN"]["F_weight"]) == (0.0, 1.0)
    assert got["ZED"]["M_weight"] is None and got["ZED"]["F_weight"] is None


def test_fused_weights_equal_spread_path(spark, reg):
    a = sorted(tuple(r) for r in name_weights(reg).collect())
    b = sorted(tuple(r) for r in weights_from_spread(name_spread(name_sex_counts(reg))).select("name", "F", "M", "M_weight", "F_weight").collect())
    assert a == b


@pytest.fixture
def staff(spark):
    return payroll(
        spark,
        [
            (2020, "A", "T", "MARY", 100, 1),
            (2020, "A", "T", "Mary", 100, 1),  # case-sensitive lookup: no match
            (2020, "A", "T", "JOHN", 100, 1),
            (2020, "A", "T", "ZED", 100, 1),  # weights undefined: unmatched
            (2020, "A", "T", None, 100, 1),  # NULL name never matches
        ],
    )


@pytest.mark.parametrize("max_rows", [1_000_000, None])
def test_lookup_policies(spark, reg, staff, max_rows):
    w = name_weights(reg)
    keep = attach_weights(staff, w, UNMATCHED_KEEP, max_broadcast_rows=max_rows).collect()
    assert len(keep) == 5
    assert sum(r.Male is None for r in keep) == 3
    drop = attach_weights(staff, w, UNMATCHED_DROP, max_broadcast_rows=max_rows).collect()
    assert sorted(r.first_name for r in drop) == ["JOHN", "MARY"]
    zero = attach_weights(staff, w, UNMATCHED_ZERO, max_broadcast_rows=max_rows).collect()
    assert len(zero) == 5
    for r in zero:
        matched = r.first_name in ("MARY", "JOHN")
        assert (r.Common, r.Uncommon) == ((1, 0) if matched else (0, 1))
        if not matched:
            assert (r.Male, r.Female) == (0.0, 0.0)
