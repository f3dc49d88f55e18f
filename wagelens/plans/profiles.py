"""Report profiles: the two published script versions, and the same two mapped onto the test tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from ..operators.names import UNMATCHED_DROP, UNMATCHED_ZERO

# Fixed value: the key text of the all-agencies / all-titles row.
CITY_LABEL = "CITY OF NEW YORK (ALL AGENCIES / TITLES)"


@dataclass(frozen=True)
class Profile:
    """Everything that differs between report runs.

    ``years``            fiscal years reported; the last one is the base year for money and the
                         year of the one-year tables.
    ``cpi_month``        month of the price index used for every year.
    ``unmatched``        'drop': employees whose name has no weight are left out everywhere;
                         'zero': they stay with zero weights and count as uncommon names.
    ``min_group_*``      a key is shown in chart and one-year reports only with more rows than this.
    ``city_scope``       'all': citywide row computed before the group-size threshold; 'kept': after.
    ``strict_nulls``     one missing amount makes a group's mean or total missing (as published);
                         False leaves missing amounts out, with their weights.
    ``max_broadcast_rows`` largest name-weights table that is broadcast (row count is checked).
    """

    name: str
    years: tuple[int, ...]
    cpi_month: int
    unmatched: str
    min_group_agency: int = 200
    min_group_title: int = 200
    city_scope: str = "all"
    city_label: str = CITY_LABEL
    max_broadcast_rows: int = 1_000_000
    strict_nulls: bool = True

    @property
    def base_year(self) -> int:
        return max(self.years)

    def with_(self, **changes) -> "Profile":
        return replace(self, **changes)


# The two published versions: 2014-2020 with the June index, unmatched names dropped; and
# 2014-2021 with the November index, unmatched names kept as "uncommon".
V2020 = Profile("v2020", tuple(range(2014, 2021)), cpi_month=6, unmatched=UNMATCHED_DROP)
V2022 = Profile("v2022", tuple(range(2014, 2022)), cpi_month=11, unmatched=UNMATCHED_ZERO)

# The same two on the generated test tables: ship years 1995-2001 (whose last year has an index
# value for June, but none for November, so both versions take June); the agency threshold lets
# some agencies of the last year pass and some not, and job titles are fewer rows per group, so
# their threshold is 40.
STAR_V2020 = Profile("star_v2020", tuple(range(1995, 2002)), cpi_month=6, unmatched=UNMATCHED_DROP, min_group_agency=205, min_group_title=40)
STAR_V2022 = Profile("star_v2022", tuple(range(1995, 2002)), cpi_month=6, unmatched=UNMATCHED_ZERO, min_group_agency=205, min_group_title=40)


def passing(profile: Profile) -> Profile:
    """A threshold that half of the agencies pass in the last year of the test tables (sf0.01), one of the others by equality."""
    return profile.with_(min_group_agency=LOW_AGENCY_THRESHOLD)


LOW_AGENCY_THRESHOLD = 170
