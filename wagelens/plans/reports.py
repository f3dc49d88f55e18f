"""The reports (R0-R13) as compositions over one measure cube.

Plan shape: the payroll is filtered and scanned once into the cube (one shuffle of partially
aggregated rows); every report is a small aggregate of the cube by agency or title, a citywide
row, a broadcast join with the per-year index, and a pivot. Text and wide layout come last.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import gap
from ..functions.text import percent_text, with_dollar_texts
from ..operators.adjust import index_values, restate_columns
from ..operators.aggregates import mean_from_sums, measure_cube, rollup, total_from_sums, weighted_from_sums
from ..operators.filters import eligible
from ..operators.names import UNMATCHED_ZERO, name_weights
from ..operators.reshape import to_wide
from ..session import materialize
from .profiles import Profile

GRAINS = {"agency": "Agency", "title": "Title"}

R = TypeVar("R")

GENDER = ("Average", "Male", "Female")
OVERTIME = ("Average", "Total")
NAMES = ("Average", "Common", "Uncommon")


@dataclass
class Inputs:
    """Canonical inputs: payroll rows, name-registration rows, price index ``year, month, value``."""

    payroll: DataFrame
    names: DataFrame
    cpi: DataFrame


def measures(rolled: DataFrame, kind: str, strict: bool = True) -> DataFrame:
    """Report measures from summed cube measures, per row of :func:`rollup`; ``strict``: see ``Profile.strict_nulls``."""
    base = [F.col("fiscal_year"), F.col("key"), F.col("is_citywide"), F.col("n")]
    salary_mean = mean_from_sums(F.col("salary_sum"), F.col("n_salary"), F.col("n"), strict).alias("Average")

    def weighted(tag: str) -> Column:
        total, weight, missing = F.col(f"xw_{tag}"), F.col(f"w_{tag}"), F.col(f"bad_{tag}")
        if strict:
            return weighted_from_sums(total, weight, missing)
        # The weights of rows with an amount; those of common and uncommon names are counts.
        return weighted_from_sums(total, F.col(f"wv_{tag}") if tag in "mf" else weight - missing, F.lit(0))

    if kind == "gender":
        cols = [salary_mean, weighted("m").alias("Male"), weighted("f").alias("Female")]
    elif kind == "overtime":
        amounts = F.col("ot_sum"), F.col("n_ot"), F.col("n")
        cols = [mean_from_sums(*amounts, strict).alias("Average"), total_from_sums(*amounts, strict).alias("Total")]
    elif kind == "names":
        cols = [salary_mean, weighted("c").alias("Common"), weighted("u").alias("Uncommon")]
    else:
        raise ValueError(f"unknown measure kind {kind!r}")
    return rolled.select(*base, *cols)


class ReportSuite:
    """All reports of one profile over one set of inputs, sharing one cube."""

    def __init__(self, inputs: Inputs, profile: Profile, keep_cube: bool = True, cube: DataFrame | None = None):
        """``cube``: a cube computed elsewhere (e.g. kept up to date by the streaming job)."""
        self.inputs = inputs
        self.profile = profile
        self.keep_cube = keep_cube
        self._cube: DataFrame | None = cube
        self._weights: DataFrame | None = None
        self._index: DataFrame | None = None
        # Reports may be built from several threads; each shared piece is computed once, and
        # the cube and the index (independent jobs) can be computed at the same time.
        self._locks = {k: threading.Lock() for k in ("weights", "cube", "index")}

    # -- building blocks ----------------------------------------------------------------------

    def weights(self) -> DataFrame:
        """``name, F, M, M_weight, F_weight``."""
        with self._locks["weights"]:
            if self._weights is None:
                self._weights = name_weights(self.inputs.names)
            return self._weights

    def eligible(self) -> DataFrame:
        return eligible(self.inputs.payroll, self.profile.years)

    def cube(self) -> DataFrame:
        """The measure cube; with ``keep_cube`` it is computed once and checkpointed."""
        with self._locks["cube"]:
            if self._cube is None:
                p = self.profile
                cube = measure_cube(self.eligible(), self.weights(), p.unmatched, p.max_broadcast_rows)
                self._cube = materialize(cube) if self.keep_cube else cube
            return self._cube

    def index(self) -> DataFrame:
        """Per-year index values (one row per year); stored once with ``keep_cube``."""
        with self._locks["index"]:
            if self._index is None:
                p = self.profile
                index = index_values(self.inputs.cpi, p.years, p.cpi_month, p.base_year)
                self._index = materialize(index) if self.keep_cube else index
            return self._index

    def _threshold(self, grain: str) -> int:
        return self.profile.min_group_agency if grain == "agency" else self.profile.min_group_title

    def long(self, kind: str, grain: str, chart: bool, latest_only: bool = False, restated: bool = True) -> DataFrame:
        """Long report rows: ``fiscal_year, key, is_citywide, n, <measures>`` (money restated)."""
        p = self.profile
        # The index plan is built while the cube step waits on its weights check.
        with ThreadPoolExecutor(max_workers=1) as pool:
            index_future = pool.submit(self.index) if restated else None
            # Facts are summed once into the cube; the grouping sets then expand only cube rows.
            source = self.cube()
            index = index_future.result() if index_future is not None else None
        if latest_only:
            source = source.where(F.col("fiscal_year") == p.base_year)
        rolled = rollup(
            source,
            grain,
            min_group_size=self._threshold(grain) if chart else None,
            city_scope=p.city_scope,
            city_label=p.city_label,
        )
        out = measures(rolled, kind, p.strict_nulls)
        if restated:
            money = {"gender": GENDER, "overtime": OVERTIME, "names": NAMES}[kind]
            out = restate_columns(out, index, money)
        return out

    # -- wide multi-year reports -----------------------------------------------------------------

    def _ratio_wide(self, kind: str, grain: str, chart: bool) -> DataFrame:
        names = GENDER if kind == "gender" else NAMES
        long = self.long(kind, grain, chart)
        long = long.withColumn("Gap", percent_text(gap(F.col(names[1]), F.col(names[2]))))
        wide = to_wide(long, "key", [*names, "Gap"], self.profile.years, GRAINS[grain])
        return wide.drop("is_citywide")

    def gender_gap(self, grain: str) -> DataFrame:
        """Per year Average, Male, Female (restated numbers) and Gap (percent text)."""
        return self._ratio_wide("gender", grain, chart=False)

    def gender_gap_chart(self, grain: str) -> DataFrame:
        """As R1 / R4, keys with more rows than the threshold only."""
        return self._ratio_wide("gender", grain, chart=True)

    def uncommon_names(self, grain: str = "agency") -> DataFrame:
        """Per year Average, Common, Uncommon (restated) and Gap = (C-U)/(C+U) as text."""
        return self._names_wide(grain, chart=False)

    def uncommon_names_chart(self, grain: str = "agency") -> DataFrame:
        """As R13, keys with more rows than the threshold only."""
        return self._names_wide(grain, chart=True)

    def _names_wide(self, grain: str, chart: bool) -> DataFrame:
        if self.profile.unmatched != UNMATCHED_ZERO:
            raise ValueError("uncommon-name reports need a profile that keeps unmatched names")
        return self._ratio_wide("names", grain, chart)

    def _overtime_wide(self, grain: str, chart: bool) -> DataFrame:
        long = self.long("overtime", grain, chart)
        # Cents or not is decided per year column, citywide row included.
        texts = with_dollar_texts(long, OVERTIME, by=["fiscal_year"])
        return to_wide(texts, "key", OVERTIME, self.profile.years, GRAINS[grain]).drop("is_citywide")

    def overtime(self, grain: str) -> DataFrame:
        """Per year Average and Total overtime (restated, dollar text)."""
        return self._overtime_wide(grain, chart=False)

    def overtime_chart(self, grain: str) -> DataFrame:
        """As R7 / R10, keys with more rows than the threshold only."""
        return self._overtime_wide(grain, chart=True)

    # -- one-year tables (nominal money, latest year) ------------------------------------------

    def gender_gap_table(self, grain: str) -> DataFrame:
        """Latest year, thresholded: Average, Male, Female (dollar text), Gap (percent)."""
        long = self.long("gender", grain, chart=True, latest_only=True, restated=False)
        long = long.withColumn("Gap", percent_text(gap(F.col("Male"), F.col("Female"))))
        texts = with_dollar_texts(long, GENDER, by=["fiscal_year"])
        return texts.select(F.col("key").alias(GRAINS[grain]), *GENDER, "Gap")

    def overtime_latest(self, grain: str) -> DataFrame:
        """Latest year, thresholded: Average, Total (dollar text)."""
        long = self.long("overtime", grain, chart=True, latest_only=True, restated=False)
        texts = with_dollar_texts(long, OVERTIME, by=["fiscal_year"])
        return texts.select(F.col("key").alias(GRAINS[grain]), *OVERTIME)

    # -- everything -------------------------------------------------------------------------------

    def report_builders(self) -> dict[str, Callable[[], DataFrame]]:
        """Every report of the profile as a function building it, keyed by the output file stem."""
        latest = self.profile.base_year
        out: dict[str, Callable[[], DataFrame]] = {"baby_names": self.weights}
        for grain, label in GRAINS.items():
            out[f"GenderGap_{label}"] = lambda g=grain: self.gender_gap(g)
            out[f"GenderGap_{label}_chart"] = lambda g=grain: self.gender_gap_chart(g)
            out[f"GenderGap_{label}_{latest}_table"] = lambda g=grain: self.gender_gap_table(g)
            out[f"Overtime_{label}"] = lambda g=grain: self.overtime(g)
            out[f"Overtime_{label}_chart"] = lambda g=grain: self.overtime_chart(g)
            out[f"Overtime_{label}_{latest}_chart"] = lambda g=grain: self.overtime_latest(g)
        if self.profile.unmatched == UNMATCHED_ZERO:
            out["Uncommon_Names_Agency"] = lambda: self.uncommon_names("agency")
            out["Uncommon_Names_Agency_chart"] = lambda: self.uncommon_names_chart("agency")
        return out

    def long_tables(self) -> dict[str, DataFrame]:
        """Numeric long forms (``fiscal_year, key, is_citywide, n, measures``, money restated) of
        every report family, for loading elsewhere; no threshold, no text."""
        kinds = ["gender", "overtime"] + (["names"] if self.profile.unmatched == UNMATCHED_ZERO else [])
        return {f"long_{kind}_{grain}": self.long(kind, grain, chart=False) for kind in kinds for grain in GRAINS}

    def all_reports(self) -> dict[str, DataFrame]:
        """Every report of the profile, keyed by the output file stem."""
        return {name: build() for name, build in self.report_builders().items()}

    def prepare(self) -> "ReportSuite":
        """Compute the shared pieces (cube and index, as two concurrent jobs) once, before
        reports run in parallel."""
        self.weights()
        with ThreadPoolExecutor(max_workers=2) as pool:
            for f in [pool.submit(self.cube), pool.submit(self.index)]:
                f.result()
        return self


def run_reports(
    reports: dict[str, DataFrame | Callable[[], DataFrame]],
    action: Callable[[str, DataFrame], R],
    parallelism: int = 8,
) -> dict[str, R]:
    """Run ``action(name, df)`` for every report, up to ``parallelism`` at once.

    Each report is a small job over the stored cube, bound by planning and scheduling latency
    rather than by data, so several in flight keep the executors busy. Reports may be given as
    builders (see :meth:`ReportSuite.report_builders`), which are then also built in parallel;
    call :meth:`ReportSuite.prepare` first so the shared cube is computed once.
    """

    def one(name: str, report: DataFrame | Callable[[], DataFrame]) -> R:
        return action(name, report() if callable(report) else report)

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        futures = {name: pool.submit(one, name, report) for name, report in reports.items()}
        return {name: f.result() for name, f in futures.items()}
