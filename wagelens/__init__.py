"""wagelens: pay-gap and overtime reports over payroll tables, on Spark DataFrames."""

from .plans.profiles import STAR_V2020, STAR_V2022, V2020, V2022, Profile
from .plans.reports import Inputs, ReportSuite

__all__ = ["Inputs", "Profile", "ReportSuite", "V2020", "V2022", "STAR_V2020", "STAR_V2022"]
