"""Write the physical plans of the headline queries to PLANS.md (tree, pushed filters, read schemas).

Usage: python tools/show_plans.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wagelens import STAR_V2020, ReportSuite  # noqa: E402
from wagelens.plans import catalog  # noqa: E402
from wagelens.session import local_session  # noqa: E402

HEADLINE = ["measure_cube", "measure_cube_shuffle", "gender_gap_agency", "overtime_title_latest", "payroll_partitioned"]


def _explain(df) -> str:
    # The "formatted" explain text, captured from the public explain() instead of printed.
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def summary(text: str) -> str:
    tree = text.split("\n\n\n")[0]
    keep = [
        line for line in text.splitlines()
        if re.match(r"^(PushedFilters|PartitionFilters|ReadSchema|Join type|Keys)", line)
    ]
    return tree.strip() + "\n\n" + "\n".join(keep)


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session()
    parts = [
        "# Physical plans of the headline queries",
        "",
        f"Generated by `tools/show_plans.py` on `{sf}` (before execution; AQE may still coalesce partitions",
        "and reuse exchanges at run time). Tree first, then the scan and join details.",
    ]
    for name in HEADLINE:
        parts += ["", f"## `{name}`", "", "```", summary(_explain(catalog.QUERIES[name](spark, sf))), "```"]
    suite = ReportSuite(catalog._inputs(spark, sf, STAR_V2020), STAR_V2020, keep_cube=True).prepare()
    parts += [
        "",
        "## A report inside the suite (reads the stored cube; no fact scan)",
        "",
        "```",
        summary(_explain(suite.overtime("agency"))),
        "```",
    ]
    out = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(out, "w") as fh:
        fh.write("\n".join(parts) + "\n")
    print(out)


if __name__ == "__main__":
    main()
