"""Write PLANS.md: physical plans of the headline reports, numbered, on stored inputs.

Usage: python tools/plans.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shoplens import queries as Q  # noqa: E402
from shoplens.operators.blocks import BlockRollup  # noqa: E402
from shoplens.operators.dims import shop_filter  # noqa: E402
from shoplens.operators.facts import joined_facts, trailing_sum  # noqa: E402
from shoplens.plans.daily import daily_report  # noqa: E402
from shoplens.plans.params import Period  # noqa: E402
from shoplens.plans.period import period_report  # noqa: E402
from shoplens.session import build_session  # noqa: E402
from shoplens.sources.tables import ReportTables, write_tables  # noqa: E402

INTRO = """# Physical plans

Made by `python tools/plans.py` on the inputs of one driver folder stored as date-partitioned parquet
(`write_tables`), local[8], broadcasts off to show the shuffles that remain when nothing is small. Before AQE
runs. Trees of the main query, then its scans (attribute ids removed). A numbered report evaluates its rows once (the
first plan of each) and makes its outputs from that stored copy (the second).
"""


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = re.sub(r"#\d+L?|\[plan_id=\d+\]|file:[^\]]*?/(?=\w+\])", "", buf.getvalue().split("===== Subqueries =====")[0])
    tree, _, nodes = text.partition("\n\n\n")
    keep = [tree.strip()]
    for node in nodes.split("\n\n"):
        if "Scan parquet" in node:
            keep.append("\n".join(x[:220] for x in node.strip().splitlines() if x.startswith(("(", "Location", "Partition", "Pushed", "ReadSchema"))))
    return "\n\n".join(keep)


def main() -> None:
    spark = build_session()
    root = tempfile.mkdtemp(prefix="shoplens-plans-")
    write_tables(Q.tables(spark, sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"), root)
    t = ReportTables.from_parquet(spark, root)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    accounts = shop_filter(t, accounts=Q.ACCOUNTS)
    weekly, daily = period_report(t, Q.W1, Q.W2), daily_report(t, Q.DAY)
    blocks = BlockRollup(spark, tempfile.mkdtemp(prefix="shoplens-blocks-"), levels=4)
    blocks.build(t, Period(Q.W1.start, Q.W2.end))
    out = {
        "Weekly report, the rows that are evaluated once": weekly.rows,
        "Weekly report, wide table from the stored rows": weekly.wide,
        "Weekly report, sheet names from the stored rows": weekly.sections,
        "Weekly sums from a stored block rollup": blocks.rollup(Q.W1, Q.W2),
        "Weekly facts of some accounts: the shops limit all three inputs before the joins": joined_facts(t, [Q.W1, Q.W2], shops=accounts),
        "Weekly facts of a shop list: literal predicates at every scan": joined_facts(t, [Q.W1, Q.W2], shops=shop_filter(t, shop_ids=Q.SHOP_LIST)),
        "Daily report, the rows that are evaluated once": daily.rows,
        "Daily summary from the stored rows": daily.summary,
        "Daily checks: no number, so no numbering": daily_report(t, Q.DAY).checks,
        "7-day totals over a range of report days": trailing_sum(t.store_daily, "coupon_pay_order_count", Q.DAY_RANGE),
    }
    print(INTRO)
    for title, df in out.items():
        print(f"## {title}\n\n```\n{plan(df)}\n```\n")


if __name__ == "__main__":
    main()
