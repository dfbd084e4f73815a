"""Two-period comparison reports: weekly, monthly and custom.

Plan: date-cut facts ⟕ promotion ⟕ stats → one conditional aggregate per shop
for both periods (A2) → shop attributes (J4) → running number (W1) → derived
metrics and deltas (N*, W4) → layouts (L3-L5).

The rollup, one row per shop, is evaluated once, when an output that shows a number
is first asked for: it is written in the session's shared folder, and the numbers, the names and every
output of the report are made from that copy. Building a report runs no job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.functions import labels as L
from shoplens.functions import metrics as M
from shoplens.functions import texts as X
from shoplens.operators.blocks import BlockRollup
from shoplens.operators.dims import Accounts, apply_shop_filter, given, shop_dim, shop_filter
from shoplens.operators.facts import SUM_KIND, RollupSpec, joined_facts, period_rollup
from shoplens.operators.layout import S, unpivot_rows
from shoplens.operators.names import unique_names
from shoplens.operators.quality import arithmetic_errors, validate
from shoplens.operators.ranks import numbered, stored
from shoplens.plans.params import Period, as_period

# Display blocks, in column order: (name, kind, args).
#   kind 'sum'  -> a period sum (counter or money, see SUM_KIND)
#   kind 'rate' -> N1 rate of (numerator, denominator) sums
#   kind 'avg'  -> N2 average of (money total, count) sums
BLOCK1 = [
    ("verify_after_discount", "sum", ()),
    ("exposure_users", "sum", ()),
    ("visit_users", "sum", ()),
    ("exposure_rate", "rate", ("visit_users", "exposure_users")),
    ("order_users", "sum", ()),
    ("order_coupon_count", "sum", ()),
    ("order_rate", "rate", ("order_users", "visit_users")),
    ("verify_users", "sum", ()),
    ("verify_coupon_count", "sum", ()),
    ("order_sale_amount", "sum", ()),
    ("verify_sale_amount", "sum", ()),
    ("coupon_orders", "sum", ()),
    ("phone_clicks", "sum", ()),
    ("avg_price", "avg", ("verify_after_discount", "verify_users")),
]
BLOCK2 = [
    ("promotion_cost", "sum", ()),
    ("promotion_exposure", "sum", ()),
    ("promotion_clicks", "sum", ()),
    ("click_price", "avg", ("promotion_cost", "promotion_clicks")),
    ("promotion_orders", "sum", ()),
    ("promotion_rate", "rate", ("promotion_orders", "promotion_clicks")),
    ("view_groupbuy", "sum", ()),
    ("view_phone", "sum", ()),
    ("consult_users", "sum", ()),
    ("address_clicks", "sum", ()),
    ("new_collect", "sum", ()),
    ("collect_rate", "rate", ("new_collect", "visit_users")),
    ("new_good_reviews", "sum", ()),
    ("review_rate", "rate", ("new_good_reviews", "verify_users")),
]
METRICS = BLOCK1 + BLOCK2

# Legacy detail sheet rows (L5), after the two title rows: (metric, kind, args)
# or None for a section row. Its collect rate divides by order users.
DETAIL_ROWS = [
    ("exposure_users", "sum", ()), ("visit_users", "sum", ()),
    ("exposure_rate", "rate", ("visit_users", "exposure_users")),
    ("order_users", "sum", ()), ("verify_users", "sum", ()),
    ("order_rate", "rate", ("order_users", "visit_users")),
    ("order_coupon_count", "sum", ()), ("verify_coupon_count", "sum", ()),
    ("order_sale_amount", "sum", ()), ("verify_sale_amount", "sum", ()),
    ("verify_after_discount", "sum", ()),
    ("avg_price", "avg", ("verify_after_discount", "verify_users")),
    ("phone_clicks", "sum", ()), ("address_clicks", "sum", ()), ("consult_users", "sum", ()),
    None,
    ("new_good_reviews", "sum", ()),
    ("review_rate", "rate", ("new_good_reviews", "verify_users")),
    ("new_collect", "sum", ()),
    ("collect_rate_detail", "rate", ("new_collect", "order_users")),
    ("checkin_count", "sum", ()),
    None,
    ("promotion_orders", "sum", ()), ("promotion_cost", "sum", ()),
    ("promotion_exposure", "sum", ()), ("promotion_clicks", "sum", ()),
    ("click_price", "avg", ("promotion_cost", "promotion_clicks")),
    ("view_groupbuy", "sum", ()), ("view_phone", "sum", ()),
]


# Shown ratios by name: (numerator, denominator).
_SHOWN = METRICS + [x for x in DETAIL_ROWS if x is not None]
RATES = {name: args for name, kind, args in _SHOWN if kind == "rate"}
AVERAGES = {name: args for name, kind, args in _SHOWN if kind == "avg"}


@dataclass
class PeriodReport:
    """Lazy outputs of one two-period report."""
    rows: DataFrame            # one row per shop: attributes and period sums, not numbered
    p1: Period
    p2: Period
    rejected: DataFrame | None = None   # with quarantine: rejected store-days and reasons
    failed: DataFrame | None = None     # with quarantine: the shops left out, their errors and both periods' sums
    options: dict = field(default_factory=dict)

    @cached_property
    def kept(self) -> DataFrame:
        """The rows, evaluated once and stored."""
        return stored(self.rows, "period-rows")

    @cached_property
    def row_count(self) -> int:
        return self.kept.count()

    @cached_property
    def base(self) -> DataFrame:
        """The stored rows with ``seq``, in the order of shop ids (one row per shop, so no ties)."""
        return numbered(self.kept, ["shop_id"], name="seq", count=self.row_count).withColumn("seq", F.col("seq").cast("int"))

    @cached_property
    def named(self) -> DataFrame:
        """The rows with ``seq`` and the unique ``sheet_name``, for the outputs that show it."""
        return unique_names(self.base, "clean_name", count=self.row_count)

    @cached_property
    def sections(self) -> DataFrame:
        """T5 + W2: the cleaned name and the unique sheet name per shop."""
        return self.named.select("shop_id", "seq", "clean_name", "sheet_name")

    # ---- typed wide table ---------------------------------------------------
    @cached_property
    def wide(self) -> DataFrame:
        """One row per shop: every metric for p1, p2 and the delta, typed."""
        cols = ["shop_id", "seq", "operator", "city", "sales", "shop_name",
                f"{L.lit(self.p1.label)} AS p1_label", f"{L.lit(self.p2.label)} AS p2_label"]
        for name, kind, args in METRICS:
            cols += _wide_metric(name, kind, args)
        return self.base.selectExpr(*cols)

    # ---- L3: eight summary lines per shop --------------------------------------
    @cached_property
    def rows8(self) -> DataFrame:
        shop_cells = [S("seq"), S("operator"), S("city"), S("sales"), S("shop_name")]
        blank5 = [""] * 5

        def block(metrics):
            p1 = [_cell(n, k, "_p1") for n, k, _ in metrics]
            p2 = [_cell(n, k, "_p2") for n, k, _ in metrics]
            d = [_delta_cell(n, k) for n, k, _ in metrics]
            return p1, p2, d

        b1p1, b1p2, b1d = block(BLOCK1)
        b2p1, b2p2, b2d = block(BLOCK2)
        rows = [
            list(X.PERIOD_HEADER_1) + [1, "header", True, False],
            shop_cells + [self.p1.label] + b1p1 + [1, "p1", False, False],
            blank5 + [self.p2.label] + b1p2 + [1, "p2", False, False],
            blank5 + [X.PERIOD_DELTA] + b1d + [1, "delta", False, True],
            list(X.PERIOD_HEADER_2) + [2, "header", True, False],
            blank5 + [self.p1.label] + b2p1 + [2, "p1", False, False],
            blank5 + [self.p2.label] + b2p2 + [2, "p2", False, False],
            blank5 + [X.PERIOD_DELTA] + b2d + [2, "delta", False, True],
        ]
        columns = [f"c{i:02d}" for i in range(1, 21)]
        return unpivot_rows(self.base, ["shop_id", "seq"], rows, columns,
                            flags=[("block", "int"), ("line_type", "string"), ("is_header", "boolean"),
                                   ("is_delta", "boolean")], row_col="line_no")

    @cached_property
    def rows8_legacy(self) -> DataFrame:
        """L4: the legacy 16-column summary (no number/operator/city/sales)."""
        keep = ["c05"] + [f"c{i:02d}" for i in range(6, 21)]
        return self.rows8.select("shop_id", "seq", "line_no", *keep, "block", "line_type", "is_header", "is_delta")

    # ---- L5: 31-line legacy detail per shop -------------------------------------
    @cached_property
    def detail31(self) -> DataFrame:
        rows = [
            [S("shop_name"), "", "", "", True, False, 0],
            [X.DETAIL_HEADER, self.p1.label, self.p2.label, X.DETAIL_DELTA_HEADER, True, False, 0],
        ]
        labels = iter(X.DETAIL_LABELS)
        for spec in DETAIL_ROWS:
            label = next(labels)
            if spec is None:
                rows.append([label, "", "", "", True, False, 0])
                continue
            n, k, _ = spec
            rows.append([label, _cell(n, k, "_p1"), _cell(n, k, "_p2"), _delta_cell(n, k, detail=True),
                         False, True, S(_trend(n, k))])
        return unpivot_rows(self.named, ["shop_id", "seq", "sheet_name"], rows, ["label", "p1", "p2", "delta"],
                            flags=[("is_section", "boolean"), ("is_metric", "boolean"), ("trend", "int")])

    # ---- N11: trend flags --------------------------------------------------------
    @cached_property
    def trend(self) -> DataFrame:
        """Per shop and metric: the numeric delta and its sign (1 up, -1 down, 0 flat)."""
        rows = [[n, S(f"CAST({_delta_num(n, k)} AS STRING)"), S(_trend(n, k))] for n, k, _ in METRICS]
        return unpivot_rows(self.base, ["shop_id", "seq"], rows, ["metric", "delta"], flags=[("trend", "int")])

    @cached_property
    def defaults(self) -> DataFrame:
        """Q2/A10: every summed metric that took the default 0, with the reason."""
        from shoplens.operators.quality import default_profile

        return default_profile(self.base)

    @cached_property
    def shop_count(self) -> DataFrame:
        """Number of shops in the report (one row)."""
        return self.__dict__.get("kept", self.rows).selectExpr("count(DISTINCT shop_id) AS store_count")

    def outputs(self) -> dict[str, DataFrame]:
        """What a run writes: with quarantine also the store-days that were left out, with reasons."""
        out = {"wide": self.wide, "summary": self.rows8, "detail": self.detail31, "trend": self.trend,
               "defaults": self.defaults}
        if self.options.get("legacy"):
            out["summary_legacy"] = self.rows8_legacy
        if self.rejected is not None:
            out["rejected"], out["failed"] = self.rejected, self.failed
        return out


# ---- per-metric SQL over the base (sums with _p1/_p2 suffix) ------------------

def _sum_type(name: str) -> str:
    return M.MONEY_TYPE if SUM_KIND[name] == "money" else "bigint"


def _t(name: str, sfx: str) -> str:
    return f"{name}{sfx}_t"


def _c(name: str, sfx: str) -> str:
    return f"{name}{sfx}_c"


def derived_columns() -> list[str]:
    """Per-period rate tenths and average cents, computed once per shop."""
    cols, seen = [], set()
    for spec in METRICS + [s for s in DETAIL_ROWS if s is not None]:
        name, kind, args = spec
        if kind == "sum" or name in seen:
            continue
        seen.add(name)
        for sfx in ("_p1", "_p2"):
            a, b = args[0] + sfx, args[1] + sfx
            if kind == "rate":
                cols.append(f"{M.rate_tenths(a, b)} AS {_t(name, sfx)}")
            else:
                cols.append(f"{M.avg_cents(a, b)} AS {_c(name, sfx)}")
    return cols


def _value(name, kind, sfx) -> str:
    if kind == "sum":
        return M.money(name + sfx) if SUM_KIND[name] == "money" else M.count0(name + sfx)
    if kind == "rate":
        return f"coalesce({M.tenths_value(_t(name, sfx))}, CAST(0 AS {M.RATE_TYPE}))"
    return f"coalesce({M.cents_value(_c(name, sfx))}, CAST(0 AS {M.MONEY_TYPE}))"


def _delta_num(name, kind) -> str:
    if kind == "rate":
        return M.tenths_diff_value(_t(name, "_p1"), _t(name, "_p2"))
    if kind == "avg":
        return M.avg_diff_value(_c(name, "_p1"), _c(name, "_p2"))
    return f"CAST({_value(name, kind, '_p2')} - {_value(name, kind, '_p1')} AS {_sum_type(name)})"


def _trend(name, kind) -> str:
    return f"CAST(signum({_delta_num(name, kind)}) AS INT)"


def _wide_metric(name, kind, args) -> list[str]:
    cols = [f"{_value(name, kind, '_p1')} AS {name}_p1",
            f"{_value(name, kind, '_p2')} AS {name}_p2",
            f"{_delta_num(name, kind)} AS {name}_delta"]
    if kind == "rate":
        t1, t2 = _t(name, "_p1"), _t(name, "_p2")
        cols += [f"{M.tenths_text(t1)} AS {name}_p1_text", f"{M.tenths_text(t2)} AS {name}_p2_text",
                 f"{M.tenths_diff_text(t1, t2)} AS {name}_delta_text"]
    return cols


def _cell(name, kind, sfx) -> S:
    """A period cell as the sheet shows it."""
    if kind == "rate":
        return S(M.tenths_text(_t(name, sfx)))
    if kind == "avg":
        return S(M.avg_cell(_c(name, sfx)))
    if SUM_KIND[name] == "money":
        return S(M.money_cell_period(name + sfx))
    return S(M.count_cell(name + sfx))


def _delta_cell(name, kind, detail: bool = False) -> S:
    if kind == "rate":
        t1, t2 = _t(name, "_p1"), _t(name, "_p2")
        return S(M.tenths_diff_text2(t1, t2) if detail else M.tenths_diff_text(t1, t2))
    if kind == "avg":
        return S(M.avg_diff_cell(_c(name, "_p1"), _c(name, "_p2")))
    if SUM_KIND[name] == "money":
        return S(M.money_diff_cell(name + "_p1", name + "_p2"))
    return S(M.count_diff_cell(name + "_p1", name + "_p2"))


# ---- the report ----------------------------------------------------------------

def rejected_store_days(tables, p1: Period, p2: Period, shops=None) -> DataFrame:
    """Q1: store-days of the periods that break a validation rule, with reasons."""
    bad = validate(tables, [p1, p2]).where("status = 'rejected'").select("shop_id", "report_date", "errors")
    return apply_shop_filter(bad, shops)


def _rollup(tables, p1: Period, p2: Period, shops, rename: str, by_city: bool, dedupe_right: bool, checked: bool = False) -> DataFrame:
    joined = joined_facts(tables, [p1, p2], shops=shops, dedupe_right=dedupe_right)
    return period_rollup(joined, p1, p2, RollupSpec(rename=rename, by_city=by_city, checked=checked))


def quarantined(roll: DataFrame, rejected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q1: a checked rollup as (shops to report, shops that fail with errors and both periods' sums).

    A shop fails by any of its store-days or by its own arithmetic; NULL is a shop id like any other here.
    A shop with rejected store-days but none in the periods fails without sums.
    """
    days = (rejected.groupBy("shop_id").agg(F.array_join(F.array_sort(F.collect_set("errors")), "; ").alias("_days"))
            .select(F.col("shop_id").alias("_bad_id"), "_days"))
    both = roll.join(days, roll["shop_id"].eqNullSafe(days["_bad_id"]), "full")
    errors = F.concat_ws("; ", "_days", F.expr(arithmetic_errors(RATES, AVERAGES)))
    marked = both.withColumn("shop_id", F.coalesce("shop_id", "_bad_id")).withColumn("errors", errors).drop("_days", "_bad_id")
    good = marked.where("errors = ''").drop("errors", "lost")
    sums = [f"{m}{sfx}" for m in SUM_KIND for sfx in ("_p1", "_p2")]
    name = F.expr(f"CASE WHEN has_p1 OR has_p2 THEN {SHOP_NAME} END").alias("shop_name")
    bad = marked.where("errors <> ''").select("shop_id", name, "errors", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("has_p1", "has_p2")], *sums)
    return good, bad


SHOP_NAME = L.period_shop_name("name_p1", "name_p2", "has_p1")


def period_rows(tables, roll: DataFrame, accounts: Accounts = None, shops=None) -> DataFrame:
    """One row per shop with attributes, both periods' sums and derived values."""
    dim = shop_dim(tables, accounts)
    if isinstance(shops, Column):                      # a literal limit is pushed down; others would only add a join
        dim = dim.where(shops)
    d = X.PERIOD_DEFAULT_ATTR
    return roll.join(dim, "shop_id", "left").selectExpr(
        *roll.columns,
        f"{L.text_or('operator', d)} AS operator",
        f"{L.text_or('sales', d)} AS sales",
        f"{L.text_or('city', d)} AS city",
        f"{SHOP_NAME} AS shop_name",
        f"{L.clean_section_name(SHOP_NAME)} AS clean_name",
        *derived_columns(),
    )


def period_report(tables, p1: Period, p2: Period, accounts: Accounts = None, shop_id: str | None = None,
                  shop_ids: Sequence[str] | DataFrame | None = None, unresolved: str = "none",
                  rename: str = "sum_latest", by_city: bool = False,
                  dedupe_right: bool = False, quarantine: bool = False, legacy: bool = False,
                  blocks: BlockRollup | None = None) -> PeriodReport:
    """R2 (weekly), R3 (monthly), R4 (custom): the same plan, different periods.

    ``shop_id`` filters one shop (the account filter then only limits the
    attributes); ``shop_ids`` is the legacy list filter; ``by_city`` groups
    by (shop, name, city) as the legacy custom report does. ``quarantine=True``
    (Q1): a shop with any rejected store-day in the periods, or whose own figures
    overflow, is left out and the others go on; ``rejected`` lists the store-days with
    reasons, ``failed`` the shops with all their errors and both periods' sums.
    ``legacy`` also writes the 16-column summary. ``blocks`` reads the sums from a stored
    block rollup instead of the facts: some 2 log2(days) rows a shop; its ``dedupe_right`` must be the
    report's, and ``quarantine`` needs the store-days themselves.
    """
    if blocks is not None and (quarantine or blocks.dedupe_right != dedupe_right):
        raise ValueError("blocks can't be quarantined, and must have been built with the report's dedupe_right")
    p1, p2 = as_period(p1), as_period(p2)
    accounts = given(accounts, unresolved)
    shops = shop_filter(tables, accounts=accounts, shop_id=shop_id, shop_ids=shop_ids, unresolved=unresolved)
    if blocks is not None:
        roll = blocks.rollup(p1, p2, RollupSpec(rename=rename, by_city=by_city), shops)
    else:
        roll = _rollup(tables, p1, p2, shops, rename, by_city, dedupe_right, quarantine)
    rejected = failed = None
    if quarantine:
        rejected = rejected_store_days(tables, p1, p2, shops)
        roll, failed = quarantined(roll, rejected)
    rows = period_rows(tables, roll, accounts, shops)
    return PeriodReport(rows=rows, p1=p1, p2=p2, rejected=rejected, failed=failed,
                        options=dict(accounts=accounts, shop_id=shop_id, rename=rename, by_city=by_city, legacy=legacy))


# ---- the service's report signatures (R2-R4) ---------------------------------------

def weekly_report(tables, week1_start, week1_end, week2_start, week2_end, accounts: Accounts = None,
                  shop_id: str | None = None, **options) -> PeriodReport:
    """R2 with the weekly request's parameters."""
    return period_report(tables, Period.of(week1_start, week1_end), Period.of(week2_start, week2_end),
                         accounts=accounts, shop_id=shop_id, **options)


def monthly_report(tables, month1_start, month1_end, month2_start, month2_end, accounts: Accounts = None,
                   **options) -> PeriodReport:
    """The weekly plan over two month-long periods."""
    return period_report(tables, Period.of(month1_start, month1_end), Period.of(month2_start, month2_end),
                         accounts=accounts, **options)


def custom_report(tables, period1_start, period1_end, period2_start, period2_end, accounts: Accounts = None,
                  shop_id: str | None = None, shop_ids=None, **options) -> PeriodReport:
    """Any two periods, filtered by accounts, one shop or (legacy) a shop list."""
    return period_report(tables, Period.of(period1_start, period1_end), Period.of(period2_start, period2_end),
                         accounts=accounts, shop_id=shop_id, shop_ids=shop_ids, **options)
