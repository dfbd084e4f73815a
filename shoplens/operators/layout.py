"""Sheet layouts as tidy tables.

A report sheet is a grid; here it is rows ``(keys..., row_no, c1..cN, flags)``
with every cell as text. Rows are produced per shop with one
``inline(array(named_struct(...), ...))`` generator — same stage, no shuffle.
Layouts are built after aggregation, so they multiply one row per shop by a
fixed number of lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from shoplens.functions.labels import lit


class S(str):
    """A SQL expression cell (a plain ``str`` cell is literal text)."""


def cell_sql(v) -> str:
    if isinstance(v, S):
        return f"coalesce(CAST({v} AS STRING), '')"
    return lit("" if v is None else str(v))


def flag_sql(v, spark_type: str) -> str:
    return f"CAST({v if isinstance(v, S) else lit(v)} AS {spark_type})"


def unpivot_rows(df: DataFrame, keys: Sequence[str], rows: Sequence[Sequence], columns: Sequence[str],
                 flags: Sequence[tuple[str, str]] = (), row_col: str = "row_no") -> DataFrame:
    """One output row per entry of ``rows`` for every input row.

    Each entry lists text cells (``S`` SQL or literal) named by ``columns``,
    then ``flags`` values (``S`` SQL or Python literal) of the given types.
    """
    n_text = len(columns)
    structs = []
    for i, r in enumerate(rows, start=1):
        parts = [f"'{row_col}', {i}"]
        for j, name in enumerate(columns):
            parts.append(f"'{name}', {cell_sql(r[j] if j < len(r) else '')}")
        for k, (fname, ftype) in enumerate(flags):
            v = r[n_text + k] if n_text + k < len(r) else None
            parts.append(f"'{fname}', {flag_sql(v, ftype)}")
        structs.append("named_struct(" + ", ".join(parts) + ")")
    return df.selectExpr(*keys, "inline(array(" + ", ".join(structs) + "))")
