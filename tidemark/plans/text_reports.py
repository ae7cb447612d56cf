"""Aligned text tables of report frames.

Cells and widths are made by Spark, and rows come to the driver one after another, so a
report in full may be as long as it likes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _is_share(name: str) -> bool:
    return name == "percentage" or name == "pct" or name.endswith("_pct")


def _cell(name: str, kind: T.DataType) -> Column:
    """Shares as percent, changes with their sign, whole numbers in groups of three, other fractions with two places."""
    value = F.col(f"`{name}`")
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        text = F.concat(F.format_number(value, 2), F.lit("%" if _is_share(name) else ""))
    elif isinstance(kind, (T.LongType, T.IntegerType, T.ShortType)):
        text = F.format_number(value, 0)
        if name.endswith("_change"):
            text = F.concat(F.when(value >= 0, "+").otherwise(""), text)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("")).alias(name)


def table_lines(df: DataFrame, order: list[str] | None = None) -> Iterator[str]:
    """The lines of a table, and how many rows there were; df is evaluated once."""
    cells = (df.orderBy(*order) if order else df).select(*[_cell(f.name, f.dataType) for f in df.schema.fields]).persist()
    try:
        wide = cells.agg(*[F.max(F.length(f"`{c}`")).alias(f"w{i}") for i, c in enumerate(df.columns)]).first()
        widths = [max(len(c), w or 0) for c, w in zip(df.columns, wide, strict=True)]
        line = lambda r: "  ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)).rstrip()
        yield line(df.columns)
        yield "  ".join("-" * w for w in widths)
        n = 0
        for row in cells.toLocalIterator():
            yield line(row)
            n += 1
        yield f"  {n:,} entries shown"
    finally:
        cells.unpersist()


def text_table(df: DataFrame, order: list[str] | None = None) -> str:
    return "\n".join(list(table_lines(df, order))[:-1])


def report_lines(sections: dict[str, DataFrame]) -> Iterator[str]:
    for i, (name, df) in enumerate(sections.items()):
        yield from ([""] if i else []) + ["=" * 72, name.upper(), "=" * 72]
        yield from table_lines(df)


def text_report(sections: dict[str, DataFrame]) -> str:
    return "\n".join(report_lines(sections))
