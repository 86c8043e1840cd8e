"""Delimited text held in a column (SRC-04 to SRC-06)."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quirekit.functions.rewrite import let, strip

SNIFF_CHARS = 8192
DELIMITERS = ",;\t|"


def parse_rows(raw: str) -> list[list[str]]:
    """SRC-04: rows of one file; the dialect is guessed from its start, else comma."""
    if not raw or not raw.strip():
        return []
    try:
        dialect = csv.Sniffer().sniff(raw[:SNIFF_CHARS], delimiters=DELIMITERS)
    except csv.Error:
        dialect = csv.excel
    try:
        return list(csv.reader(io.StringIO(raw), dialect))
    except csv.Error:
        return []


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def rows_of(raw: pd.Series) -> pd.Series:
    return raw.map(parse_rows)


def tsv_as_csv(raw: Column, compat: bool = True) -> Column:
    """SRC-05: tabs become commas before parsing, so commas inside cells split them; without
    ``compat`` cells keep their commas because they are quoted first."""
    if compat:
        return F.translate(raw, "\t", ",")
    quoted = F.transform(
        F.split(raw, "\n"),
        lambda line: F.array_join(
            F.transform(F.split(line, "\t"), lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))), ","
        ),
    )
    return F.array_join(quoted, "\n")


def narrate(rows: Column, max_rows: int | None = None, max_cell: int | None = None) -> Column:
    """SRC-06: a table as readable lines: a header line, then ``Row n: column=value | ...``."""

    def cell(value: Column) -> Column:
        flat = strip(F.translate(F.coalesce(value, F.lit("")), "\r\n", "  "))
        if not max_cell:
            return flat
        return let(
            flat,
            lambda text: F.when(F.length(text) > max_cell, F.concat(F.substring(text, 1, max_cell), F.lit("..."))).otherwise(text),
        )

    def lines(headers: Column) -> Column:
        body = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
        shown = F.slice(body, 1, max_rows) if max_rows is not None else body
        told = F.transform(
            shown,
            lambda row, i: F.concat(
                F.lit("Row "), (i + 1).cast("string"), F.lit(": "),
                F.array_join(
                    F.transform(
                        headers,
                        lambda name, j: F.concat(name, F.lit("="), cell(F.try_element_at(row, j + 1))),
                    ),
                    " | ",
                ),
            ),
        )
        head = F.array(
            F.lit("[CSV INPUT]"),
            F.concat(F.lit("Columns ("), F.size(headers).cast("string"), F.lit("): "), F.array_join(headers, " | ")),
            F.lit("Rows:"),
        )
        parts = F.concat(head, told)
        if max_rows is not None:
            note = F.concat(
                F.lit(f"[Truncated: showing first {max_rows} data rows of "), F.size(body).cast("string"), F.lit("]")
            )
            parts = F.when(F.size(body) > max_rows, F.array_append(parts, note)).otherwise(parts)
        return F.array_join(parts, "\n")

    def named(first: Column) -> Column:
        trimmed = F.transform(first, lambda h: strip(h))
        blank = F.forall(trimmed, lambda h: h == "")
        return F.when(blank, F.transform(trimmed, lambda _h, i: F.concat(F.lit("col_"), (i + 1).cast("string")))).otherwise(trimmed)

    return F.when(F.size(rows) == 0, "").otherwise(let(named(F.try_element_at(rows, F.lit(1))), lines))
