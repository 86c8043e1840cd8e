"""Query registry used by the driver entry module, the bench and the tests."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirekit.sources.tables import read_table, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def text_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table whose rows carry long texts, spread over the cores."""
    return spread(read_table(spark, sf_dir, name), key)


# --- SQL text helpers for the oracles ----------------------------------------------


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """The same pattern for the oracle's regex engine; look-around cannot be carried over."""
    pattern = re.sub(r"^\(\?([a-z]+)\)", lambda m: "(?" + m.group(1).replace("d", "") + ")", pattern).replace("(?)", "")
    if re.search(r"\(\?(?:=|!|<=|<!)|\\[1-9]", pattern):
        raise ValueError(f"no oracle form for {pattern}")
    return pattern


def sql_rewrite(expr: str, rules: Iterable[tuple[str, str]]) -> str:
    for pattern, replacement in rules:
        expr = f"regexp_replace({expr}, {quote(re2(pattern))}, {quote(replacement)}, 'g')"
    return expr


def sql_replace(expr: str, pairs: Iterable[tuple[str, str]]) -> str:
    for old, new in pairs:
        expr = f"replace({expr}, {quote(old)}, {quote(new)})"
    return expr


def sql_strip(expr: str, chars: str = " \t\n\r\x0b\f") -> str:
    return f"trim({expr}, {quote(chars)})"


def sql_squash(expr: str, chars: str = " \t\n\r\x0b\f") -> str:
    return sql_strip(f"regexp_replace({expr}, '[\\s\\x{{A0}}]+', ' ', 'g')", chars)


def sql_list(values: Iterable[str]) -> str:
    return ", ".join(quote(v) for v in values)


def sql_case(expr: str, mapping: dict[str, str], default: str) -> str:
    arms = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in mapping.items())
    return f"CASE {expr} {arms} ELSE {default} END"


# --- Injection: the same text fragments appended on both sides ------------------------

Fragment = tuple[int, int, str]


def inject(text: Column, key: Column, fragments: Iterable[Fragment]) -> Column:
    parts = [F.when(key % modulus == rest, fragment).otherwise("") for modulus, rest, fragment in fragments]
    return F.concat(text, *parts)


def sql_inject(text: str, key: str, fragments: Iterable[Fragment]) -> str:
    parts = [
        f"CASE WHEN {key} % {modulus} = {rest} THEN {quote(fragment)} ELSE '' END" for modulus, rest, fragment in fragments
    ]
    return " || ".join([text, *parts])
