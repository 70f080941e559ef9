"""A few functions, in columns only."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadloom.functions import fno_function

EX = "http://example.com/functions/"


@fno_function(EX + "lower", [EX + "value"], native=True)
def lower(value: str) -> str:
    return F.lower(value)


@fno_function(EX + "upper", [EX + "value"], native=True)
def upper(value: str) -> str:
    return F.upper(value)


@fno_function(EX + "isYes", [EX + "value"], native=True)
def is_yes(value: str) -> str:
    return F.lower(value) == "yes"


@fno_function(EX + "latinOnly", [EX + "value"], native=True)
def latin_only(value: str) -> str:
    return F.regexp_replace(value, r"[^A-Za-z0-9]", "")


@fno_function(EX + "sum", [EX + "a", EX + "b"], native=True)
def add(a: int, b: int) -> str:
    return a + b


@fno_function(EX + "split", [EX + "value", EX + "by"], native=True)
def split(value: str, by: str) -> list:
    return F.split(value, F.concat(F.lit("\\Q"), by, F.lit("\\E")))


@fno_function(EX + "join", [EX + "values"], native=True)
def join(values: list) -> str:
    return F.array_join(F.sort_array(values), ",")
