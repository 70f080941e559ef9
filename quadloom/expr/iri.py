"""IRIs as column expressions."""

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that need no escape (unreserved, and the ranges of RFC 3987).
UNRESERVED = (
    r"[A-Za-z0-9._~\-"
    r"\x{A0}-\x{D7FF}\x{F900}-\x{FDCF}\x{FDF0}-\x{FFEF}"
    r"\x{10000}-\x{1FFFD}\x{20000}-\x{2FFFD}\x{30000}-\x{3FFFD}\x{40000}-\x{4FFFD}\x{50000}-\x{5FFFD}"
    r"\x{60000}-\x{6FFFD}\x{70000}-\x{7FFFD}\x{80000}-\x{8FFFD}\x{90000}-\x{9FFFD}\x{A0000}-\x{AFFFD}"
    r"\x{B0000}-\x{BFFFD}\x{C0000}-\x{CFFFD}\x{D0000}-\x{DFFFD}\x{E1000}-\x{EFFFD}]"
)
SAFE = rf"^{UNRESERVED}*$"
#: Signs that no IRI has.
ODD = "[\\x00-\\x20<>\"{}|^`\\\\]"
VALID = r"^[A-Za-z][A-Za-z0-9+.\-]*:[^\x00-\x20<>\"{}|^`\\]*$"


def normalized(col: Column, form: str | None) -> Column:
    """Unicode normal form (None: values are known to be normal). Spark has no function for it: values go through Arrow."""
    if form is None:
        return col

    @F.pandas_udf("string")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else unicodedata.normalize(form, v))

    return F.when(col.rlike(r"[^\x00-\x7F]"), apply(col)).otherwise(col)


def iri_safe(col: Column, upper: bool = True) -> Column:
    """Every code point that is not unreserved becomes % and its hexadecimal number (at least two digits)."""

    def one(c: Column) -> Column:
        digits = F.hex(F.ascii(c))
        digits = F.when(F.length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits)
        return F.when(c.rlike(rf"^{UNRESERVED}$"), c).otherwise(F.concat(F.lit("%"), digits if upper else F.lower(digits)))

    chars = F.filter(F.split(col, ""), lambda c: c != "")
    return F.when(col.rlike(SAFE), col).otherwise(F.array_join(F.transform(chars, one), ""))


def known_valid(parts: list[tuple[str, str]], base: str) -> str | None:
    """What to put before a template of escaped values so that it is a valid IRI whatever the values are ("" or the base);
    nothing if that hangs on the values."""
    if any(k == "text" and re.search(ODD, v) for k, v in parts):
        return None
    if parts[0][0] == "text" and re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", parts[0][1]):
        return ""
    # escaped values have no colon, so without one in the text it is relative
    if any(k == "text" and ":" in v for k, v in parts) or not re.match(VALID, base):
        return None
    return base


def valid_iri(col: Column) -> Column:
    return col.rlike(VALID)


def to_iri(col: Column, base: str, on_error: str) -> Column:
    """A valid IRI as it is; else base and value, if that is valid; else an error, or nothing."""
    whole = F.concat(F.lit(base), col)
    other = F.lit(None).cast("string") if on_error == "skip" else F.raise_error(F.concat(F.lit("Could not generate a valid IRI from "), col)).cast("string")
    return F.when(col.isNull(), F.lit(None).cast("string")).when(valid_iri(col), col).when(valid_iri(whole), whole).otherwise(other)


def bnode(col: Column) -> Column:
    return F.concat(F.lit("_:"), F.regexp_replace(col, "[^a-zA-Z_0-9-]+", ""))
