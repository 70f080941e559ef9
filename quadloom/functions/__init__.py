"""Functions that mappings call, by IRI.

    @fno_function("http://example.com/toUpper", params=["http://example.com/value"])
    def to_upper(value: str) -> str: ...

A Python function gets strings (or numbers, by its annotations), and lists for parameters annotated `list`; it returns a
value, a list, or None for nothing. With native=True it gets and returns columns: strings, and array<string> for lists.
"""

import inspect
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom.errors import MappingError

KINDS = {"int": int, "float": float, "str": str, "bool": lambda s: s.strip().lower() in ("true", "1"), "list": list}


@dataclass(frozen=True)
class Function:
    iri: str
    params: tuple[str, ...]
    kinds: tuple[str, ...]
    call: Callable
    native: bool
    many: bool


def fno_function(iri: str, params: Iterable[str] = (), native: bool = False):
    def mark(call: Callable) -> Callable:
        given = list(inspect.signature(call).parameters.values())
        names = list(params)
        if len(names) != len(given):
            raise MappingError(f"{call.__name__} has {len(given)} parameters, and {len(names)} IRIs for them")
        kind = lambda a: "str" if a is inspect.Parameter.empty else getattr(a, "__name__", str(a)).split("[")[0].replace("typing.", "").lower()
        kinds = tuple(kind(p.annotation) for p in given)
        if unknown := [k for k in kinds if k not in KINDS]:
            raise MappingError(f"{call.__name__}: no parameter can be of type {unknown[0]}")
        call.fno = Function(iri, tuple(names), kinds, call, native, kind(inspect.signature(call).return_annotation) == "list")
        return call

    return mark


class Registry:
    def __init__(self, functions: Iterable = ()):
        self.by_iri: dict[str, Function] = {}
        for f in functions:
            marked = [f] if hasattr(f, "fno") else [m for _, m in inspect.getmembers(f) if hasattr(m, "fno")]
            if not marked:
                raise MappingError(f"{f!r} is no marked function and holds none")
            for m in marked:
                fn = m.fno
                self.by_iri[fn.iri] = Function(fn.iri, fn.params, fn.kinds, m, fn.native, fn.many)

    def call(self, iri: str, args: dict[str, Column]) -> Column:
        """array<string>: what the function makes of its arguments (array<string> each; a missing one is null)."""
        if iri not in self.by_iri:
            raise MappingError(f"no function is registered for {iri}")
        fn = self.by_iri[iri]
        given = [args.get(p) for p in fn.params]
        none = F.array().cast("array<string>")
        if fn.native:
            columns = [_native(c, k) for c, k in zip(given, fn.kinds, strict=True)]
            out = fn.call(*columns)
            if fn.many:
                return F.coalesce(F.filter(out.cast("array<string>"), lambda x: x.isNotNull()), none)
            return F.when(out.isNull(), none).otherwise(F.array(out.cast("string")))
        have = [c is not None for c in given]

        @F.pandas_udf("array<string>")
        def apply(*series: pd.Series) -> pd.Series:
            rows = zip(*series, strict=True) if series else iter(())
            out = []
            for row in rows:
                left = iter(row)
                values = [_python(next(left) if h else None, k, fn) for h, k in zip(have, fn.kinds, strict=True)]
                out.append(_texts(fn.call(*values)))
            return pd.Series(out, dtype=object)

        columns = [c for c in given if c is not None] or [none]
        if not any(have):
            once = _texts(fn.call(*[_python(None, k, fn) for k in fn.kinds]))
            return F.array(*[F.lit(x) for x in once]).cast("array<string>")
        return apply(*columns)


def _native(column: Column | None, kind: str) -> Column:
    if kind == "list":
        return F.array_distinct(column) if column is not None else F.lit(None).cast("array<string>")
    if column is None:
        return F.lit(None).cast("string")
    one = F.when(F.size(column) > 1, F.raise_error(F.lit("a parameter got several values where one is expected")).cast("string")).otherwise(F.try_element_at(column, F.lit(1)))
    return one.cast({"int": "long", "float": "double", "bool": "boolean"}.get(kind, "string"))


def _python(values, kind: str, fn: Function):
    values = [] if values is None else list(dict.fromkeys(values))
    if kind == "list":
        return values
    if not values:
        return None
    if len(values) > 1:
        raise MappingError(f"{fn.iri}: a parameter got {len(values)} values; one is expected")
    return KINDS[kind](values[0])


def _texts(out) -> list[str]:
    items = out if isinstance(out, (list, tuple, set, frozenset)) else [out]
    return [("true" if x else "false") if isinstance(x, bool) else str(x) for x in items if x is not None]
