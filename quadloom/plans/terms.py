"""Expression maps as columns.

A compiled map is `Terms`: `many`, an array of term structs, or, where a record gives one at most, `one`, a `Term` of
plain columns (plans stay free of arrays then). Every value is bound as a column of the records, once, whatever number of
statements use it; what can be decided when the plan is made (valid IRIs, language tags) is not asked of each record.
"""

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.errors import MappingError
from quadloom.expr import iri
from quadloom.expr.template import parse_template
from quadloom.functions import Registry
from quadloom.mapping.model import ExpressionMap, ObjectMap
from quadloom.rdf.terms import FNO, IRI, OLD_FNO, RDF, XSD, BNode, Literal
from quadloom.sources import Records

TERM = "struct<value:string,kind:string,datatype:string,lang:string>"
LANGUAGE_TAG = r"^([A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*|[xXiI](-[A-Za-z0-9]{1,8})+)$"
LANG_STRING = RDF + "langString"
# Texts of the types that are checked where asked for.
LEXICAL = {
    "integer": r"[+-]?[0-9]+",
    "decimal": r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)",
    "double": r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?INF|NaN",
    "float": r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?INF|NaN",
    "boolean": r"true|false|0|1",
    "date": r"-?[0-9]{4,}-[0-9]{2}-[0-9]{2}(?:Z|[+-][0-9]{2}:[0-9]{2})?",
    "dateTime": r"-?[0-9]{4,}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})?",
}
#: Bytes of files, times statements, that one task takes before a set (an estimate: tables pack their rows up to 30 times).
PIECE = 8 << 20
#: By place: the term types allowed, and the kinds of constant.
ALLOWED = {
    "subject": ({"iri", "bnode"}, (IRI,)),
    "predicate": ({"iri"}, (IRI,)),
    "object": ({"iri", "bnode", "literal"}, (IRI, Literal)),
    "graph": ({"iri"}, (IRI,)),
    "datatype": ({"iri"}, (IRI,)),
    "language": ({"literal"}, (Literal,)),
}


@dataclass(frozen=True)
class Options:
    base_iri: str = "http://example.com/base/"
    normalization: str | None = "NFC"
    upper_percent: bool = True
    on_error: str = "fail"
    validate: bool = False


@dataclass(frozen=True)
class Term:
    """A term that a record has once, or not at all if one of `needs` is null."""

    value: Column
    kind: str
    datatype: Column | None = None
    lang: Column | None = None
    needs: tuple[Column, ...] = ()

    @property
    def struct(self) -> Column:
        made = term(self.value, self.kind, self.datatype, self.lang)
        return F.when(there(self.needs), made) if self.needs else made


def fixed(text: str) -> Column:
    """A constant that is known to be one (see form)."""
    c = F.lit(text)
    vars(c)["form"] = (text, None)
    return c


def begun(prefix: str, rest: Column, column: Column | None = None) -> Column:
    """A column of texts that all begin with the prefix (see form). column: the whole text, if there is one."""
    if column is None and not prefix:
        return rest
    c = F.concat(F.lit(prefix), rest) if column is None else column
    vars(c)["form"] = (prefix, rest)
    return c


def form(c: Column) -> tuple[str, Column | None]:
    """What the plan knows of a column of texts: how all begin, and the column of what follows (none: nothing does)."""
    return vars(c).get("form") or ("", c)


def there(needs: tuple[Column, ...]) -> Column:
    """None of the columns is null."""
    each = list({str(c): c for c in needs}.values())
    test = each[0].isNotNull()
    for c in each[1:]:
        test = test & c.isNotNull()
    return test


@dataclass
class Terms:
    one: Term | None = None
    array: Column | None = None

    @property
    def many(self) -> Column:
        if self.array is not None:
            return self.array
        made = F.array(term(self.one.value, self.one.kind, self.one.datatype, self.one.lang))
        return F.when(there(self.one.needs), made).otherwise(F.array().cast(f"array<{TERM}>")) if self.one.needs else made


def term(value: Column, kind: str, datatype: Column | None = None, lang: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(value.alias("value"), F.lit(kind).alias("kind"), (none if datatype is None else datatype).alias("datatype"), (none if lang is None else lang).alias("lang")).cast(TERM)


@dataclass
class Texts:
    """The values of an expression, before they are terms. plain: known to be ASCII; safe: known to need no escape in
    IRIs; valid: known to be IRIs. constant: the same for all records."""

    one: Column | None = None
    array: Column | None = None
    plain: bool = False
    safe: bool = False
    valid: bool = False
    constant: bool = False
    #: The columns it is made of: it is null only if one of them is.
    parts: tuple[Column, ...] = ()

    @property
    def needs(self) -> tuple[Column, ...]:
        return () if self.constant else self.parts or (self.one,)

    @property
    def many(self) -> Column:
        if self.array is not None:
            return self.array
        return F.when(self.one.isNull(), F.array().cast("array<string>")).otherwise(F.array(self.one))


class Compiler:
    def __init__(self, records: Records, functions: Registry, options: Options):
        self.records, self.functions, self.options = records, functions, options
        self.bound: dict[object, Column] = {}
        self.levels: list[dict[str, Column]] = []
        self.level_of: dict[str, int] = {}

    def bind(self, column: Column, key: object = None) -> Column:
        """The column under a name of its own in the records: made once, and free to stand in lambdas."""
        if key is not None and key in self.bound:
            return self.bound[key]
        name = f"__bound{len(self.bound)}"
        # behind the columns it is made of; those of one level are added in one step
        level = 1 + max((self.level_of[n] for n in re.findall(r"__bound[0-9]+", str(column))), default=-1)
        self.level_of[name] = level
        while len(self.levels) <= level:
            self.levels.append({})
        self.levels[level][name] = column
        made = self.bound[name if key is None else key] = F.col(name)
        return made

    @property
    def df(self) -> DataFrame:
        """The records with the columns bound so far."""
        return self._over(self.records.df)

    def spread(self, statements: int) -> DataFrame:
        """As df, for a set of so many statements: records of files in pieces of even size (runs of 1,024 rows), so that what a task gathers before
        the shuffle does not grow with the files, whose blocks need not be small. Files give their rows in one order always,
        so a task that runs again deals them the same way."""
        df, pieces = self.records.df, -(-self.records.size * statements // PIECE)
        if pieces < 2:
            return self.df
        return self._over(df.withColumn("__at", F.shiftright(F.monotonically_increasing_id(), 10)).repartition(pieces, "__at").drop("__at"))

    def _over(self, df: DataFrame) -> DataFrame:
        for level in self.levels:
            df = df.withColumns(level)
        return df

    def terms(self, e: ExpressionMap, place: str) -> Terms:
        types, constants = ALLOWED[place]
        self._check(e)
        if e.constant is not None:
            if not isinstance(e.constant, constants):
                raise MappingError(f"{e.constant} cannot be a constant {place} ({e.id})")
            return Terms(_constant(e.constant))
        kind = self._kind(e, place)
        if kind not in types:
            raise MappingError(f"a {place} cannot be of term type {kind} ({e.id})")
        texts = self._texts(e, kind)
        if kind == "literal":
            return self._literals(e, texts)
        if kind == "bnode":
            if texts.one is not None and not texts.constant:
                texts = Texts(self.bind(iri.bnode(texts.one)), parts=texts.needs)
                return _mapped(texts, lambda v: v, "bnode")
            return _mapped(texts, iri.bnode, "bnode")
        base, on_error = self.options.base_iri, self.options.on_error
        if texts.one is None:
            made = Texts(array=self.bind(F.filter(F.transform(texts.many, lambda v: iri.to_iri(v, base, on_error)), lambda v: v.isNotNull())))
        elif texts.valid:
            made = texts
        else:
            made = Texts(self.bind(iri.to_iri(texts.one, base, on_error), ("iri", e.reference, e.template) if e.function is None else None))
        return _mapped(made, lambda v: v, "iri")

    def _check(self, e: ExpressionMap) -> None:
        given = [n for n in ("constant", "reference", "template", "function") if getattr(e, n) is not None]
        if len(given) != 1:
            raise MappingError(f"{e.id} must have one of constant, reference, template and function, and has {', '.join(given) or 'none'}")

    def _kind(self, e: ExpressionMap, place: str) -> str:
        if place in ("datatype", "language"):
            return "iri" if place == "datatype" else "literal"
        if e.term_type:
            return e.term_type
        if isinstance(e, ObjectMap) and (e.reference is not None or e.language is not None or e.datatype is not None):
            return "literal"
        return "iri"

    # -- values

    def reference(self, ref: str) -> Texts:
        one = self.records.one(ref)
        if one is not None:
            return Texts(self.bind(one, ("value", ref)), plain=self.records.plain(ref), safe=self.records.safe(ref))
        return Texts(array=self.bind(self.records.values(ref), ("values", ref)))

    def _texts(self, e: ExpressionMap, kind: str) -> Texts:
        if e.reference is not None:
            return self.reference(e.reference)
        if e.template is not None:
            return self.template(e.template, kind)
        found = self.bind(self.call(e))
        if kind == "iri":  # lenient: signs that no IRI has are escaped, others stay
            odd = iri.ODD
            form = self.options.normalization
            fix = lambda v: F.when(v.rlike(odd), F.array_join(F.transform(F.filter(F.split(v, ""), lambda c: c != ""), lambda c: F.when(c.rlike(odd), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)), "")).otherwise(v)
            return Texts(array=self.bind(F.transform(self.bind(_normal_array(found, form)), fix)))
        return Texts(array=found)

    def template(self, text: str, kind: str) -> Texts:
        parts = parse_template(text)
        o = self.options

        def safe(v: Column) -> Column:
            return iri.iri_safe(v, o.upper_percent) if kind == "iri" else v

        if not any(k == "expr" for k, _ in parts):
            whole = "".join(v for _, v in parts)
            return Texts(F.lit(whole), valid=re.match(iri.VALID, whole) is not None, constant=True)
        refs = [(k, self.reference(v) if k == "expr" else v) for k, v in parts]
        if all(k == "text" or r.one is not None for k, r in refs):

            def form(ref: str, r: Texts) -> Column:
                if kind != "iri" or r.safe:
                    return r.one
                if not r.plain and o.normalization is not None:
                    return self.bind(safe(self.bind(iri.normalized(r.one, o.normalization), ("normal", ref))), ("safe", ref))
                return self.bind(safe(r.one), ("safe", ref))

            used = tuple(r.one for k, r in refs if k == "expr")
            columns = [F.lit(r) if k == "text" else form(v, r) for (k, r), (_, v) in zip(refs, parts, strict=True)]
            if kind == "iri" and (prefix := iri.known_valid(parts, o.base_iri)) is not None:
                if prefix:
                    columns.insert(0, F.lit(prefix))
                begin = prefix + (parts[0][1] if parts[0][0] == "text" else "")
                follow = columns[bool(prefix) + (parts[0][0] == "text") :]
                rest = follow[0] if len(follow) == 1 else self.bind(F.concat(*follow), ("rest", text))
                whole = self.bind(F.concat(F.lit(begin), rest) if begin else rest, ("iri", None, text))
                return Texts(begun(begin, rest, whole), valid=True, parts=used)
            return Texts(self.bind(F.concat(*columns), ("template", text, kind)), parts=used)
        # position by position; of unequal lists an error, unless one is empty
        lists = [self.bind(_normal_array(r.many, o.normalization), ("normals", v)) if kind == "iri" else r.many for (k, r), (_, v) in zip(refs, parts, strict=True) if k == "expr"]
        sizes = [F.size(x) for x in lists]
        empty, unequal = sizes[0] == 0, F.lit(False)
        for s in sizes[1:]:
            empty, unequal = empty | (s == 0), unequal | (s != sizes[0])
        wrong = F.raise_error(F.lit(f"the values of the template {text!r} differ in number")).cast("array<string>")

        def joined(i: Column) -> Column:
            left = iter(lists)
            return F.concat(*[F.lit(r) if k == "text" else safe(F.element_at(next(left), i)) for k, r in refs])

        made = F.transform(F.sequence(F.lit(1), F.greatest(sizes[0], F.lit(1))), joined)
        return Texts(array=self.bind(F.when(empty, F.array().cast("array<string>")).when(unequal, wrong).otherwise(made), ("template", text, kind)))

    def call(self, e: ExpressionMap) -> Column:
        """array<string>: the function's results."""
        args: dict[str, Column] = {}
        name = None
        for pom in e.function.poms:
            for p in pom.predicates:
                if not isinstance(p.constant, IRI):
                    raise MappingError(f"a parameter of {e.function} is not named by a constant")
                for o in pom.objects:
                    if not isinstance(o, ObjectMap):
                        raise MappingError(f"a parameter of {e.function} cannot refer to a parent")
                    if p.constant.value in (FNO + "executes", OLD_FNO + "executes"):
                        if not isinstance(o.constant, (IRI, Literal)):
                            raise MappingError(f"{e.function} does not name its function by a constant")
                        name = o.constant.value
                        continue
                    values = F.transform(self.terms(o, "object").many, lambda t: t.value)
                    had = args.get(p.constant.value)
                    args[p.constant.value] = values if had is None else F.concat(had, values)
        if name is None:
            raise MappingError(f"{e.function} names no function to execute")
        return self.functions.call(name, args)

    # -- literals

    def _literals(self, e: ExpressionMap, texts: Texts) -> Terms:
        language, datatype = getattr(e, "language", None), getattr(e, "datatype", None)
        if language is None and datatype is None:
            return _mapped(texts, lambda v: v, "literal", fixed(XSD + "string"))
        if language is not None:
            return self._tagged(texts, self._tags(language))
        types = self.terms(datatype, "datatype")
        if texts.one is not None and types.one is not None:
            value = texts.one
            if self.options.validate:
                value = self.bind(checked(value, types.one.value))
            return Terms(Term(value, "literal", types.one.value, needs=texts.needs + types.one.needs))
        check = checked if self.options.validate else lambda v, _: v
        return Terms(array=F.flatten(F.transform(texts.many, lambda v: F.transform(types.many, lambda t: term(check(v, t.value), "literal", t.value)))))

    def _tags(self, language: ExpressionMap) -> Terms:
        if isinstance(language.constant, Literal):
            if not re.match(LANGUAGE_TAG, language.constant.value):
                raise MappingError(f"not a language tag: {language.constant.value}")
            return self.terms(language, "language")
        found = self.terms(language, "language")
        good = lambda t: F.when(t.rlike(LANGUAGE_TAG), t).when(t.isNotNull(), F.raise_error(F.concat(F.lit("not a language tag: "), t)).cast("string"))
        if found.one is not None:
            value = self.bind(good(found.one.value))
            return Terms(Term(value, "literal", needs=(value,)))
        return Terms(array=F.transform(found.array, lambda t: term(good(t.value), "literal")))

    def _tagged(self, texts: Texts, tags: Terms) -> Terms:
        if texts.one is not None and tags.one is not None:
            return Terms(Term(texts.one, "literal", fixed(LANG_STRING), tags.one.value, texts.needs + tags.one.needs))
        return Terms(array=F.flatten(F.transform(texts.many, lambda v: F.transform(tags.many, lambda t: term(v, "literal", F.lit(LANG_STRING), t.value)))))


def checked(value: Column, datatype: Column) -> Column:
    """The text of a literal, or an error where it is no text of its type."""
    wrong = F.raise_error(F.concat(F.lit("not a text of the type "), datatype, F.lit(": "), value)).cast("string")
    out = F.when(F.lit(False), value)
    for name, pattern in LEXICAL.items():
        out = out.when((datatype == XSD + name) & ~value.rlike(f"^(?:{pattern})$"), wrong)
    return out.otherwise(value)


def _normal_array(values: Column, form: str | None) -> Column:
    if form is None:
        return values

    @F.pandas_udf("array<string>")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda vs: None if vs is None else [None if v is None else unicodedata.normalize(form, v) for v in vs])

    return F.when(F.exists(values, lambda v: v.rlike(r"[^\x00-\x7F]")), apply(values)).otherwise(values)


def _mapped(texts: Texts, make: Callable[[Column], Column], kind: str, datatype: Column | None = None) -> Terms:
    if texts.one is not None:
        return Terms(Term(make(texts.one), kind, datatype, needs=texts.needs))
    return Terms(array=F.transform(texts.many, lambda v: term(make(v), kind, datatype)))


def _constant(c) -> Term:
    if isinstance(c, Literal):
        return Term(fixed(c.value), "literal", fixed(c.datatype), None if c.lang is None else fixed(c.lang))
    return Term(fixed(f"_:{c.value}" if isinstance(c, BNode) else c.value), "bnode" if isinstance(c, BNode) else "iri")
