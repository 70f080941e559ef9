"""The engine: a mapping, and the DataFrame of quads that it makes."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.errors import MappingError
from quadloom.functions import Registry
from quadloom.mapping.loader import load_mapping
from quadloom.mapping.model import LogicalSource, RefObjectMap, TriplesMap, mappable, texts_read
from quadloom.plans.sets import Source, quads_of
from quadloom.plans.terms import Compiler, Options
from quadloom.plans.triples import COLUMNS, QUAD, MapPlan, branches, constant_of, fused, joined
from quadloom.rdf.terms import QL
from quadloom.sources import FORMULATIONS, Records, check_iterator, file_resolver, first_of

#: The name under which the unnamed stream is given.
DEFAULT_STREAM = "DEFAULT"


class Mapper:
    """Compiles a mapping for Spark.

    mapping: triples maps, or anything `load_mapping` takes. base_iri: put before values that are no IRIs themselves.
    resolvers: callables from a source's path to a path or DataFrame, asked in turn (default: files below the working
    folder). functions: marked functions, or objects that hold some. formulations: more reference formulations by IRI.
    normalization: Unicode form in IRIs (None: sources are known to be in it, and plans stay free of Python). on_error: "fail",
    or "skip" to leave out terms that are no valid IRIs. validate: texts of literals must be texts of their XSD type.
    layout: "fused", "union", or None to choose (union where predicates are filtered). options: of sources (`lines`: JSON
    lines; `multiline`: whether CSV files have line breaks in quotes and so cannot be split, None to look; `text_extraction`:
    False gives XML nodes as XML). compiler: a subclass of Compiler that makes terms in its own way.
    """

    def __init__(self, mapping, *, spark: SparkSession | None = None, base_iri: str = Options.base_iri, resolvers: Iterable[Callable] | None = None, functions: Iterable = (), formulations: Mapping[str, Callable] | None = None, normalization: str | None = "NFC", upper_percent: bool = True, on_error: str = "fail", validate: bool = False, layout: str | None = None, options: dict | None = None, compiler: type[Compiler] = Compiler):
        maps = mapping if isinstance(mapping, list) else load_mapping(mapping)
        if normalization not in (None, "NFC", "NFD", "NFKC", "NFKD") or on_error not in ("fail", "skip") or layout not in (None, "fused", "union"):
            raise MappingError("an option of the mapper has an unknown value")
        self.spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        self.triples_maps: list[TriplesMap] = mappable(maps)
        if not self.triples_maps:
            raise MappingError("the mapping has no triples map to execute")
        self.all_maps = maps
        self.options = Options(base_iri, normalization, upper_percent, on_error, validate)
        self.resolve = first_of(resolvers if resolvers is not None else [file_resolver(os.getcwd())])
        self.functions = Registry(functions)
        self.formulations = {**FORMULATIONS, **(formulations or {})}
        self.layout, self.source_options, self.compiler = layout, options or {}, compiler
        self._validate()

    def _validate(self) -> None:
        """What must hold before any record is read."""
        for m in self.triples_maps:
            if m.source is None or m.source.source is None:
                raise MappingError(f"{m} has no logical source with a source")
            self._formulation(m.source)
            check_iterator(m.source)
            for pom in m.poms:
                if not pom.predicates or not pom.objects:
                    raise MappingError(f"a predicate-object map of {m} lacks predicates or objects")
        csv: dict[object, LogicalSource] = {}
        for m in self.triples_maps:
            if m.source.formulation == QL + "CSV" and csv.setdefault(m.source.source, m.source) != m.source:
                raise MappingError(f"the CSV source {m.source.source.path} has several logical sources")

        text = F.col("id").cast("string")
        dry = self.compiler(Records(self.spark.range(0), lambda ref: F.array(text), lambda ref: text, lambda ref: True, lambda ref: True), self.functions, self.options)
        for m in self.triples_maps:
            MapPlan(m, dry, lambda parent, m=m: parent.source == m.source).plan()
        for m in self.triples_maps:
            for o in (o for pom in m.poms for o in pom.objects if isinstance(o, RefObjectMap)):
                if o.parent.source is None or o.parent.source.source is None:
                    raise MappingError(f"{o.parent} is a parent and has no logical source")

    def register_formulation(self, iri: str, reader: Callable) -> None:
        self.formulations[iri] = reader

    def _formulation(self, logical: LogicalSource) -> Callable:
        if logical.formulation not in self.formulations:
            raise MappingError(f"no reader is known for the reference formulation {logical.formulation}")
        return self.formulations[logical.formulation]

    def _records(self, logical: LogicalSource, streams: Mapping[str, DataFrame], provided: DataFrame | None) -> Records:
        read = self._formulation(logical)
        options = self.source_options | {"references": texts_read(self.triples_maps, logical)}
        if provided is not None:
            return read(self.spark, logical, provided, True, options)
        src = logical.source
        if src.is_stream:
            name = src.stream or DEFAULT_STREAM
            if name not in streams:
                raise MappingError(f"no stream is given for {name!r}")
            found: object = streams[name]
        else:
            found = self.resolve(src.path or "")
            if found is None:
                raise MappingError(f"the source {src.path!r} is not found")
        return read(self.spark, logical, found, False, options)

    def map(self, streams: Mapping[str, DataFrame] | DataFrame | None = None, triples_maps: Iterable[TriplesMap | str] | None = None, predicates: Iterable[str] | None = None, _provided: DataFrame | None = None) -> DataFrame:
        """The quads, as a bag. triples_maps: only these (or ids); a parent that is left out joins nothing."""
        predicates = None if predicates is None else list(predicates)
        sources, layout = self._sources(streams, triples_maps, predicates, _provided)
        make = fused if layout == "fused" else branches
        made = [(branches if source.joined else make)(source.df, source.statements) for source in sources]
        out = made[0] if made else self._nothing()
        for more in made[1:]:
            out = out.unionByName(more)
        return self._filtered(out.select(*COLUMNS), predicates)

    def _nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], QUAD[len("struct<") : -1])

    def _filtered(self, out: DataFrame, predicates: Iterable[str] | None) -> DataFrame:
        return out if predicates is None else out.where(F.col("predicate").isin(*predicates))

    def _sources(self, streams, triples_maps, predicates, _provided, as_set: bool = False) -> tuple[list[Source], str]:
        """Records with the statements that they make, and the layout."""
        if isinstance(streams, DataFrame):
            streams = {DEFAULT_STREAM: streams}
        chosen = self.triples_maps
        if triples_maps is not None:
            ids = {m if isinstance(m, str) else m.id for m in triples_maps}
            chosen = [m for m in chosen if m.id in ids or m.id.strip("<>") in ids]
            if not chosen:
                raise MappingError("none of the triples maps is of this mapping")
        wanted = set(predicates) if predicates is not None else None
        layout = self.layout or ("union" if wanted is not None else "fused")
        compilers: dict[LogicalSource, Compiler] = {}
        for m in chosen:
            if m.source not in compilers:
                compilers[m.source] = self.compiler(self._records(m.source, streams or {}, _provided), self.functions, self.options)
        parts, statements = [], {}
        for m in chosen:
            c = compilers[m.source]
            plan = MapPlan(m, c, lambda parent, m=m: parent.source == m.source).plan()
            statements.setdefault(m.source, []).extend(s for s in plan.statements if wanted is None or s.predicate is None or s.predicate in wanted)
            for ref, terms in plan.joins:
                p = constant_of(terms[1])
                if ref.parent in chosen and (wanted is None or p is None or p in wanted):
                    df, made = joined(c, ref, terms, compilers[ref.parent.source])
                    parts.append(Source(df, [made], joined=True))
        return [Source(compilers[source].spread(len(found)) if as_set and layout == "fused" else compilers[source].df, found) for source, found in statements.items() if found] + parts, layout

    def map_to_model(self, streams: Mapping[str, DataFrame] | DataFrame | None = None, triples_maps: Iterable[TriplesMap | str] | None = None, predicates: Iterable[str] | None = None) -> DataFrame:
        """The quads, as a set."""
        predicates = None if predicates is None else list(predicates)
        sources, layout = self._sources(streams, triples_maps, predicates, None, as_set=True)
        return self._filtered(quads_of(sources, layout) if sources else self._nothing(), predicates)

    def map_record(self, record, triples_maps: Iterable[TriplesMap | str] | None = None) -> DataFrame:
        """The quads of one record: a dict (CSV, table), text (JSON, XML), or a dict or list for JSON."""
        chosen = self.triples_maps
        if len({m.source.source for m in chosen}) > 1:
            raise MappingError("a record can be given to a mapping of one source only")
        formulation = chosen[0].source.formulation
        if formulation == QL + "JSONPath" and not isinstance(record, str):
            record = json.dumps(record, ensure_ascii=False)
        if isinstance(record, str):
            df = self.spark.createDataFrame([(record,)], "value string")
        else:
            df = self.spark.createDataFrame([tuple(None if v is None else str(v) for v in record.values())], ", ".join(f"`{k}` string" for k in record))
        return self.map(triples_maps=triples_maps, _provided=df)
