"""A mapping engine for Spark: declarative mappings from CSV, JSON, XML and tables to RDF quads."""

from quadloom.errors import MappingError
from quadloom.functions import fno_function
from quadloom.mapper import Mapper
from quadloom.mapping.loader import load_mapping, to_turtle
from quadloom.rdf.nquads import to_nquads, to_trig, write_nquads

__all__ = ["Mapper", "MappingError", "fno_function", "load_mapping", "to_nquads", "to_trig", "to_turtle", "write_nquads"]
