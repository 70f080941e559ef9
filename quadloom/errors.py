class MappingError(ValueError):
    """A mapping that cannot be planned, or data that a mapping cannot take."""
