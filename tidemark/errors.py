"""Errors that callers can tell apart."""


class TidemarkError(ValueError):
    """A request that can't be answered as it stands."""


class InvalidQuery(TidemarkError):
    pass


class UnknownMeasurement(TidemarkError):
    pass


class ConflictingTypes(TidemarkError):
    """A field arrived with two types."""
