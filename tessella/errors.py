"""Exceptions raised by guards and sinks."""


class LeakageError(ValueError):
    """A row that must not take part in fitting reached a fit boundary."""


class OutputExistsError(FileExistsError):
    """A sink refused to replace an existing output."""


class PinConflictError(ValueError):
    """An incoming digest contradicts one that is already pinned."""


class RecordSchemaError(ValueError):
    """A record or model artifact breaks its closed schema."""


class SizeBoundError(ValueError):
    """Something meant to be small enough for the driver or a broadcast is not."""
