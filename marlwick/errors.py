"""Errors of the engine; what Spark raises while a query runs is left as it is."""


class EngineError(Exception):
    pass


class ParseError(EngineError):
    """The text is not in the dialect."""


class BindError(EngineError):
    """Names, types or clauses don't fit."""


class SecurityError(EngineError):
    """A role lacks a right, or a row policy forbids a row."""


class ConstraintError(EngineError):
    """A row breaks NOT NULL, a unique index or a foreign key."""


class StoreError(EngineError):
    """There is no folder for files that all executors can read."""
