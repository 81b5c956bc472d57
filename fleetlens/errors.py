"""Errors of the library."""

from __future__ import annotations


class FleetError(Exception):
    """Base of all errors of this library."""


class EntityFailed(FleetError):
    """An entity's function failed; carries the entity and the cause as text."""

    def __init__(self, entity: object, cause: str):
        super().__init__(f"entity {entity!r} failed: {cause}")
        self.entity, self.cause = entity, cause


class RetriesExhausted(FleetError):
    """A function failed on its last attempt, or with an error that isn't retried."""

    def __init__(self, attempts: int, cause: BaseException):
        super().__init__(f"failed after {attempts} attempt(s): {type(cause).__name__}: {cause}")
        self.attempts, self.cause = attempts, cause


class CheckpointError(FleetError):
    """A checkpoint log can't be read or written."""


class MissingColumns(FleetError):
    """Columns that an operator needs are not there."""

    def __init__(self, missing: list[str], there: list[str]):
        super().__init__(f"missing columns {missing}; there are {there}")
        self.missing = missing


class SourceError(FleetError):
    """Base of errors of sources."""


class SourceNotFound(SourceError):
    """The path of a source doesn't exist."""


class SourceSchemaError(SourceError):
    """A source lacks columns its schema asks for."""


class SourceLoadError(SourceError):
    """A source can't be read."""


class ProfileError(FleetError):
    """A series can't be profiled."""


class GateError(FleetError, ValueError):
    """A gate's thresholds make no sense."""


class CliError(FleetError):
    """An error to show on the command line, with a hint."""

    def __init__(self, message: str, hint: str | None = None):
        super().__init__(message)
        self.hint = hint
