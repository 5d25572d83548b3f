"""Errors, with the place in the source where there is one."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SourceLocation:
    """File, and line and column counted from 1."""

    file: str
    line: int
    column: int


class EngineError(Exception):
    """Base of this package's errors."""


class SourceIOError(EngineError):
    """A source can't be opened or read."""


class InvalidArgumentError(EngineError, ValueError):
    """An argument breaks a documented condition."""


class ResourceError(EngineError):
    """Something doesn't fit the memory it was given."""


class FastxParseError(EngineError, ValueError):
    """A FASTA or FASTQ source is malformed."""

    def __init__(self, message: str, location: SourceLocation):
        super().__init__(f"{location.file}:{location.line}:{location.column}: {message}")
        self.message, self.location = message, location

    def __reduce__(self):
        return FastxParseError, (self.message, self.location)
