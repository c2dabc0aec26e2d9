"""Errors of the engine."""

from __future__ import annotations


class TesseraError(Exception):
    """Base of all errors raised here."""


class EmptyDataError(TesseraError):
    """A source holds no data."""


class UnsupportedFormatError(TesseraError):
    """A file is of no supported type."""


class InvalidDataError(TesseraError):
    """A source does not keep to its format."""


class DuplicateColumnError(InvalidDataError):
    """A header names a column twice."""


class DuplicateTableError(TesseraError):
    """Two sources would make tables of one name."""


class NoTablesError(TesseraError):
    """There is no table to write."""


class NotFoundError(TesseraError):
    """A path does not exist."""


class SqlError(TesseraError):
    """A statement is not understood or not supported."""
