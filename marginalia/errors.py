"""Errors raised by the jobs."""


class MarginaliaError(Exception):
    """Base of all errors raised here."""


class MissingColumnError(MarginaliaError):
    """A required column is not in the table."""


class StrictInputError(MarginaliaError):
    """The table breaks a rule of the strict input check."""


class TrainingDataError(MarginaliaError):
    """The labelled table fails a training gate."""


class VocabularyError(MarginaliaError):
    """A label column has too many distinct values to be a label column."""


class KeyNotUniqueError(MarginaliaError):
    """A key that must identify rows repeats."""
