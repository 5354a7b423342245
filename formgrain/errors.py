"""Errors that name a form; their class names travel as a column, so that a failing form is a row and not the end of a run."""

from __future__ import annotations


class PipelineError(Exception):
    """A step could not handle a form."""

    def __init__(self, message: str, form_id: str | None = None):
        super().__init__(f"[{form_id}] {message}" if form_id else message)
        self.form_id = form_id


class ConfigurationError(PipelineError):
    """A setting or a name is wrong."""


class StraighteningError(PipelineError):
    """A photo could not be straightened."""


class OcrError(PipelineError):
    """No text could be read."""


class StructuringError(PipelineError):
    """The text could not be turned into a record."""


class EvaluationError(PipelineError):
    """The answer key is incomplete."""
