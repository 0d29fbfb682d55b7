"""Errors with codes and hints, and what may be told about them."""

from __future__ import annotations

import re

#: Parts of names whose values are never told.
SENSITIVE = ("password", "secret", "token", "apikey", "api_key", "authorization", "credential")


class VectrineError(Exception):
    """Base of the errors that carry a code."""

    code = "ERROR"
    hint = ""

    def __init__(self, message: str, **context):
        super().__init__(message)
        self.context = redacted(context)

    def told(self) -> dict:
        """Code, message, hint and context, without secrets."""
        return {"code": self.code, "message": str(self), "hint": self.hint, "context": self.context}


class DimensionMismatch(VectrineError):
    code, hint = "DIMENSION_MISMATCH", "give vectors of the collection's dimension"


class InvalidInput(VectrineError):
    code, hint = "INVALID_INPUT", "see the limits in vectrine.operators.validate"


class BatchFailed(VectrineError):
    code, hint = "BATCH_FAILED", "the report names the rows that failed; the others are stored"


class StorageFailed(VectrineError):
    code, hint = "STORAGE_FAILED", "check the folder and its rights, then run again: a commit is all or nothing"


class IndexFailed(VectrineError):
    code, hint = "INDEX_FAILED", "search exactly, or build the index anew"


def redacted(values: dict) -> dict:
    """The values, with secrets replaced by stars."""
    secret = re.compile("|".join(SENSITIVE), re.I)
    return {k: "***" if secret.search(k) else redacted(v) if isinstance(v, dict) else v for k, v in values.items()}
