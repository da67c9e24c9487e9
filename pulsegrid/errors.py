"""Classified refusals: invalid input is refused with a stable code, never repaired."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The codes of every refusal.
ERROR_CODES = (
    "invalid-input",
    "unsupported-format",
    "incompatible-sample-rate",
    "malformed-signal",
    "numerical-failure",
    "dsp-failure",
    "model-loading-failure",
    "model-compatibility-failure",
    "inference-failure",
    "request-superseded",
    "visualization-failure",
    "file-not-found",
    "malformed-header",
    "annotation-parse-error",
)


class SignalError(Exception):
    """An error with one of ERROR_CODES, and optional detail, metadata and cause."""

    def __init__(self, code: str, message: str, detail: str | None = None, meta: dict | None = None):
        if code not in ERROR_CODES:
            raise ValueError(f"unknown error code {code!r}")
        super().__init__(message if detail is None else f"{message} {detail}")
        self.code, self.message, self.detail, self.meta = code, message, detail, meta or {}

    def __reduce__(self):
        return type(self), (self.code, self.message, self.detail, self.meta)

    @property
    def envelope(self) -> dict:
        return {"code": self.code, "message": str(self)}


def is_error_code(value: object) -> bool:
    return isinstance(value, str) and value in ERROR_CODES


def is_error_code_column(value: Column) -> Column:
    return F.coalesce(value.isin(*ERROR_CODES), F.lit(False))


def refuse_where(condition: Column, code: str, message: Column | str, value: Column) -> Column:
    """value, or a failed query whose message starts with the code where condition is true."""
    text = F.concat(F.lit(f"[{code}] "), message if isinstance(message, Column) else F.lit(message))
    return F.when(F.coalesce(condition, F.lit(False)), F.raise_error(text).cast("double")).otherwise(value)


def error_envelope(cause: BaseException, fallback: str) -> dict:
    """{code, message} of any exception; one without a code gets `fallback` (dsp-failure or inference-failure)."""
    return cause.envelope if isinstance(cause, SignalError) else {"code": fallback, "message": str(cause)}
