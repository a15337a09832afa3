"""Errors of the engine. Plan-time errors are raised on the driver; row-time errors become NULL, a column, or fail the job, as asked."""


class JsonError(ValueError):
    """Base class; kind names the sort of error in error columns."""

    kind = "Json"


class PathNotFound(JsonError):
    kind = "PathNotFound"


class InvalidSyntax(JsonError):
    kind = "InvalidJsonSyntax"


class InvalidPath(JsonError):
    kind = "InvalidPath"


class IndexOutOfBounds(JsonError):
    kind = "IndexOutOfBounds"


class TypeMismatch(JsonError):
    kind = "TypeMismatch"


class ExpressionError(JsonError):
    kind = "Jmespath"


class DecodeError(JsonError):
    kind = "Decode"


class MissingField(JsonError):
    kind = "MissingField"


class UnknownField(JsonError):
    kind = "UnknownField"


class LimitExceeded(JsonError):
    kind = "LimitExceeded"


#: What a function of JSON text may raise for a row: its own errors, and those of documents too deep or of strings that are no Unicode.
ROW_ERRORS = (JsonError, RecursionError, UnicodeError)


def described(error: Exception) -> str:
    """The text of a row's error."""
    if isinstance(error, JsonError):
        return f"{error.kind}: {error}"
    return f"{LimitExceeded.kind}: nested too deep" if isinstance(error, RecursionError) else f"{DecodeError.kind}: a lone surrogate"
