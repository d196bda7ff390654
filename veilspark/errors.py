"""Errors with a stable code."""

INVALID_RULE, UNKNOWN_RULE, INVALID_KEY, INVALID_OPTION, ABORTED = "INVALID_RULE", "UNKNOWN_RULE", "INVALID_KEY", "INVALID_OPTION", "ABORTED"


class SanitizerError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code

    def __reduce__(self):
        return SanitizerError, (self.code, str(self))


def is_sanitizer_error(value: object) -> bool:
    return isinstance(value, SanitizerError)
