"""One exception for each error code of the API."""


import re


def brief(error: Exception) -> str:
    """What an error says; of a failed query what it raised, without the traces of the engine."""
    text = str(error)
    raised = re.search(r"\[USER_RAISED_EXCEPTION\] (.*?)(?: SQLSTATE|\n|$)", text)
    return raised[1] if raised else text


class StoreError(Exception):
    code = "IO"


class InvalidArgument(StoreError):
    code = "INVALID_ARGUMENT"


class Conflict(StoreError):
    code = "CONFLICT"


class Corruption(StoreError):
    code = "CORRUPTION"


class Closed(StoreError):
    code = "CLOSED"


class Background(StoreError):
    code = "BACKGROUND"


class ModuleError(StoreError):
    code = "WASM"


class GuestFailed(StoreError):
    """A module ended with a code other than 0; nothing was committed."""

    code = "GUEST_FAILED"

    def __init__(self, exit_code: int, output: object = None):
        super().__init__(f"module failed with code {exit_code}: {output}")
        self.exit_code, self.output = exit_code or 1, output


class ProvenanceMismatch(StoreError):
    code = "PROVENANCE_MISMATCH"


class Gone(StoreError):
    code = "GONE"


class JournalGap(StoreError):
    code = "JOURNAL_GAP"


class OutputViolation(ModuleError):
    """A module's output doesn't fit what it declares; committed tells whether its writes were."""

    def __init__(self, message: str, committed: bool = False):
        super().__init__(message)
        self.committed = committed


class Lagged(StoreError):
    code = "LAGGED"
