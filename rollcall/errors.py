"""Exceptions raised while a plan is built; a lazy plan that is returned is already checked."""


class RollcallError(Exception):
    """Base class; ``code`` is a stable machine-readable reason."""

    code = "ERROR"

    def __init__(self, message: str, code: str | None = None):
        super().__init__(message)
        if code is not None:
            self.code = code


class InputError(RollcallError):
    """A list, spec or dictionary cannot be used at all; aborts the run."""

    code = "INPUT"


class EmptyInputError(InputError):
    code = "EMPTY"


class StageError(RollcallError):
    """One stage failed; the run goes on and reports the stage as failed."""

    code = "STAGE"


class CriticalError(RollcallError):
    """Aborts the whole run."""

    code = "CRITICAL"
