"""Errors raised before any Spark job starts, and the one a failed flow carries."""


class ConditionError(ValueError):
    """A filter condition is not a plain comparison over known columns."""


class UnsafeQueryError(ValueError):
    """A SQL text is not a single read-only statement."""


class FlowError(RuntimeError):
    """A flow failed; ``log`` holds the node records written so far."""

    def __init__(self, message, log=()):
        super().__init__(message)
        self.log = list(log)


class CycleInFlowError(ValueError):
    """The nodes of a flow depend on each other in a circle."""
