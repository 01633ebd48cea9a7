"""Errors that the operators raise; all are ValueErrors."""


class QuantError(ValueError):
    """Base of all errors."""


class InsufficientData(QuantError):
    pass


class DimensionMismatch(QuantError):
    pass


class InvalidParameter(QuantError):
    pass


class EmptySeries(QuantError):
    pass


class ComputationFailed(QuantError):
    pass


class ConvergenceFailure(QuantError):
    pass


class IndexOutOfBounds(QuantError):
    pass


class NotPositiveDefinite(QuantError):
    pass
