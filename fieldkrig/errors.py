"""Errors that operators raise."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class EngineError(ValueError):
    """Base of all errors of this package."""


class InsufficientData(EngineError):
    pass


class DimensionMismatch(EngineError):
    pass


class SingularSystem(EngineError):
    pass


class InvalidParameter(EngineError):
    pass


class NoNeighbors(EngineError):
    pass


class DuplicatePoints(EngineError):
    pass
