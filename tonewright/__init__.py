"""Spark-native analytics of note events: the operators a user starts from."""

from .operators.cache import Cache
from .operators.cleanup import clean, stats
from .operators.grid import apply, release
from .operators.run import Run, process
from .schema import CleanupParams

__all__ = ["Cache", "CleanupParams", "Run", "apply", "clean", "process", "release", "stats"]
