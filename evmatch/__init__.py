"""evmatch: declarative JSON patterns matched against DataFrames and streams."""

from evmatch.errors import InvalidJson, InvalidPattern, PatternError, UnsupportedMediaType
from evmatch.operators.flatten import ExactFlattener, TypedFlattener, VariantFlattener
from evmatch.operators.registry import Builder, PatternSet, PrunerStats, ValueMatcher

__all__ = [
    "Builder", "ExactFlattener", "InvalidJson", "InvalidPattern", "PatternError", "PatternSet", "PrunerStats", "TypedFlattener",
    "UnsupportedMediaType", "ValueMatcher", "VariantFlattener",
]
