"""Errors of patterns and events."""


class PatternError(ValueError):
    """Base of everything that can be wrong with a pattern or its registry."""


class InvalidPattern(PatternError):
    """Well-formed JSON that is no pattern."""


class InvalidJson(PatternError):
    """Text that is no JSON."""


class UnsupportedMediaType(PatternError):
    """A media type without a flattener, or two ways to flatten at once."""
