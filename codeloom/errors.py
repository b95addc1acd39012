class CodeloomError(Exception):
    """Base of all errors raised here."""


class PathOutsideRoot(CodeloomError):
    """A path leaves the repository, or names a file that is never served."""


class IndexMissing(CodeloomError):
    """No index has been written yet."""


class SymbolMissing(CodeloomError):
    """No symbol matches."""


class AmbiguousSymbol(CodeloomError):
    """Several symbols match."""

    def __init__(self, query, candidates):
        super().__init__(f"'{query}' matches {len(candidates)} symbols")
        self.candidates = candidates


class UnsupportedLanguage(CodeloomError):
    """No parser for a file."""


class CommitConflict(CodeloomError):
    """Another writer committed first."""
