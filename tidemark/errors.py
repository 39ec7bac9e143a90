"""What can go wrong when tables are written or read at a position."""

from __future__ import annotations


class IngestError(Exception):
    """A failure of the write path."""


class RollbackBehindHistory(IngestError):
    """A rollback to before the oldest position that is still kept."""


class ResumingFailed(IngestError):
    """The source went back behind the last stable position while it was being drained."""


class NoIntersection(IngestError):
    """The source does not have the block from which it is to start."""


class InvalidTable(IngestError):
    """A stored table does not have the expected form."""


class StopIngest(IngestError):
    """The source asked to stop, or a table of the batch failed."""


class QueryError(Exception):
    """A failure of the read path."""


class AheadOfLastSync(QueryError):
    """The position asked for is newer than the tables; `partial` has what they know, if the query gives it."""

    def __init__(self, message: str, partial=None):
        super().__init__(message)
        self.partial = partial


class NotStoredAnymore(QueryError):
    """The position asked for was pruned."""


class SlotBoundsInvalid(QueryError):
    """Bounds that contradict each other or name something unknown."""
