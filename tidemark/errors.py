"""The errors of tables, transactions, loads, snapshots and vectors."""


class TidemarkError(Exception):
    pass


class KeyNotFound(TidemarkError):
    """An update or delete names a key that the table lacks."""


class DuplicateKey(TidemarkError):
    """A primary key or the key of a unique index would occur twice."""


class NullKey(TidemarkError):
    """Keys have no nulls."""


class KeyTooLong(TidemarkError):
    """An encoded key has more than 64 KiB."""


class KeyExhausted(TidemarkError):
    """No id is left after the largest one."""


class TableNotFound(TidemarkError):
    pass


class TypeMismatch(TidemarkError):
    """A table was defined with another schema or key."""


class DuplicateTableOpen(TidemarkError):
    """One transaction opens a table twice at once."""


class IndexNotFound(TidemarkError):
    pass


class IndexTypeMismatch(TidemarkError):
    """An index is of another kind, or its key has another type."""


class IndexAlreadyExists(TidemarkError):
    pass


class IndexDdlConflict(TidemarkError):
    """An index was defined on a table that another commit changed."""


class VersionNotFound(TidemarkError):
    pass


class ExplicitVersionRequired(TidemarkError):
    pass


class WriterBusy(TidemarkError):
    """A store with a single writer has a live one."""


class WriteConflict(TidemarkError):
    """Another commit, or another live writer, has the same keys.

    `holder` waits for that writer where it is live.
    """

    def __init__(self, message: str, table: str | None = None, version: int | None = None, holder=None):
        super().__init__(message)
        self.table, self.version, self.holder = table, version, holder


class SerializationFailure(TidemarkError):
    """A commit since the base wrote what this transaction read."""

    def __init__(self, message: str, table: str | None = None, version: int | None = None):
        super().__init__(message)
        self.table, self.version = table, version


class InvalidBulkLoad(TidemarkError):
    """The input of a load is out of order, or its buckets overlap."""


class RowCountMismatch(TidemarkError):
    pass


class SnapshotCorrupted(TidemarkError):
    """A snapshot lacks files, or their digests differ from those in its manifest."""


class LogCorrupted(TidemarkError):
    """A version's manifest can't be read, or names data that is not there."""


class UnknownTable(TidemarkError):
    """A snapshot has a table that the store doesn't know."""


class InvalidCommitVersion(TidemarkError):
    pass


class DimensionMismatch(TidemarkError):
    pass


class NotFinite(TidemarkError):
    """A vector has a NaN or an infinity."""


class NodeNotFound(TidemarkError):
    """No vector has this id."""


class InvalidParameters(TidemarkError):
    pass
