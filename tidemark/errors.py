"""Errors of the store and its operators."""


class StoreError(Exception):
    """Base of all errors below."""


class KeyNotFound(StoreError):
    """A key to remove is absent or already removed."""


class RepeatedWrite(StoreError):
    """A transaction wrote a key that was committed after it began."""


class ProcessExists(StoreError):
    """Another writer holds the store or won every race for the next version."""


class NotSupported(StoreError):
    """The operation has no meaning here, such as seeking in overlapping runs."""


class LevelOver(StoreError):
    """A level beyond the deepest one."""


class DataEmpty(StoreError):
    """An operation that needs rows found none."""
