"""The Parquet store: run files, manifest, transactions, command logs."""

from tidemark.sources.backend import MemoryStore, Storage
from tidemark.sources.commandlog import CommandLog
from tidemark.sources.manifest import Edit, Manifest, Run
from tidemark.sources.runs import read_runs, write_run
from tidemark.sources.store import Config, KVStore, Snapshot, Transaction

__all__ = [
    "CommandLog", "Config", "Edit", "KVStore", "Manifest", "MemoryStore", "Run", "Snapshot", "Storage", "Transaction", "read_runs",
    "write_run",
]
