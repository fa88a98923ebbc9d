"""Operators over change logs: pure functions from frames to frames."""

from tidemark.operators.compact import (
    fuse,
    level_loads,
    merge_anti,
    merge_levels,
    pick,
    seek_misses,
    shard_greedy,
)
from tidemark.operators.manifest import (
    contains,
    describe,
    garbage,
    meets,
    replay,
    run_scopes,
    scope_overlaps,
    stats,
    totals,
)
from tidemark.operators.read import (
    Bound,
    level_scan,
    multi_get,
    point_get,
    range_scan,
    seek,
)
from tidemark.operators.resolve import as_of, live, merge_runs, overlay, resolve
from tidemark.operators.write import (
    apply_commands,
    conflicts,
    flush_points,
    physical_size,
    put,
    remove,
    remove_failures,
)

__all__ = [
    "Bound", "apply_commands", "as_of", "conflicts", "contains", "describe", "flush_points", "fuse",
    "garbage", "level_loads", "level_scan", "live", "meets", "merge_anti", "merge_levels", "merge_runs",
    "multi_get", "overlay", "physical_size", "pick", "point_get", "put", "range_scan", "remove",
    "remove_failures", "replay", "resolve", "run_scopes", "scope_overlaps", "seek", "seek_misses",
    "shard_greedy", "stats", "totals",
]
