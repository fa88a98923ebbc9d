"""Command line of a store: ``python -m tidemark.cli --path DIR COMMAND ...``.

Keys and values are text.  ``batch-set`` takes as many values as keys, all keys first.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tidemark.errors import StoreError
from tidemark.sources import Config, KVStore


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    out.add_argument("--path", default="./data")
    commands = out.add_subparsers(dest="command", required=True)
    for name, args in {
        "set": ("key", "value"), "get": ("key",), "remove": ("key",), "flush": (), "len": (), "size-of-disk": (), "describe": (),
    }.items():
        sub = commands.add_parser(name)
        for a in args:
            sub.add_argument(a)
    for name in ("batch-set", "batch-get", "batch-remove"):
        commands.add_parser(name).add_argument("items", nargs="+")
    scan = commands.add_parser("scan")
    scan.add_argument("--low")
    scan.add_argument("--high")
    return out


def run(spark: SparkSession, args: argparse.Namespace, out=print) -> int:
    store = KVStore.open(spark, args.path, Config(key_type="string", value_type="string", auto=False))
    keys = lambda items: spark.createDataFrame(list(enumerate(items)), "ord int, key string")
    match args.command:
        case "set":
            store.set(args.key, args.value)
        case "get":
            got = store.get(args.key)
            if got is None:
                out("not found")
                return 1
            out(got)
        case "remove":
            store.remove(args.key)
        case "flush":
            store.flush()
        case "len":
            out(len(store))
        case "size-of-disk":
            out(store.size_of_disk())
        case "describe":
            for row in store.describe().orderBy("level").collect():
                out(f"level {row['level']}: {row['scopes']}")
        case "batch-set":
            half, odd = divmod(len(args.items), 2)
            if odd:
                out("as many values as keys")
                return 2
            rows = list(zip(range(half), args.items[:half], args.items[half:], strict=True))
            store.put(spark.createDataFrame(rows, "ord int, key string, value string"), "ord")
        case "batch-get":
            for row in store.multi_get(keys(args.items), "ord").collect():
                out(f"{row['key']}\t{row['value'] if row['found'] else ''}")
        case "batch-remove":
            for row in store.remove_all(keys(args.items), "ord").collect():
                out(f"not removed: {row['key']}")
        case "scan":
            from tidemark.operators import Bound

            ends = [None if x is None else Bound(x) for x in (args.low, args.high)]
            for row in store.snapshot().range(*ends, tombstones=False).toLocalIterator():
                out(f"{row['key']}\t{row['value']}")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    try:
        return run(spark, args)
    except StoreError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
