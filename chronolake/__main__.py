"""python -m chronolake ingest|export|list: the batch commands."""

from __future__ import annotations

import argparse
import json
import sys

from .catalog.store import Catalog
from .plans import catalog_query, ingest
from .plans.lod import window_ms
from .session import session
from .sinks.export import export_series, safe_filename


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser("chronolake")
    parser.add_argument("--catalog", required=True)
    parser.add_argument("--lake", required=True)
    commands = parser.add_subparsers(dest="command", required=True)
    take = commands.add_parser("ingest", help="make tests of files; a file that fails is reported and the others go on")
    take.add_argument("paths", nargs="+")
    take.add_argument("--rule", help="a JSON file with an ingest rule")
    give = commands.add_parser("export", help="write channels of a test as long rows")
    give.add_argument("test", type=int)
    give.add_argument("folder")
    give.add_argument("--channels", nargs="*")
    give.add_argument("--from", dest="start")
    give.add_argument("--to", dest="end")
    give.add_argument("--format", choices=("csv", "parquet"), default="csv")
    commands.add_parser("list", help="the newest tests").add_argument("--limit", type=int, default=20)
    return parser.parse_args(argv)


def main(argv: list[str] | None = None, spark=None) -> int:
    """The exit status: 1 if any file failed."""
    given = arguments(argv)
    catalog = Catalog(spark or session(), given.catalog)
    if given.command == "ingest":
        rule = ingest.IngestRule()
        if given.rule:
            with open(given.rule, encoding="utf-8") as f:
                rule = ingest.clean_rule(json.load(f))
        report = ingest.ingest_many(catalog, given.lake, given.paths, rule)
        for row in report:
            print(json.dumps(row))
        return int(any(r["error"] for r in report))
    if given.command == "export":
        start, end = window_ms([given.start, given.end])
        rows = catalog_query.catalog_series(catalog, given.lake, given.test, given.channels or None, start, end)
        path = f"{given.folder.rstrip('/')}/{safe_filename(catalog.get_test(given.test)['run_code'])}"
        export_series(rows, path, given.format, "overwrite")
        print(path)
        return 0
    for row in catalog.list_tests(given.limit).collect():
        print(json.dumps({"test_id": row.test_id, "run_code": row.run_code, "status": row.status}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
