"""Analyses from the command line: python -m tidewater <command> ...; results go to standard output as JSON or text."""

from __future__ import annotations

import argparse
import json
import sys

from .errors import EngineError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m tidewater", description=__doc__)
    p.add_argument("--options", help="a JSON file of options merged over the defaults")
    sub = p.add_subparsers(dest="command", required=True)
    for name, what in (("tabular", "a CSV file"), ("timeseries", "a CSV file with times"), ("images", "a folder of images")):
        c = sub.add_parser(name, help=f"findings in {what}, as a report")
        c.add_argument("path")
        c.add_argument("--run-id", default="run")
        c.add_argument("--format", choices=("json", "markdown", "html"), default="json")
    c = sub.add_parser("memory", help="build a reference memory of a folder of ordinary images")
    c.add_argument("path")
    c.add_argument("out")
    c.add_argument("--coreset", choices=("none", "farthest_first"), default="none")
    c = sub.add_parser("score", help="score a folder of images against a reference memory")
    c.add_argument("memory")
    c.add_argument("path")
    c.add_argument("out")
    for name, what in (("validate-reports", "check all reports of a folder"), ("dashboard", "reviews a run: how many, of which label")):
        sub.add_parser(name, help=what).add_argument("path")
    c = sub.add_parser("check-manifest", help="check a benchmark manifest and its files")
    c.add_argument("path")
    c.add_argument("root")
    c = sub.add_parser("query", help="a query of the catalogue over a folder of tables, its first rows")
    c.add_argument("name")
    c.add_argument("path")
    c.add_argument("--rows", type=int, default=20)
    return p


def run(spark, a: argparse.Namespace) -> tuple[str, int]:
    """What to print, and the exit status."""
    from .plans import catalog, discovery, memory
    from .sources import reports, runs, tables

    options = json.loads(open(a.options).read()) if a.options else None
    lines = lambda df: "\n".join(json.dumps(r.asDict(recursive=True), default=str) for r in df.collect())
    if a.command in ("tabular", "timeseries", "images"):
        made = getattr(discovery, f"analyse_{a.command}")(spark, a.path, a.run_id, options)
        return {"json": discovery.to_json, "markdown": discovery.to_markdown, "html": discovery.to_html}[a.format](made), 0
    if a.command == "memory":
        return json.dumps(memory.build(spark, a.path, a.out, coreset=a.coreset), default=str), 0
    if a.command == "score":
        return memory.score_with(spark, a.memory, a.path, a.out, options), 0
    if a.command == "validate-reports":
        found = reports.validate(reports.read(spark, a.path))
        return lines(found.orderBy("path")), int(found.where("not is_valid").limit(1).count() > 0)
    if a.command == "dashboard":
        return lines(runs.label_rollup(runs.read_feedback(spark, a.path)).orderBy("run_id")), 0
    if a.command == "check-manifest":
        odd = tables.check_manifest(spark, a.path, a.root)
        return lines(odd.orderBy("sample_id", "name", "problem")), int(odd.limit(1).count() > 0)
    known = catalog.queries()
    if a.name not in known:
        raise EngineError(f"no query {a.name!r}", context={"known": sorted(known)})
    return lines(known[a.name](spark, a.path).limit(a.rows)), 0


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    if spark is None:
        from .session import local, ship

        spark = local()
        ship(spark)
    try:
        text, status = run(spark, a)
    except EngineError as e:
        print(json.dumps(e.to_dict(), default=str), file=sys.stderr)
        return 2
    except (ValueError, OSError) as e:
        print(json.dumps({"code": "error", "message": str(e), "context": {}}), file=sys.stderr)
        return 2
    print(text)
    return status


if __name__ == "__main__":
    sys.exit(main())
