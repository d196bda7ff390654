"""Command line: python -m veilspark IN [OUT] [options]. Exit code 0, 1 if the run fails, 2 for wrong usage, 3 for --fail-on-match."""

from __future__ import annotations

import argparse
import json
import sys
import uuid
from pathlib import Path

from .errors import ABORTED, SanitizerError, is_sanitizer_error
from .functions.builtin_rules import BUILTIN
from .functions.rules import Rule
from .operators.report import report_text


def _lines(path: str | None) -> list[str]:
    return [x for x in Path(path).read_text(encoding="utf-8").splitlines() if x.strip()] if path else []


def rules_from_json(text: str) -> list[Rule]:
    """Rules of a data file: a list of objects; nothing in it is run."""
    kinds = {"patterns", "aggressive", "json_keys", "json_key_contains"}
    return [Rule(**{k: tuple(v) if k in kinds else v for k, v in r.items()}) for r in json.loads(text)]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veilspark", description="Redacts log lines and reports what was found.")
    p.add_argument("input", help="file or folder; - for standard input")
    p.add_argument("output", nargs="?", help="folder; IN.sanitized if not given")
    p.add_argument("--files", action="store_true", help="a file of its own for each input file, with its name, order and last line")
    p.add_argument("--progress", action="store_true", help="lines and tasks on standard error as --files goes on")
    p.add_argument("--stdout", action="store_true", help="lines go to standard output, in order")
    p.add_argument("--key")
    p.add_argument("--key-file")
    p.add_argument("--key-encoding", choices=["utf8", "hex"], default="utf8")
    p.add_argument("--print-key", action="store_true")
    p.add_argument("--rules", help="JSON file with more rules")
    p.add_argument("--include", help="ids of built-in rules, comma-separated")
    p.add_argument("--exclude", help="ids to leave out")
    p.add_argument("--never", help="file of values that stay")
    p.add_argument("--always", help="file of values that always go")
    p.add_argument("--aggressive", action="store_true")
    p.add_argument("--no-json", action="store_true")
    p.add_argument("--report-only", action="store_true")
    p.add_argument("--report", help="file for the report: counts, totals, replacements, preview")
    p.add_argument("--report-format", choices=["json", "text"], default="json")
    p.add_argument("--replacements", type=int, default=1000, help="distinct replacements of a rule in the report, at most")
    p.add_argument("--preview", type=int, default=0, help="characters of preview in the report")
    p.add_argument("--context", type=int, default=0, help="characters around a replacement's first place")
    p.add_argument("--fail-on-match", action="store_true", help="exit code 3 if anything was found")
    p.add_argument("--quiet", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 2
    from pyspark.sql import SparkSession

    from .plans.sanitizer import Sanitizer
    from .shipping import ship
    from .sources.bounded import opened
    from .sources.shared import shared_dir

    try:
        ids = [x for x in (args.include or ",".join(BUILTIN)).split(",") if x not in (args.exclude or "").split(",")]
        extra = rules_from_json(Path(args.rules).read_text(encoding="utf-8")) if args.rules else []
        key = Path(args.key_file).read_text(encoding="utf-8").strip() if args.key_file else args.key
        sanitizer = Sanitizer(key, args.key_encoding if key else "hex", ids, extra, args.aggressive, not args.no_json, always_values=_lines(args.always), never_values=_lines(args.never), context_chars=args.context)
        if args.print_key:
            sys.stderr.write(f"key: {sanitizer.key}\n")
        spark = SparkSession.builder.getOrCreate()
        ship(spark)
        source = args.input
        if source == "-":  # the driver's standard input, spooled as it comes: executors read it in ranges
            source = f"{shared_dir(spark)}/stdin-{uuid.uuid4().hex}"
            store, at = opened(source)
            with store.open_output_stream(at) as out:
                read = getattr(sys.stdin, "buffer", sys.stdin).read
                while block := read(1 << 20):
                    out.write(block if isinstance(block, bytes) else block.encode())
        target = None if args.report_only else args.output or (None if args.stdout else f"{args.input}.sanitized" if args.input != "-" else None)
        if args.files and target is not None:
            kept, told = None, (lambda p: sys.stderr.write(f"lines: {p['lines']}, tasks: {p['tasks_done']} of {p['tasks']}\n")) if args.progress else None
            run = sanitizer.start_files(spark, source, target, told, preview_chars=args.preview, most_per_rule=args.replacements)
            try:
                report = run.result()
            except KeyboardInterrupt:
                run.abort()
                report = run.result()
        else:
            kept = sanitizer.scanned(spark, source)
            report = sanitizer.report_of(kept, args.preview, args.replacements)
            if target is not None:
                sanitizer.write(kept, target)
        if kept is not None and (args.stdout or args.input == "-" and target is None and not args.report_only):
            for row in kept.orderBy("source", "block", "row").select("redacted.output").toLocalIterator(prefetchPartitions=True):
                sys.stdout.write(f"{row.output}\n")
        text = report_text(report["line_count"], report["counts"])
        if args.report:
            Path(args.report).write_text(json.dumps(report, default=str, ensure_ascii=False) if args.report_format == "json" else text, encoding="utf-8")
        if not args.quiet:
            sys.stderr.write(text)
    except (SanitizerError, OSError, TypeError, json.JSONDecodeError) as e:
        sys.stderr.write(f"{e}\n")
        return 2 if is_sanitizer_error(e) and e.code != ABORTED else 1
    return 3 if args.fail_on_match and report["total_matches"] else 0


if __name__ == "__main__":
    sys.exit(main())
