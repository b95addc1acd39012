"""Command line: python -m codeloom <command> [--repo DIR]."""

import argparse
import json
import shutil
import sys
from pathlib import Path

from codeloom import config as settings

SYMBOL_COMMANDS = {"symbol": "get_symbol_code", "usages": "find_usages", "implementations": "find_implementations",
                   "flow": "explore_flow", "impact": "analyze_impact"}


def arguments():
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--repo", default=".")
    parser = argparse.ArgumentParser(prog="codeloom", parents=[common])
    commands = parser.add_subparsers(dest="command", required=True)

    def add(name, text):
        return commands.add_parser(name, parents=[common], help=text)
    add("init", "write default settings and index")
    add("reinit", "drop the index and settings, then init").add_argument("--keep-config", action="store_true")
    add("index", "index or refresh")
    add("serve", "answer JSON-RPC lines on stdin")
    add("status", "counts of the index")
    find = add("search", "search symbols and docs")
    find.add_argument("query")
    find.add_argument("--limit", type=int, default=8)
    add("skeleton", "outline of a file").add_argument("file")
    for name in SYMBOL_COMMANDS:
        command = add(name, SYMBOL_COMMANDS[name])
        command.add_argument("symbol")
        if name == "symbol":
            command.add_argument("--context", type=int, default=0)
        if name == "usages":
            command.add_argument("--limit", type=int, default=10)
        if name == "implementations":
            command.add_argument("--direct-only", action="store_true")
        if name in ("flow", "impact"):
            command.add_argument("--depth", type=int, default=1 if name == "flow" else 2)
        if name == "impact":
            command.add_argument("--no-tests", action="store_true")
    add("clean", "drop the index")
    return parser


def clean(root: Path) -> None:
    folder = root / ".codeloom"
    print(f"Removed {folder}" if folder.exists() else "Nothing to clean")
    if folder.exists():
        shutil.rmtree(folder)


def options(args) -> dict:
    named = {"symbol": {"context_lines": "context"}, "usages": {"limit": "limit"}, "flow": {"max_depth": "depth"}, "impact": {"depth": "depth"}}
    out = {k: getattr(args, v) for k, v in named.get(args.command, {}).items()}
    if args.command == "implementations":
        out["transitive"] = not args.direct_only
    if args.command == "impact":
        out["include_tests"] = not args.no_tests
    return out


def run(args, spark=None, out=sys.stdout) -> int:
    root = Path(args.repo).resolve()
    if args.command in ("clean", "reinit"):
        clean(root)
        if args.command == "clean":
            return 0
        if not args.keep_config:
            (root / settings.FILE_NAME).unlink(missing_ok=True)
    if args.command in ("init", "reinit") and not (root / settings.FILE_NAME).exists():
        (root / settings.FILE_NAME).write_text(settings.Config().to_toml(), encoding="utf-8")
    if spark is None:
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.appName("codeloom").getOrCreate()
    from codeloom.engine import CodeIndex
    from codeloom.tools import Rpc
    index = CodeIndex(spark, root)
    if args.command == "serve":
        Rpc(index).run()
        return 0
    if args.command in ("init", "reinit", "index"):
        answer = index.index()
    elif not index.store.exists():
        print("No index here. Run 'index' first.", file=out)
        return 1
    elif args.command == "status":
        answer = index.index_status()
    elif args.command == "search":
        answer = index.search_semantic(args.query, limit=args.limit)
    elif args.command == "skeleton":
        answer = index.get_skeleton(args.file)
    else:
        answer = getattr(index, SYMBOL_COMMANDS[args.command])(args.symbol, **options(args))
    text = next((answer[k] for k in ("flow", "report", "skeleton", "code") if k in answer), None)
    print(text if text is not None else json.dumps(answer, indent=2, ensure_ascii=False), file=out)
    return 1 if answer.get("status") == "not_found" or "error" in answer else 0


if __name__ == "__main__":
    sys.exit(run(arguments().parse_args()))
