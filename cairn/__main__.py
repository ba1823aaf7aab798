"""python -m cairn HOME COMMAND ...: index, status, ask, context, enqueue, drain, watch, commits and settings from a shell."""

from __future__ import annotations

import argparse
import json


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cairn", description=__doc__)
    p.add_argument("home", help="folder of the index's tables")
    p.add_argument("--settings", help="JSON file of settings")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {"index": ["root"], "status": [], "ask": ["question"], "context": ["prompt"], "enqueue": ["root", "paths"], "drain": ["root"], "refresh": ["root"], "scan": ["root"], "watch": ["root"], "commits": ["root"], "settings": []}.items():
        one = sub.add_parser(name)
        for a in args:
            one.add_argument(a, nargs="+" if a in ("paths", "question", "prompt") else None)
        if name in ("watch", "commits"):
            one.add_argument("--every", help='as "10 seconds": runs until stopped; else once')
    return p


def answer_lines(name: str, rows: list[dict], warning: str | None = None, most: int = 500) -> list[str]:
    """An answer as text: its warning, its name and count, then a line a row, named symbols with their place; grouped rows below their owner.

    Of more than `most` rows the first are shown, and the count says so.
    """
    count, rows = (f"{len(rows)}" if len(rows) <= most else f"more than {most}, the first {most}"), rows[:most]
    out, owner = [*([f"! {warning}", ""] if warning else []), f"{name}: {count}", ""], None
    for r in rows:
        if r.get("owner") and r["owner"] != owner:
            owner = r["owner"]
            out.append(owner + (f" [{r['owner_kind']}]" if r.get("owner_kind") else ""))
        indent = "  " * bool(r.get("owner"))
        if r.get("name") and "path" in r:
            place = ":".join(str(r[c]) for c in ("path", "start_line") if r.get(c))
            out.append(f"{indent}- {r['name']}" + (f" ({place})" if place else ""))
        else:
            out.append(f"{indent}- {json.dumps(r, default=str)}")
    return out if rows else [*out, "(no results)"]


def run(spark, args: argparse.Namespace) -> str:
    """What a command prints."""
    from cairn.plans.engine import Engine, page
    from cairn.sources import files

    settings = files.settings(args.settings)
    engine = Engine(spark, args.home, settings)
    match args.command:
        case "index":
            return json.dumps(engine.index(args.root))
        case "status":
            return "\n".join(f"{r['name']}: {r['n']}" for r in engine.status().collect())
        case "ask":
            name, rows = engine.ask(" ".join(args.question))
            if rows is None:
                return page(engine.retrieve(" ".join(args.question)))
            return "\n".join(answer_lines(name, [r.asDict(recursive=True) for r in rows.limit(501).collect()], engine.warning(name)))
        case "context":
            return page(engine.retrieve(" ".join(args.prompt)))
        case "enqueue":
            return str(engine.enqueue(args.root, args.paths))
        case "drain":
            return json.dumps(engine.drain(args.root))
        case "refresh":
            return json.dumps(engine.git_refresh(args.root))
        case "scan":
            return str(engine.hash_scan(args.root))
        case "watch" | "commits":
            from cairn.streaming import changes

            at = f"{args.home.rstrip('/')}-streams/{args.command}"
            query = changes.follow_tree(engine, args.root, f"{at}/snapshots", f"{at}/checkpoint", args.every) if args.command == "watch" else changes.follow_git(engine, args.root, f"{at}/checkpoint", args.every)
            query.awaitTermination()
            return f"{engine.pending()} pending"
        case _:
            return json.dumps(settings, indent=2)


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    given = parser().parse_args()
    print(run(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), given))
