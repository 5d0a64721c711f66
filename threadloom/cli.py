"""Command line: analyze, trace, change, baseline, publish, edit, search, show, list, check-task, schema, init."""

from __future__ import annotations

import argparse
import datetime
import json
import sys
from pathlib import Path

from threadloom.sources import config as settings

STARTER = {
    "config.toml": 'base = ".."\n\n[[input]]\nname = "requirements"\ndir = "REQ"\ndriver = "obsidian"\natype = "REQ"\n\n[metamodel]\nfilename = "project.model"\n',
    "project.model": "artifact REQ:\n    id is string as REQ-{num:3}\n    attribute contents is mandatory string\n    attribute status is optional enum [draft, active, retired]\n",
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="threadloom", description=__doc__)
    top.add_argument("--config", default=".threadloom/config.toml")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("init")
    a = sub.add_parser("analyze")
    a.add_argument("--suppress-tracing", action="store_true")
    a.add_argument("--no-git", action="store_true")
    a.add_argument("--allow-dirty-worktree", action="store_true")
    a.add_argument("--violations", help="write all violations as a Parquet table to this folder")
    t = sub.add_parser("trace")
    t.add_argument("--child", required=True)
    t.add_argument("--parent", required=True)
    t.add_argument("--forward", action="store_true")
    t.add_argument("--flat", action="store_true")
    t.add_argument("--attribute", action="append", default=[])
    t.add_argument("--delimiter", default=",")
    t.add_argument("--output")
    c = sub.add_parser("change")
    c.add_argument("--base", required=True)
    c.add_argument("--target", default="working")
    c.add_argument("--repo", default=".")
    c.add_argument("--summary", action="store_true")
    c.add_argument("--output", default="console", help="a folder for one report per input record")
    b = sub.add_parser("baseline")
    b.add_argument("name")
    b.add_argument("--message", default="")
    b.add_argument("--repo", action="append")
    b.add_argument("--force", action="store_true")
    e = sub.add_parser("edit").add_subparsers(dest="what", required=True)
    i = e.add_parser("identification")
    i.add_argument("--all", action="store_true")
    i.add_argument("--atype")
    i.add_argument("--force", action="store_true")
    i.add_argument("--dry-run", action="store_true")
    n = e.add_parser("attrs")
    n.add_argument("-o", "--operation", choices=["add", "del", "replace"], default="add")
    n.add_argument("-t", "--type", choices=["attr", "field"], default="attr")
    n.add_argument("-n", "--name")
    n.add_argument("-l", "--value")
    n.add_argument("-s", "--section", required=True)
    n.add_argument("--csv")
    n.add_argument("--csv-id-column", default="id")
    n.add_argument("--csv-value-column", default="value")
    n.add_argument("-d", "--csv-delimiter", default=",")
    n.add_argument("--dry-run", action="store_true")
    m = e.add_parser("markers").add_subparsers(dest="act", required=True).add_parser("renumber")
    m.add_argument("--all", action="store_true")
    m.add_argument("--section")
    m.add_argument("--marker")
    m.add_argument("--dry-run", action="store_true")
    p = sub.add_parser("publish")
    p.add_argument("--output", default="outputs")
    p.add_argument("--single", action="store_true")
    p.add_argument("--format", choices=["docx", "html", "pdf"], help="convert the documents as well")
    s = sub.add_parser("search")
    s.add_argument("query")
    w = sub.add_parser("show")
    w.add_argument("aid")
    li = sub.add_parser("list")
    li.add_argument("--limit", type=int)
    for x in (s, w, li):
        x.add_argument("--store", help="a folder where the artifacts are kept from one command to the next")
    w.add_argument("--revisions", action="store_true")
    k = sub.add_parser("check-task", help="what an edit of a task file must not have changed")
    k.add_argument("file")
    k.add_argument("--base", default="HEAD")
    sub.add_parser("schema").add_argument("of", nargs="?", choices=["config", "publish"], default="config")
    return top


def edit(project, args) -> int:
    """The edit commands; a dry run only counts."""
    from threadloom.sources import files

    if args.what == "identification":
        if not (args.all or args.atype):
            print("either --all or --atype", file=sys.stderr)
            return 2
        done = project.renumber(args.atype, args.force, args.dry_run)
    elif args.what == "attrs":
        mapping = files.csv_mapping(project.spark, args.csv, args.csv_id_column, args.csv_value_column, args.csv_delimiter) if args.csv else None
        done = project.edit_attributes(args.section, args.operation, args.name, args.value, mapping, args.dry_run, args.type == "field")
    else:
        if args.all == bool(args.section):
            print("either --all or --section", file=sys.stderr)
            return 2
        done = project.renumber_fragments(args.section, args.marker, args.dry_run)
    print(", ".join(f"{k}: {v}" for k, v in done.items()))
    return 0


def check_task(args) -> int:
    """Compare a task file with its state at a revision."""
    from threadloom.plans import outputs
    from threadloom.sources import git

    file = Path(args.file)
    try:
        problems = outputs.check_task(git.git(file.parent, "show", f"{args.base}:./{file.name}"), file.read_text(encoding="utf-8"))
    except (git.GitError, OSError) as e:
        print(f"fatal: {e}", file=sys.stderr)
        return 3
    print("\n".join(problems) or "unchanged")
    return int(bool(problems))


def main(argv: list[str] | None = None) -> int:
    """Exit codes: 0 well, 1 violations, 2 wrong use, 3 fatal."""
    args = parser().parse_args(argv)
    if args.command == "init":
        folder = Path(args.config).parent
        folder.mkdir(parents=True, exist_ok=True)
        for name, text in STARTER.items():
            if not (folder / name).exists():
                (folder / name).write_text(text, encoding="utf-8")
        return 0
    if args.command == "schema":
        print(json.dumps(settings.publish_schema() if args.of == "publish" else settings.json_schema(), indent=2))
        return 0
    if args.command == "check-task":
        return check_task(args)
    from pyspark.sql import SparkSession

    from threadloom.plans import project as plans
    from threadloom.plans import report
    from threadloom.sources import git

    spark = SparkSession.builder.appName("threadloom").getOrCreate()
    try:
        project = plans.Project.load(spark, args.config, settings.home())
        if getattr(args, "store", None):
            project.keep(args.store)
        if args.command == "analyze":
            text = project.analyze(suppress_tracing=args.suppress_tracing, use_git=not args.no_git, allow_dirty=args.allow_dirty_worktree)
            if args.violations:
                project.violations(args.suppress_tracing).write.mode("overwrite").parquet(args.violations)
            print(text)
            return int(text.errors > 0)
        if args.command == "trace":
            matrix = project.matrix(args.child, args.parent, forward=args.forward, flat=args.flat, attributes=args.attribute)
            suffix = "tsv" if args.delimiter == "\t" else "csv"
            path = None if args.output == "console" else args.output or report.output_name(args.child, args.parent, args.forward, datetime.date.today().isoformat(), suffix)
            done = project.export_matrix(matrix, args.forward, args.attribute, args.delimiter, path)
            if path is None and done is not None:
                sys.stdout.writelines(done)
        elif args.command == "change" and args.output != "console":
            for path in plans.change_files(spark, project.config, project.rules, args.repo, args.base, args.target, args.output, f"{datetime.date.today():%Y%m%d}", summary=args.summary):
                print(path)
        elif args.command == "baseline":
            repos = args.repo or [project.root / r.dir for r in project.config.input]
            print("\n".join(git.tag_baseline([git.git(r, "rev-parse", "--show-toplevel").strip() for r in repos], args.name, args.message or args.name, project.config.tag_pattern, args.force)))
        elif args.command == "edit":
            return edit(project, args)
        elif args.command == "show":
            text = project.content(args.aid)
            print(text if text is not None else f"no artifact {args.aid}")
            if text is not None and args.revisions:
                print("\n".join(f"- {r}" for r in project.revisions_text(args.aid)))
            return int(text is None)
        elif args.command == "change":
            for line in plans.change_lines(plans.change_rows(spark, project.config, project.rules, args.repo, args.base, args.target, summary=args.summary)):
                print(line)
        elif args.command == "publish":
            for path in project.publish(args.output, single=args.single, suffix=args.format):
                print(path)
        elif args.command == "list":
            for r in project.listing(args.limit).toLocalIterator():
                print(r.aid, r.atype, r.record)
        elif args.command == "search":
            for r in project.search(args.query).select("aid", "atype").orderBy("aid").toLocalIterator():
                print(r.aid, r.atype)
        return 0
    except (settings.ConfigError, plans.PluginError, git.GitError, OSError, ValueError) as e:
        print(f"fatal: {e}", file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
