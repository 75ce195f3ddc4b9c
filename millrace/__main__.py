"""python -m millrace list | run NAME FOLDER OUT | all FOLDER OUT: the core's queries from the command line, written as Parquet."""

from __future__ import annotations

import argparse
import os
from functools import partial

from millrace import plans
from millrace.pipeline import Pipeline
from millrace.session import session


def write(name: str, master: str | None, folder: str, out: str) -> None:
    plans.queries()[name](session(master=master), folder).write.mode("overwrite").parquet(out)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="millrace")
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("list", help="the names of all queries")
    one = sub.add_parser("run", help="one query")
    one.add_argument("name")
    every = sub.add_parser("all", help="all queries, or those whose names begin with one of --only, as stages: what is done is skipped, a failure stops the run")
    every.add_argument("--only", action="append", default=[], metavar="PREFIX")
    every.add_argument("--again", action="append", default=[], metavar="NAME", help="run this one even if it is done")
    for r in (one, every):
        r.add_argument("folder")
        r.add_argument("out")
        r.add_argument("--master")
    got = p.parse_args(args)
    names = sorted(plans.queries())
    if got.what == "list":
        print("\n".join(names))
        return 0
    if got.what == "run":
        if got.name not in names:
            p.error(f"no query {got.name}")
        write(got.name, got.master, got.folder, got.out)
        return 0
    names = [n for n in names if not got.only or n.startswith(tuple(got.only))]
    if not names:
        p.error("no query begins so")
    os.makedirs(got.out, exist_ok=True)
    run = Pipeline({n: partial(write, n, got.master, got.folder, f"{got.out}/{n}") for n in names}, f"{got.out}/state.json", always=tuple(got.again))
    if run.run():
        return 0
    print("\n".join(f"{n}: {s['error']}" for n, s in run.state.items() if s["status"] == "failed"))
    return 1


if __name__ == "__main__":
    raise SystemExit(main())
