"""Command line: python -m graphloom COMMAND; the session is what spark-submit or the environment configures."""

from __future__ import annotations

import argparse
import functools
import logging

from graphloom.plans import jobs
from graphloom.plans.client import PROVIDERS, Client


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    p.add_argument("--logging-level", default="WARNING", help="of the standard logging module")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *paths: str, **kw) -> argparse.ArgumentParser:
        c = sub.add_parser(name, **kw)
        for x in paths:
            c.add_argument(f"--{x}", required=True)
        return c

    c = command("batch", "input-path", "working-directory", help="documents to graphs")
    c.add_argument("--ontology-directory")
    c.add_argument("--head-chunks", type=int, help="of each document, at most so many chunks")
    c.add_argument("--max-visits", type=int, default=3)
    c.add_argument("--provider", choices=["rules", *PROVIDERS], default="rules")
    c.add_argument("--model", default="gpt-4o-mini")
    c.add_argument("--api-key")
    c.add_argument("--base-url")
    command("split-chunks", "input-path", "output-path", help="JSON files to semantic chunks").add_argument("--prefix", default="")
    command("cmp-states", "input-path", help="sizes of the graphs of run states")
    command("plot-graph", help="the workflow as Mermaid text")
    return p


def main(args: list[str] | None = None, spark=None) -> None:
    a = parser().parse_args(args)
    logging.basicConfig(level=a.logging_level.upper())
    if a.command == "plot-graph":
        print(jobs.diagram(), end="")
        return
    if a.command == "batch" and a.provider == "openai" and not a.api_key:
        raise SystemExit("--provider openai needs --api-key")
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("graphloom").getOrCreate()
    if a.command == "batch":
        model = jobs.Rules if a.provider == "rules" else functools.partial(Client, a.provider, a.model, a.api_key, a.base_url)
        jobs.run_batch(spark, a.input_path, a.working_directory, jobs.Config(max_visits=a.max_visits, max_chunks=a.head_chunks, model=model, ontology_folder=a.ontology_directory))
    elif a.command == "split-chunks":
        jobs.split_chunks(spark, a.input_path, a.output_path, prefix=a.prefix)
    else:
        jobs.compare_runs(spark, a.input_path).show(1000, False)


if __name__ == "__main__":
    main()
