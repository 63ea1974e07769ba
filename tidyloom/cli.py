"""Commands: ``build`` a plan from a table pair, ``apply`` it, ``score`` it.

    python -m tidyloom.cli build --dirty d.csv --clean c.csv --out runs
    python -m tidyloom.cli apply --plan plan.json table.csv
    python -m tidyloom.cli score --plan plan.json --dirty d.csv --clean c.csv
    python -m tidyloom.cli models --provider ollama --model name
"""

from __future__ import annotations

import argparse
import os
import sys
from datetime import datetime

from pyspark.sql import SparkSession

from tidyloom.operators import metrics
from tidyloom.operators.names import RID
from tidyloom.plans import cleaner, report
from tidyloom.plans.agents import CASES, ChatAgent, OfflineMiner, suitability
from tidyloom.plans.build import Settings, build
from tidyloom.plans.model import CleanerPlan
from tidyloom.sources.tables import InvalidData, load_pair, read_literal_csv, write_csv_file


def parser() -> argparse.ArgumentParser:
    env = os.environ.get
    top = argparse.ArgumentParser(prog="tidyloom")
    sub = top.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("--dirty", default=env("DIRTY"), required=not env("DIRTY"))
    b.add_argument("--clean", default=env("CLEAN"), required=not env("CLEAN"))
    b.add_argument("--out", default=env("OUT", "runs"))
    b.add_argument("--columns", default="all", help="comma-separated, or all")
    b.add_argument("--iterations", type=int, default=5)
    b.add_argument("--per-iteration", type=int, default=2)
    b.add_argument("--embedding-model", help="folder with model.onnx and tokenizer.json")
    b.add_argument("--provider", choices=("openai", "ollama"), help="ask a chat model; default is the offline miner")
    b.add_argument("--model", default="")
    b.add_argument("--url", default="http://localhost:11434")
    a = sub.add_parser("apply")
    a.add_argument("--plan", required=True)
    a.add_argument("table", nargs="?")
    s = sub.add_parser("score")
    for name in ("--plan", "--dirty", "--clean"):
        s.add_argument(name, required=True)
    for command in (a, s, b):
        command.add_argument("--allow-python", action="store_true", help="run rules that are Python code")
    m = sub.add_parser("models")
    m.add_argument("--provider", choices=("openai", "ollama"), required=True)
    m.add_argument("--model", required=True)
    m.add_argument("--url", default="http://localhost:11434")
    m.add_argument("--repetitions", type=int, default=3)
    return top


def read_plan(spark: SparkSession, path: str) -> CleanerPlan:
    return CleanerPlan.from_json("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))  # one small file


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "apply" and not args.table:
        print("usage: tidyloom apply --plan plan.json table.csv", file=sys.stderr)
        return 2
    if args.command == "models":
        scores = suitability(ChatAgent(args.provider, args.model, args.url, os.environ.get("CHAT_KEY", "")), CASES, args.repetitions)
        print(report.text_table([{"role": role, **score} for role, score in scores.items()]))
        return 0 if scores["detection"]["gate"] else 1
    spark = spark or SparkSession.builder.appName("tidyloom").getOrCreate()
    try:
        if args.command == "build":
            columns = None if args.columns == "all" else [c for c in args.columns.split(",") if c]
            pair = load_pair(spark, args.dirty, args.clean, columns)
            agent = ChatAgent(args.provider, args.model, args.url, os.environ.get("CHAT_KEY", "")) if args.provider else OfflineMiner()
            stamp = datetime.now().strftime("%Y-%m-%d_%H%M%S")
            built = build(pair, agent, Settings(iterations=args.iterations, per_iteration=args.per_iteration, model_folder=args.embedding_model, python=args.allow_python), stamp)
            print(report.write_run(spark, pair, built, args.out, stamp, args.provider or "offline"))
            print(report.text_table(report.rows_of(built.repair)))
            if all(not w.detector.code.strip() or "isin([])" in w.detector.code for w in built.columns) and not built.plan.detect:
                print("warning: no rule marks anything", file=sys.stderr)
        elif args.command == "apply":
            plan, table = read_plan(spark, args.plan), read_literal_csv(spark, args.table)
            applied = cleaner.apply_plan(table, plan, python=args.allow_python)
            columns = [c for c in plan.columns if c in table.columns]
            stem = args.table.removesuffix(".csv")
            write_csv_file(cleaner.corrected(applied, columns, list(table.columns)), f"{stem}_corrected.csv")
            write_csv_file(cleaner.flags(applied, columns, [RID]), f"{stem}_flags.csv")
        else:
            plan, pair = read_plan(spark, args.plan), load_pair(spark, args.dirty, args.clean)
            columns = [c for c in plan.columns if c in pair.columns]
            repair = metrics.repair_metrics(metrics.paired(cleaner.apply_plan(pair.dirty, plan, python=args.allow_python), pair.clean, columns), columns)
            print(report.text_table(report.rows_of(repair)))
            print(report.text_table(report.rows_of(metrics.repair_total(repair))))
    except InvalidData as e:
        print(f"invalid data: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
