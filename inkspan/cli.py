"""Command line: build, analyze, run and evaluate.

    python -m inkspan build RAW OUT           raw editions to a corpus (JSON lines)
    python -m inkspan analyze CORPUS OUT      corpus to a report folder
    python -m inkspan run RAW OUT             both
    python -m inkspan evaluate CORPUS OUT     held-out evaluation of known authors
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from inkspan.operators import evaluate, supervised
from inkspan.operators.discovery import Config
from inkspan.plans.analyze import analyze
from inkspan.sources import importers, manifest, sinks, units


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkspan")
    p.add_argument("command", choices=("build", "analyze", "run", "evaluate"))
    p.add_argument("source")
    p.add_argument("out")
    p.add_argument("--language", action="append", default=[])
    p.add_argument("--passage-tokens", type=int, default=1200)
    p.add_argument("--min-tokens", type=int, default=200)
    p.add_argument("--max-styles", type=int, default=20)
    p.add_argument("--fit-passages", type=int, default=2000)
    p.add_argument("--seed", type=int, default=42)
    return p


def _selected(corpus, languages: list[str]):
    if missing := sorted(set(languages) - {r["language"] for r in corpus.select("language").distinct().collect()}):
        raise ValueError(f"no text in: {', '.join(missing)}")
    return corpus.where(F.col("language").isin(languages)) if languages else corpus


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("inkspan").getOrCreate()
    try:
        config = Config(a.passage_tokens, a.min_tokens, a.max_styles, a.fit_passages, a.seed)
        corpus = None
        if a.command in ("build", "run"):
            corpus, report, chosen = importers.build_corpus(spark, a.source)
            units.write_corpus(corpus, f"{a.out}/corpus")
            report.write.mode("overwrite").json(f"{a.out}/sources")
            chosen.write.mode("overwrite").json(f"{a.out}/witnesses")
            account = {"sources": [r.asDict() for r in report.orderBy("source_dir").collect()]}  # a row a source
            manifest.write_account(spark, f"{a.out}/corpus_account", account, units.load_corpus(spark, f"{a.out}/corpus"))
        if a.command == "analyze":
            corpus = units.load_corpus(spark, a.source)
            if manifest.read_account(spark, f"{a.source.rstrip('/').rsplit('/', 1)[0]}/corpus_account", corpus) is None:
                print("note: no account of this corpus; it was built elsewhere or changed since", file=sys.stderr)
        if a.command in ("analyze", "run"):
            sinks.write_report(analyze(_selected(corpus, a.language), config), f"{a.out}/report")
        if a.command == "evaluate":
            found = supervised.held_out_predictions(units.load_corpus(spark, a.source), a.passage_tokens, a.seed)
            found.write.mode("overwrite").json(f"{a.out}/predictions")
            evaluate.macro_recall(found, "actual_author", "predicted_author", ["collection"]).write.mode("overwrite").json(f"{a.out}/accuracy")
    except (ValueError, OSError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
