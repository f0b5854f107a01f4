"""Command line: ``python -m quillstone.plans.cli COMMAND ...``. Exit codes: 0, 2 for errors of use or input, 130 when interrupted."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.plans import analysis, reports
from quillstone.sources import lines as L
from quillstone.sources import exchange, sinks


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """An ingested corpus: a folder of Parquet files, or one JSON document."""
    return exchange.read_corpus(spark, path) if path.endswith(".json") else spark.read.parquet(path)


def ingest(spark: SparkSession, a: argparse.Namespace) -> None:
    """Writes Parquet from the executors, or one JSON document where the output's name says so."""
    if Path(a.input).is_dir():
        rows = L.parse_tagged(L.read_files(spark, a.input))
    else:
        rows = L.parse_plain(L.numbered_lines(spark, a.input))
    if a.skip_uncertain:
        rows = rows.filter("NOT has_uncertainty")
    if a.output.endswith(".json"):
        # one number for file and line, in order of both
        exchange.write_corpus(rows.withColumn("line_ord", F.struct("file", "n")), a.output, {"transcription_version": a.version})
    else:
        sinks.write_lines(rows, a.output, a.version)


def run_entropy(spark, a):
    sinks.write_report(reports.entropy_report(corpus(spark, a.corpus), a.label, a.clean), a.output)


def run_positional(spark, a):
    sinks.write_report(reports.positional_report(corpus(spark, a.corpus), a.top_n), a.output)


def run_adjacency(spark, a):
    sinks.write_report(reports.adjacency_report(corpus(spark, a.corpus), a.top_n, a.min_pmi_count), a.output)


def run_markov(spark, a):
    sinks.write_report(reports.markov_report(corpus(spark, a.corpus), a.orders, a.smoothing, a.test_fraction, a.seed), a.output)


def run_slots(spark, a):
    lines = corpus(spark, a.corpus)
    sinks.write_report(reports.slots_report(lines, a.clean), a.output)
    if a.tokens:
        from quillstone.operators import slots

        checked = slots.validated(L.vocabulary(L.token_rows(lines, clean=a.clean))).drop("first")
        sinks.write_table(checked, a.tokens)


def run_significance(spark, a):
    sinks.write_report(reports.significance_report(corpus(spark, a.corpus), a.resamples, a.seed), a.output)


def run_falsify(spark, a):
    lines = corpus(spark, a.corpus).persist()
    entropy, covered = reports.entropy_report(lines), reports.slots_report(lines)
    models = reports.markov_report(lines, 2)["markov"]
    measured = analysis.rule_measurements(lines, entropy, models, covered)
    found = analysis.judged(spark, measured)
    sinks.write_report({"measurements": measured, **found}, a.output)
    if a.rules:
        sinks.write_table(spark.createDataFrame([tuple(r.values()) for r in found["rules"]], "rule string, severity string, measured_value double, verdict string"), a.rules)
    lines.unpersist()


def run_pipeline(spark, a):
    given = {"transcription_version": a.version}
    run = analysis.analyse(corpus(spark, a.corpus), given, a.seed, a.resamples, share=a.test_fraction, run_id=a.run_id, significance=not a.skip_significance)
    folder = Path(a.output)
    sinks.write_report(run, str(folder / f"run_{run['run_id']}.json"))
    (folder / f"run_{run['run_id']}.md").write_text(analysis.markdown(run), encoding="utf-8")


def run_report(_, a):
    path = Path(a.run)
    if path.is_dir():
        found = sorted(path.glob("run_*.json"))
        if not found:
            raise FileNotFoundError(f"no run in {path}")
        path = found[-1]
    Path(a.output).write_text(analysis.markdown(json.loads(path.read_text(encoding="utf-8"))), encoding="utf-8")


def run_preregister(_, a):
    sinks.write_report(analysis.preregistration(a.version), a.output)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillstone", description="Statistics over tokenised, line-structured corpora.")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name, f, *inputs, **options):
        p = sub.add_parser(name)
        for i in inputs:
            p.add_argument(i)
        p.add_argument("--output", required=True)
        for k, (kind, default) in options.items():
            p.add_argument("--" + k.replace("_", "-"), type=kind, default=default) if kind is not bool else p.add_argument("--" + k.replace("_", "-"), action="store_true")
        p.set_defaults(run_command=f)

    seed, resamples, share = (int, 42), (int, 500), (float, 0.2)
    command("ingest", ingest, "input", version=(str, "unknown"), skip_uncertain=(bool, False))
    command("entropy", run_entropy, "corpus", label=(str, "corpus"), clean=(bool, False))
    command("positional", run_positional, "corpus", top_n=(int, 30))
    command("adjacency", run_adjacency, "corpus", top_n=(int, 30), min_pmi_count=(int, 5))
    command("slots", run_slots, "corpus", clean=(bool, False), tokens=(str, None))
    command("significance", run_significance, "corpus", resamples=resamples, seed=seed)
    command("markov", run_markov, "corpus", orders=(int, 4), smoothing=(float, 1.0), test_fraction=share, seed=seed)
    command("falsify", run_falsify, "corpus", rules=(str, None))
    command("pipeline", run_pipeline, "corpus", version=(str, "unknown"), seed=seed, resamples=resamples, test_fraction=share, run_id=(str, None), skip_significance=(bool, False))
    command("report", run_report, "run")
    command("preregister", run_preregister, version=(str, "unknown"))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        needs = a.command not in ("report", "preregister")
        a.run_command(spark or (SparkSession.builder.appName("quillstone").getOrCreate() if needs else None), a)
    except KeyboardInterrupt:
        return 130
    except (OSError, ValueError) as e:
        print(f"quillstone: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
