"""The full analysis of one corpus: measurements by tier, rules, reports, and the plan made before it."""

from __future__ import annotations

import datetime
import subprocess
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import tokens as T
from quillstone.operators import inference, positional, rules, slots
from quillstone.plans import reports
from quillstone.plans.reports import rows_of
from quillstone.sources import lines as L

#: The share of doubtful lines above which a warning is given.
DOUBTFUL = 0.15
LIMITATIONS = (
    "Sections are assigned by convention from folio names, not observed.",
    "Bootstrap weights are Poisson variates, the limit of drawing lines with replacement.",
    "Perplexities compare models on held-out lines of the same corpus; they say nothing about meaning.",
)


def rule_measurements(lines: DataFrame, entropy: dict, models: list[dict], covered: dict) -> dict:
    """What the rules ask of the reports, and what they measure by themselves."""
    rows = L.token_rows(lines)
    pp = {m["order"]: m["perplexity"] for m in models}
    sections = L.token_rows(reports.sectioned(lines), clean=True)
    return {
        "coverage": covered["coverage"], "worst_failure": max((f["share"] for f in covered["failures"]), default=None),
        "core_usage": covered["usage"].get("core"), "most_usage": max(covered["usage"].values(), default=None),
        "entropy": entropy["entropy"]["entropy"], "baseline_entropy": entropy["baseline"]["entropy"], "conditional_entropy": entropy["entropy"]["conditional_entropy"],
        "alpha": entropy["zipf"]["alpha"] or 0.0, "r_squared": entropy["zipf"]["r_squared"] or 0.0,
        "n_biased": positional.biased(positional.edge_rates(rows), 0.5).count(), "jaccard": positional.jaccard_of_edges(rows).first()[0],
        "perplexity_0": pp.get(0), "perplexity_1": pp.get(1), "perplexity_saved": (pp[0] - pp[1]) / pp[0] if pp.get(0) and pp.get(1) else None,
        "n_significant": inference.rule_significance(sections, reports.KNOWN).first()[0],
    }


def judged(spark, measured: dict) -> dict:
    """The verdict of each rule, the counts that lead to the overall one, and a sentence on it."""
    table = spark.createDataFrame([tuple(None if v is None else float(v) for v in measured.values())], ", ".join(f"{k} double" for k in measured))
    verdicts = rules.evaluate(table)
    overall = rows_of(rules.overall(verdicts))[0]
    failed = [f"{v['rule']} ({v['severity'].lower()})" for v in rows_of(verdicts) if v["verdict"] == "FAIL"]
    summary = f"{overall['verdict']}: of {len(rules.RULES)} rules, {len(failed)} fail{': ' + ', '.join(failed) if failed else ''}; {overall['inconclusive']} are inconclusive."
    return {"rules": rows_of(verdicts), "overall": overall, "summary": summary}


def analyse(
    lines: DataFrame, given: dict[str, str], seed: int = 42, resamples: int = 500, orders: int = 4, share: float = 0.2, run_id: str | None = None, significance: bool = True
) -> dict:
    """The manifest of a run over ``lines`` (canonical columns): verified results, hypotheses, warnings, limitations."""
    lines = lines.persist()
    counts, warnings = reports.metadata(lines), []
    if not counts["record_count"]:
        raise ValueError("the corpus has no lines")
    if given.get("transcription_version", "unknown") == "unknown":
        warnings.append("The version of the transcription is not known.")
    if counts["uncertainty_line_count"] > DOUBTFUL * counts["record_count"]:
        warnings.append(f"{counts['uncertainty_line_count'] / counts['record_count']:.1%} of the lines are doubtful.")
    entropy, covered, models = reports.entropy_report(lines, seed=seed), reports.slots_report(lines), reports.markov_report(lines, orders, share=share, seed=seed)
    if not covered["supported"]:
        warnings.append("The slot grammar covers too few tokens to be supported.")
    if models["split"]["warning"]:
        warnings.append(models["split"]["warning"])
    measured = rule_measurements(lines, entropy, models["markov"], covered)
    out = {
        "run_id": run_id or uuid.uuid4().hex[:12], "created_at": datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds"), "corpus_metadata": {**given, **counts},
        "verified_results": {
            "entropy": entropy["entropy"], "characters": entropy["characters"], "zipf": entropy["zipf"], "baseline": entropy["baseline"],
            "positional": reports.positional_report(lines), "adjacency": reports.adjacency_report(lines), "markov": models,
            "significance": reports.significance_report(lines, resamples, seed) if significance else {},
        },
        "hypothesis_results": {"slots": covered, **judged(lines.sparkSession, measured)},
        "warnings": warnings, "limitations": list(LIMITATIONS),
    }
    lines.unpersist()
    return out


def markdown(run: dict) -> str:
    """A run's manifest as a readable report; what is missing is left out."""
    v, h, m = run.get("verified_results", {}), run.get("hypothesis_results", {}), run.get("corpus_metadata", {})

    def table(title: str, rows: list[dict]) -> list[str]:
        if not rows:
            return []
        head = list(rows[0])
        return [f"### {title}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head), *["| " + " | ".join("" if r[c] is None else str(r[c]) for c in head) + " |" for r in rows], ""]

    def facts(title: str, d: dict) -> list[str]:
        return [f"### {title}", "", *[f"- {k.replace('_', ' ')}: {x}" for k, x in d.items() if not isinstance(x, dict | list)], ""] if d else []

    out = [f"# Corpus analysis {run.get('run_id', '')}", "", f"Made {run.get('created_at', 'at an unknown time')}.", "", "## Measurements", "", *facts("Corpus", m)]
    for name in ("entropy", "characters", "baseline", "zipf", "adjacency"):
        out += facts(name.capitalize(), v.get(name, {}))
    for edge, rows in v.get("positional", {}).get("biased", {}).items():
        out += table(f"Tokens bound to the {edge.replace('_', '-')} place", rows)
    out += table("Pairs of most mutual information", v.get("adjacency", {}).get("pmi_top", []))
    models, tests = v.get("markov", {}), v.get("significance", {})
    out += table("Markov models", models.get("markov", [])) + facts("Best order", models)
    out += table("Intervals", [{"statistic": k, **x} for k, x in tests.get("intervals", {}).items()])
    out += table("Sections against the corpus", tests.get("sections", [])) + table("Line-initial tokens against chance", tests.get("permutations", []))
    out += ["## Hypotheses", "", *facts("Slot grammar", h.get("slots", {})), *table("Rules", h.get("rules", [])), *facts("Verdict", h.get("overall", {}))]
    out += [h["summary"], ""] if "summary" in h else []
    for name in ("warnings", "limitations"):
        out += [f"## {name.capitalize()}", "", *([f"- {w}" for w in run.get(name, [])] or ["- none"]), ""]
    return "\n".join(out)


def preregistration(corpus_version: str) -> dict:
    """What will be tested and how, to be stored before a corpus is looked at."""
    try:
        commit = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=5, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        commit = None
    tests = [{"rule": i, "severity": s, "measurement": m, "passes_if": c} for i, s, m, c in rules.RULES]
    plan = [
        {"step": "ingest", "reads": "the transcription's files", "records": "the version, which must be that of corpus_to_be_tested"},
        {"step": "entropy, positional, adjacency", "reads": "the ingested corpus", "tokens": "without braces for entropies, as they stand for places and neighbours"},
        {"step": "markov", "orders": [0, 1, 2, 3, 4], "smoothing": 1.0, "test_fraction": 0.2, "seed": 42},
        {"step": "slots", "tokens": "without marks of doubt", "supported_from": slots.SUPPORTED},
        {"step": "significance", "resamples": 1000, "seed": 42, "correction": "the level divided by the number of known sections"},
        {"step": "rules", "reads": "the measurements above", "gives": "a verdict for each rule and one overall"},
        {"step": "report", "gives": "every result, whether it speaks for or against the hypothesis"},
    ]
    return {
        "created_at": datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds"), "git_commit": commit, "corpus_to_be_tested": corpus_version,
        "hypothesis": f"Tokens follow a small grammar of slots: it is refuted where fewer than {slots.SUPPORTED:.0%} of a corpus's tokens are valid under it.",
        "primary_test": tests[0], "secondary_tests": tests[1:],
        "slots": [{"name": n, "permitted": sorted(p), "optional": o, "max_repeat": k} for n, p, o, k in T.SLOTS],
        "analysis_plan": plan,
        "exclusions": [
            "Lines without tokens are left out.",
            "Tokens that hold nothing but marks of doubt count as invalid, and as doubtful.",
            "No folio, section or token is left out because of how a test came out.",
        ],
        "deviations": [],
    }
