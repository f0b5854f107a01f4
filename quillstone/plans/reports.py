"""What each command reports of a corpus, as plain values.

All work is done in DataFrames; what reaches the driver are the bounded tables
that a report shows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import tokens as T
from quillstone.operators import entropy, inference, markov, ngrams, positional, slots
from quillstone.sources import lines as L

KNOWN = [name for name, _, _ in T.SECTIONS]
#: Frequencies that a report shows of the rank-frequency fit. An alphabet is shown whole.
RANKS_SHOWN = 50


def rows_of(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def one_of(df: DataFrame) -> dict:
    return df.first().asDict(recursive=True)


def metadata(lines: DataFrame) -> dict:
    return one_of(
        lines.agg(
            F.count("*").alias("record_count"), F.countDistinct("folio").alias("folio_count"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("token_count"),
            F.count_if("has_uncertainty").alias("uncertainty_line_count"),
        )
    )


def sectioned(lines: DataFrame) -> DataFrame:
    """The lines with the sections that their folios belong to by convention."""
    return lines.withColumn("section", T.classify_folio(F.col("folio")))


def entropy_report(lines: DataFrame, label: str = "corpus", clean: bool = True, seed: int = 42) -> dict:
    tokens = T.clean_tokens(F.col("tokens")) if clean else F.col("tokens")
    vocabulary = L.vocabulary(L.token_rows(lines, clean=clean))
    measured = one_of(entropy.analyse(vocabulary))
    conditional = entropy.conditional_entropy(entropy.flat_pairs(lines, tokens), vocabulary).first()[0]
    alphabet = entropy.character_counts(vocabulary)
    pairs = entropy.flat_character_pairs(lines, tokens)
    joint = entropy.conditional_entropy(entropy.character_pairs(vocabulary, pairs), alphabet).first()[0]
    characters = one_of(alphabet.agg(F.round(entropy.entropy_of(), 6).alias("entropy"), F.sum("n").alias("n_characters"), F.count("*").alias("n_unique")))
    sums = vocabulary.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.char_length("token")).alias("c")).first()
    made = entropy.random_tokens(lines.sparkSession, alphabet, (sums["c"] or 0) / max(sums["n"] or 0, 1), sums["n"] or 0, seed)
    baseline = round(made.agg(entropy.entropy_of()).first()[0], 6)
    return {
        "label": label, "clean": clean,
        "entropy": {**measured, "conditional_entropy": round(conditional, 6), "top_tokens": rows_of(vocabulary.orderBy(F.desc("n"), "first").limit(20).select("token", "n"))},
        "characters": {**characters, "conditional_entropy": round(joint, 6), "frequencies": rows_of(alphabet.orderBy(F.desc("n"), "token").select(F.col("token").alias("character"), "n"))},
        "zipf": {**one_of(entropy.zipf_fit(vocabulary)), "rank_frequency": rows_of(entropy.ranked(vocabulary).filter(F.col("rank") <= RANKS_SHOWN).orderBy("rank"))},
        "baseline": {"entropy": baseline, "seed": seed, "delta_bits": round(baseline - measured["entropy"], 4)},
    }


def positional_report(lines: DataFrame, top_n: int = 30) -> dict:
    rows, own = L.token_rows(lines), sectioned(lines)
    initial, final = positional.edge_rates(rows, k=top_n), positional.edge_rates(rows, final=True, k=top_n)
    return {
        **{k: v for k, v in metadata(lines).items() if k in ("record_count", "token_count")},
        "line_initial": rows_of(initial), "line_final": rows_of(final),
        "biased": {"line_initial": rows_of(positional.biased(initial)), "line_final": rows_of(positional.biased(final))},
        "overlap_of_edges": positional.jaccard_of_edges(rows).first()[0],
        "sections": rows_of(positional.section_profiles(L.token_rows(own)).orderBy("section", "rank")),
        "word_places": rows_of(positional.word_position_profiles(rows).orderBy("place", "rank")),
        "character_places": rows_of(positional.character_position_profiles(L.vocabulary(rows)).orderBy("place", F.desc("n"), "character")),
    }


def adjacency_report(lines: DataFrame, top_n: int = 30, min_count: int = 5) -> dict:
    words, pairs, triples = L.vocabulary(L.token_rows(lines)), ngrams.counted(lines, 2), ngrams.counted(lines, 3)
    pmi = ngrams.mutual_information(pairs, words, min_count)
    return {
        **one_of(ngrams.totals(lines, words)), "n_pair_types": pairs.count(), "n_triple_types": triples.count(), **one_of(ngrams.pair_entropy(pairs)),
        "bigrams": rows_of(ngrams.most_common(pairs, top_n)), "trigrams": rows_of(ngrams.most_common(triples, top_n)),
        "pmi_top": rows_of(ngrams.strongest(pmi, top_n)), "pmi_low": rows_of(ngrams.strongest(pmi, top_n, low=True)), "min_pmi_count": min_count,
    }


def markov_report(lines: DataFrame, orders: int = 4, smoothing: float = 1.0, share: float = 0.2, seed: int = 42) -> dict:
    models = rows_of(markov.analysis(lines, orders, smoothing, share, seed).orderBy("order"))  # a row for each order
    honest = all(m.pop("honest") for m in models)
    best = {}
    for name, column in (("optimal_order_by_train", "train_perplexity"), ("optimal_order_by_test", "perplexity")):
        finite = [(m[column], m["order"]) for m in models if m[column] is not None and m[column] < float("inf")]
        best[name] = min(finite)[1] if finite else None
    warning = None if honest else "The held-out perplexity is of the training lines, an estimate within the sample."
    return {"markov": models, **best, "split": {"test_fraction": share, "seed": seed, "smoothing": smoothing, "honest": honest, "warning": warning}}


def slots_report(lines: DataFrame, clean: bool = True) -> dict:
    checked = slots.validated(L.vocabulary(L.token_rows(lines, clean=clean)))
    own = slots.validated(L.token_rows(sectioned(lines), clean=clean).groupBy("section", "token").agg(F.count("*").alias("n")))
    return {
        **one_of(slots.coverage(checked)), "threshold": slots.SUPPORTED, "usage": {r["slot"]: r["n"] for r in slots.usage(checked).collect()},
        "failures": rows_of(slots.failures(checked).orderBy("failure_category")), "invalid_top": rows_of(slots.most_invalid(checked)),
        "sections": rows_of(slots.coverage(own, ["section"]).select("section", "n_tokens", "coverage").orderBy("section")),
    }


def significance_report(lines: DataFrame, resamples: int = 500, seed: int = 42, tested: int = 5) -> dict:
    rows = L.token_rows(lines)
    initial = [r["token"] for r in positional.edge_rates(rows, k=tested).filter("total >= 10").collect()]  # ``tested`` at most
    found = inference.analysis(lines, L.token_rows(lines, clean=True), L.token_rows(sectioned(lines), clean=True), KNOWN, initial, resamples, seed)
    sections = rows_of(found["sections"].orderBy("section"))
    return {
        "intervals": {name: {**one_of(found[name]), "confidence": 0.95, "seed": seed + k} for k, name in enumerate(("entropy", "zipf_alpha"))},
        "sections": sections, "level": 0.05 / max(len(sections), 1), "n_significant": sum(bool(r["significant"]) for r in sections),
        "permutations": sorted(rows_of(found["permutations"]), key=lambda r: initial.index(r["token"])),
        "resampling": {"unit": "lines", "resamples": resamples, "seed": seed, "method": "percentiles of Poisson-weighted resamples"},
    }
