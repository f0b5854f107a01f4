"""Queries over the driver's tables and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import tokens as T
from quillstone.operators import entropy, graph, inference, keywords, lookup, markov, ngrams, positional, rules, slots
from quillstone.plans import sql
from quillstone.sources import encoded
from quillstone.sources import lines as L
from quillstone.sources.shared import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Documents:
    """``documents`` as a corpus, some lines marked doubtful; built when a query first asks for it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._of = (spark, f"{sf_dir}/documents.parquet")

    @cached_property
    def corpus(self) -> encoded.Corpus:
        return encoded.of_documents(*self._of, marked=True)

    def __getattr__(self, name: str):
        return getattr(self.corpus, name)


def query(oracle: str | None = None):
    """Registers a function of (corpus, spark, sf_dir) under its name."""
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Documents(spark, sf_dir), spark, sf_dir)

        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_vocabulary(c: encoded.Corpus) -> DataFrame:
    return c.vocabulary()


def clean_vocabulary(c: encoded.Corpus) -> DataFrame:
    return c.vocabulary(clean=True)


def folio_lines(lines: DataFrame) -> DataFrame:
    """Lines with folio names made of document numbers, and the sections these stand for."""
    n = F.col("folio").cast("bigint")
    folio = F.concat(F.lit("f"), (n % 120 + 1).cast("string"), F.when(n % 2 == 0, "r").otherwise("v"))
    return lines.withColumn("folio", folio).withColumn("section", T.classify_folio(F.col("folio")))


def event_lines(events: DataFrame) -> DataFrame:
    """A line for each user: the types of their events in the order of time and number."""
    e = events.select("user_id", F.struct("ts", "event_id", "event_type").alias("e"))
    return e.groupBy(F.col("user_id").alias("line_ord")).agg(F.transform(F.array_sort(F.collect_list("e")), lambda x: x.event_type).alias("tokens"))


# -- lines ----------------------------------------------------------------------

@query(sql.L + """SELECT count(*) AS record_count, count(DISTINCT folio) AS folio_count, sum(len(tokens))::BIGINT AS token_count,
  count(*) FILTER (WHERE has_uncertainty) AS uncertainty_line_count FROM lines""")
def corpus_metadata(c, spark, sf_dir):
    return c.lines().agg(
        F.count("*").alias("record_count"),
        F.countDistinct("folio").alias("folio_count"),
        F.sum(F.size("tokens")).alias("token_count"),
        F.count_if("has_uncertainty").alias("uncertainty_line_count"),
    )


@query(sql.T + """SELECT count(DISTINCT token) AS unique_types, (SELECT round(100.0 * count(*) FILTER (WHERE has_uncertainty) / greatest(count(*), 1), 4)
  FROM lines) AS percent_uncertain FROM clean""")
def corpus_summary(c, spark, sf_dir):
    types = clean_vocabulary(c).agg(F.count("*").alias("unique_types"))
    share = c.text.agg(F.round(100.0 * F.count_if("has_uncertainty") / F.greatest(F.count("*"), F.lit(1)), 4).alias("percent_uncertain"))
    return rules.one_row(spark, types, share)


@query(sql.TAGGED)
def parse_tagged_lines(c, spark, sf_dir):
    """Lines of which two in three are tagged, some begin with a tab and a no-break space, and some are comments behind a tab."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("n", "body"))
    doc, n = F.col("doc_id").cast("string"), F.col("n").cast("string")
    tag = F.concat(F.lit("<f"), doc, F.lit("."), F.col("lang"), F.lit("."), n, F.lit(";"), F.col("source"), F.lit("> "))
    space = F.when(F.col("n") % 5 == 4, "\t\u00a0").otherwise("")
    line = F.concat(space, F.when(F.col("n") % 3 != 0, tag).otherwise(""), "body")
    raw = rows.select(doc.alias("file"), "n", F.when(F.col("n") % 11 == 10, F.concat(F.lit("\t# "), "body")).otherwise(line).alias("raw"))
    parsed = L.parse_tagged(raw)
    return parsed.select("file", "n", "folio", "section", "line", "transcriber", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@query(sql.PLAIN)
def parse_plain_lines(c, spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), F.posexplode(F.split("text", "\n")).alias("n", "raw"))
    return L.parse_plain(rows).select("file", "n", "line", F.size("tokens").cast("bigint").alias("n_tokens"))


@query(sql.CONVERTED)
def auto_convert_lines(c, spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "raw"))
    made = L.auto_convert(rows.select(L.line_number(L.stride_of(table(spark, sf_dir, "documents"))), "raw"))
    return made.select("line_ord", "folio", "line", "raw_line", F.array_join("tokens", " ").alias("tokens"))


@query(sql.T + "SELECT line_ord, pos, token FROM clean")
def tokens_flat(c, spark, sf_dir):
    return L.token_rows(c.text, clean=True).select("line_ord", "pos", "token")


@query(sql.L + "SELECT line_ord, folio, len(tokens) AS n_tokens FROM lines WHERE NOT has_uncertainty")
def certain_lines(c, spark, sf_dir):
    return c.lines().filter("NOT has_uncertainty").select("line_ord", "folio", F.size("tokens").cast("bigint").alias("n_tokens"))


@query(sql.L + "SELECT folio, section, count(*) AS n_lines, sum(len(tokens))::BIGINT AS n_tokens FROM lines WHERE section = 'de' GROUP BY ALL")
def lines_of_section(c, spark, sf_dir):
    return c.lines().filter(F.col("section") == "de").groupBy("folio", "section").agg(F.count("*").alias("n_lines"), F.sum(F.size("tokens")).alias("n_tokens"))


@query(sql.L + "SELECT DISTINCT folio FROM lines")
def folios_distinct(c, spark, sf_dir):
    return c.text.select("folio").distinct().orderBy("folio")


@query(sql.L + "SELECT section, count(*) AS n_lines, count(DISTINCT folio) AS n_folios FROM lines GROUP BY 1")
def records_by_section(c, spark, sf_dir):
    return c.text.groupBy("section").agg(F.count("*").alias("n_lines"), F.countDistinct("folio").alias("n_folios"))


@query(sql.TURNS)
def conversation_sizes(c, spark, sf_dir):
    return L.conversation_lines(table(spark, sf_dir, "conversations")).groupBy("folio").agg(F.count("*").alias("n_lines"), F.sum(F.size("tokens")).alias("n_tokens"))


# -- tokens -----------------------------------------------------------------------

@query(sql.V + """SELECT token, n, lower(token) AS lowered, regexp_replace(token, '[{}]', '', 'g') AS stripped, regexp_replace(lower(token), '[{}!?]', '',
  'g') AS normalised, regexp_matches(token, '[{}!?]') AS uncertain FROM raw_v""")
def normalize_tokens(c, spark, sf_dir):
    t = F.col("token")
    return raw_vocabulary(c).select(
        "token",
        "n",
        T.normalise(t).alias("lowered"),
        T.strip_uncertainty(t).alias("stripped"),
        T.normalise(t, strip_uncertain=True).alias("normalised"),
        T.has_uncertainty(t).alias("uncertain"),
    )


@query(sql.L + """SELECT line_ord, len(t) AS n_kept, len(tokens) - len(t) AS n_dropped
  FROM (SELECT *, list_filter(list_transform(tokens, lambda x: regexp_replace(lower(x), '[{}!?]', '', 'g')), lambda x: x <> '') AS t
  FROM lines)""")
def normalize_sequences(c, spark, sf_dir):
    kept = F.size(T.normalise_sequence(F.col("tokens"), strip_uncertain=True))
    return c.text.select("line_ord", kept.cast("bigint").alias("n_kept"), (F.size("tokens") - kept).cast("bigint").alias("n_dropped"))


@query(sql.V + f"""SELECT token, array_to_string(regexp_extract_all(token, '{sql.UNIT}'), ' ') AS units, array_to_string(regexp_extract_all(token, '{sql.UNIT}'), '') AS joined,
  len(regexp_extract_all(regexp_replace(token, '[{{}}]', '', 'g'), '{sql.UNIT}')) AS n_units FROM raw_v""")
def unit_segmentation(c, spark, sf_dir):
    units = T.units(F.col("token"))
    length = T.token_length(F.col("token")).cast("bigint")
    return raw_vocabulary(c).select("token", F.array_join(units, " ").alias("units"), T.join_units(units).alias("joined"), length.alias("n_units"))


@query(sql.V + f"SELECT len(regexp_extract_all(token, '{sql.UNIT}')) AS length, sum(n)::BIGINT AS n FROM clean_v GROUP BY 1")
def unit_length_hist(c, spark, sf_dir):
    return clean_vocabulary(c).groupBy(T.token_length(F.col("token")).cast("bigint").alias("length")).agg(F.sum("n").alias("n"))


@query(sql.V + f""", x AS (SELECT len(regexp_extract_all(token, '{sql.UNIT}')) AS l, n FROM clean_v)
SELECT round(sum(l * n) / sum(n), 6) AS mean, round(sqrt(greatest(sum(l * l * n) / sum(n) - (sum(l * n) / sum(n)) ** 2, 0)), 6) AS std,
  min(l) AS low, max(l) AS high FROM x""")
def unit_length_stats(c, spark, sf_dir):
    x = clean_vocabulary(c).select(T.token_length(F.col("token")).cast("bigint").alias("l"), "n")
    mean = F.sum(F.col("l") * F.col("n")) / F.sum("n")
    square = F.sum(F.col("l") * F.col("l") * F.col("n")) / F.sum("n")
    return x.agg(F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))), 6).alias("std"), F.min("l").alias("low"), F.max("l").alias("high"))


@query(sql.V + f"""SELECT token, n FROM raw_v
  WHERE len(list_intersect(regexp_extract_all(regexp_replace(lower(token), '[{{}}]', '', 'g'), '{sql.UNIT}'), ['k', 't', 'p', 'f'])) > 0""")
def gallows_tokens(c, spark, sf_dir):
    return raw_vocabulary(c).filter(T.is_gallows(F.col("token"))).select("token", "n")


@query(sql.S + "SELECT folio, section, count(*) AS n_lines FROM folio_lines GROUP BY ALL")
def classify_folio(c, spark, sf_dir):
    return folio_lines(c.text).groupBy("folio", "section").agg(F.count("*").alias("n_lines"))


@query("SELECT p_partkey, upper(regexp_replace(lower(p_name), '[aeiou]', '', 'g')) AS skeleton FROM part")
def consonant_skeleton(c, spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.skeleton(F.col("p_name")).alias("skeleton"))


@query(sql.V + "SELECT token, n, round(100.0 * n / (SELECT sum(n) FROM clean_v), 6) AS percent FROM clean_v ORDER BY n DESC, first LIMIT 20")
def top_tokens(c, spark, sf_dir):
    v = clean_vocabulary(c)
    total = v.agg(F.sum("n").alias("t"))
    return v.orderBy(F.desc("n"), "first").limit(20).crossJoin(F.broadcast(total)).select("token", "n", F.round(100.0 * F.col("n") / F.col("t"), 6).alias("percent"))  # one row


# -- entropy ------------------------------------------------------------------------

def by_section(c: encoded.Corpus) -> DataFrame:
    return c.rows(clean=True).groupBy("section", "token").agg(F.count("*").alias("n"))


@query(sql.T + f""", s AS (SELECT section, token, count(*) AS n FROM clean GROUP BY ALL)
SELECT section, round({sql.H}, 6) AS entropy FROM s GROUP BY 1""")
def unigram_entropy_by_section(c, spark, sf_dir):
    return by_section(c).groupBy("section").agg(F.round(entropy.entropy_of(), 6).alias("entropy"))


@query(sql.T + f""", s AS (SELECT section, token, count(*) AS n FROM clean GROUP BY ALL)
SELECT section, sum(n)::BIGINT AS n_tokens, count(*) AS n_types, round(count(*) / sum(n), 6) AS type_token_ratio, round({sql.H}, 6) AS entropy,
  round({sql.H} / {sql.HMAX}, 6) AS normalised, round(1 - {sql.H} / {sql.HMAX}, 6) AS redundancy FROM s GROUP BY 1""")
def analyse_tokens(c, spark, sf_dir):
    return entropy.analyse(by_section(c), ["section"])


def flat_pairs(c: encoded.Corpus) -> DataFrame:
    """(n) of neighbours without braces, across lines."""
    pairs = entropy.flat_pairs(c.lines(clean=True), F.col("tokens"))
    barred = encoded.has_bar(F.col("a")) | encoded.has_bar(F.col("b"))
    return entropy.joined_pairs(pairs, barred, lambda p: c.named(p, "a", "b", clean=True))


@query(sql.CONDITIONAL)
def conditional_entropy(c, spark, sf_dir):
    return entropy.conditional_entropy(flat_pairs(c), clean_vocabulary(c)).select(F.round("conditional_entropy", 6).alias("conditional_entropy"))


@query(sql.CHARACTERS)
def char_entropy(c, spark, sf_dir):
    v = clean_vocabulary(c)
    bare = F.when(F.col("has_uncertainty"), T.clean_tokens(F.col("tokens"))).otherwise(F.col("tokens"))
    pairs = entropy.flat_character_pairs(c.text, bare)
    chars = entropy.character_counts(v)
    joint = entropy.conditional_entropy(entropy.character_pairs(v, pairs), chars)
    own = chars.agg(F.round(entropy.entropy_of(), 6).alias("entropy"), F.sum("n").alias("n_characters"), F.count("*").alias("n_unique"))
    return rules.one_row(spark, own, joint.select(F.round("conditional_entropy", 6).alias("conditional_entropy")))


@query(sql.V + "SELECT c AS character, sum(n)::BIGINT AS n FROM (SELECT n, unnest(regexp_extract_all(token, '(?s).')) AS c FROM clean_v) GROUP BY 1")
def char_frequencies(c, spark, sf_dir):
    return entropy.character_counts(clean_vocabulary(c)).select(F.col("token").alias("character"), "n")


@query(sql.ZIPF)
def zipf_fit(c, spark, sf_dir):
    return entropy.zipf_fit(clean_vocabulary(c))


@query(sql.RANKED)
def zipf_rank_freq(c, spark, sf_dir):
    r = entropy.ranked(clean_vocabulary(c))
    fit = r.agg((-F.regr_slope(F.log("n"), F.log("rank"))).alias("a"), F.max("n").alias("top"))
    return r.filter("rank <= 50").crossJoin(F.broadcast(fit)).select("rank", "n", F.round(F.col("top") * F.pow("rank", -F.col("a")), 4).alias("fitted"))  # one row


def baseline(spark: SparkSession, vocabulary: DataFrame) -> DataFrame:
    """(token, n) of as many random tokens as the corpus has, of about its mean length, from its characters."""
    sums = vocabulary.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.char_length("token")).alias("c")).first()
    return entropy.random_tokens(spark, entropy.character_counts(vocabulary), (sums["c"] or 0) / max(sums["n"] or 0, 1), sums["n"] or 0)


@query(sql.BASELINE)
def random_baseline(c, spark, sf_dir):
    v = clean_vocabulary(c)
    made = baseline(spark, v).agg(F.round(entropy.entropy_of(), 6).alias("baseline_entropy"))
    both = rules.one_row(spark, made, v.agg(F.round(entropy.entropy_of(), 6).alias("entropy")))
    return both.withColumn("delta_bits", F.round(F.col("baseline_entropy") - F.col("entropy"), 4))


# -- places --------------------------------------------------------------------------

def edge_rates(c: encoded.Corpus, final: bool = False, k: int = 30) -> DataFrame:
    totals = c.words.select(F.col("code").alias("token"), F.col("n").alias("total"))
    return positional.edge_rates(positional.edge_rows(c.lines(), final), final, k, totals)


@query(sql.T + sql.edge("pos = 0"))
def positional_rates(c, spark, sf_dir):
    return c.named(edge_rates(c), "token")


@query(sql.T + sql.edge("pos = size - 1"))
def line_final_rates(c, spark, sf_dir):
    return c.named(edge_rates(c, final=True), "token")


@query(sql.T + "SELECT * FROM (" + sql.edge("pos = 0") + ") WHERE rate >= 0.4 AND total >= 10")
def high_bias_tokens(c, spark, sf_dir):
    return c.named(positional.biased(edge_rates(c)), "token")


@query(sql.S + """, g AS (SELECT section, token, count(*) AS n, min(place) AS first FROM folio_tokens GROUP BY 1, 2)
SELECT section, rank, token, n FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY n DESC, first)::INTEGER AS rank FROM g)
  WHERE rank <= 20""")
def section_profiles(c, spark, sf_dir):
    return c.named(positional.section_profiles(L.token_rows(folio_lines(c.lines()))), "token")


@query(sql.T + """, g AS (SELECT pos, token, count(*) AS n, min(place) AS first FROM raw WHERE pos < 5 GROUP BY 1, 2)
SELECT (pos + 1)::INTEGER AS place, rank, token, n FROM (SELECT *, row_number() OVER (PARTITION BY pos
  ORDER BY n DESC, first)::INTEGER AS rank FROM g) WHERE rank <= 10""")
def word_position_profiles(c, spark, sf_dir):
    return c.named(positional.word_position_profiles(c.rows()), "token")


@query(sql.V + """SELECT p::INTEGER AS place, c AS character, sum(n)::BIGINT AS n
  FROM (SELECT n, unnest(regexp_extract_all(token, '(?s).')) AS c, generate_subscripts(regexp_extract_all(token, '(?s).'), 1) AS p
  FROM raw_v) WHERE p <= 8 GROUP BY ALL""")
def char_position_profiles(c, spark, sf_dir):
    return positional.character_position_profiles(raw_vocabulary(c))


def jaccard(c: encoded.Corpus) -> DataFrame:
    return positional.jaccard_of_edges(positional.edge_rows(c.lines()), last=positional.edge_rows(c.lines(), final=True))


@query(sql.T + f""", a AS ({sql.edge('pos = 0', 20)}), b AS ({sql.edge('pos = size - 1', 20)})
SELECT round(count(*) FILTER (WHERE k = 2) / greatest(count(*), 1), 6) AS jaccard FROM (SELECT token, count(*) AS k FROM (SELECT token
  FROM a UNION ALL SELECT token FROM b) GROUP BY 1)""")
def jaccard_initial_final(c, spark, sf_dir):
    return jaccard(c)


# -- neighbours ------------------------------------------------------------------------

def most_common(c: encoded.Corpus, n: int, k: int = 30) -> DataFrame:
    best = ngrams.counted(c.lines(), n).orderBy(F.desc("n"), "first").limit(k)
    names = [f"t{j}" for j in range(n)]
    named = c.named(best.select(*(F.col("gram")[j].alias(t) for j, t in enumerate(names)), "n", "first"), *names)
    return named.select(F.array(*names).alias("gram"), "n", "first").transform(ngrams.most_common, k)


@query(sql.grams(2) + "SELECT array_to_string(gram, ' ') AS gram, n FROM grams ORDER BY n DESC, first LIMIT 30")
def bigrams_top(c, spark, sf_dir):
    return most_common(c, 2)


@query(sql.grams(3) + "SELECT array_to_string(gram, ' ') AS gram, n FROM grams ORDER BY n DESC, first LIMIT 30")
def trigrams_top(c, spark, sf_dir):
    return most_common(c, 3)


@query(sql.grams(2) + f"SELECT round({sql.H}, 6) AS bigram_entropy FROM grams")
def bigram_entropy(c, spark, sf_dir):
    return ngrams.pair_entropy(ngrams.counted(c.lines(), 2))


@query(sql.pmi("DESC", "first", "> 0"))
def pmi_top(c, spark, sf_dir):
    own = raw_vocabulary(c).select(F.col("code").alias("token"), "n")
    return c.named(ngrams.strongest(ngrams.mutual_information(ngrams.counted(c.lines(), 2), own)), "w1", "w2")


@query(sql.PMI_LOW)
def pmi_low(c, spark, sf_dir):
    """Over the users' sequences of events, where some pairs are rarer than by chance."""
    own = event_lines(table(spark, sf_dir, "events"))
    words = own.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return ngrams.strongest(ngrams.mutual_information(ngrams.counted(own, 2), words), low=True)


@query(sql.T + """SELECT (SELECT count(*) FROM raw) AS n_tokens, (SELECT sum(greatest(len(tokens) - 1, 0))
  FROM lines)::BIGINT AS n_bigrams, (SELECT sum(greatest(len(tokens) - 2, 0))
  FROM lines)::BIGINT AS n_trigrams, (SELECT count(DISTINCT token) FROM raw) AS n_types""")
def adjacency_totals(c, spark, sf_dir):
    return ngrams.totals(c.lines(), raw_vocabulary(c))


@query(sql.markov('SELECT "order", perplexity FROM result'))
def markov_perplexity(c, spark, sf_dir):
    return markov.analysis(c.lines()).select("order", "perplexity")


@query(sql.markov("""SELECT "order", round((lag(perplexity) OVER (ORDER BY "order") - perplexity) / lag(perplexity) OVER (ORDER BY "order"), 6) AS reduction, n_contexts
FROM result JOIN contexts USING ("order")"""))
def markov_reductions(c, spark, sf_dir):
    return markov.analysis(c.lines()).select("order", "reduction", "n_contexts")


@query(sql.markov('SELECT "order", n_tokens, n_unknown FROM result'))
def markov_oov(c, spark, sf_dir):
    return markov.analysis(c.lines()).select("order", "n_tokens", "n_unknown")


@query(sql.markov("""SELECT "order", train_perplexity, n_train_tokens, vocab_size,
  round((lag(train_perplexity) OVER (ORDER BY "order") - train_perplexity) / lag(train_perplexity) OVER (ORDER BY "order"), 6) AS train_reduction,
true AS honest FROM trained"""))
def markov_training(c, spark, sf_dir):
    return markov.analysis(c.lines()).select("order", "train_perplexity", "n_train_tokens", "vocab_size", "train_reduction", "honest")


@query(sql.markov("""SELECT (SELECT arg_min("order", (train_perplexity, "order")) FROM trained) AS by_train,
  (SELECT arg_min("order", (perplexity, "order")) FROM result) AS by_test"""))
def markov_optimal_order(c, spark, sf_dir):
    return markov.optimal(markov.analysis(c.lines()))


@query(sql.EVENTS)
def event_transitions(c, spark, sf_dir):
    own = event_lines(table(spark, sf_dir, "events"))
    return markov.transitions(own, 1)


# -- slots ---------------------------------------------------------------------------------

def checked(c: encoded.Corpus) -> DataFrame:
    return slots.validated(raw_vocabulary(c))


@query(sql.SLOTS + "SELECT token, n, is_valid, array_to_string(matched, ',') AS matched_slots, category AS failure_category, confidence FROM checked")
def slot_validation(c, spark, sf_dir):
    return checked(c).select("token", "n", "is_valid", F.array_join("matched_slots", ",").alias("matched_slots"), "failure_category", "confidence")


@query(sql.CLEAN_SLOTS + """SELECT sum(n)::BIGINT AS n_tokens, sum(n * is_valid::INT)::BIGINT AS n_valid, round(sum(n * is_valid::INT) / sum(n), 6) AS coverage,
  sum(n * is_valid::INT) / sum(n) >= 0.7 AS supported, sum(n * (marks OR token = '')::INT)::BIGINT AS n_uncertain FROM checked""")
def slot_coverage(c, spark, sf_dir):
    return slots.coverage(slots.validated(clean_vocabulary(c)))


@query(sql.CLEAN_SLOTS + """, s AS (SELECT section, regexp_replace(token, '[{}]', '', 'g') AS token, count(*) AS n FROM folio_tokens GROUP BY ALL)
SELECT section, sum(s.n)::BIGINT AS n_tokens, round(sum(s.n * is_valid::INT) / sum(s.n), 6) AS coverage FROM s JOIN checked USING (token)
  GROUP BY 1""")
def slot_coverage_by_section(c, spark, sf_dir):
    own = L.token_rows(folio_lines(c.lines(clean=True))).groupBy("section", F.col("token").alias("code")).agg(F.count("*").alias("n"))
    good = slots.validated(clean_vocabulary(c)).drop("n", "first")
    return slots.coverage(own.join(good, "code"), ["section"]).select("section", "n_tokens", "coverage")


@query(sql.CLEAN_SLOTS + "SELECT slot, sum(n)::BIGINT AS n FROM (SELECT n, unnest(matched) AS slot FROM checked WHERE is_valid) GROUP BY 1")
def slot_usage(c, spark, sf_dir):
    return slots.usage(slots.validated(clean_vocabulary(c)))


@query(sql.CLEAN_SLOTS + """SELECT category AS failure_category, sum(n)::BIGINT AS n, round(sum(n) / (SELECT sum(n) FROM checked WHERE NOT is_valid), 6) AS share
  FROM checked WHERE NOT is_valid GROUP BY 1""")
def slot_failures(c, spark, sf_dir):
    return slots.failures(slots.validated(clean_vocabulary(c)))


@query(sql.CLEAN_SLOTS + "SELECT token, n, category AS failure_category FROM checked WHERE NOT is_valid ORDER BY n DESC, first LIMIT 30")
def invalid_top(c, spark, sf_dir):
    return slots.most_invalid(slots.validated(clean_vocabulary(c)))


# -- inference --------------------------------------------------------------------------------

KNOWN = [name for name, _, _ in T.SECTIONS]


@query(sql.CHI)
def chi_square_sections(c, spark, sf_dir):
    return inference.chi_square(L.token_rows(folio_lines(c.lines(clean=True))), KNOWN)


@query(sql.CHI_P)
def chi_square_p(c, spark, sf_dir):
    return inference.significance(inference.chi_square(L.token_rows(folio_lines(c.lines(clean=True))), KNOWN))


@query(sql.BOOTSTRAP_ENTROPY)
def bootstrap_entropy_ci(c, spark, sf_dir):
    return inference.bootstrap(c.lines(clean=True), inference.ENTROPY)


@query(sql.BOOTSTRAP_ZIPF)
def bootstrap_zipf_ci(c, spark, sf_dir):
    return inference.bootstrap(c.lines(clean=True), inference.ZIPF, seed=43)


@query(sql.PERMUTED)
def permutation_bias(c, spark, sf_dir):
    best = [r["token"] for r in edge_rates(c, k=5).filter("total >= 10").collect()]  # five at most
    return c.named(inference.permutation_tests(c.rows(clean=True), best, 1000, 142), "token", clean=True)


# -- graphs and look-ups ------------------------------------------------------------------------

def neighbours(c: encoded.Corpus) -> DataFrame:
    """(src, dst): the codes of every two words that stand next to each other."""
    return ngrams.counted(c.lines(), 2).select(F.col("gram")[0].alias("src"), F.col("gram")[1].alias("dst"))


@query(sql.EDGES + """, k AS (SELECT count(*) AS n_nodes FROM (SELECT a FROM u UNION SELECT b FROM u)), m AS (SELECT count(*) AS n_edges FROM u)
SELECT n_nodes, n_edges, round(2.0 * n_edges / (n_nodes * (n_nodes - 1)), 3)::DOUBLE AS density FROM k, m""")
def graph_metrics(c, spark, sf_dir):
    return graph.metrics(neighbours(c))


@query(sql.COMPONENTS)
def connected_components(c, spark, sf_dir):
    """A component goes by the name of its first word."""
    parts = c.named(graph.components(neighbours(c)), "node")
    first = parts.groupBy("component").agg(F.min("node").alias("name"))
    return parts.join(first, "component").select("node", F.col("name").alias("component"))


@query(sql.grams(2) + """, t AS (SELECT * FROM grams ORDER BY n DESC, first LIMIT 30)
SELECT gram[1] AS src, gram[2] AS dst, t.n AS weight, round(t.n / 100.0, 4)::DOUBLE AS width, (c.n * 0.5)::DOUBLE AS node_size FROM t
  JOIN clean_v c ON c.token = gram[1]""")
def transition_graph(c, spark, sf_dir):
    best = ngrams.counted(c.lines(), 2).orderBy(F.desc("n"), "first").limit(30).select(F.col("gram")[0].alias("src"), F.col("gram")[1].alias("dst"), F.col("n").alias("weight"))
    sizes = clean_vocabulary(c).select(F.col("code").alias("src"), (F.col("n") * 0.5).cast("double").alias("node_size"))
    return c.named(best.join(sizes, "src").select("src", "dst", "weight", F.round(F.col("weight") / 100.0, 4).alias("width"), "node_size"), "src", "dst")


@query("""SELECT c_custkey, lower(trim(q)) AS key, n_regionkey AS meaning
FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN ' no such key' ELSE '  ' || upper(n_name) || ' ' END AS q
      FROM customer JOIN nation ON c_nationkey = n_nationkey)
JOIN nation ON lower(n_name) = lower(trim(q))""")
def lookup_join(c, spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    named = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    asked = named.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, " no such key").otherwise(F.concat(F.lit("  "), F.upper("n_name"), F.lit(" "))).alias("query"))
    entries = nation.select(F.lower("n_name").alias("key"), F.col("n_regionkey").alias("meaning"))
    return lookup.exact(asked, entries).select("c_custkey", "key", "meaning")


@query("""WITH k(key_order, key, answer) AS (SELECT n_nationkey, lower(n_name), 'nation ' || n_nationkey FROM nation),
q AS (SELECT o_orderkey AS id, lower(o_orderpriority || ' ' || n_name) AS low
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT id, arg_min(key, key_order) AS key, arg_min(answer, key_order) AS answer FROM q LEFT JOIN k ON contains(low, key) GROUP BY id""")
def keyword_dispatch(c, spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    key = nation.select(F.col("n_nationkey").alias("key_order"), F.lower("n_name").alias("key"), F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("answer"))
    customer = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "n_name")
    asked = table(spark, sf_dir, "orders").join(customer, "o_custkey").select(F.col("o_orderkey").alias("id"), F.concat_ws(" ", "o_orderpriority", "n_name").alias("query"))
    return lookup.dispatch(asked, key)


@query("""WITH k AS (SELECT row_number() OVER (ORDER BY key) AS key_order, key FROM (SELECT DISTINCT lower(w) AS key FROM (SELECT unnest(string_split(p_name, ' ')) AS w
  FROM part) WHERE length(w) >= 3)), d AS (SELECT row_number() OVER () AS row, doc_id, lower(text) AS low FROM documents)
SELECT doc_id, arg_min(key, key_order) AS key, min(key_order) AS key_order FROM d LEFT JOIN k ON contains(low, key) GROUP BY row, doc_id""")
def keyword_scan(c, spark, sf_dir):
    """The first word of any part's name, by alphabet, that each document holds."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w")).filter(F.char_length("w") >= 3).select(F.lower("w").alias("key")).distinct()
    order = F.row_number().over(Window.orderBy("key"))  # a row for each different word of names
    numbered = words.withColumn("key_order", order).withColumn("answer", F.col("key_order").cast("bigint"))
    found = keywords.first_keywords(table(spark, sf_dir, "documents").select("doc_id", "text"), numbered, "text")
    return found.select("doc_id", "key", F.col("answer").alias("key_order"))


@query(sql.L + "SELECT line_ord, folio, section, len(tokens) AS n_tokens FROM lines WHERE folio = '7'")
def lines_of_folio(c, spark, sf_dir):
    return c.lines().filter(F.col("folio") == "7").select("line_ord", "folio", "section", F.size("tokens").cast("bigint").alias("n_tokens"))


@query(sql.FUZZY)
def fuzzy_match(c, spark, sf_dir):
    words = raw_vocabulary(c).select(F.col("token").alias("word"))
    asked = table(spark, sf_dir, "region").select(F.col("r_name").alias("query"))
    return lookup.fuzzy(asked, words)


# -- rules ---------------------------------------------------------------------------------------

def measurements(c: encoded.Corpus, spark: SparkSession) -> DataFrame:
    """One row of what the rules need."""
    clean = clean_vocabulary(c)
    # written once for the three that read it
    good = stored(slots.validated(clean).select("token", "n", "is_valid", "matched_slots", "failure_category"), "validated")
    used = slots.usage(good).agg(F.max(F.when(F.col("slot") == "core", F.col("n"))).alias("core_usage"), F.max("n").alias("most_usage"))
    perplexity = [F.max(F.when(F.col("order") == k, F.col("perplexity"))).alias(f"perplexity_{k}") for k in (0, 1)]
    conditional = entropy.conditional_entropy(flat_pairs(c), clean)
    one = rules.one_row(
        spark,
        slots.coverage(good).select("coverage"),
        slots.failures(good).agg(F.max("share").alias("worst_failure")),
        used,
        clean.agg(F.round(entropy.entropy_of(), 6).alias("entropy")),
        baseline(spark, clean).agg(F.round(entropy.entropy_of(), 6).alias("baseline_entropy")),
        conditional.select(F.round("conditional_entropy", 6).alias("conditional_entropy")),
        entropy.zipf_fit(clean).select("alpha", "r_squared"),
        positional.biased(edge_rates(c), 0.5).agg(F.count("*").alias("n_biased")),
        jaccard(c),
        markov.analysis(c.lines(), orders=1).agg(*perplexity),
        inference.rule_significance(L.token_rows(folio_lines(c.lines(clean=True))), KNOWN),
    )
    saved = F.try_divide(F.col("perplexity_0") - F.col("perplexity_1"), F.col("perplexity_0"))
    return one.withColumn("perplexity_saved", F.round(saved, 6))


@query(sql.rule_verdicts())
def rule_verdicts(c, spark, sf_dir):
    return rules.evaluate(measurements(c, spark))


@query(sql.overall_verdict())
def overall_verdict(c, spark, sf_dir):
    return rules.overall(rules.evaluate(measurements(c, spark)))
