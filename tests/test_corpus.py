"""Sources, token functions and statistics against plain Python on small corpora."""

import itertools
import json
import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillstone.functions import tokens as T
from quillstone.operators import draws, entropy, graph, inference, keywords, lookup, markov, ngrams, order, positional, rules, slots
from quillstone.plans import analysis, cli, reports
from quillstone.sources import lines as L
from quillstone.sources import encoded, exchange, images, shared, sinks
from quillstone.streaming import counts, statistics

LETTERS = ["o", "a", "e", "i", "c", "h", "s", "d", "y", "k", "t", "l", "r", "n", "q", "m", "{", "}", "!", "?", "O", "ü"]


def corpus(spark, rows):
    frame = spark.createDataFrame([(k, f"f{k % 7 + 1}r", "P", str(k), "H", " ".join(t), t) for k, t in enumerate(rows)], "line_ord bigint, folio string, section string, line string, transcriber string, raw_line string, tokens array<string>")
    return frame.withColumn("has_uncertainty", T.line_has_uncertainty(F.col("tokens")))


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(1)
    words = ["ol", "daiin", "chedy", "okaiin", "shol", "qo", "ar", "{d}y", "cthy", "{}", "o!"]
    return [[draw.choice(words) for _ in range(draw.randrange(1, 9))] for _ in range(120)]


@pytest.fixture(scope="module")
def lines(spark, rows):
    return corpus(spark, rows)


def plain_units(token, groups):
    out, k = [], 0
    while k < len(token):
        g = next((g for g in sorted(groups, key=len, reverse=True) if token.startswith(g, k)), token[k])
        out.append(g)
        k += len(g)
    return out


def plain_slots(token):
    text = "".join(c for c in token if c not in "{}!?")
    if not text:
        return False, [], "empty_token"
    left, matched = plain_units(text, T.SLOT_UNITS), []
    for name, permitted, optional, most in T.SLOTS:
        n = 0
        while n < most and left and left[0] in permitted:
            left, n = left[1:], n + 1
        if n:
            matched.append(name)
        elif not optional:
            return False, matched, "missing_required_slot"
    return (False, matched, "unconsumed_units") if left else (True, matched, None)


def test_segmenting_and_slots(spark):
    draw = random.Random(2)
    tokens = ["".join(draw.choice(LETTERS) for _ in range(draw.randrange(1, 9))) for _ in range(3000)] + ["o", "ol", "oo", "qo", "daiin", "okaiin", "chedy", "cthy", "{}", "aiiin"]
    frame = spark.createDataFrame([(t,) for t in tokens], "token string")
    for r in frame.select("token", T.units(F.col("token")).alias("u"), T.validate(F.col("token")).alias("v")).collect():
        assert r.u == plain_units(r.token, T.UNITS)
        assert (r.v.is_valid, r.v.matched_slots, r.v.failure_category) == plain_slots(r.token), r.token
    own = ("ab", "abc", "{}", "o!", ".", "")
    for r in frame.select("token", T.units(F.col("token"), own).alias("u")).collect():
        assert r.u == plain_units(r.token, [g for g in own if g])
    truth = {"o": False, "d": False, "ol": True, "oo": True, "qo": True, "daiin": True, "shol": True, "chedy": False, "qokaiin": False, "cthy": False, "{}": False}
    got = spark.createDataFrame([(t,) for t in truth], "token string").select("token", T.validate(F.col("token")).is_valid.alias("v")).collect()
    assert {r.token: r.v for r in got} == truth


def test_tokens(spark):
    one = spark.range(1).select(
        T.tokenise(F.lit(" a.b-c  {d}! ")).alias("t"), T.normalise_sequence(F.array(F.lit("{}"), F.lit("A{b}!")), strip_uncertain=True).alias("n"), T.is_gallows(F.lit("OK{a}")).alias("g"),
        T.is_gallows(F.lit("cthy")).alias("h"), T.skeleton(F.lit("Okaiy2.")).alias("s"), *[T.classify_folio(F.lit(f)).alias(f) for f in ("f1r", "F67v", "f68r", "f74r", "f102v", "f116r", "f067r", "f67r2")],
    ).first()
    assert one.t == ["a", "b", "c", "{d}!"] and one.n == ["ab"] and one.g and not one.h and one.s == "KY2."
    assert list(one)[5:] == ["herbal", "astronomical", "cosmological", "unknown", "pharmaceutical", "recipes", "unknown", "unknown"]


def test_tagged_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.vtt").write_bytes("# note\n<f1r.P.1;H> aa.bb {c}\nmore-words\n\n<f1r.P.2>\r\ncarried on\n".encode())
    (tmp_path / "b.vtt").write_bytes("first caf\xe9\n<f2r.L.1;C> zz".encode("latin-1"))
    got = [tuple(r) for r in L.parse_tagged(L.read_files(spark, str(tmp_path))).orderBy("file", "n").select("folio", "section", "line", "transcriber", "tokens", "has_uncertainty").collect()]
    assert got == [
        ("f1r", "P", "1", "H", ["aa", "bb", "{c}"], True), ("f1r", "P", "1", "H", ["more", "words"], False), ("f1r", "P", "2", "unknown", ["carried", "on"], False),
        ("unknown", "unknown", "0", "unknown", ["first", "café"], False), ("f2r", "L", "1", "C", ["zz"], False),
    ]
    odd = ["\t# note", " \u00a0<f3v.P.1.b;X;Y> aa\u2003bb", "<f4r.P.>x", "<f5r.P.2;>cc", "<.P.2>dd", "<f6r>.L.3>ee", "\u3000", "tail"]
    (tmp_path / "c").mkdir()
    (tmp_path / "c/odd.txt").write_text("\n".join(odd))
    got = [tuple(r) for r in L.parse_tagged(L.read_files(spark, str(tmp_path / "c"))).orderBy("n").select("folio", "section", "line", "transcriber", "tokens").collect()]
    assert got == [
        ("f3v", "P", "1.b", "X;Y", ["aa", "bb"]), ("f3v", "P", "1.b", "X;Y", ["<f4r", "P", ">x"]), ("f5r", "P", "2", "unknown", ["cc"]), ("f5r", "P", "2", "unknown", ["<", "P", "2>dd"]),
        ("f6r>", "L", "3", "unknown", ["ee"]), ("f6r>", "L", "3", "unknown", ["tail"]),
    ]
    (tmp_path / "d").mkdir()
    with pytest.raises(FileNotFoundError):
        L.read_files(spark, str(tmp_path / "d"))


def test_corpus_documents(spark, tmp_path):
    """Corpora as one document: written and read again, read from other writers' documents, however these are cut."""
    draw = random.Random(12)
    odd = ['"', "\\", "\\\"", "}", "{", "]", "[", ",", "\n", "\t", "\U0001f600", "\u00e9", "records", '"records": [', "\u2028", "x", " "]
    word = lambda: "".join(draw.choice(odd) for _ in range(draw.randrange(1, 6)))
    records = [(k * 3, word(), word(), str(k), None if k % 5 == 0 else word(), word() + " " + word(), [word() for _ in range(draw.randrange(0, 4))]) for k in range(70)]
    schema = "line_ord bigint, folio string, section string, line string, transcriber string, raw_line string, tokens array<string>"
    names = ["folio", "section", "line", "transcriber", "raw_line", "tokens"]
    metadata = {"note": 'a "records": [ } { \\', "version": "\U0001f600"}
    exchange.write_corpus(spark.createDataFrame(records, schema).repartition(5), str(tmp_path / "own/corpus.json"), metadata)
    whole = json.loads((tmp_path / "own/corpus.json").read_text(encoding="utf-8"))
    assert whole == {"metadata": metadata, "records": [dict(zip(names, r[1:], strict=True)) for r in records]}
    others = {
        "indented.json": json.dumps(whole, indent=2, ensure_ascii=False), "line.json": json.dumps(whole), "last.json": json.dumps({"records": whole["records"], "metadata": {"x": "}{"}}, indent=1),
        "extra.json": json.dumps({"metadata": {}, "records": [{**r, "has_uncertainty": False} for r in whole["records"]]}),
    }
    for name, text in others.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    for size in (37, 500, 1 << 20):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for name in ("own/corpus.json", *others) if size > 40 else ("indented.json",):
            got = exchange.read_corpus(spark, str(tmp_path / name)).orderBy("line_ord").collect()
            assert [(r.line_ord, *(r[n] for n in names)) for r in got] == [(k, *r[1:]) for k, r in enumerate(records)], (name, size)
    # filters on what is parsed may be moved below the parsing
    assert exchange.read_corpus(spark, str(tmp_path / "line.json")).select(F.explode("tokens")).count() == sum(len(r[-1]) for r in records)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    exchange.write_corpus(spark.createDataFrame([], schema), str(tmp_path / "none.json"), {})
    assert json.loads((tmp_path / "none.json").read_text()) == {"metadata": {}, "records": []} and exchange.read_corpus(spark, str(tmp_path / "none.json")).collect() == []
    (tmp_path / "bad.json").write_text('{"metadata": {"a": [1]}, "rows": [{"folio": "x"}]}')
    with pytest.raises(ValueError, match="no list of records"):
        exchange.read_corpus(spark, str(tmp_path / "bad.json"))
    (tmp_path / "worse.json").write_text('{"records": [{"folio": 1 2}]}')
    with pytest.raises(Exception, match="(?i)malformed|parse|json"):
        exchange.read_corpus(spark, str(tmp_path / "worse.json")).collect()


def test_files_are_cut_anywhere(spark, tmp_path, monkeypatch):
    """Line numbers, tags carried on and encodings are those of a plain reader, wherever files are cut."""
    monkeypatch.setattr(L, "STRETCH", 4)
    body = "# head\r\n<f1r.P.1;H> aa b\u00fcb\rcc\n\n\nmore {x} \U0001f600\r\r\n<f2v.L.3> last\none.two"
    (tmp_path / "a.vtt").write_bytes(body.encode())
    (tmp_path / "b.vtt").write_bytes(("\n" * 5 + "<f9r.Z.1> caf\xe9 " + "word " * 20 + "\r\ntail\r").encode("latin-1"))
    (tmp_path / "c.vtt").write_bytes(b"")
    import re

    want = {}
    for name in "abc":
        data = (tmp_path / f"{name}.vtt").read_bytes()
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = data.decode("latin-1")
        lines_of = re.split("\r\n|\n|\r", text)
        want |= {(name, n): line for n, line in enumerate(lines_of) if line or n < len(lines_of) - 1}
    parsed = None
    for size in (1, 2, 3, 5, 8, 13, 17, 64, 1 << 20):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        found = L.read_files(spark, str(tmp_path))
        assert {(r.file[-5], r.n): r.raw for r in found.collect()} == want, size
        if size in (3, 17, 1 << 20):
            got = sorted((r.file[-5], r.n, r.folio, r.line, r.tokens) for r in L.parse_tagged(found).collect())
            assert parsed in (None, got)
            parsed = got
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r[2:4] for r in parsed] == [("f1r", "1")] * 3 + [("f2v", "3")] * 2 + [("f9r", "1")] * 2


def test_tags_reach_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(L, "STRETCH", 3)
    raw = [("a", n, f"<f{n}r.P.1> t{n}" if n in (2, 10) else f"t{n}") for n in range(20)] + [("b", n, "x") for n in range(7)]
    got = {(r.file, r.n): r.folio for r in L.parse_tagged(spark.createDataFrame(raw, "file string, n int, raw string")).collect()}
    assert got == {("a", n): "unknown" if n < 2 else "f2r" if n < 10 else "f10r" for n in range(20)} | {("b", n): "unknown" for n in range(7)}


def test_other_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\nx y,1\n,2\n")
    for lines in (L.auto_convert(L.read_csv_line(spark, str(tmp_path / "t.csv"))), L.auto_convert_csv(spark, str(tmp_path / "t.csv"))):
        assert [(r.line, r.tokens) for r in lines.orderBy("line_ord").collect()] == [("1", ["x", "y", "1", "nan", "2"])]
    # more rows than were once read, some of white space alone
    (tmp_path / "long.csv").write_text("a\n" + '" "\n' * 30 + "".join(f'r{k}\n" "\n' for k in range(3000)) + '" "\n' * 5000 + "end\n")
    whole = L.read_csv_line(spark, str(tmp_path / "long.csv")).first().raw
    assert whole.split()[-1] == "end" and len(whole.split()) == 3001
    assert L.auto_convert_csv(spark, str(tmp_path / "long.csv")).collect() == L.auto_convert(L.read_csv_line(spark, str(tmp_path / "long.csv"))).collect()
    plain = spark.createDataFrame([("f", 0, "\t# no"), ("f", 1, "  a-b\u00a0c "), ("f", 2, "\u2003")], "file string, n int, raw string")
    assert [(r.n, r.line, r.tokens) for r in L.parse_plain(plain).collect()] == [(1, "1", ["a-b", "c"])]
    sinks.write_table(plain.limit(1), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["file", "n", "raw"]


def test_entropy_and_fit(spark, rows, lines):
    flat = [t.replace("{", "").replace("}", "") for r in rows for t in r]
    h = lambda c: -sum(n / sum(c.values()) * math.log2(n / sum(c.values())) for n in c.values())
    clean = L.vocabulary(L.token_rows(lines, clean=True))
    assert entropy.analyse(clean).first().entropy == pytest.approx(h(Counter(flat)), abs=1e-6)
    for parts in (1, 5):
        own = lines.repartition(parts)
        pairs = entropy.flat_pairs(own, T.clean_tokens(F.col("tokens")))
        got = entropy.conditional_entropy(pairs, clean).first()[0]
        assert got == pytest.approx(max(0, h(Counter(zip(flat, flat[1:], strict=False))) - h(Counter(flat))), abs=1e-9)
    f = np.log(sorted(Counter(flat).values(), reverse=True))
    slope, cut = np.polyfit(np.log(np.arange(1, len(f) + 1)), f, 1)
    fit = entropy.zipf_fit(clean).first()
    assert fit.alpha == pytest.approx(-slope, abs=1e-6)
    even = spark.createDataFrame([(c, 4) for c in "abcdefgh"], "token string, n bigint")
    assert entropy.analyse(even).first().entropy == 3 and tuple(entropy.zipf_fit(even).first()) == (8, 0.0, 0.0) and entropy.zipf_fit(even.limit(3)).first().alpha is None
    assert entropy.analyse(even.limit(0)).first().entropy == 0


def test_corpora_of_codes(spark, tmp_path, monkeypatch):
    """Built once for the same files and anew for others; documents beyond a million lines; codes that collide; bars within tokens; places that need decimals."""
    path = str(tmp_path / "documents.parquet")
    docs = [(7, "a|b c|d\na b {c} x", "en", "s"), (8, "\n" * 1_000_005 + "tail a", "de", "s"), (9, "c|d a\u2003b a|b c d", None, None), (None, "no id", "en", "s"), (10, None, "en", "s")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(path)
    one = encoded.of_documents(spark, path)
    assert encoded.of_documents(spark, path) is one and encoded.of_documents(spark, path, marked=True) is not one
    own = {r.line_ord: r.tokens for r in one.text.filter("folio IS NOT NULL").collect()}
    assert own == {70_000_000: ["a|b", "c|d"], 70_000_001: ["a", "b", "{c}", "x"], 81_000_005: ["tail", "a"], 90_000_000: ["c|d", "a", "b", "a|b", "c", "d"]}
    flat = [t.strip("{}") for k in sorted(own) for t in own[k]]
    pairs = Counter(f"{a}|{b}" for a, b in zip(flat, flat[1:], strict=False))
    coded = entropy.flat_pairs(one.lines(clean=True).filter("folio IS NOT NULL"), F.col("tokens"))
    barred = encoded.has_bar(F.col("a")) | encoded.has_bar(F.col("b"))
    joined = entropy.joined_pairs(coded, barred, lambda p: one.named(p, "a", "b", clean=True))
    assert sorted(r.n for r in joined.collect()) == sorted(pairs.values())
    words = {r.token: (r.n, r.first) for r in one.words.collect()}
    assert words["a"][0] == 3 and words["a|b"][1] < words["c|d"][1] < words["a"][1] < words["tail"][1] < words["d"][1]
    assert {r.token: r.n for r in one.clean_words.collect()} == Counter(t.strip("{}") for t in [*flat, "no", "id"])
    spark.createDataFrame(docs[:1], "doc_id bigint, text string, lang string, source string").write.mode("append").parquet(path)
    assert encoded.of_documents(spark, path).words.agg(F.sum("n")).first()[0] == len(flat) + 2 + 6
    # every token of one length gets one code until the second seed
    true = encoded.code_of
    monkeypatch.setattr(encoded, "code_of", lambda t, seed=0: true(F.when(F.lit(seed == 0), F.char_length(t).cast("string")).otherwise(t), seed))
    again = encoded.build(L.document_rows(spark.read.parquet(path)))
    assert again.seed == 1 and {r.token: r.n for r in again.words.collect()}["a"] == 4
    monkeypatch.setattr(encoded, "SEEDS", 1)
    with pytest.raises(ValueError, match="seed"):
        encoded.build(L.document_rows(spark.read.parquet(path)))
    far = spark.createDataFrame([(2**61, "f", "s", ["b", "a"], False), (-(2**61), "f", "s", ["a"], False)], "line_ord bigint, folio string, section string, tokens array<string>, has_uncertainty boolean")
    monkeypatch.undo()
    wide = encoded.build(far)
    assert "line_start" not in wide.text.columns and {r.token: r.n for r in wide.words.orderBy("first").collect()} == {"a": 2, "b": 1} and wide.words.orderBy("first").first().token == "a"


def test_reports_show_whole_alphabets(spark):
    letters = [chr(0x4E00 + k) for k in range(450)]
    found = reports.entropy_report(corpus(spark, [letters[k : k + 30] for k in range(0, 450, 30)]))
    assert sorted(r["character"] for r in found["characters"]["frequencies"]) == letters


def test_places_and_neighbours(rows, lines):
    first = Counter(r[0] for r in rows)
    total = Counter(t for r in rows for t in r)
    got = positional.edge_rates(L.token_rows(lines), k=5).collect()
    seen = list(dict.fromkeys(r[0] for r in rows))
    best = sorted(first, key=lambda t: (-first[t], seen.index(t)))[:5]
    assert [(r.token, r.at_edge, r.rate) for r in got] == [(t, first[t], round(first[t] / total[t], 4)) for t in best]
    pairs = Counter(p for r in rows for p in zip(r, r[1:], strict=False))
    assert {tuple(r.gram): r.n for r in ngrams.counted(lines, 2).collect()} == pairs
    kept = {p: n for p, n in pairs.items() if n >= 5}
    for r in ngrams.mutual_information(ngrams.counted(lines, 2), L.vocabulary(L.token_rows(lines))).collect():
        n = sum(total.values())
        assert r.pmi == pytest.approx(math.log2(kept[r.w1, r.w2] / sum(kept.values()) / (total[r.w1] * total[r.w2] / n**2)))


def plain_markov(train, test, k):
    seen, context = Counter(), Counter()
    vocabulary = {t for r in train for t in r}
    for r in train:
        for i in range(k, len(r)):
            seen[(*r[i - k : i], r[i])] += 1
            context[tuple(r[i - k : i])] += 1
    logs = [math.log2((seen[(*r[i - k : i], r[i])] + 1) / (context[tuple(r[i - k : i])] + len(vocabulary))) for r in test for i in range(k, len(r))]
    unknown = sum(r[i] not in vocabulary for r in test for i in range(k, len(r)))
    return 2 ** -np.mean(logs), len(logs), unknown, len(context)


def test_corpora_write_codes_once(spark, lines, monkeypatch):
    """Codes without braces are written for doubtful lines alone and read for all; intermediate tables are packed."""
    written, true = {}, encoded.stored

    def kept(df, name):
        written[name] = true(df, name)
        return written[name]

    monkeypatch.setattr(encoded, "stored", kept)
    built = encoded.build(lines)
    doubtful = lines.filter("has_uncertainty").count()
    assert 0 < doubtful < lines.count() == built.text.filter("size(clean_codes) = size(codes)").count()
    assert written["corpus-lines"].filter("clean_codes IS NOT NULL").count() == doubtful
    assert all(".zstd." in f for f in written["corpus-lines"].inputFiles())
    assert built.text.filter("has_uncertainty <> (codes <> clean_codes)").isEmpty()


def test_rules_read_what_they_need_once(spark, rows, lines, monkeypatch):
    """First-order models take no windows, edges count a row a line, and results are those of the long way."""
    long_way = {r.order: r for r in markov.analysis(lines, 2).collect()}
    monkeypatch.setattr(markov, "_windows", None)
    for orders in (0, 1):
        got = markov.analysis(lines, orders).collect()
        assert len(got) == orders + 1 and all(r == long_way[r.order] for r in got)
    for final in (False, True):
        edge = positional.edge_rows(lines, final)
        assert edge.count() == len(rows)
        totals = L.token_rows(lines).groupBy("token").agg(F.count("*").alias("total"))
        assert positional.edge_rates(edge, final, 7, totals).collect() == positional.edge_rates(L.token_rows(lines), final, 7).collect()
    # one pattern in each step, instead of one in every step that follows it
    plan = slots.validated(L.vocabulary(L.token_rows(lines)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 10


def test_fuzzy_compares_only_words_that_can_be_listed(spark, monkeypatch):
    """The words listed are those of comparing all; few are compared by blocks."""
    draw = random.Random(5)
    words = sorted({"".join(draw.choice("aeimrstü") for _ in range(draw.randrange(1, 9))) for _ in range(600)} | {"", "asia", "saia", "aaaa"})
    table = spark.createDataFrame([(w,) for w in words], "word string")
    asked = spark.createDataFrame([("ASIA",), ("mütter",), ("zzz",), ("",)], "query string")
    pairs = table.crossJoin(asked.select(F.lower("query").alias("query")))
    scored = pairs.select("*", lookup.similarity(F.col("word"), F.col("query")).alias("s"), lookup.most_similar(F.col("word"), F.col("query")).alias("m")).collect()
    assert all(r.s is None or r.s <= r.m for r in scored) and sum((r.m or 0) >= 0.7 for r in scored) < len(scored) / 2
    want = {q: sorted(((r.s, r.word) for r in scored if r["query"] == q and r.s is not None and r.s >= 0.3), reverse=True)[:5] for q in ("asia", "mütter", "zzz", "")}
    for first in (64, 1):
        monkeypatch.setattr(lookup, "FIRST", first)
        got = lookup.fuzzy(asked, table)
        assert {(r["query"], r["rank"], r.word) for r in got.collect()} == {(q, k + 1, w) for q, found in want.items() for k, (_, w) in enumerate(found)}


def test_random_tokens_of_any_alphabet(spark):
    """Draws with shared parts are the draws themselves; letters of one to four bytes keep their shares."""
    ids = np.array([0, 1, 5, 1 << 40])
    assert (draws.folded(draws.folded(7, ids), 3) / float(draws.PRIME) == draws.drawn(7, ids, 3)).all()
    x = [7]
    for part in (1 << 40, 3):
        x.append(pow(x[-1] * draws.FACTOR + part % draws.PRIME + 1, 5, draws.PRIME))
    assert int(draws.folded(7, ids, 3)[3]) == x[-1]
    letters = spark.createDataFrame([("a", 50), ("ü", 30), ("語", 15), ("😀", 5)], "token string, n bigint")
    made = {r.token: r.n for r in entropy.random_tokens(spark, letters, 3.0, 4000).collect()}
    share = Counter()
    for token, n in made.items():
        for c in token:
            share[c] += n
    assert sum(made.values()) == 4000 and set(share) == set("aü語😀") and abs(share["ü"] / sum(share.values()) - 0.3) < 0.02
    assert entropy.random_tokens(spark, letters.limit(0), 3.0, 5).count() == 0


def test_markov_deals_out_small_numbers(spark, lines, monkeypatch):
    """Frequent codes become small numbers, no two codes become one, and results stay, whichever tokens are taken as frequent."""
    top = np.array([1 << 40, -5, 77])
    codes = np.array([0, 1, 2, 3, 77, -5, 1 << 40, -1, 1 << 41])
    out = markov.shortened(codes, top)
    assert out.tolist() == [1 << 40, -5, 77, 3, 2, 1, 0, -1, 1 << 41] and (markov.shortened(out, top) == codes).all()
    assert (markov.shortened(codes, top[:0]) == codes).all()
    found = []
    for short, looked_at in ((1 << 16, 1), (3, 1), (1 << 16, 1 << 40)):
        monkeypatch.setattr(markov, "SHORT", short)
        monkeypatch.setattr(markov, "LOOKED_AT", looked_at)
        found.append(sorted(map(tuple, markov.analysis(lines).collect())))
    assert found[0] == found[1] == found[2]
    own = markov.coded(lines)
    monkeypatch.setattr(markov, "LOOKED_AT", 1)
    monkeypatch.setattr(markov, "SHORT", 1 << 16)
    cut, schema = markov._windows(4, markov.frequent(own))
    windows = own.select("tokens", F.lit(False).alias("held")).mapInArrow(cut, schema)
    assert windows.agg(F.max("w0"), F.max("w4")).first()[0] < own.select(F.explode("tokens").alias("t")).distinct().count()


def test_markov_windows_are_packed_and_counted_in_passes(spark, lines, monkeypatch):
    """Keys keep windows apart and those that begin alike together; results stay in several passes, and pairs are summed up where they lie."""
    draw = np.random.default_rng(1)
    odd = [0, 1, 0x7F, 0x80, 0x607F, 0x6080, 0xFFFF, 0x10000, 0x1F607F, 0x1F6080, 1 << 40, -1, -5, -(2**63), 2**63 - 1]
    size = draw.integers(1, 6, 3000)
    table = np.where(size[:, None] > np.arange(5), draw.choice(odd, (3000, 5)), 0)
    keys = markov.keys_of(table, size)
    got = markov.tokens_of(keys.slice(70), 5)
    assert (got[0] == table[70:]).all() and (got[1] == size[70:]).all()
    ordered = sorted(zip(keys.to_pylist(), size.tolist(), map(tuple, table.tolist()), strict=True))
    for level in range(1, 6):
        first = [w[:level] for _, n, w in ordered if n >= level]
        assert len(set(first)) == 1 + sum(a != b for a, b in itertools.pairwise(first))
    assert len(markov.keys_of(np.zeros((1, 5), np.int64), np.array([5]))[0].as_py()) == 5
    true, found = markov.stored, []
    for least, often in ((1 << 30, 0), (200, 0), (200, 10**6)):
        written = []
        monkeypatch.setattr(markov, "stored", lambda df, name, written=written: written.append(true(df, name)) or written[-1])
        monkeypatch.setattr(markov, "PASS_TOKENS", least)
        monkeypatch.setattr(markov, "OFTEN", often)
        monkeypatch.setattr(markov, "LOOKED_AT", 1)
        found.append(sorted(map(tuple, markov.analysis(lines).collect())))
        assert (len(written) > 3) == (least == 200)
        pairs = sum(w.filter(F.col("kind") == markov.PAIRS).count() for w in written if "kind" in w.columns)
        assert (pairs > 0) == (often > 0)
    assert found[0] == found[1] == found[2]


def test_shuffle_files_go_with_the_write_that_needed_them(spark):
    def files():
        return {f for f in spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString(" ").split() if "shuffle_" in f}

    setting = spark.conf.get(shared.CLEANED, None)
    seen = files()
    few = shared.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "few")
    for _ in range(50):  # they are removed in the background
        if not files() - seen:
            break
        time.sleep(0.2)
    assert not files() - seen and spark.conf.get(shared.CLEANED, None) == setting
    own = few.groupBy("n").agg(F.count("*").alias("k"))
    assert own.count() == 2 and len(own.collect()) == len(own.collect()) == 2


def test_markov(lines, rows):
    held = markov.split_lines(lines)
    test = {r.line_ord for r in lines.filter(held).collect()}
    assert len(test) == 24 and test == {r.line_ord for r in lines.repartition(7).filter(held).collect()}
    train, asked = [r for k, r in enumerate(rows) if k not in test], [r for k, r in enumerate(rows) if k in test]
    found = markov.analysis(lines)
    got = {r.order: r for r in found.collect()}
    for k in range(5):
        pp, n, unknown, contexts = plain_markov(train, asked, k)
        own, n_own, _, _ = plain_markov(train, train, k)
        r = got[k]
        assert (r.n_tokens, r.n_unknown, r.n_contexts, r.n_train_tokens, r.honest) == (n, unknown, contexts, n_own, True)
        assert r.perplexity == pytest.approx(pp, abs=1e-3) and r.train_perplexity == pytest.approx(own, abs=1e-3)
        if k:
            assert r.reduction == pytest.approx((got[k - 1].perplexity - r.perplexity) / got[k - 1].perplexity, abs=1e-6)
    best = markov.optimal(found).first()
    assert best.by_test == min(range(5), key=lambda k: got[k].perplexity) and best.by_train == min(range(5), key=lambda k: got[k].train_perplexity)
    few = markov.analysis(lines.filter("line_ord < 9"), orders=1).collect()
    assert all(not r.honest and r.perplexity == r.train_perplexity and r.n_tokens == r.n_train_tokens for r in few)
    assert reports.markov_report(lines.filter("line_ord < 9"), 1)["split"]["warning"]


def test_order_helpers(spark):
    frame = spark.createDataFrame([(3 * k, f"v{k}") for k in range(100)], "k bigint, v string").repartition(6)
    got = {r.k: r.following for r in order.with_next(frame, "k", "v", 7).collect()}
    assert got == {3 * k: f"v{k + 1}" if k < 99 else None for k in range(100)}
    same = spark.createDataFrame([(7, k / 300) for k in range(300)] + [(k, 0.5) for k in range(8, 40)], "k bigint, t double")
    dealt = order.numbered_ranges(same, "k", 10, F.col("t")).collect()
    by = sorted(dealt, key=lambda r: (r.k, r.t))
    assert [r._part for r in by] == sorted(r._part for r in by) and len({r._part for r in by if r.k == 7}) > 5 and max(r._part for r in by) < 10


def test_draws_agree(spark):
    import duckdb

    keys = [(k, k * k * 12345 - 7) for k in range(300)]
    mine = draws.drawn(42, np.array([a for a, _ in keys]), np.array([b for _, b in keys]), 3)
    sparks = [r[0] for r in spark.createDataFrame(keys, "a bigint, b bigint").select(draws.draw(42, F.col("a"), F.col("b"), F.lit(3))).collect()]
    table = ", ".join(f"({a}, {b})" for a, b in keys)
    sqls = [r[0] for r in duckdb.sql(f"SELECT {draws.draw_sql(42, 'a', 'b', '3')} FROM (VALUES {table}) t(a, b)").fetchall()]
    assert mine.tolist() == sparks == sqls and abs(mine.mean() - 0.5) < 0.06
    many = draws.drawn(1, np.repeat(np.arange(200), 200), np.tile(np.arange(200), 200))
    assert np.abs(np.histogram(many, 20)[0] - 2000).max() < 250
    weights = draws.poisson_weights(42, np.arange(4000), np.arange(200))
    share = np.bincount(weights.ravel(), minlength=6)[:6] / weights.size
    assert np.abs(share - [math.exp(-1) / math.factorial(k) for k in range(6)]).max() < 0.003
    assert np.abs(np.corrcoef(weights[:, :40].T) - np.eye(40)).max() < 0.08 and np.abs(np.corrcoef(weights[:40]) - np.eye(40)).max() < 0.3


def test_slots_over_a_corpus(spark, rows, lines):
    checked = slots.validated(L.vocabulary(L.token_rows(lines)))
    flat = [t for r in rows for t in r]
    good = sum(plain_slots(t)[0] for t in flat)
    one = slots.coverage(checked).first()
    assert (one.n_tokens, one.n_valid) == (len(flat), good) and one.supported == (good / len(flat) >= 0.7)
    assert sum(r.n for r in slots.failures(checked).collect()) == len(flat) - good
    assert slots.coverage(checked.limit(0)).first().coverage == 0


def plain_draws(keys, resamples, seed):
    """Weights of lines (a row for each, by its key) by the definition: whole streams, and draws added one by one."""
    n, out, stream = len(keys), [], 0
    by_number = np.argsort(keys)
    while len(out) < resamples:
        w = draws.poisson_weights(seed, np.array(keys), np.array([stream]), draws.mean_weight(n))[:, 0].astype(int)
        if w.sum() <= n:
            for place in draws.added_places(seed, stream, 0, n - w.sum(), n).tolist():
                w[by_number[place]] += 1
            out.append(w)
        stream += 1
    return np.array(out).T


def test_draws_with_replacement(spark, lines, monkeypatch):
    """Exactly n draws in every resample, however lines are partitioned and numbered; all lines as likely as each other."""
    def found(df, resamples, seed):
        d, own = inference.drawn_lines(df, resamples, seed)
        table = own.select("line_ord", "added").toArrow().combine_chunks()
        keys = table.column("line_ord").to_numpy()
        order = np.argsort(keys)
        added = table.column("added").combine_chunks()
        return keys[order], d.weights(keys, added)[order]

    monkeypatch.setattr(inference, "CHUNK", 7)
    for n in (1, 2, 9, 10, 57, 400):
        some = spark.range(n).select((F.col("id") * 37 % 1009 - 500).alias("line_ord"))
        keys, weights = found(some.repartition(5), 300, 4)
        assert len(keys) == n and weights.shape == (n, 300) and (weights.sum(axis=0) == n).all()
        assert (weights == plain_draws(np.sort(keys), 300, 4)).all()
    assert (found(some.coalesce(1), 300, 4)[1] == weights).all()
    share = np.bincount(weights.ravel(), minlength=6)[:5] / weights.size  # binomial of 400 draws with a chance of 1 in 400
    assert np.abs(share - [math.comb(400, k) * (1 / 400) ** k * (399 / 400) ** (400 - k) for k in range(5)]).max() < 0.006
    assert np.abs(weights.mean(axis=1) - 1).max() < 5 / math.sqrt(300)
    a, b = weights[:200].sum(axis=0), weights[200:].sum(axis=0)  # halves share n draws: each has a variance of n / 4
    assert (a + b == 400).all() and 60 < a.var() < 145
    twice = found(some.union(some), 300, 4)  # rows of one number are drawn together
    assert (twice[1][::2] == weights).all() and (twice[1][1::2] == weights).all()
    assert len(found(some.limit(0), 30, 4)[0]) == 0


def test_bootstrap_by_definition(spark, rows, lines, monkeypatch):
    """Every resample's vocabulary, from the same weights, in plain counters."""
    clean = [[t.replace("{", "").replace("}", "") for t in r] for r in rows]
    for heavy, cells in ((256, 4_000_000), (3, 1000)):
        monkeypatch.setattr(inference, "HEAVY", heavy)
        monkeypatch.setattr(inference, "HELD", heavy // 3)
        monkeypatch.setattr(inference, "CELLS", cells)
        weights = plain_draws(np.arange(len(rows)), 50, 9)
        entropies, slopes, rates = [], [], []
        for rep in range(50):
            c = Counter()
            for w, r in zip(weights[:, rep].tolist(), clean, strict=True):
                for t in r:
                    c[t] += w
            n = np.array([x for x in c.values() if x], float)
            entropies.append(-np.sum(n / n.sum() * np.log2(n / n.sum())))
            slopes.append(-np.polyfit(np.log(np.arange(1, len(n) + 1)), np.log(np.sort(n)[::-1]), 1)[0])
            total = sum(w * r.count("ol") for w, r in zip(weights[:, rep].tolist(), clean, strict=True))
            rates.append(sum(w * (r[0] == "ol") for w, r in zip(weights[:, rep].tolist(), clean, strict=True)) / total)
        for values, found in ((entropies, inference.bootstrap(lines, inference.ENTROPY, 50, seed=9)), (slopes, inference.bootstrap(lines, inference.ZIPF, 50, seed=9)), (rates, inference.bootstrap_initial_rate(lines, "ol", 50, seed=9))):
            one = found.first()
            assert (one.low, one.high) == pytest.approx(tuple(np.percentile(values, [2.5, 97.5])), abs=2e-6) and one.resamples == 50
    assert inference.bootstrap(lines, inference.ENTROPY, 50).first().point == entropy.analyse(L.vocabulary(L.token_rows(lines, clean=True))).first().entropy
    assert tuple(inference.bootstrap(lines, inference.ENTROPY, 40).first()) == tuple(inference.bootstrap(lines.repartition(7), inference.ENTROPY, 40).first())


def test_additional_draws_are_never_broadcast(spark, lines):
    """They grow with the square root of the lines times the resamples, which no estimate made before they are drawn says."""
    _, own = inference.drawn_lines(lines.select("line_ord"), 40, 3)
    assert len(own._jdf.collectAsList()) == lines.count()
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [place#" in plan and "BroadcastHashJoin [place#" not in plan


def test_sums_of_a_bootstrap_stay_small(monkeypatch):
    """Sums over groups of any size, beyond 16 bits too; a task gives a row for each resample and frequency, however many blocks of counts it sees."""
    draw = np.random.default_rng(3)
    weights = draw.integers(0, 4, (50, 7)).astype(np.uint16)
    for most in (3, 60_000):
        weights[5, 2] = most
        sizes = np.array([1, 700, 2, 64, 65, 1])
        rows = draw.integers(0, 50, sizes.sum())
        plain = np.add.reduceat(weights[rows].astype(np.int64), np.cumsum(sizes) - sizes, axis=0)
        assert (inference.sums_of_groups(weights, rows, sizes) == plain).all()
    big = np.array([1, 1 << 33])
    assert (inference._unpacked(inference._packed(big), 2) == big).all() and len(inference._packed(big[:1])) == 4
    monkeypatch.setattr(inference, "SMALL", 5)
    parts, counts = inference.ZIPF.parts(3), draw.integers(0, 9, (40, 3))
    found = Counter()
    given = [b for _ in range(20) for b in parts.add(counts)] + list(parts.close())
    assert given[-1].num_rows == len({(r, n) for row in counts.tolist() for r, n in enumerate(row) if 0 < n < 5})
    for b in given:
        for rep, n, types in zip(*(b.column(c).to_pylist() for c in ("rep", "n", "types")), strict=True):
            found[rep, n] += types
    assert found == Counter((r, n) for row in counts.tolist() * 20 for r, n in enumerate(row) if n)
    parts = inference.ENTROPY.parts(3)
    assert not [b for _ in range(20) for b in parts.add(counts)] and [b.num_rows for b in parts.close()] == [3]


def test_bootstrap_of_a_statistic_of_ones_own(spark, rows, lines, monkeypatch):
    """The mean length of lines and the share of repeated neighbours, merged in several levels, against weighted sums."""
    monkeypatch.setattr(inference, "FAN", 2)
    monkeypatch.setattr(inference, "CELLS", 400)
    weights = plain_draws(np.arange(len(rows)), 40, 3)
    sizes, same = np.array([len(r) for r in rows]), np.array([sum(a == b for a, b in zip(r, r[1:], strict=False)) for r in rows])
    mean = inference.Mergeable({"size": F.size("tokens").cast("double")}, lambda b, w: np.stack([b.column("size").to_numpy() @ w, w.sum(axis=0)], axis=1), lambda s: s[:, 0] / np.where(s[:, 1] > 0, s[:, 1], np.nan))
    repeated = inference.Mergeable(
        {"tokens": F.col("tokens")},
        lambda b, w: np.stack([np.array([sum(x == y for x, y in zip(t, t[1:], strict=False)) for t in b.column("tokens").to_pylist()]) @ w, np.array([len(t) for t in b.column("tokens").to_pylist()]) @ w], axis=1),
        lambda s: s[:, 0] / s[:, 1],
    )
    for statistic, values, point in ((mean, sizes @ weights / weights.sum(axis=0), sizes.mean()), (repeated, same @ weights / (sizes @ weights), same.sum() / sizes.sum())):
        for parts in (1, 9):
            one = inference.bootstrap_of(lines.repartition(parts), statistic, 40, seed=3).first()
            assert (one.low, one.high, one.point) == pytest.approx((*np.percentile(values, [2.5, 97.5]), point), abs=2e-6) and one.resamples == 40
    none = inference.bootstrap_of(lines.limit(0), mean, 40).first()
    assert none.point is None and none.low is None and none.resamples == 0


def test_permutations_of_places(spark, rows, lines):
    sizes = np.repeat(np.arange(1, 40), np.arange(1, 40))
    places = np.concatenate([np.arange(n) for n in range(1, 40)])
    moved = inference.permuted(7, sizes, sizes, places, 200)
    for n in range(1, 40):  # each permutation is a bijection
        assert (np.sort(moved[sizes == n], axis=0) == np.arange(n)[:, None]).all()
    many = inference.permuted(7, np.arange(4000), np.full(4000, 5), np.full(4000, 2), 20)
    assert np.abs(np.bincount(many.ravel(), minlength=5) / many.size - 0.2).max() < 0.01
    own = L.token_rows(lines, clean=True)
    binomial = inference.permutation_test(own, "ol", 2000).first()
    placed = inference.place_tests(own, ["ol", "absent"], inference.PLACES["first"], 2000).collect()
    assert len(placed) == 1 and placed[0].observed_rate == binomial.observed_rate and placed[0].total == binomial.total
    assert placed[0].null_mean == pytest.approx(binomial.null_mean, abs=0.01) and placed[0].null_std == pytest.approx(binomial.null_std, abs=0.006) and placed[0].p_value == pytest.approx(binomial.p_value, abs=0.05)
    clean = [[t.replace("{", "").replace("}", "") for t in r] for r in rows]
    draw = random.Random(5)
    for name in ("last", "mean"):
        score = inference.PLACES[name]
        total = sum(r.count("ol") for r in clean)
        null = []
        for _ in range(600):
            null.append(sum(float(score(p, len(r))) for r in clean for p in draw.sample(range(len(r)), r.count("ol"))) / total)
        one = inference.place_tests(own.repartition(5), ["ol"], score, 600, 9).first()
        observed = sum(float(score(p, len(r))) for r in clean for p, t in enumerate(r) if t == "ol") / total
        assert one.observed_rate == round(observed, 4) and one.null_mean == pytest.approx(np.mean(null), abs=0.01) and one.null_std == pytest.approx(np.std(null), abs=0.006)
        assert one.p_value == pytest.approx(np.mean(np.array(null) >= observed), abs=0.08)


def test_sums_of_logarithms(monkeypatch):
    n = np.array([0, 1, 5, 999, 1000, 1001, 50_000])
    tables = inference._log_tables(1000)
    monkeypatch.setattr(inference, "_log_tables", lambda: tables)
    logs = np.log(np.arange(1, 50_001))
    one, two = inference.log_sums(n)
    assert one == pytest.approx([logs[:k].sum() for k in n], rel=1e-9) and two == pytest.approx([(logs[:k] ** 2).sum() for k in n], rel=1e-8)


def test_permutations(spark, rows, lines):
    own = L.token_rows(lines, clean=True)
    p = inference.permutation_test(own, "ol", 2000).first()
    clean = [[t.replace("{", "").replace("}", "") for t in r] for r in rows]
    draw, shares = random.Random(4), [(r.count("ol"), len(r)) for r in clean if "ol" in r]
    sums = [sum(draw.random() < k / n for k, n in shares) for _ in range(4000)]
    total, observed = sum(k for k, _ in shares), sum(r[0] == "ol" for r in clean)
    assert (p.total, p.observed, p.observed_rate) == (total, observed, round(observed / total, 4))
    assert p.null_mean == pytest.approx(np.mean(sums) / total, abs=0.01) and p.null_std == pytest.approx(np.std(sums) / total, abs=0.006)
    assert p.p_value == pytest.approx(np.mean(np.array(sums) >= observed), abs=0.05)
    with pytest.raises(ValueError, match="no token"):
        inference.permutation_test(own, "absent")
    assert inference.permutation_tests(own, [], 10).collect() == []
    u = np.random.default_rng(1).random(4000)
    for m, q in ((1, 0.5), (40, 0.1), (10**6, 0.3)):
        x = inference.binomial_quantiles(m, q, u)
        assert abs(x.mean() - m * q) < 4 * math.sqrt(m * q * (1 - q) / 4000) and 0 <= x.min() and x.max() <= m
    assert inference.binomial_quantiles(7, 1.0, u).tolist() == [7] * 4000


def test_chi_square(spark):
    assert inference.upper_gamma(1.0, 2.0) == pytest.approx(math.exp(-2)) and inference.upper_gamma(0.5, 0.5) == pytest.approx(math.erfc(math.sqrt(0.5)))
    # tabulated values of the distribution: the statistic that is exceeded with a probability of 0.05 and 0.01
    for df, five, one in ((1, 3.841, 6.635), (4, 9.488, 13.277), (10, 18.307, 23.209), (30, 43.773, 50.892), (100, 124.342, 135.807)):
        assert inference.upper_gamma(df / 2, five / 2) == pytest.approx(0.05, abs=1e-4) and inference.upper_gamma(df / 2, one / 2) == pytest.approx(0.01, abs=1e-4)
    draw = np.random.default_rng(7)
    counts = {"herbal": [30, 20, 10, 5, 3], "recipes": [5, 25, 18, 2, 2], "biological": [8, 6, 4, 3, 2], "unknown": [9, 9, 9, 9, 9], "cosmological": [60, 0, 0, 0, 0]}
    rows = [(s, f"t{k}") for s, ns in counts.items() for k, n in enumerate(ns) for _ in range(n)]
    draw.shuffle(rows)
    frame = spark.createDataFrame([tuple(map(str, r)) for r in rows], "section string, token string")
    total, columns = sum(map(sum, counts.values())), np.sum(list(counts.values()), axis=0)

    def statistic(s, least):
        n = np.array(counts[s])
        e = n.sum() * columns / total
        return sum((a - b) ** 2 / b for a, b in zip(n, e, strict=True) if a and b > least)

    known = ["herbal", "recipes", "biological", "cosmological", "absent"]
    got = {r.section: r for r in inference.significance(inference.chi_square(frame, known)).collect()}
    assert got["herbal"].chi_square == pytest.approx(statistic("herbal", 0.5), abs=1e-4) and got["herbal"].df == 4
    assert got["biological"].status == "INSUFFICIENT_DATA" and got["cosmological"].status == "INSUFFICIENT_OVERLAP" and got["cosmological"].significant is None
    bar, n = 0.05 / 4, 0
    for s in known[:4]:
        df = sum(x > 0 for x in counts[s]) - 1
        p = inference.upper_gamma(df / 2, statistic(s, 0) / 2) if sum(counts[s]) >= 50 and df > 0 else 1.0
        n += round(p, 6) < bar
    assert inference.rule_significance(frame, known).first().n_significant == n >= 1


def test_keywords(spark, monkeypatch):
    """Automaton and gram join against looking for every keyword in every text."""
    draw = random.Random(14)
    letters = "aab\u00e9\U0001f600 "
    word = lambda least, most: "".join(draw.choice(letters) for _ in range(draw.randint(least, most)))
    texts = [(k % 90, word(0, 60).upper() if k % 3 else word(0, 60)) for k in range(120)] + [(1, None), (1, None), (2, word(3000, 3000)), (3, "")]
    for empty in (False, True):
        keys = [(k, word(1, 7), f"a{k}") for k in range(300)] + [(None, "a", "x"), (5, None, "x"), (7, "zzz", "twice")] + ([(250, "", "all")] if empty else [])
        asked = spark.createDataFrame(texts, "id bigint, query string").withColumn("key", F.lit("clash")).repartition(3)
        table = spark.createDataFrame(keys, "key_order int, key string, answer string")
        own = {}
        for o, k, a in sorted((r for r in keys if r[0] is not None and r[1] is not None), key=lambda r: (r[0], r[1].encode(), r[2])):
            own.setdefault(o, (k, a))
        want = sorted(str((i, t, *next(((k, a) for _, (k, a) in sorted(own.items()) if t is not None and k in t.lower()), (None, None)))) for i, t in texts)
        for most in (10_000, 0):
            monkeypatch.setattr(keywords, "MOST_KEYWORDS", most)
            found = keywords.first_keywords(asked, table).select("id", "query", "key", "answer").collect()
            assert sorted(str(tuple(r)) for r in found) == want
    assert [r.key for r in keywords.first_keywords(asked.limit(2), table.limit(0)).collect()] == [None, None] and keywords.first_keywords(asked.limit(0), table).collect() == []


def test_graph_and_lookups(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "y"), ("b", "a")], "src string, dst string")
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    assert tuple(graph.metrics(edges).first()) == (5, 4, 0.4)
    assert dict(graph.components(edges).collect()) == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    words = spark.createDataFrame([("apple",), ("apply",), ("maple",), ("zebra",)], "word string")
    got = [(r.word, r.rank) for r in lookup.fuzzy(spark.createDataFrame([(" Appl ",)], "query string"), words, 2).orderBy("rank").collect()]
    assert got == [("apply", 1), ("apple", 2)]
    from difflib import SequenceMatcher

    draw = random.Random(6)
    some = sorted({"".join(draw.choice("abcde") for _ in range(draw.randrange(1, 9))) for _ in range(300)})
    for q in ("abcab", "e", "dcbaedcb"):
        scored = sorted(((SequenceMatcher(None, w, q).ratio(), w) for w in some), reverse=True)
        want = [(w, round(SequenceMatcher(None, q, w).ratio(), 3)) for s, w in scored if s >= 0.3][:5]
        frame = spark.createDataFrame([(w,) for w in some], "word string")
        found = lookup.fuzzy(spark.createDataFrame([(q,)], "query string"), frame).orderBy("rank").collect()
        assert [(r.word, r.similarity) for r in found] == want
    words = ["", "a", "ab", "aab", "\U0001F600é", "éa\U0001F600", "abab" * 9, "ba" * 20, *some[:40]]
    both = spark.createDataFrame([(a, b) for a in words for b in words] + [(None, "a"), ("a", None)], "a string, b string")
    for r in both.withColumn("s", lookup.similarity(F.col("a"), F.col("b"))).collect():
        if r.a is None or r.b is None or r.a == r.b == "":
            assert r.s is None
        else:
            assert r.s == pytest.approx(SequenceMatcher(None, r.a, r.b).ratio(), abs=1e-12), (r.a, r.b)
    keys = spark.createDataFrame([(1, "slot", "A"), (0, "graph", "B")], "key_order int, key string, answer string")
    asked = spark.createDataFrame([(1, "The GRAPH of slots"), (2, "nothing"), (3, "slot")], "id int, query string")
    assert {r.id: r.answer for r in lookup.dispatch(asked, keys).collect()} == {1: "B", 2: None, 3: "A"}
    twice = asked.union(asked.select("id", F.lit("slot").alias("query")))
    for most in (10_000, 1):
        monkeypatch.setattr(keywords, "MOST_KEYWORDS", most)
        assert sorted(map(str, lookup.dispatch(twice, keys).collect())) == sorted(map(str, [Row(id=1, key="graph", answer="B"), Row(id=2, key=None, answer=None), Row(id=3, key="slot", answer="A"), *[Row(id=k, key="slot", answer="A") for k in (1, 2, 3)]]))
    assert lookup.exact(spark.createDataFrame([(" SLOT ",)], "query string"), keys).first().answer == "A"


def test_components_against_union_find(spark, rows, monkeypatch):
    draw = random.Random(3)
    edges = [(f"n{draw.randrange(400)}", f"n{draw.randrange(400)}") for _ in range(260)] + [("hub", f"n{k}") for k in range(0, 400, 3)]
    group = {v: v for e in edges for v in e}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        group[max(x, y)] = min(x, y)
    want = {v: root(v) for v in group if any(v in e and e[0] != e[1] for e in edges)}
    for parts in (1, 7):
        assert dict(graph.components(spark.createDataFrame(edges, "src string, dst string").repartition(parts)).collect()) == want
    # a long path whose numbers jump about, small blocks, so that contraction alone does not do it
    monkeypatch.setattr(graph, "BLOCK", 16)
    names = list(range(3000))
    draw.shuffle(names)
    path = spark.createDataFrame([(a, b) for a, b in zip(names, names[1:], strict=False)], "src bigint, dst bigint").repartition(9)
    assert {tuple(r) for r in graph.components(path).collect()} == {(k, 0) for k in names}
    assert graph.components(path.limit(0)).collect() == []


def test_contraction_holds_few_links(monkeypatch):
    """However many links a task gets, what it holds at once is bounded; no link is lost."""
    held, true = [], graph.roots
    monkeypatch.setattr(graph, "roots", lambda n, a, b: (held.append(len(a)), true(n, a, b))[1])
    batch = lambda k: pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + 10_000) * 2 + 1), pa.array(np.arange(k, k + 10_000) * 2)], ["u", "v"])
    out = list(graph._contract(batch(k * 10_000) for k in range(60)))
    assert sum(held) == sum(b.num_rows for b in out) == 600_000 and max(held) < 280_000


def test_roots():
    draw = np.random.default_rng(8)
    for n in (1, 2, 50):
        for _ in range(30):
            m = int(draw.integers(0, 2 * n))
            a, b = draw.integers(0, n, m), draw.integers(0, n, m)
            parent = list(range(n))
            for _ in range(n):
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    parent[x] = parent[y] = min(parent[x], parent[y])
            assert graph.roots(n, a, b).tolist() == parent


def test_rules(spark):
    base = {m: 0.0 for _, _, m, _ in rules.RULES} | {"baseline_entropy": 9.0, "most_usage": 0.0, "perplexity_0": 5.0}
    good = base | {"coverage": 0.8, "entropy": 8.0, "alpha": 1.0, "r_squared": 0.9, "n_biased": 5.0, "perplexity_1": 4.0, "perplexity_saved": 0.2, "n_significant": 2.0}
    def verdict(values):
        frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} double" for k in values))
        return rules.overall(rules.evaluate(frame)).first().verdict
    assert verdict(good) == "SUPPORTED" and verdict(good | {"coverage": 0.6}) == "NOT_SUPPORTED"
    assert verdict(good | {"n_biased": 1.0, "alpha": 3.0}) == "CONDITIONAL" and verdict(good | {"n_biased": None}) == "INCONCLUSIVE"


def test_command_line(spark, tmp_path, rows):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.vtt").write_text("".join(f"<f{k % 9 + 1}r.P.{k};H> {' '.join(r)}\n" for k, r in enumerate(rows)))
    path = str(tmp_path / "corpus.json")
    assert cli.main(["ingest", str(tmp_path / "in"), "--output", path], spark) == 0
    assert len(json.loads((tmp_path / "corpus.json").read_text())["records"]) == 120
    assert [r.tokens for r in exchange.read_corpus(spark, path).orderBy("line_ord").collect()] == rows
    folder = str(tmp_path / "corpus")
    assert cli.main(["ingest", str(tmp_path / "in"), "--output", folder, "--version", "v1"], spark) == 0
    assert [r.tokens for r in spark.read.parquet(folder).orderBy("line_ord").collect()] == rows

    def report(command, *options):
        assert cli.main([command, path, "--output", str(tmp_path / "r.json"), *options], spark) == 0
        return json.loads((tmp_path / "r.json").read_text())

    found = report("markov", "--orders", "1")
    assert len(found["markov"]) == 2 and found["optimal_order_by_test"] in (0, 1) and found["split"]["honest"]
    found = report("entropy", "--clean", "--label", "x")
    assert found["label"] == "x" and found["baseline"]["delta_bits"] == round(found["baseline"]["entropy"] - found["entropy"]["entropy"], 4) and found["characters"]["frequencies"] and found["zipf"]["rank_frequency"]
    found = report("positional", "--top-n", "4")
    assert len(found["line_initial"]) == len(found["line_final"]) == 4 and found["sections"] and found["word_places"] and found["character_places"] and set(found["biased"]) == {"line_initial", "line_final"}
    found = report("adjacency", "--top-n", "3", "--min-pmi-count", "2")
    assert len(found["bigrams"]) == len(found["trigrams"]) == 3 and found["n_pair_types"] <= found["n_bigrams"] and {"pmi_top", "pmi_low"} <= set(found)
    found = report("slots", "--tokens", str(tmp_path / "tokens"))
    assert found["n_tokens"] == sum(map(len, rows)) and found["failures"] and found["invalid_top"] and found["sections"] and spark.read.csv(str(tmp_path / "tokens"), header=True).count() > 5
    found = report("significance", "--resamples", "30", "--seed", "5")
    assert {"entropy", "zipf_alpha"} == set(found["intervals"]) and found["sections"] and all(0 <= p["p_value"] <= 1 for p in found["permutations"])
    found = report("falsify", "--rules", str(tmp_path / "rules"))
    assert sorted(r.rule for r in spark.read.csv(str(tmp_path / "rules"), header=True).collect()) == sorted(r[0] for r in rules.RULES)
    assert len(found["rules"]) == len(rules.RULES) and found["summary"].startswith(found["overall"]["verdict"])
    assert cli.main(["pipeline", folder, "--output", str(tmp_path / "runs"), "--resamples", "20", "--run-id", "one"], spark) == 0
    assert cli.main(["report", str(tmp_path / "runs"), "--output", str(tmp_path / "r.md")]) == 0 and "## Hypotheses" in (tmp_path / "r.md").read_text() and (tmp_path / "runs/run_one.json").exists()
    assert cli.main(["preregister", "--output", str(tmp_path / "p.json"), "--version", "v1"]) == 0
    plan = json.loads((tmp_path / "p.json").read_text())
    assert len(plan["secondary_tests"]) == len(rules.RULES) - 1 and plan["analysis_plan"] and plan["exclusions"] and plan["deviations"] == []
    assert cli.main(["report", str(tmp_path / "in"), "--output", str(tmp_path / "r.md")]) == 2
    assert analysis.markdown({}) and sinks.finite({"a": [float("inf"), 1.0]}) == {"a": [None, 1.0]}


def test_stream(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:01:00", "a b a"), ("2024-01-01 00:07:00", "a")], "ts string, text string").select(F.to_timestamp("ts").alias("ts"), "text").write.parquet(str(tmp_path / "in"))
    stream = counts.windowed_counts(spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((str(r.start), r.token, r.n) for r in spark.table("counted").collect()) == [("2024-01-01 00:00:00", "a", 2), ("2024-01-01 00:00:00", "b", 1), ("2024-01-01 00:05:00", "a", 1)]


def test_running_statistics(spark, tmp_path, monkeypatch):
    """What a stream keeps equals the batch after every file, however rows are split, also when it is started again."""
    monkeypatch.setattr(statistics, "BUCKETS", 5)
    before = spark.conf.get(statistics.STORE[0])
    statistics.prepared(spark)
    draw = random.Random(21)
    texts = [" ".join(f"w{min(draw.randrange(60), draw.randrange(60))}" for _ in range(draw.randrange(0, 12))) for _ in range(90)] + [None, "", "  "]
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    seen: list = []
    try:
        for k, size in enumerate((1, 40, 0, 52)):
            part, texts = texts[:size], texts[size:]
            seen += part
            if part:
                spark.createDataFrame([(t,) for t in part], "text string").coalesce(1).write.mode("append").parquet(source)
            # each round starts the stream anew from its checkpoint
            stream = statistics.running_counts(spark.readStream.schema("text string").parquet(source))
            q = stream.writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(sink)).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            q.awaitTermination()
            rows = spark.read.schema(statistics.ROW).parquet(sink)
            count = Counter(t for x in seen if x for t in x.split())
            total = sum(count.values())
            h = -sum(n / total * math.log2(n / total) for n in count.values()) if total else 0
            one = statistics.statistics(rows).first()
            assert (one.n_tokens, one.n_types) == (total, len(count)) and one.entropy == pytest.approx(h, abs=1e-5)
            assert [tuple(r) for r in statistics.top_tokens(rows).collect()] == sorted(count.items(), key=lambda e: (-e[1], e[0]))[: statistics.TOP]
    finally:
        spark.conf.set(statistics.STORE[0], before)
    assert tuple(statistics.statistics(rows.limit(0)).first()) == (0, 0, 0.0)


def test_image_headers(spark, tmp_path):
    import struct
    import zlib

    def png(w, h, depth, kind):
        chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, 0)) + chunk(b"IEND", b"")

    def jpeg(w, h, parts, marker=0xC0, segments=(), fill=0):
        out = b"\xff\xd8" + b"".join(b"\xff" + bytes([m]) + struct.pack(">H", len(b) + 2) + b for m, b in segments)
        return out + b"\xff" * fill + b"\xff" + bytes([marker]) + struct.pack(">HBHHB", 8 + 3 * parts, 8, h, w, parts) + b"\x00" * 3 * parts + b"\xff\xd9"

    files = {
        "a.png": (png(640, 480, 8, 2), (640, 480, "RGB", 1.33)), "b.png": (png(3, 70000, 1, 0), (3, 70000, "1", 0.0)), "c.png": (png(5, 5, 16, 0), (5, 5, "I;16", 1.0)), "d.png": (png(9, 2, 8, 6), (9, 2, "RGBA", 4.5)),
        "e.jpg": (jpeg(800, 600, 3, segments=[(0xE0, b"JFIF"), (0xFE, b"\xff\xc0" * 40)]), (800, 600, "RGB", 1.33)), "f.jpeg": (jpeg(7, 9, 1, 0xC2, fill=3), (7, 9, "L", 0.78)),
        "g.JPG": (jpeg(10, 20, 4, segments=[(0xE1, bytes(60000))] * 3 + [(0xC4, b"table")] * 200), (10, 20, "CMYK", 0.5)),
        "h.png": (png(1, 1, 8, 2)[:20], None), "i.jpg": (b"\xff\xd8\xff\xe0\x00\x10", None), "j.jpg": (b"\xff", None), "k.png": (b"GIF89a" + bytes(40), None), "l.jpg": (b"\xff\xd8\xff\xda\x00\x04ab" + jpeg(1, 1, 3), None), "m.png": (png(0, 4, 8, 2), None),
    }
    for name, (body, _) in files.items():
        (tmp_path / name).write_bytes(body)
    found = {r.path.rsplit("/", 1)[1]: r for r in images.read_images(spark, str(tmp_path), 50).collect()}
    assert found.keys() == files.keys()
    for name, (_, want) in files.items():
        r = found[name]
        assert (want and (r.width, r.height, r.mode, r.aspect)) == want if want else r.width is None and r.aspect is None, name
        assert r.zoom_width == (want[0] // 2 if want else None)
