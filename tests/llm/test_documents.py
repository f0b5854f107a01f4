"""The operators on documents against plain versions, on a table of odd cases."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline
from quillstone.llm import components, language_id, license_scan, mixing, near_dedup, order_minhash, pieces, private_data, registry, substrings
from tests.llm.conftest import prose


def pairs(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]


# -- near-duplicates ------------------------------------------------------------

def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def plain_groups(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
                group[root(a)] = root(b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[root(k)] = min(i, ids.get(root(k), i))
    return sorted(((i, len(s), ids.get(root(k)), i == ids.get(root(k))) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def test_near_dedup(documents):
    found = sorted((tuple(r) for r in near_dedup.near_dedup(documents).drop("rk", "chosen").collect()), key=str)
    assert found == plain_groups(pairs(documents))


@pytest.mark.parametrize("compared,large,block", [(64, 1000, 256), (64, 4, 256), (64, 4, 7), (0, 48, 256)])
def test_near_dedup_of_a_family(spark, monkeypatch, compared, large, block):
    """Many edited copies of one text, of which by no means all are linked with each other."""
    for name, value in (("COMPARED", compared), ("LARGE", large), ("BLOCK_NODES", block)):
        monkeypatch.setattr(near_dedup, name, value)
    draw = np.random.default_rng(5)
    words = prose(11, 120).split()
    rows = []
    for k in range(120):
        w = list(words)
        for at in draw.integers(0, len(w), int(draw.integers(0, 9))):
            w[at] = f"edit{k}x{at}"
        rows.append((k, " ".join(w)))
    found = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).drop("rk", "chosen")
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, plain_groups(rows)))


def test_estimate_is_near_the_similarity(spark):
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = np.unique(pool[:2800]), np.unique(pool[1200:])
    m = near_dedup.minima([a, b])
    s = near_dedup.signatures(m).tolist()
    got = spark.createDataFrame([(s[0], s[1])], "a array<bigint>, b array<bigint>").select(near_dedup.estimate(F.col("a"), F.col("b"))).first()[0]
    assert abs(got - 1600 / 4000) < 0.12


def test_recall_near_the_bar(spark):
    """Pairs of a similarity from 0.75 to 0.80, found without the help of other copies."""
    draw = np.random.default_rng(9)
    rows, linked = [], 0
    for k in range(400):
        words = [f"w{x}" for x in draw.integers(0, 10**9, 160)]
        edited = list(words)
        for at in range(int(draw.integers(0, 3)), len(words), int(draw.integers(35, 40))):
            edited[at] = f"e{k}x{at}"
        a, b = " ".join(words), " ".join(edited)
        x, y = shingles(a), shingles(b)
        if 0.75 <= len(x & y) / len(x | y) <= 0.80:
            rows += [(2 * k, a), (2 * k + 1, b)]
            linked += 1
    found = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert linked > 150 and found.filter("NOT kept").count() >= 0.99 * linked


def test_hash_functions_are_nearly_independent():
    """The share of equal minima over many small sets is their similarity, function by function and pair by pair of functions."""
    draw = np.random.default_rng(3)
    sets, shared = [], 0.5
    for _ in range(3000):
        x = draw.integers(0, 2**63, 30).astype(np.uint64)
        sets += [np.unique(x[:20]), np.unique(x[10:])]  # 10 of 30 shared
    same = near_dedup.minima(sets)[0::2] == near_dedup.minima(sets)[1::2]
    assert abs(same.mean() - 1 / 3) < 0.005 and np.abs(same.mean(axis=0) - 1 / 3).max() < 0.05 and shared
    both = np.corrcoef(same[:, :60].T.astype(float))
    assert np.abs(both - np.eye(60)).max() < 0.11


def test_null_and_repeated_ids_of_near_dedup(spark):
    base = prose(21, 120)
    rows = [(None, base), (None, base), (None, base + " more"), (None, prose(22, 90)), (5, base + " again"), (5, prose(23, 90)), (5, prose(23, 90) + " end"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = near_dedup.near_dedup(docs)
    with_id = lambda rs: sorted(str(tuple(r)) for r in rs if r[0] is not None)
    assert with_id(found.drop("rk", "chosen").collect()) == with_id(plain_groups(rows))
    # of each component one row is chosen, with rows equal to it, whatever ids it has
    near = {k: g for g, ks in enumerate(([0, 1, 2, 4], [3], [5, 6], [7])) for k in ks}
    left = corpus_pipeline.near_duplicates(spark, docs.withColumns({c: F.lit(None).cast("string") for c in ("lang", "source")}).withColumn("n_chars", F.lit(1)), "").collect()
    groups = [near[rows.index((r.doc_id, r.text))] for r in left]
    assert sorted(groups) == [0, 1, 2, 3] and {r.doc_id for r in left} == {None, 5, 6}
    lone = near_dedup.near_dedup(spark.createDataFrame(rows[:4], "doc_id bigint, text string")).collect()
    assert all(r.kept == r.chosen for r in lone) and len({r.rk for r in lone if r.kept}) == 2


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 101), (5, 5), (200, 7), (100, 101)]
    found = dict(components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert found == {**{k: 0 for k in range(41)}, 200: 0, 100: 100, 101: 100, 103: 100}


def test_components_of_hubs(spark, monkeypatch):
    from quillstone.operators import graph

    monkeypatch.setattr(graph, "BLOCK", 3)
    edges = [(500, k) for k in range(0, 60)] + [(900, k) for k in range(50, 120)] + [(k, k + 1) for k in range(2000, 2040)] + [(2005, 3000), (3000, 3001)]
    found = dict(components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert found == {**{k: 0 for k in [*range(120), 500, 900]}, **{k: 2000 for k in [*range(2000, 2041), 3000, 3001]}}


# -- repeated strings -------------------------------------------------------------

def plain_removal(rows):
    n = substrings.LENGTH
    raws = [(t or "").encode() for _, t in rows]
    seen = {}
    for r in raws:
        for s in range(len(r) - n + 1):
            seen[r[s : s + n]] = seen.get(r[s : s + n], 0) + 1
    out = []
    for (i, _), r in zip(rows, raws, strict=True):
        gone = np.zeros(len(r), bool)
        for s in range(len(r) - n + 1):
            if seen[r[s : s + n]] > 1:
                gone[s : s + n] = True
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((i, len(r), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) > 0).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("stretches", [1500, 2])
def test_repeated_strings(documents, monkeypatch, stretches):
    monkeypatch.setattr(substrings, "SHARD_STRETCHES", stretches)
    found = sorted((tuple(r) for r in substrings.remove_repeats(documents).collect()), key=str)
    assert found == plain_removal(pairs(documents))


def test_repeats_in_long_texts_and_equal_rows(spark, monkeypatch):
    """Texts worked through in parts, one string repeated in very many, rows without ids, equal rows."""
    monkeypatch.setattr(substrings, "PART", 1000)
    monkeypatch.setattr(substrings, "SHARD_STRETCHES", 5)
    common = prose(31, 100)
    rows = [(k, f"{prose(100 + k, 70)} {common[k % 7 : ]} {prose(200 + k, 60)}") for k in range(40)]
    rows += [(None, prose(33, 300)), (None, prose(33, 300)), (None, prose(34, 300) + common), (77, prose(35, 200)), (77, prose(35, 200)), (77, None), (78, "é" * 700), (79, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = substrings.remove_repeats(docs, with_text=True).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == plain_removal(rows)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in found)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(0, 2, int(rng.integers(1, 60))).astype(np.uint8)) for _ in range(12)] + [b"\x00" * 30, b"ab" * 20]
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes + 1) - sizes - 1
    codes = np.concatenate([np.append(np.frombuffer(t, np.uint8).astype(np.int64) + 1, 0) for t in texts])
    order, words = substrings.suffix_array(codes, np.repeat(begin + sizes, sizes + 1))
    whole = [(c, k) if c == 0 else (c, 0) for k, c in enumerate(codes.tolist())]
    key = lambda k: whole[k : next(e for e in (begin + sizes).tolist() if e >= k) + 1]
    assert order.tolist() == sorted(range(len(codes)), key=key)
    shared = substrings.common_prefixes(order, words, codes, begin, sizes)
    for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
        x, y = key(a), key(b)
        n = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        if codes[b]:
            assert shared[b] == n
    for least in (8, 12, 20):
        assert np.array_equal(substrings.common_prefixes(order, words, codes, begin, sizes, least), np.where(shared >= least, shared, 0))


# -- fingerprints -------------------------------------------------------------------

def test_order_minhash(documents):
    marked = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    rows = [(r.doc_id, r.text) for r in sorted(marked.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.mark))]
    for parts in (1, 4, 40):
        found = order_minhash.fingerprints(documents, parts).collect()
        expected = []
        for k, (i, t) in enumerate(rows):
            other = rows[(k + 1) % len(rows)][1]
            half = len(t) // 2
            edit = t[: len(t) - half] + other[:half]
            a, b, c = ((not x, order_minhash.sketch(x)) for x in (t, edit, other))
            expected.append((i, len(t), hashlib.sha256(edit.encode()).hexdigest(), order_minhash.encode(a[1]), order_minhash.encode(b[1]), order_minhash.likeness(a, b), order_minhash.likeness(a, c)))
        assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)


def test_ranges_of_one_key(spark):
    """Rows without an id, or with one, are dealt to several ranges, and each still meets the one after it."""
    rows = [(None if k % 3 else 7, f"text number {k} {prose(k, 5)}") for k in range(300)] + [(8, "a"), (8, "a"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    dealt = order_minhash.ranges(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), 12)
    assert dealt.filter("guest = 0 AND doc_id IS NULL").select("part").distinct().count() > 4 and dealt.filter("guest = 0").count() == len(rows)
    one, many = (sorted(map(str, order_minhash.fingerprints(docs, parts).collect())) for parts in (1, 12))
    assert one == many and len(one) == len(rows)


def test_sketch_by_definition():
    text = prose(3, 60) + "aaaaaaaaaaaaaaaaaaaa"
    h = order_minhash.kmers(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64))
    seen, base = {}, []
    with np.errstate(over="ignore"):
        for x in h.tolist():
            k = seen[x] = seen.get(x, -1) + 1
            base.append(int(order_minhash.K.mix(np.array([x], np.uint64) + np.array([k], np.uint64) * order_minhash.K.BASE)[0]) >> 32)
        out = []
        for flip, factor in zip(order_minhash._FLIPS.tolist(), order_minhash._FACTORS.tolist(), strict=True):
            value = [((b ^ flip) * factor) % 2**32 for b in base]
            best = sorted(sorted(range(len(value)), key=lambda k: value[k])[: order_minhash.TUPLE])
            e = np.array([1], np.uint64)
            for k in best:
                e = order_minhash.K.mix(e * order_minhash.K.BASE + h[k])
            out.append(int(e[0]) >> (64 - order_minhash.ENTRY_BITS))
    assert order_minhash.sketch(text).tolist() == out


def test_long_texts_are_sketched_in_blocks(monkeypatch):
    text = prose(5, 9000) + "ab" * 30_000
    whole = order_minhash.sketch(text)
    for block in (1, 1000, 10_000_000):
        monkeypatch.setattr(order_minhash, "BLOCK", block)
        assert np.array_equal(order_minhash.sketch(text), whole)


def test_slices_and_chunks_change_nothing(spark, monkeypatch):
    """Very long rows among short ones, worked through in pieces of a few bytes or as a whole."""
    rows = [(k, prose(k, [3, 4000, 12][k % 3]), ["en", "de"][k % 2]) for k in range(12)]
    texts = [t for _, t, _ in rows]
    columns = [pa.array(texts[a:b]) for a, b in ((0, 12), (0, 1), (1, 12))]
    for size in (7, 1 << 20):
        monkeypatch.setattr(language_id.K, "CHUNK", size)
        keys = [language_id.K.letter_words(*language_id.K.code_points(c))[2] for c in columns]
        assert np.array_equal(keys[0], np.concatenate(keys[1:]))
    first = language_id.K.word_key("Grüße")
    assert first == language_id.K.word_key("grüße") != language_id.K.word_key("grüss")


def test_order_matters_to_the_sketch():
    words = prose(8, 200).split()
    text = " ".join(words)
    swapped = " ".join(words[100:] + words[:100])
    edited = " ".join(words[:60] + ["new"] + words[61:])
    like = lambda a, b: float(np.mean(order_minhash.sketch(a) == order_minhash.sketch(b)))
    assert like(text, text) == 1 and like(text, edited) > like(text, swapped)


# -- personal data --------------------------------------------------------------------

KINDS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(KINDS.items()):
        for m in pattern.finditer(text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            luhn = sum(d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for k, d in enumerate(reversed(digits))) % 10 == 0
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False, "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), n, m.end()))
    return sorted(out)


def test_spans_match_the_patterns():
    draw = np.random.default_rng(3)
    alphabet = list("ab@..-+ 01259()%_\n") + ["4111111111111111", "192.168.1.1", "x@y.zz", "+1 (234) 555-0100"]
    for _ in range(3000):
        text = "".join(draw.choice(alphabet, int(draw.integers(1, 40))))
        assert private_data.spans(text) == plain_spans(text), text


def test_private_spans_and_terms(spark):
    mail = "jane@corp.example.com"
    rows = [(k, f"{prose(40 + k, 30)}\nplease ask zebrafish about {mail} on {w}\n{prose(70 + k, 20)}") for k, w in enumerate(["monday", "tuesday", "friday", "sunday"])]
    rows += [(10, None), (11, ""), (12, prose(5, 100)), (None, "zebrafish"), (13, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r for r in private_data.private_spans(docs).collect()}
    for i, t in rows[:4]:
        base = private_data.written(plain_spans(t))
        assert found[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and found[i].n_email == 1
        own = [s for s in found[i].spans.split(",") if s.startswith("term")]
        assert base in found[i].spans and [t[slice(*map(int, s.split(":")[1:]))] for s in own].count("zebrafish") == 1
    assert found[12].spans == found[11].spans == found[10].spans == ""
    new = {r.doc_id: r for r in private_data.sanitise(docs.withColumn("n_chars", F.lit(0))).collect()}
    assert mail not in new[0].text and "zebrafish" not in new[0].text and "[EMAIL]" in new[0].text and new[12].text == rows[6][1] and new[10].text is None
    assert new[0].n_chars == len(new[0].text) and len(new) == len({i for i, _ in rows})


def test_private_terms_of_whole_documents(spark):
    """A disclosing term goes from every place of a document that holds the entity, also where it stands on another line."""
    mail = "jane@corp.example.com"
    rows = [(k, f"Wombat {prose(40 + k, 400)}\nfrom Zebrafish\n{mail}\n{w}\n{prose(70 + k, 400)} {['', 'zebrafish'][k < 2]} again") for k, w in enumerate(["monday", "tuesday", "friday", "sunday"])]
    rows += [(10, f"zebrafish {prose(9, 80)}\n{'0 ' * 400}\n{mail}\n{'0 ' * 400}"), (11, prose(5, 100)), (12, None)]
    rows += [(20 + k, prose(300 + k, 60)) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    new = {r.doc_id: r.text for r in private_data.sanitise(docs).collect()}
    assert all("zebrafish" not in new[k].lower() and "Wombat" in new[k] for k in range(4))
    assert new[10].startswith("[TERM] ") and mail not in new[10] and new[11] == rows[5][1] and new[12] is None
    spans = {r.doc_id: r.spans for r in private_data.private_spans(docs).collect()}
    marked = [rows[0][1][slice(*map(int, s.split(":")[1:]))].lower() for s in spans[0].split(",") if s.startswith("term")]
    assert marked.count("zebrafish") == 2


def plain_terms(rows, residual=1.0, share=0.5, support=3):
    """(document, term) pairs that disclose, from counts of documents in plain dictionaries."""
    fold = lambda w: "".join(c.lower() if len(c.lower()) == 1 else c for c in w)
    docs = []
    for _, t in rows:
        t = t or ""
        base = plain_spans(t)
        words = [(m.start(), m.end(), fold(m.group())) for m in re.finditer(r"[^\W\d_]+", t) if m.end() - m.start() >= 3]
        free = [w for w in words if not any(w[0] < b and w[1] > a for a, _, b in base)]
        near = []
        for a, kind, b in base:
            value = t[a:b].lower() if kind < 2 else re.sub("[^0-9]", "", t[a:b])
            own = [w[2] for w in free if w[1] <= a][-8:] + [w[2] for w in free if w[0] >= b][:8]
            near.append(((kind, value), tuple(own)))
        docs.append((near, {w[2] for w in words}))
    found = set()
    for e in {e for near, _ in docs for e, _ in near}:
        holders = [k for k, (near, _) in enumerate(docs) if any(x == e for x, _ in near)]
        contexts = {c for near, _ in docs for x, c in near if x == e}
        for term in {w for c in contexts for w in c}:
            both = sum(any(x == e and term in c for x, c in near) for near, _ in docs)
            n_term = sum(term in words for _, words in docs)
            content = -np.log2(len(holders) / len(docs))
            shared = np.log2(both * len(docs) / (len(holders) * n_term))
            assert shared <= content + 1e-9
            if sum(term in c for c in contexts) >= support and both >= n_term * 2.0**-residual and shared >= share * content and content > 0:
                found |= {(k, term) for k in holders}
    return found


def test_disclosing_terms_by_definition(spark):
    draw = np.random.default_rng(12)
    people = [("jane@corp.example.com", "zebrafish wombat"), ("10.20.30.40", "axolotl"), ("+1 (555) 555-0100", "İstanbul quokka"), ("4111 1111 1111 1111", "narwhal")]
    rows = []
    for k in range(120):
        parts = [prose(600 + k, int(draw.integers(5, 60)))]
        if k % 3 == 0:
            value, names = people[(k // 3) % 4]
            long_word = "q" * 700 if k % 2 else ""
            parts += [f"{names} {long_word} {value} {prose(800 + k, 3)}", prose(900 + k, 20), names.split()[0].upper() if k % 9 == 0 else ""]
        elif k % 10 == 1:
            parts += ["axolotl wombat"]
        rows.append((k, "\n".join(parts)))
    rows += [(200, None), (201, ""), (None, rows[0][1]), (202, rows[0][1]), (202, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("tk", F.lit("clash")).withColumn("entity", F.lit("clash"))
    expected = plain_terms(rows)
    assert len({t for _, t in expected}) >= 4
    wanted = []
    for k, (i, t) in enumerate(rows):
        fold = lambda w: "".join(c.lower() if len(c.lower()) == 1 else c for c in w)
        base = plain_spans(t or "")
        own = [(m.start(), 4, m.end()) for m in re.finditer(r"[^\W\d_]+", t or "") if (k, fold(m.group())) in expected and not any(m.start() < b and m.end() > a for a, _, b in base)]
        wanted.append((i, private_data.written(sorted(base + own))))
    found = [(r.doc_id, r.spans) for r in private_data.private_spans(docs).collect()]
    assert sorted(found, key=str) == sorted(wanted, key=str)
    clean = private_data.sanitise(docs).collect()
    assert len(clean) == len(rows) and all(r.tk == r.entity == "clash" for r in clean) and not any("zebrafish" in (r.text or "") for r in clean)


# -- language ------------------------------------------------------------------------------

def test_language_id(spark):
    vocabulary = {"en": "the house stands near water and trees".split(), "de": "das Haus steht nahe am Wasser und Bäumen".split(), "fr": "la maison près de l'eau et des arbres été".split()}
    draw = np.random.default_rng(4)
    rows = [(k, " ".join(draw.choice(vocabulary[lang := ["en", "de", "fr"][k % 3]], 30)), lang) for k in range(300)]
    odd = [(900, None, "en"), (901, "12 34 !!", "de"), (902, "", None), (903, "wasser wassern bäume häuser", None), (None, "the trees stand", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string").withColumn("score", F.lit("clash"))
    found = {r.doc_id: r for r in language_id.identify(docs, language_id.fit(docs)).withColumn("held", language_id.held_out(F.col("doc_id"))).collect()}
    held = [i for i, _, _ in rows if found[i].held]
    assert 60 < len(held) < 140 and np.mean([found[i].lang_pred == found[i].lang for i in held]) > 0.98
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (900, 901, 902))
    assert found[903].lang_pred == "de" and found[None].lang_pred == "en" and all(0 <= r.score <= 1 for r in found.values())


def plain_words(text):
    fold = lambda w: "".join(c.lower() if len(c.lower()) == 1 else c for c in w)
    out, run = [], ""
    for c in (text or "") + " ":
        if c.isalpha():
            run += c
        elif run:
            out.append(fold(run))
            run = ""
    return out


def plain_language(rows, texts):
    """Predictions from plain dictionaries of counts: words first, then the longest known n-grams."""
    counts, mass = {}, {}
    for text, lang in rows:
        for w in plain_words(text):
            for size in range(6):
                for g in [w] if size == 0 else [w[a : a + size] for a in range(len(w) - size + 1)]:
                    counts.setdefault((size, g), {}).setdefault(lang, 0)
                    counts[size, g][lang] += 1
                    mass[size, lang] = mass.get((size, lang), 0) + 1
    langs = sorted({lang for _, lang in mass})
    known = [{g for s, g in counts if s == size and (size == 1 or sum(counts[s, g].values()) >= 2)} for size in range(6)]

    def row(size, g):
        logs = [np.log((counts[size, g].get(lang, 0) + 0.5) / (mass.get((size, lang), 0) + 0.5 * (len(known[size]) + 1))) for lang in langs]
        return np.array(logs) - np.mean(logs)

    def score(w):
        if w in known[0]:
            return row(0, w)
        for size in range(5, 0, -1):
            hits = [row(size, w[a : a + size]) for a in range(len(w) - size + 1) if w[a : a + size] in known[size]]
            if hits:
                return np.mean(hits, axis=0) / (1 + (5 - size))
        return np.zeros(len(langs))

    out = []
    for t in texts:
        words = plain_words(t)
        sums = np.sum([score(w) for w in words], axis=0) if words else None
        odds = np.exp(sums - sums.max()) if words else None
        out.append((langs[int(odds.argmax())], odds.max() / odds.sum()) if words else ("und", 0.0))
    return out


def test_language_id_by_definition(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MEMORY", 20)
    monkeypatch.setattr(language_id.K, "CHUNK", 64)
    vocabulary = {"en": "the house stands near water and trees", "de": "das Haus steht nahe am Wasser und Bäumen", "fr": "la maison près de l'eau et des arbres été"}
    draw = np.random.default_rng(14)
    rows = [(k, " ".join(draw.choice(vocabulary[lang := ["en", "de", "fr"][k % 3]].split(), int(draw.integers(1, 12)))), lang) for k in range(200)]
    rows += [(500 + k, t, None) for k, t in enumerate(["½ ² ٣", "häuser wassers", "İstanbul trees", "x", "", None, "ﬁ hausen ǅ", "wasser" * 60, "zzz qqq", "Wald ½ maison", "你好 the"])]
    rows += [rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("clash")).withColumn("gram", F.lit("clash"))
    labelled = [(t, lang) for _, t, lang in {r for r in [(r.doc_id, r.text, r.lang) for r in docs.filter(~language_id.held_out(F.col("doc_id"))).collect()] if r[2]}]
    found = language_id.identify(docs, language_id.fit(docs)).collect()
    expected = plain_language(labelled, [r.text for r in found])
    assert len(found) == len(rows)
    for r, (lang, score) in zip(found, expected, strict=True):
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4, (r, lang, score)
    assert {r.lang_pred for r in found if r.text in ("½ ² ٣", "", None)} == {"und"}


def test_sample_is_bounded_under_ties(spark):
    rows = [(None, f"text {k}", "en") for k in range(400)] + [(3, "same", "de")] * 400
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5)
    assert language_id.sample(docs, 50).count() <= 50 and language_id.sample(docs, 1000).count() <= 401


# -- pieces ----------------------------------------------------------------------------------

def test_pieces_equal_the_library_without_dropout(texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    own = [t for t in texts if t and "▁" not in t] + [" a", "a  b\n\n c", "https://www.example.com/" + "abc123" * 30, "   "]
    ids, counts = pieces.Encoder(pieces.load(), 0.0, 1).encode(own, np.arange(len(own)).astype(np.uint64))
    ends = np.append(0, np.cumsum(counts))
    for k, t in enumerate(own):
        assert ids[ends[k] : ends[k + 1]].tolist() == model.encode(t)


def test_dropout_is_lossless_varied_and_the_same_by_either_agenda(texts, monkeypatch):
    own = [t or "" for t in texts]
    keys = np.arange(len(own)).astype(np.uint64)
    encode = lambda rate, seed: pieces.Encoder(pieces.load(), rate, seed).encode(own, keys)
    plain, (ids, counts) = encode(0.0, 7), encode(0.3, 7)
    ends = np.append(0, np.cumsum(counts))
    for k, t in enumerate(own):
        assert pieces.decode(ids[ends[k] : ends[k + 1]].tolist(), pieces.load()) == t
    assert len(ids) > len(plain[0]) and not np.array_equal(encode(0.3, 8)[0], ids)
    monkeypatch.setattr(pieces, "LONG", 1)
    assert np.array_equal(encode(0.3, 7)[0], ids)


def test_dropout_is_drawn_for_each_occurrence(monkeypatch):
    """A frequent word is cut in more than 16 ways, as often as by agendas of its own."""
    own = ["understanding internationalisation"] * 3000
    keys = np.array([pieces.row_key(7, (k,)) for k in range(len(own))], np.uint64)
    encode = lambda some: pieces.Encoder(pieces.load(), 0.1, 7).encode(own[:some], keys[:some])
    ids, counts = encode(3000)
    ends = np.append(0, np.cumsum(counts))
    assert len({tuple(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)}) > 16 * 16
    monkeypatch.setattr(pieces, "LONG", 1)
    assert np.array_equal(encode(300)[0], ids[: ends[300]])


def plain_pieces(text, key, rate, seed):
    """Pieces by scanning all neighbours again after every merge, in whole numbers of Python."""
    import sentencepiece

    model, full = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), (1 << 64) - 1
    known = {model.id_to_piece(k): k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))}
    base = int(pieces.K.BASE)

    def mix(x):
        x &= full
        x = (x ^ (x >> 33)) * 0xFF51AFD7ED558CCD & full
        x = (x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53 & full
        return x ^ (x >> 33)

    points = ["▁" if c == " " else c for c in " " + text]
    number = lambda c, raw: known[c] if c in known and raw != "▁" else -1 - ord(raw)
    symbols = [number(c, raw) for c, raw in zip(points, " " + text, strict=True)]
    segments, run = [], []
    for k, s in enumerate(symbols):
        if run and ((points[k] == "▁" and s >= 0 and not (points[k - 1] == "▁" and symbols[k - 1] >= 0)) or s < 0 or symbols[k - 1] < 0):
            segments.append(run)
            run = []
        run.append(k)
    segments.append(run)
    out = []
    for ordinal, run in enumerate(segments):
        content = mix(sum(mix(symbols[k] + (1 << 32)) * pow(base, j, 1 << 64) for j, k in enumerate(run)) + len(run))
        own = mix(content + seed * base + mix(key + ordinal + seed))
        parts = [(j, j + 1, points[k]) for j, k in enumerate(run)]
        while True:
            options = []
            for (a, b, x), (_, d, y) in zip(parts, parts[1:], strict=False):
                gone = mix(own + a * 0x9E3779B1 + b * 0x85EBCA6B1 + d * 0xC2B2AE3D27) < int(rate * 2**64)
                if x + y in known and all(symbols[run[j]] >= 0 for j in range(a, d)) and not gone:
                    options.append((-model.get_score(known[x + y]), a, d, x + y))
            if not options:
                break
            _, a, d, piece = min(options)
            parts = [p for p in parts if p[1] <= a] + [(a, d, piece)] + [p for p in parts if p[0] >= d]
        for a, _, x in parts:
            out += [known[x]] if symbols[run[a]] >= 0 else [known.get(f"<0x{v:02X}>", model.piece_to_id(f"<0x{v:02X}>")) for v in (" " + text)[run[a]].encode()]
    return out


def test_dropout_by_an_independent_agenda():
    own = ["understanding internationalisation is  not easy", "Grüße, señor! ▁ 你好 🙂", "a" * 60, prose(61, 40), "x", "https://www.example.com/path?query=1"] * 2
    keys = np.array([pieces.row_key(7, (k,)) for k in range(len(own))], np.uint64)
    for rate in (0.1, 0.5):
        ids, counts = pieces.Encoder(pieces.load(), rate, 7).encode(own, keys)
        ends = np.append(0, np.cumsum(counts))
        for k, t in enumerate(own):
            assert ids[ends[k] : ends[k + 1]].tolist() == plain_pieces(t, int(keys[k]), rate, 7), t


def test_encode_documents(documents, texts):
    rows = pieces.encode(documents).collect()
    assert len(rows) == len(texts) + 3 and all(r.lossless for r in rows) and {r.score for r in rows} == {"clash"}


# -- mixing and licenses ------------------------------------------------------------------------

def plain_copies(rows, seed=mixing.SEED):
    sizes = {}
    for r in rows:
        sizes[r.source or ""] = sizes.get(r.source or "", 0) + 1
    total = sum(n**mixing.TEMPERATURE for n in sizes.values())
    out = []
    for r in rows:
        n = sizes[r.source or ""]
        rate = len(rows) * n**mixing.TEMPERATURE / (total * n)
        u = int(hashlib.md5(f"{seed}:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        p = c = np.exp(-rate)
        k = 0
        while u > c:
            k += 1
            p *= rate / k
            c += p
        out += [(r.doc_id, r.source, x) for x in range(k)]
    return sorted(out, key=str)


def test_mixing(documents):
    found = mixing.mix(documents)
    assert sorted(((r.doc_id, r.source, r.copy_no) for r in found.collect()), key=str) == plain_copies(documents.collect())
    weights = documents.sparkSession.createDataFrame([("s1", 1.0), ("absent", 5.0)], "source string, weight double")
    assert {r.source for r in mixing.mix(documents, weights, rows=200).collect()} == {"s1"}


def test_mixing_small_sources(spark):
    """Sources so small that their rows are repeated more often than one inversion can tell."""
    sizes = {"big": 20_000, "one": 1, **{f"few{k}": 4 for k in range(50)}}
    rows = [(s, k) for s, n in sizes.items() for k in range(n)]
    docs = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(rows)], "doc_id bigint, source string")
    rate = {r.source: r.rate for r in mixing.rates(docs).collect()}
    got = {r.source: r["count"] for r in mixing.mix(docs).groupBy("source").count().collect()}
    assert rate["one"] > mixing.MOST_MEAN > rate["few0"] and all(abs(got[s] - n * rate[s]) < 6 * (n * rate[s]) ** 0.5 for s, n in sizes.items())
    few = np.array([r.n for r in docs.select(mixing.drawn(F.lit(500.0), "x", F.col("doc_id")).alias("n")).collect()])
    assert abs(few.mean() - 500) < 1 and abs(few.var() / 500 - 1) < 0.05


def test_drawn_by_definition(spark):
    """At any mean: inversion up to 64, beyond it the sum of inversions of equal parts."""
    def uniform(*parts):
        return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52

    def quantile(mean, u):
        p = c = np.exp(-mean)
        k = 0
        while u > c and k < 400:
            k += 1
            p *= mean / k
            c += p
        return k

    for mean in (0.0, 0.1, 1.0, 64.0, 140.0, 5000.0):
        parts = int(np.ceil(mean / 64))
        want = [quantile(mean, uniform("s", i)) if parts <= 1 else sum(quantile(mean / parts, uniform("s", i, k)) for k in range(1, parts + 1)) for i in range(60)]
        got = spark.range(60).select(mixing.drawn(F.lit(mean), "s", F.col("id")).alias("n")).collect()
        assert [r.n for r in got] == want, mean


def test_license_scan(documents):
    import duckdb

    joined = "\n".join(t for _, t in license_scan.TEMPLATES[:14]).replace(" is hereby", "\nis hereby")
    more = [
        (None, joined), (900, joined.upper()), (900, joined.upper()), (901, license_scan.TEMPLATES[5][1].replace("holders be", "holders,\nbe")), (902, "One. " + license_scan.TEMPLATES[23][1].capitalize() + "\n\nNext."),
        (903, "GNU Lesser General Public License. Apache  License"), (904, license_scan.TEMPLATES[17][1].replace(" free ", "\nfree "))
    ]
    table = documents.drop("label").select("doc_id", "text").union(documents.sparkSession.createDataFrame(more, "doc_id bigint, text string")).withColumn("label", F.lit("clash")).withColumn("block", F.lit(1))
    con = duckdb.connect()
    con.register("documents", table.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    expected = con.execute(license_scan.ORACLE)
    names = [d[0] for d in expected.description]
    found = license_scan.digest(*license_scan.scan(table)).select(*names).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected.fetchall())) and len(found) == table.count()
    labels = {r.doc_id: r.labels for r in found}
    assert labels[901] == "mit" and labels[902] == "bsd" and labels[904] == "gpl,lgpl" and labels[903] == "apache,gpl"
    assert any(r.labels == "cc-by-nc,mit" and r.base_labels == "mit" for r in found)


def test_license_scan_of_wrapped_and_joint_notices(spark):
    wrapped = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\ndocumentation files"
    rows = [
        (1, wrapped), (2, wrapped.replace("\n", "\n\n")), (3, "All rights reserved, licensed under CC BY 4.0"), (4, "Licensed under CC BY-NC 4.0"),
        (5, "Licensed under CC BY 4.0\nLicensed under CC BY-NC 4.0"),
    ]
    found = license_scan.digest(*license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()
    assert {r.doc_id: r.labels for r in found} == {1: "mit", 2: "", 3: "cc-by,reserved", 4: "cc-by-nc", 5: "cc-by,cc-by-nc"}


def plain_matches(text, templates=license_scan.TEMPLATES, share=license_scan.CONTAINMENT):
    """Templates that some line, sentence or paragraph of a text holds to the share, by plain sets."""
    import re

    low = text.lower()
    wrapped = [x for x in re.split(license_scan.SENTENCE, low) if "\n" in x.strip(" \t\r\n")]
    wide = [x for x in re.split(license_scan.PARAGRAPH, low) if re.search(license_scan.ENDED, x)]
    out = {}
    for paragraph, parts in ((False, re.split(license_scan.BLOCK, low) + wrapped), (True, wide)):
        for part in parts:
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", part)
            own = set(words) | {f"{a}_{b}" for a, b in zip(words, words[1:])}
            for k, (_, t) in enumerate(templates):
                ws = license_scan.template_words(t)
                if len(own & set(ws)) >= license_scan.needed(len(ws), share) and ("." in t or not paragraph):
                    out[k] = max(out.get(k, 0), len(own & set(ws)) / len(ws))
    return out


def test_license_scan_reports_every_template(spark):
    """Templates within templates, several of a block, and a very long text: all that meet the share."""
    texts = [
        "Licensed under CC BY 4.0 and also, elsewhere, under CC BY-NC 4.0", license_scan.TEMPLATES[2][1], license_scan.TEMPLATES[5][1], license_scan.TEMPLATES[14][1] + ". " + license_scan.TEMPLATES[13][1],
        "Under CC BY-SA 4.0 licensed; by 4", "licensed under 4 0 cc by", prose(31, 60_000) + "\n" + license_scan.TEMPLATES[19][1] + "\n" + prose(32, 60_000), license_scan.TEMPLATES[10][1].replace("apache", ""), None, "",
    ]
    rows, matches = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    found = {}
    for r in matches.join(rows, "row_no").collect():
        found.setdefault(r.doc_id, {})[r.template] = max(r.containment, found.get(r.doc_id, {}).get(r.template, 0))
    assert found == {k: m for k, t in enumerate(texts) if (m := plain_matches(t or ""))}
    by = {k: {license_scan.TEMPLATES[t][0] for t in m} for k, m in found.items()}
    assert by[0] == {"cc-by", "cc-by-nc"} and {1, 2} <= found[1].keys() and {13, 14} <= found[3].keys() and "bsd" not in by.get(7, set())


# -- every operator on an empty table, and the pipeline --------------------------------------------

def test_empty_tables(none):
    for made in (
        near_dedup.near_dedup(none), substrings.remove_repeats(none), order_minhash.fingerprints(none), private_data.private_spans(none), private_data.sanitise(none), language_id.identify(none, language_id.fit(none)),
        pieces.encode(none), mixing.mix(none), license_scan.digest(*license_scan.scan(none)),
    ):
        assert made.collect() == []


def test_pipeline(spark, documents, tmp_path):
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, str(tmp_path))
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS, name
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= before
    out = corpus_pipeline.run(spark, str(tmp_path))
    rows = out.collect()
    assert rows and all(r.lossless for r in rows)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        assert pieces.decode(r.ids, pieces.load()) == text[r.doc_id] and "@" not in text[r.doc_id]
    kept = corpus_pipeline.near_duplicates(spark, documents, "")
    expected = {i for i, _, _, keep in plain_groups(pairs(documents)) if keep}
    assert {r.doc_id for r in kept.collect()} == expected and kept.filter("doc_id = 66").count() == 1


def test_pipeline_by_definition(spark, tmp_path):
    """Every stage against a plain version of it, on the rows that the stage before it kept."""
    draw = np.random.default_rng(8)
    lexicon = {"en": prose(1, 400).split(), "de": "das Haus steht nahe am Wasser und den Bäumen wo viele Leute gehen sehen kommen".split()}
    rows = []
    for k in range(90):
        lang = ["en", "en", "de"][k % 3]
        text = " ".join(draw.choice(lexicon[lang], int(draw.integers(20, 60))))
        text += f" write to p{k % 4}@mail.example.com" if k % 5 == 0 else ""
        rows.append((k, text, lang if k % 7 else None, ["a", "a", "a", "b", None][k % 5], len(text)))
    rows += [(100 + k, rows[k][1] + " end", rows[k][2], "c", 1) for k in range(0, 20, 2)] + [(300, "12 34", None, "a", 5), (301, None, "en", "a", None), (302, "", "en", None, 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    held = {r.doc_id for r in spark.createDataFrame([(r[0],) for r in rows], "doc_id bigint").filter(language_id.held_out(F.col("doc_id"))).collect()}
    guesses = plain_language([(t, lang) for i, t, lang, *_ in rows if i not in held and t is not None and lang is not None], [r[1] for r in rows])
    kept = [(i, t, lang or guess, s) for (i, t, lang, s, _), (guess, score) in zip(rows, guesses, strict=True) if guess != "und" and score >= 0.5]
    first = {i for i, _, _, keep in plain_groups([(i, t) for i, t, *_ in kept]) if keep}
    kept = [r for r in kept if r[0] in first]
    terms = plain_terms([(i, t) for i, t, *_ in kept])
    clean = []
    for k, (i, t, lang, s) in enumerate(kept):
        base = plain_spans(t)
        own = [(m.start(), 4, m.end()) for m in re.finditer(r"[^\W\d_]+", t) if (k, m.group().lower()) in terms and not any(m.start() < b and m.end() > a for a, _, b in base)]
        clean.append((i, private_data.redacted(t, base + own), lang, s))
    copies = plain_copies([Row(doc_id=i, source=s) for i, _, _, s in clean])
    text = {i: (t, lang) for i, t, lang, _ in clean}
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.source, r.lang, r.n_chars, pieces.decode(r.ids, pieces.load())) for r in found if r.source) == sorted((i, s, text[i][1], len(text[i][0]), text[i][0]) for i, s, _ in copies if s)
    assert len(found) == len(copies) and any("[EMAIL]" in t for t, _ in text.values())
    made = {(r.doc_id, tuple(r.ids)) for r in found}
    assert made == {(i, tuple(plain_pieces(text[i][0], pieces.row_key(pieces.SEED, (i, n + 1)), pieces.DROPOUT, pieces.SEED))) for i, _, n in copies}


def test_decoding_of_tables(spark, documents, none):
    """Encoded tables decode to their texts again; nulls and empty lists to the empty text; pieces out of range are an error."""
    encoded = pieces.encode(documents).withColumn("text", F.lit("clash"))
    back = pieces.decode_table(encoded)
    assert set(back.columns) == set(encoded.columns) - {"ids"} and pieces.decode_table(pieces.encode(none)).collect() == []
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(r.doc_id), r.text or "") for r in documents.collect())
    odd = spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    assert [r.text for r in pieces.decode_table(odd).collect()] == ["", ""]
    with pytest.raises(Exception, match="vocabulary"):
        pieces.decode_table(spark.createDataFrame([(1, [10**6])], "k int, ids array<int>")).collect()


def test_copies_draw_their_own_dropout(spark):
    row = (1, prose(3, 200), "en", "s1", 1)
    docs = spark.createDataFrame([row] * 4 + [(2, *row[1:])], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    made = [corpus_pipeline.encoded(spark, docs.repartition(n), "").collect() for n in (1, 3)]
    ids = [sorted((r.doc_id, tuple(r.ids)) for r in rows) for rows in made]
    assert ids[0] == ids[1] and len({i for _, i in ids[0]}) == 5 and all(r.lossless for r in made[0])


def test_registry():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES)
    assert numbers == list(range(1, 14)) and set(registry.ORACLES) <= set(registry.QUERIES)
