"""The filter audit against applying the filters in every order, and its parts against plain counts."""

import re
from itertools import permutations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.llm import filter_audit as A
from quillstone.llm import kernels
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    return [len(words), len(set(words)), len(re.findall("[A-Z]", text or "")), len(text or ""), len(re.findall("[#$%&*|]", text or ""))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAB é\t\n#🙂|\x1c b", max_size=40)), max_size=12), st.sampled_from([3, 7, 1 << 20]))
def test_measured(texts, piece):
    before, A.PIECE = A.PIECE, piece
    try:
        assert A.measured(pa.array(texts, pa.string())).tolist() == [plain(t) for t in texts]
    finally:
        A.PIECE = before


def test_measured_long_texts(texts):
    many = texts + ["Ab cd é " * 400_000, "x" * 3_000_000, prose(9, 60_000)]
    assert A.measured(pa.array(many, pa.string())).tolist() == [plain(t) for t in many]


def test_table_drives_the_machine():
    text = "Aé #b\n".encode()
    put, state = A.transduce(np.frombuffer(text, np.uint8), A.WHITE)
    assert state == A.WHITE and [bool(x & A.START) for x in put] == [True, False, False, False, True, False, False]
    assert [bool(x & A.END) for x in put] == [False, False, False, True, False, False, True]
    assert [bool(x & A.POINT) for x in put] == [True, True, False, True, True, True, True]


def test_words_of_equal_hash_stay_apart():
    """With hashes that are all alike, comparing the words alone tells them apart."""
    text = ("ab abc ab abd a ab " + "longerthaneight longerthaneighy longerthaneight").encode()
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = kernels.words(data, np.array([0, len(data)]))
    for hashes in (kernels.span_hashes, lambda d, s, e: np.zeros(len(s), np.uint64)):
        table = A.WordTable(data, hashes)
        for low in (0, 3):  # in two goes
            some = slice(low, low + 3) if not low else slice(3, None)
            table.insert(starts[some], ends[some], np.zeros(len(starts[some]), np.int64), int(starts[some][0]))
        assert table.counts(1).tolist() == [len(set(text.split()))]


def brute(rows, labels):
    own, least = {}, {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    for i, t, lang in rows:
        words, distinct, capitals, points, marks = plain(t)
        tests = [words < 100, 100 * distinct < 80 * words, 100 * capitals > 10 * points, marks > 0, i is not None and i > least[t or ""]]
        own.setdefault(lang or "", []).append((i, {f for f, x in zip("ABCDE", tests, strict=True) if x}))
    out, shapley = [], {}
    for part, docs in own.items():
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone, kept = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                before = sum(1 for d in docs if f in d[1]) - len(gone)
                out.append([part, "".join(order), step, len(kept), len(gone), before, sum(1 for d in docs if d[1] == {f}), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone), f])
                left = kept
    return sorted([*r[:-1], shapley[r[0], r[-1]]] for r in out)


def test_audit(spark, documents, none):
    long = prose(11, 150)
    extra = [(900, long, "en"), (901, long, "de"), (902, long + " #", "en"), (902, long, "en"), (903, long.upper(), None), (904, " ".join(f"w{k}" for k in range(120)), "fr"), (905, None, "fr"), (None, long, "fr"), (906, long.title() * 2 + "|", "")]
    frame = documents.select("doc_id", "text", "lang").union(spark.createDataFrame(extra, "doc_id bigint, text string, lang string")).withColumn("part", F.lit("clash")).withColumn("failed", F.lit("clash"))
    labels = [(900, 1, 0), (902, 1, 1), (902, 0, 0), (904, None, 1), (None, 1, 1), (903, 0, 1), (3, 1, None), (901, 1, 0)]
    given = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in frame.collect()]
    found = A.audit(frame, given)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(list(r) for r in found.collect()) == brute(rows, labels)
    assert A.audit(none, given).collect() == []
    assert {r["good_lost"] for r in A.audit(frame, given.limit(0)).collect()} == {0}
