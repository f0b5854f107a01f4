import random

import pytest

WORDS = "the of and to in is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    out = []
    for k in range(n):
        out.append(draw.choice(WORDS) + draw.choice(["", "", "ing", "ed", "s"]))
        out.append("\n" if k % 17 == 16 else ". " if k % 9 == 8 else " ")
    return "".join(out)


@pytest.fixture(scope="session")
def texts():
    """Texts with nulls, empty ones, copies, near copies, one long text, odd characters."""
    base = prose(1, 300)
    words = base.split(" ")
    near = " ".join(words[:150] + ["changed"] + words[151:])
    return [
        base, base, near, None, "", "   \n ", "one two", "one two", prose(2, 200), prose(3, 90), prose(4, 4000), base[:900] + prose(5, 60), "a" * 2000, "ab" * 900,
        "Grüße, señor! ça été ▁ 你好 🙂 ﬁ①\t tab", prose(6, 120) + base[200:1200], "x@y.example.com +1 (555) 555-0100 192.168.0.1 4111 1111 1111 1111", base.upper(), prose(7, 5),
        "Released under the MIT License.\nLicensed under CC BY-NC 4.0.", " ".join(words[:280]),
    ]


@pytest.fixture(scope="session")
def documents(spark, texts):
    """The texts as a table of documents: ids with gaps, a null id, nulls in other columns, a repeated row, columns of clashing names."""
    rows = [(7 * k + 3, t, ["en", None, "de"][k % 3], [None, "s1", "s2", "s1"][k % 4], None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [(None, texts[8], "en", "s1", 1), rows[9], rows[9]]
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    frame = spark.createDataFrame(rows, columns).repartition(5)
    from pyspark.sql import functions as F

    for name in ("score", "ids", "component", "node", "part", "guest", "rank", "label", "kept", "copy_no", "row_no"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


@pytest.fixture(scope="session")
def none(documents):
    return documents.limit(0)
