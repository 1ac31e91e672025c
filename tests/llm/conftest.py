import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid long, digest string, key string, score double, kept boolean"


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, share):
    parts = text.split(" ")
    for i in range(len(parts)):
        if rng.random() < share:
            parts[i] = f"x{rng.randrange(10**6)}"
    return " ".join(parts)


def texts():
    """Null, empty, blank, short, long, repeated, near and shared texts."""
    rng = random.Random(5)
    base = [words(rng, rng.randrange(20, 120)) for _ in range(24)]
    passage = words(rng, 60)
    out = [None, "", "  \n\t ", "one", "one two three", "ONE two Three", "é ü ñ", "A b  c\nD\te", "a b c d"]
    out += base + base[:6] + [b.upper() for b in base[:3]]
    out += [edited(rng, b, 0.01) for b in base[6:16] for _ in range(3)]
    out += [f"{words(rng, 20)} {passage} {words(rng, 15)}" for _ in range(5)]
    out += [words(rng, 12000), ("aa " * 300).strip(), ("la li lu " * 40).strip(), passage]
    return out


@pytest.fixture(scope="session")
def rows():
    found = texts()
    out = [(i, t, "en", (None, "b", "a", "ä", "a")[i % 5], len(t or ""), 7, "d", "k", 0.5, True) for i, t in enumerate(found)]
    return out + [out[12], (None, "no id at all", "en", "a", 12, 7, "d", "k", 0.5, True), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder(spark, rows, tmp_path_factory):
    """Parquet tables as the queries read them, with the ids distinct and filled."""
    d = str(tmp_path_factory.mktemp("sf"))
    distinct = [r for i, r in enumerate(rows) if r[0] is not None and r[0] not in [x[0] for x in rows[:i]]]
    spark.createDataFrame(distinct, SCHEMA).coalesce(2).write.parquet(f"{d}/documents.parquet")
    rng = random.Random(9)
    labelled = [(10_000 + i, words(rng, 60, 300) + (" vile idiotish scumword" if i % 4 == 0 else "") + (" %%% @@@ !!!" * 20 if i % 3 == 0 else ""), int(i % 3 > 0), int(i % 4 == 0)) for i in range(400)]
    more = spark.createDataFrame([(i, t, "en", "s", len(t), 0, "", "", 0.0, True) for i, t, _, _ in labelled], SCHEMA)
    more.coalesce(1).write.mode("append").parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, q, x) for i, _, q, x in labelled] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, "u", "<article><p>Hi</p></article>"), (1, None, None)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{d}/pages.parquet")
    return d
