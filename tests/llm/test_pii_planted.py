"""Surrogates against texts whose entities are known: what was planted is replaced, each as its type demands, the rest stays."""

import random
import re

import pytest

from pavelake.llm import pii

#: maker, form of a surrogate, what tells two values apart
TYPES = {
    "email": (lambda r: f"{word(r)}.{word(r)}@{word(r)}.org", r"[a-z]+\.[a-z]+@[a-z]+\.org", str.lower),
    "secret": (lambda r: "".join(r.choice("0123456789abcdef") for _ in range(24)), r"[0-9a-f]{24}", str),
    "jwt": (lambda r: f"{word(r)}{word(r)}.{word(r)}{word(r)}.{word(r)}{word(r)}", r"[a-z]+\.[a-z]+\.[a-z]+", str),
    "ip": (lambda r: ".".join(str(r.randrange(256)) for _ in range(4)), pii._OCTET + rf"(\.{pii._OCTET}){{3}}", str),
    "ip6": (lambda r: ":".join(f"{r.randrange(65536):04x}" for _ in range(8)), r"[0-9a-f]{4}(:[0-9a-f]{4}){7}", str.lower),
    "short ip6": (lambda r: f"2001:db8::{r.randrange(1, 65536):04x}", r"\d{4}:[a-f]{2}\d::[0-9a-f]{4}", str.lower),
    "national": (lambda r: f"{r.randrange(100, 999)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}", r"\d{3}-\d\d-\d{4}", lambda x: re.sub(r"\D", "", x)),
    "ssn": (lambda r: f"{r.randrange(10**8, 10**9)}", r"\d{9}", str),
    "passport": (lambda r: f"C{r.randrange(10**7, 10**8)}", r"[A-Z]\d{8}", str),
    "e164": (lambda r: f"+1415555{r.randrange(1000, 9999)}", r"\+1\d{10}", str),
    "phone": (lambda r: f"+49 30 {r.randrange(10**6, 10**7)}", r"\+4\d \d\d \d{7}", lambda x: re.sub(r"\D", "", x)),
    "us phone": (lambda r: f"555 {r.randrange(100, 999)} {r.randrange(1000, 9999)}", r"\d{3} \d{3} \d{4}", lambda x: re.sub(r"\D", "", x)),
    "name": (lambda r: f"{word(r).title()} {word(r).title()}", r"[A-Z][a-z]+ [A-Z][a-z]+", str.lower),
}
BEFORE = {"secret": "password=", "jwt": "token: ", "ssn": "SSN: ", "passport": "passport number ", "name": "My name is "}


def word(r):
    return "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randrange(2, 4)))


@pytest.fixture(scope="module")
def planted():
    """Texts as lists of plain pieces and (type, value), with values shared between texts."""
    r = random.Random(4)
    values = {t: [make(r) for _ in range(12)] for t, (make, _, _) in TYPES.items()}
    texts = []
    for _ in range(150):
        parts = [f"Some {word(r)} text,"]
        for _ in range(r.randrange(1, 5)):
            t = r.choice(list(TYPES))
            value = r.choice(values[t])
            if t in ("email", "ip6") and r.random() < 0.3:
                value = value.upper()
            parts += [f" {word(r)} " + BEFORE.get(t, ""), (t, value), f" then {word(r)},"]
        texts.append(parts)
    return texts + [[f"{word(r)} std::{word(r)} A::B, 12:30:15 {r.randrange(100)} of 3.5, Dr. no, v1.2.3"] for _ in range(20)]


def test_planted_entities(spark, planted):
    texts = ["".join(p if isinstance(p, str) else p[1] for p in parts) for parts in planted]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[1]), (7, None), (8, "")]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, uid string, parts int").repartition(5)
    got = sorted(pii.replace(d, "one key").collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.text is None, r.text or ""))
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_entities): r.text for r in got}
    assert by[7, 0] is None or by[8, 0] == ""
    found = {}
    for i, parts in enumerate(planted):
        n = sum(isinstance(p, tuple) for p in parts)
        pattern = "".join(re.escape(p) if isinstance(p, str) else "(.+?)" for p in parts)
        m = re.fullmatch(pattern, by[i, n])
        assert m, (texts[i], [r.text for r in got if r.doc_id == i])
        for (t, value), new in zip((p for p in parts if isinstance(p, tuple)), m.groups()):
            same, form = TYPES[t][2], TYPES[t][1]
            assert re.fullmatch(form, new.lower() if value.isupper() and value != value.lower() and t != "passport" else new), (t, value, new)
            assert found.setdefault((t, same(value)), same(new)) == same(new)
    for t in TYPES:
        made = [v for (k, _), v in found.items() if k == t]
        assert len(set(made)) == len(made) and not set(made) & {v for k, v in found if k == t}


def test_key_decides(spark):
    d = spark.createDataFrame([(1, "mail jo.doe@example.com")], "doc_id long, text string")
    one, again, other = (pii.replace(d, k).first().text for k in ("a", "a", "b"))
    assert one == again != other
    assert pii.run_key(spark) != pii.run_key(spark)


def test_a_hot_entity(spark):
    d = spark.createDataFrame([(i, f"text {i}: mail jo.doe@example.com") for i in range(3000)] + [(i, "none") for i in range(500)], "doc_id long, text string").repartition(8)
    got = pii.replace(d, "k")
    assert got.filter("n_entities = 1").select(pii.F.regexp_extract("text", r"mail (\S+)", 1)).distinct().count() == 1 and got.count() == 3500
