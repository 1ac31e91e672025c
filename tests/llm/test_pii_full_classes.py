"""Surrogates of shape classes that are nearly full: all different, none a real entity, type and format kept; letters with marks."""

import itertools
import re

import pytest

from pavelake.llm import pii


@pytest.fixture(autouse=True)
def few_rounds(monkeypatch):
    """Two rounds of hashes, so that the rank decides after few jobs."""
    monkeypatch.setattr(pii.assign, "__defaults__", (2,))


def replaced(spark, texts):
    got = pii.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()
    return [r.text for r in sorted(got, key=lambda r: r.doc_id)]


def test_names_of_two_letters(spark):
    names = [a + "i" for a in "BCDFGHJKLMNPQRSTVWXZ"]
    got = [t.removeprefix("Mr ").removesuffix(" came") for t in replaced(spark, [f"Mr {n} came" for n in names])]
    assert len(set(got)) == len(names) and not set(got) & set(names)
    assert all(re.fullmatch(r"[A-Z][a-z]{1,2}", n) and n.endswith("i") for n in got)


def test_most_addresses_of_one_shape(spark):
    real = [".".join(x) for x in itertools.product("0123456789", repeat=4)][:6000]
    got = [t.removeprefix("ip ") for t in replaced(spark, [f"ip {a}" for a in real])]
    assert len(set(got)) == len(real) and not set(got) & set(real)
    assert all(re.fullmatch(rf"{pii._OCTET}(\.{pii._OCTET}){{3}}", a) for a in got)


def test_small_mails_and_secrets(spark):
    mails = [f"{a}@{b}.de" for a in "aeiou" for b in "aeiou"]
    got = replaced(spark, [*(f"to {m} now" for m in mails), "token=--------"])
    assert len(set(got)) == 26 and not {x[3:-4] for x in got} & set(mails)
    assert all(re.fullmatch(r"to [aeiou]\d?@[aeiou]\.de now", x) for x in got[:-1]) and re.fullmatch(r"token=--------\d", got[-1])


@pytest.mark.parametrize("name", ["Öäåéü", "Łżčšž", "Yyyyy", "Йёъьй", "Ώάέήί", "Աբգդե"])
def test_letters_with_marks(spark, name):
    got = replaced(spark, [f"Mrs {name} came", "Mrs Anna came"])[0].split(" ")[1]
    assert len(got) == len(name) and got[-1] == name[-1] and got[0].isupper() and got[1:].islower()
    assert sum(a != b for a, b in zip(got.lower()[:-1], name.lower()[:-1])) >= 2
