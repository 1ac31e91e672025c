"""HTML, fingerprints, byte-pair coding and surrogates."""

import hashlib
import itertools
import random
import re
import time

import pytest

from pavelake.llm import bpe, fingerprint, html, pii

PAGE = """<html><head><title>t</title><style>p{}</style><script>var a="</p>"</script></head><body><header>Site name</header><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><aside>About us</aside><article><h1>Head &amp; tail</h1><p>First   block<b> bold</b>
next</p><p>Short.<p>Third &lt;b&gt; &eacute;<form>Search</form><section class="comments"><p>Nice post!</p></section></article><div id="sidebar">More</div><footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize("page,text", [
    (PAGE, "Head & tail\n\nFirst block bold next\n\nShort.\n\nThird <b> é"),
    (None, ""), ("", ""), ("<p> </p>", ""), ("plain", "plain"), ("a < b<br>c", "a < b\n\nc"), ("<article><p>cut off", "cut off"),
    ("<body><div class=menu>Home</div><div><p>A long text that is the body of this page.</p><p>ok</p></div><div class=footer>imprint</div>", "A long text that is the body of this page.\n\nok"),
])
def test_main_text(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("page,text", [
    # a closing note in a container of its own, behind an advert
    (f"<body><div><p>{'A long text that is the body of this page, with enough words to be one. ' * 9}</p></div><div class='ad'>Buy now</div><div><p>This closing note belongs to the text, short as it is.</p></div><div class=footer>imprint</div></body>",
     ('A long text that is the body of this page, with enough words to be one. ' * 9).strip() + "\n\nThis closing note belongs to the text, short as it is."),
    # names that only begin like something beside the text
    ("<article><p>One line of the text that is read.</p><p class='promo-code'>The code is SPRING for all readers.</p><div class='share-price'>The share price rose to 12.</div></article>",
     "One line of the text that is read.\n\nThe code is SPRING for all readers.\n\nThe share price rose to 12."),
    ("<article><p>One line of the text that is read.</p><div class='share-buttons'><a href=x>Post</a> <a href=y>Mail</a></div><div class='ad-slot'>Buy cheap watches</div><ul class='site-nav'><li>Home</ul></article>", "One line of the text that is read."),
])
def test_nothing_else_is_dropped(page, text):
    assert html.main_text(page) == text


def test_long_page():
    body = "\n\n".join(f"block {i} of it" for i in range(5000))
    assert html.main_text("<article>" + "".join(f"<p>{b}</p>" for b in body.split("\n\n")) + "</article>") == body


def test_extract(spark):
    d = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = html.extract(d).collect()
    assert len(got) == 3 and all(r.n_chars == len(r.text) for r in got)
    assert html.extract(d.limit(0)).count() == 0


LONG = "A long text that is the body of this page, with enough words to be one."


@pytest.mark.parametrize("page,text", [
    (f"<div id=page class='site no-sidebar'><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG}\n\n{LONG}"),
    (f"<div class='content has-sidebar'><p>{LONG}</p><p>ok</p></div>", f"{LONG}\n\nok"),
    (f"<div class='widget'><main><p>{LONG}</p></main></div>", LONG),
    (f"<body><form id=aspnetForm><div><p>{LONG}</p><p>ok</p></div></form></body>", f"{LONG}\n\nok"),
    ("<p>One</p><p title=don't>Two</p><p>Three</p>", "One\n\nTwo\n\nThree"),
    (f"<body><article class=card><p>teaser</p></article><div><p>{LONG}</p><p>{LONG}</p><p>end.</p></div></body>", f"{LONG}\n\n{LONG}\n\nend."),
    (f"<body><div><p>{LONG * 8}</p><div class=ad>Buy this now, it is a good thing to have</div><p>Closing words.</p></div></body>", f"{LONG * 8}\n\nClosing words."),
    ("<body><article><p>Hi.</p></article><footer>A footer that is much longer than the article of this page</footer></body>", "Hi."),
    (f"<body><div>{LONG}</div><div class=comments><article><p>{LONG * 9}</p></article></div></body>", LONG),
])
def test_what_holds_the_text_decides(page, text):
    assert html.main_text(page) == text


PLAIN = "<body>{0}<div><h1>Title</h1><p>{1}</p><p>short</p><p>{1}</p><p>End</p></div>{0}</body>".format("<div>Home</div><div>Login</div><div>About us</div><div>News</div>", LONG * 4)


def test_surge_and_dive_points_decide():
    """A page without articles, classes or links: only the distribution of text tells menus from the body."""
    body = f"Title\n\n{LONG * 4}\n\nshort\n\n{LONG * 4}\n\nEnd"
    assert html.main_text(PLAIN) == body
    assert html.main_text(PLAIN, rise=0) != body


def test_pages_take_linear_time():
    """Unclosed and stray tags, open quotes: forty times the page in far less than forty squared the time."""
    for piece in ("<div>", "<p>x", "<b>y</i>", '<a title="', "<svg/>", "<", "<a ='\"=' "):
        began = time.time()
        html.main_text(piece * 40_000)
        assert time.time() - began < 3, piece


def runs_by_hand(lengths, window, level):
    """A line is in a run if it weighs anything and some window of lines that it lies in is dense."""
    n = len(lengths)
    dense = [set(range(max(0, z - window), z)) for z in range(1, n + 1) if sum(lengths[max(0, z - window) : z]) > level]
    on = [lengths[i] > 0 and any(i in d for d in dense) for i in range(n)]
    return [list(g) for k, g in itertools.groupby(range(n), on.__getitem__) if k]


def test_runs():
    assert html.runs([0, 5, 0, 0, 0, 4, 4], 2) == [(1, 2), (5, 7)]
    rng = random.Random(3)
    for _ in range(300):
        lengths = [rng.choice((0, 1, 5, 60)) for _ in range(rng.randrange(30))]
        window, level = rng.randrange(1, 5), rng.choice((0, 3, 20, 61))
        assert [list(range(a, z)) for a, z in html.runs(lengths, window, level)] == runs_by_hand(lengths, window, level)


def lz(text):
    known, phrase = set(), ""
    for c in text:
        phrase += c
        if phrase not in known:
            known.add(phrase)
            phrase = ""
    return known


def test_phrases():
    known = {}
    fingerprint.parse("abababababcabc", known)
    assert set(known) == lz("abababababcabc")


def in_order(spark, rows):
    """No id first, then by id, by hash of the text, by text."""
    hashed = spark.createDataFrame([(i, r[1] or "") for i, r in enumerate(rows)], "i int, t string").selectExpr("i", "xxhash64(t) h").collect()
    mark = {r.i: r.h for r in hashed}
    return [r for i, r in sorted(enumerate(rows), key=lambda x: (x[1][0] is not None, x[1][0] or 0, mark[x[0]], x[1][1] is not None, x[1][1] or ""))]


@pytest.mark.parametrize("reuse,parts", [("true", "4"), ("false", "4"), ("true", "40")])
def test_fingerprints(spark, docs, rows, reuse, parts):
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        check_fingerprints(spark, docs, rows)
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_no_ids_and_repeated_rows(spark):
    rows = [(None, f"text {i} of none") for i in range(200)] + [(5, f"text {i % 3} of five") for i in range(100)] + [(None, None)] * 3
    check_fingerprints(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def check_fingerprints(spark, docs, rows):
    ordered = in_order(spark, rows)
    got = fingerprint.with_next(docs).collect()
    assert len(got) == len(rows)
    expected = []
    for r, nxt in zip(ordered, ordered[1:] + ordered[:1]):
        text, other = r[1] or "", nxt[1] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + other[:q]
        expected.append((str(r[0]), len(text), hashlib.sha256(edited.encode()).hexdigest()))
        mine = fingerprint.fingerprints(text, other, fingerprint.BINS)
        whole = fingerprint.fingerprints(edited, "", fingerprint.BINS)[0]
        assert (mine[1] == whole).all() and mine[2] == edited
        a, b = lz(text), lz(edited)
        if len(a | b) > 150:
            assert abs(fingerprint.likeness(mine[0], mine[1]) - len(a & b) / len(a | b)) < 0.2
    assert sorted((str(g.doc_id), g.n_chars, g.edited_sha256) for g in got) == sorted(expected)
    texts = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    prints = {}
    for g in got:
        if g.doc_id is not None and len({r[1] for r in rows if r[0] == g.doc_id}) == 1:
            assert prints.setdefault(texts[g.doc_id], g.fingerprint) == g.fingerprint
    assert all(0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1 for g in got)


def test_fingerprints_small(spark, empty):
    assert fingerprint.with_next(empty).count() == 0
    one = fingerprint.with_next(spark.createDataFrame([(1, "alone in the world")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_tokens_are_exact(docs, rows):
    from tokenizers import Tokenizer

    path = bpe.default_tokenizer()
    t = Tokenizer.from_file(path)
    got = bpe.encode(docs, path, chunk_words=4).collect()
    texts = {r[0]: r[1] or "" for r in rows}
    assert len(got) == len(rows)
    for g in got:
        if g.doc_id is not None:
            ids = t.encode(texts[g.doc_id], add_special_tokens=False).ids
            assert g.ids == ids and g.n_tokens == len(ids) and g.decoded == texts[g.doc_id]
            assert g.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert g.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    assert all(back[i] == x for i, x in texts.items() if i is not None)


def test_joins_are_repaired():
    c = bpe.Coder(bpe.default_tokenizer())
    rows = [["un", "happy words", " here"]]  # a cut inside a word must be merged again
    c.learn(rows)
    fixed = c.repair(rows)
    assert "".join(fixed[0]) == "unhappy words here"


def test_no_tokens(empty):
    assert bpe.encode(empty, bpe.default_tokenizer()).count() == 0


PERSONAL = [
    (1, "Write to Jo.Doe42@mail7.example.com or JO.DOE42@MAIL7.example.com, call +1 (017) 555-7713 or +1-017-555-7713."),
    (2, 'ip 97.51.17.173, 97.51.17.174; token = "04dbebab91ab85687d33eeaaf9" password=e3b3ed3cc8548923d6'),
    (3, "Mr. John Smith and Mrs. Anna Smith, card 4111 1111 1111 1111 or 4111111111111111, 123-45-6789"),
    (4, None), (5, ""), (6, "clean text 12 3.4 of 1999, v1.2.3 a@b"), (3, "same id, mail x@y.org"), (None, "x@y.org"), (7, "﷐ ﷒ x@y.org"),
]


@pytest.fixture(scope="module")
def replaced(spark):
    d = spark.createDataFrame([(i, t, 1, "n") for i, t in PERSONAL], "doc_id long, text string, kind int, names string")
    return [(r.doc_id, r.text, r.n_entities) for r in pii.replace(d, "k").collect()]


def test_surrogates(replaced):
    by = {(i, n): t for i, t, n in replaced}
    mail = re.findall(r"[\w.]+@[\w.]+(?=[ ,])", by[1, 4])
    assert mail[0].lower() == mail[1].lower() != "jo.doe42@mail7.example.com" and mail[0].endswith(".com")
    phones = [re.sub(r"\D", "", p) for p in re.findall(r"\+1[ (-][\d() -]+", by[1, 4])]
    assert phones[0] == phones[1] and "5557713" not in phones[0]
    assert len(set(re.findall(r"\d+\.\d+\.\d+\.\d+", by[2, 4]))) == 2 and "97.51.17.17" not in by[2, 4]
    assert re.search(r'token = "[0-9a-f]{26}"', by[2, 4]) and "04dbebab" not in by[2, 4]
    people = re.search(r"Mr\. (\w+) (\w+) and Mrs\. (\w+) (\w+),", by[3, 5])
    assert people[2] == people[4] != "Smith" and people[3].endswith("a")
    cards = [re.sub(r"\D", "", c) for c in re.findall(r"\d{4} ?\d{4} ?\d{4} ?\d{4}", by[3, 5])]
    digits = [int(c) for c in cards[0]][::-1]
    assert cards[0] == cards[1] and (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def test_clean_texts_stay(replaced):
    by = {i: (t, n) for i, t, n in replaced}
    assert by[4] == (None, 0) and by[5] == ("", 0) and by[6] == (PERSONAL[5][1], 0)
    assert by[7][0] == PERSONAL[8][1]
    assert {t for _, t, n in replaced if t and "same id" in t}.pop().endswith([t for i, t, _ in replaced if i is None][0])


def test_surrogates_stay_distinct(spark):
    d = spark.createDataFrame([(i, f"ip {i % 10}.{i // 10 % 10}.{i // 100}.1") for i in range(1000)], "doc_id long, text string")
    got = [r.text for r in pii.replace(d, "k").collect()]
    assert len(set(got)) == 1000


def test_no_documents(empty):
    assert pii.replace(empty, "k").count() == 0
