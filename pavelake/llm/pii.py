"""Surrogates for personal data, in DataFrame operations only.

One regular expression with a group for each type finds e-mail addresses, secrets after password= or
token=, IP addresses of both versions, IBANs, card numbers, national and passport numbers, telephone numbers and names after an
honorific or "name is". Mentions are reduced to a canonical value (case and separators aside), so mentions of one entity
share a surrogate in the whole corpus. A surrogate is made from a keyed hash of the canonical value, character by
character: digits give digits, vowels vowels, consonants consonants of the same script, letters with marks such letters; what tells the type stays
(top-level domain, country code, first card digit, a name's last letter, which carries its gender).
Card numbers keep a valid check digit, octets stay octets, hex strings stay hex. It is then
written in the mention's own format and case. The key is the caller's; without it surrogates can't be foretold.

Collision checks: no surrogate may equal another entity's surrogate or any entity found in the corpus;
losers get a new surrogate in the next round. What a small shape class has not told apart after ROUNDS rounds takes
the free values of its class by rank, in an order that hangs on the key, and where a class is full, those of
a shape with one more sign (a longer octet, a longer name). So different entities stay different.

Every text is searched once and kept in parts in a checkpoint; only texts with entities are shuffled. Entities are distinct values,
each with the number of its mentions, by which the join back to the texts splits hot ones.

Defined results: null text stays null; empty texts and those without entities stay as they are; very long texts are searched
in whole; rows equal in doc_id and text get equal results; texts that hold all four noncharacters U+FDD0 to U+FDD3 are left alone; columns other
than doc_id and text are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import secrets
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, join_counted, row_mark, table

ROUNDS = 16
WIDEST = 32
TYPES = ("email", "secret", "ip", "iban", "card", "national", "phone", "name", "ip6")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_OCTET_REST = r"(?:(?<=2)5[0-5]|(?<=2)[0-4]\d|(?<=1)\d\d|(?<=[1-9])\d|)(?!\d)"
_TITLES = r"Mr|Mrs|Ms|Miss|Dr|Doctor|Prof|Professor|Herr|Frau|Mme|Monsieur|Madame|Mademoiselle|Sr|Sra|Señor|Señora|Доктор|Господин|Госпожа|Κύριος|Κυρία|name is|Name ist|m'appelle|me llamo|Me llamo|зовут"
_HEX = "[0-9A-Fa-f]{1,4}"
# each begins with a cheap test of one or two characters, so that most places of a text fail at once
PATTERNS = (
    r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){0,6}\.\p{L}{2,24}",
    r"(?<=[=:\"'] {0,3})[A-Za-z0-9+/_-](?<=(?i:password|passwd|pwd|token|secret|api_key|apikey|api-key)[ \t]{0,3}[=:][ \t]{0,3}[\"']?.)[A-Za-z0-9+/_-]{7,}(?:\.[A-Za-z0-9+/_-]{4,}){0,4}",
    rf"\d(?<![\d.].){_OCTET_REST}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    r"[A-Z](?<![\p{L}\p{N}].)[A-Z]\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    r"\d(?<![\p{L}\p{N}].)(?:\d{12,18}|\d{3}(?: \d{4}){3}|\d{3}(?:-\d{4}){3})(?![\p{L}\p{N}])",
    r"[A-Z\d](?<![\p{L}\p{N}-].)(?:(?<=\d)\d{2}-\d{2}-\d{4}|(?<=(?i:ssn|social security number)[:#]? {0,2}.)\d{8}|(?<=(?i:passport|passport no\.?|passport number)[:#]? {1,2}.)[A-Z0-9]{5,8})(?![\p{L}\p{N}-])",
    r"[+(\d](?<![\p{L}\p{N}+].)(?:(?<=\+)\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|(?<=\d)\d{0,2}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|(?<=\()\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|(?<=\+)\d{1,3}(?:[ .-]\d{2,4}){2,5}|(?<=\+)(?=(?:\d[ .-]?){8,15}(?!\d))\d{1,3}(?:[ .-]?\d{1,8}){1,5}|(?<=\d)\d{2}(?:[.-]\d{3}[.-]| \d{3} )\d{4})(?!\d)",
    rf"\p{{Lu}}(?<= .)(?<=(?<!\p{{L}})(?:{_TITLES})\.? .)\p{{Ll}}+(?:[ -]\p{{Lu}}\p{{Ll}}+){{0,2}}",
    rf"[0-9A-Fa-f](?<![\p{{L}}\p{{N}}:.].)(?:[0-9A-Fa-f]{{0,3}}(?::{_HEX}){{7}}|(?:(?<=\d)[0-9A-Fa-f]{{3}}|[0-9A-Fa-f]{{0,2}}\d[0-9A-Fa-f]{{0,2}}(?<=[0-9A-Fa-f]{{4}}))(?::{_HEX}){{0,6}}::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![\p{{L}}\p{{N}}:])",
)
PATTERN = "|".join(f"({p})" for p in PATTERNS)
#: letters that stand for letters of their own kind
LETTERS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюя", "бвгджзклмнпрстфхцчш", "αειουηω", "βγδζθκλμνξπρστφχψ")
DIGITS = "0123456789"


def _marked() -> list[str]:
    """Lower-case letters beyond LETTERS whose case can be turned, by script; Latin vowels apart."""
    found: dict[tuple, str] = {}
    for c in map(chr, range(0xDF, 0x587)):
        if unicodedata.category(c) == "Ll" and len(c.upper()) == 1 and c.upper().lower() == c != c.upper() and not any(c in x for x in LETTERS):
            vowel = unicodedata.normalize("NFD", c)[0] in "aeiouæøœ"
            script = unicodedata.name(c).split(" ")[0]
            if script in ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN"):
                found[script, vowel] = found.get((script, vowel), "") + c
    return list(found.values())


MARKED = _marked()
_MARK, _OTHER = ("﷐", "﷑"), ("﷒", "﷓")


def found(text: Column) -> Column:
    """The text in parts: every second one is an entity, its groups parted by the second mark."""
    first = F.instr(text, _MARK[0]) + F.instr(text, _MARK[1]) == 0
    second = F.instr(text, _OTHER[0]) + F.instr(text, _OTHER[1]) == 0

    def parts(marks):
        groups = marks[1].join(f"${i + 1}" for i in range(len(TYPES)))
        return F.split(F.regexp_replace(text, F.lit(PATTERN), F.lit(f"{marks[0]}{groups}{marks[0]}")), marks[0])

    def typed(marks):
        def one(part, i):
            groups = F.split(part, marks[1])
            kind = F.array_position(F.transform(groups, lambda g: g != ""), True).cast("int")
            return F.when(i % 2 == 0, F.struct(F.lit(0).alias("kind"), part.alias("value"))).otherwise(F.struct(kind.alias("kind"), F.array_join(groups, "").alias("value")))

        return F.transform(parts(marks), one)

    alone = F.array(F.struct(F.lit(0).alias("kind"), text.alias("value")))
    return F.when(first, typed(_MARK)).when(second, typed(_OTHER)).otherwise(alone)


def canonical(kind: Column, value: Column) -> Column:
    """Case and separators aside, except where they matter (secrets, dots of addresses)."""
    bare = F.regexp_replace(value, r"[^\p{L}\p{N}+]", "")
    return (
        F.when(kind == 2, value)
        .when(kind.isin(1, 3, 9), F.lower(value))
        .when(kind == 8, F.lower(F.regexp_replace(value, r"[^\p{L}]+", " ")))
        .otherwise(bare)
    )


def _noise(seed: Column, i: Column, most: int) -> Column:
    """A number below `most` for place i, from the hash of the seed and a block number."""
    block = F.sha2(F.concat_ws("|", seed, F.floor(i / 15).cast("string")), 256)
    return F.pmod(F.conv(F.substr(block, (i % 15) * 4 + 1, F.lit(4)), 16, 10).cast("int"), F.lit(most))


def _alphabet(low: Column) -> Column:
    """The signs that may stand for a sign in lower case; the sign itself if it stays."""
    out = F.when(low.rlike("^[0-9]$"), DIGITS)
    for letters in LETTERS:
        out = out.when(F.instr(F.lit(letters), low) > 0, letters)
    out = out.when(F.octet_length(low) == 1, low)
    for letters in MARKED:
        out = out.when(F.instr(F.lit(letters), low) > 0, letters)
    return out.otherwise(low)


def _letter(c: Column, seed: Column, i: Column) -> Column:
    draw = lambda x: F.when(F.length(x) <= 1, x).otherwise(F.substr(x, _noise(seed, i, F.length(x)) + 1, F.lit(1)))
    return F.transform(F.array(_alphabet(F.lower(c))), draw)[0]


def _luhn(digits: Column) -> Column:
    """Check sum of a digit string; the last digit is not doubled."""

    def add(total, d, i):
        n = d.cast("int")
        return total + F.when(i % 2 == 1, F.when(n > 4, n * 2 - 9).otherwise(n * 2)).otherwise(n)

    turned = F.filter(F.split(F.reverse(digits), ""), lambda x: x != "")
    pairs = F.transform(turned, lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    return F.aggregate(pairs, F.lit(0), lambda acc, x: add(acc, x["d"], x["i"]))


def _stays(kind: Column, canon: Column):
    """Whether the sign at place i tells the type."""
    tail = F.length(canon) - F.length(F.substring_index(canon, ".", -1)) - 1  # the top-level domain begins after it
    return lambda i: ((kind == 1) & (i >= tail)) | ((kind == 4) & (i < 2)) | ((kind == 5) & (i == 0)) | ((kind == 7) & F.startswith(canon, F.lit("+")) & (i < 2))


def _in_hex(kind: Column, canon: Column) -> Column:
    return (kind == 9) | ((kind == 2) & canon.rlike("^[0-9a-fA-F]+$"))


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """A candidate of the same type and shape as the canonical value."""
    seed = F.concat_ws("|", F.lit(key), kind.cast("string"), canon, attempt.cast("string"))
    n = F.length(canon)
    chars = F.filter(F.split(canon, ""), lambda x: x != "")
    stays = _stays(kind, canon)
    usual = F.array_join(F.transform(chars, lambda c, i: F.when(stays(i), c).when(c.rlike("^[A-Z]$"), F.upper(_letter(c, seed, i))).otherwise(_letter(c, seed, i))), "")
    hexes = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), _noise(seed, i, 10).cast("string")).when(c.rlike("[a-f]"), F.substr(F.lit("abcdef"), _noise(seed, i, 6) + 1, F.lit(1))).when(c.rlike("[A-F]"), F.substr(F.lit("ABCDEF"), _noise(seed, i, 6) + 1, F.lit(1))).otherwise(c)), "")
    octet = lambda o, i: F.when(F.length(o) == 1, _noise(seed, i, 10)).when(F.length(o) == 2, 10 + _noise(seed, i, 90)).otherwise(100 + _noise(seed, i, 155)).cast("string")
    address = F.array_join(F.transform(F.split(canon, "\\."), octet), ".")
    # each word of a name has a surrogate of its own, so a family name keeps it beside any given name
    word = lambda w: F.array_join(F.transform(F.filter(F.split(w, ""), lambda x: x != ""), lambda c, i: F.when(i == F.length(w) - 1, c).otherwise(_letter(c, F.concat_ws("|", F.lit(key), w, attempt.cast("string")), i))), "")
    name = F.array_join(F.transform(F.split(canon, " "), word), " ")
    body = F.substr(usual, F.lit(1), n - 1)
    fixed = F.concat(body, F.pmod(10 - F.pmod(_luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string"))
    card = F.when(F.pmod(_luhn(canon), F.lit(10)) == 0, fixed).otherwise(usual)
    return F.when(_in_hex(kind, canon), hexes).when(kind == 3, address).when(kind == 5, card).when(kind == 8, name).otherwise(usual)


def shape(kind: Column, canon: Column, more: Column) -> Column:
    """Alphabets of all places, with `more` places added after the first sign; of an address the lengths of its octets."""
    chars = F.filter(F.split(canon, ""), lambda x: x != "")
    stays, hexes, n = _stays(kind, canon), _in_hex(kind, canon), F.length(canon)
    sums = (kind == 5) & (F.pmod(_luhn(canon), F.lit(10)) == 0)
    ends = lambda i: (kind == 8) & F.substr(canon, i + 2, F.lit(1)).isin("", " ")

    def places(c, i):
        hexed = F.when(c.rlike("[0-9]"), DIGITS).when(c.rlike("[a-f]"), "abcdef").when(c.rlike("[A-F]"), "ABCDEF").otherwise(c)
        usual = F.when(c.rlike("^[A-Z]$"), F.upper(_alphabet(F.lower(c)))).otherwise(_alphabet(F.lower(c)))
        return F.when(stays(i) | ends(i), c).when(sums & (i == n - 1), "0").when(hexes, hexed).otherwise(usual)

    first = F.when(kind == 4, 4).otherwise(F.length(F.regexp_extract(canon, r"^[^\p{L}\p{N}]*[\p{L}\p{N}]?", 0)))
    vowels = F.when(canon.rlike(r"^\p{IsCyrillic}"), LETTERS[2]).when(canon.rlike(r"^\p{IsGreek}"), LETTERS[4]).otherwise(LETTERS[0])
    added = F.array_repeat(F.when(kind == 8, vowels).otherwise(DIGITS), more)
    usual = F.transform(chars, places)
    usual = F.concat(F.slice(usual, F.lit(1), first), added, F.slice(usual, first + 1, F.greatest(n - first, F.lit(0))))
    lengths = F.transform(F.split(canon, "\\."), F.length)
    before = lambda i: 3 * i - F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda t, x: t + x)
    octets = F.transform(lengths, lambda x, i: (x + F.least(3 - x, F.greatest(more - before(i), F.lit(0)))).cast("string"))
    return F.struct(F.when(kind == 3, octets).otherwise(usual).alias("places"), sums.alias("sums"))


def _sizes(kind: Column, places: Column) -> Column:
    return F.transform(places, lambda a: F.when(kind != 3, F.length(a)).when(a == "1", 10).when(a == "2", 90).otherwise(155).cast("long"))


def capacity(kind: Column, places: Column) -> Column:
    """The number of values of a shape; above 10**12 a divisor of it."""
    return F.aggregate(_sizes(kind, places), F.lit(1).cast("long"), lambda n, x: F.when(n > 10**12, n).otherwise(n * x))


def numbered(kind: Column, shaped: Column, index: Column) -> Column:
    """The value of a shape with this number."""
    start = F.struct(index.cast("long").alias("rest"), F.array().cast("array<long>").alias("out"))
    step = lambda acc, x: F.struct(((acc["rest"] - acc["rest"] % x) / x).cast("long").alias("rest"), F.concat(acc["out"], F.array(acc["rest"] % x)).alias("out"))
    at = F.aggregate(_sizes(kind, shaped["places"]), start, step, lambda acc: acc["out"])
    both = F.arrays_zip(shaped["places"].alias("a"), at.alias("d"))
    octet = lambda x: (x["d"] + F.when(x["a"] == "1", 0).when(x["a"] == "2", 10).otherwise(100)).cast("string")
    usual = F.array_join(F.transform(both, lambda x: F.substr(x["a"], x["d"].cast("int") + 1, F.lit(1))), "")
    body = F.substr(usual, F.lit(1), F.length(usual) - 1)
    fixed = F.concat(body, F.pmod(10 - F.pmod(_luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string"))
    return F.when(kind == 3, F.array_join(F.transform(both, octet), ".")).when(shaped["sums"], fixed).otherwise(usual)


def by_rank(left: DataFrame, entities: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """kind, canon, made of all entities: those left get the free values of their shape class by rank."""
    most = 2 * entities.count()  # so many values of a class can be taken
    left = left.select("kind", "canon", F.lit(0).alias("more"))
    keyed = lambda *c: F.sha2(F.concat_ws("|", F.lit(key), *c), 256)
    for _ in range(WIDEST):
        kind = F.col("kind")
        mine = left.withColumn("shape", shape(kind, F.col("canon"), F.col("more"))).withColumn("class", F.sha2(F.to_json("shape"), 256))
        mine = cut(mine.withColumn("rank", F.row_number().over(Window.partitionBy("kind", "class").orderBy(keyed("canon"), "canon"))))
        classes = mine.groupBy("kind", "class").agg(F.first("shape").alias("shape"), F.count(F.lit(1)).alias("wanted")).withColumn("n", capacity(kind, F.col("shape.places")))
        offset = F.conv(F.substr(keyed("class"), F.lit(1), F.lit(9)), 16, 10).cast("long")
        tried = classes.withColumn("offset", offset).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.least("n", F.lit(most)) - 1)))
        # the factor is a prime above all sizes of alphabets, so every number comes once
        tried = tried.withColumn("made", numbered(kind, F.col("shape"), F.pmod(F.col("j") * 1_000_003 + F.col("offset"), F.col("n"))))
        taken = entities.select("kind", F.col("canon").alias("made")).unionByName(done.select("kind", "made"))
        free = tried.join(taken, ["kind", "made"], "left_anti").withColumn("rank", F.row_number().over(Window.partitionBy("kind", "class").orderBy("j")))
        got = cut(mine.join(free.select("kind", "class", "rank", "made"), ["kind", "class", "rank"], "left"))
        # values that two classes have in common go to one of them
        one = got.filter("made is not null").groupBy("kind", "made").agg(F.min("canon").alias("canon"), F.lit(True).alias("first"))
        got = got.join(one, ["kind", "made", "canon"], "left")
        done = cut(done.unionByName(got.filter("first").select("kind", "canon", "made")))
        left = cut(got.filter("first is null").select("kind", "canon", (F.col("more") + F.col("made").isNull().cast("int")).alias("more")))
        if left.isEmpty():
            return done
    raise ValueError(f"more entities of a shape than surrogates: {left.first()}")


def written(kind: Column, value: Column, made: Column) -> Column:
    """The surrogate in the format and case of the mention; what it has more of follows the first sign."""
    signs = F.filter(F.split(F.regexp_replace(made, r"[^\p{L}\p{N}]", ""), ""), lambda x: x != "")
    chars = F.filter(F.split(value, ""), lambda x: x != "")
    over = F.size(signs) - F.length(F.regexp_replace(value, r"[^\p{L}\p{N}]", ""))
    anchor = F.when(kind == 4, 4).otherwise(1)
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(acc, c):
        new = F.coalesce(F.try_element_at(signs, acc["k"]), c)
        new = F.when((c == F.upper(c)) & (c != F.lower(c)), F.upper(new)).otherwise(new)
        sign = c.rlike(r"^[\p{L}\p{N}]$")
        here = sign & (acc["k"] == anchor) & (over > 0)
        extra = F.when(here, F.array_join(F.slice(signs, anchor + 1, F.greatest(over, F.lit(0))), "")).otherwise("")
        return F.struct(F.concat(acc["out"], F.when(sign, new).otherwise(c), extra).alias("out"), (acc["k"] + sign.cast("int") + F.when(here, over).otherwise(0)).alias("k"))

    return F.when(kind.isin(2, 3), made).when(kind == 9, F.when(value == F.upper(value), F.upper(made)).otherwise(made)).otherwise(F.aggregate(chars, start, step, lambda acc: acc["out"]))


def assign(entities: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """kind, canon, made: surrogates of distinct entities, all different, none of them an entity."""
    entities = cut(entities)
    done = None
    open_ = entities.withColumn("attempt", F.lit(0))
    for _ in range(rounds):
        tried = open_.withColumn("made", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key))
        first = tried.groupBy("kind", "made").agg(F.min("canon").alias("one"))
        tried = tried.join(first, ["kind", "made"]).join(entities.select("kind", F.col("canon").alias("made"), F.lit(True).alias("real")), ["kind", "made"], "left")
        if done is not None:
            tried = tried.join(done.select("kind", "made", F.lit(True).alias("used")), ["kind", "made"], "left")
        else:
            tried = tried.withColumn("used", F.lit(None).cast("boolean"))
        tried = cut(tried.withColumn("good", (F.col("one") == F.col("canon")) & F.col("real").isNull() & F.col("used").isNull()))
        good = tried.filter("good").select("kind", "canon", "made")
        done = good if done is None else done.unionByName(good)
        open_ = tried.filter("not good").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        if open_.isEmpty():
            return done
    return by_rank(open_, entities, done, key)


def replace(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text, n_entities: the texts with surrogates made with this key.

    Texts are parted once, and kept with their parts; mentions, names and texts without entities are all read from there.
    """
    parsed = cut(docs.select("doc_id", F.when(F.col("text").isNotNull(), found(F.col("text"))).alias("parts"), row_mark().alias("uid")))
    has = parsed.filter(F.size("parts") > 1)
    entity = lambda p: F.struct(p["kind"].alias("kind"), canonical(p["kind"], p["value"]).alias("canon"))
    mentions = has.select("uid", F.explode(F.array_distinct(F.transform(F.filter("parts", lambda p: p["kind"] > 0), entity))).alias("m")).select("uid", "m.kind", "m.canon")
    counted = cut(mentions.groupBy("kind", "canon").agg(F.count(F.lit(1)).alias("c")))
    made = cut(assign(counted.select("kind", "canon"), key).join(counted, ["kind", "canon"]))
    # an entity that a third of all texts hold is split over many tasks
    named = join_counted(mentions, made, ["kind", "canon"], "c", F.col("uid.a"))
    own = named.groupBy("uid").agg(F.collect_set(F.struct(F.concat_ws("|", "kind", "canon").alias("k"), F.col("made").alias("v"))).alias("pairs"))
    changed = has.join(own.select("uid", F.map_from_entries("pairs").alias("names")), "uid", "left")

    def part(p):
        made = F.element_at(F.col("names"), F.concat_ws("|", p["kind"], canonical(p["kind"], p["value"])))
        return F.when(p["kind"] == 0, p["value"]).otherwise(written(p["kind"], p["value"], made))

    changed = changed.select("doc_id", F.array_join(F.transform("parts", part), "").alias("text"), F.floor(F.size("parts") / 2).cast("long").alias("n_entities"))
    plain = parsed.filter(F.coalesce(F.size("parts"), F.lit(-1)) <= 1).select("doc_id", F.col("parts")[0]["value"].alias("text"), F.lit(0).cast("long").alias("n_entities"))
    return changed.unionByName(plain)


def run_key(spark: SparkSession) -> str:
    """The key that the session names in spark.pavelake.surrogateKey; a new one for each run where it names none."""
    return spark.conf.get("spark.pavelake.surrogateKey", None) or secrets.token_hex(16)


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(table(spark, sf_dir, "documents"), run_key(spark))
