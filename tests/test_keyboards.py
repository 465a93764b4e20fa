"""Layouts on rows of our own: an independent loop over keys, lines typed on the wrong layout, syllables."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lingsmith.functions import hangul
from lingsmith.functions import keyboards as B
from lingsmith.functions import scripts
from lingsmith.plans import QUERIES

SF = "/root/testdata/sf0.001"


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def plain(text, source, to):
    """Key by key: accent keys first, then accented letters, ligatures, single keys."""
    a, b = B.layout(source), B.layout(to)
    out, i = "", 0
    while i < len(text):
        k = a.key(text[i])
        if k and (k[0], k[1] > 0) in b.dead and i + 1 < len(text) and (n := a.key(text[i + 1])) and (made := b.composed((k[0], k[1] > 0), b.char(*n))):
            out, i = out + made, i + 2
            continue
        parts = [(at, c) for at in a.dead for c in [*a.base, *map(B.simple_upper, a.base)] if c and a.composed(at, c) == text[i]]
        if not k and parts:
            (slot, up), letter = parts[0]
            out += (b.char(slot, 0) if not up else b.shift[slot] or b.char(slot, 1)) + b.char(*a.key(letter))
        elif k and (k[0], k[1] > 0) in b.ligatures:
            out += b.ligatures[k[0], k[1] > 0]
        else:
            out += (b.char(*k) if k else "") or text[i]
        i += 1
    return out


def test_layouts_have_48_keys():
    assert all(len(r) == len(B.US) == 48 for r in B.ROWS.values())
    for name in B.ROWS:
        own = B.layout(name)
        assert all(own.char(*own.key(c)) == c for c in own.typed() if own.key(c)[1] == 0 or own.shift[own.key(c)[0]] in ("", c))


@pytest.mark.parametrize("source, to", [("en", n) for n in B.ROWS if n not in ("en", "ko")] + [(n, "en") for n in B.ROWS if n not in ("en", "ko")] + [("ru", "el"), ("el", "uk"), ("hy", "ka")])
def test_against_keys(spark, source, to):
    rng = random.Random(1)
    typed = B.layout(source).typed() + ["ά", "Ϋ", " ", "\n", "é", "9"]
    texts = ["".join(rng.choice(typed) for _ in range(30)) for _ in range(60)] + ["", None]
    got = column(spark, texts, lambda x: B.transcode(x, source, to))
    assert got == [t if t is None else plain(t, source, to) for t in texts]


def test_wrong_layout(spark):
    say = lambda text, source, to, keys=False: column(spark, [text], lambda x: B.transcode(x, source, to, keys))[0]
    assert say("ghbdtn", "en", "ru") == "привет" and say("Ghbdsn", "en", "uk") == "Привіт"
    assert say("akuo", "en", "he") == "שלום" and say("gh", "en", "ar") == "لا" and say("b", "en", "ar") == "لا"
    assert say("لاعل", "ar", "en", True) == "bug" and say("لاعل", "ar", "en") == "ghug"
    assert say("kalhm;era", "en", "el") == "καλημέρα" and say("καλημέρα", "el", "en") == "kalhm;era"
    assert column(spark, ["dkssudgktpdy"], lambda x: hangul.composed_column(B.transcode(x, "en", "ko"))) == ["안녕하세요"]
    assert column(spark, ["안녕하세요"], lambda x: B.transcode(x, "ko", "en")) == ["dkssudgktpdy"]


def test_mixed_and_kept(spark):
    into = lambda x: B.into_script(x, "en", "uk")
    assert column(spark, ["ghbdsn світ  ghbdsn", "ghbdsn", "", None], into) == ["привіт світ  привіт", "привіт", "", None]
    spans = F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end")), F.struct(F.lit(1).alias("start"), F.lit(3).alias("end")), F.struct(F.lit(5).alias("start"), F.lit(5).alias("end")))
    assert column(spark, ["ghbdsn ghb", "gh", "ghbdsn світ"], lambda x: B.keeping(x, spans, "en", "uk")) == ["ghbвіт при", "gh", "ghbвіт світ"]


def test_order_asks_for_the_script_once(spark):
    """A count of a whole text must not be repeated by each of the rules that ask for its script."""
    df = spark.createDataFrame([(0, "plain слово"), (1, "слово її plain"), (2, "12 ;"), (3, ""), (4, None), (5, "é ü עב")], "id long, text string")
    asked = scripts.dominant(F.col("text"))
    out = df.select("id", F.array_join(B.candidates(asked, F.col("id") % 2 == 0, "ru"), " ").alias("order"), asked.alias("s"))
    rows = {r["id"]: r for r in out.collect()}
    assert [rows[i]["s"] for i in range(6)] == ["Latin", "Cyrillic", None, None, None, "Latin"]
    assert rows[0]["order"].split()[0] == "en" and rows[1]["order"].split()[0] != "ru" and rows[3]["order"].split()[0] == "ru"
    plan = df.select(B.candidates(asked, F.col("id") % 2 == 0, "ru").alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") == len(scripts.RANGES) + 1


def test_syllables(spark):
    rng = random.Random(2)
    words = ["".join(chr(rng.randrange(0xAC00, 0xD7A4)) for _ in range(6)) for _ in range(200)]
    keys = column(spark, words, hangul.decomposed)
    assert column(spark, keys, hangul.composed_column) == words
    for w, k in zip(words, keys):
        parts = [unicodedata.normalize("NFKC", c) for c in unicodedata.normalize("NFD", w)]
        assert len(k) >= len(parts)
    rows = QUERIES["l14_hangul_syllables"](spark, SF).filter("word rlike '^[a-z]+$'").collect()
    assert all(hangul.composed("".join(B.rules(("en",), "ko").get(c, c) for c in r.word)) == r.syllables for r in rows)
