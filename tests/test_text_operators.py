"""Rows of our own for the text, lookup and event-order operators."""

from pyspark.sql import functions as F

from lingsmith.functions import casing, hangul, phonetic, scripts, speech, transliterate
from lingsmith.operators import lookup as K
from lingsmith.operators import votes
from lingsmith.streaming import state


def column(spark, values, f):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(f(F.col("x"))).collect()]


def test_case_cycle(spark):
    seen, x = [], "HELLO BIG WORLD. ONE"
    for _ in range(4):
        x = column(spark, [x], casing.next_case)[0]
        seen.append(x)
    assert seen == ["hello big world. one", "Hello big world. One", "Hello Big World. One", "HELLO BIG WORLD. ONE"]
    assert column(spark, ["word", "5TH STREET", "123", "", None], casing.next_case) == ["Word", "5th street", "123", "", None]
    assert column(spark, ["ΛΟΓΟΣ ΚΑΙ"], casing.next_case) == ["λογος και"]
    assert column(spark, ["5th avenue"], casing.every_word) == ["5th Avenue"]


def test_transliteration(spark):
    assert column(spark, ["Shchuka", "SHCHUKA", "Yo", "x", "1, 2", "", None], transliterate.convert) == ["Щука", "ЩУКА", "Ё", "кс", "1, 2", "", None]
    assert column(spark, ["Щука", "ЩУКА", "Я"], transliterate.convert) == ["Shchuka", "SHCHUKA", "Ya"]
    assert column(spark, ["logos"], lambda c: transliterate.convert(c, "Greek")) == ["λογος"]
    assert column(spark, ["λογος"], transliterate.convert) == ["logos"]


def test_sound(spark):
    assert column(spark, ["request", "merge", "rebase", "file", "code", ""], phonetic.english) == ["rekvest", "merJ", "rebeis", "fail", "kod", ""]
    assert column(spark, ["реквест", "мердж", "ребейс", "", None], phonetic.heard) == ["rekvest", "merJ", "rebeis", "", ""]
    pairs = spark.createDataFrame([("rebeis", "rebeis"), ("kod", "kad"), ("rekvest", "rikvest"), ("kod", "kot")], "a string, b string")
    assert [r[0] for r in pairs.select(phonetic.close(F.col("a"), F.col("b"))).collect()] == [True, False, True, False]


def plain_collapse(text):
    """Runs taken out one by one, longest first."""
    words = text.split()
    bare = lambda w: "".join(c if c.isalnum() else " " for c in w.lower()).split()
    for n in range(10, 0, -1):
        start = 0
        while start < len(words):
            run = list(map(bare, words[start : start + n]))
            times = 1
            while len(run) == n and list(map(bare, words[start + times * n : start + (times + 1) * n])) == run:
                times += 1
            if times >= (4 if n == 1 else 3) and any(run):
                del words[start + n : start + times * n]
            start += 1
    return " ".join(words)


def test_repeated_runs():
    texts = ["a b a b a b c", "no no no", "no, No no. no", "- - - - -", "", "x", "a a a a a a b a a a a", "one two three one two three one two three one two", "a b c " * 50]
    texts += [" ".join("ab"[(i * i + j) % 3 % 2] for i in range(40)) for j in range(20)]
    texts += ["q w e r t y u i o p " * 4 + "z"]
    for x in texts:
        assert speech.one_copy_each(x) == plain_collapse(x), x


def test_cleaned(spark):
    df = spark.createDataFrame([(1, "Thank you. We go. We go! Then we left. Then we"), (2, None), (3, ""), (4, "Hi hi hi hi there.")], "id int, text string")
    got = {r.id: r.text for r in speech.cleaned(df, ["thank you"], ["subtitles"]).collect()}
    assert got == {1: "We go. Then we left.", 2: None, 3: "", 4: "Hi there."}


def test_hangul(spark):
    words = ["한글", "읽다", "닭이", "값", "없어요", "뭐예요", "앉아", "abc", ""]
    keys = column(spark, words, hangul.decomposed)
    assert keys[0] == "ㅎㅏㄴㄱㅡㄹ" and [hangul.composed(k) for k in keys] == words


def test_scripts(spark):
    assert column(spark, ["аb", "ba", "1", "", None], scripts.majority) == ["Cyrillic", "Latin", None, None, None]
    assert column(spark, ["мама", "ьма", "оьы", "ы"], lambda c: scripts.possible(c, "Cyrillic")) == [True, False, False, True]
    assert column(spark, ["пʼять", "'пять", "пять'", "pять"], lambda c: scripts.is_word_of(c, "Cyrillic")) == [True, False, False, False]
    assert column(spark, ["hello", "brrrrrr", "", "שלום"], lambda c: F.round(scripts.naturalness(c), 3)) == [1.0, 0.01, 0.0, 0.0]
    assert column(spark, ["مدرسة", "أحمد"], lambda c: scripts.folded(c, "Arabic")) == ["مدرسه", "احمد"]


def test_lookups(spark):
    listed = spark.createDataFrame([("en", "walk", 5), ("en", "talk", 9), ("en", "king", 2), ("de", "volk", 3)], "lang string, word string, n long")
    typed = spark.createDataFrame([("en", "wakl"), ("en", "alk"), ("de", "alk"), ("en", "zzzz")], "lang string, word string")
    lists = listed.withColumn("freq", F.col("n") / 9.0)
    assert sorted(map(tuple, K.corrections(typed, lists).collect())) == [("de", "alk", "talk", 1), ("en", "alk", "talk", 1), ("en", "wakl", "walk", 1)]
    assert sorted(map(tuple, K.suggestions(typed, listed, 5).collect())) == [("de", "alk", "volk"), ("en", "alk", "talk walk"), ("en", "wakl", "walk")]
    words = spark.createDataFrame([("walking",), ("rewalked",), ("king",)], "word string")
    assert [tuple(r) for r in K.stems(words, listed, ["re"], ["ing", "ed"], 3).collect()] == [("walking", "walk")]
    assert K.corrections(typed.limit(0), lists).count() == 0
    none = spark.createDataFrame([], "u long, target string, electing boolean")
    assert votes.elected(none, ["u"], "x").count() == 0


def test_taps_and_buffers(spark):
    rows = [(1, i, s, k) for i, (s, k) in enumerate([(0, "a"), (1, "a"), (2, "a"), (3, "a"), (9, "b"), (10, "<"), (11, "<"), (12, "<"), (13, "c"), (14, "/"), (15, "d")])]
    events = spark.createDataFrame(rows, "user_id long, event_id long, s long, event_type string").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.event_id for r in state.double_taps(events, 1_000_000).collect()) == [1, 3, 6]
    got = state.typed_buffers(events, 60, "/", "<").collect()
    assert sorted((r.line, r.typed) for r in got) == [(0, "aac"), (1, "d")]


def test_two_edits_against_all_pairs(spark):
    """Every pair within two edits, with swaps, is found; prices of slips equal a plain table."""
    import random

    from lingsmith.functions import slips
    from lingsmith.operators import lexicon as L

    def plain(a, b, price=None):
        near = lambda x, y: bool(slips._near(__import__("numpy").array([ord(x)]), __import__("numpy").array([ord(y)]), "en")[0])
        extra = lambda i: 1.0 if price is None else 0.6 if i and a[i] == a[i - 1] or i and near(a[i], a[i - 1]) or i + 1 < len(a) and near(a[i], a[i + 1]) else 1.2
        d = {(0, 0): 0.0}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                if i or j:
                    ways = [d[i - 1, j] + extra(i - 1)] if i else []
                    ways += [d[i, j - 1] + (1 if price is None else 0.8)] if j else []
                    ways += [d[i - 1, j - 1] + (0 if a[i - 1] == b[j - 1] else 1 if price is None else 0.6 if near(a[i - 1], b[j - 1]) else 1.4)] if i and j else []
                    if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and (price is None or a[i - 1] != a[i - 2]):
                        ways.append(d[i - 2, j - 2] + (1 if price is None else 0.7))
                    d[i, j] = min(ways)
        return d[len(a), len(b)]

    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcde") for _ in range(rng.randrange(1, 10))) for _ in range(160)})
    typed = sorted({"".join(rng.choice("abcde") for _ in range(rng.randrange(1, 10))) for _ in range(60)})
    frame = lambda x: spark.createDataFrame([(w,) for w in x], "word string")
    want = {(a, b, int(plain(a, b))) for a in typed for b in words if plain(a, b) <= 2}
    assert {tuple(r) for r in L.fuzzy(frame(typed), frame(words)).collect()} == want
    least = {a: min(n for x, _, n in want if x == a and n) for a in {x for x, _, n in want if n}}
    assert {tuple(r) for r in L.nearest(frame(typed), frame(words)).collect()} == {(a, b, n) for a, b, n in want if n and n == least[a]}
    pairs = [(a, b) for a in typed[:25] for b in words[:25]]
    assert all(abs(x - plain(a, b, "en")) < 1e-9 for (a, b), x in zip(pairs, slips.distances([a for a, _ in pairs], [b for _, b in pairs], "en")))
