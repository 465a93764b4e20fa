"""Each stage of the pipeline against a plain version on what the stage before kept."""

import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lingsmith.llm import _spark, jaccard, linededup, packing
from lingsmith.llm._spark import staged
from tests.llm.test_jaccard import plain
from tests.llm.test_lines_mixing import plain_lines
from tests.llm.test_tokens_out import check_packed

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(staged(spark, stage(spark, kept[-1], SF)))
        assert kept[-1].columns == columns
    rows = [{r.doc_id: r.text for r in df.collect()} for df in kept]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    # learned from some 65 labels here: nearly all that is labelled good stays
    good = [d for d, y in labels.items() if y == 1]
    assert sum(d in rows[1] for d in good) >= 0.95 * len(good)
    gone = plain_lines([(d, t) for d, t in rows[1].items() if t])
    want = {}
    for d, t in rows[1].items():
        left = [x for i, x in enumerate(t.split("\n")) if i not in gone.get((d, t), ())]
        if (d, t) not in gone or any(x.strip() for x in left):
            want[d] = "\n".join(left) if (d, t) in gone else t
    assert rows[2] == want
    assert rows[3] == {d: want[d] for d, _, c in plain(list(want.items()), 80, 5) if d == c}
    times = Counter(r.doc_id for r in kept[4].collect())
    assert set(times) == set(rows[3]) and max(times.values()) <= 2
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = corpus_pipeline.STAGES[-1][1](spark, kept[4], SF).collect()
    assert sum(r["length"] for r in packed) == sum(n * (len(tok.encode(rows[4][d], add_special_tokens=False).ids) + 1) for d, n in times.items())
    once = corpus_pipeline.STAGES[-1][1](spark, kept[3], SF).collect()
    check_packed(once, 2048, {d: tok.encode(t, add_special_tokens=False).ids + [0] for d, t in rows[3].items()})


def test_stages_on_odd_rows(spark):
    """Null and empty texts, a very long one, repeated rows, one id twice, columns with other stages' names; no rows."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
    line = "a line of text that several documents hold in common"
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, long, "en", None, 1), (4, f"{line}\nand one of its own here", None, "b", 2), (5, f"{line}\nquite another one", "en", "b", 2), (5, f"{line}\nquite another one", "en", "b", 2), (6, "one id", "en", "c", 1), (6, "with two texts", "en", "c", 1), (None, "no id at all", "en", "c", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, 7, "k") for r in rows], schema + ", n_lines int, key string")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, SF)
        assert sorted(out.columns) == sorted(docs.columns)
        docs = spark.createDataFrame(out.collect(), docs.schema)
    got = docs.collect()
    assert {r.doc_id for r in got} >= {1, 2, 3, 4, 6, None} and {r.text for r in got if r.doc_id == 6} == {"one id", "with two texts"}
    assert next(r.text for r in got if r.doc_id == 5) == "quite another one"
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.count() >= len(got)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_what_grows_is_not_broadcast(spark, monkeypatch):
    """However small Spark takes them to be: only owners of many partners, long lists and weights may go to the driver."""
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 0
    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    for module in (_spark, jaccard, linededup, packing):
        monkeypatch.setattr(module, "staged", lambda spark, df: (plan(df), staged(spark, df))[1])
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:3] + corpus_pipeline.STAGES[4:]:
        plan(stage(spark, docs, SF))
    assert len(plans) > 20 and any("SortMergeJoin" in x for x in plans)
    assert {re.sub(r"#\d+L?", "", on) for x in plans for on in re.findall(r"BroadcastHashJoin \[([^]]*)\]", x)} <= {"owner", "token"}
