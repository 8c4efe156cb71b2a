import os
import random
import sys
from collections import Counter

import corpus_pipeline as pipeline
import pytest
from ledgerloom.llm.mixing import source_targets, word_count
from ledgerloom.llm.quality import fit_on_labels, held_out, statistics
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").cache()
    out = [("documents", docs)]
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, SMALL).cache()
        out.append((name, docs))
    return out


def test_stages_keep_the_columns_of_documents(stages):
    for name, df in stages[1:-1]:
        assert df.columns == stages[0][1].columns and df.schema.simpleString() == stages[0][1].schema.simpleString(), name


def test_each_stage_works_on_what_its_predecessor_kept(stages):
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for _, df in stages]
    for before, after in zip(ids, ids[1:], strict=False):
        assert after <= before and after
    rows = [df.count() for _, df in stages]
    assert rows[5] == rows[4] and rows[2] == rows[1] and rows[3] < rows[2] < rows[0]


def test_no_near_copies_are_left(stages):
    from ledgerloom.llm.neardup import near_duplicates

    assert near_duplicates(stages[3][1]).where("not kept").count() == 0


def test_mix_takes_each_row_on_its_own(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    # a third without an id, and ids that several rows share; each text names its row
    ids = F.when(F.col("doc_id") % 3 > 0, F.floor(F.col("doc_id") / 5))
    texts = F.concat(F.lit("row"), F.col("doc_id").cast("string"), F.repeat(F.lit(" x"), (F.col("doc_id") % 37 * 9).cast("int")))
    sources = F.concat(F.lit("s"), (F.col("doc_id") % 3 + F.when(F.col("doc_id") % 50 == 0, 3).otherwise(0)).cast("string"))
    odd = docs.withColumn("text", texts).withColumn("source", sources).withColumn("doc_id", ids.cast("long")).cache()
    rows = {r.text.split()[0]: r for r in odd.collect()}
    words, copies = Counter(), Counter()
    for r in pipeline.mix(spark, odd, SMALL).collect():
        own = rows[r.text.split()[0]]
        assert (r.doc_id, r.source) == (own.doc_id, own.source) and own.text.startswith(r.text) and r.n_chars == len(r.text)
        words[r.source] += len(r.text.split())
        copies[own.text.split()[0]] += 1
    assert max(copies.values()) <= 3
    targets = {r.source: r.target for r in source_targets(odd.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("source_size"))).collect()}
    assert all(abs(words[s] - t) <= 0.5 for s, t in targets.items())


ODD = "doc_id long, text string, lang string, source string, n_chars long"


def odd_docs(spark):
    """Nulls in every column, empty and blank texts, repeated rows and ids, ties, a very long text."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    line = "this very same line of text is found in many documents"
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n ", None, None), (None, text(30), "en", "b"), (None, text(30), "en", "b"), (4, text(40), "en", None)]
    rows += [(5, "same words for all of us here in this text.", "en", "b")] * 3 + [(6, "same words for all of us here in this text.", "en", "c")]
    rows += [(10 + i, text(25) + "\n" + line + "\n" + text(8), "en", "abc"[i % 3]) for i in range(8)] + [(30, text(60_000), "en", "c")]
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows], ODD)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_take_odd_tables(spark, name):
    stage, docs = dict(pipeline.STAGES)[name], odd_docs(spark)
    out = stage(spark, docs, SMALL).collect()
    assert stage(spark, docs.limit(0), SMALL).count() == 0
    if name == "pieces":
        assert len(out) == docs.count() and sum(r.n_tokens == 0 for r in out) == 2
        return
    assert stage(spark, docs, SMALL).columns == docs.columns
    rows = Counter((r.doc_id, r.text) for r in docs.collect())
    got = Counter((r.doc_id, r.text) for r in out)
    if name == "lines":  # all rows stay; the shared line stays in the last document alone
        assert sum(got.values()) == sum(rows.values()) and sum("very same line" in (t or "") for _, t in got) == 1
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out)
    elif name == "near_copies":  # of equal texts the smallest id stays, rows without an id all do
        assert {k for k in rows if k[0] != 6} == set(got) and got[5, rows_of_id(docs, 5)] == 3
    elif name == "quality":
        assert all(got[k] <= rows[k] for k in got)
    else:
        assert max(got.values()) <= 3 * max(rows.values()) and not {1, 2, 3} & {i for i, _ in got}


def rows_of_id(docs, i):
    return docs.where(f"doc_id = {i}").first().text


def plain_pipeline(docs, model):
    """Quality, lines and near copies by plain loops over lists of (doc_id, text, source)."""
    from test_operators import brute_components, brute_lines

    x = statistics([(t or "").encode() for _, t, _ in docs])
    docs = [d for d, s in zip(docs, model.scores(x), strict=True) if s >= 0.3]
    yield docs
    kept = brute_lines([(i, t) for i, t, _ in docs])
    docs = [(i, kept[i], s) for i, _, s in docs]
    yield docs
    component = brute_components([(i, t) for i, t, _ in docs])
    yield [d for d in docs if component[d[0]] == d[0]]


def test_stages_equal_plain_ones(spark, stages):
    docs = sorted((r.doc_id, r.text, r.source) for r in stages[0][1].collect())
    model = fit_on_labels(stages[0][1], spark.read.parquet(f"{SMALL}/labels.parquet"), held_out())
    for (name, df), want in zip(stages[1:4], plain_pipeline(docs, model), strict=True):
        assert sorted((r.doc_id, r.text) for r in df.collect()) == sorted((i, t or "") if name != "quality" else (i, t) for i, t, _ in want), name


def test_mix_meets_the_targets_of_its_input(spark, stages):
    sizes, words = Counter(), Counter()
    for r in stages[3][1].collect():
        sizes[r.source] += len(r.text.split())
    for r in stages[4][1].collect():
        words[r.source] += len(r.text.split())
    from test_operators import brute_targets

    assert all(abs(words[s] - t) <= 0.5 for s, t in brute_targets(sizes).items())


def test_pieces_decode_to_their_texts(spark, stages):
    from ledgerloom.llm.pieces import codec, default_model

    own = codec(default_model())
    got = sorted((r.doc_id, own.decode(r.ids)) for r in stages[5][1].collect())
    assert got == sorted((r.doc_id, r.text) for r in stages[4][1].collect())


def test_run_writes_every_stage(spark):
    out = pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids"] and out.count() > 0
