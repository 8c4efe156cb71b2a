"""Languages, periodic runs and whitening: against plain versions, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from ledgerloom.llm import languages, periodic, whitening
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, block string, a string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), "b", "x") for i, t, lang in rows], DOCS)


# ---- Periodic runs ------------------------------------------------------------------------------------------------------


def plain_runs(w):
    """(start, period, length) by comparing all words at all lags."""
    found = {}
    for q in range(len(w) // 2, 0, -1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                found[i, j - i + q] = q  # smaller periods come later and stay
            i = j + 1 if j == i else j
    return sorted((s, q, n) for (s, n), q in found.items())


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    runs = plain_runs(w)
    gone = {i for s, q, n in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[2], -r[0], -r[1])) if runs else None
    shown = "".join(f"{s},{n},{q}\n" for s, q, n in runs)
    left = " ".join(x for i, x in enumerate(w) if i not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    big = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    return (doc_id, len(runs), *big, sha(shown), sha(left))


def repeating(rng, most):
    """Words of which stretches repeat, at several lags and inside one another."""
    w, kinds = [], rng.choice([1, 2, 3, 5, 50])
    while len(w) < most:
        if w and rng.random() < 0.5:
            q = rng.randint(1, min(40, len(w)))
            w += (w[-q:] * rng.randint(1, 8))[: rng.randint(1, 90)]
        else:
            w += [f"w{rng.randrange(kinds)}" for _ in range(rng.randint(1, 15))]
    return w


def test_runs_are_those_of_all_lags():
    rng = random.Random(4)
    for _ in range(150):
        texts = [repeating(rng, rng.randint(0, 150)) for _ in range(rng.randint(1, 4))]
        names = {x: i for i, x in enumerate(sorted({x for w in texts for x in w}))}
        ids = np.array([names[x] for w in texts for x in w], dtype=np.int64)
        at = np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)
        start, length, period = periodic.find_runs(ids, at)
        got = [[(s - at[i], q, n) for s, n, q in zip(start, length, period, strict=True) if at[i] <= s < at[i + 1]] for i in range(len(texts))]
        assert got == [plain_runs(w) for w in texts]


def test_words_that_stand_alone_split_until_nothing_changes():
    w = [1, 2, 3, 9, *range(20, 33), 9, 1, 2, 3, *([5, 6, 7] * 4), 40, *([8] * 11)]
    starts, ends = periodic.surviving_segments(np.array(w), np.array([0, len(w)]))
    # 20 to 32 and 40 stand once; then 9 and 1 2 3 on either side; eleven equal words are too few
    assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == [(w.index(5), w.index(40))]


def test_a_crafted_text_that_splits_word_by_word_is_scanned_all_the_same():
    chain = [x for i in range(2000) for x in (i + 1, i)] + [7000, 7001] * 8  # each cut leaves one more word alone
    start, length, period = periodic.find_runs(np.array(chain), np.array([0, len(chain)]))
    assert (start.tolist(), length.tolist(), period.tolist()) == ([4000], [16], [2])


@pytest.mark.parametrize("text", [["a"] * 30_000, ["a", "b"] * 20_000 + ["c"], [f"w{i % 7919}" for i in range(40_000)]])
def test_runs_of_very_long_texts(text):
    names = {x: i for i, x in enumerate(dict.fromkeys(text))}
    start, length, period = periodic.find_runs(np.array([names[x] for x in text]), np.array([0, len(text)]))
    kinds = len({*text} - {"c"})
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [len(text) - ("c" in text)], [kinds])


def test_periodic_runs_of_odd_rows(spark, tmp_path):
    rng = random.Random(6)
    planted = next(i for i in range(100, 1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    texts = [None, "", " \n\t ", "a", "a\x0bb\x0cc a b c a b c a b c a b c", "x y\x1cz\x85 " * 7, "Ä ä " * 9, "ä " * 12, "w " * 11]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(planted, "p q r s t u v w x y z " * 3, "en"), (planted, "", None), (None, "k l " * 9, None)]
    rows += [(1000 + i, " ".join(repeating(rng, 90)), "en") for i in range(60)] * 2
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in periodic.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert Counter(got) == Counter(plain_row(i, t) for i, t, _ in rows)
    assert periodic.mark_runs(docs_of(spark, [])).count() == 0
    whole = periodic.mark_runs(docs_of(spark, rows[:6]))
    assert whole.columns == [*docs_of(spark, []).columns, "runs", "collapsed"]
    assert [r.collapsed for r in whole.where("doc_id = 4").collect()] == ["a b c"]
    with pytest.raises(ValueError, match="already"):
        periodic.mark_runs(whole)


# ---- Languages ----------------------------------------------------------------------------------------------------------


def plain_counts(text):
    words = "".join(c.lower()[0] if c.isalpha() else " " for c in text).split()
    s = f" {' '.join(words)} " if words else ""
    return Counter(s[i : i + 3] for i in range(len(s) - 2))


def test_gram_counts_are_those_of_the_letters():
    rng = random.Random(1)
    texts = ["", "  ", "!?", "a", "Ab, a1B", "ÉÈ é", "İI ı", "𝔘𝔫𝔦 中文字 字", "x" * 5000] + ["".join(rng.choice("aBc éß.1\n") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    text, gram, count = languages.gram_counts([t.encode() for t in texts])
    letters = lambda g: "".join(chr(g >> 21 * k & (1 << 21) - 1) for k in (2, 1, 0))
    got = [Counter() for _ in texts]
    for i, g, n in zip(text.tolist(), gram.tolist(), count.tolist(), strict=True):
        got[i][letters(g)] += n
    assert got == [plain_counts(t) for t in texts]


def plain_vector(text, dims):
    """Letter vectors rotated, multiplied and added, n-gram by n-gram."""
    out = np.zeros(dims, dtype=np.int64)
    for gram, n in plain_counts(text).items():
        bound = np.ones(dims, dtype=np.int64)
        for k, letter in enumerate(reversed(gram)):
            bound *= np.roll(languages.letter_vectors(np.array([ord(letter)]), dims)[0].astype(np.int64), k)
        out += n * bound
    return out


def sample(spark, sf="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")


def test_predictions_are_those_of_plain_vectors(spark):
    docs = sample(spark).select("doc_id", "lang", F.substring("text", 1, 400).alias("text")).where("doc_id < 60")
    rows = [r.asDict() for r in docs.collect()]
    dims = 128
    sums = {}
    for r in rows:
        sums[r["lang"]] = sums.get(r["lang"], 0) + plain_vector(r["text"], dims)
    prototypes = languages.language_prototypes(docs.repartition(5), dims=dims)
    assert {r.lang: list(r.sums) for r in prototypes.collect()} == {k: v.tolist() for k, v in sums.items()}
    want = {}
    for r in rows:
        v = plain_vector(r["text"], dims)
        cosines = {k: round(float(v @ s / np.linalg.norm(v) / np.linalg.norm(s)), 9) for k, s in sums.items()}
        best = max(cosines.values())
        want[r["doc_id"]] = (min(k for k, c in cosines.items() if c == best), best)
    for most in (1024, 1):  # all prototypes at once, or one part of them after another
        got = {r.doc_id: r for r in languages.predict_languages(docs, prototypes, most=most).collect()}
        assert {i: r.lang_pred for i, r in got.items()} == {i: k for i, (k, _) in want.items()}
        assert all(math.isclose(got[i].lang_score, max(0, c), abs_tol=1e-8) for i, (_, c) in want.items())


def test_language_accuracy_on_held_out_documents(spark):
    told = languages.op11_languages(spark, "/root/testdata/sf0.01").join(sample(spark, "sf0.01").select("doc_id", "lang"), "doc_id")
    held = told.where("held_out")
    assert held.count() > 150
    assert held.where("lang = lang_pred").count() / held.count() >= 0.98
    assert told.where("score < 0 or score > 1 or lang_pred is null").count() == 0


def test_languages_of_odd_rows(spark):
    long = "the thing that they thought " * 20_000
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !? \n", "fr"), (4, "the this that", "en"), (4, "the this that", "en"), (None, "les des que", "fr"),
            (5, "les des que", None), (6, long, None), (7, "A", None), (8, "中文", "zz"), (9, "123", "none")]
    docs = docs_of(spark, rows)
    prototypes = languages.language_prototypes(docs)
    assert sorted(r.lang for r in prototypes.collect()) == ["en", "fr", "zz"]
    told = languages.predict_languages(docs, prototypes)
    assert told.columns == [*docs.columns, "lang_pred", "lang_score"]
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in told.collect()}
    assert told.count() == len(rows)
    assert [got[i] for i in (1, 2, 3, 9)] == [("und", 0.0)] * 4
    assert [got[i][0] for i in (4, None, 5, 6, 8)] == ["en", "fr", "fr", "en", "zz"]
    assert got[8][1] == 1.0 and got[7][0] in ("en", "fr", "zz")
    none = languages.language_prototypes(docs_of(spark, []))
    assert none.count() == 0 and {r.lang_pred for r in languages.predict_languages(docs, none).collect()} == {"und"}
    assert languages.predict_languages(docs_of(spark, []), prototypes).count() == 0
    with pytest.raises(ValueError, match="already"):
        languages.predict_languages(told, prototypes)


def test_equal_prototypes_give_the_first_language(spark):
    docs = docs_of(spark, [(i, "one two three", lang) for i, lang in enumerate(["b", "B", "c"])])
    assert {r.lang_pred for r in languages.predict_languages(docs, languages.language_prototypes(docs)).collect()} == {"B"}


# ---- Whitening ----------------------------------------------------------------------------------------------------------


def symmetric(kind):
    rng = np.random.default_rng(3)
    if kind == "random":
        x = rng.standard_normal((300, 40))
        return np.cov(x.T, bias=True)
    if kind == "many equal":
        return np.diag([5.0, 5, 5, *[1.0] * 20, 0])
    if kind == "one value":
        return np.eye(30)
    if kind == "close":
        return np.diag([1, 1 - 1e-7, 1 - 2e-7, 1 - 3e-7, 1 - 4e-7, *[0.1] * 20])
    if kind == "wide":
        return np.diag([1e6, 1, 1e-3, 1e-4, 0])
    x = rng.integers(0, 2, (3, 64)) * 1.0
    return np.cov(x.T, bias=True)  # rank two


@pytest.mark.parametrize("kind", ["random", "many equal", "one value", "close", "wide", "rank two"])
def test_components_are_eigenvectors(kind):
    a = symmetric(kind)
    values, vectors = whitening.leading_components(a, 4)
    want = np.linalg.eigvalsh(a)[::-1]
    assert len(values) == {"rank two": 2}.get(kind, 4)
    assert np.abs(values - want[: len(values)]).max() <= 1e-14 * np.trace(a)  # as exact as the matrix itself
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() <= 1e-12


def test_inertia_counts_the_eigenvalues_above():
    rng = np.random.default_rng(8)
    a = rng.standard_normal((25, 25))
    a += a.T
    parts = whitening.tridiagonal(a)
    values = np.linalg.eigvalsh(a)
    for shift in [*((values[1:] + values[:-1]) / 2), -100.0, 100.0]:
        assert whitening.inertia(*parts, shift) == (values > shift).sum()


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1) for i, v in rows], "vec_id long, embedding array<float>, x int")


def held_against_plain(out, rows, most=4):
    """`out` of rows (vec_id, sound vector of single precision) against sums in whole numbers and a dense solver."""
    xs = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in rows]
    fit = sorted({x for _, x in xs})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    centred = np.array([[(n * x[j] - sums[j]) / n for j in range(d)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(out) == len(rows) * most
    by = {}
    for r in out:
        by.setdefault(r.component, []).append(r)
    kept = {}
    for i, x in xs:
        kept.setdefault(i, x)
    for k in range(1, most + 1):
        for r in by[k]:
            assert (r.n, r.deviation) == (n, sum((n * v - s) ** 2 for v, s in zip(kept[r.vec_id], sums, strict=True)))
            assert math.isclose(r.explained, values[k - 1] / values.sum(), rel_tol=1e-9) and r.identity_error <= 1e-9
        got = np.array([r.whitened for r in by[k]])
        want = np.array([(np.array(kept[r.vec_id]) - np.array(sums) / n) @ vectors[:, k - 1] / math.sqrt(values[k - 1]) for r in by[k]])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) <= 1e-7


def test_whitening_of_the_small_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    held_against_plain(whitening.op13_whitening(spark, "/root/testdata/sf0.001").collect(), rows)


def test_whitening_with_a_vector_that_most_rows_share(spark):
    rng = random.Random(2)
    rows = [(i, [0.25, -0.5, 1, 0, 2]) for i in range(300)] + [(1000 + i, [rng.gauss(0, s) for s in (3, 2, 1, 0.5, 0.1)]) for i in range(60)]
    held_against_plain(whitening.whiten(vectors_of(spark, rows).repartition(7)).collect(), rows)


def test_whitening_of_odd_rows(spark):
    bad = [None, [], [1, None, 2], [1, float("nan"), 2], [1, float("inf"), 2], [-float("inf"), 0, 0], [1e30, 0, 0]]
    rng = random.Random(5)
    sound = [(100 + i, [rng.gauss(0, 2), rng.gauss(0, 1), -0.0 if i % 2 else 0.0]) for i in range(40)]
    df = vectors_of(spark, [*enumerate(bad), *sound, sound[0], (None, [1, 2, 0])])
    out = whitening.whiten(df).collect()
    # the third place never varies, so two components; the column x is the caller's own and stays
    assert Counter(r.component for r in out) == {1: 42, 2: 42} and {r.x for r in out} == {1}
    assert {r.n for r in out} == {41} and {r.vec_id for r in out} == {i for i, _ in sound} | {None}
    for rows in ([], [(1, [1, 2])], [(1, [1, 2]), (2, [1, 2])], [(i, b) for i, b in enumerate(bad)]):
        assert whitening.whiten(vectors_of(spark, rows)).count() == 0
    mixed = whitening.whiten(vectors_of(spark, [*sound, (1, [0, 0]), (2, [0, 4]), (3, [0, 0])])).collect()
    short = sorted((r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 9)) for r in mixed if r.vec_id < 10)
    assert short == [(1, 1, 2, 1024**2, 1.0), (2, 1, 2, 1024**2, 1.0), (3, 1, 2, 1024**2, 1.0)]
    with pytest.raises(ValueError, match="already"):
        whitening.whiten(df.withColumnRenamed("x", "n"))


def test_deviations_are_exact_and_null_beyond_63_bits():
    x = np.array([[3, -1], [1 << 40, 0], [1 << 20, 5]])
    got = whitening._deviations(x, 3, [4, 4]).to_pylist()
    assert got == [5**2 + 7**2, None, (3 * (1 << 20) - 4) ** 2 + 11**2]
