"""Each operator against a brute-force version and against odd tables: nulls, empty and repeated rows, ties, no rows, and
columns whose names clash with the operators' own."""

import hashlib
import itertools
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from ledgerloom.llm import chat, components, fingerprints, licenses, lines, mixing, neardup, neighbours, quality, secrets
from ledgerloom.llm.common import shingle_sets

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep string, block string, a string"
WORDS = [a + b for a in ("ta", "ri", "no", "be", "lu", "so") for b in ("m", "ne", "st", "x", "qu", "ll", "ra")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "k", "b", "x") for i, t, s in rows], DOCS)


def odd_rows():
    rng = random.Random(5)
    long = sentence(rng, 4000)
    return [(1, None, "s"), (2, "", "s"), (3, "  \n ", None), (None, "a b c", "s"), (4, "a b c", None), (4, "a b c", None), (5, long, "t"),
            (6, long, "t"), (7, "One two THREE four five six", "t"), (8, "one  two three\tfour five six", "u")]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted((find(i), find(j)))
            up[y] = x
    return {i: find(i) for i in sets}


def near_rows(seed, groups=12, copies=25):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [rng.choice(WORDS) for _ in range(rng.randint(3, 160))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            rows.append(" ".join(words))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_shingle_sets_are_those_of_the_words():
    rng = random.Random(0)
    texts = ["", " ", "a", "A  b\n", "a b c d e f", "\x0b\x0ca\x1cb"] + [sentence(rng, rng.randint(1, 60)) for _ in range(80)]
    for t, s in zip(texts, shingle_sets([t.encode() for t in texts]), strict=True):
        assert len(s) == len(shingles(t))


def test_near_duplicates_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)  # many blocks a bucket
    rows = near_rows(1)
    want = brute_components(rows)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs_of(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert got == want


def test_near_duplicates_of_many_groups_of_two(spark):
    rng = random.Random(7)
    rows = []
    for g in range(5000):
        words = [f"w{rng.getrandbits(40)}" for _ in range(120)]
        moved = rng.choice([14, 14, 13, 12, 11, 8])  # of 100 shingles each: similarities 0.754 (twice), 0.770, 0.786, 0.802, 0.852
        rows += [(2 * g, " ".join(words[:104])), (2 * g + 1, " ".join(words[moved : 104 + moved]))]
    out = neardup.near_duplicates(docs_of(spark, [(i, t, "s") for i, t in rows])).collect()
    assert [r.doc_id for r in out if r.component_id != r.doc_id - r.doc_id % 2] == []


def test_near_duplicates_of_odd_rows(spark):
    out = neardup.near_duplicates(docs_of(spark, odd_rows())).collect()
    assert len(out) == len(odd_rows())
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    assert [by[i][0].n_shingles for i in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert by[6][0].component_id == 5 and not by[6][0].kept and by[8][0].component_id == 7
    assert by[None][0].component_id is None and by[None][0].kept
    assert neardup.near_duplicates(docs_of(spark, [])).count() == 0


def brute_lines(rows, most=5, least=40):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip("\x20\t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                holders[key(x)].add(i)
    return {
        i: "\n".join(x for x in (t or "").split("\n") if not (len(holders[key(x)]) >= most and max(holders[key(x)]) != i)) for i, t in rows
    }


def test_line_dedup_equals_brute_force_over_any_partitions(spark):
    rng = random.Random(2)
    common = [sentence(rng, 12) for _ in range(6)]
    rows = [(i, "\n".join(rng.choice([f" {rng.choice(common).upper()}\r", rng.choice(common), sentence(rng, 9), "", "é" * 45]) for _ in range(rng.randint(0, 9))))
            for i in range(150)]
    want = brute_lines(rows)
    for n in (1, 3, 40):
        docs = docs_of(spark, [(i, t, "s") for i, t in rows])
        maps = lines.keep_bitmaps(docs, parts=n)
        dropped = {r.doc_id: r.n_dropped for r in maps.collect()}
        assert {i: n for i, n in dropped.items()} == {i: t.count("\n") + 1 - (want[i].count("\n") + 1 if want[i] or "" in t.split("\n") else 0)
                                                      for i, t in rows if i in dropped}
    got = {r.doc_id: r.text for r in lines.drop_repeated_lines(docs).collect()}
    assert got == want


def test_line_dedup_of_odd_rows(spark):
    line = "x" * 50
    rows = odd_rows() + [(i, line + "\nown", "s") for i in range(20, 26)] + [(None, line, "s"), (25, line + "\nown", "s")]
    out = lines.drop_repeated_lines(docs_of(spark, rows))
    assert out.columns == docs_of(spark, []).columns and out.count() == len(rows)
    texts = Counter((r.doc_id, r.text) for r in out.collect())
    assert texts[(20, "own")] == 1 and texts[(25, line + "\nown")] == 2 and texts[(None, line)] == 1
    assert lines.drop_repeated_lines(docs_of(spark, [])).count() == 0


def test_fingerprints_estimate_and_edit(spark):
    rng = random.Random(3)
    rows = [(i, sentence(rng, rng.randint(1, 400))) for i in range(60)] + [(100, None), (101, "")]
    got = {r.doc_id: r for r in fingerprints.edited_likeness(docs_of(spark, [(i, t, "s") for i, t in rows]), parts=7).collect()}
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles(t), shingles(edited), shingles(after)
        if len(a) > 100:
            assert abs(got[i].near_edited - len(a & b) / len(a | b)) < 0.15
            assert abs(got[i].near_next - len(a & c) / max(1, len(a | c))) < 0.15
    out = fingerprints.edited_likeness(docs_of(spark, odd_rows())).collect()
    assert len(out) == len(odd_rows()) and len({r.fingerprint for r in out if r.doc_id in (5, 6)}) == 1
    assert fingerprints.edited_likeness(docs_of(spark, [])).count() == 0
    assert fingerprints.edited_likeness(docs_of(spark, [(1, "a b c d e f", "s")])).first().near_next == 1.0
    assert fingerprints.fingerprint_column(docs_of(spark, odd_rows())).count() == len(odd_rows())


def plain_fingerprint(hashes):
    """Bins, densification and low bits one by one."""
    mask = (1 << 64) - 1

    def mix(x):
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> 33) * m & mask
        return x ^ x >> 33

    bins = {}
    for h in hashes:
        t = mix(h ^ 0x5851F42D4C957F2D)
        bins[t >> 56] = min(bins.get(t >> 56, mask), t << 8 & mask)
    out = []
    for k in range(256):
        donor, attempt = k, 0
        while bins and donor not in bins:
            attempt += 1
            donor = mix((k << 20) + attempt) & 255
        out.append(mix(bins[donor]) & 15 if bins else 0)
    return bytes(a << 4 | b for a, b in zip(out[::2], out[1::2], strict=True))


def test_fingerprints_equal_plain_ones():
    rng = random.Random(15)
    texts = ["", "a", "a b c d e f g"] + [sentence(rng, n) for n in (20, 300, 6000)]
    for t, packed in zip(texts, fingerprints.fingerprints([t.encode() for t in texts]), strict=True):
        assert packed.tobytes() == plain_fingerprint([int(h) for h in shingle_sets([t.encode()])[0]])


def test_likeness_is_unbiased():
    rng = random.Random(16)
    errors = []
    for _ in range(300):
        a = [rng.choice(WORDS) for _ in range(400)]
        b = a[: rng.randint(50, 380)]
        b += [rng.choice(WORDS) for _ in range(400 - len(b))]
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        p = fingerprints.fingerprints([" ".join(a).encode(), " ".join(b).encode()])
        errors.append(fingerprints.likeness(p[:1], p[1:])[0] - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def test_fingerprints_of_hot_ids_are_spread(spark):
    rng = random.Random(17)
    rows = [(None, "one and the same text of several words", "s")] * 300 + [(7, sentence(rng, 30), "s") for _ in range(100)] + [(8, "b", "s"), (9, "c" * 40, "s")]
    out = fingerprints.edited_likeness(docs_of(spark, rows), parts=16).collect()
    assert len(out) == len(rows)
    same = [r for r in out if r.doc_id is None]
    assert len(same) == 300 and sum(r.near_next == 1.0 for r in same) == 299
    assert [r.edited_sha256 for r in out if r.doc_id == 8] == [hashlib.sha256(b"b").hexdigest()]
    assert [r.edited_sha256 for r in out if r.doc_id == 9] == [hashlib.sha256(("c" * 30 + "one and th").encode()).hexdigest()]


def test_neighbours_reach_their_recall_and_ties(spark):
    rng = np.random.default_rng(4)
    vectors = [[float(x) for x in v] for v in rng.standard_normal((1200, 16))]
    vectors[1:40] = [vectors[0]] * 39  # one very common vector
    table = spark.createDataFrame(
        [(i, v, "x") for i, v in enumerate(vectors)]
        + [(5000, None, "x"), (5001, [0.0] * 16, "x"), (5002, [None] * 16, "x"), (5003, [float("nan")] * 16, "x"), (None, vectors[3], "x"), (5004, [1.0], "x")],
        "vec_id long, embedding array<float>, tbl string",
    )
    got = defaultdict(list)
    for r in neighbours.nearest(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    e = np.array(vectors, dtype=np.float32).astype(float)
    assert sorted(got) == list(range(0, 1200, 100))
    hits = 0
    for q in got:
        d = np.sqrt(((e - e[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(d)), d))[:10]
        hits += len(set(best.tolist()) & {v for v, _ in got[q]})
        assert all(abs(d[v] - s) < 1e-9 for v, s in got[q])
    assert hits / (10 * len(got)) >= 0.9 and [v for v, _ in got[0]] == list(range(1, 11))
    few = neighbours.nearest(table.where("vec_id in (0, 100, 200)")).collect()
    assert len(few) == 6 and neighbours.nearest(table.limit(0)).count() == 0


def test_neighbours_of_each_length_on_their_own(spark):
    rng = np.random.default_rng(10)
    rows = [(i, [float(x) for x in rng.standard_normal(8 if i % 3 else 5)]) for i in range(600)] + [(900, [1.0])]
    got = defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hits = 0
    for q in range(0, 600, 100):
        alike = [(np.linalg.norm(np.subtract(v, rows[q][1])), i) for i, v in rows if len(v) == len(rows[q][1]) and i != q]
        hits += len({i for _, i in sorted(alike)[:10]} & set(got[q]))
        assert len(got[q]) == 10
    assert hits >= 54 and 900 not in got


def test_neighbours_recall_on_the_given_table(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BROADCAST_BUCKETS", 10)  # sizes of buckets are joined in parts
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    good = {r.vec_id: np.array(r.vec) for r in neighbours.usable(table, "vec_id", "embedding").collect()}
    ids, e = np.array(sorted(good)), np.array([good[i] for i in sorted(good)])
    hits, got = 0, defaultdict(set)
    for r in neighbours.nearest(table).collect():
        got[r.query_id].add(r.vec_id)
    for q in [i for i in ids.tolist() if i % 100 == 0]:
        d = np.sqrt(((e - good[q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        hits += len(got[q] & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert hits >= 0.9 * 10 * len(got)


def test_neighbours_count_a_repeated_id_once(spark):
    rng = np.random.default_rng(9)
    rows = [(i, v) for i, v in enumerate(rng.standard_normal((300, 8)).astype(np.float32))]
    rows += [(1, rows[0][1] + np.float32(1e-3))] * 30  # the nearest id, far more than k times
    rows += [(2, rows[0][1] + np.float32(1e-2 + 1e-4 * j)) for j in range(30)]
    rows += [(100, rows[100][1] + np.float32(1e-3 * j)) for j in range(30)]  # a query
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>")
    ids, e = np.array([i for i, _ in rows]), np.array([v for _, v in rows]).astype(float)
    got = defaultdict(list)
    for probes in (1, 64):  # with one bucket a table, all queries are compared with every row
        got.clear()
        for r in neighbours.nearest(table, probes=probes, projections=40 if probes == 1 else 2).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.vec_id)
        for q in (0, 100, 200):
            d = np.sqrt(((e[:, None, :] - e[None, ids == q, :]) ** 2).sum(axis=2)).min(axis=1)
            best = sorted((min(d[ids == v]), v) for v in set(ids.tolist()) - {q})[:10]
            assert len(got[q]) == len(set(got[q])) == 10
            assert probes == 64 and len({v for _, v in best} & set(got[q])) >= 8 or got[q] == [v for _, v in best]


def brute_targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in stopped)
        level = rest / max(1, sum(weight[s] for s in names if s not in stopped))
        more = {s for s in names if s not in stopped and level * weight[s] > 3 * sizes[s]}
        if not more:
            return {s: 3 * sizes[s] if s in stopped else level * weight[s] for s in names}
        stopped |= more


def test_mixing_meets_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, sentence(rng, rng.randint(0, 60)), rng.choice(["a"] * 9 + ["b", "c", "é", None])) for i in range(900)]
    out = mixing.mix_sources(docs_of(spark, rows)).collect()
    size = {i: len(t.split()) for i, t, _ in rows}
    sources = Counter()
    for i, _, s in rows:
        sources[s] += size[i]
    want, taken, of = brute_targets(sources), Counter(), {i: s for i, _, s in rows}
    for r in out:
        assert r.size == size[r.doc_id] and r.source_size == sources[of[r.doc_id]] and 0 <= r.taken <= 3 * r.size
        assert abs(r.target - want[of[r.doc_id]]) < 1e-6 * max(1, r.target)
        taken[of[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    again = mixing.mix_sources(docs_of(spark, rows).repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))
    assert len(mixing.mix_sources(docs_of(spark, odd_rows())).collect()) == len(odd_rows())
    assert mixing.mix_sources(docs_of(spark, [])).count() == 0
    assert mixing.mix_sources(docs_of(spark, [(1, "", "s"), (2, None, None)])).count() == 2


def test_mixing_meets_each_target_with_blocks_of_many_words(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MIN_SLOTS", 64)  # blocks of hundreds of words: most sources are near one or below
    rng = random.Random(8)
    rows = [(i, sentence(rng, rng.randint(0, 60)), "hot") for i in range(700)]
    tiny = [("a", 50), ("b", 300), ("c", 1), ("d", 245), ("e", 1000), (None, 70)]
    for name, words in tiny:
        while words:
            n = min(words, rng.randint(1, 40))
            rows.append((len(rows), sentence(rng, n), name))
            words -= n
    rows += [(None, sentence(rng, 9), "hot"), (None, sentence(rng, 30), "b"), (3, sentence(rng, 8), "e")]
    sources, taken = Counter(), Counter()
    for _, t, s in rows:
        sources[s] += len(t.split())
    want = brute_targets(sources)
    docs = docs_of(spark, [(k, t, s) for k, (_, t, s) in enumerate(rows)])
    docs = docs.withColumnRenamed("doc_id", "at").join(spark.createDataFrame(list(enumerate(i for i, _, _ in rows)), "at long, doc_id long"), "at")
    out = mixing.mix_sources(docs, row_col="at").collect()
    assert sorted(r.row for r in out) == list(range(len(rows)))
    for r in out:
        i, t, s = rows[r.row]
        assert (r.doc_id, r.size) == (i, len(t.split())) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    assert len(mixing.mix_sources(docs_of(spark, odd_rows())).collect()) == len(odd_rows())
    assert mixing.mix_sources(docs_of(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix_sources(docs_of(spark, [(1, "", "s"), (2, None, None)])).collect()] == [0, 0]


def test_mixing_schedule_is_whole_and_even(spark):
    docs = [(i, p, n, q, st, sz) for i, (p, n, q, st, sz) in enumerate([(1, 100, 300, 0, 60), (1, 100, 300, 60, 40), (2, 5000, 2500, 0, 5000), (3, 7, 21, 0, 7)])]
    begun = spark.createDataFrame(docs, "row long, place long, source_size long, quota long, start long, size long")
    got = mixing.mix_pieces(begun, 10).orderBy("slot", "rank", "first").collect()
    words, slots = Counter(), defaultdict(dict)
    for r in got:
        words[r.place, r.rank] += r.last - r.first
        slots[r.place][r.rank] = r.slot
    assert all(n == 10 for (p, k), n in words.items() if p < 3) and [words[3, k] for k in range(3)] == [10, 10, 1]
    assert [len(slots[p]) for p in (1, 2, 3)] == [30, 250, 3]
    for p in slots:  # ranks in the order of slots, spread over the whole mix
        at = [slots[p][k] for k in sorted(slots[p])]
        assert at == sorted(at)
    first = sorted(s for p in slots for s in slots[p].values())[:100]
    assert 7 <= sum(s in first for s in slots[1].values()) <= 14


def test_mixing_of_many_sources_is_ranked_by_ranges(spark):
    rng = random.Random(14)
    rows = [(i, sentence(rng, rng.randint(1, 9)), f"host{rng.randint(0, 700)}") for i in range(2000)]
    sizes, taken = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want, of = brute_targets(sizes), {i: s for i, _, s in rows}
    for r in mixing.mix_sources(docs_of(spark, rows).repartition(5)).collect():
        assert abs(r.target - want[of[r.doc_id]]) < 1e-6
        taken[of[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)


def test_secret_spans_and_ownership(spark):
    live, shown = "Abcdef0123456789ABCDEFxyz", "Zbcdef0123456789ABCDEFxyz"
    rows = odd_rows() + [(30, f"é password = 'hunter22' x {live}", "s"), (31, "AKIA" + "A1" * 10 + " " + "0f" * 12 + " pwd", "s"),
                         (32, "api_key:abc token=12345", "s"), *[(40 + i, f"see {shown}", f"s{i}") for i in range(4)]]
    got = {r.doc_id: r for r in secrets.scan_secrets(docs_of(spark, rows)).collect() if r.doc_id}
    assert [(s.kind, s.first, s.last, s.value) for s in got[30].base] == [("assign", 2, 22, "hunter22")]
    assert [(s.kind, s.value) for s in got[30].owned] == [("owned", live)]
    assert {s.kind for s in got[31].base} == {"access", "hex"} and not got[32].base and not got[40].owned
    assert secrets.scan_secrets(docs_of(spark, rows)).count() == len(rows) and secrets.scan_secrets(docs_of(spark, [])).count() == 0


def test_licenses_in_windows(spark):
    rng = random.Random(7)
    grant = licenses.TEMPLATES["MIT-grant"]
    rows = odd_rows() + [(50, sentence(rng, 33) + " " + grant + " " + sentence(rng, 20), "s"), (51, "RELEASED under the mit license.", "s"),
                         (52, " ".join(grant.split()[:16]) + " " + sentence(rng, 9), "s"), (53, " ".join(grant.split()[:9]), "s")]
    got = {r.doc_id: [(x.license, x.containment) for x in r.licenses] for r in licenses.scan_licenses(docs_of(spark, rows)).collect()}
    rows += [(54, grant, "s"), (54, grant, "s"), (54, "", "s")]
    assert Counter(len(r.licenses) for r in licenses.scan_licenses(docs_of(spark, rows)).where("doc_id = 54").collect()) == {1: 2, 0: 1}
    assert got[50] == [("MIT-grant", 1.0)] and got[51] == [("MIT", 1.0)] and not got[53]
    assert [n for n, _ in got[52]] == ["MIT-grant"] and 0.75 <= got[52][0][1] < 1
    assert licenses.scan_licenses(docs_of(spark, [])).count() == 0 and licenses.scan_licenses(docs_of(spark, rows), templates={}).count() == len(rows)


def plain_licenses(text, templates):
    """Best window of each template by plain loops over all windows."""
    w, out = re.sub("[A-Z]", lambda m: m[0].lower(), text).split(), []
    for name in sorted(templates):
        t = templates[name].lower().split()
        m = min(5, len(t))
        own = {tuple(t[i : i + m]) for i in range(len(t) - m + 1)} if t else set()
        step = min((c for c in licenses.LADDER if c >= len(own)), default=None)
        said = [tuple(w[i : i + m]) for i in range(len(w) - m + 1)] if m else []
        windows = [(-len(own & set(said[k * step : (k + 2) * step])), k) for k in range(-(-len(said) // step))] if own else []
        if windows and -min(windows)[0] >= 0.75 * len(own):
            out.append((name, min(windows)[1], -min(windows)[0]))
    return out


def test_licenses_equal_plain_windows(spark):
    rng = random.Random(18)
    given = {"short": "Some Right", "one": "w " * 9, "even": sentence(rng, 40), "long": sentence(rng, 300), "none": "  ", **licenses.TEMPLATES}
    rows = []
    for i in range(120):
        words = sentence(rng, rng.randint(0, 700)).split()
        for name in rng.sample(sorted(given), 3):
            t = given[name].split()
            for k in range(len(t)):
                if rng.random() < rng.choice([0, 0, 0.01, 0.05]):
                    t[k] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = t
        rows.append((i, " ".join(words).upper() if i % 3 == 0 else " ".join(words), "s"))
    given_table = spark.createDataFrame(sorted(given.items()), "license string, notice string")
    got = {r.doc_id: [(x.license, x.window, x.found) for x in r.licenses] for r in licenses.scan_licenses(docs_of(spark, rows), templates=given_table).collect()}
    assert got == {i: plain_licenses(t, given) for i, t, _ in rows}
    assert sum(map(len, got.values())) > 200


def test_preferences_share_their_prompt(spark):
    turn = "array<struct<role: string, text: string>>"
    rows = [
        (1, [("user", "hi"), ("assistant", "a")], [("user", "hi"), ("assistant", "bé"), ("user", None)], "p"),
        (2, [("user", "x")], [("user", "x")], "p"), (3, None, [("user", "x")], "p"), (4, [(None, None)], [(None, None), ("assistant", "<|im_end|>")], "p"),
        (4, [], [], "p"),
    ]
    pairs = spark.createDataFrame(rows, f"id long, chosen {turn}, rejected {turn}, turns string")
    got = chat.format_preferences(pairs).orderBy("id").collect()
    assert got[0].prompt_turns == 1 and got[0].prompt == "<|im_start|>user\nhi<|im_end|>\n"
    for r in got:
        for text, mask, turns in ((r.chosen_text, r.chosen_mask, r.chosen), (r.rejected_text, r.rejected_mask, r.rejected)):
            said = [t for t in (turns or [])[r.prompt_turns :] if t.role == "assistant"]
            assert len(mask) == len(said) and all(text[m.first : m.last].endswith("<|im_end|>") for m in mask)
    assert got[1].chosen_text == got[1].rejected_text == "" and got[2].prompt == ""
    talks = spark.createDataFrame([(None, 0, "user", "x"), (7, 1, "assistant", "b"), (7, 0, "user", "a"), (9, 0, "user", None)],
                                  "conv_id long, turn long, role string, text string")
    assert chat.format_preferences(chat.swapped_answers(talks)).count() == 2 and chat.swapped_answers(talks.limit(0)).count() == 0


def test_preferences_beside_any_columns(spark):
    pair = "array<struct<role: string, text: string>>"
    pairs = spark.createDataFrame([(1, [("user", "a")], [("user", "b")], 7, 8, 9, 10)], f"own long, chosen {pair}, rejected {pair}, a int, b int, n int, _a int")
    got = chat.format_preferences(pairs).first()
    assert (got.own, got.a, got.b, got.n, got["_a"], got.prompt_turns) == (1, 7, 8, 9, 10, 0) and "a<|im_end|>" in got.chosen_text
    with pytest.raises(ValueError):
        chat.format_preferences(pairs.withColumnRenamed("a", "prompt"))


def plain_statistics(text):
    """Shares of a text, character by character."""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    if not words:
        return [0.0] * 13
    n = len(text)
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    share = lambda chars: sum(c in chars for c in text) / n
    groups = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "#$%&*+<=>@\\^_`{}~/[]", "|", "!?", ".,;:", "0123456789", "\n"]
    known = set("".join(groups)) | set("abcdefghijklmnopqrstuvwxyz \t\n\r\v\f")
    other = sum(ord(c) < 128 and c not in known for c in text) / n
    return [math.log1p(len(words)), n / len(words), *map(share, groups), other, len(set(low)) / len(low),
            sum(a == b for a, b in zip(low, low[1:])) / len(low), max(Counter(low).values()) / len(low)]


def test_statistics_equal_plain_ones():
    rng = random.Random(20)
    texts = ["", " \n", "a", "A a a b!", "x|y 12 #é\"'(日)\n.,"] + [sentence(rng, 60) + "".join(rng.choice("AB|#!?.,;:09\n(é ") for _ in range(50)) for _ in range(40)]
    got = quality.statistics([t.encode() for t in texts])
    assert np.allclose(got, [plain_statistics(t) for t in texts], atol=1e-12)


def test_lasso_weights_are_optimal():
    """The conditions of an optimum: the gradient is the penalty against each weight's sign, and within it for zero weights."""
    rng = np.random.default_rng(21)
    x = (rng.random((600, 12)) < 0.4).astype(np.float32)
    y = (rng.random(600) < 1 / (1 + np.exp(-(2 * x[:, 0] - 3 * x[:, 1] + 0.5)))).astype(float)
    full = np.column_stack([x, np.ones(600, dtype=np.float32)])
    w, b = quality._lasso(full, y, 0.01, rounds=4000)
    grad = full.astype(float).T @ (1 / (1 + np.exp(-(x @ w + b))) - y) / 600
    assert abs(grad[-1]) < 1e-4 and all(abs(g + 0.01 * np.sign(v)) < 1e-4 if v else abs(g) <= 0.01 + 1e-4 for g, v in zip(grad[:-1], w, strict=True))
    assert w[0] > 0.5 and w[1] < -0.5 and 0 < sum(w == 0) < 12


def test_paths_of_a_tree_are_nested_conjunctions():
    rng = np.random.default_rng(22)
    x = rng.random((500, 13))
    y = ((x[:, 2] > 0.5) & (x[:, 5] < 0.3)).astype(float)
    for _ in range(5):
        rules = quality._paths(x, y, rng)
        assert rules and all(1 <= len(r.bounds) <= quality.DEPTH for r in rules)
        held = np.array([r.holds(x) for r in rules])
        for r, h in zip(rules, held, strict=True):
            want = np.all([(x[:, k] > low) & (x[:, k] <= high) for k, low, high in r.bounds], axis=0)
            assert (h == want).all()
        first = [h for r, h in zip(rules, held, strict=True) if len(r.bounds) == 1]
        assert any((a ^ b).all() for a, b in itertools.combinations(first, 2))  # the two sides of the root


def quality_rows():
    rng = random.Random(8)
    good = [(i, sentence(rng, rng.randint(20, 120)) + ".", "s") for i in range(300)]
    bad = [(300 + i, rng.choice([lambda: " | ".join(sentence(rng, 40).split()), lambda: (rng.choice(WORDS) + " ") * 60,
                                 lambda: sentence(rng, 40).upper() + "!!", lambda: "### ".join(sentence(rng, 40).split())])(), "s") for i in range(80)]
    return good + bad


def test_quality_on_held_out_rows(spark):
    rows = quality_rows()
    docs = docs_of(spark, rows + odd_rows())
    labels = spark.createDataFrame([(i, int(i < 300), "x") for i, _, _ in rows] + [(None, 1, "x"), (3, None, "x")], "doc_id long, quality int, y string")
    model = quality.fit_on_labels(docs, labels, quality.held_out())
    scored = quality.score_quality(docs, model).select("doc_id", quality.held_out().alias("h"), "score").collect()
    assert len(scored) == len(rows) + len(odd_rows()) and all(0 <= r.score <= 1 for r in scored)
    held = [r for r in scored if r.h and r.doc_id is not None and r.doc_id >= 10]
    assert np.mean([(r.score >= 0.3) == (r.doc_id < 300) for r in held]) >= 0.95
    x = quality.statistics([(t or "").encode() for _, t, _ in rows])
    own = {r.doc_id: r.score for r in scored}
    assert all(abs(own[rows[i][0]] - s) < 1e-9 for i, s in enumerate(model.scores(x)) if rows[i][0] >= 10)
    none = quality.fit_on_labels(docs, labels.limit(0))
    assert quality.score_quality(docs.limit(0), none).count() == 0


def test_names_that_clash_are_refused(spark):
    docs = docs_of(spark, odd_rows())
    with pytest.raises(ValueError):
        quality.with_statistics(docs, name="keep")
    with pytest.raises(ValueError):
        fingerprints.fingerprint_column(docs, name="keep")


def test_components_of_chains_stars_and_loops(spark, monkeypatch):
    monkeypatch.setattr(components, "AT_ONCE", 50)
    rng = random.Random(11)
    links = [(i, i + 1) for i in range(400)] + [(1000, 1001 + i) for i in range(300)] + [(5000, 5000), (6001, 6000), (6000, 6001), (6001, 6000)]
    links += [tuple(rng.sample(range(7000, 7600), 2)) for _ in range(280)]
    rng.shuffle(links)
    up = {}

    def find(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    want = {i: find(i) for i in up if find(i) != i}
    for parts in (1, 13):
        table = spark.createDataFrame(links, "a long, b long").repartition(parts)
        got = components.components(table).collect()
        assert len(got) == len(want) and {r.node: r.component for r in got} == want
    assert components.components(table.limit(0)).count() == 0


def test_near_duplicates_in_buckets_of_many_blocks(spark, monkeypatch):
    """One large group, its bridges and strangers that share its bands: components of a block and more have their own."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "HEAVY", 60)
    rng = random.Random(12)
    base, rows = [rng.choice(WORDS) + str(i) for i in range(90)], []
    for g, moved in enumerate((0, 9, 15, 22)):  # neighbours in this row are near enough or just not
        for _ in range(60):
            words = base[moved:] + [f"g{g}.{i}" for i in range(moved)]
            words[rng.randrange(len(words))] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(words)))
    want = brute_components(rows)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs_of(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert got == want and len(set(want.values())) > 1


def brute_secrets(rows, copied=3):
    """(doc_id, source) rows: base and owned spans by plain loops."""
    patterns = [("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
                ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24), ("owned", r"[A-Za-z0-9+/_-]+", 0, 20)]
    base, owned, owners = {}, {}, defaultdict(set)
    for k, (_, t, s) in enumerate(rows):
        spans = []
        for kind, p, g, least in patterns:
            for m in re.finditer(p, t or "", re.ASCII):
                if len(m[g]) >= least:
                    spans.append((kind, *m.span(), m[g]))
        base[k] = [x for x in spans if x[0] != "owned"]
        owned[k] = [x for x in spans if x[0] == "owned" and all(re.search(p, x[3]) for p in ("[0-9]", "[A-Z]", "[a-z]"))
                    and not any(b[1] < x[2] and x[1] < b[2] for b in base[k])]
        for x in base[k] + owned[k]:
            owners[x[3]].add(s)
    return base, {k: [x for x in v if len(owners[x[3]]) < copied] for k, v in owned.items()}


def test_secrets_equal_brute_force(spark):
    rng = random.Random(13)
    bits = ["password=", "Token : ", "api_key=\"", "AKIA" + "B7" * 9, "0a" * 13, "0a" * 10, "Zz9" * 8, "zz9" * 8, "hunter22", "é", " ", "\n", ".", "abc", "AB12cd" * 5]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40))), rng.choice(["s", "t", "u", "v", None])) for i in range(300)]
    base, owned = brute_secrets(rows)
    got = {r.doc_id: r for r in secrets.scan_secrets(docs_of(spark, rows)).collect()}
    for k in base:
        assert sorted(tuple(s)[:4] for s in got[k].base) == sorted(base[k])
        assert sorted(tuple(s)[:4] for s in got[k].owned) == sorted(owned[k])


def test_secrets_of_a_text_with_very_many_matches(spark):
    words = [f"{i:024x}" for i in range(100_000)]
    rows = [(1, " ".join(words), "s"), (2, words[7], "t")]
    began = time.time()
    got = {r.doc_id: r for r in secrets.scan_secrets(docs_of(spark, rows)).collect()}
    assert time.time() - began < 60
    assert sorted((s.first, s.last) for s in got[1].base) == [(25 * i, 25 * i + 24) for i in range(100_000)]
    assert got[2].base[0].repositories == 2 and got[2].base[0].owners == 2
