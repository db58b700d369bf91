"""Operators across documents, against brute force: near duplicates, repeated passages, the pipeline."""

import random

import pytest
from pyspark.sql import functions as F

from skywright.llm import near_dedup, suffix_dedup
from skywright.llm.components import components
from skywright.llm.decontam import normalise
from skywright.llm.near_dedup import Verifier, aligned, shingle_list


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_banded_alignment_decides_as_full_one():
    rng = random.Random(6)
    for _ in range(400):
        a = [rng.randrange(6) for _ in range(rng.randint(0, 40))]
        b = [x if rng.random() > 0.15 else rng.randrange(9) for x in a if rng.random() > 0.1]
        full = lcs(a, b)
        for need in (full, full + 1, max(0, full - 3)):
            got = aligned(a, b, need)
            assert got <= full and (got == full if full >= need else got < need)


def words(rng, n, vocab=900):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


def corpus(seed=9):
    rng = random.Random(seed)
    base = words(rng, 150)
    rows, passage = [], words(rng, 64)
    for i in range(40):  # one family of copies that grow apart
        w = list(base)
        for _ in range(i // 4):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append(" ".join(w))
    rows += [rows[0]] * 30 + [rows[0].upper().replace(" ", ", ")]
    for _ in range(30):  # one passage in texts that share nothing else
        rows.append(" ".join([*words(rng, rng.randint(5, 90), 10**6), *passage, *words(rng, rng.randint(0, 90), 10**6)]))
    rows += [" ".join(words(rng, 120, 10**6)) for _ in range(40)]
    rows += [None, "", "  ", "one two", "One two!", "one two three four five", "one two three four six", "x " * 300, "x " * 290]
    a, b = words(rng, 70, 10**6), words(rng, 30, 10**6)
    rows += [" ".join(a + b), " ".join(b + a[:49]), " ".join(b[:3] + a[:50]), " ".join(a[-50:])]
    return list(enumerate(rows))


def classes_by_hand(rows):
    v, parent = Verifier(), {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in rows:
        for j, b in rows:
            if i < j and (v.similar(a, b) > 0):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return {i: top(i) for i, _ in rows}


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame(corpus(), "doc_id bigint, text string")
    return df.withColumn("node", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("label", F.lit(1)).cache()


def test_near_duplicates(table):
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(table).collect()}
    assert got == classes_by_hand(corpus())
    assert len(set(got.values())) < len(got) - 40


def test_near_duplicates_of_odd_tables(spark, table):
    assert near_dedup.classes(table.limit(0)).count() == 0
    twice = near_dedup.classes(table.where("doc_id in (0, 150, 151)").unionByName(table.where("doc_id in (0, 150, 151)")))
    assert twice.count() == 6 and twice.where("doc_id = class_id").count() == 6
    none = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (None, None)], "doc_id bigint, text string")
    assert sorted(map(str, (r["class_id"] for r in near_dedup.classes(none).collect()))) == ["3", "3", "None"]


def test_one_id_on_several_texts(spark):
    """Two families whose texts share an id: each keeps its class, and one text of each stays."""
    rng = random.Random(31)
    a, b, c = (words(rng, 80, 10**6) for _ in range(3))
    near = lambda w: " ".join([*w[:-1], "changed"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (3, near(a)), (7, near(b)), (9, " ".join(c)), (9, near(c)), (9, " ".join(c).upper()), (11, "alone in its class"), (11, None), (11, None), (None, near(b)), (None, "only this text has no id"), (12, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for clash in ("i", "n", "node", "__id", "label", "first"):
        docs = docs.withColumn(clash, F.lit(clash))
    got = sorted(((r["doc_id"] or -1, r["class_id"] or -1) for r in near_dedup.classes(docs).collect()))
    assert got == sorted([(5, 3), (5, 5), (3, 3), (7, 5), (9, 9), (9, 9), (9, 9), (11, 11), (11, 11), (11, 11), (-1, 5), (-1, -1), (12, 12)])
    kept = near_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    kept = kept.collect()
    assert sorted(((r["doc_id"] or -1, r["text"] or "") for r in kept if r["doc_id"] != 9)) == sorted([(3, near(a)), (5, " ".join(b)), (11, "alone in its class"), (11, ""), (-1, "only this text has no id"), (12, "")])
    assert [r["text"] in (near(c), " ".join(c).upper()) for r in kept if r["doc_id"] == 9] == [True]  # the smaller digest's, and of equal words the smaller text
    assert all(r["i"] == "i" and r["__id"] == "__id" for r in kept)
    assert near_dedup.deduplicated(docs.limit(0)).count() == 0


def test_near_duplicates_away_from_the_centre(spark):
    rng = random.Random(3)
    base, rows = words(rng, 150, 10**6), []
    for i in range(150):  # versions of one text, most of them too far from each other and from the centre
        w = list(base)
        for _ in range(rng.randint(2, 4)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    keys = {r["id"]: set(r["keys"]) for r in near_dedup.sketches(docs, "doc_id", "text").collect()}
    mates = [(i, j) for i in keys for j in keys if i < j and keys[i] & keys[j]]
    v, texts = Verifier(), dict(rows)
    links = [(i, j) for i, j in mates if v.similar(texts[i], texts[j]) > 0]
    top = {i: i for i in keys}
    for _ in keys:
        for i, j in links:
            top[i] = top[j] = min(top[i], top[j])
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()} == top


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(8, 60)] + [(5, 5)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert {got[k] for k in range(100, 161)} == {100} and {got[k] for k in range(7, 60)} == {7} and 5 not in got
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def passages_by_hand(rows, size=50):
    seen, multi, split = {}, set(), {}
    for i, t in rows:
        w = split[i] = normalise(t).split()
        for k in range(len(w) - size + 1):
            x = tuple(w[k : k + size])
            if seen.setdefault(x, i) != i:
                multi.add(x)
    out = {}
    for i, w in split.items():
        spans = []
        for k in range(len(w) - size + 1):
            if tuple(w[k : k + size]) in multi:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + size
                else:
                    spans.append([k, k + size])
        if spans:
            out[i] = [tuple(s) for s in spans]
    return out


def test_repeated_passages(table):
    got = {r["doc_id"]: r for r in suffix_dedup.passages(table).collect()}
    want = passages_by_hand(corpus())
    spans = {i: [(s["start"], s["end"]) for s in r["spans"]] for i, r in got.items()}
    assert set(spans) == set(want)
    assert spans == want
    for i, r in got.items():
        assert r["n_repeated"] == sum(b - a for a, b in spans[i]) and r["partners"] and i not in r["partners"]
    assert suffix_dedup.passages(table.limit(0)).count() == 0
    pair = table.where("doc_id = 80")
    assert suffix_dedup.passages(pair.unionByName(pair)).count() == 0


def test_passages_of_one_id_on_several_texts_and_of_null_ids(spark):
    rng = random.Random(41)
    own, shared = lambda n: words(rng, n, 10**6), words(rng, 60, 10**6)
    rows = [(1, " ".join([*own(3), *shared])), (1, " ".join(own(310))), (2, " ".join([*own(9), *shared, *own(2)])), (3, " ".join(own(80)))]
    copy = " ".join(own(70))
    rows += [(None, " ".join([*shared, *own(4)])), (None, copy), (4, copy), (4, copy), (5, "short")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("node", F.lit("clash")).withColumn("other", F.lit(1))
    got = [(r["doc_id"], r["n_words"], [(s["start"], s["end"]) for s in r["spans"]]) for r in suffix_dedup.passages(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(1, 63, [(3, 63)]), (2, 71, [(9, 69)]), (None, 64, [(0, 60)]), (None, 70, [(0, 70)]), (4, 70, [(0, 70)])]))


def spans_found(spark, rows):
    got = suffix_dedup.passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    return {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in got}


def test_a_short_passage_in_very_many_documents(spark):
    rng = random.Random(4)
    passages, rows = [words(rng, n, 10**6) for n in (50, 52, 57)], []
    for i in range(4500):
        rows.append((i, " ".join([*words(rng, rng.randint(3, 20), 10**6), *passages[i % 3], *words(rng, rng.randint(3, 20), 10**6)])))
    # One 16-word beginning in very many documents, with passages that only two of them hold.
    start = words(rng, 16, 10**6)
    for i in range(0, 1200, 2):
        rest = words(rng, 34, 10**6)
        rows += [(5000 + i + k, " ".join([*words(rng, 9, 10**6), *start, *rest, *words(rng, 9, 10**6)])) for k in range(2)]
    assert spans_found(spark, rows) == passages_by_hand(rows)


def test_repeats_in_families_that_mix_parts(spark):
    rng = random.Random(8)
    parts, rows = [words(rng, rng.randint(14, 30), 10**6) for _ in range(24)], []
    for i in range(400):
        rows.append((i, " ".join(sum([rng.choice(parts)[rng.randint(0, 3) :] for _ in range(8)], []))))
    assert spans_found(spark, rows) == passages_by_hand(rows)


def test_repeats_inside_long_runs_and_long_texts(spark):
    rng = random.Random(12)
    own = lambda n: words(rng, n, 10**6)
    left, right = own(60), own(60)
    rows = [(0, " ".join([*left, *["x"] * 5000, *right])), (1, " ".join([*left, *["x"] * 60, *right]))]
    rows += [(2 + i, " ".join([*own(5), *["x"] * (52 + i), *own(5)])) for i in range(10)]
    long = own(30_000)
    rows += [(20, " ".join(long)), (21, " ".join([*own(7), *long[12_345:12_398], *own(9)]))]
    assert spans_found(spark, rows) == passages_by_hand(rows)


def test_salted_k_grams(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 8)
    monkeypatch.setattr(suffix_dedup, "WINDOWS", 500)
    rng = random.Random(5)
    parts, rows = [words(rng, rng.randint(14, 30), 10**6) for _ in range(12)], []
    for i in range(150):
        rows.append((i, " ".join(sum([rng.choice(parts)[rng.randint(0, 3) :] for _ in range(8)], []))))
    assert spans_found(spark, rows) == passages_by_hand(rows)


def linked(docs):
    got = {}
    for r in near_dedup.classes(docs).collect():
        got.setdefault(r["class_id"], []).append(r["doc_id"])
    return got


def test_pairs_in_template_families(spark):
    """All texts share a template of 880 words and their buckets; only pairs are similar enough."""
    rng = random.Random(7)
    template, rows = words(rng, 880, 10**6), []
    for i in range(60):
        shared = words(rng, 30, 10**6)
        rows += [(2 * i + k, " ".join([*template, *shared, *words(rng, 90, 10**6)])) for k in range(2)]
    v = Verifier()
    assert v.similar(rows[0][1], rows[1][1]) >= 0.8 and v.similar(rows[0][1], rows[2][1]) == 0
    got = linked(spark.createDataFrame(rows, "doc_id bigint, text string"))
    pairs = sum(len(m) == 2 and m[0] // 2 == m[1] // 2 for m in map(sorted, got.values()))
    assert pairs >= 59 and max(map(len, got.values())) == 2


def test_links_of_planted_copies(spark):
    """Recall of the links of near copies at and above the threshold, against all pairs."""
    rng, rows = random.Random(21), []
    for _ in range(60):
        base = words(rng, 200, 10**6)
        for k in range(4):
            w = list(base)
            for _ in range(k):
                w[rng.randrange(200)] = f"n{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(w)))
    v = Verifier()
    links = [(i, j) for g in range(0, 240, 4) for i in range(g, g + 4) for j in range(i + 1, g + 4) if v.similar(rows[i][1], rows[j][1]) > 0]
    of = {d: c for c, m in linked(spark.createDataFrame(rows, "doc_id bigint, text string")).items() for d in m}
    assert len(links) > 200 and sum(of[i] == of[j] for i, j in links) >= 0.99 * len(links)
    long = words(rng, 25_000, 10**6)
    two = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(long[:-40])), (3, " ".join(words(rng, 25_000, 10**6)))], "doc_id bigint, text string")
    assert {c: sorted(m) for c, m in linked(two).items()} == {1: [1, 2], 3: [3]}
