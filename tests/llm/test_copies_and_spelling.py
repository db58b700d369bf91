"""Exact duplicates, spelling variants and the fill-in-middle transformation, against brute force and on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skywright.llm import exact_dedup, fill_in_middle, spelling
from skywright.llm.queries import ORACLES, QUERIES, planted_slip


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_spelling_variants", "op13_fill_in_middle"])
def test_query_equals_its_sql(name, spark, sf_dir, same):
    same(QUERIES[name](spark, sf_dir), ORACLES[name])


# Exact duplicates.


def bare(t):
    return re.sub("[\x20\x09-\x0d]", "", t or "")


def copies_by_hand(rows):
    """For every (id, text), in the order of rows: (keep_id, group size)."""
    groups = {}
    for i, t in rows:
        groups.setdefault(bare(t), []).append((-len(t or ""), i is None, i or 0, i))
    best = {k: (min(v)[3], len(v)) for k, v in groups.items()}
    return [(i, *best[bare(t)], hashlib.sha256(bare(t).encode()).hexdigest()) for i, t in rows], len(groups)


def copy_rows():
    rng, rows = random.Random(2), []
    for i in range(400):
        rows.append((i, rng.choice(["a b", "a  b", "ab", "ab\n", "x", "x y\tz", None, "", " \r\n", "é 😀", "é😀", " "])))
    rows += [(i, "the hot one" + " " * (i % 5)) for i in range(400, 1000)]
    rows += [(1000 + i, f"only {i}") for i in range(100)]
    rows += [(7, "a b"), (7, "other"), (None, "a b"), (None, "nothing else"), (None, "nothing else"), (2000, "long " * 50_000), (2001, "long" * 50_000)]
    return rows


@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(spark, monkeypatch, weak):
    monkeypatch.setattr(exact_dedup, "HOT", 20)
    rows = copy_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7).withColumn("n", F.lit("clash")).withColumn("best", F.lit(1)).withColumn("g", F.lit(None).cast("string"))
    digest = (lambda n: F.substring(F.sha2(n, 256), 1, 1)) if weak else None  # 16 digests for all contents
    got = exact_dedup.classes(docs, digest=digest).collect()
    want, groups = copies_by_hand(rows)
    assert sorted(map(repr, ((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got))) == sorted(map(repr, want))
    assert sum(r["kept"] for r in got) == groups and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    kept = exact_dedup.deduplicated(docs, digest=digest)
    assert kept.columns == docs.columns
    kept = kept.collect()
    assert len(kept) == groups and {bare(r["text"]) for r in kept} == {bare(t) for _, t in rows} and all(r["n"] == "clash" and r["g"] is None for r in kept)
    longest = {}
    for _, t in rows:
        longest[bare(t)] = max(longest.get(bare(t), 0), len(t or ""))
    assert all(len(r["text"] or "") == longest[bare(r["text"])] for r in kept)


def test_repeated_rows_and_empty_tables_of_copies(spark):
    docs = spark.createDataFrame([(1, "a b")] * 5 + [(2, "ab")] * 3 + [(None, None)] * 2, "doc_id bigint, text string").repartition(3)
    got = exact_dedup.classes(docs).collect()
    assert sorted((r["keep_id"] or 0, r["group_size"], r["kept"]) for r in got) == [(0, 2, False), (0, 2, True)] + [(1, 8, False)] * 7 + [(1, 8, True)]
    assert exact_dedup.deduplicated(docs).count() == 2
    assert exact_dedup.classes(docs.limit(0)).count() == 0 == exact_dedup.deduplicated(docs.limit(0)).count()


def test_texts_as_ids(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", " x")], "name string, body string")
    assert {r["name"]: (r["keep_id"], r["kept"]) for r in exact_dedup.classes(docs, "name", "body").collect()} == {"a": ("c", False), "b": ("c", False), "c": ("c", True)}


# Spelling variants.


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def words_by_hand(rows, slips=True):
    count = {}
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{w}".encode())
            if slips and i is not None and h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                count[w] = count.get(w, 0) + 1
    return {w: n for w, n in count.items() if n >= 2}


def variants_by_hand(count):
    near = {w: [x for x in count if x != w and one_apart(w, x)] for w in count}
    best = {w: min(v, key=lambda x: (-count[x], x)) for w, v in near.items() if v}
    form = {w: x for w, x in best.items() if count[x] >= 10 * count[w]}
    out = set()
    for w, n in count.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), count.get(form.get(w))))
    return out


def found_variants(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_spelling_variants(spark):
    rng = random.Random(4)
    base = ["Strasse", "straßen", "ÉTERNEL", "éternel", "letters", "letterss", "aaaaaaa", "aaaaaaaa", "abababa", "bababab", "÷times×x", "chapter", "chapters", "naïveté"]
    rows = []
    for i in range(300):
        ws = []
        for _ in range(rng.randint(0, 40)):
            w = list(rng.choice(base))
            if rng.random() < 0.3:
                k, c = rng.randrange(len(w)), rng.choice("abéÉ")
                w[k : k + rng.randint(0, 1)] = [c] if rng.random() < 0.7 else []
            ws.append("".join(w))
        rows.append((i, rng.choice([" ", "1", "\n", "_"]).join(ws)))
    rows += [(None, "chapters chapter " * 40), (1, None), (2, ""), (3, "chapter " * 5000), (3, "chapter " * 5000), (5, "x" * 300 + " KKelvinsign")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("word", F.lit("clash")).withColumn("id", F.lit(3))
    want = words_by_hand(rows)
    assert {r["word"]: r["n"] for r in spelling.words(docs, change=planted_slip).collect()} == want
    assert {r["word"]: r["n"] for r in spelling.words(docs).collect()} == words_by_hand(rows, False)
    assert len(want) > 300
    got = found_variants(spelling.variants(spelling.words(docs, change=planted_slip)))
    assert got == variants_by_hand(want) and sum(f is not None for _, f, *_ in got) > 50
    assert spelling.variants(spelling.words(docs.limit(0))).count() == 0
    assert spelling.words(spark.createDataFrame([(1, None)], "doc_id bigint, text string")).count() == 0


def test_chains_of_forms_and_ties(spark):
    chain = {"aaaaaaa" + "b" * k: 10**k for k in range(13)}
    ties = {"thewordx": 2, "thewordy": 20, "thewordb": 20, "thewordé": 20, "theword": 19}
    count = chain | ties
    df = spark.createDataFrame(list(count.items()), "word string, n bigint")
    got = found_variants(spelling.variants(df))
    assert got == variants_by_hand(count)
    assert {r for w, _, r, *_ in got if w in chain} == {"aaaaaaa" + "b" * 12} and ("thewordx", "thewordb", "thewordb", 2, 4, 20) in got


def test_very_long_words(spark, monkeypatch):
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdé") for _ in range(n))
    count = {}
    for n in (62, 63, 64, 65, 66, 20_000):
        w = letters(n)
        count[w] = 50
        for k in (0, n // 2, n - 1):
            count[w[:k] + w[k + 1 :]] = 3
            count[w[:k] + "z" + w[k + 1 :]] = 5
            count[w[:k] + "y" + w[k:]] = 4
    count["q" * 64] = count["q" * 65] = count["q" * 66] = 1
    got = found_variants(spelling.variants(spark.createDataFrame(list(count.items()), "word string, n bigint")))
    assert got == variants_by_hand(count)
    keys = spelling.deletion_keys("abcab")
    assert len(keys) == 6 and set(spelling.deletion_keys("abxab").tolist()) & set(keys.tolist()) and len(spelling.deletion_keys("x" * 300)) == 2


# Fill in the middle.

MARKS = ("<P>", "<S>", "<M>")


def fim_by_hand(i, t):
    t = t or ""
    h = hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    w = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    a, b = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not t or any(x in t for x in MARKS) or h3 % 100 >= 90:
        return len(w), "plain", None, None, t
    if h4 % 100 < 20:
        return len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fim_rows():
    rng = random.Random(5)
    alphabet = ["a", "Z", "word", " ", "\n", "é", "€", "😀", "7", "<", "<P", "S>", "\u0000", "ß"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))) for i in range(250)]
    rows += [(300 + i, t) for i, t in enumerate([None, "", "x", "é", "<P>", "a<M>b", "word" * 30_000, "é" * 70_000, ("ab " * 9 + "😀") * 6000, "9" * 66_000, "a" * 65_537])]
    return [*rows, (None, "a null id"), (5, "one id"), (5, "and two texts"), (6, "twice"), (6, "twice")]


@pytest.mark.parametrize("giant, chunk", [(fill_in_middle.GIANT, fill_in_middle.CHUNK), (4, 3)])
def test_fill_in_middle(spark, giant, chunk):
    rows = fim_rows() if giant > 4 else [r for r in fim_rows() if len(r[1] or "") < 3000]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("low", F.lit("clash")).withColumn("key", F.lit(2)).withColumn("form", F.lit("x"))
    out = fill_in_middle.transform(docs, giant=giant, chunk=chunk).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    got = sorted(repr((r["doc_id"], r["back"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])) for r in out)
    assert got == sorted(repr((i, t or "", *fim_by_hand(i, t))) for i, t in rows)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    assert fill_in_middle.transform(docs.limit(0)).count() == 0


def test_kept_columns_and_digests(spark):
    docs = spark.createDataFrame([(1, "some text", "u"), (2, None, "v")], "doc_id bigint, text string, source string")
    assert fill_in_middle.transform(docs, keep=["source", "doc_id"]).columns == ["source", "doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = {r["doc_id"]: r for r in fill_in_middle.digest(fill_in_middle.transform(docs)).collect()}
    assert got[1]["output_sha256"] == hashlib.sha256(fim_by_hand(1, "some text")[-1].encode()).hexdigest() and got[1]["restored_sha256"] == hashlib.sha256(b"some text").hexdigest()


def test_summaries_compose_as_one_scan():
    rng = random.Random(8)
    for _ in range(200):
        data = np.frombuffer("".join(rng.choice("ab é😀1") for _ in range(rng.randint(1, 40))).encode(), np.uint8)
        bounds = np.array([0, *sorted(rng.randint(0, len(data)) for _ in range(rng.randint(0, 6))), len(data)])
        whole = fill_in_middle.summaries(data, np.array([0, len(data)]))[0]
        parts = fill_in_middle.scanned(fill_in_middle.summaries(data, bounds))
        assert (parts[-1] == whole).all()
        a, b, c = (fill_in_middle.summaries(data, np.array(x)) for x in ([0, len(data) // 3], [len(data) // 3, len(data) // 2], [len(data) // 2, len(data)]))
        f = fill_in_middle.composed
        assert (f(f(a, b), c) == f(a, f(b, c))).all()
