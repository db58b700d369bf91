"""Operators that judge single texts, against brute force and on odd rows."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skywright.llm import decontam, language_id, license_scan, pii, quality_classifier, quality_rules, url_filter
from skywright.llm.queries import ORACLES, QUERIES

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ODD = [None, "", " \t\n\x0b\x0c\r ", "one", "a b\r\nc  d\n\na b\r\nc", "€uro é 😀 " * 30, "x " * 40, "word", "word"]


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = [(10_000 + i, t, None, "s", None) for i, t in enumerate(ODD)] + [(10_003, "one", None, "s", None)]
    return base.unionByName(spark.createDataFrame(extra, base.schema)).withColumn("stats", F.lit(1)).withColumn("n_words", F.lit("clash")).withColumn("items", F.lit(2)).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def base_stats(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {p for ps in at.values() if len(ps) > 1 for i in ps for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark, docs, texts, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rules = quality_rules.learn(docs, labels.unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 7, 0)], labels.schema)))
    got = quality_rules.judge(docs, rules, keep=["doc_id"]).collect()
    assert len(got) == docs.count()
    for r in got:
        n, chars, sym, dup, rep = base_stats(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, sym, dup, rep), r["doc_id"]
        assert r["base_failed"] == (n < 20 or 100 * rep > 30 * n)
        assert r["kept"] == (not r["base_failed"] and r["rule"] == 0)
    empty = quality_rules.learn(docs, labels.limit(0))
    assert empty.rules == [] and quality_rules.judge(docs.limit(0), empty, keep=["doc_id"]).count() == 0


def rule_features(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    n, chars, symbols, dup, rep = base_stats(t)
    lines = sum(bool(re.search("[^\x20\x09-\x0d]", x)) for x in t.split("\n"))
    of = lambda chars_of: sum(c in chars_of for c in t)
    shares = [(symbols, chars), (rep, n), (dup, lines), (len(set(w)), n), (of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), chars), (of("0123456789"), chars), (of("!?.,;:"), chars), (chars, n), (n, lines)]
    return [a / max(b, 1) for a, b in shares]


def test_quality_rules_verdicts_by_hand(docs, texts):
    C = quality_rules.Condition
    rules = quality_rules.DecisionList([quality_rules.Rule((C("mark_share", True, 0.0305), C("words_per_line", False, 60.5))), quality_rules.Rule((C("distinct_share", False, 0.4205),)), quality_rules.Rule((C("upper_share", True, 0.0205), C("chars_per_word", True, 5.0005)))])
    seen = set()
    for r in quality_rules.judge(docs, rules, keep=["doc_id"]).collect():
        x = np.array([rule_features(texts[r["doc_id"]])])
        want = next((k for k, rule in enumerate(rules.rules, 1) if rule.holds(x)[0]), 0)
        assert r["rule"] == want and r["kept"] == (want == 0 and not r["base_failed"]), r["doc_id"]
        seen.add(want)
    assert seen == {0, 1, 2, 3}


def test_quality_statistics_of_long_texts(spark):
    long = [" ".join(f"w{i % 30_011}" for i in range(60_000)), "A#1. " * 40_000, "line one\n" * 20_000, "é😀" * 50_000]
    df = spark.createDataFrame(list(enumerate(long)), "doc_id bigint, text string")
    for r in quality_rules.judge(df, quality_rules.DecisionList([]), keep=["doc_id"]).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base_stats(long[r["doc_id"]])


def test_clashing_names(spark, docs, tmp_path):
    names = ["__stats", "__id", "__base", "row", "id", "h", "t", "word_chars", "kept", "rule", "terms", "spans"]
    odd = docs.select("doc_id", "text", F.lit(5).alias("n_words"), *[F.lit(n).alias(n) for n in names])
    rules = quality_rules.DecisionList([])
    judged = quality_rules.judge(odd, rules)
    judged.write.parquet(str(tmp_path / "judged"))
    assert sorted(judged.columns) == sorted({*odd.columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept"})
    assert judged.where("n_words <> 5").count() > 0  # the operator's own column wins
    kept = quality_rules.good(odd, rules)
    assert kept.columns == odd.columns and kept.where("`__stats` <> '__stats'").count() == 0
    found = pii.find(odd, keep=odd.columns)
    found.write.parquet(str(tmp_path / "found"))
    assert found.count() == odd.count() and found.where("`__base` <> '__base' or row <> 'row'").count() == 0
    for f in (license_scan.scan(odd), decontam.decontaminate(odd, odd.select(F.col("doc_id").alias("item_id"), "text", "items" if "items" in odd.columns else "spans").limit(3))):
        assert f.count() == odd.count()


def test_covering_finds_planted_rules():
    rng = np.random.default_rng(4)
    x = rng.random((3000, len(quality_rules.FEATURES)))
    bad = (x[:, 0] > 0.8) | ((x[:, 3] <= 0.2) & (x[:, 5] > 0.5))
    rules = quality_rules.cover(x, bad, min_precision=0.9)
    hit = np.logical_or.reduce([r.holds(x) for r in rules.rules])
    assert (hit == bad).mean() > 0.97 and (hit & ~bad).mean() < 0.02
    assert all(len(r.conditions) <= 3 for r in rules.rules)
    assert quality_rules.cover(x, np.zeros(3000, bool)).rules == []


def test_quality_rules_agree_with_labels(spark, sf_dir):
    got = QUERIES["op1_quality_rules"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    good = got.where("quality = 1 and not base_failed").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good >= 0.95


def test_license_scan(spark, sf_dir, same, docs):
    same(QUERIES["op4_license_scan"](spark, sf_dir), ORACLES["op4_license_scan"])
    rows = [(1, "Under the MIT LICENSE, or the Apache license; mit\nlicense"), (2, "licensed under the apache license version 2 0 ok"), (3, "License version 2.0 apache the under licensed"), (4, None), (5, ""), (6, "mit"), (6, "mit")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("label", F.lit("x")).withColumn("w", F.lit(0))
    got = {r["doc_id"]: r for r in license_scan.digest(license_scan.scan(df)).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (3, 2, 8, "apache,mit")
    assert got[2]["labels"] == "apache" and got[2]["score"] == 1.0 and got[3]["labels"] == "apache" and got[3]["n_base"] == 0
    assert (got[4]["n_words"], got[4]["labels"], got[4]["first_word"], got[4]["score"]) == (0, "", None, 0.0)
    assert license_scan.scan(df).count() == 7
    mit = "Permission is hereby granted, free of charge, to any person\n * obtaining a copy of this software and associated\n * documentation files"
    scattered = " ".join(w for x in license_scan.plain_words(license_scan.TEMPLATES[3][1]) for w in (x, *["filler"] * 90))
    full = license_scan.TEMPLATES[3][1].replace("software", "program", 3)
    rows = [(1, "/* " + mit + " */"), (2, "The court released him. Under a bridge near mit, a fisherman bought his license."), (3, scattered), (4, "lorem " * 20_000 + full + " ipsum" * 20_000), (5, "the of and to in " * 5_000)]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [x["label"] for x in got[1]["matches"]] == ["mit"] and got[1]["matches"][0]["containment"] == 1.0 and got[1]["matches"][0]["start"] == 0
    rivals = ["Licensed under CC BY-NC 4.0", "Licensed under CC BY 4.0", "Licensed under CC BY-NC-SA 4.0. And more words, so that it ends.", license_scan.TEMPLATES[9][1], license_scan.TEMPLATES[7][1], license_scan.TEMPLATES[10][1]]
    one = spark.createDataFrame(list(enumerate(rivals)), "doc_id bigint, text string")
    found = {r["doc_id"]: [x["label"] for x in r["matches"]] for r in license_scan.scan(one).collect()}
    assert found == {0: ["cc-by-nc"], 1: ["cc-by"], 2: ["cc-by-nc-sa"], 3: ["lgpl"], 4: ["gpl"], 5: ["agpl"]}
    assert got[2]["matches"] == got[3]["matches"] == got[5]["matches"] == []
    assert [x["label"] for x in got[4]["matches"]] == ["mit"] and got[4]["matches"][0]["start"] == 20_000 and got[4]["matches"][0]["containment"] >= 0.9
    assert license_scan.digest(license_scan.scan(df, templates=[])).where("labels <> base_labels").count() == 0
    assert license_scan.scan(df.limit(0)).count() == 0


def test_license_blocks_by_hand(spark):
    rng = np.random.default_rng(2)
    templates = [("a", "k0 k1 k1 k2 k3 k4 k5 k6 k7 k8"), ("b", "k3 k3 k3 c1 c2 c3"), ("a", "c1 c1 k9 c5"), ("none", " .,"), ("one", "solo")]
    vocabulary = [f"k{i}" for i in range(10)] + [f"c{i}" for i in range(8)] + ["solo"]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 60), p=[0.98 / 18] * 18 + [0.02]))) for i in range(150)]
    for i in range(150, 260):  # a template with words changed, added or moved
        words = templates[i % 3][1].split() + ["x"] * int(rng.integers(0, 4))
        if i % 2:
            rng.shuffle(words)
        words[int(rng.integers(len(words)))] = "k1"
        rows.append((i, "k1 x c1 " * int(rng.integers(0, 3)) + ", ".join(words)))
    got = {r["doc_id"]: {m["label"]: round(m["containment"], 6) for m in r["matches"]} for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), templates, 0.8).collect()}
    found = 0
    for i, text in rows:
        words, want = text.replace(",", "").split(), {}
        for label, t in templates[:3] + templates[4:]:
            t = t.split()
            span = int(np.ceil(license_scan.STRETCH * len(t)))
            best = max((sum(min(t.count(w), words[k : k + span].count(w)) for w in set(t)) for k in range(max(1, len(words)))), default=0)
            if best >= np.ceil(0.8 * len(t) - 1e-9):
                want[label] = round(max(best / len(t), want.get(label, 0)), 6)
        assert got[i] == want, (i, text)
        found += len(want)
    assert found > 60


def license_blocks(words, templates, threshold):
    """Maximal blocks of every template: (template, rank among rivals, start, end)."""
    out = []
    for k, (_, t) in enumerate(templates):
        t = WORD.findall(lower(t))
        span, found = int(np.ceil(license_scan.STRETCH * len(t))), []
        for i, w in enumerate(words):
            if w not in t:
                continue
            n, end, seen = 0, i, {}
            for j in range(i, min(len(words), i + span)):
                seen[words[j]] = seen.get(words[j], 0) + 1
                if seen[words[j]] <= t.count(words[j]):
                    n, end = n + 1, j + 1
            if n >= np.ceil(threshold * len(t) - 1e-9):
                found.append((n, w == t[0], i - end, -i, i, end))
        out += [(k, (b[1], b[0] / len(t), len(t)), *b[4:]) for b in found if not any(c[4] < b[5] and b[4] < c[5] and c > b for c in found)]
    return out


def license_labels(text, templates, threshold, with_rivals=True):
    bag = lambda k: {w: WORD.findall(lower(templates[k][1])).count(w) for w in WORD.findall(lower(templates[k][1]))}
    need = lambda k: np.ceil(threshold * sum(bag(k).values()) - 1e-9)
    rival = lambda j, k: templates[j][0] != templates[k][0] and sum(min(c, bag(k).get(w, 0)) for w, c in bag(j).items()) >= min(need(j), need(k))
    blocks = license_blocks(WORD.findall(lower(text)), templates, threshold)
    lost = lambda a: any(b[2] < a[3] and a[2] < b[3] and b[1] > a[1] and rival(a[0], b[0]) for b in blocks)
    return sorted({templates[a[0]][0] for a in blocks if not (with_rivals and lost(a))})


def test_no_label_is_lost_beside_a_rival(spark):
    """Every two confusable notices in either order, near each other and far apart: both labels are found, by hand and by the operator."""
    templates = license_scan.TEMPLATES
    sets = license_scan.prepared(templates, license_scan.THRESHOLD)
    pairs = sorted({tuple(sorted((k, j))) for k, js in license_scan.rivals_of(sets).items() for j in js})
    assert len(pairs) > 20
    rows, want = [], []
    for a, b in pairs:
        for x, y in ((a, b), (b, a)):
            for gap in (" ", " filler" * 300 + " "):
                rows.append((len(rows), templates[x][1] + gap + templates[y][1]))
                want.append({templates[x][0], templates[y][0]})
    rows += [(len(rows) + k, t) for k, (_, t) in enumerate(templates)]
    want += [{label} for label, _ in templates]
    got = {r["doc_id"]: [m["label"] for m in r["matches"]] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, text in rows:
        assert got[i] == license_labels(text, templates, license_scan.THRESHOLD), text
        assert want[i] <= set(license_labels(text, templates, license_scan.THRESHOLD, False))  # without the rule of rivals no label is missing
        assert want[i] <= set(got[i]), text
        if "filler" in text:
            assert set(got[i]) == want[i], text


def test_blocks_of_random_rivals_by_hand(spark):
    rng = np.random.default_rng(5)
    templates = [("a", "p q r s t u"), ("b", "p q r s t u v"), ("c", "q r s t u v w x"), ("a", "v w x y"), ("d", "p p q q r")]
    rows = [(i, " ".join(rng.choice(list("pqrstuvwxyz"), rng.integers(0, 50)))) for i in range(250)]
    rows += [(i, " z ".join(templates[int(k)][1] for k in rng.integers(0, 5, 4))) for i in range(250, 330)]
    got = {r["doc_id"]: [m["label"] for m in r["matches"]] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), templates, 0.8).collect()}
    for i, text in rows:
        assert got[i] == license_labels(text, templates, 0.8), text
    assert sum(map(len, got.values())) > 200


def test_very_many_notices_in_one_text(spark):
    one = "Licensed under CC BY-NC 4.0 and so on. Licensed under CC BY 4.0 as well. "
    got = license_scan.scan(spark.createDataFrame([(1, one * 3000)], "doc_id bigint, text string")).first()
    assert [m["label"] for m in got["matches"]] == ["cc-by", "cc-by-nc"] and [m["start"] for m in got["matches"]] == [10, 0]


def brute_decontam(texts, items):
    win = {}
    for k, t in items:
        w = WORD.findall(lower(t))
        for i in range(max(1, len(w) - 9)) if w else ():
            win.setdefault(tuple(w[i : i + 10]), set()).add(str(k))
    sizes = {len(x) for x in win}
    out = {}
    for d, t in texts.items():
        w, hit, who = WORD.findall(lower(t)), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                x = tuple(w[i : i + n])
                if x in win:
                    hit.update(range(i, i + n))
                    who |= win[x]
        out[d] = (len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest())
    return out


@pytest.mark.parametrize("block", [decontam.BLOCK_CHARS, 2000])
def test_decontamination(spark, docs, texts, sf_dir, block):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bench = bench.unionByName(spark.createDataFrame([(900, None), (901, ""), (902, "one"), (903, "Word"), (904, "a B c d a b"), (905, "x " * 11)], bench.schema)).withColumn("doc_id", F.lit(7))
    got = decontam.digest(decontam.decontaminate(docs.dropDuplicates(["doc_id"]), bench, block_chars=block)).collect()
    want = brute_decontam(texts, [tuple(r) for r in bench.select("item_id", "text").collect()])
    assert len(got) == len(want) and any(r["contaminated"] for r in got)
    for r in got:
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == want[r["doc_id"]], r["doc_id"]
        assert r["contaminated"] == (r["n_hit"] > 0)
    assert decontam.decontaminate(docs, bench.limit(0)).where(F.size("spans") > 0).count() == 0


def test_offsets_map_to_the_original():
    text = "  The CAT,sat\non é the mat. "
    auto = decontam.Automaton({" cat sat on é ": [0], " on é the ": [1]})
    n, spans, items = auto.scan(text)
    assert (n, spans, items) == (7, [(1, 6)], {0, 1})
    assert [text[a:b] for a, b in decontam.original_spans(text, spans)] == ["CAT,sat\non é the"]


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return lower(host), re.match("[^?#]*", rest[len(host) :])[0]


def test_url_filter(spark, sf_dir):
    urls = [None, "", "no scheme", "http://", "HTTP://Sub.Example.ORG:80/es/1?x=://y#z", "http://example.org/en/12", "http://a.example.org/en/2", "http://notexample.org/es/", "http://x.org", "http://x.com/fr/?a", "http://x.com/de/", "http://x.com/de", "http://com/fr/", "http://q.net?u=http://org/", "http://é.org/é"]
    want_rule = {5: "example.org/en/1", 6: "org/", 7: "org/", 9: "com/fr/", 10: "com/de/", 12: "com/fr/"}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    extra = spark.createDataFrame([(10_000 + i, u) for i, u in enumerate(urls)], pages.schema)
    df = pages.unionByName(extra).withColumn("host", F.lit("clash")).withColumn("rule", F.lit(3))
    got = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    assert len(got) == df.count()
    for r in df.select("page_id", "url").collect():
        assert (got[r[0]]["host"], got[r[0]]["path"]) == host_path(r[1]), r
    for i, u in enumerate(urls):
        if i != 4 and i != 8 and i != 14:
            assert got[10_000 + i]["rule"] == want_rule.get(i), u
    assert got[10_008]["rule"] is None and got[10_004]["path"] == "/es/1"
    assert {r["verdict"] for r in got.values()} == {"allow", "block"}
    assert url_filter.judge(df.limit(0)).count() == 0


def url_features(url, rates, prior):
    u, (host, path) = url or "", host_path(url)
    entropy = lambda s: -sum(s.count(c) / len(s) * np.log2(s.count(c) / len(s)) for c in set(s)) if s else 0.0
    digits = lambda s: sum(c in "0123456789" for c in s) / max(len(s), 1)
    suffix = ".".join(host.split(".")[-2:])
    return [len(u), len(host), host.count(".") + 1, len(path), path.count("/"), round(digits(u), 6), round(digits(host), 6), entropy(u), entropy(host), ("?" in u) + u.count("&"), host.count("-"), u.count("%"), max(map(len, host.split("."))), rates.get(suffix, prior)]


def test_url_features_and_verdicts_by_hand(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    odd = [(10_000, None), (10_001, ""), (10_002, "x://a-b.c1%20.net/é?p=1&q=2#z"), (10_003, "http://" + "y" * 20_000 + ".net/" + "/1" * 5_000)]
    pages = pages.unionByName(spark.createDataFrame(odd, pages.schema))
    model = url_filter.learn(url_filter.rule_labels(pages), least_suffix=5)
    assert model.trees and model.rates and 0 < model.prior < 1
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    host, path = url_filter.host_path(F.col("url"))
    rows = pages.select("page_id", url_filter.features(F.col("url"), host, path, model.rates, model.prior).alias("f")).collect()
    for r in rows:
        assert np.allclose([r["f"][k] for k in url_filter.FEATURES], url_features(urls[r["page_id"]], model.rates, model.prior), atol=2e-6), urls[r["page_id"]]
    x = {r["page_id"]: np.array([[float(r["f"][k]) for k in url_filter.FEATURES]]) for r in rows}
    for r in url_filter.judge(pages, model).collect():
        p = model.predict(x[r["page_id"]])[0]
        assert np.isclose(r["score"], p)
        if r["rule"] is None:
            assert r["verdict"] == ("block" if r["score"] > 0.5 else "allow")


def test_url_filter_learns_from_a_table_of_labels(spark):
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    good = [f"https://{word(6)}.example/{word(5)}/{word(7)}" for _ in range(600)]
    bad = [f"http://{word(4)}-{word(3)}{rng.integers(10, 999)}.test/{rng.integers(10**6)}?a={rng.integers(99)}&b={word(2)}&c=1" for _ in range(600)]
    table = spark.createDataFrame([(u, False) for u in good[:400]] + [(u, True) for u in bad[:400]] + [(None, True), ("u", None), (bad[0], True)], "url string, blocked boolean")
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(good[400:] + bad[400:])], "page_id bigint, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, labelled=table, rules=[]).collect()}
    assert np.mean([got[i] == ("allow" if i < 200 else "block") for i in got]) >= 0.98
    nothing = url_filter.judge(pages, labelled=table.limit(0), rules=[])
    assert {(r["verdict"], r["score"]) for r in nothing.collect()} == {("allow", 0.5)}


def test_boosting_learns_and_equals_its_columns(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.random((800, len(url_filter.FEATURES))), 6)
    y = ((x[:, 1] > 0.5) ^ (x[:, 4] > 0.7)).astype(float)
    base, trees = url_filter.boost(x, y)
    model = url_filter.Boosted(base, trees, {}, 0.5)
    p = model.predict(x)
    assert ((p > 0.5) == (y == 1)).mean() > 0.97
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], ", ".join(f"{f} double" for f in url_filter.FEATURES))
    got = [r[0] for r in df.select(model.score(F.struct(*url_filter.FEATURES))).collect()]
    assert np.allclose(got, p[:50])


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    return {"email": True, "card": 16 <= len(d) <= 19 and luhn(d) if kind == "card" else False, "phone": 8 <= len(d) <= 15}[kind]


def test_pii_base(spark, docs, texts):
    tricky = ["a@b.c..d@e.f x@y z.w@q-.r_s@t.u", "1.2.3.4.5.6.7.8 01.002.0255.9 256.1.1.1", "4111 1111-1111 1111 4111 1111 1111 1111 12 4111111111111111-", "+1 (555) 123-4567 ++44 20 7946 0958. +1234 +12345678901234567", "é😀 a.b@c.de 😀 10.0.0.1", "a@" + "b." * 6000 + "c", "1 " * 5000, "9" * 4000, "@" * 300 + "a@b.cd", "+1" + " " * 3000, "x" * 20000]
    more = {50_000 + i: t for i, t in enumerate(tricky)}
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(more.items()), "doc_id bigint, text string")).withColumn("base", F.lit(1)).withColumn("terms", F.lit(2))
    got = pii.digest(pii.find(df.dropDuplicates(["doc_id"]))).collect()
    every = texts | more
    assert len(got) == len(every)
    for r in got:
        spans = [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, every[r["doc_id"]] or "") if valid(k, m[0])] for k, p in PATTERNS.items()]
        assert [r[f"n_{k}"] for k in PATTERNS] == [len(s) for s in spans], r["doc_id"]
        line = ",".join(sum(spans, []))
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest() and r["spans"].startswith(line)
    assert pii.find(df.limit(0)).count() == 0


def test_pii_disclosing_terms(spark):
    common = "the quick brown fox jumps over a lazy dog while many people watch from afar and near".split()
    fill = lambda k: " ".join(common[(k * 7 + j * 3) % len(common)] for j in range(12))
    rows = [(i, fill(i) + (f" Zorblax bob@corp.example.com speaks {fill(i + 3)}" if i < 6 else "")) for i in range(120)]
    rows += [(200, rows[0][1]), (201, "Zorblax alone")]
    found = pii.find(spark.createDataFrame(rows, "doc_id bigint, text string"), keep=["doc_id", "text"], generalise=0.85)
    found = found.withColumn("clean", pii.sanitised(F.col("text"), F.col("base"), F.col("terms")))
    got = {r["doc_id"]: r for r in found.collect()}
    assert {t["value"] for t in got[0]["terms"]} == {"zorblax", "speaks"} == {t["value"] for t in got[200]["terms"]}
    for t in got[3]["terms"]:
        assert got[3]["text"][t["start"] : t["end"]].lower() == t["value"]
    assert "bob@" not in got[1]["clean"] and "Zorblax" not in got[1]["clean"] and "[EMAIL]" in got[1]["clean"]
    assert got[201]["terms"] == [] and got[50]["clean"] == got[50]["text"]


def pii_rows(copies):
    common = "the quick brown fox jumps over a lazy dog while many people watch from afar and near".split()
    fill = lambda k: " ".join(common[(k * 7 + j * 3) % len(common)] + "x" * (k // 17 % 9) for j in range(12))
    rows = [(i, f"Page {'yz' * (i % 30 + 1)}{'w' * (i // 30)} " + fill(i)) for i in range(300)]
    return rows + [(1000 + i, rows[7 * k][1] + " Zorblax bob@corp.example.com " + fill(k)) for i, k in enumerate([0, 1, 2] + [2] * copies)]


def test_pii_copies_do_not_hide_terms(spark):
    for copies in (0, 40):
        found = pii.find(spark.createDataFrame(pii_rows(copies), "doc_id bigint, text string")).where("doc_id >= 1000").collect()
        assert len(found) == 3 + copies
        for r in found:
            assert ("zorblax", "remove") in {(t["value"], t["action"]) for t in r["terms"]}


def disclosures(texts, min_contexts, remove, generalise):
    """(term, entity) -> action, from all pairs of all distinct texts."""
    distinct = sorted(set(texts))
    terms, entities = [], []
    for t in distinct:
        spans = [(m.start(), m.end(), f"{k}:{m[0].lower()}") for k, p in PATTERNS.items() for m in re.finditer(p, t) if valid(k, m[0])]
        entities.append({e for _, _, e in spans})
        blank = list(t)
        for a, b, _ in spans:
            blank[a:b] = " " * (b - a)
        terms.append(({w.lower() for w in re.findall(r"[^\W\d_]+", "".join(blank)) if len(w) >= 3}, {w.lower() for w in re.findall(r"[^\W\d_]+", t)}))
    out, n = {}, len(distinct)
    for e in set().union(*entities):
        having = [k for k in range(n) if e in entities[k]]
        for t in set().union(*(terms[k][0] for k in having)):
            n_tc, n_t = sum(t in terms[k][0] for k in having), sum(t in terms[k][0] or t in terms[k][1] for k in range(n))
            r = 1 + np.log(n_tc / n_t) / -np.log(len(having) / n)
            if n_tc >= min_contexts and r >= generalise:
                out[t, e] = "remove" if r >= remove else "generalise"
    return out


def test_pii_counts_by_hand(spark):
    rng = np.random.default_rng(6)
    common, rare = [f"w{c}{d}" .replace("w", "wo") for c in "abcdefgh" for d in "xyz"], ["zorblax", "quemby", "vintolo"]
    rows = []
    for i in range(400):
        words = list(rng.choice(common, 14))
        if i % 23 == 0:
            words += ["ann@corp.example.com", *rare[: 1 + i % 2]]
        if i % 31 == 0:
            words += ["10.1.2.3", "vintolo"]
        if i % 97 == 5:
            words += ["quemby"]
        rows.append(" ".join([*words, "q" + "abcdefghij"[i % 10] * (3 + i // 10)]))
    rows += [rows[0]] * 20 + [rows[31]] * 5
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    base = df.select("doc_id", F.col("doc_id").alias("id"), F.col("text").alias("t"))
    hits = pii._hits(base).cache()
    entities = hits.select("h", F.explode("entities").alias("entity")).distinct()
    for remove, generalise in ((0.97, 0.9), (0.9, 0.6), (0.99, 0.3)):
        got = pii._disclosive(base, hits, entities, 3, remove, generalise).collect()
        want = disclosures(rows, 3, remove, generalise)
        assert {(r["term"], r["entity"]): r["action"] for r in got} == want
    assert {"remove", "generalise"} == set(want.values()) and len(want) >= 3


def test_pii_terms_of_the_whole_text(spark):
    far = " the quick brown fox jumps over a lazy dog while many people watch from afar and near" * 4
    rows = [(i, f"Note {'n' * (i + 3)}" + far) for i in range(200)]
    rows += [(500 + i, f"Vexquor report {'q' * (i + 3)}{far} mail bob@corp.example.com {'r' * (i + 3)}{far} regards VEXQUOR") for i in range(4)]
    rows += [(600, rows[0][1] + " vexquorish")]
    got = {r["doc_id"]: r["terms"] for r in pii.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    texts = dict(rows)
    for i in range(500, 504):
        assert [texts[i][t["start"] : t["end"]] for t in got[i] if t["value"] == "vexquor"] == ["Vexquor", "VEXQUOR"]
        assert {t["value"] for t in got[i]} == {"vexquor", "report", "mail", "regards"}
    assert got[0] == [] and got[600] == []


def test_quality_classifier(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.learn(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[10_000] == got[10_001] == pytest.approx(model.share)
    lab = labels.collect()
    assert np.mean([(got[r["doc_id"]] >= 0.3) == (r["quality"] == 1) for r in lab]) > 0.97
    none = quality_classifier.learn(docs, labels.limit(0))
    assert quality_classifier.score(docs.limit(0), none).count() == 0 and none.share == 0.5


def score_by_hand(model, text):
    """The folded model on features made one by one."""
    import zlib

    mask, mix = 2**64 - 1, 0x9E3779B97F4A7C15
    mixed = lambda h: (lambda x: x ^ (x >> 29))(((h ^ (h >> 31)) * mix) & mask)
    words, buckets, hashes = (text or "").split(), [], []
    for w in words:
        data = ("<" + w + ">").encode()
        hashes.append(mixed(zlib.crc32(data) + (1 << 40)))
        buckets.append(hashes[-1] % len(model.logit))
        for n in quality_classifier.NGRAMS:
            for i in range(len(data) - n + 1):
                h = n
                for c in data[i : i + n]:
                    h = (h * 257 + c) & mask
                buckets.append(mixed(h) % len(model.logit))
    buckets += [0 if a == b else mixed((a * 31 + b) & mask) % len(model.logit) for a, b in zip(hashes, hashes[1:])]
    if not buckets:
        return model.share
    z = sum(float(model.logit[b]) for b in buckets) / len(buckets) + model.bias
    trust = len(buckets) / (len(buckets) + model.trust)
    z = trust * z + (1 - trust) * np.log(model.share / (1 - model.share))
    return 1 / (1 + np.exp(-max(-30, min(30, z))))


def test_quality_scores_by_hand(spark, docs, texts, sf_dir):
    model = quality_classifier.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), epochs=2)
    some = docs.where("doc_id < 60 or doc_id >= 10000").select("doc_id", "text").unionByName(spark.createDataFrame([(99_999, "long words " * 20_000)], "doc_id bigint, text string"))
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(some, model).collect()}
    for i, s in got.items():
        assert s == pytest.approx(score_by_hand(model, "long words " * 20_000 if i == 99_999 else texts[i]), abs=1e-6), i
    # The folded model is the softmax of the averaged vectors: two texts trained for long enough are told apart.
    plain = quality_classifier.train(["good fine words here", "bad awful junk there"] * 20, np.array([1, 0] * 20), epochs=20)
    plain.trust = 0
    assert score_by_hand(plain, "good fine words here") > 0.9 and score_by_hand(plain, "bad awful junk there") < 0.1


def test_quality_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op8_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] >= 0.95


def test_language_id(spark, docs, sf_dir):
    got = QUERIES["op9_language_id"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] >= 0.95
    model = language_id.learn(docs)
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "the and of " * 3000), (4, "the and of " * 3000)], "doc_id bigint, text string").withColumn("lang", F.lit("xx")).withColumn("score", F.lit(9))
    out = language_id.identify(rows, model).collect()
    assert [(r["lang_pred"], r["score"]) for r in out[:3]] == [("und", 0.0)] * 3 and out[3]["lang_pred"] == "en" and out[3] == out[4]
    nothing = language_id.learn(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(rows, nothing).collect()} == {"und"}


def test_long_texts_and_samples(spark):
    from skywright.llm import common

    model = language_id.train(["the house is red and big " * 9, "der hund und die katze sind im haus " * 8], ["en", "de"])
    rows = spark.createDataFrame([(1, "the house is big " * 20_000), (2, "der hund und die katze " * 20_000)], "doc_id bigint, text string")
    assert [r["lang_pred"] for r in language_id.identify(rows, model).orderBy("doc_id").collect()] == ["en", "de"]
    many = spark.range(50_000).withColumn("x", F.lit(1)).unionByName(spark.range(30_000).select(F.lit(7).cast("long").alias("id"), F.lit(1).alias("x")))
    got = sorted(r["id"] for r in common.sample_by_hash(many, "id", 500).collect())
    want = many.distinct().select("id", F.xxhash64("id").alias("h")).orderBy("h").limit(500).collect()
    assert got == sorted(r["id"] for r in want)
    assert common.sample_by_hash(many.limit(0), "id", 5).count() == 0 and common.sample_by_hash(spark.range(9), "id", 50).count() == 9


def test_blockwise_forward_backward_is_exact():
    texts = ["the house is red and big " * 9, "der hund und die katze sind im haus " * 8, "le chat et la maison sont petits " * 7] * 4
    model = language_id.train(texts, ["en", "de", "fr"] * 4, epochs=3)
    mixed = [texts[0][:90] + texts[1][:120] + texts[2][:100], texts[1] * 9, "the", ""]
    found = language_id.Labeller(model).posteriors(mixed)
    for t, p in zip(mixed, found, strict=True):
        words = [w for w in map(language_id.letters, t.split()) if w]
        if words:
            want = language_id.marginals(model.emissions(words)[None], model.trans, model.start)[0][0]
            assert np.allclose(p, want, atol=1e-9)
    assert [x[2] for x in language_id.Labeller(model).label(mixed)[0][2]] == ["en", "de", "fr"]
