"""The corpus pipeline: every stage against a brute-force version, and odd rows."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skywright.llm import quality_rules
from test_groups import classes_by_hand
from test_texts import PATTERNS, base_stats, brute_decontam, disclosures, rule_features, valid


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = docs.where("doc_id = 0").first()["text"]
    more = [(90_000, None, None, None, None), (90_001, "", "en", "s", 0), (0, first, "en", "s", 1), (90_002, first, "en", "s", 1), (90_003, "write to a.b@c.de or +1 (555) 123-4567 " + " ".join(f"own{i}" for i in range(40)), "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    for name in ("base", "kept", "__stats", "__gone", "__clean", "row"):
        docs = docs.withColumn(name, F.lit(name))
    return docs.cache()


def sanitised(text):
    spans = sorted((m.start(), -m.end(), k) for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m[0]))
    out, at = [], 0
    joined = []
    for a, b, k in spans:
        if joined and a < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], -b)
        else:
            joined.append([a, -b, k])
    for a, b, k in joined:
        out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def test_every_stage_by_hand(spark, sf_dir, docs):
    rules = quality_rules.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]

    def by_rules(rows):
        def good(t):
            n, _, _, _, rep = base_stats(t)
            return n >= 20 and 100 * rep <= 30 * n and not any(r.holds(np.array([rule_features(t)]))[0] for r in rules.rules)

        return [r for r in rows if good(r[1])]

    def by_classes(rows):
        of = classes_by_hand(sorted({r[0]: r for r in rows}.values()))
        return sorted({r for r in rows if of[r[0]] == r[0]})

    def by_benchmark(rows):
        hit = brute_decontam(dict(rows), items)
        return [r for r in rows if hit[r[0]][1] == 0]

    def by_patterns(rows):
        assert disclosures([t for _, t in rows], 3, 0.97, 0.9) == {}  # no term is disclosing in these tables
        return [(i, sanitised(t)) for i, t in rows]

    now, want = docs, [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for (name, stage), by_hand in zip(corpus_pipeline.STAGES[:-1], (by_rules, by_classes, by_benchmark, by_patterns), strict=True):
        out = corpus_pipeline.materialize(stage(spark, now, sf_dir), f"test-{name}")
        assert out.columns == docs.columns
        before, want = len(want), by_hand(want)
        got = [tuple(r) for r in out.select("doc_id", "text").collect()]
        assert sorted(got) == sorted(want), name
        assert len(want) < before or name == "pii"
        now = out
    assert now.where("n_chars <> length(text)").count() == 0 and now.where("base <> 'base' or `__stats` <> '__stats' or `__clean` <> '__clean'").count() == 0
    assert any("[EMAIL]" in t and "[PHONE]" in t for _, t in want)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    library.no_truncation()
    library.no_padding()
    last = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, now, sf_dir).collect()}
    assert len(last) == len(want)
    for i, t in want:
        ids = library.encode(t, add_special_tokens=False).ids
        assert last[i]["ids"] == ids and last[i]["n_tokens"] == len(ids)
        assert last[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_stages_of_an_empty_table(spark, sf_dir, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    from types import SimpleNamespace

    from skywright.sources.storage import run_dir, shared_dir

    session = lambda master, found: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: found), sparkContext=SimpleNamespace(master=master))
    assert shared_dir(session("yarn", "hdfs://x/y/")) == "hdfs://x/y" and shared_dir(session("local[4]", None))
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:7077"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(session(master, None))
    assert spark.sparkContext.applicationId in run_dir(spark)
