"""The pipeline's stages, each on what the one before kept."""

import hashlib
import os
import re
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corpus_pipeline import quality as quality_kept
from matchloom.llm import common
from matchloom.llm.common import batch, in_arrow
from matchloom.llm.quality import score_quality
from matchloom.llm.source_mix import mix_sources

from .test_duplicates import cut, joined, shingles


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, data).write.parquet(str(tmp_path / name))
        kept[name], before = spark.read.parquet(str(tmp_path / name)), docs
        docs = kept[name]
        if name != "tokens":
            assert docs.dtypes == before.dtypes
    rows = {n: kept[n].collect() for n in kept}
    source = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    good = {r.doc_id for r in score_quality(source, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in rows["quality"]} == good
    label = joined({r.doc_id: shingles(r.text) for r in rows["quality"]})
    assert sorted(r.doc_id for r in rows["near_duplicates"]) == sorted({k for k, v in label.items() if k == v})
    want = cut([(r.doc_id, r.text) for r in rows["near_duplicates"]])
    assert {r.doc_id: len((r.text or "").split()) for r in rows["substrings"]} == {i: n - gone for i, (n, gone, _) in want.items()}
    draws = {r.doc_id: len(r.draws) for r in mix_sources(kept["substrings"]).collect()}
    drawn = Counter(r.doc_id for r in rows["mixture"])
    assert drawn == Counter({i: n for i, n in draws.items() if n}) and all(n <= 3 for n in drawn.values())
    text = {r.doc_id: r.text for r in rows["substrings"]}
    assert all(r.text == text[r.doc_id] for r in rows["mixture"])
    assert Counter(r.doc_id for r in rows["tokens"]) == drawn
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    for r in rows["tokens"]:
        ids = " ".join(map(str, library.encode(text[r.doc_id], add_special_tokens=False).ids))
        assert hashlib.sha256(ids.encode()).hexdigest() == r.ids_sha256


def test_awkward_rows(spark, data, tmp_path):
    """Null and repeated ids, null and empty texts, repeated rows and columns with clashing names go through all stages."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    good = [r.text for r in quality_kept(spark, docs, data).orderBy("doc_id").limit(6).collect()]
    rows = [(None, good[0]), (None, good[1]), (5, good[2]), (5, good[3]), (6, good[4]), (6, good[4]), (7, good[4]), (8, None), (9, ""), (10, "a b c"), (11, good[5] * 3)]
    more = [(i, t, "es", None if k % 4 == 3 else f"s{k % 2}", 1, "clash", {"k": k}) for k, (i, t) in enumerate(rows)]
    awkward = spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long, draws string, other_id map<string, int>")
    both = docs.select("doc_id", "text", "lang", "source", "n_chars", F.lit("x").alias("draws"), F.lit(None).cast("map<string, int>").alias("other_id")).where("doc_id >= 100").unionByName(awkward)
    for name, stage in corpus_pipeline.STAGES:
        before, both = both, stage(spark, both, data)
        both.write.parquet(str(tmp_path / name))
        both = spark.read.parquet(str(tmp_path / name))
        if name == "near_duplicates":
            texts = Counter(r.text for r in both.collect())
            assert all(texts[g] == 1 for g in good[:5])  # each of the texts that share nothing, once
        if name != "tokens":
            assert both.columns == before.columns
    assert both.count() > 0


def test_empty_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
        assert docs.collect() == []


def test_run_and_registry(spark, data):
    import __spark_entry__ as entry

    assert {"pipeline", *(f"op{k}_" for k in range(1, 11))} <= {n if n == "pipeline" else n.split("_")[0] + "_" for n in entry.queries()}
    assert corpus_pipeline.run(spark, data).count() > 0


def test_a_worker_gives_back_what_a_task_freed(spark):
    """Workers wait between stages; one that kept all it once took would stand beside the later stages' memory."""

    def taken():
        return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text()).group(1)) // 1024

    def grow(rows):
        freed = [np.ones(8000) for _ in range(4000)]
        common.remembered("")["last"] = np.ones(8000)  # stands above what is freed, so that it can't shrink by itself
        yield batch(worker=[os.getpid()], mb=[taken() if freed else 0])

    def look(rows):
        yield batch(worker=[os.getpid()], mb=[taken()])

    (grown,), found = (in_arrow(spark.range(n, numPartitions=n), task, "worker long, mb long").collect() for n, task in ((1, grow), (64, look)))
    left = [r.mb for r in found if r.worker == grown.worker]
    assert left and max(left) < grown.mb - 150
