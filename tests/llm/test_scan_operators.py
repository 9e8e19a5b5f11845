"""Operators of one scan: token counts, codec, quality, source mix."""

import hashlib
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from matchloom.llm import bpe_codec, common
from matchloom.llm import quality as q
from matchloom.llm.bpe_codec import Codec, encode_texts
from matchloom.llm.queries import queries
from matchloom.llm.source_mix import mix_sources, mixed_rows, split_quotas, targets
from matchloom.llm.token_counts import PieceTable, count_tokens, slice_counts

ODD = ["", " ", "  a", "a  b \n c", "a\tb", "　x", "ﬁ", "a\x00b", "<s>", "</s> x", "▁a", "<0x0A>", "aaaa" * 9, " " * 15 + "x", " " * 31, "é é", "中文字", "𝔘", "It's 'LL don't", "ΑΣ Σ İ ǅ", "\x1c x\x85y", "<|endoftext|> a<|STARTOFTEXT|>", "12 3.4"]


def test_token_counts_equal_the_library():
    import pyarrow as pa
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = np.random.default_rng(0)
    texts = ODD + ["".join(rng.choice([*"abthe \n▁é中-=0"], int(n))) for n in rng.integers(0, 60, 3000)]
    assert slice_counts(PieceTable.load(path), pa.array(texts)).tolist() == [len(x) for x in library.encode(texts)]


def test_token_counts_of_awkward_rows(spark, awkward, empty, data):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = count_tokens(awkward, path, limit=8).collect()
    assert len(rows) == 10 and {(r.n_bytes, r.n_tokens) for r in rows if r.doc_id in (1, 2)} == {(0, 0)}
    assert [r.over_limit for r in rows if r.doc_id == 4] == [True]
    assert count_tokens(empty, path).count() == 0
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in count_tokens(docs, path).collect()}
    assert got == {r.doc_id: (len(r.text.encode()), len(library.encode(r.text))) for r in docs.collect()}


def test_codec_equals_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        codec = Codec(f.read())
    rng = np.random.default_rng(0)
    texts = ODD + ["".join(rng.choice(["a", "th", "The", " ", "\n", "é", "'s", "12", "...", "<|endoftext|>", "Σ", "中"], int(n))) for n in rng.integers(0, 30, 2000)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids, decoded = codec.encode(text)
        assert ids == " ".join(map(str, want.ids)) and decoded == library.decode(want.ids, skip_special_tokens=False)


def library():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def digests(tokenizer, text):
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    return len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), tokenizer.decode(ids, skip_special_tokens=False)))


def test_codec_query_gives_the_library_s_digests(spark, data, awkward):
    tokenizer = library()
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = {r.doc_id: digests(tokenizer, r.text or "") for r in docs.collect()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries()["op7_bpe_codec"](spark, data).collect()} == want
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_texts(awkward, public_tokenizers.path("word_bpe_49k.json")).collect())
    assert got == sorted((r.doc_id or 0, *digests(tokenizer, r.text or "")) for r in awkward.collect())


def test_codec_orders_marks_as_the_library():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        codec = Codec(f.read())
    tokenizer, rng = library(), np.random.default_rng(9)
    marks = [c for c in range(0x300, 0x1F000) if unicodedata.combining(chr(c))]
    later = [c for a, b in bpe_codec._LATER_MARKS for c in range(a, b + 1)]
    texts = ["\u0344\U0001e4ee", "\U0001e134\u085a", "\U0001e01b\u08d1", "\u05af\U00010f83", "\U00011935\U00011930"]
    for _ in range(4000):
        texts.append("".join(chr(int(c)) for c in rng.choice([0x61, 0xC5, 0x1E9, *rng.choice(marks, 3), *rng.choice(later, 3)], 6)))
    for text in texts:
        assert codec.encode(text)[0] == " ".join(map(str, tokenizer.encode(text, add_special_tokens=False).ids)), ascii(text)


def test_a_worker_drops_what_another_operator_remembers(spark, awkward):
    path = public_tokenizers.path("word_bpe_49k.json")

    def held(rows):
        import pyarrow as pa

        from matchloom.llm import common

        yield pa.RecordBatch.from_pydict({"n": pa.array([len(common._remembered)], pa.int64())})

    one = awkward.coalesce(1)
    assert encode_texts(one, path).count() == 10
    assert {r.n for r in common.in_arrow(one.select("doc_id"), held, "n long", bpe_codec.OWNER).collect()} <= {0, 1}
    assert {r.n for r in common.in_arrow(one.select("doc_id"), held, "n long").collect()} == {0}
    assert encode_texts(one, path).count() == 10


def test_codec_hands_results_on_in_slices(spark, monkeypatch):
    """A batch of any number of rows leaves the task in slices of bounded size, each row once and in order."""
    import pyarrow as pa

    monkeypatch.setattr(bpe_codec, "in_arrow", lambda df, task, *a: task)
    monkeypatch.setattr(bpe_codec, "SLICE_CHARACTERS", 2000)
    docs = [(k, None if k % 7 == 0 else f"some words of document {k} " * (k % 9)) for k in range(200)] + [(200, "long " * 3000), (201, "end")]
    task = encode_texts(spark.createDataFrame(docs, "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"), keep=True)
    rows = common.batch(doc_id=pa.array([k for k, _ in docs]), text=pa.array([x for _, x in docs]))
    out = list(task(rows))
    assert all(b.num_rows == 1 or sum(len(r["ids"]) + len(r["decoded"]) for r in b.slice(0, b.num_rows - 1).to_pylist()) < 2000 for b in out)
    assert len(out) > 10
    monkeypatch.setattr(bpe_codec, "SLICE_CHARACTERS", 1 << 40)
    assert [r for b in out for r in b.to_pylist()] == [r for b in task(rows) for r in b.to_pylist()] and [r["doc_id"] for b in out for r in b.to_pylist()] == list(range(202))


def test_a_word_is_remembered_once():
    """A pre-token that is a stretch by itself is encoded once, whether it came alone or within another first."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        codec = bpe_codec.Codec(f.read())
    made, encode = [], codec.encode_piece
    codec.encode_piece = lambda piece: made.append(piece) or encode(piece)
    assert codec.encode("wurd wurd, -wurd othr! othr") == tuple(" ".join(codec.encode(x)[k] for x in ("wurd", "wurd,", "-wurd", "othr!", "othr")) for k in (0, 1))
    assert sorted(made) == sorted({"wurd", ",", "-", "othr", "!"}) and not hasattr(codec, "pieces")


def test_codec_memory_is_bounded_by_size():
    made = []
    memory = bpe_codec.Memory(lambda key: made.append(key) or (key, "x" * 90), size=1000, characters=1000)
    for k in range(60):
        assert memory[f"k{k}"][0] == f"k{k}"
    assert sum(len(v[1]) for v in [*memory.values(), *memory.old.values()]) < 2000
    long = "字" * 500
    assert memory[long] == memory[long] and made.count(long) == 2


def test_codec_of_awkward_rows(awkward, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = encode_texts(awkward, path, keep=True).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert len(rows) == 10 and all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == (0, nothing, nothing) for r in rows if r.doc_id in (1, 2, 3))
    assert all(r.n_tokens == len(r.ids.split()) for r in rows)
    assert encode_texts(empty, path).count() == 0


def test_quality_on_held_out_rows(spark, data):
    docs, labels = (spark.read.parquet(f"{data.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    scored = q.score_quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = scored[scored.quality == 1].score, scored[scored.quality == 0].score
    assert np.mean([(good > b).mean() for b in bad]) > 0.97
    assert (scored.predicted == scored.quality).mean() > 0.95


def test_quality_ignores_what_it_must(spark, awkward, empty):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(3, 0), (None, 1), (5, None)], "doc_id long, quality int")
    rows = q.score_quality(awkward, labels).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert q.score_quality(empty, labels).count() == 0
    assert {r.score for r in q.score_quality(awkward, labels.where("false")).collect()} == {0.5}
    kept = q.keep_good(awkward, labels)
    assert kept.columns == awkward.columns and kept.count() <= 10


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = (rng.random(2000) < 1 / (1 + np.exp(-3 * x[:, 0]))).astype(float)
    net = q.fit_network(x, y, epochs=20)
    p = net.scores(x)
    assert abs(p.mean() - y.mean()) < 0.03 and abs(y[(p > 0.6) & (p < 0.8)].mean() - 0.7) < 0.1


def test_targets_share_the_excess():
    got = targets(np.array([10, 1000, 1000, 0]), np.array([1.0, 2.0, 3.0, 1.0]))
    assert got[0] == 30 and got[3] == 0 and abs(got.sum() - 2010) < 1e-9 and abs(got[2] / got[1] - 1.5) < 1e-9
    assert targets(np.zeros(2, np.int64), np.ones(2)).tolist() == [0, 0]


def test_quotas_add_up():
    quotas = np.array([5, 0, 17, 100])
    out = split_quotas(quotas, 7, np.random.default_rng(0))
    assert (out.sum(0) == quotas).all() and out.sum(1).max() - out.sum(1).min() <= 1 and (out >= 0).all()


def test_mix(spark, data):
    docs = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet")
    rows = mix_sources(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    assert len(rows) == 1000 and (rows.taken <= 3 * rows["size"]).all() and (rows.taken % rows["size"].clip(lower=1) == 0).all()
    by = rows.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((by.taken - by.target).abs() < 0.05 * by.target).all() and abs(by.target.sum() - rows["size"].sum()) < 1e-6
    again = mix_sources(docs).select("doc_id", "taken").toPandas()
    assert dict(zip(again.doc_id, again.taken, strict=True)) == dict(zip(rows.doc_id, rows.taken, strict=True))
    draws = mix_sources(docs).select("doc_id", F.explode("draws").alias("d")).select("doc_id", "d.*").toPandas()
    copies = rows[rows["size"] > 0].set_index("doc_id").eval("taken / size")
    assert not draws.duplicated(["doc_id", "place"]).any() and (draws[draws.doc_id.isin(copies.index)].groupby("doc_id").size().reindex(copies.index, fill_value=0) == copies).all()


def test_mixed_rows_are_dealt_to_shards_and_shuffled(spark, data):
    docs = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet")
    want = sorted((r.d.shard, r.d.place, r.doc_id) for r in mix_sources(docs).select("doc_id", F.explode("draws").alias("d")).collect())
    rows = mixed_rows(docs, shard_col="shard").withColumn("at", F.monotonically_increasing_id()).select("doc_id", "shard", "at").collect()
    assert len(rows) == len(want)
    for shard in {w[0] for w in want}:
        got = [r.doc_id for r in sorted(rows, key=lambda r: r["at"]) if r.shard == shard]
        assert got == [w[2] for w in want if w[0] == shard] and got != sorted(got)
        assert len({r["at"] >> 33 for r in rows if r.shard == shard}) == 1


def test_mix_query_gives_its_shards_and_places(spark, data):
    rows = queries()["op10_source_mix"](spark, data).collect()
    assert {s for r in rows for s in r.shards} == set(range(16))
    assert all(len(r.shards) == len(r.places) and r.size * len(r.shards) == r.taken for r in rows)


def test_mix_of_awkward_rows(awkward, empty):
    rows = mix_sources(awkward).collect()
    assert len(rows) == 10 and all(r["size"] == 0 and r.taken == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert mix_sources(empty).count() == 0
    assert mixed_rows(awkward).columns == awkward.columns
    assert {r.target for r in mix_sources(awkward.where("doc_id <= 3")).collect()} == {0.0}


@pytest.mark.parametrize("every", [1, 3])
def test_hot_source(spark, every):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a b "), (F.col("id") % 40).cast("int")).alias("text"), F.when(F.col("id") % 3 < every, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 11).cast("string"))).alias("source"))
    by = mix_sources(docs).join(docs, "doc_id").groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 80 for r in by)
