import json
import threading

import pytest
from pyspark.sql import functions as F

from matchloom import config
from matchloom.errors import ConfigError, ConflictError, EngineError
from matchloom.functions.features import sparse_embedding
from matchloom.observe import STAGES, observed, stage
from matchloom.operators.models import client_vectors, embeddings_with_cache, ensure_embeddings, extract_lines, stored_vectors
from matchloom.operators.store import CHECKPOINT, Migration, Store, merged, migrate, reconciled_offers, stable_id
from matchloom.plans import report
from matchloom.schemas import EMBEDDINGS, TABLES
from matchloom.streaming.ingest import ingest_lines


def test_upsert_is_idempotent(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("R1", "a"), ("R2", "b")], "code string, title string").withColumn("id", stable_id("code"))
    store.upsert("requisitions", rows)
    store.upsert("requisitions", rows.withColumn("title", F.concat("title", F.lit("!"))).where("code = 'R1'"))
    assert sorted((r.code, r.title) for r in store.read("requisitions").collect()) == [("R1", "a!"), ("R2", "b")]
    before = store.version("requisitions")
    store.upsert("requisitions", rows.where("false"))
    assert store.read("requisitions").count() == 2 and store.version("requisitions") != before
    assert store.prune("requisitions", older_than=0) >= 2 and store.prune("requisitions") == 0
    assert store.read("requisitions").count() == 2
    store.reset(["requisitions"])
    assert store.read("requisitions").count() == 0
    with pytest.raises(ConfigError):
        store.upsert("reconciliations", rows)


def test_children_are_replaced(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("o1", 1), ("o1", 2), ("o2", 1)], "offer_id string, line_no int")
    store.replace("offer_items", rows)
    store.replace_children("offer_items", rows.where("offer_id = 'o1' AND line_no = 2"), "offer_id")
    assert sorted((r.offer_id, r.line_no) for r in store.read("offer_items").collect()) == [("o1", 2), ("o2", 1)]
    assert store.orphans("offer_items", "offer_id", "offers").count() == 2


def files(root):
    return {str(p) for p in root.rglob("*.parquet")}


def test_one_offer_costs_one_bucket(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=16)
    rows = spark.range(4000).select(F.concat(F.lit("o"), (F.col("id") % 1000).cast("string")).alias("offer_id"), (F.col("id") / 1000).cast("int").alias("line_no"))
    store.replace("offer_items", rows)
    before = store.state().tables["offer_items"]
    old = files(tmp_path / "offer_items")
    assert len(before) == 16
    store.replace_children("offer_items", rows.where("offer_id = 'o7' AND line_no = 0"), "offer_id")
    after = store.state().tables["offer_items"]
    assert sum(before[b] != after[b] for b in before) == 1 and len([f for f in files(tmp_path / "offer_items") - old if "/c-" in f]) == 1
    assert store.read("offer_items").count() == 3997 and store.of("offer_items", "o7").count() == 1 and store.of("offer_items", "o8").count() == 4
    assert "_bucket=" in store.of("offer_items", "o8").inputFiles()[0] and len(store.of("offer_items", "o8").inputFiles()) == 1
    assert store.at(1).read("offer_items").count() == 4000  # as it was


def test_update_from_touches_only_rows_with_keys(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=16)
    items = spark.range(200).select(F.concat(F.lit("i"), "id").alias("id"), F.concat(F.lit("c"), "id").alias("code"), F.array(F.lit(1.0)).alias("embedding"))
    store.replace("items", items)
    before = store.state().tables["items"]
    given = spark.createDataFrame([("i3", [5.0]), ("i3", [7.0]), ("i9", None), ("nobody", [1.0]), (None, [2.0])], "id string, embedding array<float>")
    store.update_from("items", given, "id", ["embedding"])
    got = {r.id: r.embedding for r in store.read("items").collect()}
    assert len(got) == 200 and got["i3"] == [7.0] and got["i9"] is None and got["i4"] == [1.0]
    assert sum(before[b] != f for b, f in store.state().tables["items"].items()) <= 2
    version = store.state().version
    store.update_from("items", given.where("id = 'nobody'"), "id", ["embedding"])
    assert store.state().version == version  # nothing to change, no commit


def test_two_writers_of_one_bucket_conflict(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=4)
    rows = spark.createDataFrame([("a", 1)], "offer_id string, line_no int")
    store.replace("offer_items", rows)
    one, two = store.begin(), store.begin()
    one.replace_children("offer_items", rows.withColumn("line_no", F.lit(5)), "offer_id")
    two.replace_children("offer_items", rows.withColumn("line_no", F.lit(6)), "offer_id")
    one.commit()
    with pytest.raises(ConflictError):
        two.commit()
    assert [r.line_no for r in store.read("offer_items").collect()] == [5]
    reader, writer = store.begin(), store.begin()
    reader.read("offer_items")
    reader.append("providers", spark.createDataFrame([("p",)], "name string"))
    writer.append("offer_items", rows)
    writer.commit()
    with pytest.raises(ConflictError):  # what it read has changed
        reader.commit()
    first, second = store.begin(), store.begin()
    for k, tx in enumerate((first, second)):
        tx.append("providers", spark.createDataFrame([(f"p{k}",)], "name string"))
    assert second.commit() == first.commit() - 1 and store.read("providers").count() == 2  # appends don't meet


def test_readers_never_see_half_a_commit(spark, tmp_path):
    """Two writers keep an offer's count of lines and its lines in step; a reader checks every snapshot that it gets."""
    store, seen, failed, done = Store(spark, str(tmp_path), buckets=4), [], [], threading.Event()

    def write(who):
        try:
            for k in range(1, 5):
                head = spark.createDataFrame([("r", who, who, str(k))], "requisition_id string, source_hash string, id string, terms string")
                rows = spark.range(k).select(F.lit(who).alias("offer_id"), F.col("id").cast("int").alias("line_no"))
                store.transact(lambda tx, head=head, rows=rows: (tx.upsert("offers", head), tx.replace_children("offer_items", rows, "offer_id")), attempts=40)
        except Exception as e:
            failed.append(e)

    def read():
        while not done.is_set():
            tx = Store(spark, str(tmp_path)).begin()
            counts = {r.offer_id: r["count"] for r in tx.read("offer_items").groupBy("offer_id").count().collect()}
            heads = {r.id: int(r.terms) for r in tx.read("offers").collect()}
            seen.append(counts == heads)

    writers, reader = [threading.Thread(target=write, args=(w,)) for w in ("a", "b")], threading.Thread(target=read)
    for thread in [reader, *writers]:
        thread.start()
    for thread in writers:
        thread.join(240)
    done.set()
    reader.join(60)
    assert not failed and len(seen) > 3 and all(seen)
    assert store.state().version == 8 and store.read("offer_items").count() == 8


def test_what_was_not_committed_is_not_there(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=4)
    rows = spark.createDataFrame([("a", 1)], "offer_id string, line_no int")
    tx = store.begin()
    tx.append("offer_items", rows)
    assert tx.read("offer_items").count() == 1 and store.read("offer_items").count() == 0
    assert store.begin().commit() == 0 and store.version("offer_items") is None
    for k in range(CHECKPOINT + 2):
        store.append("offer_items", rows.withColumn("line_no", F.lit(k)))
    assert any(p.name.startswith("state-") for p in (tmp_path / "log").iterdir())
    assert store.read("offer_items").count() == CHECKPOINT + 2 and store.at(3).read("offer_items").count() == 3
    assert Store(spark, str(tmp_path), buckets=99).state_buckets == 4
    store.reset(hard=True)
    assert store.read("offer_items").count() == 0


def test_a_file_is_made_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for link in (True, False):
        path = f"{tmp_path}/x{link}/1.json"
        assert store._put_new(path, "one", link) and not store._put_new(path, "two", link)
        assert store._text(path) == "one" and [p.name for p in (tmp_path / f"x{link}").iterdir() if not p.name.endswith(".crc")] == ["1.json"]


def test_migrations_and_columns_added_later(spark, tmp_path, monkeypatch):
    from pyspark.sql import types as T

    store, now = Store(spark, str(tmp_path), buckets=2), TABLES["providers"]
    monkeypatch.setitem(TABLES, "providers", T.StructType([f for f in now.fields if f.name != "created_at"]))
    store.replace("providers", spark.createDataFrame([("1", "norte")], "id string, name string"))
    monkeypatch.setitem(TABLES, "providers", now)
    assert [tuple(r) for r in store.read("providers").collect()] == [("1", "norte", None)]
    steps = [Migration("002-date", "providers", "SELECT id, name, TIMESTAMP'2024-01-01 00:00:00' AS created_at FROM {rows}"), Migration("001-upper", "providers", "SELECT id, upper(name) AS name FROM {rows}")]
    assert migrate(store, steps) == (["001-upper", "002-date"], [])
    assert [(r.name, r.created_at.year) for r in store.read("providers").collect()] == [("NORTE", 2024)]
    version = store.state().version
    assert migrate(store, [Migration("001-upper", "providers", "SELECT id, lower(name) AS name FROM {rows}"), steps[0]]) == ([], ["001-upper"])
    assert store.state().version == version and store.read("providers").first().name == "NORTE"


def test_merge_keeps_other_columns(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, v string, w string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k long, v string")
    assert sorted(map(tuple, merged(old, new, ["k"]).collect()), key=str) == [(1, "a", "x"), (2, "c", "y"), (3, "e", None)]
    assert sorted(map(tuple, merged(old, new, ["k"], update=[]).collect()), key=str) == [(1, "a", "x"), (2, "b", "y"), (3, "e", None)]


def test_status_follows_from_reconciliations(spark):
    offers = spark.createDataFrame([("a", "x"), ("b", "x")], "id string, status string")
    done = spark.createDataFrame([("a",), ("a",)], "offer_id string")
    assert {r.id: r.status for r in reconciled_offers(offers, done).collect()} == {"a": "reconciled", "b": "extracted"}


def entries(vectors):
    return {(r.text_hash, x["index"]): x["weight"] for r in vectors.collect() for x in r.vector}


def test_embedding_cache_keeps_models_apart(spark):
    texts = spark.createDataFrame([("cable",), ("tubo",), (None,), ("cable",)], "text string")
    vectors, made = embeddings_with_cache(texts, spark.createDataFrame([], EMBEDDINGS))
    assert vectors.count() == made.count() == 2
    again, more = embeddings_with_cache(texts, made)
    assert again.count() == 2 and more.count() == 0
    assert entries(again) == pytest.approx(entries(vectors))
    assert embeddings_with_cache(texts, made, dims=64)[1].count() == 2
    assert embeddings_with_cache(texts, made, force=True)[1].count() == 2
    twice, _ = embeddings_with_cache(texts, made.union(made))
    assert twice.count() == 2 and entries(twice) == pytest.approx(entries(vectors))


def test_stored_embeddings_are_made_once(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=4)
    texts = spark.createDataFrame([(1, "cable rojo"), (2, "tubo"), (3, None), (4, "cable rojo"), (5, "...")], "item_no long, text string")
    assert ensure_embeddings(store, texts) == 3 and ensure_embeddings(store, texts) == 0
    assert ensure_embeddings(store, texts.where("item_no = 2"), force=True) == 1 and store.read("text_embeddings").count() == 3
    want = {(r.item_no, r["index"]): r.weight for r in sparse_embedding(texts.where("text IS NOT NULL"), ["item_no"], F.col("text")).collect()}
    got = {(r.item_no, r["index"]): r.weight for r in stored_vectors(store, texts, "item_no").collect()}
    assert got == pytest.approx(want) and {i for i, _ in got} == {1, 2, 4, 5}


def test_clients_vectors_have_the_width_asked_for(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=4)
    texts = spark.createDataFrame([(str(k),) for k in range(7)], "text string")
    right, wrong = client_vectors(lambda batch: [[float(len(x)), 0.0, 2.0] for x in batch], batch=3), client_vectors(lambda batch: [[1.0]] * len(batch))
    assert ensure_embeddings(store, texts, "m", 3, right) == 7
    assert {(r["index"], round(r.weight, 9)) for r in stored_vectors(store, texts, "text", "m", 3).collect()} == {(0, round(5**-0.5, 9)), (2, round(2 * 5**-0.5, 9))}
    with pytest.raises(Exception, match="width"):
        ensure_embeddings(store, texts, "m2", 3, wrong)
    wide = lambda misses, dims: misses.select("text_hash", F.array(F.struct(F.lit(dims).alias("index"), F.lit(1.0).alias("weight"))).alias("vector"))
    with pytest.raises(Exception, match="wider"):
        ensure_embeddings(store, texts, "m3", 3, wide)
    assert store.read("text_embeddings").count() == 7  # nothing of the failed runs is there


def test_model_extraction(spark):
    lines = spark.createDataFrame([("a", "1 x"), ("a", "2 y"), ("b", "boom")], "path string, line string").withColumn("part", F.lit("body"))

    def client(batch):
        if "boom" in batch:
            raise ValueError
        return [{"line_no": b.split()[0], "offered_description": b.split()[1]} for b in batch]

    rows = extract_lines(lines, client).collect()
    assert sorted((r.path, r.line_no, r.failed) for r in rows if not r.failed) == [("a", "1", False), ("a", "2", False)] and sum(r.failed for r in rows) == 1


def test_reports(spark):
    from decimal import Decimal as D

    from matchloom.operators import summary
    from matchloom.operators.cascade import reconcile
    from tests.test_cascade import case

    offer, items, found = case(spark)
    lines, s = reconcile(offer, items, found), None
    s = summary.summarize(lines, items)
    head = spark.createDataFrame([("Norte | SA", "R1", "Compra")], "provider_name string, requisition_code string, requisition_title string")
    with_units = [df.withColumn("raw_unit", F.lit("metro")).withColumn("unit_of_measure", F.lit("meter")) for df in (offer, items)]
    shown = report.report_lines(lines, *with_units)
    loaded = report.load(head, s, with_units[0], shown)
    assert [r["status"] for r in loaded.lines][0] == "ambiguous" and loaded.lines[-1]["status"] == "match"
    md, page, data = (report.RENDERERS[k](loaded) for k in ("md", "html", "json"))
    assert "Tabla conciliada" in md and "$ 10,00" in md and "Norte | SA" in page and "&lt;" not in md
    assert json.loads(data)["summary"]["requisition_items"] == 4
    assert report.money(D("1234.5")) == "$ 1.234,50" and report.qty(D("2.500")) == "2,5" and report.delta(D("-3")) == "-3" and report.report_name("R/1", "a b.pdf") == "r_1_a_b"
    with pytest.raises(EngineError):
        report.REPORT_ROWS, kept = 1, report.REPORT_ROWS
        try:
            report.gathered(shown)
        finally:
            report.REPORT_ROWS = kept


def test_config(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("MATCHLOOM_TOP_K=7\nMATCHLOOM_DIMS=64\n# no\n")
    monkeypatch.setenv("MATCHLOOM_DIMS", "128")
    got = config.load({"review_brands": True}, (str(tmp_path / ".env"),))
    assert (got.top_k, got.dims, got.review_brands) == (7, 128, True)
    with pytest.raises(ConfigError):
        config.Config(dims=0)


def test_stages_are_timed(spark):
    df, seen = observed(spark.range(5), "five")
    with stage("count") as counts:
        df.collect()
        counts["rows"] = seen.get["rows"]
    assert STAGES[-1].name == "count" and STAGES[-1].counts == {"rows": 5}


def test_streamed_lines_are_stored_once(spark, tmp_path):
    source, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("o1", 1), ("o1", 2), ("o1", 2)], "offer_id string, line_no int")
    rows.write.parquet(source)
    for _ in range(2):
        query = ingest_lines(spark.readStream.schema(rows.schema).parquet(source), store, str(tmp_path / "checkpoint"))
        query.awaitTermination(60)
    assert store.read("offer_items").count() == 2
