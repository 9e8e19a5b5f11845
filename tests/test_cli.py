import argparse

import pytest

from matchloom import cli, config
from matchloom.errors import ConfigError, EngineError, ExtractionError
from matchloom.operators import providers
from matchloom.operators.cascade import LexicalDecider
from matchloom.operators.models import extract_pdf_with_model, stand_in_match
from matchloom.operators.store import Store

from .test_sources import workbook


def test_from_files_to_report(spark, tmp_path):
    (tmp_path / "purchase_requests.csv").write_text("request_id,title\nR1,Compra\n")
    (tmp_path / "purchase_request_items.csv").write_text('request_id,item_id,description,quantity,unit\nR1,1,Cable rojo 4 mm2,"1.000",metro\nR1,2,Tubo PVC 110,2,tubo\nR1,3,Caja estanca,1,unidad\n')
    workbook(tmp_path / "oferta.xlsx", [["Proveedor", "Norte"], ["Linea", "Codigo", "Descripcion", "Cantidad", "Unidad", "Precio"], [1, "A-1", "Cable rojo 4 mm2", 1000, "metro", 2.5], [2, "A-2", "Tubo PVC 110", 1, "tubo", 3]])
    store = Store(spark, str(tmp_path / "store"))
    assert cli.seed(store, str(tmp_path)) == cli.seed(store, str(tmp_path)) == "R1"
    key = cli.process(store, str(tmp_path / "oferta.xlsx"), "R1")
    assert cli.process(store, str(tmp_path / "oferta.xlsx"), "R1") == key and store.read("offer_items").count() == 2
    done, found = cli.run_reconcile(store, key, config.Config())
    s = found.first()
    assert (s.covered, s.n_match, s.n_partial_quantity, s.n_missing_from_offer, s.shortfall_lines) == (2, 1, 1, 1, 1)
    with open(cli.run_report(store, done, "md", str(tmp_path / "out")), encoding="utf-8") as f:
        text = f.read()
    assert "Norte" in text and "Caja estanca" in text and "Avisos" not in text
    assert [r.n for r in cli.listed(store, "offers").collect()] == [2] and cli.listed(store, "reconciliations").first().covered == 2


def request(folder):
    (folder / "purchase_requests.csv").write_text("request_id,title\nR1,Compra\n")
    (folder / "purchase_request_items.csv").write_text("request_id,item_id,description,quantity,unit\nR1,1,Soga trenzada,3,metro\nR1,2,Cinta de papel,2,rollo\n")


HEAD = "Proveedor: Vivero\nLinea Codigo proveedor Descripcion ofertada Cantidad Unidad Precio unit.\n"


def test_page_texts_to_report_with_warnings(spark, tmp_path, capsys):
    request(tmp_path)
    offer = tmp_path / "oferta.txt"
    offer.write_text(HEAD + "1 FER-0X200 Soga trenzada 3 metro 4,00\nalgo suelto\n\f4 FER-0X201 Cinta de papel 2 rollo 5,00 nota rara\n")
    store, settings = Store(spark, str(tmp_path / "store"), buckets=4), config.Config()
    cli.seed(store, str(tmp_path))
    cli.run(spark, store, argparse.Namespace(command="process", path=str(offer), code="R1"), settings, counts := {})
    printed = capsys.readouterr().out.split("\n")
    assert counts == {"lines": 2, "warnings": 3} and [p.split("]")[0] for p in printed[:3]] == ["[unparsed_line", "[line_gap", "[unknown_note"]
    key = printed[3]
    done, found = cli.run_reconcile(store, key, settings)
    assert found.first().n_match == 2
    for form in ("md", "html", "json"):
        with open(cli.run_report(store, done, form, str(tmp_path / "out")), encoding="utf-8") as f:
            assert "line_gap" in f.read()
    offer.write_text(HEAD + "sin lineas\n")
    with pytest.raises(ExtractionError, match="oferta.txt"):
        cli.process(store, str(offer), "R1")
    with pytest.raises(EngineError, match="form feeds"):
        cli.process(store, str(tmp_path / "x.pdf"), "R1")


def test_units_are_converted_where_settings_say_so(spark, tmp_path):
    (tmp_path / "purchase_requests.csv").write_text("request_id,title\nR1,Compra\n")
    (tmp_path / "purchase_request_items.csv").write_text("request_id,item_id,description,quantity,unit\nR1,1,Cable rojo rollo x 100 m,200,metro\n")
    workbook(tmp_path / "o.xlsx", [["Proveedor", "Norte"], ["Linea", "Descripcion", "Cantidad", "Unidad", "Precio"], [1, "Cable rojo", 2, "rollo", 2.5]])
    store = Store(spark, str(tmp_path / "store"), buckets=4)
    cli.seed(store, str(tmp_path))
    key = cli.process(store, str(tmp_path / "o.xlsx"), "R1")
    first, plain = cli.run_reconcile(store, key, config.Config())
    second, found = cli.run_reconcile(store, key, config.Config(convert_units=True))
    assert (plain.first().n_partial_quantity, found.first().n_match) == (1, 1) and first.endswith("-1") and second.endswith("-2")


def test_warnings_of_an_offer_are_replaced(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=4)
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "offer_id string, code string")
    store.replace("offer_warnings", rows)
    store.transact(lambda tx: tx.replace_children("offer_warnings", rows.where("false"), "offer_id", also=["a"]))
    assert [r.offer_id for r in store.read("offer_warnings").collect()] == ["b"]


def test_vectors_of_a_request_are_made_once(spark, tmp_path, capsys):
    request(tmp_path)
    store = Store(spark, str(tmp_path / "store"), buckets=4)
    for want in (2, 0):
        cli.run(spark, store, argparse.Namespace(command="seed", folder=str(tmp_path)), config.Config(), counts := {})
        assert counts == {"vectors": want}
    requisition = store.read("requisitions").first().id
    assert cli.ensure_requisition_embeddings(store, requisition, config.Config(), force=True) == 2
    assert cli.ensure_requisition_embeddings(store, requisition, config.Config(dims=64)) == 2 and store.read("text_embeddings").count() == 4


def test_the_provider_follows_from_settings(monkeypatch):
    live = dict(dry_run=False)
    assert providers.chosen(config.Config(google_key="k")) is None  # a dry run
    assert providers.chosen(config.Config(**live)) is None and providers.chosen(config.Config(google_key="k", **live)) == "google"
    assert providers.chosen(config.Config(google_key="k", openai_key="k", **live)) == "openai" and providers.chosen(config.Config(google_key="k", openai_key="k", provider="google", **live)) == "google"
    assert providers.chosen(config.Config(google_key="k", provider="openai", **live)) is None
    with pytest.raises(ConfigError):
        providers.chosen(config.Config(provider="other", **live))
    settings = config.Config(google_key="k", **live)
    monkeypatch.setattr(providers, "_FACTORIES", {})
    with pytest.raises(ConfigError):
        providers.decider(settings)
    providers.register("google", lambda s: providers.Clients("m", match=stand_in_match))
    assert providers.decider(settings).client is stand_in_match and providers.embedder(settings)[0] == "hashed"
    assert isinstance(providers.decider(config.Config()), LexicalDecider)


def test_model_lines_are_checked_against_patterns(spark):
    text = HEAD + "1 FER-0X200 Soga trenzada 3 metro 4,00\n2 FER-0X201 Cinta 2 rollo 5,00\n3 FER-0X202 Clavo 9 caja 6,00\n4 FER-0X203 Boom 1 unidad 1,00\n5 FER-0X204 Pala 1 unidad 2,00\n"
    pages = spark.createDataFrame([("a.pdf", 1, text)], "path string, page int, text string")

    def client(texts, error=None):
        if any("Boom" in t for t in texts):
            raise ValueError("boom")
        if error is None and "Soga" in texts[0]:
            raise ValueError("again, please")
        read = [t.split() for t in texts if "Clavo" not in t]
        return [{"line_no": r[0], "supplier_code": r[1], "offered_description": r[2], "offered_quantity": r[-3], "unit": r[-2], "unit_price": "9,99" if r[0] == "2" else r[-1]} for r in read]

    headers, items, warnings = extract_pdf_with_model(pages, client, batch=1)
    assert headers.first().provider_name == "Vivero" and sorted(r.line_no for r in items.collect()) == [1, 2, 5]
    got = sorted((w.code, w.line_no or 0) for w in warnings.collect())
    assert got == [("line_gap", 3), ("llm_failed", 0), ("llm_failed", 3), ("llm_failed", 4), ("llm_retry", 2)]
