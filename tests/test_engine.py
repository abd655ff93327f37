from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.engine import Engine, NotAvailable, Settings
from folio.functions import images, models


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    rows = [("Alpha", "Alpha/one", f"a{i}", i, t, "1", "H", "m") for i, t in enumerate(["red pump manual", "blue valve list", "annual budget of the red harbour"])]
    rows += [("Beta", "Beta/two", "b1", 0, "secret red budget", "2", None, "m"), ("Gamma", "Gamma/one", "g1", 0, None, None, None, "m")]
    chunks = spark.createDataFrame(rows, "collection string, doc string, chunk_id string, ord int, text string, page string, heading string, model string")
    rules = spark.createDataFrame([("beta", ["hr"])], "name string, clients array<string>")
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('engine')}", rules)
    e.publish(chunks)
    return e


def test_scope_looks_the_same_for_hidden_and_missing(engine):
    assert engine.scope("guest") == ["Alpha", "Gamma"] and engine.scope("hr", ["beta", "Beta"]) == ["Beta"]
    said = []
    for name in ("Beta", "Nothing"):
        with pytest.raises(NotAvailable) as e:
            engine.scope("guest", [name])
        said.append(str(e.value).replace(name, "x"))
    assert said[0] == said[1]


def test_search_grep_read(engine):
    assert [r.chunk_id for r in engine.search(["red budget"], "guest").orderBy("rank").collect()][0] == "a2"
    assert {r.chunk_id for r in engine.search(["secret"], "hr", stages="bm25").collect()} == {"b1"}
    assert [r.id for r in engine.grep("RED", "guest").collect()] == ["a0", "a2"]
    assert engine.read("two", "hr").first().part == "secret red budget"
    for name in ("one", "none"):
        with pytest.raises(NotAvailable):
            engine.read(name)
    with pytest.raises(ValueError):
        engine.search([" "])
    assert [r.doc for r in engine.documents(glob="*one").collect()] == ["Alpha/one", "Gamma/one"]


def test_bench_export_import_delete(engine, tmp_path):
    labelled = engine.spark.createDataFrame([(1, "blue valve", "a1"), (2, "zzz", "a0")], "qid int, query string, key string")
    b = engine.bench(labelled, 1, "bm25").first()
    assert (b.queries, b.hit_rate, b.mrr) == (2, 0.5, 0.5)
    engine.export("Alpha", str(tmp_path / "x"))
    engine.import_(str(tmp_path / "x"), "Copy", "m")
    assert "Copy" in engine.scope("cli")
    engine.delete("Copy")
    assert "Copy" not in engine.scope("cli")


def test_settings():
    assert Settings.parse_stages("BM25, dense,bm25") == ("bm25", "dense")
    for bad in ("rerank", "", "x"):
        with pytest.raises(ValueError):
            Settings.parse_stages(bad)
    s = Settings(top_k=99, chunk_size=100, chunk_overlap=90).clamped()
    assert (s.top_k, s.chunk_overlap, s.pool, s.rerank_pool) == (25, 50, 100, 60)


def test_models(spark):
    rows = spark.createDataFrame([("red pump", "red pump"), ("red pump", None), ("q", "x")], "query string, text string")
    v = rows.select(models.embed(F.col("text")).alias("v")).collect()
    assert abs(np.linalg.norm(v[0].v) - 1) < 1e-6 and v[1].v is None
    assert [r.rerank for r in models.rerank(rows).collect()] == [1.0, 0.0, 0.0]
    broken = models.rerank(rows, "folio.functions.models:Missing").collect()
    assert all(r.rerank is None or np.isnan(r.rerank) for r in broken) and all("Error" in r.rerank_error for r in broken)


def test_images(spark):
    page = np.full((60, 80), 255)
    for y in range(5, 55, 6):
        page[y, 10:70:2] = 0
    page[58, :] = 0
    f = dict(zip((x.split()[0] for x in images.FACTS.split(", ")), images.facts(page)))
    assert f["h_rules"] == 1 and f["skew"] == 0.0 and 0 < f["ink"] < 0.2 and f["text_lines"] >= 8
    mask = np.array([[1, 1, 0, 1], [0, 1, 0, 1], [1, 1, 0, 0]], bool)
    assert sorted(images.components(mask)) == [(0, 0, 3, 2, 5), (0, 3, 2, 4, 2)]
    rows = spark.createDataFrame([(page.tolist(), 200), (None, None), ([[1], [1, 2]], 10)], "grey array<array<int>>, dpi int")
    got = rows.select("dpi", images.image_facts(F.col("grey")).alias("f")).select("dpi", "f.*").withColumn("why", images.scan_reasons()).collect()
    assert got[0].h_rules == 1 and got[1].ink is None and "resolution" in got[1].why
