"""Sources, index, retrieval, selection, store and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from folium.config import EngineConfig
from folium.functions.records import redacted_text
from folium.operators import knn, selection, store
from folium.operators.embedding import HashingEmbedder, embedded
from folium.plans import index, ingest, retrieve
from folium.sources import tables
from folium.streaming import flows

PAGES = [("a.pdf", 1, "Cabeçalho comum do documento\nA tricoscopia ajuda na avaliação da queda de cabelo."), ("a.pdf", 2, "Cabeçalho comum do documento\nConduta: minoxidil tópico e seguimento."), ("a.pdf", 3, "Cabeçalho comum do documento\nOleosidade e prurido do couro cabeludo."), ("b.pdf", 1, "Ferritina baixa e exames laboratoriais na queda."), ("b.pdf", 2, "  ")]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(PAGES, "document string, page int, text string")


def test_ingest_retrieve_answer(spark, raw, tmp_path):
    path, model = str(tmp_path / "index"), HashingEmbedder()
    assert index.load(spark, path) is None
    meta = ingest.build(raw, path, model)
    built = index.load(spark, path, model=model.name)
    assert meta["rows"] == built.count() >= 3 and built.where("text like '%comum%'").count() == 0
    with pytest.raises(ValueError):
        index.load(spark, path, model="other")
    asked = spark.createDataFrame([(1, "queda de cabelo e ferritina, exames laboratoriais"), (2, "couro cabeludo oleosidade prurido")], "question_id long, question string")
    config = EngineConfig(similarity_floor=0.0, min_rerank_score=0.0, max_results_per_source=2)
    found = retrieve.retrieve(asked, built, model, config)
    rows = found.collect()
    assert {r.question_id for r in rows} == {1, 2} and all(r.rank <= config.candidates for r in rows)

    class Echo:
        name = "echo"

        def answer(self, system, prompt):
            return "Resumo das fontes [1]."

    contexts = retrieve.prompts(found, config)
    got = {r.question_id: r for r in retrieve.answered(asked, contexts, Echo()).collect()}
    assert got[1].status == "ok" and '<trecho id="1"' in got[1].context
    assert retrieve.retrieve_plain(asked, built, model, EngineConfig(window=1)).count() > 0


def test_publish_keeps_the_old_version_on_failure(spark, tmp_path):
    path = str(tmp_path / "t")
    index.publish(spark.range(5), path)
    with pytest.raises(ValueError):
        index.publish(spark.range(6), path, expected=7)
    assert index.load(spark, path).count() == 5
    index.publish(spark.range(8), path, expected=8)
    assert index.load(spark, path).count() == 8 and index.roll_back(spark, path)["rows"] == 5
    assert index.load(spark, path).count() == 5 and index.health(spark, path).first().ready


def test_chunk_lines(spark, tmp_path):
    lines = [{"text": "um texto", "source": "x.pdf"}, {"chunk_id": "k", "text": "t", "source": "y"}, {"chunk_id": "k", "text": "t", "source": "y"}, {"text": "", "source": "z"}]
    (tmp_path / "c.jsonl").write_text("\n".join(["", *map(json.dumps, lines), "{broken"]))
    good, bad = tables.checked(tables.chunk_lines(spark, str(tmp_path / "c.jsonl")))
    rows = {r.chunk_id: r for r in tables.backfilled(good).collect()}
    assert set(rows) == {"legacy_00000002", "k"} and rows["legacy_00000002"].document_id == "x" and rows["k"].page_start == 1
    assert sorted(r.error for r in bad.collect()) == ["broken JSON", "no text or source", "repeated chunk_id"]


def test_extracted_keeps_going(spark):
    files = spark.createDataFrame([("a", bytearray(b"one\ftwo")), ("b", bytearray(b"\xff"))], "path string, content binary")
    good, bad = tables.extracted(files, lambda b: b.decode().split("\f"))
    assert [(r.document, r.page, r.text) for r in good.orderBy("page").collect()] == [("a", 1, "one"), ("a", 2, "two")]
    assert [r.document for r in bad.collect()] == ["b"]


def test_knn_against_numpy(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 16))
    v[7] = v[9]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>").repartition(5)
    asked = df.where("vec_id < 9").select(F.col("vec_id").alias("query_id"), "embedding")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for r in knn.top_k(asked, df, 6).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))).alias("h")).collect():
        sim = (u @ u[r.query_id]).round(12)
        assert [x.vec_id for x in r.h] == sorted(range(300), key=lambda i: (-sim[i], i))[:6]
    one, many = (sorted((r.query_id, r.rank, r.vec_id) for r in knn.top_k(asked, df, 6, query_bytes=n).collect()) for n in (1 << 20, 3 * 16 * 8))
    assert one == many
    near = knn.lsh_top_k(asked, df, 1, length=16)
    assert near.where("query_id = vec_id").count() >= 8


def test_selection_order_of_tests(spark):
    base = "a b c d e f g h"
    rows = [(1, "c1", "s1", 1, 0.9, False, base), (1, "c2", "s1", 2, 0.8, False, "other words here now ok"), (1, "c3", "s2", 3, 0.8, True, "x"), (1, "c4", "s3", 4, 0.7, False, base), (1, "c5", "s4", 5, 0.4, False, "y"), (1, "c6", "s5", 6, 0.6, False, "quite different text of its own")]
    df = spark.createDataFrame(rows, "question_id long, chunk_id string, source string, place int, adjusted_score double, rejected boolean, window_text string")
    df = df.withColumns({"window_ids": F.array("chunk_id"), "window_score": F.col("adjusted_score"), "window_rejected": F.col("rejected")})
    got = {r.chunk_id: r.discard_reason for r in selection.select(df).collect()}
    assert got == {"c1": None, "c2": "source_cap", "c3": "policy", "c4": "near_duplicate", "c5": "score", "c6": None}


def test_budget_skips_what_overflows(spark):
    blocks = ["x" * 60, "y" * 50, "z" * 30]
    r = spark.createDataFrame([(blocks,)], "b array<string>").select(selection.within_budget(F.col("b"), 100).alias("k")).first()
    assert [x.place for x in r.k] == [1, 3]
    cut = spark.createDataFrame([(["x" * 300, "y"],)], "b array<string>").select(selection.within_budget(F.col("b"), 200).alias("k")).first()
    assert cut.k[0].block.startswith("x" * 80 + "\n[trecho truncado")


def test_evaluated(spark):
    cases = spark.createDataFrame([("a", "q", ["exame"], ["termo"], ["procedure"]), ("b", "q", ["z"], [], [])], tables.CASE_FIELDS)
    hits = spark.createDataFrame([("a", "s.pdf", "Exâme físico", "assessment")], "name string, source string, text string, content_type string")
    assert {r.name: r.passed for r in retrieve.evaluated(cases, hits).collect()} == {"a": True, "b": False}


def test_redact():
    raw = {"Senha ": 1, "a": {"token": 2, "l": [{"cpf": 1}, "x" * 600, 3, None, [1, "b"]]}, "e": "", "f": [], "ok": True}
    want = {"Senha ": "[removido]", "a": {"token": "[removido]", "l": [{"cpf": "[removido]"}, "x" * 497 + "...", 3, None, "[1, 'b']"]}, "e": "", "f": [], "ok": True}
    assert json.loads(redacted_text(json.dumps(raw))) == want
    assert [redacted_text(x) for x in (None, "", "[1]", "{broken", "3")] == ["{}"] * 5


def attempts(spark):
    rows = [(1, i, i, i == 3) for i in range(12)] + [(2, 0, 0, False)]
    return spark.createDataFrame(rows, "user_id long, event_id long, s long, success boolean").withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_lockouts(spark):
    got = {(r.user_id, r.event_id): (r.failures, r.locked_until is not None) for r in store.lockouts(attempts(spark)).collect()}
    assert got[1, 2] == (3, False) and got[1, 8] == (5, True) and got[1, 11] == (8, True) and got[2, 0] == (1, False)


def test_stream_ingest(spark, raw, tmp_path):
    raw.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in"))
    flows.ingest(stream, str(tmp_path / "out"), str(tmp_path / "ck"), HashingEmbedder(8)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == embedded(ingest.chunked(raw), HashingEmbedder(8)).count()


class Scripted:
    """Answers badly, well once repaired, or not at all; notes each call in a folder."""

    name = "scripted"

    def __init__(self, folder):
        self.folder = folder

    def answer(self, system, prompt):
        import uuid
        from pathlib import Path

        Path(self.folder, uuid.uuid4().hex).write_text(prompt)
        if "breaks" in prompt:
            raise TimeoutError
        if "good" in prompt or ("mends" in prompt and "<resposta_provisoria>\nNo numbers" in prompt):
            return "All is well [1]."
        return "No numbers here."


def test_answered_calls_again_only_where_needed(spark, tmp_path):
    asked = spark.createDataFrame([(1, "good one"), (2, "mends"), (3, "stays bad"), (4, "breaks"), (5, "no passages"), (6, " "), (7, "good two")], "question_id long, question string")
    contexts = spark.createDataFrame([(i, "passage", [1]) for i in (1, 2, 3, 4, 6, 7)], "question_id long, context string, places array<int>")
    rows = retrieve.answered(asked, contexts, Scripted(str(tmp_path)))
    got = {r.question_id: (r.status, r.answer) for r in rows.collect()}
    rows.count()
    well = "All is well [1]."
    assert got == {1: ("ok", well), 2: ("ok", well), 3: ("resposta_bloqueada", "No numbers here."), 4: ("erro_modelo", None), 5: ("sem_material", None), 6: ("vazio", None), 7: ("ok", well)}
    calls = [p.read_text() for p in tmp_path.iterdir()]
    assert len(calls) == 5 + 2 and sum("<resposta_provisoria>\nNo numbers here." in c for c in calls) == 2
    assert {r.status for r in retrieve.answered(asked.where("question_id < 6"), None, Scripted(str(tmp_path))).collect()} == {"erro_indice"}


def test_unused_windows(spark):
    rows = [(1, "a", 1, ["a", "b"], False), (1, "b", 2, ["b", "c"], False), (1, "c", 3, ["c", "d"], True), (1, "d", 4, ["c", "d"], False), (1, "e", 5, [], False), (1, "f", 6, ["f"], False)]
    df = spark.createDataFrame(rows, "question_id long, chunk_id string, rank int, window_ids array<string>, window_rejected boolean")
    assert sorted(r.chunk_id for r in selection.unused_windows(df).collect()) == ["a", "d", "f"]


def test_retrieve_plain_fills_up_behind_rejected_ones(spark):
    """Rejected and overlapping candidates make room for the next; the order is that of the windows' scores."""
    model = HashingEmbedder(32)
    texts = [("consentimento termo de consentimento livre e esclarecido queda de cabelo", "termo.pdf")] * 6 + [(f"queda de cabelo {i} avaliação", f"s{i}.pdf") for i in range(8)]
    rows = [(f"c{i}", f"d{i}", t, s, 0, "consent_form" if i < 6 else "review", "assessment", "general_trichology", "high", "general") for i, (t, s) in enumerate(texts)]
    built = embedded(spark.createDataFrame(rows, "chunk_id string, document_id string, text string, source string, doc_pos int, document_type string, content_type string, topic string, source_quality string, section string"), model)
    asked = spark.createDataFrame([(1, "queda de cabelo")], "question_id long, question string")
    got = retrieve.retrieve_plain(asked, built, model, EngineConfig(top_k=4)).orderBy("place").collect()
    assert len(got) == 4 and all(r.document_type == "review" for r in got) and [r.place for r in got] == [1, 2, 3, 4]
    assert [r.window_score for r in got] == sorted((r.window_score for r in got), reverse=True)


def test_publish_survives_a_crash(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    index.publish(spark.range(5), path)

    def crash(self, name, text):
        raise OSError("crash before the pointer")

    with monkeypatch.context() as m:
        m.setattr(index.Folder, "create", crash)
        with pytest.raises(OSError):
            index.publish(spark.range(9), path)
    assert index.load(spark, path).count() == 5
    folder = index.Folder(spark, path)
    assert not folder.create("_current-000000001", "{}")  # a second writer of the same number is refused
    index.publish(spark.range(8), path)
    assert index.load(spark, path).count() == 8
    for n in range(5):
        index.publish(spark.range(n), path)
    assert index.load(spark, path).count() == 4 and len([x for x in folder.names() if x.startswith(index.POINTER)]) == 3


def test_filters(spark):
    from folium.functions.filters import where

    df = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5), (None, 5)], "s string, n int")
    count = lambda spec: df.where(where(spec)).count()
    assert [count(x) for x in ({}, {"s": "a"}, {"$and": [{"s": "a"}, {"n": {"$gte": 2, "$lte": 5}}]}, {"$or": [{"s": "b"}, {"n": {"$lt": 2}}]}, {"s": {"$in": ["a", "b"]}}, {"s": {"$ne": "a"}}, {"n": {"$nin": [1]}}, {"n": {"$gt": 1}})] == [4, 2, 1, 2, 3, 1, 3, 3]
    for bad in ({"$not": []}, {"n": {"$like": 1}}, {"$and": []}):
        with pytest.raises(ValueError):
            where(bad)


def test_chat_model_asks_allowed_hosts_only():
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    from folium.sources.models import ChatModel

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"message": {"content": f" {body['model']}: {body['messages'][1]['content']} " if body["messages"][1]["content"] else ""}}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/api/chat"
    assert ChatModel("m", url).answer("s", "hello") == "m: hello"
    with pytest.raises(ValueError):
        ChatModel("m", url).answer("s", "")
    server.shutdown()
    with pytest.raises(PermissionError):
        ChatModel("m", "http://example.com/api/chat").answer("s", "x")
    with pytest.raises(ValueError):
        ChatModel("m", "http://localhost:1/other").answer("s", "x")


def test_reports(spark, tmp_path):
    from folium.plans import report

    df = spark.createDataFrame([("ok", "três [1]", 1, 0.5)], "status string, answer string, n_sources int, best_similarity double")
    rows = report.timings(["Pergunta é?", "b"], lambda q: df, "m", "e")
    assert [list(r) for r in rows] == [report.TIMING] * 2 and rows[1]["question_number"] == 2 and rows[0]["answer_characters"] == 8
    for _ in range(2):
        report.write_report(spark, str(tmp_path), "times", rows)
    raw = (tmp_path / "times.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and "Pergunta é?" in raw.decode("utf-8-sig") and json.loads((tmp_path / "times.json").read_text())[0]["status"] == "ok"
    report.write_rows(df, str(tmp_path / "rows"), "csv")
    assert spark.read.csv(str(tmp_path / "rows"), header=True).count() == 1


def test_shared_dir_is_never_local_on_a_cluster():
    from types import SimpleNamespace as N

    from folium.storage import shared_dir

    conf = {}
    session = lambda master: N(conf=N(get=conf.get, set=conf.__setitem__), sparkContext=N(master=master))
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(session(master))
    assert shared_dir(session("local[2]")) == conf["spark.checkpoint.dir"]


def test_tokens_and_passwords(spark):
    from folium.functions import tokens

    token, kept = tokens.new_token()
    assert spark.range(1).select(F.sha2(F.lit(token), 256).alias("h")).first().h == kept and tokens.new_token()[0] != token
    stored = tokens.password_hash("çãé 1")
    assert tokens.password_matches("çãé 1", stored) and not tokens.password_matches("other", stored) and not tokens.password_matches("x", "broken")


def test_lines_are_numbered_over_splits(spark, tmp_path):
    """Files of many splits: as many lines as there are, blank ones too."""
    want = {}
    for f in range(3):
        lines = ["" if (i * 7 + f) % 5 == 0 else json.dumps({"chunk_id": f"{f}-{i}", "text": "é" * (i % 60), "source": "s"}) for i in range(2000 + 700 * f)]
        (tmp_path / f"{f}.jsonl").write_text("\n".join(lines) + "\n")
        want |= {json.loads(x)["chunk_id"]: i for i, x in enumerate(lines, 1) if x}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        rows = tables.chunk_lines(spark, str(tmp_path)).select("chunk_id", "line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.chunk_id: r.line_no for r in rows} == want and len(rows) == len(want)


def test_streamed_lockouts_of_late_and_shuffled_rows(spark, tmp_path):
    """Results equal the table's, as far as the watermark gets; too late rows are dropped, idle users woken by a timer."""
    import datetime as dt
    import random

    rng, start = random.Random(6), dt.datetime(2024, 1, 1)
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), start + dt.timedelta(minutes=i // 2, microseconds=rng.randrange(2)), rng.random() < 0.15) for i in range(600)]
    rows.append((900, 4, start + dt.timedelta(minutes=20), False))  # this user comes no more
    order = sorted(rows, key=lambda r: (r[2] + dt.timedelta(minutes=rng.randrange(50)), r[0]))
    files = [order[:200], order[200:400], order[400:], [(999, 9, start + dt.timedelta(days=2), False)], [(1000, 1, start, False), (1001, 9, start + dt.timedelta(days=3), False)]]
    schema, path = "event_id long, user_id long, ts timestamp, success boolean", str(tmp_path / "in")
    for part in files:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        stream = flows.lockouts(spark.readStream.schema(schema).parquet(path), late="1 hour")
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = {r.event_id: (r.user_id, r.ts, r.failures, r.locked_until) for r in spark.read.schema(flows.LOCKS).parquet(str(tmp_path / "out")).collect()}
    want = {r.event_id: (r.user_id, r.ts, r.failures, r.locked_until) for r in store.lockouts(spark.createDataFrame(rows, schema)).collect()}
    assert 900 in want and 1000 not in got
    assert {k: v for k, v in got.items() if k != 999} == want
