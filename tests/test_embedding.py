import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from corpusloom.config import Settings
from corpusloom.operators import embedding as E


class Stub(BaseHTTPRequestHandler):
    most_chars = 40
    native_only = False
    seen: list = []

    def log_message(self, *_):
        pass

    def do_GET(self):
        self.send_response(200)
        self.end_headers()

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        texts = body.get("input") or body.get("inputs")
        self.seen.append((self.path, texts))
        if self.path == "/v1/embeddings" and self.native_only:
            return self.answer(404, {})
        if sum(map(len, texts)) > self.most_chars:
            return self.answer(413, {})
        vectors = [[float(len(t)), 1.0] for t in texts]
        self.answer(200, {"data": [{"index": i, "embedding": v} for i, v in enumerate(vectors)]} if self.path == "/v1/embeddings" else vectors)

    def answer(self, code, body):
        raw = json.dumps(body).encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)


@pytest.fixture
def service():
    handler = type("Own", (Stub,), {"seen": []})
    server = HTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield handler, Settings(embedding_backend="http", embedding_url=f"http://127.0.0.1:{server.server_port}/", document_prefix="", query_template="Q {query}")
    server.shutdown()
    server.server_close()


def test_batches():
    assert [len(b) for b in E.batches_of(["x"] * 50)] == [24, 24, 2]
    assert list(E.batches_of(["a" * 7, "b" * 7, "c" * 30], 24, 14)) == [["a" * 7, "b" * 7], ["c" * 30]]
    assert list(E.batches_of([])) == []


def test_remote(service):
    handler, settings = service
    client = E.provider(settings)
    assert client.healthcheck()
    assert client.embed_documents(["ab", "abcd"]) == [[2.0, 1.0], [4.0, 1.0]]
    assert client.embed_query("ab") == [4.0, 1.0] and client.embed_documents([]) == []


def test_remote_halves_batches_and_texts(service):
    handler, settings = service
    client = E.provider(settings)
    assert client.embed_documents(["x" * 30, "y" * 30]) == [[30.0, 1.0], [30.0, 1.0]]
    assert client.embed_documents(["z" * 60]) == [[30.0, 1.0]]


def test_remote_native_endpoint(service):
    handler, settings = service
    handler.native_only = True
    assert E.provider(settings).embed_documents(["abc"]) == [[3.0, 1.0]]
    assert [p for p, _ in handler.seen] == ["/v1/embeddings", "/embed"]


def test_unreachable_is_not_halved():
    client = E.HttpProvider(Settings(embedding_url="http://127.0.0.1:9"), timeout=0.2, attempts=2)
    assert not client.healthcheck()
    with pytest.raises(OSError):
        client.embed_documents(["a long text to split"])


def test_providers():
    with pytest.raises(RuntimeError):
        E.provider(Settings(embedding_backend="none"))
    with pytest.raises(RuntimeError):
        E.provider(Settings(embedding_backend="http"))
    own = E.provider(Settings())
    a, b = own.embed_documents(["merged window", "merged window"])
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-9 and own.embed_query("") == [0.0] * 64


def test_embed_chunks(spark):
    rows = spark.createDataFrame([("a", "merged window"), ("b", "other")], "chunk_id string, text string")
    got = E.embed_chunks(rows, Settings()).collect()
    assert {r["chunk_id"]: len(r["vector"]) for r in got} == {"a": 64, "b": 64} and got[0]["embedding_backend"] == "hashing"


def test_local_model(monkeypatch, tmp_path):
    import numpy as np
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokenizer = Tokenizer(models.WordLevel({"[UNK]": 0, "alpha": 1, "beta": 2, "gamma": 3}, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.save(str(tmp_path / "tokenizer.json"))

    class Session:
        """Each token's state is its one-hot number."""

        def __init__(self, path, providers):
            assert path.endswith("model.onnx")

        def get_inputs(self):
            return [type("I", (), {"name": n}) for n in ("input_ids", "attention_mask")]

        def run(self, _, given):
            assert set(given) == {"input_ids", "attention_mask"} and given["input_ids"].shape[1] <= 2
            return [np.eye(4)[given["input_ids"]]]

    import onnxruntime

    monkeypatch.setattr(onnxruntime, "InferenceSession", Session)
    s = Settings(embedding_backend="local", embedding_model=str(tmp_path), document_prefix="", query_template="{query}")
    p = E.LocalModelProvider(s, most_tokens=2)
    got = np.array(p.embed_documents(["alpha beta gamma alpha", "beta", ""]))
    want = np.array([0, 2, 1, 1]) / np.sqrt(6)
    assert np.allclose(got[0], want) and np.allclose(got[1], [0, 0, 1, 0]) and np.allclose(got[2], 0)
    assert np.allclose(p.embed_query("beta"), got[1]) and p.healthcheck() and p.embed_documents([]) == []
    assert isinstance(E.provider(s), E.LocalModelProvider)
    assert not E.LocalModelProvider(Settings(embedding_model=str(tmp_path / "none"))).healthcheck()
