"""Embedding providers and the batched embedding of chunk rows."""

from __future__ import annotations

import json
import math
import re
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from corpusloom.config import Settings


class Provider(Protocol):
    def embed_documents(self, texts: list[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...

    def healthcheck(self) -> bool: ...


class HashingProvider:
    """Deterministic local vectors: signed hashes of words and their trigrams, normalised. No model, no network."""

    def __init__(self, settings: Settings, dimension: int = 64):
        self.settings, self.dimension = settings, dimension

    def _vector(self, text: str) -> list[float]:
        import xxhash

        out = [0.0] * self.dimension
        for word in re.findall(r"\w+", text.lower()):
            for gram, weight in [(word, 1.0), *((f"#{word[i : i + 3]}", 0.3) for i in range(len(word) - 2))]:
                h = xxhash.xxh3_64_intdigest(gram)
                out[h % self.dimension] += weight if h >> 63 else -weight
        size = math.sqrt(sum(x * x for x in out))
        return [x / size for x in out] if size else out

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        return [self._vector(t) for t in texts]

    def embed_query(self, text: str) -> list[float]:
        return self._vector(text)

    def healthcheck(self) -> bool:
        return True


class HttpProvider:
    """A remote service: the OpenAI-style endpoint first, the native one where that is missing or refuses the size.

    A batch refused as too large is halved; a single text refused is halved by itself and the two vectors are
    averaged, neither weighted nor normalised. Failures to connect are retried as a whole and then raised, not halved.
    """

    def __init__(self, settings: Settings, timeout: float = 60.0, attempts: int = 3):
        if not settings.embedding_url:
            raise RuntimeError("the http provider needs embedding_url")
        self.settings, self.base, self.timeout, self.attempts = settings, settings.embedding_url.rstrip("/"), timeout, attempts

    def _post(self, path: str, body: dict):
        request = urllib.request.Request(self.base + path, json.dumps(body).encode(), {"Content-Type": "application/json"})
        for n in range(self.attempts):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError:
                raise
            except OSError:
                if n + 1 == self.attempts:
                    raise
        return None

    def _once(self, texts: list[str], prompt: str | None) -> list[list[float]]:
        named = {"prompt_name": prompt} if prompt else {}
        try:
            data = self._post("/v1/embeddings", {"input": texts, "model": self.settings.embedding_model, **named})["data"]
            return [x["embedding"] for x in sorted(data, key=lambda x: x.get("index", 0))]
        except urllib.error.HTTPError as e:
            if e.code not in (404, 405, 413):
                raise
        return self._post("/embed", {"inputs": texts, **named})

    def _split(self, texts: list[str], prompt: str | None) -> list[list[float]]:
        try:
            return self._once(texts, prompt)
        except urllib.error.HTTPError as e:
            if e.code != 413 or (len(texts) == 1 and len(texts[0]) < 2):
                raise
        if len(texts) > 1:
            half = len(texts) // 2
            return self._split(texts[:half], prompt) + self._split(texts[half:], prompt)
        half = len(texts[0]) // 2
        left, right = (self._split([t], prompt)[0] for t in (texts[0][:half], texts[0][half:]))
        return [[(a + b) / 2 for a, b in zip(left, right, strict=True)]]

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        s = self.settings
        return self._split([s.document_prefix + t if s.document_prefix else t for t in texts], s.document_prompt_name) if texts else []

    def embed_query(self, text: str) -> list[float]:
        s = self.settings
        return self._split([s.query_template.replace("{query}", text)], s.query_prompt_name)[0]

    def healthcheck(self) -> bool:
        try:
            with urllib.request.urlopen(f"{self.base}/health", timeout=self.timeout):
                return True
        except OSError:
            return False


class LocalModelProvider:
    """A model in the worker's own process: `embedding_model` names a folder with model.onnx and tokenizer.json.

    The last hidden states of a text's tokens are averaged and normalised. Texts longer than `most_tokens` are cut into
    runs of that length whose averages are weighted by their tokens, so no text is cut off. One session a process.
    """

    _loaded: dict[str, tuple] = {}

    def __init__(self, settings: Settings, most_tokens: int = 512):
        self.settings, self.most = settings, most_tokens

    @classmethod
    def load(cls, folder: str) -> tuple:
        """(session, tokenizer) of a folder that every worker can read."""
        if folder not in cls._loaded:
            import onnxruntime
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(f"{folder}/tokenizer.json")
            tokenizer.no_truncation()
            tokenizer.no_padding()
            cls._loaded[folder] = onnxruntime.InferenceSession(f"{folder}/model.onnx", providers=["CPUExecutionProvider"]), tokenizer
        return cls._loaded[folder]

    def _vectors(self, texts: list[str]) -> list[list[float]]:
        import numpy as np

        session, tokenizer = self.load(self.settings.embedding_model)
        wanted = {x.name for x in session.get_inputs()}
        runs = [(n, ids[at : at + self.most]) for n, ids in enumerate(e.ids for e in tokenizer.encode_batch(texts)) for at in range(0, max(1, len(ids)), self.most)]
        width = max((len(ids) for _, ids in runs), default=0) or 1
        tokens, mask = np.zeros((len(runs), width), dtype=np.int64), np.zeros((len(runs), width), dtype=np.int64)
        for row, (_, ids) in enumerate(runs):
            tokens[row, : len(ids)], mask[row, : len(ids)] = ids, 1
        given = {"input_ids": tokens, "attention_mask": mask, "token_type_ids": np.zeros_like(tokens)}
        states = np.asarray(session.run(None, {k: v for k, v in given.items() if k in wanted})[0], dtype=np.float64)
        sums = np.zeros((len(texts), states.shape[2]))
        np.add.at(sums, [n for n, _ in runs], (states * mask[:, :, None]).sum(axis=1))
        return (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)).tolist()

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        return self._vectors([self.settings.document_prefix + t for t in texts]) if texts else []

    def embed_query(self, text: str) -> list[float]:
        return self._vectors([self.settings.query_template.replace("{query}", text)])[0]

    def healthcheck(self) -> bool:
        try:
            return len(self.embed_query("health")) > 0
        except Exception:  # noqa: BLE001 - whatever keeps the model from answering
            return False


PROVIDERS: dict[str, Callable[[Settings], Provider]] = {"hashing": HashingProvider, "http": HttpProvider, "local": LocalModelProvider}


def provider(settings: Settings) -> Provider:
    if settings.embedding_backend not in PROVIDERS:
        raise RuntimeError(f"unknown embedding backend: {settings.embedding_backend}")
    return PROVIDERS[settings.embedding_backend](settings)


def batches_of(texts: list[str], most_docs: int = 24, most_chars: int = 12_000) -> Iterator[list[str]]:
    """Greedy batches in order: a batch ends at `most_docs` texts or before it would exceed `most_chars`."""
    held, size = [], 0
    for t in texts:
        if held and (len(held) >= most_docs or size + len(t) > most_chars):
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def _embed_batches(settings: Settings) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = provider(settings)  # one for each task
        for batch in batches:
            vectors = [v for group in batches_of(list(batch["text"]), settings.embed_batch_docs, settings.embed_batch_chars) for v in client.embed_documents(group)]
            if len(vectors) != len(batch):
                raise ValueError("the provider returned another number of vectors")
            yield batch.assign(vector=vectors)

    return run


def embed_chunks(chunks: DataFrame, settings: Settings) -> DataFrame:
    """Chunk rows with vector, embedding_backend, embedding_model and index_schema_version."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    rows = chunks.drop("vector")
    done = rows.mapInPandas(_embed_batches(settings), T.StructType([*rows.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))]))
    return done.withColumns({"embedding_backend": F.lit(settings.embedding_backend), "embedding_model": F.lit(settings.embedding_model), "index_schema_version": F.lit(settings.index_schema_version)})
