"""Models as strategies: token counters, embedders, rerankers and chat endpoints, with offline stand-ins."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    """Vectors of texts; ``model_id`` changes whenever the vectors would."""

    model_id: str
    dims: int

    def embed(self, texts: list[str]) -> list[tuple[list[float], dict[int, float]]]: ...


class Reranker(Protocol):
    model_id: str

    def score(self, query: str, passages: list[str]) -> list[float]: ...


def tokenizer_counter(path: str) -> Callable[[str], int]:
    """Counts tokens, special ones included, by a tokenizer file; loaded once a worker, repeated texts remembered."""
    @lru_cache(maxsize=1)
    def load():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    @lru_cache(maxsize=65_536)
    def count(text: str) -> int:
        return len(load().encode(text).ids)

    return count


class HashingEmbedder:
    """Deterministic vectors without a model: hashed words, dense by random signs, sparse by counts."""

    def __init__(self, dims: int = 64):
        self.dims, self.model_id = dims, f"hashing-{dims}"

    def embed(self, texts: list[str]) -> list[tuple[list[float], dict[int, float]]]:
        import zlib

        out = []
        for text in texts:
            dense = np.zeros(self.dims)
            sparse: dict[int, float] = {}
            for word in text.lower().split():
                code = zlib.crc32(word.encode())
                dense[code % self.dims] += 1 if code & 0x10000 else -1
                sparse[code % 10_000] = max(sparse.get(code % 10_000, 0.0), 1.0)
            norm = float(np.linalg.norm(dense)) or 1.0
            out.append(((dense / norm).tolist(), sparse))
        return out


def pooled_weights(token_ids: list[int], weights: list[float], special: frozenset[int] | set[int]) -> dict[int, float]:
    """The greatest positive weight of each token; special tokens and those without weight are left out."""
    best: dict[int, float] = {}
    for token, weight in sorted(zip(token_ids, weights), key=lambda x: x[1]):
        if weight > 0 and token not in special:
            best[int(token)] = float(weight)
    return best


class OnnxEmbedder:
    """Dense and sparse vectors of an exported encoder: the first position scaled to length 1, and a weight per token
    from a linear layer over all positions.

    ``session`` runs ``input_ids, attention_mask`` to the hidden states (``onnxruntime.InferenceSession`` of a model
    file, or a stand-in), ``tokenizer`` is a ``tokenizers.Tokenizer``, ``sparse`` the weights and bias of the layer.
    """

    def __init__(self, session, tokenizer, model_id: str, sparse: tuple[np.ndarray, float] | None = None, max_length: int = 8192, special: tuple[int, ...] = (0, 1, 2, 3)):
        self.session, self.tokenizer, self.model_id, self.sparse, self.special = session, tokenizer, model_id, sparse, frozenset(special)
        tokenizer.enable_truncation(max_length)
        tokenizer.enable_padding()

    def embed(self, texts: list[str]) -> list[tuple[list[float], dict[int, float]]]:
        coded = self.tokenizer.encode_batch(texts)
        ids, mask = np.array([c.ids for c in coded], dtype=np.int64), np.array([c.attention_mask for c in coded], dtype=np.int64)
        hidden = np.asarray(self.session.run(None, {"input_ids": ids, "attention_mask": mask})[0], dtype=np.float64)
        first = hidden[:, 0]
        dense = first / np.maximum(np.linalg.norm(first, axis=1, keepdims=True), 1e-12)
        weights = np.zeros(ids.shape) if self.sparse is None else np.maximum(hidden @ self.sparse[0] + self.sparse[1], 0) * mask
        return [(d.tolist(), pooled_weights(i.tolist(), w.tolist(), self.special)) for d, i, w in zip(dense, ids, weights)]


class OnnxReranker:
    """Scores of an exported cross-encoder. A pair over the length loses the end of its passage, never of its query."""

    def __init__(self, session, tokenizer, model_id: str, max_length: int = 1024, batch: int = 16):
        self.session, self.tokenizer, self.model_id, self.batch = session, tokenizer, model_id, batch
        tokenizer.enable_truncation(max_length, strategy="only_second")
        tokenizer.enable_padding()

    def score(self, query: str, passages: list[str]) -> list[float]:
        out: list[float] = []
        for at in range(0, len(passages), self.batch):
            coded = self.tokenizer.encode_batch([(query, p) for p in passages[at : at + self.batch]])
            feed = {"input_ids": np.array([c.ids for c in coded], dtype=np.int64), "attention_mask": np.array([c.attention_mask for c in coded], dtype=np.int64)}
            out += np.asarray(self.session.run(None, feed)[0], dtype=np.float64).reshape(len(coded)).tolist()
        return out


def embed_texts(df: DataFrame, make: Callable[[], Embedder], dims: int, text: str = "embed_text", batch: int = 32) -> DataFrame:
    """Adds ``dense`` and ``sparse``; the model is made on first use in each task, so empty input never loads it.

    Texts go to the model by length, to keep padding small, and come back in their order. A vector of another
    dimension is an error. Null texts have null vectors.
    """
    schema = f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes)}, dense array<float>, sparse map<int,double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Embedder | None = None
        for part in batches:
            texts = part[text].tolist()
            order = sorted((i for i, t in enumerate(texts) if t is not None), key=lambda i: len(texts[i]))
            dense: list = [None] * len(texts)
            sparse: list = [None] * len(texts)
            for k in range(0, len(order), batch):
                model = model or make()
                for i, (d, s) in zip(order[k : k + batch], model.embed([texts[i] for i in order[k : k + batch]])):
                    if len(d) != dims:
                        raise ValueError(f"{model.model_id} gave {len(d)} dimensions, not {dims}")
                    dense[i], sparse[i] = d, {t: w for t, w in s.items() if w > 0}
            yield part.assign(dense=dense, sparse=sparse)

    return df.mapInPandas(run, schema)


def rerank_pairs(df: DataFrame, make: Callable[[], Reranker], query: str = "query", passage: str = "passage") -> DataFrame:
    """Adds ``rerank_score`` of each row's query and passage."""
    schema = f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes)}, rerank_score double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Reranker | None = None
        for part in batches:
            scores = pd.Series(np.nan, index=part.index, dtype=float)
            for q, rows in part.groupby(query, sort=False):
                model = model or make()
                scores.loc[rows.index] = model.score(q, rows[passage].fillna("").tolist())
            yield part.assign(rerank_score=scores)

    return df.mapInPandas(run, schema)


class ChatEndpoint:
    """An OpenAI-compatible chat endpoint at temperature 0, optionally bound to a JSON schema."""

    def __init__(self, url: str, model: str, timeout: float = 120.0, max_tokens: int = 1024, key: str | None = None, system: str | None = None):
        self.system = system
        self.url, self.model, self.timeout, self.max_tokens, self.key = url, model, timeout, max_tokens, key

    def __call__(self, prompt: str, schema: str | None = None) -> str:
        body = {"model": self.model, "temperature": 0, "max_tokens": self.max_tokens, "messages": [*([{"role": "system", "content": self.system}] if self.system else []), {"role": "user", "content": prompt}]}
        if schema:
            body["response_format"] = {"type": "json_schema", "json_schema": {"name": "reply", "schema": json.loads(schema)}}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(f"{self.url}/chat/completions", json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)["choices"][0]["message"]["content"]


def ask(prompts: DataFrame, call: Callable[[str], str], prompt: str = "prompt") -> DataFrame:
    """Adds ``reply`` and ``call_error``; a failed call is a row with an error, not a failed job."""
    schema = f"{', '.join(f'`{n}` {t}' for n, t in prompts.dtypes)}, reply string, call_error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            replies, errors = [], []
            for p in part[prompt]:
                try:
                    replies.append(call(p))
                    errors.append(None)
                except Exception as failed:
                    replies.append(None)
                    errors.append(f"{type(failed).__name__}: {failed}")
            yield part.assign(reply=replies, call_error=errors)

    return prompts.mapInPandas(run, schema)
