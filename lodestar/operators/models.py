"""Where models plug in: encoders, generators, projectors. The doubles here need no weights and are deterministic."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]
Generator = Callable[[list[str], list[str]], list[str]]
ENCODERS: dict[str, Callable[..., Encoder]] = {}


def register(name: str):
    def put(make: Callable[..., Encoder]) -> Callable[..., Encoder]:
        ENCODERS[name] = make
        return make

    return put


@register("hashing")
def hashing_encoder(dim: int = 64) -> Encoder:
    """Signed counts of hashed words, of length 1."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                out[i, h % dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)

    return encode


def build_encoder(name: str, **options) -> Encoder:
    if name not in ENCODERS:
        raise ValueError(f"unknown encoder {name}; known: {', '.join(sorted(ENCODERS))}")
    return ENCODERS[name](**options)


def encode(df: DataFrame, text: str, name: str, out: str = "vec", prefix: str = "", **options) -> DataFrame:
    """df with `out` (array<float>); blank texts are zero vectors and never reach the encoder."""
    rows = df.select(*[c for c in df.columns if c != out])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = build_encoder(name, **options)
        width = enc(["x"]).shape[1]
        for f in frames:
            texts = [t or "" for t in f[text]]
            some = [i for i, t in enumerate(texts) if t.strip()]
            v = np.zeros((len(texts), width), np.float32)
            if some:
                v[some] = enc([prefix + texts[i] for i in some])
            yield f.assign(**{out: list(v)})

    return rows.mapInPandas(run, rows.select("*", F.lit(None).cast("array<float>").alias(out)).schema)


def generate(df: DataFrame, document: str, generator: Generator, question: str | None = None, out: str = "answer", samples: int = 1, batch: int = 8) -> DataFrame:
    """df repeated `samples` times (column sample) with `out`; blank documents give ''. A batch that fails is tried row by row, a row that fails gives ''."""
    rows = df.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples)))).select(*[c for c in df.columns if c != out], "sample")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            docs = [d or "" for d in f[document]]
            asks = [q or "" for q in f[question]] if question else [""] * len(docs)
            made = [""] * len(docs)
            some = [i for i, d in enumerate(docs) if d.strip()]
            for lo in range(0, len(some), batch):
                part = some[lo : lo + batch]
                try:
                    got = generator([docs[i] for i in part], [asks[i] for i in part])
                except Exception:
                    got = []
                    for i in part:
                        try:
                            got += generator([docs[i]], [asks[i]])
                        except Exception:
                            got.append("")
                for i, g in zip(part, got, strict=True):
                    made[i] = g
            yield f.assign(**{out: made})

    return rows.mapInPandas(run, rows.select("*", F.lit("").alias(out)).schema)


def project(df: DataFrame, vec: str, layers: list[tuple[np.ndarray, np.ndarray]], out: str = "projected", residual: bool = False) -> DataFrame:
    """df with `out`: vec through linear layers with ReLU between them, of length 1."""
    rows = df.select(*[c for c in df.columns if c != out])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.array(f[vec].tolist(), float)
            y = x
            for k, (w, b) in enumerate(layers):
                y = y @ w + b
                if k < len(layers) - 1:
                    y = np.maximum(y, 0)
            y = x + y if residual else y
            n = np.linalg.norm(y, axis=1, keepdims=True)
            yield f.assign(**{out: list(y / np.where(n == 0, 1, n))})

    return rows.mapInPandas(run, rows.select("*", F.lit(None).cast("array<double>").alias(out)).schema)
