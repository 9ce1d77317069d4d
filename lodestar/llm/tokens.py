"""Token counts through a digest cache.

A cache is a Parquet table (tokenizer, content, n_tokens). `tokenizer` is the SHA-256 of the
tokenizer's file and of how it is used, `content` the SHA-256 of a text's normalised content.
Counting joins the texts' digests to the stored counts, encodes only the distinct contents that
are missing, and appends those to the cache.

Normalisation may only join texts whose counts are equal: for a tokenizer that turns runs of
white space into one space, ASCII runs are joined; otherwise the content is the text itself.

Encoding a missing text splits it with the tokenizer's own pattern and asks the library for each
distinct piece once; texts with characters beyond SAFE, or with strings of special tokens, go to
the library whole. Both give the library's counts.

Defined cases: null text is empty, with 0 tokens; repeated rows are counted once and answered
each; further columns stay.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import bounded_batches, shared_dir, unused

#: Characters on which the pattern and case rules of both regular expression engines agree and NFC changes nothing.
SAFE = regex.compile(r"[\t\n\r\x20-\x7e¡-įı-ɏ]*")
#: Distinct pieces that one worker remembers.
MEMO = 300_000
CACHE_SCHEMA = "tokenizer string, content string, n_tokens long"


@functools.lru_cache(maxsize=2)
def library(path: str):
    """The tokenizer of a file, by the library its suffix names."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def _rules(path: str) -> dict:
    if path.endswith(".model"):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"|no added specials|v1").hexdigest()


def joins_spaces(path: str) -> bool:
    """Whether the tokenizer itself turns every run of white space into one space before anything else splits the text."""
    rules = (_rules(path).get("normalizer") or {}).get("normalizers", [])
    return any(r.get("type") == "Replace" and r.get("pattern") == {"Regex": r"\s+"} and r.get("content") == " " for r in rules)


def piece_pattern(path: str) -> regex.Pattern | None:
    """The pattern that cuts a normalised text into the pieces encoded one by one; None if the file has no such rule."""
    for p in (_rules(path).get("pre_tokenizer") or {}).get("pretokenizers", []):
        if p.get("type") == "Split" and p.get("invert") and p.get("behavior") == "Removed":
            return regex.compile(p["pattern"]["Regex"])
    return None


class Counter:
    """Counts tokens of texts as the library does."""

    def __init__(self, path: str):
        self.path, self.lib = path, library(path)
        self.pattern = piece_pattern(path)
        self.special = [t["content"] for t in _rules(path).get("added_tokens", [])]
        self.lower = any(r.get("type") == "Lowercase" for r in (_rules(path).get("normalizer") or {}).get("normalizers", []))
        self.memo: dict[str, int] = {}

    def whole(self, texts: list[str]) -> list[int]:
        if self.path.endswith(".model"):
            return [len(x) for x in self.lib.encode(texts, num_threads=1)]
        return [len(e.ids) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[int]:
        if self.pattern is None or not self.lower:
            return self.whole(texts)
        out = [-1] * len(texts)
        cut: list[list[str]] = [[]] * len(texts)
        for i, t in enumerate(texts):
            if SAFE.fullmatch(t) and not any(s in t for s in self.special):
                cut[i] = self.pattern.findall(t.lower())
                out[i] = 0
        odd = [i for i, n in enumerate(out) if n < 0]
        for i, n in zip(odd, self.whole([texts[i] for i in odd]) if odd else [], strict=True):
            out[i] = n
        new = set().union(*cut).difference(self.memo)
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = set().union(*cut)
        fresh = list(new)
        self.memo.update(zip(fresh, self.whole(fresh) if fresh else [], strict=True))
        get = self.memo.__getitem__
        for i, c in enumerate(cut):
            if c:
                out[i] = sum(map(get, c))
        return out


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(df: DataFrame, tokenizer: str, cache: str | None = None, text: str = "text", out: str = "n_tokens", carry: dict | None = None) -> DataFrame:
    """df with the column `out`. cache: folder of the cache, made if it isn't there; None: a new one in the shared folder.

    carry: further columns computed from df's columns, kept instead of the text; without it all columns of df stay.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    own = version(tokenizer)
    if cache is None:
        cache = f"{shared_dir(spark)}/token-counts-{hashlib.sha256(os.urandom(16)).hexdigest()[:16]}"
        spark.createDataFrame([], CACHE_SCHEMA).write.parquet(cache)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == own).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    if joins_spaces(tokenizer):
        content = F.regexp_replace(content, "[ \\t\\n\\x0B\\f\\r]+", " ")
    digest = F.sha2(content, 256)

    # a copy of a text meets its likes before the shuffle: each task keeps one row of a content
    texts = df.select(F.unhex(digest).alias("_content"), content.alias("_text")).groupBy("_content").agg(F.any_value("_text").alias("_text"))
    misses = texts.join(stored.select(F.unhex("content").alias("_content")), "_content", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for b in batches:
            n = count(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["_content", "n_tokens"])

    encoded = misses.mapInArrow(encode, "_content binary, n_tokens long")
    encoded.select(F.lit(own).alias("tokenizer"), F.lower(F.hex("_content")).alias("content"), "n_tokens").write.mode("append").parquet(cache)

    known = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == own).groupBy("content").agg(F.min("n_tokens").alias("_n"))
    kept = [F.col(f"`{c}`") for c in df.columns if c != out] if carry is None else [v.alias(k) for k, v in carry.items()]
    rows = df.select(*kept)
    names = rows.columns
    own, theirs, n_ = unused(rows, "digest", "content", "stored")
    rows = df.select(*kept, digest.alias(own))
    known = known.select(F.col("content").alias(theirs), F.col("_n").alias(n_))
    return rows.join(known, F.col(own) == F.col(theirs), "left").select(*[F.col(f"`{c}`") for c in names], F.col(n_).alias(out))
