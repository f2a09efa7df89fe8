"""Token counts by a public byte-level BPE vocabulary; the vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

VOCABULARY = os.environ.get("LUMENFOLD_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the published pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Counter:
    """Token counts of texts, and the byte ends of their tokens, under one vocabulary."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int32)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text)) if text else 0

    def ends(self, text: str) -> np.ndarray:
        """Where each token ends, in bytes of UTF-8."""
        return np.cumsum(self.lengths[np.array(self.encoding.encode_ordinary(text), np.int64)], dtype=np.int64)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``n_tokens`` of every document with an id; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for b in batches:
            n = [c.count(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, "doc_id long, n_tokens long")
