"""Encoding a table's texts with a public byte-level BPE tokenizer (problem 6)."""

import array
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.bpe_transducer import Encoder
from quernstone.sources.tables import spread

#: The pre-token pattern of byte_bpe_50k (a fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FOLDER = "/opt/tokenizers"

_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """This process's encoder for a vocabulary file.

    Its tables hold no cycles, and scanning millions of entries for some costs much: the cycle collector is off from here on.
    """
    gc.disable()
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def _ids(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for batch in batches:
            flat, offsets = array.array("i"), array.array("i", [0])
            for text in batch.column(1).to_pylist():
                if text:
                    e.encode(text, flat)
                offsets.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(np.frombuffer(offsets, np.int32)), pa.array(np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "ids"])

    return run


def _lengths(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for batch in batches:
            counts = []
            for text in batch.column(1).to_pylist():
                flat = array.array("i")
                if text:
                    e.encode(text, flat)
                counts.append(len(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32())], names=["id", "n_tokens"])

    return run


def encode(df: DataFrame, id_col: str, text_col: str, vocabulary: str = f"{FOLDER}/byte_bpe_50k.tiktoken", pattern: str = PATTERN) -> DataFrame:
    """(id bigint, ids array<int>) for every row of df; null and empty texts give an empty list.

    No special tokens are added, and strings that look like them are ordinary text. `vocabulary` must be a path
    that every executor can read. Rows with null or equal ids are kept.
    """
    texts = spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    return texts.mapInArrow(_ids(vocabulary, pattern), "id long, ids array<int>")


def token_counts(df: DataFrame, id_col: str, text_col: str, vocabulary: str = f"{FOLDER}/byte_bpe_50k.tiktoken", pattern: str = PATTERN) -> DataFrame:
    """(id bigint, n_tokens int) for every row of df, as `encode` counts."""
    texts = spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    return texts.mapInArrow(_lengths(vocabulary, pattern), "id long, n_tokens int")
