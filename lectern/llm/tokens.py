"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the public pattern by which byte-level BPE vocabularies of this kind cut text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


class Counter:
    """Counts tokens with a tiktoken rank file or a sentencepiece model; loaded once a worker and never copied."""

    _loaded: dict[str, object] = {}

    def __init__(self, vocabulary: str):
        if vocabulary not in self._loaded:
            if vocabulary.endswith(".model"):
                import sentencepiece

                self._loaded[vocabulary] = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
            else:
                import tiktoken

                with open(vocabulary, "rb") as file:
                    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file)}
                self._loaded[vocabulary] = tiktoken.Encoding(os.path.basename(vocabulary), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.model, self.pieces = self._loaded[vocabulary], vocabulary.endswith(".model")

    def count(self, texts: list[str | None]) -> list[int]:
        if self.pieces:
            found = iter(self.model.encode([t for t in texts if t is not None], num_threads=1))
        else:
            found = (self.model.encode_ordinary(t) for t in texts if t is not None)
        return [0 if t is None else len(next(found)) for t in texts]


def token_sizes(docs: DataFrame, keep: list[str], *, vocabulary: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """The columns `keep` of docs and `name`, the number of tokens of the whole text by the vocabulary file; 0 for null and empty texts."""
    kept = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(0).cast("long").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            sizes = pa.array(counter.count(batch.column(len(keep)).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], sizes], [*keep, name])

    return kept.mapInArrow(run, schema)
