"""Token counts and token spans by a public tokenizer; its file is a parameter and travels to the executors."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder of the tokenizer files, and the vocabulary used unless another is named.
TOKENIZER_DIR = os.environ.get("BIBLION_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"

_loaded: dict = {}


def encoder(path: str):
    """The encoder of a rank file, loaded once in each worker."""
    if path not in _loaded:
        import tiktoken

        from pyspark import SparkFiles

        with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        try:
            from public_tokenizers import PATTERN as pattern
        except ImportError:
            pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        _loaded[path] = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_count(text: str | None, path: str, block: int = 100_000) -> int:
    """Tokens of a whole text; the encoder sees it in blocks that end at a blank.

    Unbroken runs without any blank are encoded in one piece.
    """
    if not text:
        return 0
    enc, n, at = encoder(path), 0, 0
    while at < len(text):
        end = min(len(text), at + block)
        if end < len(text):
            while end < len(text) and not (text[end] == " " and text[end - 1] > " "):
                end += 1
        n += len(enc.encode_ordinary(text[at:end]))
        at = end
    return n


def with_token_counts(df: DataFrame, keep: list[str], text: str = "text", output: str = "n_tokens", tokenizer: str | None = None) -> DataFrame:
    """Columns ``keep`` and the number of tokens of ``text`` (0 for NULL and empty)."""
    path = tokenizer or os.path.join(TOKENIZER_DIR, VOCABULARY)
    df.sparkSession.sparkContext.addFile(path)  # for executors whose machine lacks it
    slim = df.select(*keep, df[text].alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [token_count(x, path) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*keep, output])

    return slim.mapInArrow(run, ", ".join([*fields, f"`{output}` bigint"]))
