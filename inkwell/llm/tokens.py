"""Token counts of a public tokenizer, read from a rank file that stays outside the repository."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary files lie, and the one that sizes are counted with; both can be given otherwise.
FOLDER = "/opt/tokenizers"
RANKS = f"{FOLDER}/byte_bpe_multi_50k.tiktoken"


@lru_cache(4)
def encoding(path: str = RANKS):
    """The tokenizer of a rank file, loaded once per Python worker."""
    import tiktoken

    try:
        from public_tokenizers import PATTERN
    except ImportError:
        PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(4)
def byte_lengths(path: str = RANKS) -> np.ndarray:
    """Bytes of each token, by its id."""
    made = encoding(path)
    return np.array([len(made.decode_single_token_bytes(i)) for i in range(made.n_vocab)], dtype=np.int32)


def sizes(documents: DataFrame, path: str = RANKS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_tokens`` and the columns ``keep`` of every row; a null or empty text has 0 tokens.

    Whole texts are counted; the texts themselves go no further than the worker.
    """
    schema = documents.select("doc_id", *keep).schema.add("n_tokens", "long")
    n_kept = 1 + len(keep)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoding(path)
        for batch in batches:
            n = [len(made.encode_ordinary(t)) if t else 0 for t in batch.column(n_kept).to_pylist()]
            kept = [batch.column(i) for i in range(n_kept)]
            yield pa.record_batch([*kept, pa.array(n, pa.int64())], names=["doc_id", *keep, "n_tokens"])

    return documents.select("doc_id", *keep, "text").mapInArrow(count, schema)
