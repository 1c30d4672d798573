"""Token counts with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies, as ranks (base64 piece, rank per line); pass another path to count with another vocabulary.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how byte-level BPE vocabularies of this family cut text into pieces before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(data: bytes) -> object:
    """An encoding from the bytes of a rank file; special tokens in a text are ordinary text."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, count: str = "n_tokens") -> DataFrame:
    """``documents`` without ``text`` but with its number of tokens; NULL and empty texts have 0. The vocabulary file is read once, on the
    driver (it is under 2 MB), so executors need no file of their own."""
    ranks = documents.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    rest = [c for c in documents.columns if c != text]
    shape = documents.select(*rest, F.lit(0).cast("long").alias(count)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for b in batches:
            enc = enc or encoder(ranks.value)
            t = b.column(b.schema.get_field_index(text)).to_pylist()
            n = [len(enc.encode_ordinary(x)) if x else 0 for x in t]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), pa.array(n, pa.int64())], names=[*rest, count])

    return documents.mapInArrow(run, shape)
