"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks of a byte-level BPE: the file that QUILLSTREAM_VOCABULARY names, or this one.
VOCABULARY = os.environ.get("QUILLSTREAM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the published pattern by which such a vocabulary splits a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts are encoded in runs of about so many characters.
RUN = 100_000
#: A single space between two other characters, before which the pattern always splits.
_SPLIT = re.compile(r"(?<=\S) (?=\S)")


def encoder(path: str = VOCABULARY):
    """The tokenizer of a vocabulary file."""
    import tiktoken

    if not Path(path).is_file():
        raise FileNotFoundError(f"no vocabulary at {path}: pass its path, or set QUILLSTREAM_VOCABULARY")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counted(documents: DataFrame, text: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the size of ``text``: 0 for empty and for null texts.

    Strings that look like special tokens count as ordinary text.
    """

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(vocabulary)
        for texts in batches:
            yield pd.Series([len(e.encode_ordinary(t)) if len(t) <= RUN else _long(e, t) for t in texts], dtype="int64")

    size = F.pandas_udf(count, "long")
    return documents.select(*keep, size(F.coalesce(text, F.lit(""))).alias("tokens"))


def _long(e, text: str) -> int:
    """The tokens of a long text, encoded in runs that end where the pattern splits, so that the count is that of the whole.

    Only in a word or in white space of over ``RUN`` characters a run ends anywhere: whole, it would take the encoder quadratic time.
    """
    n, at = 0, 0
    while at < len(text):
        end = len(text)
        if at + RUN < end:
            spots = [m.start() for m in _SPLIT.finditer(text, max(at + 1, at + RUN - 2_000), at + RUN)] or [m.start() for m in _SPLIT.finditer(text, at + 1, at + RUN)]
            end = spots[-1] if spots else at + RUN
        n, at = n + len(e.encode_ordinary(text[at:end])), end
    return n
