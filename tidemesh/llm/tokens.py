"""Token counts of a public byte-level tokenizer, piece by piece."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the tokenizer's own rule for splitting a text into pieces.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ASCII = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")


def counter(path: str = TOKENIZER, remember: int = 200_000) -> Callable[[str], int]:
    """A function from a text to its number of tokens.

    Tokens never cross pieces, so a text's count is the sum over its pieces, and pieces recur: their counts are
    remembered (at most `remember` of them). Texts with other than ASCII characters go to the tokenizer whole.
    """
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    encode = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    known: dict[str, int] = {}

    def count(text: str) -> int:
        if not text.isascii() or any(c in text for c in "\x1c\x1d\x1e\x1f"):  # blanks to Python, not to the tokenizer
            return len(encode(text))
        pieces = _ASCII.findall(text)
        try:
            return sum(map(known.__getitem__, pieces))
        except KeyError:
            n = 0
            for p in pieces:
                if p not in known:
                    if len(known) >= remember:
                        known.clear()
                    known[p] = len(encode(p))
                n += known[p]
            return n

    return count


def with_token_counts(documents: DataFrame, keep: list[str], text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """The columns `keep` and n_tokens of every document; a null text has 0 tokens. Whole texts are counted."""
    fields = [documents.schema[c] for c in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_tokens long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in batches:
            n = pa.array([count(t) if t else 0 for t in b.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], n], names=[*keep, "n_tokens"])

    return documents.select(*keep, F.col(text).cast("string")).mapInArrow(run, schema)
