"""Token counts with the vocabulary file of a public tokenizer; the path is a parameter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def token_counter(path: str = TOKENIZER):
    """A pandas UDF string -> int. Null counts as no tokens; special tokens' strings are ordinary text."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        for s in batches:
            yield pd.Series([len(e.ids) for e in t.encode_batch(s.fillna("").tolist(), add_special_tokens=False)], dtype="int32")

    return count
