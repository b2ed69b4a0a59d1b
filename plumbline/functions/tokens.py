"""Token counts and cuts by a tokenizer that the caller brings.

A tokenizer is made by a function without arguments, once in each worker, and has
encode(text) and decode(ids). Whitespace stands in where no vocabulary file is at hand.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Whitespace:
    """Words with the white space before them, so that decode(encode(text)) is the text."""

    def encode(self, text: str) -> list[str]:
        return re.findall(r"\s*\S+|\s+", text)

    def decode(self, ids: list[str]) -> str:
        return "".join(ids)


class _Once:
    """Makes its tokenizer where it is first asked for, which is in a worker."""

    def __init__(self, make: Callable):
        self.make, self.made = make, None

    def __call__(self):
        if self.made is None:
            self.made = self.make()
        return self.made


def tiktoken_file(path: str, pattern: str) -> Callable:
    """Makes a tokenizer of a tiktoken rank file and its split pattern; text like special tokens is plain text."""

    def make():
        import tiktoken
        from tiktoken.load import load_tiktoken_bpe

        whole = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})

        class Plain:
            encode = staticmethod(whole.encode_ordinary)
            decode = staticmethod(whole.decode)

        return Plain

    return make


def token_count(c: Column, make: Callable = Whitespace) -> Column:
    """How many tokens a text has; null for null."""
    made = _Once(make)

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else len(made().encode(t))).astype("Int32")

    return count(c)


def first_tokens(c: Column, most: int, make: Callable = Whitespace) -> Column:
    """The text, cut after its first `most` tokens if it has more."""
    made = _Once(make)

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        def one(t):
            ids = None if t is None else made().encode(t)
            return t if ids is None or len(ids) <= most else made().decode(ids[:most])

        return texts.map(one)

    return cut(c)
