"""Subword tokens from a vocabulary file, in Arrow batches: the one text function that needs Python.

A file that ends in ``.txt`` is a WordPiece vocabulary, one piece on a line, lower case (``##`` continues a
word); any other is a tokenizer's JSON.  The path must be readable on every executor.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.functions import text as T

SPECIAL = {"[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "<s>", "</s>", "<unk>", "<pad>", "<mask>", "<|startoftext|>", "<|endoftext|>"}


@functools.cache
def _load(path: str):
    """The tokenizer, and its tokens that say something: no special ones, none without a letter or digit."""
    import tokenizers as K

    if path.endswith(".txt"):
        with open(path, encoding="utf-8") as f:
            vocab = {line.rstrip("\n"): i for i, line in enumerate(f)}
        tok = K.Tokenizer(K.models.WordPiece(vocab, unk_token="[UNK]"))
        tok.normalizer, tok.pre_tokenizer = K.normalizers.BertNormalizer(lowercase=True), K.pre_tokenizers.BertPreTokenizer()
    else:
        tok = K.Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    kept = {t for t in tok.get_vocab(with_added_tokens=True) if t not in SPECIAL and any(c.isalnum() for c in t.removeprefix("##"))}
    return tok, kept


def tokeniser(path: str | None) -> Callable[[Column], Column]:
    """The tokens of a text column, in order and with repeats; without a path, plain words."""
    if path is None:
        return T.tokens

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok, kept = _load(path)
        for texts in batches:
            codes = tok.encode_batch(texts.fillna("").tolist(), add_special_tokens=False)
            yield pd.Series([[t for t in c.tokens if t in kept] for c in codes])

    udf = F.pandas_udf(run, "array<string>", F.PandasUDFType.SCALAR_ITER)
    return lambda text: udf(T.normalize(F.coalesce(text, F.lit(""))))
