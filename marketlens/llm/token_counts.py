"""Token counts of whole texts with the library of a given vocabulary."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from marketlens.llm.common import bounded_batches, whole_text

PART_CHARS = 1 << 15
BATCH_BYTES = 1 << 18
# Characters that pieces of a sentencepiece vocabulary treat as a space.
_SPACES = " ▁"


def _piece_splitter(processor):
    """Cuts a long text before spaces that no piece can span, or None if the vocabulary has pieces across words."""
    names = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    if any("▁" in name.lstrip("▁") for name in names):
        return None

    def split(text: str) -> list[str]:
        parts, begin = [], 0
        while len(text) - begin > PART_CHARS:
            cut = text.find(" ", begin + PART_CHARS)
            while cut > 0 and text[cut - 1] in _SPACES:
                cut = text.find(" ", cut + 1)
            # An empty rest would lose the token of a space at the end.
            if cut < 0 or cut + 1 == len(text):
                break
            # The rest gets its leading space back: the library puts one before every text.
            parts.append(text[begin:cut])
            begin = cut + 1
        parts.append(text[begin:])
        return parts

    return split


def _merge_splitter(text: str) -> list[str]:
    """Cuts a long text before a single space and a visible character, where the byte-level pattern always cuts."""
    parts, begin = [], 0
    for found in re.finditer(r" (?=\S)", text):
        if found.start() - begin >= PART_CHARS:
            parts.append(text[begin : found.start()])
            begin = found.start()
    parts.append(text[begin:])
    return parts


def counter(path: str):
    """(split, count): parts of a text whose counts add up to the text's, and the counts of a list of parts.

    sentencepiece for .model files, tokenizers for .json files, without added special tokens.
    """
    if path.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        split = _piece_splitter(processor) or (lambda text: [text])
        return split, lambda parts: [len(ids) for ids in processor.encode(parts, num_threads=1)]
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    plain = tokenizer.normalizer is None and isinstance(tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel)
    split = _merge_splitter if plain else (lambda text: [text])
    return split, lambda parts: [len(e.ids) for e in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]


def _batches(texts: pd.Series, split) -> Iterator[tuple[list[int], list[str]]]:
    """Parts of about ``BATCH_BYTES`` in all, with the row each belongs to."""
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        for part in split(text):
            rows.append(row)
            parts.append(part)
            size += len(part) * 2
            if size >= BATCH_BYTES:
                yield rows, parts
                rows, parts, size = [], [], 0
    if parts:
        yield rows, parts


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens of every row of ``docs`` (doc_id, text).

    Texts are encoded whole, without truncation, padding or added special tokens; only the counts leave the
    function. Null texts count as empty (0 bytes, 0 tokens), repeated rows are counted each, an
    empty table gives an empty result. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        split, counts = counter(path)
        for texts in batches:
            totals = [0] * len(texts)
            for rows, parts in _batches(texts, split):
                for row, n in zip(rows, counts(parts)):
                    totals[row] += n
            yield pd.Series(totals, dtype="int64")

    text = whole_text()
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), count(text).alias("n_tokens"))
