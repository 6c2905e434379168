"""Byte-level BPE by replaying merges over the distinct words of a part of the corpus.

A task keeps the bytes of its distinct new words as linked tokens and an inverted index from merge rank to the
positions of the pairs that it joins. Ranks are taken from a heap in order; each is applied at all
its positions, and only the neighbours of a merged pair enter the index anew. Documents
are then assembled from the ids of their words.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from marketlens.llm.common import bounded_batches, whole_text
from marketlens.llm.wordwise import CHUNK_BYTES, WordEncoder


class Merges:
    """A vocabulary of ranks: token bytes by id, and the id that a pair of ids merges to."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.first = [self.ranks[bytes([byte])] for byte in range(256)]
        ranks = self.ranks
        # For the bytes that words begin as.
        self.byte_pairs = {
            (token[0], token[1]): rank for token, rank in ranks.items() if len(token) == 2
        }
        self.pairs = {
            (ranks[token[:cut]], ranks[token[cut:]]): rank
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        }

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """The ids of every word: one that is a token is that token; else of all pairs in it the lowest rank merges first, of equal ones the leftmost."""
        first, pairs, ranks = self.first, self.pairs, self.ranks
        ids: list[int] = []
        after: list[int] = []
        before: list[int] = []
        owner: list[int] = []
        starts: list[int] = []
        index: dict[int, list[int]] = {}
        for number, word in enumerate(words):
            start, n = len(ids), len(word)
            starts.append(start)
            if word in ranks:
                ids.append(ranks[word])
                owner.append(number)
                after.append(-1)
                before.append(-1)
                continue
            ids += map(first.__getitem__, word)
            owner += [number] * n
            after += range(start + 1, start + n + 1)
            before += range(start - 1, start + n - 1)
            if n:
                after[-1] = before[start] = -1
            for position, rank in enumerate(map(self.byte_pairs.get, zip(word, word[1:])), start):
                if rank is not None:
                    if rank in index:
                        index[rank].append(position)
                    else:
                        index[rank] = [position]
        waiting = list(index)
        heapify(waiting)
        find = pairs.get
        while waiting:
            rank = heappop(waiting)
            positions = index.pop(rank)
            positions.sort()
            overtaken: set[int] = set()
            for position in positions:
                follower = after[position]
                if follower < 0 or find((ids[position], ids[follower])) != rank:
                    continue
                if overtaken and owner[position] in overtaken:
                    touched = ((rank, position),)
                else:
                    beyond, ahead = after[follower], before[position]
                    ids[position], ids[follower] = rank, -1
                    after[follower] = -1
                    after[position] = beyond
                    touched = ()
                    if beyond >= 0:
                        before[beyond] = position
                        touched = ((find((rank, ids[beyond])), position),)
                    if ahead >= 0:
                        touched += ((find((ids[ahead], rank)), ahead),)
                for found, at in touched:
                    if found is not None:
                        if found in index:
                            index[found].append(at)
                        else:
                            index[found] = [at]
                            heappush(waiting, found)
                        if found <= rank:
                            overtaken.add(owner[at])
        starts.append(len(ids))
        return [[i for i in ids[a:b] if i >= 0] for a, b in zip(starts, starts[1:])]


class PatternEncoder:
    """Ids of texts: each match of the pattern is a word of its own. New words of a call are replayed together."""

    MAX_WORDS = 300_000

    def __init__(self, merges: Merges, pattern: str):
        self.merges = merges
        self.pattern = regex.compile(pattern)
        self.known: dict[str, list[int]] = {}

    def __call__(self, texts: list[str]) -> list[list[int]]:
        found = [self.pattern.findall(text) for text in texts]
        if len(self.known) > self.MAX_WORDS:
            self.known = {}
        new = list({word for words in found for word in words}.difference(self.known))
        self.known.update(zip(new, self.merges.replay([word.encode("utf-8") for word in new])))
        known = self.known
        return [list(chain.from_iterable(map(known.__getitem__, words))) for words in found]


_ENCODERS: dict[tuple[str, str], tuple[Merges, WordEncoder]] = {}


def _encoder(path: str, pattern: str) -> tuple[Merges, WordEncoder]:
    """Kept for the worker's later tasks. Whitespace-delimited words of texts are looked up whole first."""
    if (path, pattern) not in _ENCODERS:
        merges = Merges(path)
        sizes = np.asarray([len(token) for token in merges.tokens], dtype=np.int64)
        _ENCODERS[path, pattern] = merges, WordEncoder(PatternEncoder(merges, pattern), sizes)
    return _ENCODERS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) of every row of ``docs`` (doc_id, text).

    ``path`` is a file of ranks, ``pattern`` splits texts before the merges and must be the byte-level one: it
    cuts before every space that a visible character follows. No special tokens. Null texts count as empty and have no ids;
    repeated rows are encoded each; an empty table gives an empty result. Other columns are not read.
    """
    bounded_batches(docs.sparkSession, rows=1000, size=CHUNK_BYTES)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, encoder = _encoder(path, pattern)
        for batch in batches:
            whole, lengths = encoder.flat(batch["text"].tolist())
            raw, ends = whole.astype("<u4").tobytes(), np.cumsum(lengths) * 4
            ids = [raw[a:b] for a, b in zip((ends - lengths * 4).tolist(), ends.tolist())]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids})

    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.select("doc_id", whole_text().alias("text"))
    return chosen.mapInPandas(encode, f"doc_id {kind}, ids binary")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of a table of ids; bytes are looked up by id and joined."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        merges, _ = _encoder(path, ".")
        token = merges.tokens.__getitem__
        for batch in batches:
            arrays = [np.frombuffer(ids, dtype="<u4") for ids in batch["ids"]]
            texts = [b"".join(map(token, array.tolist())) for array in arrays]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "n_tokens": [len(array) for array in arrays],
                    "ids_sha256": [hashlib.sha256(ids).hexdigest() for ids in batch["ids"]],
                    "decoded_sha256": [hashlib.sha256(text).hexdigest() for text in texts],
                }
            )

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.mapInPandas(decode, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
