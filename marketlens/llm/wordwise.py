"""Token ids of whole texts, encoding each distinct piece of many texts once.

A byte-level pattern always cuts before a space that a visible character follows, whatever stands before it; also on
both sides of a line break between visible characters, and before a full stop or comma that ends such a word after a letter. So a text is a
sequence of pieces, and its ids are those of its pieces one after another. The bytes of many texts are
cut at once. A piece of up to 32 bytes is four 64-bit words: pieces are sorted by a hash of them, compared, and looked up in
sorted tables of those seen before. New ones are encoded together, joined as they would stand in a text, and cut apart by
the number of bytes each token covers. First pieces of texts, long ones and those with other white space are encoded by
themselves. Where a cut is not certain from a few bytes there is none, which changes no ids.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

import numpy as np

# Pieces remembered by a Python worker, some 70 bytes each; beyond that it starts afresh.
MAX_WORDS = 1_000_000
# Bytes of texts cut at once, bytes of new pieces in one string, and strings encoded at once.
CHUNK_BYTES = 2 << 20
GROUP_BYTES = 1 << 16
GROUPS = 4
# Bytes of a piece that is compared as words.
WIDTH = 32
_WORDS = WIDTH // 8
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
# Odd numbers; a hash only has to be the same for equal pieces.
_MIX = [np.uint64(n) for n in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]

_BYTES = np.arange(256)
_BLANK = np.isin(_BYTES, [*range(0x09, 0x0E), *range(0x1C, 0x21)])
# First bytes of visible characters (those of white space beyond ASCII are looked at more closely), and last bytes that no white space ends with.
_VISIBLE = (_BYTES > 0x20) & (_BYTES != 0x7F) & ((_BYTES < 0x80) | (_BYTES >= 0xC2))
_CLOSER = np.isin(_BYTES, [0xC2, 0xE1, 0xE2, 0xE3])
_VISIBLE_END = ((_BYTES > 0x20) & (_BYTES < 0x7F)) | ((_BYTES >= 0x8B) & (_BYTES < 0xC0) & ~np.isin(_BYTES, [0x9F, 0xA0, 0xA8, 0xA9, 0xAF]))
_LETTER = np.isin(_BYTES, [*range(0x41, 0x5B), *range(0x61, 0x7B)])
# Lead bytes of two-byte letters; of 0xC3 all but two signs are.
_LETTER_LEADS = np.isin(_BYTES, [*range(0xC3, 0xCA), 0xD0, 0xD1])
_MARKS = b".,"


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... (sizes[i] of them) for all i, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _repeats(columns: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Whether each row but the first, in this order, equals the one before it."""
    same = np.ones(len(order) - 1, dtype=bool)
    for column in columns:
        ordered = column[order]
        same &= ordered[1:] == ordered[:-1]
    return same


class _Seen:
    """Pieces and where their ids are, in a few tables sorted by hash of which each is over twice as long as the next."""

    def __init__(self):
        self.tables: list[list[np.ndarray]] = []
        self.ids: list[np.ndarray] = []
        self.total = 0
        self.words = 0

    def find(self, hashes: np.ndarray, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether seen, first id, number of ids) of pieces with ascending hashes."""
        found = np.zeros(len(hashes), dtype=bool)
        starts, counts = np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        for known, *columns, first, number in self.tables:
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            same = known[at] == hashes
            for mine, theirs in zip(keys, columns):
                same &= mine == theirs[at]
            starts[same], counts[same] = first[at[same]], number[at[same]]
            found |= same
        return found, starts, counts

    def add(self, hashes: np.ndarray, keys: list[np.ndarray], ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> None:
        if not len(hashes):
            return
        self.ids.append(ids)
        self.tables.append([hashes, *keys, starts + self.total, counts])
        self.total += len(ids)
        self.words += len(hashes)
        while len(self.tables) > 1 and len(self.tables[-2][0]) <= 2 * len(self.tables[-1][0]):
            last, before = self.tables.pop(), self.tables.pop()
            order = np.argsort(np.concatenate([before[0], last[0]]), kind="stable")
            self.tables.append([np.concatenate([a, b])[order] for a, b in zip(before, last)])

    def source(self) -> np.ndarray:
        if len(self.ids) > 1:
            self.ids = [np.concatenate(self.ids)]
        return self.ids[0] if self.ids else np.zeros(0, dtype=np.uint16)


class WordEncoder:
    """Encodes texts by pieces; ``encode`` gives the ids of each of a list of texts, ``sizes`` the bytes of each id.

    ``special`` are strings that ``encode`` takes out of a text first; a text with one is encoded whole, as white space
    before it is split differently.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[list[int]]], sizes: np.ndarray, special: Iterable[str] = ()):
        self.encode = encode
        self.special = list(special)
        self.sizes = sizes
        self.max_words = MAX_WORDS
        self.type = np.dtype("<u2") if len(sizes) <= 1 << 16 else np.dtype("<u4")
        self.marks = [self._array(ids) for ids in encode([chr(mark) for mark in _MARKS])]
        self.forget()

    def forget(self) -> None:
        """Drop the remembered pieces."""
        self.seen = _Seen()

    def _array(self, ids: list[int]) -> np.ndarray:
        return np.asarray(ids, dtype=self.type)

    def _cuts(self, raw: np.ndarray, begins: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts of pieces, whether each is a full stop or comma alone) of texts that begin at ``begins``; ``raw`` is longer than ``end``."""
        head = np.zeros(len(raw), dtype=bool)
        head[begins] = True
        follows = raw[:end] == 0x20
        breaks = raw[:end] == 0x0A
        breaks[1:] &= _VISIBLE_END[raw[: end - 1]]
        breaks &= ~head[:end]
        at = np.flatnonzero(follows | breaks)
        at = at[_VISIBLE[raw[at + 1]] & ~head[at + 1] & (at + 1 < end)]
        near = np.flatnonzero(_CLOSER[raw[at + 1]])
        first, second, third = (raw[at[near] + i] for i in (1, 2, 3))
        blank = (first == 0xC2) & ((second == 0x85) | (second == 0xA0)) | (first == 0xE1) & (second == 0x9A) & (third == 0x80)
        blank |= (first == 0xE2) & (second == 0x80) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF))
        blank |= (first == 0xE2) & (second == 0x81) & (third == 0x9F) | (first == 0xE3) & (second == 0x80) & (third == 0x80)
        at = np.delete(at, near[blank])

        ends = at[at >= 2] - 1
        ends = ends[np.isin(raw[ends], list(_MARKS)) & ~head[ends]]
        last, lead = raw[ends - 1], raw[ends - 2]
        letter = _LETTER[last] | (last >= 0x80) & (last < 0xC0) & _LETTER_LEADS[lead] & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7))) & ~head[ends - 1]
        marks = ends[letter]
        mark = np.zeros(len(raw), dtype=bool)
        mark[marks] = True
        head[at] = True
        head[marks] = True
        starts = np.flatnonzero(head[:end])
        return starts, mark[starts]

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of texts that are encoded by themselves."""
        arrays = [self._array(ids) for ids in self.encode(texts)] if texts else []
        return np.concatenate([np.zeros(0, dtype=self.type), *arrays]), np.array([len(a) for a in arrays], dtype=np.int64)

    def _encode_pieces(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of pieces that may follow each other."""
        ends = np.cumsum(sizes)
        joined = raw[_spread(starts, sizes)].tobytes()
        cuts = np.searchsorted(ends, np.arange(GROUP_BYTES, (ends[-1] if len(ends) else 0) + GROUP_BYTES, GROUP_BYTES), side="right")
        cuts = np.unique(np.concatenate([[0], cuts, [len(ends)] if len(ends) else []]).astype(np.int64))
        found, counts = [np.zeros(0, dtype=self.type)], [np.zeros(0, dtype=np.int64)]
        for i in range(0, len(cuts) - 1, GROUPS):
            groups = list(zip(cuts[i : i + GROUPS].tolist(), cuts[i + 1 : i + GROUPS + 1].tolist()))
            borders = [(int(ends[a - 1]) if a else 0, int(ends[b - 1])) for a, b in groups]
            for (a, b), (low, _), ids in zip(groups, borders, self.encode([joined[x:y].decode("utf-8") for x, y in borders])):
                found.append(self._array(ids))
                covered = np.cumsum(self.sizes[found[-1]])
                at = np.searchsorted(covered, ends[a:b] - low) + 1
                if not np.array_equal(covered[at - 1], ends[a:b] - low):
                    raise ValueError("a token spans the start of a piece")
                counts.append(np.diff(at, prepend=0))
        return np.concatenate(found), np.concatenate(counts)

    def _distinct(self, hashes: np.ndarray, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(one of each distinct piece by ascending hash, for every piece the number of its like)."""
        order = np.argsort(hashes)
        same = _repeats([hashes], order)
        if not np.array_equal(same, _repeats(keys, order)):
            # Different pieces with one hash: order those by their words too.
            order = np.lexsort([*keys, hashes])
            same = _repeats(keys, order)
        new = np.concatenate([[True], ~same])
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        return order[new], number

    def _flat(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each); no text is empty."""
        ends = np.cumsum([len(text) for text in texts])
        begins = np.concatenate([[0], ends[:-1]])
        end = int(ends[-1])
        raw = np.frombuffer(b"".join([*texts, bytes(WIDTH + 8)]), dtype=np.uint8)
        starts, mark = self._cuts(raw, begins, end)
        sizes = np.diff(starts, append=end)
        first = np.zeros(len(starts), dtype=bool)
        first[np.searchsorted(starts, begins)] = True
        blanks = np.concatenate([[0], np.cumsum(_BLANK[raw[:end]], dtype=np.int32)])
        lead, last = raw[starts], raw[starts + sizes - 1]
        plain = (blanks[starts + sizes] - blanks[starts] == 1) & (sizes > 1) & (sizes <= WIDTH) & ~first & _BLANK[lead]
        plain &= (lead == 0x20) | _VISIBLE_END[last]

        at = np.flatnonzero(plain)
        start, size = starts[at], sizes[at]
        eights = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
        keys = [eights[start + 8 * i] & _MASKS[np.clip(size - 8 * i, 0, 8)] for i in range(_WORDS)] + [size.astype(np.uint64)]
        hashes = sum(key * factor for key, factor in zip(keys, _MIX))
        hashes = (hashes ^ (hashes >> np.uint64(29))) * _MIX[0]
        one, number = self._distinct(hashes, keys) if len(at) else (at, at)
        if self.seen.words > self.max_words:
            self.forget()
        known, first_id, count = self.seen.find(hashes[one], [key[one] for key in keys])
        new = one[~known]
        # Those after a line break follow each other, as do those after a space.
        order = np.argsort(raw[start[new]] == 0x0A, kind="stable")
        divide = int((raw[start[new]] != 0x0A).sum())
        parts = [self._encode_pieces(raw, start[some], size[some]) for some in (new[order[:divide]], new[order[divide:]])]
        ids, counts = (np.concatenate(column) for column in zip(*parts))
        position = np.empty(len(new), dtype=np.int64)
        position[order] = np.cumsum(counts) - counts
        amount = np.empty(len(new), dtype=np.int64)
        amount[order] = counts
        base = self.seen.total
        first_id[~known], count[~known] = position + base, amount
        self.seen.add(hashes[new], [key[new] for key in keys], ids, position, amount)

        rest = np.flatnonzero(~plain & ~mark)
        raw_rest = [raw[a : a + n].tobytes() for a, n in zip(starts[rest].tolist(), sizes[rest].tolist())]
        others = dict.fromkeys(raw_rest)
        other_ids, other_counts = self._encoded([text.decode("utf-8") for text in others])
        at_other = np.cumsum(other_counts) - other_counts
        place = {text: i for i, text in enumerate(others)}
        of_rest = np.array([place[text] for text in raw_rest], dtype=np.int64)

        source = np.concatenate([self.seen.source().astype(self.type, copy=False), *self.marks, other_ids])
        marks_at = self.seen.total + np.cumsum([0, *map(len, self.marks)])
        where, many = np.empty(len(starts), dtype=np.int64), np.empty(len(starts), dtype=np.int64)
        where[at], many[at] = first_id[number], count[number]
        where[rest], many[rest] = marks_at[-1] + at_other[of_rest], other_counts[of_rest]
        for i, value in enumerate(_MARKS):
            these = mark & (lead == value)
            where[these], many[these] = marks_at[i], len(self.marks[i])
        lengths = np.add.reduceat(many, np.searchsorted(starts, begins))
        return source[_spread(where, many)], lengths

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        lengths = np.zeros(len(texts), dtype=np.int64)
        found: list[np.ndarray] = [np.zeros(0, dtype=self.type)]
        pending: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if pending:
                ids, counts = self._flat([raw for _, raw in pending])
                lengths[[i for i, _ in pending]] = counts
                found.append(ids)
            pending.clear()
            size = 0

        for i, text in enumerate(texts):
            if self.special and any(mark in text for mark in self.special):
                flush()
                ids, counts = self._encoded([text])
                lengths[i] = counts[0]
                found.append(ids)
            elif text:
                pending.append((i, text.encode("utf-8")))
                size += len(pending[-1][1])
                if size >= CHUNK_BYTES:
                    flush()
        flush()
        return np.concatenate(found), lengths

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text."""
        ids, lengths = self.flat(texts)
        return np.split(ids, np.cumsum(lengths)[:-1]) if len(texts) else []


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids (unsigned, 32 bits) and lengths of texts with ``end_id`` after each of them."""
    sizes = lengths + 1
    whole = np.full(len(ids) + len(lengths), end_id, dtype="<u4")
    inner = np.ones(len(whole), dtype=bool)
    inner[np.cumsum(sizes) - 1] = False
    whole[inner] = ids
    return whole, sizes


_ENCODERS: dict[str, WordEncoder] = {}


def json_encoder(path: str) -> WordEncoder:
    """For a byte-level .json vocabulary, by the tokenizers library; kept for the worker's later tasks."""
    if path not in _ENCODERS:
        # Tasks are what runs in parallel; threads of the library would each keep memory of their own.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        before = tokenizer.pre_tokenizer
        if tokenizer.normalizer is not None or not isinstance(before, pre_tokenizers.ByteLevel) or before.add_prefix_space:
            raise ValueError("a plain byte-level vocabulary is needed")
        special = {i: token.content for i, token in tokenizer.get_added_tokens_decoder().items()}
        # A byte-level token has one character per byte.
        sizes = [0 if i in special else len(tokenizer.id_to_token(i) or "") for i in range(tokenizer.get_vocab_size())]

        def encode(texts: list[str]) -> list[list[int]]:
            return [found.ids for found in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        _ENCODERS[path] = WordEncoder(encode, np.asarray(sizes, dtype=np.int64), special.values())
    return _ENCODERS[path]
