"""Token operators against the libraries themselves, packing against its bounds."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from marketlens.llm import bpe, id_files, packing, queries, token_counts, wordwise

JSON = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def odd_texts(n=300, size=70):
    rng = random.Random(4)
    letters = "ab  \n\t'sé漢1😀\x1c\x85\xa0▁ .,ZI<>|"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(size))) for _ in range(n)]
    return made + ["", " ", "  x", "x  ", "a<|endoftext|> <|endoftext|>b", "<s>x</s>", "a" * 20_000, "word " * 30_000, "x" + " " * 5000]


@pytest.fixture(scope="module")
def rows(spark, small):
    found = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    return [(row[0], row[1]) for row in found]


@pytest.fixture(scope="module")
def cases(rows):
    odd = [(5000 + i, text) for i, text in enumerate(odd_texts())]
    return rows[:60] + odd + [(9000, None), (None, "no id"), (7, "repeated"), (7, "repeated")]


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


TOKENIZER = Tokenizer.from_file(JSON)


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("path", [MODEL, JSON])
@pytest.mark.parametrize("part", [40, 1 << 15])
def test_parts_add_up(path, part, monkeypatch):
    monkeypatch.setattr(token_counts, "PART_CHARS", part)
    split, count = token_counts.counter(path)
    for text in odd_texts():
        assert sum(count(split(text))) == count([text])[0], text[:80]


def test_token_counts(spark, make, small, rows, cases):
    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)

    def expected(table):
        full = [(i, len((t or "").encode()), len(processor.encode(t or ""))) for i, t in table]
        return sorted(full, key=str)

    got = token_counts.token_counts(make(cases), MODEL)
    assert sorted(map(tuple, got.collect()), key=str) == expected(cases)
    result = queries.op2_token_counts(spark, small)
    assert result.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    found = result.collect()
    assert sorted((tuple(r)[:3] for r in found), key=str) == expected(rows)
    assert all(r.over_limit == (r.n_tokens > 4096) for r in found)
    assert token_counts.token_counts(make(cases).limit(0), MODEL).count() == 0


def test_words_give_the_library_s_ids():
    encoder = wordwise.json_encoder(JSON)
    texts = odd_texts(2000)
    for text, ids in zip(texts, encoder(texts)):
        assert ids.tolist() == ids_of(text), text[:80]


def test_bpe_merges_like_the_library(spark, make, small, rows, cases):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def expected(table):
        out = []
        for i, t in table:
            ids = library.encode_ordinary(t or "")
            digest = hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest()
            out.append((i, len(ids), digest, hashlib.sha256((t or "").encode()).hexdigest()))
        return sorted(out, key=str)

    got = bpe.decode_ids(bpe.encode_documents(make(cases), RANKS, public_tokenizers.PATTERN), RANKS)
    assert sorted(map(tuple, got.collect()), key=str) == expected(cases)
    assert sorted(map(tuple, queries.op5_bpe(spark, small).collect()), key=str) == expected(rows)
    assert bpe.encode_documents(make(cases).limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    random_words = [bytes(random.Random(i).choices(range(256), k=i % 40)) for i in range(2000)]
    single = [library.encode_single_token(w) if w in ranks else None for w in random_words]
    for word, ids, one in zip(random_words, bpe.Merges(RANKS).replay(random_words), single):
        assert b"".join(map(library.decode_single_token_bytes, ids)) == word
        assert one is None or ids == [one]


def test_id_codec_round_trip():
    rng = np.random.default_rng(1)
    for ids in ([], [7], rng.integers(0, 50_257, 100_001), rng.zipf(1.3, 10_000) % 2**32, range(70_000), [2**32 - 1] * 5):
        array = np.asarray(list(ids), dtype="<u4")
        assert np.array_equal(id_files.decode_ids(*id_files.encode_ids(array), len(array)), array)


def expected_files(table):
    ordered = sorted(table, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out, start = [], 0
    for i, t in ordered:
        ids = ids_of(t) + [0]
        out.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_id_files(spark, make, small, rows, cases, tmp_path, monkeypatch):
    key = lambda row: row[1]
    got = sorted(map(tuple, queries.op8_id_files(spark, small).collect()), key=key)
    assert got == expected_files(rows)
    monkeypatch.setattr(id_files, "SEGMENT_IDS", 5000)
    id_files.write_ids(make(cases), f"{tmp_path}/ids", JSON)
    assert sorted(map(tuple, id_files.read_ids(spark, f"{tmp_path}/ids").collect()), key=key) == expected_files(cases)
    id_files.write_ids(make(cases).limit(0), f"{tmp_path}/none", JSON)
    assert id_files.read_ids(spark, f"{tmp_path}/none").count() == 0


def check_packing(result, table, capacity):
    found = sorted(map(tuple, result.select("doc_id", "piece", "start", "length", "ids_crc32").collect()), key=str)
    expected = []
    for i, t in table:
        ids = ids_of(t) + [2]
        first = len(ids) % capacity or min(capacity, len(ids))
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected.append((i, piece, a, b - a, crc(ids[a:b])))
    assert found == sorted(expected, key=str)
    filled = {}
    for row in sorted(result.collect(), key=lambda r: (r.sequence_id, r.offset)):
        assert row.offset == filled.get(row.sequence_id, 0)
        filled[row.sequence_id] = row.offset + row.length
    assert max(filled.values()) <= capacity
    return len(filled), -(-sum(filled.values()) // capacity)


def test_packing(spark, make, small, rows, cases):
    used, least = check_packing(queries.op3_best_fit_packing(spark, small), rows, 1024)
    assert used <= least * 1.03 + 1
    check_packing(packing.pack(make(cases), JSON), cases, 1024)
    check_packing(packing.pack(make(cases), JSON, capacity=16), cases, 16)
    assert packing.pack(make(cases).limit(0), JSON).count() == 0


def plain_best_fit(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fitting = [(room, i) for i, room in enumerate(rooms) if room >= length]
        if fitting:
            rooms[min(fitting)[1]] -= length
        else:
            rooms.append(capacity - length)
    return len(rooms)


def test_best_fit_is_best_fit_decreasing():
    rng = random.Random(2)
    for trial in range(60):
        capacity = rng.choice([7, 16, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(200))] + [3] * (trial % 3 * 100)
        counts = {n: lengths.count(n) for n in set(lengths)}
        places = packing.best_fit(counts, capacity)
        filled = {}
        for row, (length, rank, each, sequence, offset) in enumerate(places.tolist()):
            following = places[row + 1] if row + 1 < len(places) else None
            end = int(following[1]) if following is not None and following[0] == length else counts[length]
            for i in range(rank, end):
                spot = sequence + (i - rank) // each
                filled.setdefault(spot, []).append((offset + (i - rank) % each * length, length))
        for spans in filled.values():
            at = 0
            for start, length in sorted(spans):
                assert start == at
                at += length
            assert at <= capacity
        assert len(filled) == plain_best_fit(lengths, capacity)


def test_pieces_of_words_give_the_ids_of_whole_texts():
    library, encoder = Tokenizer.from_file(JSON), wordwise.json_encoder(JSON)
    parts = ["<|endoftext|>", " ", "  ", "\n", "a", "é", "B.", "'s", ",", "1", "\x1c", "\x85", "　", "\t", "\r", "。", ". ", "|>", "a\nB", "x.\nY,", "\nQ."]
    chosen = random.Random(7)
    texts = ["".join(chosen.choices(parts, k=chosen.randint(0, 12))) for _ in range(5000)]
    texts += ["a        <|endoftext|>b", "a\n\n<|endoftext|>", "r\n\n<|endoftext|>.\nB.", ""]
    for text, ids in zip(texts, encoder(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
