"""Plain, quadratic versions of the operators for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib

import xxhash

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]


def lower_ascii(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def simhash(text: str) -> int:
    words = re.findall("[^\x20\x09-\x0d]+", lower_ascii(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def near_components(rows: list[tuple[int, str]]) -> dict[int, tuple[str, int]]:
    """doc_id -> (fingerprint, smallest doc_id reachable), comparing every pair."""
    prints = {doc_id: simhash(text or "") for doc_id, text in rows}
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind number, 'kind:start:end') by the contract's own patterns."""
    found = []

    def add(kind, match):
        found.append((match.start(), KINDS.index(kind), f"{kind}:{match.start()}:{match.end()}"))

    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        add("email", m)
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(part) <= 255 for part in m[0].split(".")):
            add("ip", m)
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            add("card", m)
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            add("phone", m)
    return sorted(found)


def base_sha256(text: str) -> str:
    return hashlib.sha256(",".join(s for _, _, s in base_spans(text)).encode()).hexdigest()


def edited(rows: list[tuple[int, str]]) -> dict[int, str]:
    """doc_id -> the text whose last third is replaced by the start of the next document's."""
    ordered = sorted(rows, reverse=True)
    out = {}
    for i, (doc_id, text) in enumerate(ordered):
        text, other = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        third = len(text) // 3
        out[doc_id] = text[: len(text) - third] + other[:third]
    return out


def shingles(text: str) -> set[tuple[str, ...]]:
    words = re.findall("[^\x20\x09-\x0d]+", lower_ascii(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def shape(word: str) -> bytes:
    """Capitals A, other letters a, digits 0, all other characters as they are; byte by byte of the UTF-8 text."""
    out = bytearray()
    for b in word.encode():
        c = chr(b)
        out.append(65 if "A" <= c <= "Z" else 97 if b >= 128 or "a" <= c <= "z" else 48 if "0" <= c <= "9" else b)
    return bytes(out)


def quality_features(text: str, hashed: int) -> tuple[int, list[float], dict[int, float]]:
    """(words, measures, hash bucket -> share) of a text."""
    raw = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    words = [lower_ascii(w) for w in raw]
    n = len(words)
    if not n:
        return 0, [0.0] * 7, {}
    counts = {}
    for word in raw:
        short = re.sub(rb"([aA0])\1+", rb"\1", shape(word))
        bucket = zlib.crc32(short) % hashed
        counts[bucket] = counts.get(bucket, 0) + 1
    letters = sum(1 for c in text if c.isascii() and c.isalpha() or ord(c) >= 128)
    measures = [
        sum(text.count(c) for c in "#$%&*|~^<>{}=_\\@") / len(text),
        sum(1 for c in text if "A" <= c <= "Z") / max(letters, 1),
        min(sum(text.count(c) for c in "|!") / n, 1.0),
        sum(1 for w in raw if re.fullmatch(rb"[aA'-]+[.,;:!?]?", shape(w))) / n,
        min(len(set(words)) / min(n, 6 * n**0.5), 1.0),
        sum(a == b for a, b in zip(words, words[1:])) / n,
        min(letters / n / 20, 1.0),
    ]
    size = sum(v * v for v in counts.values()) ** 0.5
    return n, [min(m, 1.0) for m in measures], {b: v / size for b, v in counts.items()}


def quality_votes(words: int, m: list[float]) -> tuple[int, ...]:
    bad = [(3, m[0] > 0.03), (8, m[1] > 0.2), (8, m[2] > 0.1), (16, m[3] < 0.75), (20, m[4] < 0.55), (8, m[5] > 0.08), (8, m[6] < 0.1 or m[6] > 0.7)]
    return tuple(-1 if words < least else int(not b) for least, b in bad)


def label_posteriors(votes: list[tuple[int, ...]]) -> dict[tuple[int, ...], float]:
    """Expectation-maximisation over single documents, until nothing changes."""
    good = [0.95 / 3 ** sum(v == 0 for v in vote) for vote in votes]
    for _ in range(400):
        share = (sum(good) + 1) / (len(votes) + 2)
        chance = {}
        for labeller in range(len(votes[0])):
            for kind in (0, 1):
                seen = [0.2, 0.2]
                seen[kind] = 0.8
                for vote, p in zip(votes, good):
                    if vote[labeller] >= 0:
                        seen[vote[labeller]] += p if kind else 1 - p
                for value in (0, 1):
                    chance[labeller, kind, value] = seen[value] / sum(seen)
        after = []
        for vote in votes:
            odds = [1 - share, share]
            for labeller, value in enumerate(vote):
                if value >= 0:
                    odds = [odds[kind] * chance[labeller, kind, value] for kind in (0, 1)]
            after.append(odds[1] / sum(odds))
        if max(abs(a - b) for a, b in zip(good, after)) < 1e-12:
            break
        good = after
    return dict(zip(votes, good))
