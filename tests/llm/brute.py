"""Plain Python versions of the queries' contracts, row by row, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

LOWER = {i: i + 32 for i in range(65, 91)}
BLANKS = " \t\n\x0b\x0c\r"


def sha(x: bytes | str) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def warc(rows):
    """(page_id, html) -> {page_id: (payload_bytes, digest, type, refers_to)}"""
    first: dict[bytes, int] = {}
    for i, h in rows:
        p = (h or "").encode()
        if len(p) >= 100 and i is not None:
            first[p] = min(i, first.get(p, i))
    out = []
    for i, h in rows:
        p = (h or "").encode()
        revisit = p in first and first[p] != i
        out.append((i, len(p), sha(p), "revisit" if revisit else "response", first[p] if revisit else None))
    return out


def simhash(text: str | None) -> int:
    import xxhash

    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w)] if len(w) < 4 else [" ".join(w[i : i + 4]) for i in range(len(w) - 3)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_duplicates(rows, max_bits: int = 4):
    """(doc_id, text) -> [(doc_id, fingerprint, component_id)]"""
    prints = [simhash(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= max_bits:
                up[find(i)] = find(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)].append(k)
    return [(k, f"{prints[i]:016x}", min(least[find(i)], default=None)) for i, (k, _) in enumerate(rows)]


def tokens(rows, path: str, end: int = 2):
    """(doc_id, text) in order -> [(doc_id, start, n, crc)]"""
    import numpy as np
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    out, at = [], 0
    for k, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end]
        out.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def contamination(docs, items, width: int = 10):
    """-> [(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)]"""

    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        n = min(width, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[a : a + n])].add("" if i is None else str(i))
    sizes = {len(w) for w in windows}
    out = []
    for k, t in docs:
        w, hit, found = split(t), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[a : a + n]))) is not None:
                    hit.update(range(a, a + n))
                    found |= got
        out.append((k, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def proximity(docs, items, width: int = 10, slop: int = 5):
    """-> [(doc_id, n_words, n_near, items)]"""

    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    windows = set()
    for i, t in items:
        w = split(t)
        n = min(width, len(w))
        windows |= {("" if i is None else str(i), n + slop, frozenset(w[a : a + n])) for a in range(len(w) - n + 1 if w else 0)}
    out = []
    for k, t in docs:
        w, near, found = split(t), set(), set()
        for a in range(len(w)):
            for item, reach, terms in windows:
                if w[a] in terms and terms <= set(w[a : a + reach]):
                    near.add(a)
                    found.add(item)
        out.append((k, len(w), len(near), sorted(found)))
    return out


def base_statistics(text: str | None):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    w, t = words(text), text or ""
    n = len(w)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    hit = {j for i in range(n - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return n, sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit), n < 20 or 100 * len(hit) > 30 * n


def line_dedup(rows, least: int = 10):
    """-> [(doc_id, n_lines, n_dropped, kept_sha256)]"""

    def key(line):
        return line.strip(BLANKS).translate(LOWER)

    count = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or count[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def chats(rows):
    """(conv, turn, role, text) -> {conv: (n_turns, turns_sha256, loss_chars, loss_sha256)}"""
    by = defaultdict(list)
    for c, n, role, text in rows:
        by[c].append((n is None, n or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(loss), sha(loss))
    return out


def repeats(rows, length: int = 400):
    """-> [(doc_id, n_bytes, n_removed, n_spans, kept_sha256)]"""
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(hash(t[i : i + length]) for t in texts for i in range(len(t) - length + 1))
    out = []
    for (k, _), t in zip(rows, texts, strict=True):
        gone, until = bytearray(len(t)), 0
        for i in range(len(t) - length + 1):
            if count[hash(t[i : i + length])] > 1:
                for j in range(max(i, until), i + length):
                    gone[j] = 1
                until = i + length
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((k, len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone, strict=True) if not g))))
    return out
