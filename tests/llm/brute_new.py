"""Plain Python versions of packing, structure repair and token alignment."""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections import Counter

STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def damage(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        fate = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def _legal(role: str, state: int) -> int | None:
    return STEP.get((state, role[:1]))


def least_edits(turns: list[tuple[str, str, str]]) -> tuple[int, str, list[tuple[str, str]]]:
    """Cheapest, then ASCII-least edits by a search over (turns done, state): turns are (role, text, fault)."""
    queue, seen = [(0, "", 0, 0, ())], set()
    while queue:
        cost, audit, i, state, lines = heapq.heappop(queue)
        if i == len(turns) and state in (0, 3):
            return cost, audit, list(lines)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        for role in ("user", "assistant"):
            if (to := _legal(role, state)) is not None:
                heapq.heappush(queue, (cost + 5, audit + "I", i, to, (*lines, (role, ""))))
        if i == len(turns):
            continue
        role, text, fault = turns[i]
        heapq.heappush(queue, (cost + 2, audit + "D", i + 1, state, lines))
        if fault in ("blank", "duplicate"):
            continue
        more = 5 if fault == "truncated" else 0
        if (to := _legal(role, state)) is not None:
            heapq.heappush(queue, (cost + more, audit + "K", i + 1, to, (*lines, (role, text))))
        for other in ("user", "assistant"):
            if (to := _legal(other, state)) is not None:
                heapq.heappush(queue, (cost + more + 1, audit + "R", i + 1, to, (*lines, (other, text))))
    raise AssertionError


def faults(rows: list[tuple[str, str]]) -> list[str]:
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def structure_repair(rows: list[tuple], damaging=damage) -> dict:
    groups: dict = {r[0]: [] for r in rows}
    for r in damaging(rows):
        groups[r[0]].append(r[1:])
    out = {}
    for conv, turns in groups.items():
        digest = lambda t: hashlib.sha256(t.encode()).digest()
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), digest(t[2])))
        found = faults([(r, t) for _, r, t in turns])
        cost, audit, lines = least_edits([(r, t, f) for (_, r, t), f in zip(turns, found, strict=True)])
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:], strict=False)]
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[conv] = (
            gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs),
            cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(),
        )
    return out


def alignment(texts: list[str | None], byte_level, pieces) -> list[tuple]:
    """``byte_level``/``pieces``: text to a list of (id, bytes) of its tokens."""
    docs = []
    for text in texts:
        whole = b" " + (text or "").encode()
        a, b = (byte_level(" " + text), pieces(text)) if text else ([], [])
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a, b = [], []
        spans = []
        for side in (a, b):
            at, made = 0, []
            for i, raw in side:
                made.append((at, at + len(raw), i))
                at += len(raw)
            spans.append(made)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        both = {e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}
        groups, start = [], 0
        for end in sorted(both):
            groups.append("|".join(",".join(str(i) for s, e, i in side if start <= s and e <= end) for side in spans))
            start = end
        docs.append((len(a), len(b), len(both), links, ";".join(groups)))
    count = Counter(link for d in docs for link in d[3])
    best: dict = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return [
        (n_a, n_b, n_groups, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for n_a, n_b, n_groups, links, g in docs
    ]
