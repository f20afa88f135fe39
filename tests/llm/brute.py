"""Plain Python versions of the operators, over lists of (doc_id, text) rows."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"
LAST = (1 << 63) - 1


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def remainder(doc_id, n):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def sha(data):
    return hashlib.sha256(data).hexdigest()


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def similar(rows):
    """(doc_id, class_id, n_links) of each row."""
    sets = [shingles(t) for _, t in rows]
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    shared = collections.Counter((a, b) for l in holders.values() for y, b in enumerate(l) for a in l[:y])
    links, parent = collections.Counter(), list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
            parent[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(doc_id, least.get(top(i), LAST))
    return [(d, least.get(top(i)), links[i]) for i, (d, _) in enumerate(rows)]


def lm_base(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens) and the base score of each row."""
    tokens = [words(lower(t)) + [None] for _, t in rows]
    held = [remainder(d, 7) for d, _ in rows]
    counts = collections.Counter(w for h, ws in zip(held, tokens) if h is not None and h != 2 for w in ws)
    total = sum(counts.values())
    for (d, _), h, ws in zip(rows, held, tokens):
        score = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in ws)
        yield (d, h == 2, len(ws), sum(counts[w] > 0 for w in ws), total), score


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m))
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
              if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [f"{kind}:{m.start()}:{m.end()}" for kind, m in found]


def quality_counts(text):
    text = text or ""
    w, seen, repeated = words(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    windows = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
    times = collections.Counter(windows)
    covered = {k + j for k, g in enumerate(windows) if times[g] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def _without(sequence, starts, size):
    change = [0] * (len(sequence) + 1)
    for k in starts:
        change[k] += 1
        change[k + size] -= 1
    depth, kept, spans, inside = 0, [], 0, False
    for k, x in enumerate(sequence):
        depth += change[k]
        if not depth:
            kept.append(x)
        spans += depth > 0 and not inside
        inside = depth > 0
    return kept, spans


def earlier_passages(rows, size=50):
    first = {}
    for d, t in rows:
        w = words(t)
        for k in range(len(w) - size + 1):
            key = tuple(w[k:k + size])
            first[key] = min(first.get(key, LAST), LAST if d is None else d)
    for d, t in rows:
        w, own = words(t), LAST if d is None else d
        kept, _ = _without(w, [k for k in range(len(w) - size + 1) if first[tuple(w[k:k + size])] < own], size)
        yield d, len(w), len(w) - len(kept), sha(" ".join(kept).encode())


def repeated_bytes(rows, size=200):
    data = [(t or "").encode() for _, t in rows]
    times = collections.Counter(b[k:k + size] for b in data for k in range(len(b) - size + 1))
    for (d, _), b in zip(rows, data):
        kept, spans = _without(b, [k for k in range(len(b) - size + 1) if times[b[k:k + size]] > 1], size)
        yield d, len(b), len(b) - len(kept), spans, sha(bytes(kept))


def item_words(text):
    marks = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
    return [w for w in (x.strip(marks) for x in words(lower(text))) if w]


def contained(rows, items):
    """(doc_id, item_id) of the documents that hold 0.8 of an item."""
    for d, t in rows:
        own = item_words(t)
        for item, text in items:
            w = item_words(text)
            n = min(len(w), 5)
            wanted = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if n else set()
            have = {tuple(own[k:k + n]) for k in range(len(own) - n + 1)} if n else set()
            if wanted and 5 * len(wanted & have) >= 4 * len(wanted):
                yield d, item
