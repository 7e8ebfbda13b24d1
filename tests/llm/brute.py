"""Plain versions of the text operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
NULL = -(1 << 63)


def bytes_of(text):
    return (text or "").encode()


def repeats(docs, size):
    count = collections.Counter(b[i : i + size] for _, t in docs for b in [bytes_of(t)] for i in range(len(b) - size + 1))
    out = []
    for d, t in docs:
        b = bytes_of(t)
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def later_copies(docs, size):
    order = sorted(docs, key=lambda d: (NULL if d[0] is None else d[0], d[1] or ""))
    seen, out = set(), []
    for d, t in order:
        x = WORD.findall(bytes_of(t))
        gone = [0] * len(x)
        for s in range(len(x) - size + 1):
            key = tuple(x[s : s + size])
            if key in seen:
                gone[s : s + size] = [1] * size
            seen.add(key)
        out.append((d, len(x), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def shingles(text):
    words = WORD.findall(bytes_of(text).translate(bytes([*range(65), *range(97, 123), *range(91, 256)])))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def near_groups(docs, percent=75):
    sets = [shingles(t) for _, t in docs]
    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for k in s:
            where[k].append(i)
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        for j, n in collections.Counter(j for k in s for j in where[k] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(docs):
        low[root(i)] = min(low.get(root(i), d), d)
    return sorted(((d, len(sets[i]), low[root(i)], low[root(i)] == d) for i, (d, _) in enumerate(docs)), key=repr)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def toxicity_scores(texts, lexicon, weights, quotes, reporting, context=8, fuzzy_from=5):
    """Scores by comparing every word with every entry."""
    import math

    out = []
    for text in texts:
        t = (text or "").lower()
        spans = [m.span() for m in re.finditer(r"(?:[^\W_]|[@$])+", t)]
        found = []
        for b, e in spans:
            w = t[b:e]
            exact = any(w.startswith(x) if stem else w == x for x, stem in lexicon)
            near = any(not stem and len(x) >= fuzzy_from and abs(len(x) - len(w)) <= 1 and edit_distance(w, x) <= 1 for x, stem in lexicon)
            found.append(1 if exact else 2 if near else 0)
        count = [0, 0, 0, 0]
        for i, kind in enumerate(found):
            if kind:
                low, high = max(0, i - context), min(len(spans) - 1, i + context)
                left = 0 if low == 0 else spans[low][0]
                right = len(t) if high == len(spans) - 1 else spans[high][1]
                before, after = sum(c in quotes for c in t[left : spans[i][0]]), sum(c in quotes for c in t[spans[i][1] : right])
                quoted = before % 2 == 1 and after > 0 or not reporting.isdisjoint(re.findall(r"\w+", t[left:right]))
                count[kind - 1 + 2 * quoted] += 1
        x = [1, *(math.log1p(c) for c in count), math.log1p(50 * (count[0] + count[1]) / max(len(spans), 1))]
        out.append(1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(x, weights, strict=True)))))))
    return out


def taken_words(docs, plan):
    """docs (doc_id, source, size, h), plan source -> target: words that the mix takes of each document, in the order of docs."""
    out = [0] * len(docs)
    for source, target in plan.items():
        own = sorted((i for i, d in enumerate(docs) if d[1] == source), key=lambda i: (docs[i][3] % 2**64, docs[i][0] is not None, docs[i][0] or 0, docs[i][2]))
        size = sum(docs[i][2] for i in own)
        if size:
            whole = int(target / size + 1e-9)
            left = max(round(target) - whole * size, 0)
            for i in own:
                extra = min(docs[i][2], left)
                out[i], left = whole * docs[i][2] + extra, left - extra
    return out
