"""Plain single-machine versions that the operators are held against."""

import hashlib
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _covered(docs, length, earlier):
    """docs: list of (id, sequence). For each, the flags of units covered by a repeated window."""
    first = {}
    for i, (d, s) in enumerate(docs):
        for p in range(len(s) - length + 1):
            k = s[p:p + length] if isinstance(s, bytes) else tuple(s[p:p + length])
            first[k] = min(first.get(k, (d, p)), (d, p))
    out = []
    for d, s in docs:
        flag = [False] * len(s)
        upto = 0
        for p in range(len(s) - length + 1):
            k = s[p:p + length] if isinstance(s, bytes) else tuple(s[p:p + length])
            if earlier(first[k], (d, p)):
                for q in range(max(p, upto), p + length):
                    flag[q] = True
                upto = p + length
        out.append(flag)
    return out


def suffix_dedup(rows, length=100):
    docs = [(d, (t or "").encode()) for d, t in rows]
    out = {}
    for (d, s), f in zip(docs, _covered(docs, length, lambda a, b: a < b), strict=True):
        kept = bytes(x for x, g in zip(s, f, strict=True) if not g)
        out[d] = (len(s), sum(f), sum(1 for i, g in enumerate(f) if g and (i == 0 or not f[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


def substring_dedup(rows, length=50):
    docs = [(d, WORD.findall((t or "").encode())) for d, t in rows]
    out = {}
    for (d, s), f in zip(docs, _covered(docs, length, lambda a, b: a[0] < b[0]), strict=True):
        kept = b" ".join(x for x, g in zip(s, f, strict=True) if not g)
        out[d] = (len(s), sum(f), hashlib.sha256(kept).hexdigest())
    return out


def add_one(rows, held_out):
    """n_tokens, n_known, train_tokens and base score of every text."""
    import math
    from collections import Counter

    toks = {d: [w.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) for w in WORD.findall((t or "").encode())] + [None] for d, t in rows}
    c = Counter(w for d, ws in toks.items() if not held_out(d) for w in ws)
    n, v = sum(c.values()), len(c)
    return {d: (len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for d, ws in toks.items()}


def lower_words(t):
    return [w.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) for w in WORD.findall((t or "").encode())]


def shingles(words, k=5):
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def components(rows):
    """Smallest id that links of Jaccard similarity 0.8 reach."""
    sets = {d: shingles(lower_words(t)) for d, t in rows}
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, x in enumerate(ids):
        for y in ids[i + 1:]:
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                label[max(a, b)] = min(a, b)
    return {d: find(d) for d in ids}


def cut_whole_characters(rows, length=100):
    """Texts without the characters all of whose bytes a repeated string covers."""
    docs = [(d, (t or "").encode()) for d, t in rows]
    out = {}
    for (d, s), f in zip(docs, _covered(docs, length, lambda a, b: a < b), strict=True):
        at, kept = 0, []
        for ch in s.decode():
            n = len(ch.encode())
            if not all(f[at:at + n]):
                kept.append(ch)
            at += n
        out[d] = "".join(kept)
    return out


def leaks(rows, items, k=5):
    """(document, item) pairs of which a window of the item's size, laid at a common shingle, has weighted similarity 0.8."""
    from collections import Counter

    count = lambda w: Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = set()
    for item, t in items:
        w = lower_words(t)
        if len(w) < k:
            continue
        there = count(w)
        place = {}
        for i in range(len(w) - k + 1):
            place.setdefault(tuple(w[i:i + k]), []).append(i)
        for d, text in rows:
            v = lower_words(text)
            starts = {max(0, min(p - q, len(v) - len(w))) for p in range(len(v) - k + 1) for q in place.get(tuple(v[p:p + k]), ())}
            for s in starts:
                here = count(v[s:s + len(w)])
                both = sum((here & there).values())
                if 100 * both >= 80 * (sum(here.values()) + sum(there.values()) - both):
                    out.add((d, item))
    return out
