"""Plain computations of what the operators return, for small tables."""

import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=True):
    return WORD.findall((text or "").translate(LOWER) if lower else (text or ""))


def measures(text):
    ws, text = words(text, lower=False), text or ""
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(ws) < 5000 else None
    return len(ws), sum(map(len, ws)), sum(text.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), None if covered is None else len(covered)


def shingles(text, width):
    ws = words(text)
    if 0 < len(ws) < width:
        return {("short", *ws)}
    return {tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)}


def components(docs, width, percent=80):
    """{doc_id: smallest reachable}, for documents with an id; rows of one id are tied."""
    sets, parent = [(i, shingles(t, width)) for i, t in docs if i is not None], {}
    for i, _ in sets:
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


def repeated(docs, length=50):
    key = lambda i: -(2**63) if i is None else i
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            g = b[p : p + length]
            first[g] = min(first.get(g, key(i)), key(i))
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < key(i):
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def nones_first(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))
