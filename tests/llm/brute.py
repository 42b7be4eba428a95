"""Plain versions of the operators, for small fixtures."""

import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(ASCII_LOWER))


def shingles(text, size=5):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def near_duplicates(rows, similarity=0.8):
    """[(key, text)] -> sorted [(key, class, links)]."""
    sets = [shingles(t) for _, t in rows]
    owners = {}
    for i, s in enumerate(sets):
        for x in s:
            owners.setdefault(x, []).append(i)
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        seen = {}
        for x in s:
            for j in owners[x]:
                if j > i:
                    seen[j] = seen.get(j, 0) + 1
        for j, both in seen.items():
            if both * 10 >= int(similarity * 10) * (len(s) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return sorted(((k, least.get(root(i)), links[i]) for i, (k, _) in enumerate(rows)), key=repr)


def removed(rows, length=50):
    """[(key, text)] -> for each row the byte flags that a repeat from a smaller key covers."""
    first = {}
    for k, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if k is not None and k < first.get(w, k + 1):
                first[w] = k
    out = []
    for k, t in rows:
        b = (t or "").encode()
        flags = bytearray(len(b))
        for i in range(len(b) - length + 1):
            f = first.get(b[i : i + length])
            if f is not None and (k is None or f < k):
                flags[i : i + length] = b"\x01" * length
        out.append(bytes(flags))
    return out
