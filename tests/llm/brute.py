"""Plain versions of the operators, for small inputs."""

import hashlib
import itertools
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def base_licenses(text, base):
    w, places, labels = words(text), [], set()
    for phrase, label in base.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near_phrase(words, phrase, edits):
    """Whether a span of words is the phrase with at most so many edits, none of them in words marked by *."""

    def cost(w, p):
        """Least edits of words w to the parts p: stretches of letters and, at odd places, fixed words."""
        if len(p) == 1:
            return distance(" ".join(w), p[0])
        return min((distance(" ".join(w[:k]), p[0]) + cost(w[k + 1 :], p[2:]) for k in range(len(w)) if w[k] == p[1]), default=99)

    parts, loose = [], []
    for w in phrase:
        if w[0] == "*":
            parts += [" ".join(loose), w[1:]]
            loose = []
        else:
            loose.append(w)
    parts.append(" ".join(loose))
    return any(cost(words[i:j], parts) <= edits for i in range(len(words)) for j in range(i + 1, len(words) + 1))


def leaks(text, items, size=10):
    """(n_words, n_hit, sorted item ids)"""
    w, hit, found = words(text), set(), set()
    for item, t in items:
        p = words(t)
        windows = {tuple(p[i : i + size]) for i in range(max(1, len(p) - size + 1))} if p else set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard_components(rows):
    """{id: (size, component)} of [(id, text)]"""
    sets = [(i, shingles(t)) for i, t in rows]
    by = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(k)
    near = set()
    for members in by.values():
        near.update(itertools.combinations(sorted(set(members)), 2))
    links = []
    for a, b in near:
        x, y = sets[a][1], sets[b][1]
        i = len(x & y)
        if 100 * i >= 80 * (len(x) + len(y) - i):
            links.append((sets[a][0], sets[b][0]))
    c = components([i for i, _ in sets], links)
    return {i: (len(s), c[i]) for i, s in sets}
