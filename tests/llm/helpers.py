"""Plain forms of what the training-data operators compute, for small inputs."""

import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def documents(spark, texts, sources=None):
    """Rows with ids 0, 1, ... and one source for all, unless they are given."""
    rows = [(i, t, "en", sources[i] if sources else "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def components(n, links):
    p = list(range(n))

    def root(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        p[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def shingles(text, k):
    w = SPACED.findall(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near(texts, k, percent):
    """(set sizes, components) by comparing all pairs."""
    s = [shingles(t, k) for t in texts]
    links = [(i, j) for i in range(len(s)) for j in range(i) if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j])]
    return [len(x) for x in s], components(len(s), links)


def kept_words(texts, k):
    """Words that stay when all that windows of k words that start twice cover goes."""
    words = [SPACED.findall(t or "") for t in texts]
    count = {}
    for w in words:
        for i in range(len(w) - k + 1):
            count[tuple(w[i : i + k])] = count.get(tuple(w[i : i + k]), 0) + 1
    out = []
    for w in words:
        gone = {j for i in range(len(w) - k + 1) if count[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        out.append([x for j, x in enumerate(w) if j not in gone])
    return out


def hits(text, items, k=10):
    """(words, indexes of hit words, ids of items) of one text."""
    w, hit, ids = ALNUM.findall(lower(text)), set(), set()
    for item, t in items:
        v = ALNUM.findall(lower(t))
        n = min(k, len(v))
        for at in range(len(v) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[at : at + n] and item is not None:
                    hit |= set(range(i, i + n))
                    ids.add(str(item))
    return len(w), hit, sorted(ids)
