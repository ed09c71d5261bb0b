"""Plain Python versions of the corpus operators, for small tables."""

import collections
import hashlib
import html.parser
import math
import re

import numpy as np

WORD = re.compile("[^\x20\x09-\x0d]+")
LAST = 2**63 - 1


def key(doc_id):
    return LAST if doc_id is None else doc_id


def words(text):
    return WORD.findall(text or "")


class Sets:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def repeated(sequences, size):
    """Per (doc_id, sequence): which places lie in a run that starts in a smaller document."""
    first = {}
    for d, s in sequences:
        for i in range(len(s) - size + 1):
            k = s[i : i + size]
            first[k] = min(first.get(k, LAST), key(d))
    out = []
    for d, s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - size + 1):
            if first[s[i : i + size]] < key(d):
                gone[i : i + size] = [True] * size
        out.append(gone)
    return out


def bytes_removed(docs, size=50):
    sequences = [(d, (t or "").encode()) for d, t in docs]
    rows = []
    for (d, s), gone in zip(sequences, repeated(sequences, size)):
        kept = bytes(b for b, g in zip(s, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        rows.append((d, len(s), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return rows


def words_removed(docs, size=13):
    sequences = [(d, tuple(words(t))) for d, t in docs]
    rows = []
    for (d, s), gone in zip(sequences, repeated(sequences, size)):
        kept = " ".join(w for w, g in zip(s, gone) if not g)
        rows.append((d, len(s), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return rows


def print_of(text, size):
    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_groups(docs, size, radius):
    """(doc_id, fingerprint, component) per row."""
    prints = [print_of(t, size) for _, t in docs]
    sets = Sets(range(len(docs)))
    array = np.array(prints, dtype=np.uint64)
    for i in range(len(docs)):
        for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= radius).tolist():
            sets.join(i, j)
    least = {}
    for i, (d, _) in enumerate(docs):
        root = sets.find(i)
        least[root] = min(least.get(root, LAST), key(d))
    component = [least[sets.find(i)] for i in range(len(docs))]
    return [(d, f"{p:016x}", None if c == LAST else c) for (d, _), p, c in zip(docs, prints, component)]


def cosine_links(vectors, threshold=0.98):
    """(vec_id, n_links, component, kept) for distinct ids."""
    def good(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    ok = [(i, np.array(v, dtype=float), l) for i, v, l in vectors if good(v, l)]
    n = {i: 0 for i, _, _ in vectors}
    sets = Sets(n)
    for a in range(len(ok)):
        for b in range(a):
            (i, x, l), (j, y, m) = ok[a], ok[b]
            if l == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                n[i] += 1
                n[j] += 1
                sets.join(i, j)
    return [(i, n[i], sets.find(i), sets.find(i) == i) for i in n]


def similar_groups(docs):
    """Smallest id of every group of texts linked by a five-word Jaccard of 0.8 or more."""
    def shingles(text):
        w = (text or "").lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [shingles(t) for _, t in docs]
    up = Sets(range(len(docs)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                up.join(i, j)
    return sorted({min(d for j, (d, _) in enumerate(docs) if up.find(j) == up.find(i)) for i in range(len(docs))})


class _Nodes(html.parser.HTMLParser):
    """Texts and child styles per path of a well-formed page."""

    def __init__(self, page):
        super().__init__()
        self.stack, self.texts, self.layouts = [()], collections.defaultdict(list), collections.defaultdict(set)
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        label = (tag, *(w for k, v in attrs if k in ("class", "id") for w in v.split()))
        self.layouts[self.stack[-1]].add(label)
        self.stack.append((*self.stack[-1], label))

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        if data.strip():
            for path in set(self.stack):
                self.texts[path].append(data)


def style_tree(rows, presentation):
    """(pages, chars, importance) of every path with text; equal bodies count once."""
    seen = {}
    for page in rows:
        nodes = _Nodes(page)
        body = " ".join(" ".join(nodes.texts[()]).split())
        seen.setdefault(body, nodes)
    found = collections.defaultdict(list)
    for nodes in seen.values():
        for path, parts in nodes.texts.items():
            found[path].append((" ".join("".join(parts).split()), frozenset(nodes.layouts[path])))

    def entropy(values):
        n = len(values)
        counts = collections.Counter(values).values()
        return 1.0 if n == 1 else -sum(c / n * math.log(c / n) for c in counts) / math.log(n)

    out = []
    for values in found.values():
        text, layout = zip(*values)
        out.append((len(values), sum(map(len, text)), (1 - presentation) * entropy(text) + presentation * entropy(layout)))
    return out
