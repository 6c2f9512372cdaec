"""Plain single-machine versions that the tests compare with."""

import re
import zlib

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
EDGE_TEXTS = [None, "", " \n\t ", "one", "One two three four", "a b c d e f g h i j k l", "a b c d e f g h i j k l", "x" * 5000, "été ñ ß 漢字 \U0001f600 don't", "w " * 3000]


def edge_docs(spark):
    """Nulls everywhere, ties, repeated rows, long words, and columns with the names of result columns."""
    rows = [(i, t, "en", "s", 1, True, 0, 0.5) for i, t in enumerate(EDGE_TEXTS)]
    rows += [(None, "lost row with no id at all but some words in it", None, None, None, None, None, None), rows[5], rows[0]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, kept boolean, shard int, score double")


def empty_docs(spark):
    return edge_docs(spark).limit(0)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def components(docs, percent=75):
    """{doc_id: smallest doc_id reachable} with all pairs that share a shingle."""
    from collections import Counter, defaultdict

    sets = {d: shingles(t) for d, t in docs}
    by = defaultdict(list)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d in sorted(sets):
        common = Counter(o for s in sets[d] for o in by[s])
        for o, n in common.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[o]) - n):
                a, b = sorted((find(d), find(o)))
                root[b] = a
        for s in sets[d]:
            by[s].append(d)
    return {d: find(d) for d in sets}, {d: len(s) for d, s in sets.items()}


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(docs, items, size=10):
    """{doc_id: (n_words, n_hit, sorted item ids)}"""
    windows = {}
    for item, text in items:
        w = bench_words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for d, text in docs:
        w = bench_words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= own
        out[d] = (len(w), len(hit), sorted(found))
    return out


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n
