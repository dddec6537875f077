"""Fixtures of the training-data tests: hard rows, and brute-force results."""

import hashlib
import itertools

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def doc(doc_id, text, lang="en", source="src0"):
    return (doc_id, text, lang, source, None if text is None else len(text))


LONG = " ".join(f"word{i % 977}x{i}" for i in range(40_000))


def hard_rows():
    """Nulls in every column, empty and blank texts, a very long text, ties and a repeated row."""
    base = " ".join(f"tok{i}" for i in range(120))
    return [
        doc(1, base),
        doc(2, base),
        doc(2, base),
        doc(3, base.replace("tok5 ", "other ")),
        doc(4, None),
        doc(5, ""),
        doc(6, " \n\t "),
        doc(7, LONG),
        doc(8, "short text"),
        (9, "null language and source\nsecond line", None, None, None),
        (None, "row without an id", "en", "src1", 17),
        doc(10, "Ünïcödé ßtraße 😀 naïve\n\ntoken = \"abcdef0123456789abcdef0123456789\""),
    ]


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text, size):
    found = words(text)
    if not found:
        return set()
    width = min(size, len(found))
    return {tuple(found[i : i + width]) for i in range(len(found) - width + 1)}


def brute_components(rows, size, percent):
    """{doc_id: (set size, component)} by all pairs that share a shingle."""
    sets = {d: shingle_set(t, size) for d, t in rows if d is not None}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    shared, by_token = {}, {}
    for d, found in sets.items():
        for token in found:
            by_token.setdefault(token, []).append(d)
    for owners in by_token.values():
        for pair in itertools.combinations(sorted(owners), 2):
            shared[pair] = shared.get(pair, 0) + 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {d: (len(found), find(d)) for d, found in sets.items()}


def brute_repeats(rows, length):
    """{doc_id: (bytes, removed, spans, digest of what is left)}."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, text in sorted((x for x in texts if x[0] is not None), key=lambda x: x[0]):
        for i in range(len(text) - length + 1):
            first.setdefault(text[i : i + length], d)
    out = {}
    for d, text in texts:
        gone = bytearray(len(text))
        if d is not None:
            for i in range(len(text) - length + 1):
                if first[text[i : i + length]] < d:
                    gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        left = bytes(c for c, x in zip(text, gone, strict=True) if not x)
        out[d] = (len(text), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out
