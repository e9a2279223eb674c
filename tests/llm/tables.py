"""Small tables with awkward rows, and plain Python versions of what the operators compute."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n long, row string, label int"
LONG = " ".join(f"word{i % 4000}x{i % 7}" for i in range(30_000))
TEXTS = [
    "The quick brown fox jumps over the lazy dog near the old river bank today",
    "The  quick brown\tfox jumps over the lazy dog near the old river bank today",
    None,
    "",
    " \n\t ",
    "one",
    "One",
    "one two",
    LONG,
    LONG + " tail",
    LONG,
    "ünïcödé 日本語 😀 mail me: jo.doe@example.com or +1 (437) 555-0689, 10.0.0.1, 4111 1111 1111 1111 <|endoftext|> x",
    "a" * 50_000,
    "idiot!! you are a WORTHLESS loser, idiot",
    " marks  stay 300.1.2.3 and a@b..c a@b.c%d@e.f 1.2.3.4.5.6.7.8",
]


def awkward(spark, ids=None):
    """Every text once, some rows repeated whole, one without id; clashing extra columns, some null."""
    rows = []
    for i, text in enumerate(TEXTS):
        rows.append((i + 1, text, None, "s", None if text is None else len(text), None, None, None, i % 2))
    rows += [rows[0], rows[2], (None, "one two", "en", None, 7, 1.0, 2, "r", None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows if ids is None else [r for r in rows if r[0] in ids], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) >= n:
        return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    return frozenset([tuple(words)]) if words else frozenset()


def jaccard_labels(texts, n, p, q):
    """{id: (set size, smallest id reachable)} by comparing everything with everything."""
    sets = {i: shingles(t, n) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and q * common >= p * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}
