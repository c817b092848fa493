"""Plain models of what the operators compute, and small awkward tables."""

import re
from collections import Counter, defaultdict

CLASHING = "digest long, text string, row long, node long, keep_id long, lang string, doc_id long, source string, bucket long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def shingles(text):
    w = words(text)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def components(rows):
    """Smallest id reachable over links of at least 75 % shared shingles, per row (id, text)."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_shingle = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by_shingle[x].append(i)
    shared = Counter()
    for at in by_shingle.values():
        for k, i in enumerate(at):
            for j in at[k + 1 :]:
                shared[i, j] += 1
    for (i, j), n in shared.items():
        if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
            parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def awkward(spark, rows):
    """Rows (doc_id, text) as a table with columns whose names the operators use themselves."""
    return spark.createDataFrame([(7, t, 8, 9, 10, "xx", d, None, 1) for d, t in rows], CLASHING)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
