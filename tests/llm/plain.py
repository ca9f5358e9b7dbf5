"""Plain definitions that the operators are held against."""

from __future__ import annotations

import base64
import collections
import hashlib
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [None, "", " \t\n", "a", "é", "a b c d e"]


def words(text):
    return WORD.findall(text or "")


def stripped(rows, window):
    counts = collections.Counter()
    for _, text in rows:
        w = words(text)
        counts.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for doc_id, text in rows:
        w, gone = words(text), set()
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def shingles(text, k=5):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def near_groups(rows, percent=75):
    """doc_id, set size, smallest id reachable, kept; ids are distinct and not null."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    posting = collections.defaultdict(list)
    for d in sorted(sets):
        common = collections.Counter()
        for s in sets[d]:
            common.update(posting[s])
            posting[s].append(d)
        for e, n in common.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[e]) - n):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return sorted((d, len(sets[d]), root(d), root(d) == d) for d in sets)


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w, covered = words(text), set()
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def records(rows, least=0):
    """page_id, payload_bytes, digest, type, refers_to of rows (page_id, url, html)."""
    groups = collections.defaultdict(list)
    for page_id, _, html in rows:
        groups[html or ""].append(page_id)
    out = []
    for html, ids in groups.items():
        data = html.encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        largest, free = max((i for i in ids if i is not None), default=None), True
        for page_id in ids:
            response = largest is None or len(data) < least or (page_id == largest and free)
            free = free and not (page_id == largest)
            out.append((page_id, len(data), digest, *(("response", None) if response else ("revisit", largest))))
    return sorted(out, key=str)


def edits(pattern, text, whole=False):
    """Least edit distance of the pattern to a substring of the text (to all of it if ``whole``), and the first end of one."""
    row, best = list(range(len(pattern) + 1)), (len(pattern), 0)
    for j, c in enumerate(text):
        above, row[0] = row[0], j + 1 if whole else 0
        for i, p in enumerate(pattern):
            above, row[i + 1] = row[i + 1], min(above + (p != c), row[i] + 1, row[i + 1] + 1)
        if row[-1] < best[0]:
            best = row[-1], j + 1
    return row[-1] if whole else best
