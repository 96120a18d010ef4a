"""Plain Python versions of the text operators, for small rows."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def shingle_set(text, low=True):
    words = WORD.findall(lower(text or "") if low else text or "")
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def similar(a, b):
    both = len(a & b)
    return 100 * both >= 80 * (len(a) + len(b) - both)


class Groups:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a, b):
        self.parent[self.find(a)] = self.find(b)


def jaccard_components(rows):
    """Position in rows -> smallest doc_id of its component; rows are (doc_id, text)."""
    sets = [shingle_set(t) for _, t in rows]
    groups = Groups()
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and similar(a, sets[j]):
                groups.join(i, j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            root = groups.find(i)
            least[root] = min(least.get(root, doc), doc)
    return [least.get(groups.find(i)) if sets[i] else rows[i][0] for i in range(len(rows))], [len(s) for s in sets]


def leaks(rows, items):
    """(doc_id, item_id) -> best similarity over the windows in which a shared shingle has its place of the item."""
    out = {}
    for doc, text in rows:
        words = WORD.findall((text or "").lower())
        for item, body in items:
            wanted = WORD.findall((body or "").lower())
            size = len(wanted)
            if not size:
                continue
            run = min(5, size)
            bag = Counter(tuple(wanted[i : i + run]) for i in range(size - run + 1))
            grams = [tuple(words[i : i + run]) for i in range(len(words) - run + 1)]
            starts = {i - j for j in range(size - run + 1) for i, g in enumerate(grams) if g == tuple(wanted[j : j + run])}
            for start in starts:
                part = words[max(start, 0) : start + size]
                if size < 5 and len(part) < size:
                    continue
                have = Counter(tuple(part[i : i + run]) for i in range(len(part) - run + 1))
                both = sum((have & bag).values())
                every = sum((have | bag).values())
                if both and 100 * both >= 80 * every:
                    out[doc, item] = max(out.get((doc, item), 0), both / every)
    return out


def rule_counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    times = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if times[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


SECRETS = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
)


def base_spans(text):
    found = [(m.start(), rank, kind, m.end()) for rank, (kind, p, ok) in enumerate(SECRETS) for m in p.finditer(text or "") if ok(m)]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


def repeated_paragraphs(rows, least=50):
    """(doc_id, paragraph) -> (start, end, words, words of the passage, copies)."""
    units = []
    for doc, text in rows:
        number = at = 0
        for line in (text or "").split("\n"):
            words = WORD.findall(lower(line))
            if len(words) >= 5:
                units.append((doc, number, at, at + len(line), len(words), shingle_set(line)))
                number += 1
            at += len(line) + 1
    groups = Groups()
    for i, a in enumerate(units):
        for j in range(i):
            if similar(a[5], units[j][5]):
                groups.join(i, j)
    members = defaultdict(list)
    for i in range(len(units)):
        members[groups.find(i)].append(i)
    flagged = {(units[i][0], units[i][1]): (units[i], len(v)) for v in members.values() if len({units[i][0] for i in v}) > 1 for i in v}
    out, run = {}, []

    def close():
        total = sum(flagged[k][0][4] for k in run)
        if total >= least:
            for k in run:
                u, copies = flagged[k]
                out[k] = (*u[2:5], total, copies)

    for key in sorted(flagged):
        if run and (run[-1][0] != key[0] or run[-1][1] != key[1] - 1):
            close()
            run = []
        run.append(key)
    close()
    return out


def prose(rng, words, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def edited(rng, text, times):
    words = text.split(" ")
    for _ in range(times):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)
