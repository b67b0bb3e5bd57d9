"""Plain-Python versions of the operators, for small fixtures."""

from __future__ import annotations

import re
from collections import defaultdict

from ledgerloom.llm.quality import BARS, MARKS, PHRASES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    wins = defaultdict(list)
    for i in range(len(words) - 7):
        wins[tuple(words[i : i + 8])].append(i)
    covered = {i + k for at in wins.values() if len(at) > 1 for i in at for k in range(8)}
    lines = text.split("\n")
    full = [x for x in lines if WORD.search(x)]

    def bad(line):
        n = len(WORD.findall(line))
        marks = len(re.findall(r"[#*$%&|<>!]{2,}", line))
        bars = sum(x in "|>»•·" and x != "" for x in re.split("[\x20\x09]", line))
        phrase = len(line) <= 480 and n <= 12 and any(p in line.lower() for p in PHRASES)
        return (n >= 4 and marks > 0.3 * n) or (bars >= 3 and n - bars <= 3 * bars) or phrase or marked(line)

    def marked(line):
        shown = re.sub(r"[\x20\x09-\x0D]", "", line)
        marks, between = sum(c in MARKS for c in shown), sum(c in BARS for c in shown)
        items = len(WORD.findall("".join(" " if c in BARS else c for c in line)))
        return (marks >= 5 and marks > 0.6 * len(shown)) or (between >= 3 and items <= 2 * between)

    good = [x for x in lines if not bad(x)]
    chars = lambda t: sum(map(len, WORD.findall(t)))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    clean = "\n".join(good)
    return {
        "n_words": len(words), "word_chars": chars(text), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(full) - len(set(full)),
        "n_repeat_words": len(covered), "base_failed": failed, "kept": not failed and chars(text) - chars(clean) <= 0.3 * chars(text), "clean": clean,
    }


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def removed_lines(docs):
    """{(doc, no): (kept doc, kept no)} of {doc: text}."""
    first, every = {}, []
    for doc in sorted(docs):
        for no, raw in enumerate((docs[doc] or "").split("\n")) if docs[doc] is not None else ():
            line = raw.strip(" \t\x0b\x0c\r")
            if line:
                every.append((doc, no, line))
                first.setdefault(line, (doc, no))
    near = {}
    for a, at in first.items():
        earlier = [(o, b) for b, o in first.items() if len(a) >= 20 and len(b) >= 20 and o < at and a != b and within_one(a, b)]
        if earlier:
            near[a] = min(earlier)[1]

    def stays(line):
        while line in near:
            line = near[line]
        return first[line]

    return {(d, n): stays(x) for d, n, x in every if x in near or first[x] != (d, n)}


def line_cleaned(docs, copied=1.0):
    gone = removed_lines(docs)
    size = lambda t: sum(map(len, WORD.findall(t)))
    out = {}
    for doc, text in docs.items():
        if text is None or not any((doc, i) in gone for i in range(text.count("\n") + 1)):
            out[doc] = text
            continue
        kept = "\n".join(x for i, x in enumerate(text.split("\n")) if (doc, i) not in gone)
        if WORD.search(kept) and size(kept) > round(size(text) * (1 - copied), 6):
            out[doc] = kept
    return out


def shingles(text, k):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(lower)
    return frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(docs, k=4, percent=80):
    """{doc: (set size, smallest doc reachable)}."""
    sets = {d: shingles(t, k) for d, t in docs.items()}
    label = {d: d for d in docs}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {d: (len(sets[d]), root(d)) for d in docs}
