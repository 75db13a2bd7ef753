"""Plain versions of the pipeline's stages, for its test."""

import re

from xxhash import xxh64_intdigest


def quality_brute(text):
    text = text or ""
    words = re.findall(r"[^ \t-\r]+", text)
    wins = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    rep = {p for i, w in enumerate(wins) if wins.count(w) > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^ \t-\r]", x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(rep), "n_upper": len(re.findall("[A-Z]", text)), "n_bangs": text.count("!")}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def line_verdicts(docs, tau, exact, fuzzy):
    """Lines to cut of each document."""
    first, cut = {}, {}
    places = [((i, n), x) for i in sorted(docs) for n, x in enumerate((docs[i] or "").split("\n")) if len(x) >= exact]
    for p, x in places:
        first.setdefault(x, p)
    for p, x in places:
        linked = (u for u in first if min(len(u), len(x)) >= fuzzy and abs(len(u) - len(x)) <= tau and first[u] < first[x] and distance(u, x) <= tau)
        if first[x] != p or next(linked, None) is not None:
            cut.setdefault(p[0], set()).add(p[1])
    return cut


def fingerprint_groups(docs):
    def fp(text):
        words = (text or "").encode().lower().split()
        hs = [xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else [0]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = {i: fp(t) for i, t in docs.items()}
    group = {}
    for i in sorted(fps):
        if i not in group:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in group:
                    group[x] = i
                    todo += [y for y in fps if y not in group and (fps[x] ^ fps[y]).bit_count() <= 3]
    return group


def decontam_brute(words, items, window):
    hit = set()
    for w in items:
        k = min(len(w), window)
        wins = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(words) - k + 1) if k else ():
            if tuple(words[i:i + k]) in wins:
                hit.update(range(i, i + k))
    spans = []
    for p in sorted(hit):
        if spans and spans[-1][1] == p:
            spans[-1] = (spans[-1][0], p + 1)
        else:
            spans.append((p, p + 1))
    return spans
