"""Plain restatements that the operators are compared with."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grouped(nodes, links):
    """Smallest node reachable from each node."""
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for node in sorted(nodes):
        if node not in out:
            todo, out[node] = [node], node
            while todo:
                for other in near[todo.pop()]:
                    if other not in out:
                        out[other] = node
                        todo.append(other)
    return out


def kept_words(documents, width=50):
    """doc_id -> (words, removed, kept words) by comparing all windows; ``documents`` is {doc_id: text}."""
    first, out = {}, {}
    words = {i: WORD.findall(t or "") for i, t in documents.items()}
    for i in sorted(words):
        for k in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][k : k + width]), i)
    for i, ws in words.items():
        covered = set()
        for k in range(len(ws) - width + 1):
            if first[tuple(ws[k : k + width])] < i:
                covered.update(range(k, k + width))
        out[i] = (len(ws), len(covered), " ".join(w for k, w in enumerate(ws) if k not in covered))
    return out


def shingles(text, width=5):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def near_copies(documents, percent=80):
    """doc_id -> (set size, component)."""
    sets = {i: shingles(t) for i, t in documents.items()}
    holders, links, same = defaultdict(list), [], {}
    for i in sorted(sets):
        if not sets[i]:
            continue
        if sets[i] in same:
            links.append((same[sets[i]], i))
            continue
        same[sets[i]] = i
        common = Counter(j for g in sets[i] for j in holders[g])
        links += [(i, j) for j, n in common.items() if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n)]
        for g in sets[i]:
            holders[g].append(i)
    group = grouped(sets, links)
    return {i: (len(sets[i]), group[i]) for i in sets}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]
