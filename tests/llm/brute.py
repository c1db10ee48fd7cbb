"""Plain re-statements of the contracts, for small tables."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def shingle_set(text):
    words = WORD.findall((text or "").translate(FOLD))
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def jaccard_degrees(docs, num=75, den=100):
    """By document: how many other sets its set links with; equal sets are one."""
    sets = {d: shingle_set(t) for d, t in docs}
    kinds = list(set(sets.values()) - {frozenset()})
    n = dict.fromkeys(kinds, 0)
    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            inter = len(a & b)
            if den * inter >= num * (len(a) + len(b) - inter):
                n[a] += 1
                n[b] += 1
    return {d: n.get(x, 0) for d, x in sets.items()}


def jaccard_components(docs, num=75, den=100):
    sets = {d: shingle_set(t) for d, t in docs}
    ids, parent = sorted(sets), {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for d in ids:
        for s in sets[d]:
            by.setdefault(s, []).append(d)
    seen = set()
    for members in by.values():
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                if (a, b) in seen:
                    continue
                seen.add((a, b))
                inter = len(sets[a] & sets[b])
                if den * inter >= num * (len(sets[a]) + len(sets[b]) - inter):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def rule_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    where = {}
    for i in range(len(words) - 2):
        where.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def url_rule(url):
    """host, path, rule, verdict of the rule"""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        rest = ""
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = host.translate(FOLD)
    fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits, key=lambda f: len(f[0]), default=(None, None)))
