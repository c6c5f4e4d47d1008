"""Plain versions of the operators, for small tables."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def smallest(ids, links):
    """Smallest reachable id of each."""
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return least


def shingles(text, size):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def near_sets(docs, size, percent):
    """{doc_id: (n_shingles, component)} for docs {doc_id: text}."""
    sets = {i: shingles(t, size) for i, t in docs.items()}
    ids = [i for i in sets if sets[i]]
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                links.append((a, b))
    least = smallest(sets, links)
    return {i: (len(sets[i]), least[i]) for i in sets}


def covered(texts, size):
    """For a list of texts: word lists and flags of words covered by windows found twice."""
    ws = [words(t) for t in texts]
    times = Counter(tuple(w[i : i + size]) for w in ws for i in range(len(w) - size + 1))
    flags = []
    for w in ws:
        f = [False] * len(w)
        for i in range(len(w) - size + 1):
            if times[tuple(w[i : i + size])] > 1:
                f[i : i + size] = [True] * size
        flags.append(f)
    return ws, flags


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def line_verdicts(rows, least=20, edits=1):
    """For rows (doc_id, text) with distinct ids: {doc_id: (n_lines, n_exact, n_near, text that stays)}."""
    first = {}
    for d, t in sorted(rows):
        for k, line in enumerate(t.split("\n") if t is not None else []):
            if len(line) >= least:
                first.setdefault(line, (d, k))
    near = {a for a in first for b in first if first[b] < first[a] and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits}
    out = {}
    for d, t in rows:
        lines = t.split("\n") if t is not None else []
        exact = [k for k, x in enumerate(lines) if x in first and first[x] != (d, k)]
        close = [k for k, x in enumerate(lines) if x in near and k not in exact]
        left = [x for k, x in enumerate(lines) if k not in exact and k not in close]
        out[d] = (len(lines), len(exact), len(close), t if t is None or len(left) == len(lines) else "\n".join(left))
    return out


def quality_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w, t = words(text), text or ""
    times = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    flag = [False] * len(w)
    for i in range(len(w) - 2):
        if times[tuple(w[i : i + 3])] > 1:
            flag[i : i + 3] = [True] * 3
    lines = [x for x in t.split("\n") if words(x)]
    repeat = sum(flag)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat, len(w) < 50 or 100 * repeat > 50 * len(w)


def clause_class(symbols, between=2):
    """Offences, target, denied, reported, threat of a clause of symbols (1 offence, 2 target, 3 negation, 4 report, 5 threat)."""
    hostile = next((i for i, s in enumerate(symbols) if s in (1, 5)), None)
    before = symbols[:hostile] if hostile is not None else []
    offence = hostile is not None and symbols[hostile] == 1
    threats = [i for i, s in enumerate(symbols) if s == 5 and not (i == hostile and (3 in before or 4 in before))]
    aimed = any(2 in symbols[i + 1 : i + 2 + between] for i in threats)
    return (min(symbols.count(1), 2), int(1 in symbols and 2 in symbols), int(offence and 3 in before), int(offence and 4 in before), int(aimed))


def toxic_score(text, model, fixed):
    """The score of a text under a model, without the operator's machine."""
    import math

    def stem(word):
        return next((word[:n] for n in range(model.longest, model.shortest - 1, -1) if len(word) >= n and word[:n] in model.stems), None)

    def weight(word):
        return 0.0 if stem(word) is None or stem(word) in model.threats else model.stems[stem(word)]

    total = []
    for clause in re.split(r"[.!?;:\n]+", (text or "").lower()):
        line = re.findall(r"\w+", clause)
        kind = clause_class([1 if weight(w) else 5 if stem(w) else fixed.get(w, 0) for w in line])
        stems = sum(map(weight, line))
        if stems:
            total.append(min(stems, model.classes.get(kind, stems)))
        elif kind[-1]:
            total.append(model.classes.get(kind, model.threat))
    x = model.prior + (max(total) + 0.25 * (sum(total) - max(total)) if total else 0)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))
