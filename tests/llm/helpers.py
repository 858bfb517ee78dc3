"""Small corpora with everything that may go wrong, and brute-force versions."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that clash with a column in case, or with what the operators call things inside.
CLASHING = ["TEXT", "Doc_Id", "h1", "h2", "pos", "dk", "kept", "runs", "hits", "n_words", "bucket", "start", "node", "band", "comp", "score", "keep", "p", "tokens", "m_topic", "new", "island", "trusted", "group_id"]
WORD = re.compile("[a-z0-9À-῿⁰-⿿぀-\U0010ffff]+")


def words(text):
    return WORD.findall((text or "").lower())


def docs(spark, texts, clash=True):
    """texts: texts, numbered from 0, or pairs of an id and a text. With the documents' other columns and clashing ones."""
    pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    rows = [(i, t, "en" if t is None or len(t) % 2 else None, None if i == 0 else "src", None if t is None else len(t)) for i, t in pairs]
    df = spark.createDataFrame(rows, DOCS)
    if clash:
        more = ", ".join(f"`{c}` string" for c in CLASHING)
        df = spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], f"{DOCS}, {more}")
    return df


LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
AWKWARD = [(0, "One two three four five six seven."), (None, "one two three four five six seven"), (2, None), (3, ""), (4, "  \n\n"), (5, "!!! ..."), (0, "One two three four five six seven."), (7, LONG), (8, LONG), (None, None), (9, "héé ÉÉ “x”\nsame line\nsame line")]


def random_texts(seed, n=60, vocabulary=6, longest=40):
    rng = np.random.default_rng(seed)
    out = [" ".join(f"{'ABCDEFGH'[w]}{w}" for w in rng.integers(0, vocabulary, rng.integers(0, longest))) for _ in range(n)]
    return [(i if rng.random() > 0.05 else None, t if rng.random() > 0.05 else None) for i, t in enumerate(out)] + [(1, out[1]), (1, out[1])]


def repeated_windows(pairs, size):
    """By document, an id and its words: the windows (first word) that occur more than once in the rows, as (start,
    copies, least id); each place once, however often the row is repeated."""
    where = defaultdict(list)
    for i, t in pairs:
        w = tuple(words(t))
        for a in range(len(w) - size + 1):
            where[w[a : a + size]].append(((i, w), a))
    out = defaultdict(set)
    for hits in where.values():
        if len(hits) > 1:
            least = min((d[0] for d, _ in hits if d[0] is not None), default=None)
            for d, a in hits:
                out[d].add((a, len(hits), least))
    return out


def spans_of(windows, size):
    """(start, end, windows, copies, least id) of the stretches of words that windows cover."""
    out = []
    for a, c, f in sorted(windows, key=lambda x: x[0]):
        if out and a <= out[-1][1]:
            s = out[-1]
            out[-1] = (s[0], max(s[1], a + size), s[2] + 1, max(s[3], c), min((x for x in (s[4], f) if x is not None), default=None))
        else:
            out.append((a, a + size, 1, c, f))
    return out


def kept_lines(pairs):
    """By (id, text): the kept lines' positions, of distinct documents in order of id."""
    seen, out = set(), {}
    for i, t in sorted(dict.fromkeys(p for p in pairs if p[1] is not None), key=lambda p: (p[0] is not None, p[0] or 0)):
        keep = []
        for pos, line in enumerate(t.split("\n")):
            if not line.strip(" "):
                keep.append(pos)
            elif line not in seen:
                seen.add(line)
                keep.append(pos)
        out[i, t] = keep
    return out


def shingles(text, k=3):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_groups(pairs, threshold):
    """Lists of ids whose texts pairs at the threshold or above connect, by exact comparison of all."""
    items = [(i, shingles(t)) for i, t in pairs if i is not None and t is not None and words(t)]
    up = list(range(len(items)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    by = defaultdict(list)
    for n, (_, s) in enumerate(items):
        for g in s:
            by[g].append(n)
    shared = Counter((a, b) for m in by.values() for k, a in enumerate(m) for b in m[k + 1 :])
    for (a, b), c in shared.items():
        if c / (len(items[a][1]) + len(items[b][1]) - c) >= threshold:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for n, (i, _) in enumerate(items):
        groups[top(n)].append(i)
    return [sorted(g) for g in groups.values() if len(g) > 1]


def leaks(text, items, n=8, least=5):
    """(word, length, item) of each place where a window of an item occurs, or a short item as a line."""
    w, out = words(text), []
    for i, t in items:
        g = words(t)
        if i is None or not g:
            continue
        if len(g) < least:
            at = 0
            for line in (text or "").split("\n"):
                x = words(line)
                out += [(at, len(g), i)] if x == g else []
                at += len(x)
            continue
        size = min(n, len(g))
        grams = {tuple(g[a : a + size]) for a in range(len(g) - size + 1)}
        out += [(a, size, i) for a in range(len(w) - size + 1) if tuple(w[a : a + size]) in grams]
    return out


def shares(axis, cells, power, given=None, lift=4.0):
    """The target shares of one of a cell's values (source, lang, topic, tokens)."""
    seen = {c[axis] for c in cells}
    tokens = {v: sum(c[3] for c in cells if c[axis] == v) for v in seen}
    s = {v: given.get(v, 0.0) if given else n**power for v, n in tokens.items()}
    s = {v: x / sum(s.values()) for v, x in s.items()}
    if not given:
        s = {v: min(x, lift * tokens[v] / sum(tokens.values())) for v, x in s.items()}
    return {v: x / sum(s.values()) for v, x in s.items()}


def fitted(cells, want, budget, rounds):
    """Of one budget, each cell's part and the greatest miss, by brute force: a factor a value."""
    goal = budget * sum(c[3] for c in cells)
    factor = [dict.fromkeys(w, 1.0) for w in want]
    part = lambda c: min(float(c[3]), c[3] * budget * factor[0][c[0]] * factor[1][c[1]] * factor[2][c[2]])

    def totals(i):
        out = dict.fromkeys(want[i], 0.0)
        for c in cells:
            out[c[i]] += part(c)
        return out

    for _ in range(rounds):
        for i in range(3):
            for v, have in totals(i).items():
                factor[i][v] = min(1e100, factor[i][v] * want[i][v] * goal / have) if have else 0.0
    whole = sum(map(part, cells))
    miss = max(abs(have / whole - want[i][v]) / want[i][v] for i in range(3) for v, have in totals(i).items() if want[i][v])
    return {c[:3]: part(c) / c[3] for c in cells}, miss


def best_fit(cells, budget, steps, rounds, close, power, given=None):
    """Each cell's probability."""
    want = [shares(i, cells, power, (given or {}).get(m)) for i, m in enumerate(("source", "lang", "topic"))]
    fits = [fitted(cells, want, budget * k / steps, rounds) for k in range(1, steps + 1)]
    return fits[min(range(steps), key=lambda k: (max(round(fits[k][1], 6), close), -k))][0]
