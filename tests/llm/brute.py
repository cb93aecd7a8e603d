"""Plain versions of the contracts, over whole tables in memory."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

#: Columns whose names an operator may use for itself.
CLASHING = ["size", "k", "w", "hits", "uid", "token", "n", "shard", "slot", "bucket", "copies", "base", "bundle", "label", "score", "comp", "__row", "rank"]

SPACED = re.compile(rb"[^\x20\x09-\x0D]+")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return SPACED.findall((text or "").encode())


def folded_words(text):
    return SPACED.findall(lower(text).encode())


def shingles(text, size=4):
    w = folded_words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def jaccard_components(rows, size=4, percent=85):
    """(doc_id, set size, component) of each row: all pairs are compared."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)]


def decontaminated(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        w = FOLDED.findall(lower(text))
        k = min(13, len(w))
        for j in range(len(w) - k + 1) if k else ():
            windows[tuple(w[j : j + k])].add(item)
    widths = sorted({len(k) for k in windows})
    out = []
    for d, text in rows:
        w = FOLDED.findall(lower(text))
        hit, found = set(), set()
        for k in widths:
            for j in range(len(w) - k + 1):
                if owners := windows.get(tuple(w[j : j + k])):
                    hit |= set(range(j, j + k))
                    found |= owners
        found.discard(None)
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    triples = list(zip(w, w[1:], w[2:]))
    n, covered = Counter(triples), set()
    for i, g in enumerate(triples):
        if n[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c)
        total += (v * 2 - 9 if v > 4 else v * 2) if i % 2 else v
    return total % 10 == 0


PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def personal(text):
    """The base spans, as (start, kind number, end, kind), sorted."""
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def base_scores(rows):
    counts = Counter()
    for d, t in rows:
        if d is None or zlib.crc32(str(d).encode()) % 7 != 2:
            counts.update([*folded_words(t), b"\n"])
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, t in rows:
        w = [*folded_words(t), b"\n"]
        out.append((d, d is not None and zlib.crc32(str(d).encode()) % 7 == 2, len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)))
    return out


def water_filled(sizes, weights=(5, 2, 1), limit=3):
    """Targets by the level that fills: the level's share by weight, none over its limit, all sizes together."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, low, high = sum(sizes.values()), 0.0, 1.0 + limit * max(sizes.values(), default=0)
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(limit * sizes[s], level * weight[s]) for s in order) < total:
            low = level
        else:
            high = level
    return {s: min(limit * sizes[s], high * weight[s]) for s in order}


def ratios(rows, trusted, buckets, prior):
    """Mean log ratio of hashed unigrams and bigrams of each text, by dictionaries of counts."""
    import xxhash

    def hashed(*said):
        h = 42
        for w in said:
            h = xxhash.xxh64_intdigest(w, seed=h)
        return h % buckets if h < 1 << 63 else (h - (1 << 64)) % buckets

    def grams(text):
        w = words(text)
        return [(1, hashed(x)) for x in w] + [(2, hashed(a, b)) for a, b in zip(w, w[1:])]

    raw, target = Counter(), Counter()
    for d, t in rows:
        raw.update(grams(t))
        if d in trusted:
            target.update(grams(t))

    def weight(g):
        n_raw, n_target = (sum(v for k, v in c.items() if k[0] == g[0]) for c in (raw, target))
        p = (raw[g] + 1) / (n_raw + buckets)
        return math.log((target[g] + prior * p) / (n_target + prior) / p) if n_target else 0.0

    known = {g: weight(g) for g in raw}
    return [(d, sum(known[g] for g in grams(t)) / max(1, len(grams(t)))) for d, t in rows]


def scoped_events(classes, kinds, spans=(("negated", 4, 3), ("reported", 5, 12), ("targeted", 3, 6))):
    """Names of the events along (class, weight) pairs: what stands in the words before, inside the clause."""
    out, clause = Counter(), []
    for kind, weight in classes:
        if kind in kinds:
            name = next((f"_{mark}" for mark, opener, reach in spans if opener in clause[-reach:]), "")
            out[kinds[kind] + name] += weight
        clause = [] if kind == 6 else [*clause, kind]
    return out
