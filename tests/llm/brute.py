"""Plain versions of the operators, for small tables."""
import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def words(text):
    return WORD.findall(text or "")


def shingles(text, n):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(docs, num, den, n):
    """Smallest id reachable per id; ``docs``: (id, text) without null ids."""
    sets = collections.defaultdict(list)
    for i, t in docs:
        sets[i].append(shingles(t, n))
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(x and y and den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def without_repeats(docs, window):
    """Words left per row of (id, text) rows with distinct ids, in the order of ids."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        w = words(t)
        stay = [True] * len(w)
        for k in range(len(w) - window + 1):
            g = tuple(w[k:k + window])
            if g in seen:
                stay[k:k + window] = [False] * window
            seen.add(g)
        out[i] = [x for x, y in zip(w, stay) if y]
    return out


def quality(text, rules):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]

    def covered(n, later_only):
        grams = [tuple(w[i:i + n]) for i in range(len(w) - n + 1)]
        count, seen, inside = collections.Counter(grams), set(), set()
        for i, g in enumerate(grams):
            if (g in seen) if later_only else count[g] > 1:
                inside |= set(range(i, i + n))
            seen.add(g)
        return inside

    again = [x for k, x in enumerate(lines) if x in lines[:k]]
    repeat = len(covered(rules.window, False))
    failed = len(w) < rules.min_words or 100 * repeat > rules.max_repeat_pct * len(w)
    chars = sum(map(len, w))
    kept = not failed and sum(map(len, again)) <= rules.line_share * sum(map(len, lines)) and all(
        sum(len(w[i]) for i in covered(n, True)) <= share * chars for n, share in rules.ngram_shares)
    return (len(w), chars, sum(c in "#*$%&|<>" for c in text or ""), len(again), repeat, failed, kept)
