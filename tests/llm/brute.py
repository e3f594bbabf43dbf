"""Plain versions of the operators, for small inputs."""

import hashlib
import itertools
import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def rules(text):
    w = words(text)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    times = Counter(grams)
    again = {k for i, g in enumerate(grams) if times[g] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(again),
            "base_failed": len(w) < 10 or 100 * len(again) > 20 * len(w)}


def shingles(text):
    w = words((text or "").translate(UPPER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    """doc_id -> smallest id reachable over links of equal or near sets."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def kept_words(rows):
    """[(n_words, kept words)] of rows in their order; a null id comes last, equal ids don't precede one another."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    earlier, out = {}, [None] * len(rows)
    rank = [(rows[i][0] is None, rows[i][0] or 0) for i in range(len(rows))]
    for i in order:
        w, own = words(rows[i][1]), set()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            g = tuple(w[k:k + 20])
            if g in own or (g in earlier and earlier[g] < rank[i]):
                gone[k:k + 20] = [True] * 20
            own.add(g)
        for g in own:
            earlier[g] = min(earlier.get(g, rank[i]), rank[i])
        out[i] = (len(w), [x for x, d in zip(w, gone) if not d])
    return out


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(x) * (1 + i % 2) for i, x in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                    "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
