"""Plain Python versions of the contracts, for comparison on small tables."""

import hashlib
import re
from itertools import combinations

import xxhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows, *, source="a"):
    """A documents table from (doc_id, text) pairs."""
    return spark.createDataFrame([(i, t, "en", source, None if t is None else len(t)) for i, t in rows], DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints):
    """Smallest id reachable over pairs of fingerprints that differ in at most 4 bits, by id."""
    group = {i: i for i in prints}
    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4 and group[a] != group[b]:
            low, high = sorted((group[a], group[b]))
            group = {i: low if g == high else g for i, g in group.items()}
    return group


def words10(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contaminated(text, items):
    """(words, hit words, items that occur) for a text and (item_id, text) pairs."""
    w, hit, found = words10(text), set(), set()
    for item, t in items:
        v = words10(t)
        n = min(10, len(v))
        for i in range(len(v) - n + 1) if n else ():
            for at in range(len(w) - n + 1):
                if w[at : at + n] == v[i : i + n]:
                    hit.update(range(at, at + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal(text):
    """Base spans (kind, start, end) by start, then kind as listed."""
    text, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    )
    for k, (kind, pattern, good) in enumerate(kinds):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text) if good(m[0])]
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """Words that each source shall give, by source, from the words it has."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        share = {s: 3 * sizes[s] if s in capped else rest * weight[s] / free for s in order}
        more = {s for s in order if share[s] > 3 * sizes[s] + 1e-9}
        if not more:
            return share
        capped |= more


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
