"""Fixtures and brute-force versions for the operators over documents."""

import re
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = ("The quick brown fox jumps over the lazy dog and then some more words follow here to make it long enough for a passage of over "
           "fifty words so that it may be found again in other texts of this little table whatever stands before or after it in them "
           "and so on until the end of the passage is reached at last ")
LONG = " ".join(f"word{i % 977} of{i}" for i in range(12_000))

#: NULL and empty texts, blanks, ties, repeated rows, a NULL id, a very long text, odd characters.
EDGE = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "two words"), (6, LONG), (7, "x" * 3000), (8, "The The The " * 90), (8, "The The The " * 90),
        (9, PASSAGE), (10, "before it " + PASSAGE + "after it"), (11, PASSAGE), (None, PASSAGE), (12, "mail a.b@c.example.org or +1 (555) 555-1234\n\nx"),
        (13, "é́ 日本語 😀😀 \x1c\x85\xa0 <|endoftext|> it's we'll"), (14, "ab ab ab ab\nab ab ab ab\nab ab ab ab\n\n\nq"), (15, "ÀÉÎ " * 60), (16, "$$$ !!! ### " * 40)]
#: Further columns with names that operators use inside.
NAMES = ["word", "n", "s", "start", "label", "fp", "kind", "score", "gram", "spans", "source", "n_chars", "row", "id", "gone", "again", "__text", "__base", "__spans", "__cands",
         "__free", "__add", "__scored", "__s", "__score", "__stage_id", "__found_id", "component_id", "component_root", "fingerprint", "item_id", "bucket", "deal", "f", "m"]
EXTRA = "doc_id long, text string, " + ", ".join(f"`{n}` {'int' if n in ('label', 'kind') else 'long'}" for n in NAMES if n != "n_chars") + ", n_chars long"


def frame(spark, rows, parts=3):
    """Documents with many further columns whose names operators use inside."""
    more = tuple(range(3, 3 + len(NAMES) - 1))
    return spark.createDataFrame([(i, t, *more, len(t or "")) for i, t in rows], EXTRA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], EXTRA)


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def simhash(text, n=3):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n, linked):
    """Root of each of n items under a symmetric relation, by union."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    return [find(i) for i in range(n)]


def near_duplicates(rows, radius=3):
    fps = [simhash(t) for _, t in rows]
    root = groups(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= radius)
    least = {}
    for (d, _), r in zip(rows, root):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, f"{f:016x}", least.get(r)) for (d, _), f, r in zip(rows, fps, root)]


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def repeated_bytes(rows, length=200):
    """(n_bytes, n_removed, n_spans, kept bytes) of each row, by counting every string."""
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(b[i:i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = True
        runs = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        out.append((len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


KINDS = ("email", "ip", "card", "phone")
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(digits):
    twice = [2 * int(c) if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in twice) % 10 == 0


def _passes(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in hit.split(".")),
            "card": 16 <= len(digits) <= 19 and _luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def base_spans(text):
    return [(k, m.start(), m.end()) for k in KINDS for m in re.finditer(PATTERNS[k], text or "") if _passes(k, m.group())]
