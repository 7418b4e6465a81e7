"""Plain forms of the corpus operators, one text or one pair at a time."""

import collections
import hashlib
import re
import unicodedata

import xxhash

LOWER = {c: c + 32 for c in range(65, 91)}


def pii_base(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    kinds = ["email", "ip", "card", "phone"]
    return sorted(out, key=lambda s: (s[1], kinds.index(s[0])))


def measures(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = [tuple(w[j:j + 3]) for j in range(len(w) - 2)]
    c = collections.Counter(tri)
    covered = {j + k for j, x in enumerate(tri) if c[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
    shingles = [" ".join(w[j:j + 4]) for j in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=4):
    """ids' least reachable id, by comparing all pairs of (id, fingerprint)."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= radius:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        least[find(k)] = min(least.get(find(k), i), i)
    return [least[find(k)] for k in range(len(prints))]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(t, items, window=10):
    """(n_words, hit word places, items) of a text against (item_id, text) pairs."""
    w, hit, found = WORD.findall(t.translate(LOWER)), set(), set()
    for i, x in items:
        own = WORD.findall(x.translate(LOWER))
        n = min(window, len(own))
        windows = {tuple(own[j:j + n]) for j in range(len(own) - n + 1)} if n else set()
        for j in range(len(w) - n + 1):
            if n and tuple(w[j:j + n]) in windows:
                hit.update(range(j, j + n))
                found.add(i)
    return len(w), hit, found


def repeated(texts, length=100):
    """For each text (in order of id) the bytes covered by a string that also starts earlier."""
    seen, out = set(), []
    for t in texts:
        b = t.encode()
        mark = bytearray(len(b))
        for s in range(len(b) - length + 1):
            x = b[s:s + length]
            if x in seen:
                mark[s:s + length] = b"\1" * length
            else:
                seen.add(x)
        out.append((b, mark))
    return out


def runs(mark):
    return sum(1 for k, m in enumerate(mark) if m and not (k and mark[k - 1]))


def sha(b):
    return hashlib.sha256(b).hexdigest()


def nfc(t):
    return unicodedata.normalize("NFC", t)
