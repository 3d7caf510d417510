"""Plain versions of the corpus operators, for whole small tables."""

import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    lines, seen, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered.update((i, i + 1, i + 2))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def conversation(turns):
    """n_turns, turns_sha256, loss_chars, loss_sha256 of ``(turn, role, text)`` rows."""
    turns = sorted((t, r or "", x or "") for t, r, x in turns)
    said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
    loss = "".join(x for _, r, x in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(said), len(loss), sha(loss)


def fingerprint(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fingerprints, bits=2):
    """Smallest id reachable over links of ``bits`` or fewer differing bits, by id."""
    ids = sorted(fingerprints)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if (fingerprints[a] ^ fingerprints[b]).bit_count() <= bits:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in ids}


def targets(sizes):
    """Words each source is to give; ``sizes`` by source, null last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1.0 + k % 3 for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level >= 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else weight[s] * level for s in order}
        full |= over


def seats(aimed, total):
    """Sainte-Laguë: one seat after the other to the highest quotient, the first of equals."""
    got = dict.fromkeys(aimed, 0)
    for _ in range(total):
        got[max(aimed, key=lambda s: aimed[s] / (2 * got[s] + 1))] += 1
    return got


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_pii(text):
    digits = lambda s: [int(c) for c in s if c in "0123456789"]

    def luhn(d):
        return sum(x if k % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for k, x in enumerate(reversed(d))) % 10 == 0

    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
