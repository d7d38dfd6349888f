"""Plain versions of what the operators compute."""

import re

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, linked):
    """The smallest value that each value reaches."""
    up = {v: v for v in values}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    for a in values:
        for b in values:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {v: find(v) for v in values}


def windows(items, size):
    """The items of each window of ``size`` words."""
    out = {}
    for key, text in items:
        w = WORD.findall(ascii_lower(text))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            out.setdefault(tuple(w[i : i + size]), set()).add("" if key is None else str(key))
    return out


def hits(text, wins):
    """Hit places, found items and number of words."""
    w, places, found = WORD.findall(ascii_lower(text)), set(), set()
    sizes = {len(win) for win in wins}
    for size in sizes:
        for i in range(len(w) - size + 1):
            ids = wins.get(tuple(w[i : i + size]))
            if ids:
                places |= set(range(i, i + size))
                found |= ids
    return places, found, len(w)


def secrets(text):
    """The base spans as the contract words them: find each kind's matches, then drop those that are too short."""
    text = text or ""
    names = re.sub(r"[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", "password|passwd|secret|token|api_?key")
    out = [("assign", m.start(), m.end()) for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    order = {"assign": 0, "access": 1, "hex": 2}
    return sorted(out, key=lambda s: (s[1], order[s[0]]))
