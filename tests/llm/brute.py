"""Plain versions of the operators, one document at a time."""

import hashlib
import math
import re
from collections import Counter

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def windows(items):
    out = {}
    for i, t in items:
        w = WORDS.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - 9) if w else 0):
            out.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    return out


def contaminated(text, wins):
    """Words, hit words, sorted items."""
    w, hit, items = WORDS.findall((text or "").translate(LOWER)), set(), set()
    for n in {len(x) for x in wins}:
        for k in range(len(w) - n + 1):
            if own := wins.get(tuple(w[k : k + n])):
                hit |= set(range(k, k + n))
                items |= own
    return len(w), len(hit), sorted(items)


BASE = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
]


def secrets(text, p):
    """Base spans and all spans as (start, rank, end), each window's entropy counted afresh."""
    text = text or ""
    base = sorted((m.start(), k, m.end()) for k, (_, r, g, n) in enumerate(BASE) for m in r.finditer(text) if len(m[g]) >= n)
    more = []
    for m in re.finditer(p.candidate, text):
        w = m[0]
        if not (re.search("[0-9]", w) and re.search("[A-Za-z]", w)) or any(re.search(a, w) for a in p.allow):
            continue
        bits = p.hex_bits if re.fullmatch("[0-9a-f]+|[0-9A-F]+", w) else p.alnum_bits if re.fullmatch("[A-Za-z0-9]+", w) else p.base64_bits
        hot = [i for i in range(len(w) - p.window + 1) if -sum(c / p.window * math.log2(c / p.window) for c in Counter(w[i : i + p.window]).values()) >= bits - 1e-12 and not re.search(p.placeholder, w[i : i + p.window])]
        if hot:
            span = (m.start() + hot[0], 3, m.start() + hot[-1] + p.window)
            if not any(a <= span[0] and b >= span[2] for a, _, b in base):
                more.append(span)
    return base, sorted(base + more)


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len({i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)})


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()
