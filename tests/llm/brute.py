"""Plain restatements of the operators' rules, one text at a time."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rule_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
    lines = Counter(x for x in (text or "").split("\n") if WORD.search(x))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return {"n_words": len(words), "word_chars": sum(map(len, words)),
            "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
            "n_dup_lines": sum(n - 1 for n in lines.values()), "n_repeat_words": len(covered), "base_failed": failed}


def item_windows(items):
    found = {}
    for item, text in items:
        words = ALNUM.findall(lower(text))
        if words and item is not None:
            size = min(13, len(words))
            for i in range(len(words) - size + 1):
                found.setdefault(tuple(words[i:i + size]), set()).add(str(item))
    return found


def contamination(text, windows):
    words = ALNUM.findall(lower(text))
    hit, items = set(), set()
    for size in {len(w) for w in windows}:
        for i in range(len(words) - size + 1):
            owners = windows.get(tuple(words[i:i + size]))
            if owners:
                hit |= set(range(i, i + size))
                items |= owners
    return {"n_words": len(words), "n_hit": len(hit), "n_items": len(items), "items_sha256": sha(",".join(sorted(items))),
            "contaminated": bool(hit) and 20 * len(hit) >= len(words)}


def base_secrets(text):
    text, spans = text or "", []
    pattern = re.compile("([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|"
                         "[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    spans += [("assign", m.start(), m.end()) for m in pattern.finditer(text) if len(m[2]) >= 6]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    kinds = ["assign", "access", "hex"]
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0])))


def phrases(text, sample):
    """Greedy parse of bytes into longest runs found in the sample."""
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at:at + n + 1] in sample:
            n += 1
        count, at = count + 1, at + n
    return count


def shingles(text, k=5):
    words = ALNUM.findall(lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1)))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0
