"""The agreed results in plain Python, one text or pair at a time, for small tables."""

import hashlib
import re
from collections import Counter

import xxhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(0x41, 0x5B)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def repeats(docs, size=13):
    """op4: (doc_id, n_words, n_removed, kept_sha256)."""
    words = [(i, SPACE.findall(t or "")) for i, t in docs]
    least = {}
    for i, ws in words:
        for k in range(len(ws) - size + 1):
            w = tuple(ws[k : k + size])
            least[w] = min(i, least.get(w, i))
    out = []
    for i, ws in words:
        gone = set()
        for k in range(len(ws) - size + 1):
            if least[tuple(ws[k : k + size])] < i:
                gone.update(range(k, k + size))
        out.append((i, len(ws), len(gone), sha(" ".join(w for k, w in enumerate(ws) if k not in gone))))
    return out


def contamination(docs, items, size=10):
    """op5: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    windows = {}
    for item, text in items:
        ws = ALNUM.findall((text or "").translate(LOWER))
        for k in range(max(1, len(ws) - size + 1) if ws else 0):
            windows.setdefault(tuple(ws[k : k + size]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for i, text in docs:
        ws = ALNUM.findall((text or "").translate(LOWER))
        hit, who = set(), set()
        for n in sizes:
            for k in range(len(ws) - n + 1):
                got = windows.get(tuple(ws[k : k + n]))
                if got:
                    hit.update(range(k, k + n))
                    who |= got
        out.append((i, len(ws), len(hit), len(who), sha(",".join(sorted(who))), bool(hit)))
    return out


def simhash(text, size=4):
    ws = SPACE.findall((text or "").translate(LOWER))
    if not ws:
        return 0
    shingles = [" ".join(ws[k : k + size]) for k in range(max(1, len(ws) - size + 1))]
    total = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        total.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * total[b] > len(shingles))


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_copies(docs, size=4, limit=4):
    """op6: (doc_id, fingerprint, component_id)."""
    prints = {i: simhash(t, size) for i, t in docs}
    distinct = sorted(set(prints.values()))
    links = [(a, b) for k, a in enumerate(distinct) for b in distinct[k + 1 :] if (a ^ b).bit_count() <= limit]
    roots = components(distinct, links)
    least = {}
    for i, f in prints.items():
        least[roots[f]] = min(i, least.get(roots[f], i))
    return [(i, f"{f:016x}", least[roots[f]]) for i, f in prints.items()]


def shingle_set(text, size=5):
    ws = SPACE.findall((text or "").translate(LOWER))
    return {tuple(ws[k : k + size]) for k in range(max(1, len(ws) - size + 1))} if ws else set()


def similar_groups(docs, least=0.8):
    """Least place in ``docs`` of each one's component over shingle similarity, and the links."""
    sets = [shingle_set(t) for _, t in docs]
    holders = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    links = set()
    for k, s in enumerate(sets):
        shared = Counter(j for x in s for j in holders[x] if j > k)
        links |= {(k, j) for j, n in shared.items() if n >= least * (len(s) + len(sets[j]) - n) - 1e-9}
    empty = [k for k, s in enumerate(sets) if not s]
    links |= {(empty[0], k) for k in empty[1:]}
    return components(range(len(docs)), links), links


def rule_counts(docs):
    """op8: (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    out = []
    for i, text in docs:
        text = text or ""
        ws = SPACE.findall(text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if SPACE.search(line):
                dup += line in seen
                seen.add(line)
        windows = [tuple(ws[k : k + 5]) for k in range(len(ws) - 4)]
        times = Counter(windows)
        again = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(5)}
        symbols = len(re.findall(r"[#*$%&|<>]", text))
        failed = len(ws) < 10 or 100 * len(again) > 20 * len(ws)
        out.append((i, len(ws), sum(map(len, ws)), symbols, dup, len(again), failed))
    return out


def luhn(number):
    total = 0
    for k, ch in enumerate(reversed(number)):
        d = int(ch)
        total += d if k % 2 == 0 else 2 * d - 9 if d > 4 else 2 * d
    return total % 10 == 0


def private(text):
    """op9: the base spans (kind, start, end)."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    found = [
        (m.start(), rank, kind, m.end())
        for rank, (kind, pattern, ok) in enumerate(rules)
        for m in re.finditer(pattern, text or "")
        if ok(m[0])
    ]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def chats(rows):
    """op10: conv_id -> (n_turns, turns_sha256, loss_chars, loss_sha256)."""
    out = {}
    order = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    for conv in dict.fromkeys(r[0] for r in order):
        own = [(r[2] or "", r[3] or "") for r in order if r[0] == conv]
        loss = "".join(t for role, t in own if role == "assistant")
        out[conv] = (len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)), len(loss), sha(loss))
    return out
