"""Plain-Python statements of the rules, written from the rule text, for small inputs."""

from __future__ import annotations

import re
import unicodedata

BREAK = re.compile("[:;]| - | — | – ")


def ascii_only(value: str) -> str:
    return unicodedata.normalize("NFKD", value or "").encode("ascii", "ignore").decode()


def key(value: str) -> str:
    return " ".join(re.findall("[a-z0-9]+", ascii_only(value).lower()))


def main(value: str) -> str:
    head = key(BREAK.split(value, maxsplit=1)[0])
    return "" if head == key(value) else head


def sequential_dedup(readings, catalogue):
    """Readings in order against an index that grows; rows it inserts.

    readings: dicts with id, shop, batch, title, author, read; catalogue: dicts with id,
    shop, title, author in index order.
    """
    index: list[tuple] = []  # (shop, full key, main key, author key, id)

    def remember(shop, title, author, book):
        if key(title):
            index.append((shop, key(title), main(title), key(author), book))

    def find(shop, title, author):
        full, short, who = key(title), main(title), key(author)
        if not full:
            return None
        mine = [e for e in index if e[0] == shop and ("" in (who, e[3]) or who == e[3])]
        hits = [e for e in mine if full in (e[1], e[2])]
        if not hits and short:
            hits = [e for e in mine if e[1] == short]
        return hits[0][4] if hits else None

    for book in catalogue:
        remember(book["shop"], book["title"], book["author"], book["id"])
    rows, seen, batch = [], set(), None
    for r in readings:
        if not r["read"].strip():
            continue
        if batch != (r["shop"], r["batch"]):
            batch, seen = (r["shop"], r["batch"]), set()
        old = find(r["shop"], r["title"], r["author"])
        if old in seen and old is not None:
            continue
        rows.append((r["id"], r["batch"], old))
        if old is None:
            seen.add(r["id"])
            remember(r["shop"], r["title"], r["author"], r["id"])
        else:
            seen.add(old)
    return rows


def overlaps(a: str, b: str) -> bool:
    if not b:
        return False
    if a in b or b in a:
        return True
    left, right = a.split(), b.split()
    return len(set(left) & set(right)) >= max(1, 0.6 * min(len(left), len(right)))


def assign(expected: list[str], found: list[str]) -> list[int]:
    """Each expected title takes the first free found title that fits; -1 when none does."""
    free = list(range(len(found)))
    result = []
    for want in expected:
        pick = next((i for i in free if overlaps(key(want), key(found[i]))), -1)
        if pick >= 0:
            free.remove(pick)
        result.append(pick)
    return result
