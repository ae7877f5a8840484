"""Plain Python versions of the operators' results, for small inputs."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(rows) -> list[tuple]:
    """(doc_id, n_shingles, component_id) for (doc_id, text) rows."""
    sets = []
    for _, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j]:
                both = len(a & sets[j])
                if 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                    parent[root(i)] = root(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(doc)
    return [(doc, len(sets[i]), min(ids[root(i)])) for i, (doc, _) in enumerate(rows)]


def repeats(rows, k: int = 20) -> dict[int, tuple]:
    """doc_id to (n_words, n_removed, kept_sha256); ids are distinct."""
    first = {}
    found = {doc: WORD.findall(text or "") for doc, text in rows}
    for doc, w in sorted(found.items()):
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i : i + k]), (doc, i))
    out = {}
    for doc, w in found.items():
        gone = {p for i in range(len(w) - k + 1) if first[tuple(w[i : i + k])] != (doc, i) for p in range(i, i + k)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[doc] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal(text: str | None) -> list[tuple[int, int, str, int]]:
    """Base spans as (start, rank, kind, end)."""
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        if kind == "email" and "@" not in (text or ""):
            continue  # the plain pattern takes the square of a long word's length
        for m in re.finditer(pattern, text or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def quality(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen: dict[tuple, list[int]] = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    places = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(places), len(w) < 20 or 100 * len(places) > 30 * len(w)
