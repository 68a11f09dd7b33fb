"""Plain-Python versions of the text operators for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")
WHITE = " \t\n\x0b\x0c\r"


def sha(raw: bytes | str) -> str:
    return hashlib.sha256(raw.encode() if isinstance(raw, str) else raw).hexdigest()


def words(text: str | None) -> list[str]:
    return ALNUM.findall((text or "").translate(UPPER))


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    found = SOLID.findall(text)
    lines = [line for line in text.split("\n") if SOLID.search(line)]
    windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    count, covered = Counter(windows), set()
    for i, window in enumerate(windows):
        if count[window] > 1:
            covered.update(range(i, i + 5))
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(found), sum(map(len, found)), symbols, len(lines) - len(set(lines)), len(covered)


def substrings(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r) + 2)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = b"\x01" * length
        spans = sum(gone[i] > gone[i - 1] for i in range(1, len(gone)))
        out.append((len(r), sum(gone), spans, sha(bytes(b for b, g in zip(r, gone[1:]) if not g))))
    return out


def shared_passages(docs: list[tuple], n: int) -> list[int]:
    """Words of each document at which a passage of n words starts that also stands in a document of another id or text."""
    where: dict = {}
    cells = []
    for k, text in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = words(low)
        cells.append([tuple(w[i : i + n]) for i in range(len(w) - n + 1)])
        for c in cells[-1]:
            where.setdefault(c, set()).add((k, text))
    return [sum(len(where[c]) > 1 for c in row) for row in cells]


def line_key(line: str) -> str:
    return line.strip(WHITE).translate(UPPER)


def lines(docs: list[tuple], min_docs: int, keep_first: bool = False) -> list[tuple[str, int, int]]:
    """(text, lines, dropped) of each (doc_id, text); ids order first occurrences."""
    owners = defaultdict(set)
    for doc in set(docs):
        for line in (doc[1] or "").split("\n"):
            owners[line_key(line)].add(doc)
    drop = {k for k, d in owners.items() if k and len(d) >= min_docs}
    spared = {}
    for doc in sorted(set(docs), key=lambda d: d[0]):
        for at, line in enumerate((doc[1] or "").split("\n")):
            spared.setdefault(line_key(line), (doc, at))
    out = []
    for doc in docs:
        all_lines = (doc[1] or "").split("\n")
        left = [x for at, x in enumerate(all_lines) if line_key(x) not in drop or (keep_first and spared[line_key(x)] == (doc, at))]
        out.append(("\n".join(left), len(all_lines), len(all_lines) - len(left)))
    return out


def contamination(texts: list[str | None], items: list[tuple], window: int) -> list[tuple[int, int, list[str]]]:
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if w else []:
            windows[tuple(w[i : i + n])].add("" if item is None else str(item))
    sizes = {len(k) for k in windows}
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((len(w), len(hit), sorted(found)))
    return out


def grams(text: str | None, n: int = 5) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def near_duplicates(docs: list[tuple], threshold: float = 0.8) -> list[tuple]:
    """(least id of the connected group, number of links) of each (doc_id, text)."""
    sets = [grams(t) for _, t in docs]
    links = [
        [j for j in range(len(docs)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9]
        for i in range(len(docs))
    ]
    group = list(range(len(docs)))
    changed = True
    while changed:
        changed = False
        for i, near in enumerate(links):
            least = min([group[i], *(group[j] for j in near)])
            if least < group[i]:
                group[i], changed = least, True
    first = {}
    for i, g in enumerate(group):
        first[g] = min(first.get(g, docs[i][0]), docs[i][0])
    return [(first[g], len(n)) for g, n in zip(group, links)]


def infilled(doc_id, text: str | None) -> tuple:
    """(tokens, form, prefix, middle, output) by regular expression."""
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(tokens), "plain", None, None, text
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if h[3] % 100 < 20:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def collocations(docs, least: int, most: int, top: int) -> list[tuple]:
    """(lang, rank, phrase, a, l, r, n, score) from (lang, text) rows, by counting all phrases."""
    counts, total = {}, {}
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] = total.get(lang, 0) + len(words)
            for size in range(1, most + 1):
                for k in range(len(words) - size + 1):
                    key = lang, tuple(words[k : k + size])
                    counts[key] = counts.get(key, 0) + 1
    often = {k: v for k, v in counts.items() if v >= least}
    covered = set()
    for (lang, words), f in often.items():
        for size in range(2, len(words)):
            for k in range(len(words) - size + 1):
                part = lang, words[k : k + size]
                if f >= often[part]:
                    covered.add(part)
    rows = []
    for (lang, words), a in often.items():
        if len(words) < 2 or (lang, words) in covered:
            continue
        n = total[lang]
        cuts = [(1000 * a * n // (often[lang, words[:k]] * often[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        rows.append((lang, -score, -a, " ".join(words).encode(), often[lang, words[:k]], often[lang, words[k:]], n))
    out, rank = [], {}
    for lang, score, a, phrase, left, right, n in sorted(rows):
        rank[lang] = rank.get(lang, 0) + 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, n, -score))
    return out


def longest_first(sizes: list[int], shards: int) -> list[int]:
    """Loads after giving each size, the largest first, to the least loaded shard."""
    loads = [0] * shards
    for size in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += size
    return loads
