"""Plain versions of the operators, over lists of rows (doc_id, text, lang, source, ...)."""

import base64
import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def quality(text):
    ws, seen, again = words(text), set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    windows = Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4))
    covered = {k + j for k in range(len(ws) - 4) if windows[tuple(ws[k : k + 5])] > 1 for j in range(5)}
    n = len(covered)
    return len(ws), sum(map(len, ws)), sum(ch in "#*$%&|<>" for ch in text or ""), again, n, len(ws) < 10 or 100 * n > 20 * len(ws)


def simhash(text):
    ws = words((text or "").translate(LOWER))
    if not ws:
        return 0
    shingles = [" ".join(ws[k : k + 3]) for k in range(max(1, len(ws) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=2):
    """fingerprint -> set of fingerprints reachable"""
    prints, group = sorted(set(prints)), {}
    for p in prints:
        if p in group:
            continue
        group[p], stack = p, [p]
        while stack:
            q = stack.pop()
            for o in prints:
                if o not in group and (o ^ q).bit_count() <= radius:
                    group[o] = p
                    stack.append(o)
    return group


def near_copies_kept(rows, size=5, similarity=0.8):
    """doc_ids that stay of all components of pairs whose sets of word runs have the similarity: the smallest of each."""
    sets = {}
    for doc_id, text, *_ in rows:
        ws = words((text or "").translate(LOWER))
        sets[doc_id] = {tuple(ws[k : k + size]) for k in range(max(1, len(ws) - size + 1))}
    left, out = set(sets), []
    while left:
        stack, group = [left.pop()], []
        while stack:
            one = stack.pop()
            group.append(one)
            near = {o for o in left if len(sets[o] & sets[one]) >= similarity * len(sets[o] | sets[one]) - 1e-9}
            left -= near
            stack += near
        out.append(min(group))
    return out


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def line_dedup(rows, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            for line in (text or "").split("\n"):
                holders[line_key(line)].add(doc_id)
    common = {k: max(v) for k, v in holders.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if line_key(x) not in common or common[line_key(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def repeats(rows, n=200):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(t[k : k + n] for _, t in texts for k in range(len(t) - n + 1))
    out = []
    for doc_id, t in texts:
        cover, kept, spans, inside = 0, bytearray(), 0, False
        for k in range(len(t)):
            if k + n <= len(t) and seen[t[k : k + n]] > 1:
                cover = k + n
            if k < cover:
                spans += not inside
                inside = True
            else:
                inside = False
                kept.append(t[k])
        out.append((doc_id, len(t), len(t) - len(kept), spans, hashlib.sha256(bytes(kept)).hexdigest()))
    return out


def contamination(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        ws = ITEM_WORD.findall((text or "").translate(LOWER))
        size = min(13, len(ws))
        for k in range(len(ws) - size + 1) if ws else ():
            windows[tuple(ws[k : k + size])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text, *_ in rows:
        ws, hit, found = ITEM_WORD.findall((text or "").translate(LOWER)), set(), set()
        for size in sizes:
            for k in range(len(ws) - size + 1):
                if w := windows.get(tuple(ws[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= w
        out.append((doc_id, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(ws)))
    return out


def archive(pages):
    """pages: (page_id, url, html)"""
    groups = defaultdict(list)
    for page, _, html in pages:
        groups[(html or "").encode()].append(page)
    out = []
    for page, _, html in pages:
        data = (html or "").encode()
        keeper = max((p for p in groups[data] if p is not None), default=None)
        first = keeper is None or page == keeper
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else keeper))
    return out


def mix(rows, weights=(5, 2, 1), most=3, seed=17):
    """(doc_id, source, size, target, taken) by filling source after source."""
    sizes = defaultdict(int)
    for _, text, _, source, *_ in rows:
        sizes[source] += len(words(text))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > most * sizes[s]}
        if not full:
            target |= share
            break
        target |= {s: most * sizes[s] for s in full}
        open_ -= full
    taken = {}
    for s in order:
        mine = sorted(((hashlib.md5(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:16], r[0] is None, r[0] or 0, len(words(r[1])), k) for k, r in enumerate(rows) if r[3] == s), key=lambda x: x[:4])
        whole = int(target[s] // sizes[s] + 1e-12) if sizes[s] else 0
        quota, upto = target[s] - whole * sizes[s], 0
        for *_, size, k in mine:
            upto += size
            taken[k] = (whole + (upto - size / 2 < quota - 1e-9)) * size
    return [(r[0], r[3], len(words(r[1])), target[r[3]], taken[k]) for k, r in enumerate(rows)]
