"""Plain versions of the operators, one text or pair at a time, to compare with."""

import hashlib
import re
import zlib

BLANK = r"[\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text):
    return [w for w in re.split(BLANK, text or "") if w]


def alnum(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)) if w]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w, text = spaced(text), text or ""
    lines = [x for x in text.split("\n") if spaced(x)]
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = {t for t in triples if triples.count(t) > 1}
    hit = {i + k for i, t in enumerate(triples) if t in many for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def removed_words(docs, size=13):
    """{id: (n_words, n_removed, kept)}"""
    words = {d: spaced(t) for d, t in docs.items()}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - size + 1):
            first.setdefault(tuple(words[d][i : i + size]), d)
    out = {}
    for d, w in words.items():
        gone = {i + k for i in range(len(w) - size + 1) if first[tuple(w[i : i + size])] < d for k in range(size)}
        out[d] = len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)
    return out


def removed_bytes(docs, size=100):
    """{id: (n_bytes, n_removed, n_spans, kept)}"""
    data = {d: (t or "").encode() for d, t in docs.items()}
    first = {}
    for d in sorted(data):
        for i in range(len(data[d]) - size + 1):
            first.setdefault(data[d][i : i + size], (d, i))
    out = {}
    for d, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if first[b[i : i + size]] < (d, i):
                gone[i : i + size] = b"\1" * size
        out[d] = len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone) if not g)
    return out


def shingles(text, size=5):
    w = spaced((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


def near_classes(docs, percent=75):
    """{id: (n_shingles, least id reachable)}"""
    sets = {d: shingles(t) for d, t in docs.items()}
    label = {d: d for d in docs}

    def find(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {d: (len(sets[d]), find(d)) for d in docs}


def contamination(docs, items, size=13):
    """{id: (n_words, n_hit, items, contaminated)}"""
    windows = {}
    for item, text in items:
        w = alnum(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = {}
    for d, text in docs.items():
        w, hit, found = alnum(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if got := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= got
        out[d] = len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)
    return out


def phrase_places(text, phrases):
    w = alnum(text)
    found = [(i, name) for i in range(len(w)) for p, name in phrases if w[i : i + len(p.split())] == p.split()]
    return len(w), len(found), min(found)[0] if found else None, max(found)[0] if found else None, ",".join(sorted({n for _, n in found}))


def checksum(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def unigram_tokens(word, scored, fallback):
    """Tokens of the best segmentation; the longer last piece wins a tie."""
    best = [(0.0, 0)]
    for d in range(1, len(word) + 1):
        score, count = best[d - 1][0] + fallback, best[d - 1][1] + 1
        for width in range(min(d, 48), 0, -1):
            piece = scored.get(word[d - width : d])
            if piece is not None and best[d - width][0] + piece > score:
                score, count = best[d - width][0] + piece, best[d - width][1] + 1
        best.append((score, count))
    return best[-1][1]


def ranked(docs, items, k=50):
    """{item: [(doc, score)]} of [(id, text)] pairs; every row of docs with a term counts."""
    import math
    from collections import Counter

    held = [(d, Counter(w), len(w)) for d, t in docs if (w := alnum(t))]
    count, total = len(held), sum(n for _, _, n in held)
    terms = {}
    for item, text in items:
        if item is not None:
            terms.setdefault(item, set()).update(alnum(text))
    df = Counter(t for _, c, _ in held for t in c)
    out = {}
    for item, wanted in terms.items():
        scores = []
        for d, c, n in held:
            m = 100 - 50 + (50 * n * count) // total
            score = sum(
                math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
                for t in wanted if t in c)
            if score > 0 and d is not None:
                scores.append((-score, d))
        if scores:
            out[item] = [(d, -s) for s, d in sorted(scores)[:k]]
    return out


def merkle(rows, changed):
    """{doc_id: (leaf, subroot, root, proof, folded)} of (doc_id, source, lang, n_chars, text) rows."""
    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def grow(level):
        levels = [level]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([sha("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
        return levels

    def walk(levels, i, start, proof):
        for level in levels[:-1]:
            a, run = i // 8 * 8, level[i // 8 * 8 : i // 8 * 8 + 8]
            proof += "".join(run[: i - a] + run[i - a + 1 :])
            start = sha("".join(run[: i - a]) + start + "".join(run[i - a + 1 :]))
            i //= 8
        return start, proof

    by = {}
    for row in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], leaf(r))):
        by.setdefault(row[2], []).append(row)
    names = sorted(by, key=lambda x: b"" if x is None else b"\1" + x.encode())
    trees = {x: grow([leaf(r) for r in by[x]]) for x in names}
    top = grow([trees[x][-1][0] for x in names])
    out = []
    for k, x in enumerate(names):
        for i, row in enumerate(by[x]):
            fold, proof = walk(trees[x], i, leaf(changed(row)), "")
            fold, proof = walk(top, k, fold, proof)
            out.append((row[0], leaf(row), trees[x][-1][0], top[-1][0], sha(proof), fold, fold == top[-1][0]))
    return out
