"""Plain versions of the operators, one Python object at a time, to hold results against."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
VISIBLE = re.compile(r"[^\x20\x09-\x0D]+")


def remainder(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


def decontamination(docs, items, window=13):
    places = defaultdict(set)
    lengths = set()
    for item_id, text in items:
        words = LETTERS.findall((text or "").translate(LOWER))
        n = min(len(words), window)
        if n:
            lengths.add(n)
            for k in range(len(words) - n + 1):
                places[tuple(words[k : k + n])].add(item_id)
    out = []
    for doc_id, text in docs:
        words = LETTERS.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(words) - n + 1):
                if ids := places.get(tuple(words[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= ids
        names = ",".join(sorted(map(str, found)))
        out.append((doc_id, len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(words)))
    return sorted(out)


def shingles(text, width):
    words = VISIBLE.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))


def near_duplicates(docs, width=4, percent=80):
    sets = [(doc_id, shingles(text, width)) for doc_id, text in docs]
    up = {doc_id: doc_id for doc_id, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    by = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            by[g].append(k)
    for k, (a, s) in enumerate(sets):
        shared = Counter(j for g in s for j in by[g] if j < k)
        for j, n in shared.items():
            b, t = sets[j]
            if 100 * n >= percent * (len(s) + len(t) - n):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return sorted((doc_id, len(s), find(doc_id), find(doc_id) == doc_id) for doc_id, s in sets)


def tokens(text):
    return [*VISIBLE.findall((text or "").translate(LOWER)), None]


def lm(docs, order=3, smoothing=(0, 5, 3, 2, 2)):
    """n_tokens, n_known, base, score for (doc_id, text), by dictionaries and recursion."""
    train = [tokens(t) for d, t in docs if remainder(d) != 1]
    counts = Counter(tuple(words[i : i + k]) for words in train for k in range(1, order + 1) for i in range(len(words) - k + 1))
    n, v = sum(map(len, train)), sum(len(g) == 1 for g in counts)
    once = max(1, sum(c == 1 for g, c in counts.items() if len(g) == 1))

    def p(history, word):
        if not history:
            return (counts[(word,)] or once) / (n + once)
        m, c = smoothing[len(history)], counts[history]
        lower = p(history[1:], word)
        return (counts[(*history, word)] + m * lower) / (c + m) if c else lower

    out = []
    for d, t in docs:
        words = tokens(t)
        base = sum(math.log10((counts[(w,)] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        score = sum(math.log10(p(tuple(words[max(0, i - order + 1) : i]), w)) for i, w in enumerate(words))
        out.append((d, remainder(d) == 1, len(words), sum(counts[(w,)] > 0 for w in words), n, base, score))
    return sorted(out)


def mixing_targets(sizes, share=1.5, limit=2.0, weights=(5, 2, 1)):
    """source -> (size, target), by resharing what is over again and again."""
    total = defaultdict(int)
    for source, size in sizes:
        total[source] += size
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {}, list(names), share * sum(total.values())
    while open_:
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > limit * total[s]]
        if not over:
            for s in open_:
                target[s] = left * weight[s] / sum(weight[x] for x in open_)
            break
        for s in over:
            target[s] = limit * total[s]
            left -= target[s]
            open_.remove(s)
    return {s: (total[s], target[s]) for s in names}


def mixing_rates(cells, targets, limit=2.0):
    """Rates by (source, class), for cells {source: {class: mass}}: nested bisection on the tilt and on each source's lambda."""
    total = sum(m for by in cells.values() for m in by.values())
    mean = sum(m * c for by in cells.values() for c, m in by.items()) / total

    def rate(lam, mu, c):
        return math.exp(min(math.log(limit), lam + mu * (c - mean)))

    def lam_for(source, mu):
        low, high = -60.0, 60.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(m * rate(mid, mu, c) for c, m in cells[source].items()) < targets[source] else (low, mid)
        return high

    def moment(mu):
        return sum(m * (c - mean) * rate(lam_for(s, mu), mu, c) for s, by in cells.items() for c, m in by.items())

    low, high = -1.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if moment(mid) < 0 else (low, mid)
    return {(s, c): rate(lam_for(s, low), low, c) for s, by in cells.items() for c in by}


def mixing(docs, share=1.5, limit=2.0, close=5e-4):
    """doc_id -> words taken, for (doc_id, source, size) with different doc_ids."""
    import struct

    import xxhash

    known = mixing_targets([(s, n) for _, s, n in docs], share, limit)
    cells = {}
    for _, s, n in docs:
        if n:
            by = cells.setdefault(s, {})
            by[n.bit_length()] = by.get(n.bit_length(), 0) + n
    rates = mixing_rates(cells, {s: t for s, (_, t) in known.items()}, limit)
    taken = {}
    for s, (_, target) in known.items():
        rows, gap = [], target
        for k, source, n in docs:
            if source != s:
                continue
            r = rates[s, n.bit_length()] if n else 0.0
            base = math.floor(r + 1e-9)
            h = 42
            for data in (str(k).encode(), struct.pack("<q", n), struct.pack("<i", 20260101)):
                h = xxhash.xxh64(data, seed=h).intdigest()
            uniform = ((h >> 11) + 0.5) / 2**53
            part = max(0.0, r - base)
            taken[k] = base * n
            gap -= base * n
            # one more copy by the rest of the rate, and after all those the further ones that the limit allows
            rows += [(uniform / (uniform + part) if t == 0 else t + uniform, n, k) for t in range(int(limit) - base if n else 0)]
        rows.sort()
        half = False
        while gap > close * target:
            fits = [x for x in rows if x[1] <= (gap / 2 if half else gap)]
            if not fits and not half:
                break
            left = gap
            for x in fits:
                if x[1] > left:
                    break
                left -= x[1]
                taken[x[2]] += x[1]
                rows.remove(x)
            gap, half = left, not half
        if gap > close * target and (near := [x for x in rows if x[1] < 2 * gap]):
            best = min(near, key=lambda x: (abs(x[1] - gap), x[0]))
            taken[best[2]] += best[1]
    return taken


_MASK = (1 << 64) - 1


def _mixed(x):
    x ^= x >> 32
    x = x * 0xD6E8FEB86659FD93 & _MASK
    x ^= x >> 29
    x = x * 0xA24BAED4963EE407 & _MASK
    return x ^ x >> 32


def character_grams(text, orders=(4, 5, 6), bits=22):
    """Hashed n-grams of characters, by Python's integers."""
    places = [_mixed(k * 0x9E3779B97F4A7C15 & _MASK) | 1 for k in range(1, 17)]
    salts = [_mixed(k * 0xC2B2AE3D27D4EB4F & _MASK) for k in range(101, 117)]
    letters = []
    for c in text or "":
        low = c.lower()
        c = low if len(low) == 1 and ord(c) < 1 << 16 and ord(low) < 1 << 16 else c
        letters.append(32 if c in "\t\n\x0b\x0c\r" else ord(c))
    return {
        (sum(letters[at + j] * places[j] for j in range(n)) + salts[n - 1] & _MASK) >> 64 - bits
        for n in orders
        for at in range(len(letters) - n + 1)
    }


def toxicity_features(rows, min_z=3.5, alpha=1.0):
    """feature -> log-count ratio, for (text, label)."""
    seen = {0: Counter(), 1: Counter()}
    n = Counter(y for _, y in rows)
    for text, y in rows:
        seen[y].update(character_grams(text))
    out = {}
    for f in seen[0].keys() | seen[1].keys():
        d0, d1 = seen[0][f], seen[1][f]
        ratio = math.log((d1 + alpha) / (n[1] + 2 * alpha)) - math.log((d0 + alpha) / (n[0] + 2 * alpha))
        if abs(ratio) / math.sqrt(1 / (d1 + alpha) + 1 / (d0 + alpha)) >= min_z:
            out[f] = ratio
    return out


def toxicity_score(text, weights, bias):
    margin = sum(weights.get(f, 0.0) for f in character_grams(text)) + bias
    return 1 / (1 + math.exp(-min(40, max(-40, margin))))


def licences(text, model, least=0.6, overlap=0.6):
    """n_paragraphs, candidates and sorted (line, family, probability, overlap) of the confirmed units, by loops."""
    from inkwell.llm import license

    lines, parts, begin = (text or "").split("\n"), [[]], [0]
    for k, line in enumerate(lines):
        if k and not line.strip(" \t\r\f\x0b") and k < len(lines):
            # the line feed before a blank line ends a paragraph, and the blank line begins the next
            parts.append([])
            begin.append(k)
        parts[-1].append(line)
    anchors = set(license.ANCHORS)
    templates = {f: license._template_pairs(f) for f in license.TEMPLATES}
    n = sum(any(x.strip() for x in part) for part in parts)
    candidates, out = 0, set()
    for start, part in zip(begin, parts, strict=True):
        words = [license.words_of(line) for line in part]
        if not any(anchors & set(w) for w in words):
            continue
        candidates += 1
        flat = [(w, k) for k, line in enumerate(words) for w in line]
        units = [(k, line) for k, line in enumerate(words)]
        for number, (most, step) in enumerate(license.WINDOWS):
            if len(flat) > most or (number == 0 and len(part) > 1 and flat):
                last = max(1, len(flat) - most + step)
                units += [(flat[at - 1][1], [w for w, _ in flat[at - 1 : at - 1 + most]]) for at in range(1, last + 1, step)]
        best = {}
        for line, unit in units:
            if not anchors & set(unit):
                continue
            found = license.features_of(unit)
            p = license._softmax([x / model.temperature for x in license._scores(model.weights, model.bias, found)])
            top = max(range(len(p)), key=lambda k: (p[k], -k))
            family = model.families[top]
            pairs = set(zip(unit, unit[1:], strict=False))
            similar = max((len(pairs & t) / len(t) for t in templates.get(family, ()) if t), default=0.0)
            if family != "unknown" and p[top] >= least and similar >= overlap:
                rank = (p[top], -(start + line), similar)
                best[family] = max(best.get(family, rank), rank)
        out |= {(-line, family, p, similar) for family, (p, line, similar) in best.items()}
    return n, candidates, sorted(out)


def chat(turns):
    """conv_id -> digests of the turns and of the assistant's words."""
    by = defaultdict(list)
    for conv_id, turn, role, text in turns:
        by[conv_id].append((turn, role or "", text or ""))
    out = []
    for conv_id, rows in by.items():
        rows.sort()
        said = [t for _, r, t in rows if r == "assistant"]
        out.append((conv_id, len(rows), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in rows).encode()).hexdigest(), len("".join(said)), hashlib.sha256("".join(said).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0]) if r[0] is not None else (False,))
