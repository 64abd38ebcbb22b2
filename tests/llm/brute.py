"""Plain-Python versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def chat(rows) -> dict:
    """rows: (conv_id, turn, role, text) -> {conv_id: (n_turns, turns_sha256, loss_chars, loss_sha256)}"""
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t if t is not None else float("-inf"), r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def licenses(text: str | None) -> tuple:
    words = LICENSE_WORD.findall(ascii_lower(text or ""))
    found = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def quality(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    windows = [tuple(words[i : i + 8]) for i in range(n - 7)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def shingles(text: str | None) -> frozenset:
    words = WORD.findall(ascii_lower(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def jaccard_components(rows) -> dict:
    """rows: (doc_id, text), ids distinct -> {doc_id: (n_shingles, component_id)}"""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    post = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            post[x].append(d)
    both = Counter()
    for ds in post.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                both[a, b] += 1
    for (a, b), k in both.items():
        if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def repeated_bytes(rows, length: int = 100) -> dict:
    """rows: (doc_id, text), ids distinct -> {doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}"""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


UNITS = set("km m cm mm kg g mg lb oz l ml s min h hours minutes seconds days miles feet inches meters dollars euros cents percent kmh mph".split())


def _tokens(words: list[str]) -> list[str]:
    out = []
    for w in words:
        first = w[0]
        out.append("#" if "0" <= first <= "9" else "^" if first.lower() != first else "@" if w.lower() in UNITS else w.lower())
    return out


def leaks(docs, items, width: int = 8, run: int = 6, plain: int = 4, least: int = 5) -> dict:
    """docs: (doc_id, text), items: (item_id, text), ids distinct -> {(doc_id, item_id): (matched windows, exact)}"""
    split = lambda t: re.findall(r"[^\W_]+", t or "")  # noqa: E731  letters and digits
    out = {}
    for d, text in docs:
        own = split(text)
        canon = _tokens(own)
        for i, item in items:
            words = split(item)
            if len(words) < least:
                lines = [x for x in ([w.lower() for w in split(line)] for line in (text or "").split("\n")) if x]
                if words and [w.lower() for w in words] in lines and (len(words) > 1 or len(lines) == 1):
                    out[d, i] = (1, True)
                continue
            w = min(width, len(words))
            theirs = _tokens(words)
            windows = [a for a in range(len(words) - w + 1) if sum(t not in "#@^" for t in theirs[a : a + w]) >= plain]
            if not windows:
                low = [x.lower() for x in own]
                if any(low[p : p + len(words)] == [x.lower() for x in words] for p in range(len(low) - len(words) + 1)):
                    out[d, i] = (1, True)
                continue
            diagonals = defaultdict(set)
            for a in windows:
                for p in range(len(own) - w + 1):
                    if canon[p : p + w] == theirs[a : a + w]:
                        diagonals[p - a].add(a)
            good = []
            for shift, at in diagonals.items():
                slots = {(words[a + k], own[a + k + shift]) for a in at for k in range(w) if theirs[a + k] in "#@^"}
                if len({x for x, _ in slots}) == len(slots):
                    good.append((at, slots))
            if not good:
                continue
            every = set().union(*(s for _, s in good))
            same = lambda s: all(x == y for x, y in s)
            if len({x for x, _ in every}) == len(every):
                n, exact = len(set().union(*(a for a, _ in good))), same(every)
            else:
                n, exact = max((len(a), same(s)) for a, s in good)
            if n >= min(run, -(-len(windows) // 2)):
                out[d, i] = (n, exact)
    return out


def kneser_ney(training: list[bytes], order: int = 5):
    """p(byte, context) of the interpolated modified Kneser-Ney model, straight from the definition; before a text stand line ends."""
    counts = [Counter() for _ in range(order + 1)]
    for t in training:
        b = b"\n" * (order - 1) + t
        for i in range(order - 1, len(b)):
            counts[order][b[i - order + 1 : i + 1]] += 1
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cuts = []
    for n in range(order + 1):
        of = [max(1, sum(c == k for c in counts[n].values())) for k in (1, 2, 3, 4)]
        y = of[0] / (of[0] + 2 * of[1])
        raw = [1 - 2 * y * of[1] / of[0], 2 - 3 * y * of[2] / of[1], 3 - 4 * y * of[3] / of[2]]
        cuts.append([0.0] + [min(max(r, 0.05), top) for r, top in zip(raw, (0.95, 1.9, 2.85))])
    followers = [defaultdict(list) for _ in range(order + 1)]
    for n in range(1, order + 1):
        for g, c in counts[n].items():
            followers[n][g[:-1]].append(c)

    def p(byte: bytes, context: bytes, n: int) -> float:
        if n == 0:
            return 1 / 256
        shorter = p(byte, context[1:], n - 1)
        seen = followers[n].get(context)
        if not seen:
            return shorter
        c, total = counts[n].get(context + byte, 0), sum(seen)
        lost = sum(cuts[n][min(x, 3)] for x in seen)
        return (c - cuts[n][min(c, 3)]) / total + lost / total * shorter

    def perplexity(text: bytes) -> float:
        b = b"\n" * (order - 1) + text
        logs = [math.log(p(b[i : i + 1], b[i - order + 1 : i], order)) for i in range(order - 1, len(b))]
        return math.exp(-sum(logs) / len(text))

    return perplexity


def context_mixing(rows, hash_of, suffix_of, rate: float = 0.02) -> dict:
    """rows: (doc_id, text), in order of doc_id, fewer than 2048 training tokens -> {doc_id: log10 probability}.

    Word by word and decision by decision from the description: four contexts keyed by what they hold (no
    hashing, so no collisions), weights by gate, adaptive map.  hash_of orders words of one count, suffix_of deals them to classes.
    """
    end = None
    texts = {d: [*WORD.findall(ascii_lower(t or "")), end] for d, t in rows}
    learns = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 != 0
    count = Counter(w for d, ws in texts.items() if learns(d) for w in ws)
    total, distinct = sum(count.values()), len(count)
    order = sorted((w for w in count if count[w] > 1), key=lambda w: (-count[w], hash_of(w)))
    own = [w for w in order if w is not end]
    cls = {w: i if i < 30 else 32 + suffix_of(w) % 32 for i, w in enumerate(own)} | {end: 30}
    unseen = max(0.1, sum(c == 1 for c in count.values()))
    mass = Counter({31: unseen})  # words met once, and any that was never met
    for w in count:
        mass[cls.get(w, 31)] += count[w] + 0.1
    class_of = lambda w: cls.get(w, 30 if w is end else 31)

    def decisions(ws):
        """For each token: its four contexts and its six (depth, node, bit)."""
        cs = [class_of(w) for w in ws]
        for i, c in enumerate(cs):
            back = [cs[i - k] if i >= k else 0 for k in (1, 2, 3)]
            word = ws[i - 1] if i else "<start>"
            yield [(0, back[0]), (1, *back[:2]), (2, *back), (3, word)], [(k, (c + 64) >> (6 - k), (c >> (5 - k)) & 1) for k in range(6)]

    half = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) // 10 % 2
    halves = [Counter(), Counter()]
    for d, ws in texts.items():
        if learns(d):
            for contexts, steps in decisions(ws):
                for x in contexts:
                    for _, node, bit in steps:
                        halves[half(d)][x, node, bit] += 1
    seen = halves[0] + halves[1]

    def gate(k, node, contexts, seen=seen):
        level = lambda x: int(min(math.log2(1 + seen[x, node, 0] + seen[x, node, 1]) / 3, 3))
        return k, level(contexts[2]), level(contexts[3])

    def log_odds(x, node, seen=seen):
        return math.log((seen[x, node, 1] + 0.4) / (seen[x, node, 0] + 0.4))

    squash = lambda x: 1 / (1 + math.exp(-max(-30, min(30, x))))
    weights, met, summed = defaultdict(lambda: [0.25] * 4 + [0.0]), Counter(), defaultdict(lambda: [0.0] * 5)
    cells = {(n, i): [8 * squash((i - 12) / 2), 8 * (1 - squash((i - 12) / 2))] for n in range(64) for i in range(25)}
    added = Counter()
    for part in (0, 1):  # each half is one learner, with the other's counts
        weights.clear()
        batch, others = [step for d, ws in texts.items() if learns(d) and half(d) == part for step in decisions(ws)], halves[1 - part]
        for k in range(6):
            moves, n = defaultdict(lambda: [0.0] * 5), Counter()
            for contexts, steps in batch:
                _, node, bit = steps[k]
                odds = [log_odds(x, node, others) for x in contexts] + [1.0]
                g = gate(k, node, contexts, others)
                x = sum(w * o for w, o in zip(weights[g], odds))
                for i, o in enumerate(odds):
                    moves[g][i] += (bit - squash(x)) * o
                n[g] += 1
                added[node, min(24, max(0, round(x * 2 + 12))), bit] += 1
            for g, m in moves.items():
                weights[g] = [w + rate * v / math.sqrt(n[g]) for w, v in zip(weights[g], m)]
                met[g] += n[g]
                summed[g] = [s + n[g] * w for s, w in zip(summed[g], weights[g])]
    final = {g: [s / met[g] for s in summed[g]] for g in met}
    for (node, i, bit), v in added.items():
        cells[node, i][1 - bit] += v
    rare = [w for d, ws in texts.items() if learns(d) for w in ws if w is not end and w not in cls]
    letters = Counter(b for w in rare for b in w.encode())
    spelled = lambda w: sum(math.log((letters[b] + 1) / (sum(letters.values()) + len(rare) + 257)) for b in w.encode()) + math.log((len(rare) + 1) / (sum(letters.values()) + len(rare) + 257))
    curve = lambda node, i: math.log((cells[node, i][0] + 0.02) / (cells[node, i][1] + 0.02))
    out = {}
    for d, ws in texts.items():
        logs = 0.0
        for w, (contexts, steps) in zip(ws, decisions(ws)):
            for k, node, bit in steps:
                odds = [log_odds(x, node) for x in contexts] + [1.0]
                x = sum(a * b for a, b in zip(final.get(gate(k, node, contexts), [0.25] * 4 + [0.0]), odds))
                at = min(24 - 1e-3, max(0.0, x * 2 + 12))
                i = int(at)
                x = 0.5 * x + 0.5 * (curve(node, i) * (1 - at + i) + curve(node, i + 1) * (at - i))
                logs -= math.log1p(math.exp(-x if bit else x))
            logs += math.log((count[w] + 0.1 if count[w] else unseen) / mass[class_of(w)]) + (0.0 if count[w] or w is end else spelled(w))
        out[d] = logs / math.log(10)
    return out


def pipeline(rows, labels, items, encode, quantile: float = 0.99, margin: float = 1.15, slack: float = 3.0) -> dict:
    """rows: (doc_id, text, lang) with distinct ids -> {doc_id: ids} of what the stages leave; labels: trusted ids; encode: text -> ids."""
    texts = {d: t or "" for d, t, _ in rows}
    perplexity = kneser_ney([texts[d].encode() for d in labels])
    seen = {d: perplexity(t.encode()) for d, t in texts.items() if t}
    lang = {d: g for d, _, g in rows}

    def limit(own):
        own = sorted(own)
        return margin * own[max(0, math.ceil(quantile * len(own)) - 1)]

    trusted = [d for d in labels if d in seen]
    limits = {g: limit(seen[d] for d in trusted if lang[d] == g) for g in {lang[d] for d in trusted}}
    every = limit(seen[d] for d in trusted)
    kept = {d: texts[d] for d, p in seen.items() if p <= limits.get(lang[d], every) * (1 + slack / math.sqrt(len(texts[d].encode())))}
    kept = {d: kept[d] for d, (_, c) in jaccard_components(kept.items()).items() if c == d}
    whole, kept, before = kept, {}, set()
    for d in sorted(whole):
        b = whole[d].encode()
        windows = [b[i : i + 100] for i in range(len(b) - 99)]
        gone = bytearray(len(b))
        for i, w in enumerate(windows):
            if w in before:
                gone[i : i + 100] = b"\1" * 100
            before.add(w)
        left = bytes(x for x, g in zip(b, gone) if not g)
        if left:
            kept[d] = left.decode("utf-8", "ignore")
    leaked = {d for d, _ in leaks(kept.items(), items)}
    return {d: [*encode(t), 2] for d, t in kept.items() if d not in leaked}


def phrases(rows, least: int = 10, most: int = 3, top: int = 2000, absorbed: int = 50) -> dict:
    """rows: (text, lang) -> {(lang, rank): (phrase, a, l, r, n, score)}"""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f.update((lang, *ws[i : i + k]) for k in range(1, most + 1) for i in range(len(ws) - k + 1))
    candidates = {p: c for p, c in f.items() if len(p) > 2 and c >= least}
    gone = {(p[0], *p[i : i + k]) for p, c in candidates.items() for k in range(2, len(p) - 1) for i in range(1, len(p) - k + 1) if 100 * c >= absorbed * candidates[(p[0], *p[i : i + k])]}
    ranked = defaultdict(list)
    for p, a in candidates.items():
        if p not in gone:
            score, _, left, right = min((10**6 * a * a // (f[p[: j + 1]] * f[(p[0], *p[j + 1 :])]), j, f[p[: j + 1]], f[(p[0], *p[j + 1 :])]) for j in range(1, len(p) - 1))
            ranked[p[0]].append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return {(lang, i): (s.decode(), -a, left, right, n[lang], -score) for lang, found in ranked.items() for i, (score, a, s, left, right) in enumerate(sorted(found)[:top], 1)}


def vector_codes(rows, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096):
    """rows: (vec_id, vector, label) -> ({vec_id: (code, error, label_error)}, digest)"""
    kept = [(i, [math.floor(x * scale) if abs(x) < 2**40 else int(x) * scale for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    if not kept:
        return {}, hashlib.sha256(b"").hexdigest()
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : p * w + w]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v, p: min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v, _ in kept:
            for p in range(parts):
                groups[p, nearest(v, p)].append(cut(v, p))
        for (p, e), own in groups.items():
            books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    found = [(i, g, [nearest(v, p) for p in range(parts)], sum(far(cut(v, p), books[p][nearest(v, p)]) for p in range(parts))) for i, v, g in kept]
    total = defaultdict(int)
    for _, g, _, e in found:
        total[g] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for entry in b for x in entry).encode()).hexdigest()
    return {i: ("".join(f"{c:02x}" for c in code), e, total[g]) for i, g, code, e in found}, digest
