"""Plain Python versions of the operators, and the rows they are held against."""

from __future__ import annotations

import hashlib
import math
import random
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, rid long, digest string, key string, c long, token string, size string, taken string, chunk int"


def words(text):
    return WORD.findall((text or "").encode())


def corpus(n: int = 120, seed: int = 3):
    """Texts with copies, near copies, shared passages, repeats, nulls, empty ones, a very long one, rows that repeat; more columns with clashing names."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghié") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    text = lambda k: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\n", "  \t"]) for _ in range(k))
    passage, base = text(60), text(150)
    out = []
    for i in range(n):
        kind = i % 12
        if kind == 0:
            t = None if i % 24 else ""
        elif kind == 1:
            t = base + " " * (i % 5)
        elif kind in (2, 3):
            ws = base.split(" ")
            ws[rng.randrange(len(ws))] = "changed" + str(i)
            t = " ".join(ws)
        elif kind == 4:
            t = text(20) + passage + text(20)
        elif kind == 5:
            t = "round and round " * rng.randint(1, 40)
        elif kind == 6:
            t = "a b" if i % 24 == 6 else "!!! 123"
        else:
            t = text(rng.randint(1, 300))
        out.append((i, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s1", "sé", None]), None, "x", i, "y", "z", 1, "t", "u", "v", 7))
    out.append((n, text(40_000), "en", "s0", 5, *out[0][5:]))
    out += [out[1], out[1], out[13]]  # rows that repeat
    rng.shuffle(out)
    return out


def exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(b"".join(words(t)), []).append((-len(t or ""), i))
    out = []
    for i, t in rows:
        g = groups[b"".join(words(t))]
        out.append((i, min(g)[1], len(g), hashlib.sha256(b"".join(words(t))).hexdigest()))
    return sorted(out)


def repeats(rows, size=20):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        ws = words(t)
        gone = [False] * len(ws)
        for a in range(len(ws) - size + 1):
            k = tuple(ws[a : a + size])
            if k in seen:
                gone[a : a + size] = [True] * size
            seen.add(k)
        left = b" ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        out.append((i, len(ws), sum(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out)


def near(rows, size=5, percent=75):
    lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    sets = []
    for i, t in rows:
        ws = [w.translate(lower) for w in words(t)]
        sets.append((i, frozenset(tuple(ws[a : a + size]) for a in range(max(1, len(ws) - size + 1))) if ws else frozenset()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= percent * (len(sets[a][1]) + len(sets[b][1]) - both):
                root[find(a)] = find(b)
    lowest = {}
    for k, (i, _) in enumerate(sets):
        lowest[find(k)] = min(i, lowest.get(find(k), i))
    return sorted((i, len(s), lowest[find(k)] if s else i) for k, (i, s) in enumerate(sets))


def above(n, everything, max_docs, max_share, min_docs):
    return n > max_docs or n >= min_docs and n > max_share * everything


def quality(rows, max_docs, max_share=0.1, min_docs=5):
    docs, out, hosts = {}, [], {}
    keyed = []
    for i, t, host in rows:
        hosts[host] = hosts.get(host, 0) + 1
        lines = {}
        for line in (t or "").encode().split(b"\n"):
            if ws := words(line.decode()):
                k = b" ".join(ws).lower()
                lines[k] = lines.get(k, 0) + len(ws)
        keyed.append(lines)
        for k in lines:
            docs[host, k] = docs.get((host, k), 0) + 1
    for (i, t, host), lines in zip(rows, keyed, strict=True):
        ws = words(t)
        grams = [tuple(ws[a : a + 3]) for a in range(len(ws) - 2)]
        covered = {a + k for a, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(ws) < 2000 else None
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        removed = sum(n for k, n in lines.items() if above(docs[host, k], hosts[host], max_docs, max_share, min_docs))
        out.append((i, len(ws), sum(len(w.decode()) for w in ws), len(re.findall(r"[#*$%&|<>]", t or "")), dup, None if covered is None else len(covered), removed))
    return out


def mixing(rows, block=64, step=1327217885, most=3, weights=(5, 2, 1)):
    """Rows are (doc_id, text, source). A list of (doc_id, size, source_size, target, taken, first slot), and of (slot, turn, index of the row) for what is taken by half or more."""
    size = [len(words(t)) for _, t, _ in rows]
    names = sorted({r[2] for r in rows if r[2] is not None}) + ([None] if any(r[2] is None for r in rows) else [])
    per = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in names}
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, open_ = sum(size), {}, set(names)
    rest, w = float(total), 1
    while open_:
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / w > most * per[s]]
        if not over:
            break
        for s in over:
            target[s] = float(most * per[s])
        open_ -= set(over)
        rest = total - sum(target.values())
    target |= {s: rest * weight[s] / w for s in open_}
    bounds, at = [], 0.0
    for s in names:
        at += target[s]
        bounds.append(int(at / max(sum(target.values()), 1e-9) * 2**31))
    if bounds:
        bounds[-1] = 2**31
    slots = {s: [] for s in names}
    for i in range(-(-total // block)):
        u = i % 2**31 * step % 2**31
        slots[next(s for s, b in zip(names, bounds, strict=True) if u < b)].append(i)
    out, order = [None] * len(rows), []
    for s in names:
        key = lambda k: hashlib.md5(f"{'' if rows[k][0] is None else rows[k][0]}:{hashlib.md5((rows[k][1] or '').encode()).hexdigest()}".encode()).hexdigest()
        stream = [k for k in sorted((k for k, r in enumerate(rows) if r[2] == s), key=lambda k: (key(k), k)) if size[k]]
        last = -(-total // block) - 1
        given = min(len(slots[s]) * block - ((last + 1) * block - total if last in slots[s] else 0), most * per[s])
        taken, first, place, turn = {}, {}, 0, 0
        while place < given:
            for k in stream:
                got = max(0, min(size[k], given - place))
                if got:
                    taken[k] = taken.get(k, 0) + got
                    first.setdefault(k, slots[s][place // block])
                if 2 * got >= size[k]:
                    order.append((slots[s][place // block], turn, k))
                place += size[k]
            turn += 1
        for k, r in enumerate(rows):
            if r[2] == s:
                out[k] = (r[0], size[k], per[s], target[s], taken.get(k, 0), first.get(k))
    return out, sorted(order)


def letters(text):
    """The text as language identification reads it."""
    return " " + " ".join("".join(c if ord(c) >= 128 or c.isalpha() else " " for c in text).lower().split()) + " "


def language(model, text):
    """(language, score) of a trained model's weights, by plain sums over n-grams."""
    s, counts = letters(text), {}
    for n in (1, 2, 3):
        for a in range(len(s) - n + 1):
            h = 0
            for c in s[a : a + n]:
                h = (h * 31 + ord(c)) * 0x9E3779B1 % 2**32
                h ^= h >> 15
            h %= model.weights.shape[0]
            counts[h] = counts.get(h, 0) + 1
    length = math.sqrt(sum(counts.values()))
    margins = [sum(math.sqrt(c) / length * float(model.weights[h, b]) for h, c in counts.items()) + float(model.bias[b]) for b in range(model.code.shape[1])]
    losses = [sum(float(model.trust[b]) * math.log1p(math.exp(-m * int(model.code[k, b]))) for b, m in enumerate(margins)) for k in range(len(model.langs))]
    low = min(losses)
    return model.langs[losses.index(low)], 1 / sum(math.exp(low - x) for x in losses)
