"""Plain versions of the training-data operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def crc(doc_id, modulus: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def edited(rows):
    """doc_id, n_chars, edited_sha256 in order; null ids first, then by id and text."""
    own = sorted(((i is not None, i or 0, t or ""), i) for i, t in rows)
    texts = [k[2] for k, _ in own]
    out = []
    for n, (k, i) in enumerate(own):
        t, after = k[2], texts[(n + 1) % len(texts)]
        half = len(t) // 2
        out.append((i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    return out


def chunk_digests(text, gear, least, usual, most, rare, common):
    """Digest and bytes of each distinct chunk: hashes byte by byte, and from each bound the next by trying every end."""
    data, hashes, h = text.encode(), [], 0
    for b in data:
        h = (2 * h + int(gear[b])) % 2**32
        hashes.append(h)
    mark = lambda end, bits: hashes[end - 1] < 2 ** (32 - bits)
    at, out = 0, {}
    while at < len(data):
        end = len(data)
        if end - at > least:
            soon = [e for e in range(at + least, min(at + usual, end) + 1) if mark(e, rare)]
            late = [e for e in range(at + usual + 1, min(at + most, end) + 1) if mark(e, common)]
            end = (soon + late + [min(at + most, end)])[0]
        out[xxhash.xxh3_64(data[at:end]).hexdigest()[:12]] = end - at
        at = end
    return out


def fingerprints(rows, *rule):
    """doc_id, fingerprint, edited_fingerprint, near_edited, near_next, in the order of edited()."""
    def shared(a, b):
        return sum(a[d] for d in set(a) & set(b)) / sum(a.values()) if a and b else float(a == b)

    own = sorted(((i is not None, i or 0, t or ""), i) for i, t in rows)
    texts, out = [k[2] for k, _ in own], []
    for n, (t, (_, i)) in enumerate(zip(texts, own, strict=True)):
        after, half = texts[(n + 1) % len(texts)], len(t) // 2
        mine, other, following = (chunk_digests(x, *rule) for x in (t, t[: len(t) - half] + after[:half], after))
        said = [" ".join(f"{d}:{k}" for d, k in sorted(x.items())) for x in (mine, other)]
        out.append((i, *said, round(shared(mine, other), 9), round(shared(mine, following), 9)))
    return out


def kept_words(rows, window=35):
    docs = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in docs for k in range(len(w) - window + 1))
    out = []
    for i, w in docs:
        gone = {j for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def components(rows, width=5, percent=80):
    """doc_id, n_shingles, component_id, kept; ids are unique and not null."""
    sets = {}
    for i, t in rows:
        w = WORD.findall(low(t))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    held = defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            held[s].append(i)
    common = Counter((a, b) for ids in held.values() for n, b in enumerate(ids) for a in ids[:n])
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)  # noqa: PLW2901
            top[max(a, b)] = min(a, b)
    return [(i, len(sets[i]), find(i), find(i) == i) for i in sorted(sets)]


def phrases(rows, known):
    out = []
    for i, t in rows:
        w = ALNUM.findall(low(t))
        hits = [(k, label) for k in range(len(w)) for p, label in known.items() if w[k : k + len(p.split())] == p.split()]
        places = [k for k, _ in hits]
        out.append((i, len(w), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))))
    return out


def longest_common(a, b):
    rows = [[0] * (len(b) + 1)]
    for x in a:
        rows.append([0])
        for k, y in enumerate(b):
            rows[-1].append(rows[-2][k] + 1 if x == y else max(rows[-2][k + 1], rows[-1][k]))
    return rows[-1][-1]


def license_labels(rows, templates, most, drift, voted, enough, short, half_way):
    """doc_id, labels and score of each text. templates: label, words, strict, least score."""
    out = []
    for i, t in rows:
        words = [w.encode() for w in ALNUM.findall(low(t))]
        at = defaultdict(list)
        for gram in range(1, most + 1):
            for k in range(len(words) - gram + 1):
                at[tuple(words[k : k + gram])].append(k)
        found = {}
        for label, own, strict, least in templates:
            votes, gram = defaultdict(list), min(most, len(own))
            size = len(own) - gram + 1
            for place in range(size):
                for k in at[tuple(own[place : place + gram])]:
                    votes[k - place].append((place, k))
            reach = math.ceil(size * (1 / enough - 1)) + drift
            copies, last, low_, chain = defaultdict(list), None, None, -1
            for d in sorted(votes):
                if strict or last is None or d - last > drift:
                    low_, chain = d, chain + 1
                last = d
                copies[chain, (d - low_) // reach] += votes[d]
            for v in copies.values():
                if len({p for p, _ in v}) < (size if strict else size * voted):
                    continue
                span = words[min(k for _, k in v) : max(k for _, k in v) + gram]
                n = longest_common(own, span)
                if (span == own) if strict else (n >= enough * len(own) and n >= enough * len(span)):
                    right = len(own) if strict else n
                    sure = least if right < short else 1 - (1 - least) / 2 ** (right / half_way)
                    found[label] = max(found.get(label, 0), sure * right / len(own))
        out.append((i, ",".join(sorted(found)), max(found.values(), default=0)))
    return out


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """By source: the share, with what capped sources leave dealt again until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, still, out = share * sum(sizes.values()), list(names), {}
    while still:
        total = sum(weight[s] for s in still)
        over = [s for s in still if left * weight[s] / total >= most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in still}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        still = [s for s in still if s not in over]
    return out


def base_scores(rows, modulus=7, left_out=2):
    docs = [(i, [*WORD.findall(low(t)), None]) for i, t in rows]
    seen = Counter(w for i, own in docs if crc(i, modulus) != left_out for w in own)
    total, distinct = sum(seen.values()), len(seen)
    return [(i, crc(i, modulus) == left_out, len(w), sum(seen[x] > 0 for x in w), total, sum(math.log10((seen[x] + 1) / (total + distinct + 1)) for x in w)) for i, w in docs]


def interpolated(rows, mixture, bucket_of, modulus=7, left_out=2):
    """doc_id and score under given weights: triples, then pairs, single tokens and any token."""
    weights, trust = mixture
    docs = [(i, [*WORD.findall(low(t)), None]) for i, t in rows]
    taught = [w for i, w in docs if crc(i, modulus) != left_out]
    begin = object()
    runs = [Counter(tuple([begin, begin, *w][k + 2 - n : k + 3]) for w in taught for k in range(len(w))) for n in range(3)]
    total, distinct = sum(runs[0].values()), len(runs[0])
    out = []
    for i, w in docs:
        score, padded = 0.0, [begin, begin, *w]
        for k in range(len(w)):
            u, v, x = padded[k : k + 3]
            before1 = runs[0][v,] if k else len(taught)
            before2 = runs[1][u, v] if k else len(taught)
            w2, w1, w0 = weights[bucket_of(before1)]
            lower = w2 * runs[1][v, x] / max(before1, 1) + w1 * runs[0][x,] / max(total, 1) + w0 / (distinct + 1)
            t = trust[bucket_of(before2)]
            score += math.log10(t * runs[2][u, v, x] / max(before2, 1) + (1 - t) * lower)
        out.append((i, score))
    return out


def line_features(text):
    """What crf.lines() measures of each line, a line at a time."""
    out, lines = [], text.split("\n")
    words = [WORD.findall(low(x)) for x in lines]
    times = Counter(tuple(sorted(w)) for w in words)
    for line, own in zip(lines, words, strict=True):
        raw, n = line.encode(), len(own)
        size, upper, lower = max(len(raw), 1), sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 for b in raw)
        letters, again = max(upper + lower, 1), sum(a == b for a, b in pairwise(own))
        count = lambda signs, raw=raw: sum(b in signs for b in raw)
        out.append([
            math.log1p(len(raw)), math.log1p(n), len(raw) / max(n, 1) / 10, upper / letters, upper / letters > 0.7, count(b"0123456789") / size, 5 * count(b"|") / size, 5 * count(b"!") / size,
            5 * count(b"#$%&*@^~_=+<>{}[]\\/`") / size, 5 * count(b".,;:'\"()-?") / size, sum(b >= 128 for b in raw) / size, again / max(n, 1), again / max(n, 1) > 0.2,
            times[tuple(sorted(own))] > 1 and n > 1, raw[-1:] in (b".", b"!", b"?", b":"), not raw,
        ])
    return [[float(x) for x in row] for row in out], [len(x.encode()) for x in lines]


def line_quality(text, model):
    """The length-weighted chance that lines are good, by sums of products along the chain."""
    rows, size = line_features(text)
    scaled = [[(v - m) / s for v, m, s in zip(r, model["mean"], model["spread"], strict=True)] for r in rows]
    none, n = [0.0] * len(scaled[0]), len(scaled)
    good = []
    for k, own in enumerate(scaled):
        before, after = scaled[k - 1] if k else none, scaled[k + 1] if k + 1 < n else none
        x = [*own, *before, *after, float(not k), float(k + 1 == n), 1.0]
        good.append(math.exp(sum(a * b for a, b in zip(x, model["weights"], strict=True))))
    tie = [[math.exp(v) for v in row] for row in model["ties"]]
    own = [[1.0, g] for g in good]
    forward, backward = [own[0]], [[1.0, 1.0]]
    for k in range(1, n):
        forward.append([own[k][y] * sum(forward[-1][x] * tie[x][y] for x in (0, 1)) for y in (0, 1)])
        forward[-1] = [v / sum(forward[-1]) for v in forward[-1]]
    for k in range(n - 1, 0, -1):
        backward.insert(0, [sum(tie[x][y] * own[k][y] * backward[0][y] for y in (0, 1)) for x in (0, 1)])
        backward[0] = [v / sum(backward[0]) for v in backward[0]]
    chance = [f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]) for f, b in zip(forward, backward, strict=True)]
    return sum(c * (s + 1) for c, s in zip(chance, size, strict=True)) / sum(s + 1 for s in size)


def machine_chance(terms, model):
    """A factorization machine's chance for a set of known terms, pair by pair."""
    at = [k for k, slot in enumerate(model["kept"].tolist()) if slot in terms]
    total = float(model["w0"][0]) + sum(float(model["w"][k]) for k in at)
    total += sum(float(sum(model["v"][a] * model["v"][b])) for n, a in enumerate(at) for b in at[:n])
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def gapless(places):
    """places: (offset, length) of one sequence."""
    places = sorted(places)
    return places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in pairwise(places))


def sizes_of(text):
    return len((text or "").encode())


def rebuilt_conversations(rows, family=5, longest=8):
    """rows: conv_id, turn, role, text. For each conversation the list of (role, text), its beginning taken from its family's first."""
    own = defaultdict(list)
    key = lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{sizes_of(r[2])}:".encode() + (r[2] or "").encode() + (r[3] or "").encode()).digest())
    for c, _, role, text in sorted((r for r in rows if r[0] is not None), key=key):
        own[c].append((role or "", text or ""))
    out = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % (longest + 1)
        out[c] = own.get(c - int(math.fmod(c, family)), [])[:h] + said[h:]
    return out


def trie_nodes(conversations):
    """Rows of the trie of conversations (id to list of turns), each node from its members."""
    members = defaultdict(set)
    for c, said in conversations.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].add(c)
    out = []
    for node, who in members.items():
        d = len(node)
        below = [x for x in members if x[:d] == node]
        ends = ",".join(str(c) for c in sorted(who) if len(conversations[c]) == d)
        childless = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        saved = sum((len(members[x]) - 1) * sizes_of(x[-1][1]) for x in below if x)
        out.append((min(who), d, min(members[node[:-1]]) if d else None, len(who), sum(len(x) == d + 1 for x in below), len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def alignments(rows, tokenizer, pieces):
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_best_a by two pointers. tokenizer, pieces: the libraries' own."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(x for x in range(256) if x not in shown)}
    done = []
    for i, t in rows:
        a, b = tokenizer.encode(" " + (t or ""), add_special_tokens=False).ids, pieces.encode(t or "")
        of_a = [bytes(letter[c] for c in tokenizer.id_to_token(x)) for x in a]
        of_b = [bytes.fromhex(p[3:5]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(pieces.id_to_piece, b)]
        if not t or b"".join(of_a) != (" " + t).encode() or b"".join(of_b) != (" " + t).encode():
            done.append((i, [], [], [], []))
            continue
        links, groups, x, y, end_a, end_b, own = [], [], 0, 0, len(of_a[0]), len(of_b[0]), ([a[0]], [b[0]])
        while True:
            links.append((a[x], b[y]))
            if end_a == end_b:
                groups.append(",".join(map(str, own[0])) + "|" + ",".join(map(str, own[1])))
                own = ([], [])
            step_a, step_b = end_a <= end_b, end_b <= end_a
            x, y = x + step_a, y + step_b
            if x == len(a):
                break
            if step_a:
                end_a += len(of_a[x])
                own[0].append(a[x])
            if step_b:
                end_b += len(of_b[y])
                own[1].append(b[y])
        done.append((i, a, b, links, groups))
    count = Counter(pair for *_, links, _ in done for pair in links)
    most: dict = defaultdict(int)
    for (a, b), n in count.items():
        most["a", a], most["b", b] = max(most["a", a], n), max(most["b", b], n)
    best = lambda links, side: sum(count[p] == most["ab"[side], p[side]] for p in links)
    return [(i, len(a), len(b), len(g), len(ls), best(ls, 1), sum(count[p] for p in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "", best(ls, 0)) for i, a, b, ls, g in done]
