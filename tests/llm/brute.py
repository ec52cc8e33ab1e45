"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(value):
    return hashlib.sha256(value if isinstance(value, bytes) else value.encode()).hexdigest()


def remainder(doc_id, divisor):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % divisor


def words(text, fold=True):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if fold else text)


def shingles(text, size=5):
    w = words(text)
    if 0 < len(w) < size:
        return {tuple(w)}
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def jaccard(rows):
    """[(doc_id, text)] to {row number: (n_shingles, component_id)}."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    seen = set()
    for some in holders.values():
        for a in some:
            for b in some:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                        root[find(b)] = find(a)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def repeats(rows, length=100):
    """[(doc_id, text)] with unique ids to [(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)]."""
    first = {}
    out = []
    for doc_id, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            piece = data[i : i + length]
            if piece in first:
                gone[i : i + length] = b"\x01" * length
            else:
                first[piece] = doc_id
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((doc_id, len(data), sum(gone), spans, sha(kept), kept))
    return out


def contaminated(rows, items):
    wins = defaultdict(set)
    for item_id, text in items:
        w = ITEM_WORD.findall((text or "").translate(LOWER))
        if w:
            m = min(10, len(w))
            for i in range(len(w) - m + 1):
                wins[tuple(w[i : i + m])].add(item_id)
    sizes = {len(x) for x in wins}
    out = []
    for doc_id, text in rows:
        w = ITEM_WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                key = tuple(w[i : i + m])
                if key in wins:
                    hit.update(range(i, i + m))
                    found |= wins[key]
        listed = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(w), len(hit), len(listed), sha(",".join(listed)), bool(hit)))
    return out


def quality(text):
    text = text or ""
    w = words(text, fold=False)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    wins = defaultdict(list)
    for i in range(len(w) - 7):
        wins[tuple(w[i : i + 8])].append(i)
    covered = {j for at in wins.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
        len(w) < 20 or 100 * len(covered) > 30 * len(w),
    )


def bpe(rows, path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    out = []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        out.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    return out


def _md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def mixed(rows, weights=(3, 1, 2), share=1.5, most=2, seed=17):
    """[(doc_id, source, text)] to [(doc_id, size, source_size, target, taken)]; clamps one source after the other."""
    sizes = [len(words(t)) for _, _, t in rows]
    names = sorted({s for _, s, _ in rows if s is not None}) + ([None] if any(s is None for _, s, _ in rows) else [])
    total = {n: sum(z for z, (_, s, _) in zip(sizes, rows) if s == n) for n in names}
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, free = {}, set(names)
    while free:
        left = share * sum(total.values()) - sum(target.values())
        part = {n: weight[n] * left / sum(weight[m] for m in free) for n in free}
        above = {n for n in free if part[n] > most * total[n]}
        if not above:
            target.update(part)
            break
        target.update({n: float(most * total[n]) for n in above})
        free -= above
    out = []
    for name in names:
        goal = int(target[name] + 0.5)
        whole = goal // total[name] if total[name] else 0
        rest = goal - whole * total[name]
        own = [(d, z) for z, (d, s, _) in zip(sizes, rows) if s == name]
        for d, z in sorted(own, key=lambda x: (_md5(f"{seed}:{'' if x[0] is None else x[0]}"), x[0] is not None, x[0] or 0, x[1])):
            part = min(z, rest)
            rest -= part
            out.append((d, z, total[name], target[name], whole * z + part))
    return out


def audited(rows, labels):
    """[(doc_id, lang, text)], [(doc_id, quality, toxic)] to the rows of the report, one order after the other."""
    from itertools import permutations

    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    docs = []
    for d, lang, text in rows:
        text = text or ""
        w = words(text, fold=False)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": d is not None and any(o is not None and o < d and (t or "") == text for o, _, t in rows),
        }
        docs.append((lang or "", fails, d is not None and d in good, d is not None and d in toxic))
    out, removed = [], defaultdict(int)
    for part in {p for p, *_ in docs}:
        own = [x[1:] for x in docs if x[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[0][f]]
                left = [x for x in left if not x[0][f]]
                fails = sum(x[0][f] for x in own)
                alone = sum(x[0][f] and sum(x[0].values()) == 1 for x in own)
                removed[part, f] += len(gone)
                out.append((part, order, step, len(left), len(gone), fails - len(gone), alone, sum(x[1] for x in gone), sum(x[2] for x in gone)))
    return [(*r, removed[r[0], r[1][r[2] - 1]]) for r in out]


def _levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def _fold(levels, pos, digest):
    proof = ""
    for level in levels[:-1]:
        first = pos - pos % 3
        run = level[first : first + 3]
        proof += "".join(run[: pos - first] + run[pos - first + 1 :])
        digest = sha("".join([*run[: pos - first], digest, *run[pos - first + 1 :]]))
        pos //= 3
    return digest, proof


def merkle(rows):
    """[(doc_id, source, lang, n_chars, text)] to the rows of the proof report."""

    def leaf(*fields):
        texts = [None if f is None else str(f) for f in fields]
        return sha("".join("-" if t is None else f"{len(t.encode())}:{t}" for t in texts))

    groups = defaultdict(list)
    for row in rows:
        d, source, lang, n, text = row
        shown = leaf(d, source, lang, n, text and text.replace("\n", "")) if remainder(d, 2) == 0 else leaf(*row)
        groups[source].append((d is not None, d or 0, leaf(*row), shown, d))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _levels([x[2] for x in sorted(groups[s])]) for s in names}
    top = _levels([trees[s][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for pos, (_, _, own, shown, d) in enumerate(sorted(groups[s])):
            node, proof = _fold(trees[s], pos, shown)
            node, more = _fold(top, at, node)
            out.append((d, own, trees[s][-1][0], top[-1][0], sha(proof + more), node, node == top[-1][0]))
    return out
