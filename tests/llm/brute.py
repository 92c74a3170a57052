"""Plain versions of the operators, row by row and pair by pair."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def components(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    inside = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 8)}
    n = len(words)
    base = (
        n,
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(inside),
    )
    return (*base, n < 20 or 100 * len(inside) > 30 * n)


SECRETS = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)


def secrets(text):
    found = [
        (m.start(), k, m.end(), name)
        for k, (name, pattern, group, least) in enumerate(SECRETS)
        for m in pattern.finditer(text or "")
        if len(m[group]) >= least
    ]
    counts = Counter(f[3] for f in found)
    spans = [f"{name}:{a}:{b}" for a, _, b, name in sorted(found)]
    return counts["assign"], counts["access"], counts["hex"], sha(",".join(spans)), spans


def warc(pages):
    first = {}
    for i, html in pages:
        data = (html or "").encode()
        first[data] = min(first.get(data, i), i)
    rows = []
    for i, html in pages:
        data = (html or "").encode()
        again = len(data) >= 100 and first[data] != i
        rows.append((i, len(data), sha(data), "revisit" if again else "response", first[data] if again else None))
    return rows


def vectors(rows, least=0.95):
    sound = {i: np.array(v, float) for i, v in rows if v is not None and None not in list(v) and len(v)}
    sound = {i: v for i, v in sound.items() if np.isfinite(v).all() and v.any()}
    unit = {i: v / np.linalg.norm(v) for i, v in sound.items()}
    links = [
        (a, b)
        for a, b in itertools.combinations(unit, 2)
        if len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= least
    ]
    degree = Counter(itertools.chain.from_iterable(links))
    of = components([i for i, _ in rows], links)
    return [(i, degree[i], of[i], of[i] == i) for i, _ in rows]


def shingles(text):
    words = WORD.findall((text or "").translate(CAPITALS))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def documents(rows):
    """All pairs that share a shingle, compared on whole sets."""
    sets = {i: shingles(t) for i, t in rows}
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    common = Counter()
    for ids in by.values():
        common.update(itertools.combinations(sorted(ids), 2))
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    of = components(sets, links)
    return [(i, len(sets[i]), of[i], of[i] == i) for i, _ in rows]


def substrings(rows, width=50):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = {j for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < i for j in range(k, k + width)}
        out.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def line_rows(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(CAPITALS)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def token_digests(text, tokenizer):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    decoded = tokenizer.decode(ids, skip_special_tokens=False)
    return len(ids), sha(np.array(ids, "<u4").tobytes()), sha(decoded)


def check_pieces(rows, pieces, tokenizer, window=2048):
    """Whether pieces (doc, start, length, crc, tokens, sequence, offset) cover every document and window once."""
    of_doc, of_window = defaultdict(list), defaultdict(list)
    for doc, start, length, crc, total, sequence, offset in pieces:
        of_doc[doc].append((start, length, crc, total))
        of_window[sequence].append((offset, length))
    texts = dict(rows)
    assert set(of_doc) == set(texts)
    for doc, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for start, length, crc, total in sorted(of_doc[doc]):
            assert start == at and length > 0 and total == len(ids)
            assert crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    padding = 0
    for parts in of_window.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def _field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def _levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def _path(levels, i):
    steps = []
    for nodes in levels[:-1]:
        a = i - i % 3
        steps.append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + 3])))
        i //= 3
    return steps


def merkle(rows):
    """Rows (doc_id, source, lang, n_chars, text)."""
    leaf = lambda r, text: sha("".join(map(_field, (*r[:4], text))))
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    groups = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: _levels([x[2] for x in sorted(by[g], key=lambda x: x[:3])]) for g in groups}
    top = _levels([trees[g][-1][0] for g in groups])
    out = []
    for k, g in enumerate(groups):
        for i, (*_, own, r) in enumerate(sorted(by[g], key=lambda x: x[:3])):
            steps = _path(trees[g], i) + _path(top, k)
            at = own
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                at = leaf(r, r[4].replace("\n", ""))
            for before, after in steps:
                at = sha(before + at + after)
            proof = sha("".join(b + a for b, a in steps))
            out.append((r[0], own, trees[g][-1][0], top[-1][0], proof, at, at == top[-1][0]))
    return out


RUN = re.compile("[A-Za-z\u00c0-\u00ff]+")


def spelling_words(rows, min_chars=6, min_count=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(CAPITALS)
            h = 1 if doc_id is None else zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}


def spelling(words):
    """Rows (word, form, root, n, n_near, form_n) from all edits of every word."""
    letters = {c for w in words for c in w}

    def near(w):
        cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        made = {a + b[1:] for a, b in cuts if b}
        made |= {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}
        return (made - {w}) & words.keys()

    beside = {w: near(w) for w in words}
    form = {}
    for w, found in beside.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def last(w):
        while form[w] is not None:
            w = form[w]
        return w

    return [(w, form[w], last(w), words[w], len(beside[w]), words.get(form[w])) for w in words]


class SuffixTree:
    """The suffix tree of token lists, with a dictionary for everything."""

    def __init__(self, texts, depth=2, min_count=16, min_state=64, cost=4.0):
        self.depth = depth
        counts = defaultdict(Counter)
        for tokens in texts:
            for i, w in enumerate(tokens):
                for n in range(min(i, depth) + 1):
                    counts[tuple(tokens[i - n : i])][w] += 1
        self.words = counts[()]
        self.n, self.v = sum(self.words.values()), len(self.words)
        self.states = {}
        for s in sorted((s for s in counts if s), key=len):
            total = sum(counts[s].values())
            # a context is looked at if all its beginnings were, as pairs seen often enough
            begins = all(counts[s[:i]][s[i]] >= (min_state if i else 0) for i in range(len(s)))
            own = {w: c for w, c in counts[s].items() if c >= min_count}
            if total < min_state or not begins or not own:
                continue
            rest = total + 1 - sum(own.values())
            p = {w: np.log(self.predicts(s[1:], w)) for w in own}
            q = {w: np.log((c + rest * np.exp(p[w])) / (total + 1)) for w, c in own.items()}
            back = np.log(rest / (total + 1))
            if sum(c * (q[w] - p[w]) for w, c in own.items()) + (total - sum(own.values())) * back > cost * len(own):
                self.states[s] = (total, rest, own)

    def base(self, w):
        return (self.words[w] + 1) / (self.n + self.v + 1)

    def predicts(self, context, w):
        while context and context not in self.states:
            context = context[1:]
        if not context:
            return self.base(w)
        total, rest, own = self.states[context]
        return (own.get(w, 0) + rest * self.predicts(context[1:], w)) / (total + 1)

    def score(self, tokens):
        known = sum(self.words[w] > 0 for w in tokens)
        base = sum(np.log10(self.base(w)) for w in tokens)
        whole = sum(np.log10(self.predicts(tuple(tokens[max(i - self.depth, 0) : i]), w)) for i, w in enumerate(tokens))
        return len(tokens), known, self.n, base, whole


def lm_tokens(text):
    return [*WORD.findall((text or "").translate(CAPITALS)), " "]
