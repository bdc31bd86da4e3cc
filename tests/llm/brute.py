"""Plain versions of the operators, to hold results against. Documents are (doc_id, text) pairs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from html.parser import HTMLParser

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def op3(docs, k=13):
    low = {}
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    for i, w in words:
        if i is not None:
            for j in range(len(w) - k + 1):
                x = tuple(w[j : j + k])
                low[x] = min(low.get(x, i), i)
    out = []
    for i, w in words:
        gone = set()
        for j in range(len(w) - k + 1):
            m = low.get(tuple(w[j : j + k]))
            if m is not None and (i is None or m < i):
                gone.update(range(j, j + k))
        out.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone).encode())))
    return out


def op6(docs, length=400):
    count = defaultdict(int)
    texts = [(i, (t or "").encode()) for i, t in docs]
    for _, b in texts:
        for j in range(len(b) - length + 1):
            count[hashlib.md5(b[j : j + length]).digest()] += 1
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if count[hashlib.md5(b[j : j + length]).digest()] > 1:
                gone[j : j + length] = b"\1" * length
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def lower_az(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def op7(docs, percent=85, k=4):
    sets = []
    for i, t in docs:
        w = WORD.findall(lower_az(t))
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}))
    up = {n: n for n in range(len(sets))}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    holders = defaultdict(list)
    for n, (i, s) in enumerate(sets):
        if i is not None:
            for x in s:
                holders[x].append(n)
    common = defaultdict(int)
    for held in holders.values():
        for a in held:
            for b in held:
                if a < b:
                    common[a, b] += 1
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a][1]) + len(sets[b][1]) - c):
            up[root(a)] = root(b)
    low = {}
    for n, (i, _) in enumerate(sets):
        if i is not None:
            low[root(n)] = min(low.get(root(n), i), i)
    return [(i, len(s), None if i is None else low[root(n)]) for n, (i, s) in enumerate(sets)]


def op4(docs, encoders, spread=2.25, slack=2, least=32, bins=2048):
    """docs: (doc_id, text, lang) with lang given. encoders: functions from a word to its tokens, each as (id, whole characters).

    Returns kept for each; for languages with enough texts only (no fixed bands).
    """
    import math
    from collections import Counter

    import numpy as np

    rows = []
    for i, t, g in docs:
        w = WORD.findall(t or "")
        found, fewest = [], None
        for encode in encoders:
            tokens = [x for y in w for x in encode(y)]
            n, count = len(tokens), Counter(x for x, _ in tokens)
            entropy = -sum(c / n * math.log2(c / n) for c in count.values())
            found += [sum(map(len, w)) / max(n, 1), sum(not ok for _, ok in tokens) / max(n, 1), entropy / math.log2(min(max(n, 2), encode.size))]
            fewest = n if fewest is None else min(n, fewest)
        windows = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        again = {j + o for j in range(len(w) - 4) if windows[tuple(w[j : j + 5])] > 1 for o in range(5)}
        base = len(w) < 10 or 100 * len(again) > 20 * len(w)
        rows.append((i, t, g, math.floor(math.log2(max(len(w), 1)) * 2 + 0.5), len(w), fewest, found, base))
    out = []
    for i, _, g, length, n_words, fewest, found, base in rows:
        if not n_words:
            out.append((i, False))
            continue
        fine = True
        for m, v in enumerate(found):
            texts = {(t, x): math.floor(f[m] * bins + 0.5) / bins for _, t, h, x, n, _, f, _ in rows if h == g and n}
            slope = -0.05 / 2 if m % 3 == 2 else 0
            levels, near = sorted({x for _, x in texts}), {}
            for x in levels:
                reach = min(r for r in {abs(y - x) for y in levels} if sum(abs(y - x) <= r for _, y in texts) >= least)
                values = sorted(b + slope * (x - y) for (_, y), b in texts.items() if abs(y - x) <= reach)
                near[x] = [values[max(0, math.ceil(q * len(values)) - 1)] for q in (0.25, 0.5, 0.75)]
            usual = float(np.median([(q[2] - q[0]) * min(1, 2 ** ((x - length) / 4)) for x, q in near.items()]))
            q1, q2, q3 = near[length]
            wide, more = max(0.05 * (m % 3 == 1), spread * max(q3 - q1, usual, 0.02 * q2, 2 / bins)), slack / max(fewest, 1) * max(v, 1)
            fine &= q1 - wide <= v + more and v - more <= q3 + wide
        out.append((i, not base and fine))
    return out


def op9(x, y, model, d, ridge, bins):
    """Scores of the rows of x (statistics) from the rows with a label y (others None): one matrix, and isotonic values by their min-max formula."""
    import numpy as np

    known = [i for i, v in enumerate(y) if v is not None]
    mean, deviation = x[known].mean(axis=0), x[known].std(axis=0)
    z = np.clip((x - mean) / np.where(deviation > 1e-9, deviation, 1), -6, 6)
    f = np.hstack([np.sqrt(2 / d) * np.cos(z @ model.w + model.b), np.ones((len(x), 1))])
    t, a = np.array([y[i] for i in known], float), f[known]
    penalty = np.diag([ridge * len(known)] * d + [0.0]) + 1e-9 * np.eye(d + 1)
    raw = np.clip(f @ np.linalg.solve(a.T @ a + penalty, a.T @ t), -1, 2)
    groups = defaultdict(list)
    for i, v in zip(known, t, strict=True):
        groups[np.floor((raw[i] + 1) / 3 * bins + 0.5)].append((raw[i], v))
    at = [np.mean([p for p, _ in groups[k]]) for k in sorted(groups)]
    mean_y, n = [np.mean([v for _, v in groups[k]]) for k in sorted(groups)], [len(groups[k]) for k in sorted(groups)]
    avg = lambda j, k: np.average(mean_y[j : k + 1], weights=n[j : k + 1])
    fit = [max(min(avg(j, k) for k in range(i, len(n))) for j in range(i + 1)) for i in range(len(n))]
    blocks = defaultdict(list)
    for p, v, c in zip(at, fit, n, strict=True):
        blocks[round(v, 12)].append((p, v, c))
    xs = [np.average([p for p, _, _ in b], weights=[c for _, _, c in b]) for b in blocks.values()]
    return np.interp(raw, xs, [b[0][1] for b in blocks.values()]) * 0.998 + (raw + 1) / 3 * 0.002


class Article(HTMLParser):
    """Blocks of text inside <article> elements, with the tag that holds each, by the standard library's parser."""

    APART = "nav footer aside form script style noscript template dialog menu button select textarea title".split()
    BLOCKS = "article section div p h1 h2 h3 h4 h5 h6 ul ol li table tr td blockquote pre header main body figure".split() + APART

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.inside = self.apart = 0
        self.buffer, self.open, self.blocks = [], ["body"], []
        self.feed(html)
        self.close()
        self.flush()

    def flush(self):
        text = " ".join("".join(self.buffer).split())
        self.buffer = []
        if text:
            self.blocks.append((self.open[-1], text))

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.buffer.append(" ")
        if tag in self.BLOCKS:
            self.flush()
            self.inside += tag == "article"
            self.apart += tag in self.APART
            if tag != "p" or self.open[-1] != "p":
                self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.flush()
            self.inside -= tag == "article"
            self.apart -= tag in self.APART
            if tag in self.open:
                while self.open.pop() != tag:
                    pass
            self.open = self.open or ["body"]

    def handle_data(self, data):
        if self.inside and not self.apart:
            self.buffer.append(data)


def op2(pages, host_of, share=0.8, least=3):
    """(page_id, text) of pages whose text is all in <article>: without blocks that a host's different pages repeat."""
    found = [(i, host_of(u), Article(h or "").blocks) for i, u, h in pages]
    seen, every = defaultdict(set), defaultdict(set)
    for _, host, blocks in found:
        if blocks:
            longest = max((t for tag, t in blocks if tag[0] != "h" or tag == "header"), key=lambda t: (len(t), t), default="")
            every[host].add(longest)
            for b in set(blocks):
                seen[host, b].add(longest)
    gone = {k for k, pages_ in seen.items() if k[1][0] not in ("h1", "h2", "h3", "h4", "h5", "h6") and len(pages_) >= least and len(pages_) >= share * len(every[k[0]])}
    return [(i, "\n".join(t for tag, t in blocks if (host, (tag, t)) not in gone)) for i, host, blocks in found]
