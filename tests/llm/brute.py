"""Row-by-row definitions of what the operators compute, for small tables."""

from __future__ import annotations

import bisect
import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text):
    return WORD.findall(text or "")


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    places = collections.defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i : i + 8])].append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [line for line in text.split("\n") if words(line)]
    return (
        len(w),
        sum(map(len, w)),
        sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(covered),
    )


def line_key(line):
    return line.strip(SPACES).translate(LOWER)


def lines_left(rows, min_chars=20, min_docs=3):
    """The lines that each of ``rows`` (id, text) keeps; a null id is below all others."""
    holders = collections.defaultdict(list)
    for i, text in rows:
        for key in {line_key(x) for x in (text or "").split("\n")}:
            holders[key].append(-math.inf if i is None else i)
    out = []
    for i, text in rows:
        own = -math.inf if i is None else i
        out.append(
            [
                x
                for x in (text or "").split("\n")
                if not (
                    len(k := line_key(x)) >= min_chars
                    and len(holders[k]) >= min_docs
                    and (i is None or max(holders[k]) != own)
                )
            ]
        )
    return out


def shingles(text, size=5):
    w = words((text or "").translate(LOWER))
    if len(w) >= size:
        return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def near_groups(rows, percent=75):
    """Smallest id that links lead to, by position in ``rows`` (id, text)."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            same_id = rows[a][0] is not None and rows[a][0] == rows[b][0]
            linked = both and 100 * both >= percent * len(sets[a] | sets[b])
            if linked or same_id:
                group[root(a)] = root(b)
    first = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            first[root(i)] = min(doc, first.get(root(i), doc))
    return [first.get(root(i)) for i in range(len(rows))], [len(s) for s in sets]


def repeats_removed(texts, window):
    """Kept words of each text, and how many went."""
    lists = [words(t) for t in texts]
    seen = collections.Counter(
        tuple(w[i : i + window]) for w in lists for i in range(len(w) - window + 1)
    )
    out = []
    for w in lists:
        gone = {
            i + k
            for i in range(len(w) - window + 1)
            if seen[tuple(w[i : i + window])] > 1
            for k in range(window)
        }
        out.append((" ".join(x for i, x in enumerate(w) if i not in gone), len(gone)))
    return out


def filled(sizes, weights, total, cap):
    """Targets by sharing again and again what is above the cap."""
    stopped = set()
    while True:
        open_ = [s for s in sizes if s not in stopped]
        if not open_:
            return {s: cap * sizes[s] for s in sizes}
        rest = total - sum(cap * sizes[s] for s in stopped)
        share = {s: rest * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return share | {s: float(cap * sizes[s]) for s in stopped}
        stopped |= over


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n // 10 + n % 10
    return total % 10 == 0


KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def base_spans(text):
    found = []
    for order, (kind, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = (
                kind == "email"
                or (kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")))
                or (kind == "card" and 12 <= len(digits) <= 19 and luhn(digits))
                or (kind == "phone" and 9 <= len(digits) <= 15)
            )
            if good:
                found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(found)]


class PairModel:
    """Interpolated modified Kneser-Ney over word pairs, straight from its definition."""

    def __init__(self, texts):
        lists = [[*words((t or "").translate(LOWER)), None] for t in texts]
        self.count = collections.Counter(w for x in lists for w in x)
        self.n, self.v = sum(self.count.values()), len(self.count)
        self.pairs = collections.Counter(p for x in lists for p in zip(["<s> "] + x, x))
        self.before = collections.Counter(w for _, w in self.pairs)
        self.pair_d, self.word_d = self._discounts(self.pairs), self._discounts(self.before)
        self.total, self.back = collections.Counter(), collections.Counter()
        for (v, _), k in self.pairs.items():
            self.total[v] += k
            self.back[v] += self.pair_d[min(k, 3)]

    @staticmethod
    def _discounts(counts):
        n = collections.Counter(counts.values())
        if all(n[k] for k in (1, 2, 3, 4)):
            y = n[1] / (n[1] + 2 * n[2])
            d = [0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
            if all(0 < d[k] <= k for k in (1, 2, 3)):
                return d
        return [0, 0.5, 1.0, 1.5]

    def word(self, w):
        if not self.pairs:
            return 1 / (self.v + 1)
        k, types = self.before[w], len(self.pairs)
        back = sum(self.word_d[min(k, 3)] for k in self.before.values()) / types
        return max(k - self.word_d[min(k, 3)], 0) / types + back / (self.v + 1)

    def pair(self, v, w):
        if not self.total[v]:
            return self.word(w)
        k = self.pairs[v, w]
        own = max(k - self.pair_d[min(k, 3)], 0)
        return (own + self.back[v] * self.word(w)) / self.total[v]

    def scores(self, text):
        x = [*words((text or "").translate(LOWER)), None]
        base = sum(math.log10((self.count[w] + 1) / (self.n + self.v + 1)) for w in x)
        score = sum(math.log10(self.pair(v, w)) for v, w in zip(["<s> "] + x, x))
        return len(x), sum(self.count[w] > 0 for w in x), base, score


def crc_of_ids(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def alignment(texts, byte_path, piece_path):
    """Counts, links by pair and listing of each text, from tokens of whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    byte = Tokenizer.from_file(byte_path)
    byte.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in shown]
    letters = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(hidden)}
    piece = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    held, rows = [], []
    for text in texts:
        links, listing, n = collections.Counter(), [], [0, 0, 0, 0]
        whole = (" " + (text or "")).encode()
        a = byte.encode(" " + (text or ""), add_special_tokens=False)
        a = [(i, bytes(letters[c] for c in t)) for i, t in zip(a.ids, a.tokens, strict=True)]
        b = []
        for i in piece.encode(text or ""):
            name = piece.id_to_piece(i)
            b.append((i, bytes([int(name[3:5], 16)]) if piece.is_byte(i) else name.replace("▁", " ").encode()))
        if text and b"".join(t for _, t in a) == whole == b"".join(t for _, t in b):
            sides = []
            for tokens in (a, b):
                at, ends = 0, []
                for i, t in tokens:
                    at += len(t)
                    ends.append((at, i))
                sides.append(ends)
            common = sorted({e for e, _ in sides[0]} & {e for e, _ in sides[1]})
            start = 0
            for stop in common:
                left, right = (
                    [
                        i
                        for _, i in side[
                            bisect.bisect(side, (start, 1 << 40)) : bisect.bisect(side, (stop, 1 << 40))
                        ]
                    ]
                    for side in sides
                )
                listing.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
                for x in left:
                    for y in right:
                        links[x, y] += 1
                start = stop
            n = [len(a), len(b), len(common), sum(links.values())]
        held.append(links)
        rows.append((n, hashlib.sha256(";".join(listing).encode()).hexdigest() if listing else ""))
    counts = collections.Counter(p for links in held for p in links)
    most = collections.Counter()
    for (x, _), c in counts.items():
        most[x] = max(most[x], c)
    return [
        (
            *n,
            sum(k for p, k in links.items() if counts[p] == most[p[0]]),
            sum(k * counts[p] for p, k in links.items()),
            digest,
        )
        for links, (n, digest) in zip(held, rows, strict=True)
    ]
