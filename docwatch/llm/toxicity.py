"""Toxicity: a support vector machine on a gapped-subsequence string kernel, with Nyström landmarks.

The kernel of two pieces of text weighs every common subsequence of ORDER letters by
DECAY**(length spanned in both), normalised to 1 for equal pieces: letters put into an insult lower the weight instead of ending
the match. It is taken as 0 where a piece holds less than SHARE of a landmark's letters.

Landmarks are of two kinds. Words: the pieces most over-represented in sentences of toxic documents, and a few common harmless ones.
Heads: beginnings of words of 4 to 7 letters, because in inflected and compounding languages an insult is a stem with many endings and no
one form of it is frequent. Heads are picked one after the other, each the one whose rate singles out most toxic documents that no landmark
before it did, so no language's insults have to compete with those of a larger language. Letters decide, not language or lists.

Training (on a bounded, documented sample of labelled rows, in one task): a sentence's
features are, per word landmark, the largest kernel value of its pieces, mapped by the inverse
root of the landmarks' own kernel matrix (Nyström). A linear SVM with squared hinge loss is fitted to
labelled sentences: of a toxic document those that hold a piece like a landmark, of the others all; then refitted with those, too, that
score above the margin. A second linear SVM judges the document: by the margin of its highest sentence, and by the mean over all its words of
their kernel with each head landmark (a kernel mean, mapped by Nyström like the sentences), because a stem that clean texts hold now and then, too, is evidence by its rate.
A logistic fit makes its margin a probability.

Scoring: one pass over the whole texts, no shuffle. Kernel values are computed for words that hold the different letters of a landmark (all others have 0 by SHARE); a worker remembers them.

Null and empty texts have no piece and get the score of a text without evidence. Repeated rows get the same score each; in training, equal
hashes of ids are ordered by id and by the text's hash. Through words longer than twice a landmark
slide windows of 1.5 times its length, by a quarter of its length, so all of a long word is seen by each landmark; a letter
written three times or more counts as once and as twice, too. Pieces across white space are letters spelled out one by one and up to PARTS
neighbouring tokens of a sentence that hold a landmark whole in 1.5 times its length at most. Labels, language, source and id are never inputs.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docwatch.llm.common import fresh
from docwatch.llm.shingles import slices

ORDER, DECAY, SHARE, LONGEST, STEP = 3, 0.7, 0.9, 18, 9
#: Labelled rows of each class that training uses at most, by order of a hash of the id.
SAMPLE = 1500
#: Longer texts aren't drawn for training, which bounds the sample in bytes; they are scored whole.
TRAINED_LENGTH = 64_000
LANDMARKS, HARMLESS, HEADS = 24, 4, 24
HEAD_LENGTHS = range(4, 8)
#: Words that a document's rates are smoothed by, the rate that counts as full evidence, and the least kernel value of a head that resembles a landmark.
SMOOTH, FULL, ALIKE = 60, 0.02, 0.6
#: Weight of harmless sentences against toxic ones: a near miss of a common word is no insult.
CAUTION = 2.0
#: Kernel values up to this are no evidence.
LEAST = 0.4
#: Neighbouring tokens that are joined at most.
PARTS = 6
#: Distinct words a worker remembers.
REMEMBERED = 300_000
#: Digits and signs written for letters.
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")
#: Both begin with a set of few characters, which the search skips to: [.!?\n]+ before white space or the end, or one \n; and letters spelled out after white space.
_SENTENCE = re.compile(r"[.!?\n](?:[.!?\n]*(?=\s|$)|(?<=\n))")
_SPELLED = re.compile(r"\s(\w(?:[^\w\n]{1,5}\w){2,})(?!\w)")
_RUN = re.compile(r"(.)\1{2,}")


def normal(token: str) -> str:
    """A token's letters, lower-cased, look-alikes undone."""
    if token.isalpha():
        return token
    inner = token.strip(".,;:!?\"'()[]")
    return inner if inner.isalpha() else "".join(filter(str.isalpha, inner.translate(LOOKALIKES)))


def windows(piece: str) -> list[str]:
    if len(piece) <= LONGEST:
        return [piece] if len(piece) >= ORDER else []
    return [piece[i : i + LONGEST] for i in range(0, len(piece) - LONGEST + STEP, STEP)]


def _codes(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the pieces in rows, 0 after the end; and their lengths."""
    lengths = np.array([len(p) for p in pieces])
    wide = max(1, int(lengths.max(initial=1)))
    return np.frombuffer("".join(p.ljust(wide, "\0") for p in pieces).encode("utf-32-le"), np.uint32).reshape(len(pieces), wide), lengths


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gap-weighted kernel of row i of `a` with row i of `b` (codes, 0 after the end), not normalised."""
    n, la, lb = len(a), a.shape[1], b.shape[1]
    same = (a[:, :, None] == b[:, None, :]) & (a[:, :, None] > 0)
    inner = np.ones((n, la + 1, lb + 1), np.float32)
    for k in range(ORDER):
        hit = np.where(same, inner[:, :la, :lb], 0) * np.float32(DECAY**2)
        if k == ORDER - 1:
            return hit.sum((1, 2))
        nxt = np.zeros_like(inner)
        for i in range(la):  # spans grow by one letter of `a` at a time, then by letters of `b`
            row = np.zeros((n, lb + 1), np.float32)
            for j in range(lb):
                row[:, j + 1] = DECAY * row[:, j] + hit[:, i, j]
            nxt[:, i + 1] = DECAY * nxt[:, i] + row
        inner = nxt
    raise ValueError("ORDER must be positive")


class Landmarks:
    """The landmark pieces, with their letters and kernel norms."""

    def __init__(self, pieces: list[str], marked: int):
        self.pieces, self.marked = pieces, marked  # the first `marked` are insults
        self.codes, self.lengths = _codes(pieces)
        self.norm = kernel(self.codes, self.codes)
        self.letters = np.array(sorted({ord(c) for p in pieces for c in p}), np.uint32)
        self.bag = self._bag(self.codes)
        # of more than 64 letters those after the 63rd share a bit, which lets more pieces pass and loses none
        self.bits = np.uint64(1) << np.minimum(np.arange(self.letters.size), 63).astype(np.uint64)
        self.sets = self._set(self.codes)
        self.spare = np.floor((1 - SHARE) * self.lengths + 1e-6)  # letters of each landmark that a piece may lack

    def _set(self, codes: np.ndarray) -> np.ndarray:
        """The set of the landmarks' letters in each row, as bits."""
        at = np.minimum(np.searchsorted(self.letters, codes), self.letters.size - 1)
        return np.bitwise_or.reduce(np.where(self.letters[at] == codes, self.bits[at], np.uint64(0)), 1)

    def _possible(self, codes: np.ndarray) -> np.ndarray:
        """For each row, whether it lacks no more different letters of each landmark than a piece like it may: all others have kernel 0."""
        return np.bitwise_count(self.sets & ~self._set(codes)[:, None]) <= self.spare

    def possible(self, words: list[str], most: int = 0) -> list[str]:
        """Those of `words` (of their first `most` letters, if given) that hold enough different letters of a landmark for a kernel value above 0."""
        out = []
        order = sorted(words, key=len)
        lo = 0
        while lo < len(order):  # blocks of words of about one length, bounded in letters
            hi = min(lo + 4000, len(order))
            while hi - lo > 1 and (hi - lo) * len(order[hi - 1]) > 200_000:
                hi = lo + (hi - lo) // 2
            some = order[lo:hi]
            codes, _ = _codes([w[:most] for w in some] if most else some)
            out += [some[i] for i in np.flatnonzero(self._possible(codes).any(1))]
            lo = hi
        return out

    def pieces_of(self, words: list[str]) -> dict[str, set[str]]:
        """The pieces in which each word's letters are looked at."""
        out = {w: set(windows(w)) for w in words}
        forms = [(w, w) for w in words]
        for w in words:
            if _RUN.search(w):
                for form in (_RUN.sub(r"\1", w), _RUN.sub(r"\1\1", w)):
                    forms.append((w, form))
                    out[w].update(windows(form))
        short = 2 * int(self.lengths[: self.marked].min(initial=LONGEST))
        forms = sorted((f for f in forms if len(f[1]) > short), key=lambda f: len(f[1]))
        lo = 0
        while lo < len(forms):  # blocks of words of about one length, bounded in letters
            hi = lo + 1
            while hi < len(forms) and len(forms[hi][1]) * (hi + 1 - lo) <= 200_000 and len(forms[hi][1]) <= 2 * len(forms[lo][1]):
                hi += 1
            self._slide([f[1] for f in forms[lo:hi]], [out[f[0]] for f in forms[lo:hi]])
            lo = hi
        return out

    def _slide(self, words: list[str], out: list[set[str]]) -> None:
        """Add to `out` the windows of `words`, sized to each insult, that hold enough of its letters."""
        codes, lengths = _codes(words)
        counts = {c: np.pad(np.cumsum(codes == c, 1, dtype=np.int32), ((0, 0), (1, 0))) for c in self.letters.tolist()}
        has = np.stack([counts[c][:, -1] for c in self.letters.tolist()], 1)
        for i in range(self.marked):
            size = int(self.lengths[i])
            need = self.bag[i]
            least = int(np.ceil(SHARE * size))
            some = np.nonzero((lengths > 2 * size) & (np.minimum(has, need).sum(1) >= least))[0]
            if not some.size:
                continue
            wide = size + size // 2
            last = lengths[some] - wide
            step = max(1, size // 4)
            at = np.minimum(np.arange(0, int(last.max()) + step, step)[None, :], last[:, None])
            rows = some[:, None]
            shared = np.zeros(at.shape, np.int32)
            for c, n in zip(self.letters.tolist(), need.tolist()):
                if n:
                    shared += np.minimum(counts[c][rows, at + wide] - counts[c][rows, at], n)
            for r, k in zip(*np.nonzero(shared >= least)):
                w = some[r]
                out[w].add(words[w][at[r, k] : at[r, k] + wide])

    def joined(self, sentences: list[list[str]]) -> list[set[str]]:
        """For each sentence (a list of words) its neighbouring words that together, but not alone, hold a landmark.

        The breaks are the gaps: with other letters between, too, "more on" would be "moron".
        """
        out: list[set[str]] = [set() for _ in sentences]
        flat = list(chain.from_iterable((*of, "\n") for of in sentences))
        letters = "".join(flat)
        starts = list(accumulate(map(len, flat), initial=0))
        ends = list(accumulate(len(of) + 1 for of in sentences))
        for piece in self.pieces[: self.marked]:
            at = letters.find(piece)
            while at >= 0:
                i, j = bisect_right(starts, at) - 1, bisect_left(starts, at + len(piece))
                if 1 < j - i <= PARTS and starts[j] - starts[i] <= 1.5 * len(piece):
                    out[bisect_right(ends, i)].add("".join(flat[i:j]))
                at = letters.find(piece, at + 1)
        return out

    def _bag(self, codes: np.ndarray) -> np.ndarray:
        """How often each of the landmarks' letters is in each row."""
        return np.stack([np.count_nonzero(codes == c, 1) for c in self.letters], 1).astype(np.int8)

    def values(self, pieces: list[str]) -> np.ndarray:
        """Normalised kernel of each piece with each landmark."""
        out = np.zeros((len(pieces), len(self.pieces)), np.float32)
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))  # pieces of one length together
        for lo in range(0, len(pieces), 4000):
            own = np.array(order[lo : lo + 4000])
            codes, sizes = _codes([pieces[i] for i in own])
            # a piece three times as long as the landmark isn't that word with gaps
            at, which = np.nonzero(self._possible(codes) & (sizes[:, None] <= 3 * self.lengths))
            some, back = np.unique(at, return_inverse=True)
            enough = np.minimum(self._bag(codes[some])[back], self.bag[which]).sum(1) >= SHARE * self.lengths[which]
            at, which = at[enough], which[enough]
            for k in range(0, at.size, 4000):
                x, y = at[k : k + 4000], which[k : k + 4000]
                some, back = np.unique(x, return_inverse=True)
                wide = int(sizes[some].max())
                rows = codes[some, :wide]
                norms = kernel(rows, rows)[back] * self.norm[y]
                out[own[x], y] = kernel(rows[back], self.codes[y, : self.lengths[y].max()]) / np.sqrt(np.maximum(norms, 1e-12))
        return out


def _root(marks: Landmarks) -> np.ndarray:
    """Inverse root of the landmarks' own kernel matrix: the Nyström map."""
    k = marks.values(marks.pieces).astype(float)
    value, vector = np.linalg.eigh((k + k.T) / 2 + 1e-3 * np.eye(len(k)))
    return vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-6))) @ vector.T


class Model:
    """Landmarks, Nyström maps, SVM weights and logistic fit; small (its size is bounded by LANDMARKS and HEADS), sent with the tasks."""

    def __init__(self, marks: Landmarks, heads: Landmarks):
        self.marks, self.heads = marks, heads
        self.root, self.head_root = _root(marks), _root(heads)
        self.head_sizes = sorted(set(heads.lengths.tolist()))
        self.w, self.b, self.slope, self.base = np.zeros(len(marks.pieces)), 0.0, 1.0, 0.0
        self.doc_w, self.doc_b = np.append(1.0, np.zeros(len(heads.pieces))), 0.0

    def margins(self, features: np.ndarray) -> np.ndarray:
        return features @ self.root @ self.w + self.b

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def look_up(self, words: set[str]) -> dict[str, np.ndarray]:
        """Kernel values of those words that resemble a word landmark; remembered."""
        seen, near = self.__dict__.setdefault("_known", (set(), {}))
        if len(seen) + len(words) > REMEMBERED:
            seen.clear(), near.clear()
        new = words - seen
        seen |= new
        if some := self.marks.possible(list(new)):
            parts = [(w, p) for w, of in self.marks.pieces_of(some).items() for p in of]
            distinct = list(dict.fromkeys(p for _, p in parts))
            values = self.marks.values(distinct) if distinct else np.zeros((0, 1))
            strong = {distinct[i]: i for i in np.nonzero(values.max(1) > LEAST)[0]}
            for w, p in parts:
                if p in strong:
                    v = values[strong[p]]
                    near[w] = np.maximum(near[w], v) if w in near else v
        return {w: near[w] for w in near.keys() & words}

    def look_up_heads(self, words: set[str]) -> dict[str, np.ndarray]:
        """Of those words whose beginning resembles a head landmark, by how much for each: 0 at ALIKE, 1 for the same letters; remembered."""
        seen, alike = self.__dict__.setdefault("_alike", (set(), {}))
        if len(seen) + len(words) > REMEMBERED:
            seen.clear(), alike.clear()
        new = words - seen
        seen |= new
        some = self.heads.possible(list(new), max(self.head_sizes, default=0) + 2)
        parts = [(w, w[:n]) for n in {k + m for k in self.head_sizes for m in (0, 2)} for w in some if len(w) >= n]
        parts += [(w, w) for n in self.head_sizes for w in some if n <= len(w) <= n + 1]
        distinct = list({p for _, p in parts})
        values = np.maximum(self.heads.values(distinct) - ALIKE, 0) / (1 - ALIKE) if distinct else np.zeros((0, 1))
        strong = {distinct[i]: i for i in np.nonzero(values.max(1) > 0)[0]}
        for w, p in parts:
            if p in strong:
                v = values[strong[p]]
                alike[w] = np.maximum(alike[w], v) if w in alike else v
        return {w: alike[w] for w in alike.keys() & words}

    def evidence(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the features of its sentences that hold any evidence, and the smoothed rates of its head landmarks."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for lo, hi in slices(texts, 1 << 20):  # pieces are looked up for all texts of a slice at once
            lowered = [t.lower() for t in texts[lo:hi]]
            split = [_SENTENCE.split(t) for t in lowered]
            tokens = [[s.split() for s in text] for text in split]
            letters = {t: normal(t) for t in set().union(*chain.from_iterable(tokens))}
            words = [[list(filter(None, map(letters.__getitem__, s))) for s in text] for text in tokens]
            joined = iter(self.marks.joined([s for text in words for s in text]))
            across = [[next(joined) for _ in text] for text in words]
            spelled = [{m: normal("".join(c for c in m if c.isalnum())) for m in _SPELLED.findall("\n" + t)} for t in lowered]
            distinct = set(letters.values()) - {""}
            near = self.look_up(distinct.union(*[s for text in across for s in text], *[s.values() for s in spelled]))
            heads = self.look_up_heads(distinct)
            hot = near.keys() | heads.keys()
            for text, own, joins, spelt in zip(split, words, across, spelled):
                found, alike = [], []
                spelt = {k: near[v] for k, v in spelt.items() if v in near}
                for s, of, more in zip(text, own, joins):
                    if hot.isdisjoint(of) and not (more or spelt):
                        continue
                    hits = [w for w in of if w in hot]
                    alike += [heads[w] for w in hits if w in heads]
                    pieces = [near[w] for w in (*hits, *more) if w in near] + [v for k, v in spelt.items() if k in s]
                    if pieces:
                        found.append(np.max(pieces, 0))
                # letters with points between them are cut by the sentences' ends: each such word is one by itself
                found += [v for k, v in spelt.items() if not any(k in s for s in text)]
                rates = np.sum(alike, 0) / (SMOOTH + sum(map(len, own))) if alike else np.zeros(len(self.heads.pieces))
                out.append((np.array(found) if found else np.zeros((0, len(self.marks.pieces))), rates))
        return out

    def top(self, sentences: list[np.ndarray]) -> np.ndarray:
        """Margin of each text's highest sentence, within -1 and 1: beyond the margin more evidence tells nothing."""
        return np.clip([max(float(self.margins(f).max()), self.b) if len(f) else self.b for f in sentences], -1, 1)

    def features(self, evidence: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the document's SVM sees: the highest sentence's margin, and the kernel means of the heads."""
        rates = np.minimum(np.array([r for _, r in evidence]).reshape(len(evidence), -1) / FULL, 1)
        return np.column_stack([self.top([s for s, _ in evidence]), rates @ self.head_root])

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        m = np.clip(self.features(self.evidence(texts)) @ self.doc_w + self.doc_b, -2, 2)
        return 1 / (1 + np.exp(-np.clip(self.slope * m + self.base, -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 20.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Primal linear SVM with squared hinge loss, by Newton steps on the active rows."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    ridge = np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        active = y * (x1 @ w) < 1
        xa, ya, wa = x1[active], y[active], weight[active]
        step = np.linalg.solve(ridge + 2 * c * (xa * wa[:, None]).T @ xa, 2 * c * (xa * wa[:, None]).T @ ya)
        if np.abs(step - w).max() < 1e-7:
            break
        w = step
    return w[:-1], float(w[-1])


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and base of P(y=1) = 1/(1+exp(-(slope m + base))), lightly held."""
    x = np.column_stack([m, np.ones(len(m))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 0.0)), float(w[1])


def _heads(texts: list[str], labels: np.ndarray, missed: np.ndarray) -> list[str]:
    """Heads picked one by one: each the one whose rate lifts most of the `missed` toxic texts above nearly all clean ones."""
    least = max(3, int(np.ceil(0.01 * labels.sum())))
    letters: dict[str, str] = {}
    heads_of = lambda w: [w[:n] for n in HEAD_LENGTHS if n <= len(w)]
    for text in texts:
        letters.update((t, normal(t)) for t in set(text.lower().split()) if t not in letters)
    spread = Counter(h for i in np.nonzero(missed)[0] for h in {h for t in set(texts[i].lower().split()) for h in heads_of(letters[t])})
    rates: dict[str, list[tuple[int, float]]] = {h: [] for h, n in spread.items() if n >= least}
    known = {t: own for t, w in letters.items() if (own := [h for h in heads_of(w) if h in rates])}
    del letters
    for i, text in enumerate(texts):
        tokens = Counter(text.lower().split())  # counted here again: all texts' counts at once would be larger than the texts
        found: Counter = Counter()
        for t in tokens.keys() & known.keys():
            for h in known[t]:
                found[h] += tokens[t]
        size = SMOOTH + tokens.total()
        for h, n in found.items():
            rates[h].append((i, n / size))
    spare = int(0.005 * (labels == 0).sum())  # clean texts that may lie above a head's bar
    above: dict[str, set[int]] = {}
    for h, at in rates.items():
        clean = sorted((r for i, r in at if not labels[i]), reverse=True)
        bar = clean[spare] if len(clean) > spare else 0.0
        above[h] = {i for i, r in at if labels[i] and r > bar}
    left, picked = set(np.nonzero(missed)[0].tolist()), []
    while len(picked) < HEADS and left:
        best = max(above, key=lambda h: (len(above[h] & left), len(above[h]), len(h), h), default="")
        if not best or len(above[best] & left) < least:
            break
        picked.append(best)
        left -= above[best]
    return picked


def fit(texts: list[str], labels: list[int]) -> Model:
    """Train on labelled texts (see the module's text)."""
    counts = (Counter(), Counter())
    totals = [0, 0]
    for text, label in zip(texts, labels):
        totals[label] += 1
        counts[label].update({p for t in set(text.lower().split()) for p in windows(normal(t))})
    gain = {}
    for p, n in counts[1].items():
        here, there = (n + 0.5) / (totals[1] + 1), (counts[0][p] + 0.5) / (totals[0] + 1)
        if n >= 3 and here > 3 * there:
            gain[p] = n * np.log(here / there)
    ranked = sorted(gain, key=lambda p: (-gain[p], p))
    bar = 0.3 * gain[ranked[0]] if ranked else 0
    marked = [p for p in ranked[:LANDMARKS] if gain[p] >= bar]
    harmless = [p for p, n in sorted(counts[0].items(), key=lambda x: (-x[1], x[0])) if len(p) >= 5 and p not in gain]
    pieces = marked + harmless[:HARMLESS]
    del counts, gain, ranked, harmless
    y = np.array(labels, int)
    told = set(marked)
    missed = np.array([bool(label) and not told.intersection(normal(t) for t in text.lower().split()) for text, label in zip(texts, labels)], bool)
    heads = _heads(texts, y, missed)
    model = Model(Landmarks(pieces or ["harmless"], len(marked)), Landmarks(heads or ["harmless"], len(heads)))
    per_doc = model.evidence(texts)
    sentences = [s for s, _ in per_doc]
    like = lambda d: d[:, : len(marked)].max(1, initial=0)
    harm = [d for i, d in enumerate(sentences) if not y[i] and len(d)]
    for turn in range(2):
        best = []
        for i, d in enumerate(sentences):
            if y[i] and len(d):
                best.append(d[(like(d) > 0.6) | (model.margins(d) > 0)] if turn else d[like(d) > 0.6])
        best = [b for b in best if len(b)]
        if not best:
            break
        x = np.vstack([*best, *harm, np.zeros((1, len(pieces)))])
        t = np.append(np.ones(sum(map(len, best))), -np.ones(len(x) - sum(map(len, best))))
        share = np.where(t > 0, 1 / max(1, (t > 0).sum()), CAUTION / max(1, (t < 0).sum()))
        share[-1] = 1.0  # most sentences hold no evidence at all: they are one row of great weight
        model.w, model.b = _svm(x @ model.root, t, share * len(x) / 2)
    if len(texts):
        x = model.features(per_doc)
        if 0 < y.sum() < len(y):
            model.doc_w, model.doc_b = _svm(x, 2.0 * y - 1, np.where(y == 1, len(y) / y.sum(), CAUTION * len(y) / (len(y) - y.sum())) / 2)
        model.slope, model.base = _logistic(np.clip(x @ model.doc_w + model.doc_b, -2, 2), y)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` rows of each class of `labels` (doc_id, toxic), drawn from all of them by a hash of the id.

    The class shares of the sample are not those of the corpus where a class has more rows than `sample`; the logistic
    fit's base is corrected by the counts of all labelled rows.
    """
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    number = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    drawn = [labels.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    picked = drawn[0].union(drawn[1])  # 2 * sample narrow rows at most
    rows = docs.select("doc_id", "text").where(F.length("text") <= TRAINED_LENGTH).join(F.broadcast(picked), "doc_id")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(2 * sample).select("text", "toxic")

    def fitted(batches):
        texts, y = [], []
        for b in batches:
            texts += b.column("text").to_pylist()
            y += b.column("toxic").to_pylist()
        if texts:
            model = pa.array([cloudpickle.dumps(fit(texts, y))], pa.binary())
            yield pa.RecordBatch.from_arrays([model, pa.array([[y.count(c) for c in (0, 1)]], pa.list_(pa.int64()))], ["model", "have"])

    # the bounded sample is fitted in a task: what a fit needs would stay in the driver for all that follows
    found = rows.mapInArrow(fitted, "model binary, have array<long>").collect()
    model = cloudpickle.loads(bytes(found[0]["model"])) if found else fit([], [])
    have = [max(1, n) for n in (found[0]["have"] if found else (0, 0))]
    if all(number.get(c) for c in (0, 1)):
        model.base += float(np.log(number[1] / number[0]) - np.log(have[1] / have[0]))
    return model


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """`docs` with `name`, the probability of label 1; other columns unchanged (a column of that name is replaced)."""
    kept = docs.select(*[c for c in docs.columns if c != name])
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())])
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = told.value
        for b in batches:
            values = m.scores([t or "" for t in b.column("text").cast(pa.string()).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.asarray(values, float))], names=[*b.schema.names, name])

    return kept.mapInArrow(run, schema)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves `fold`; a null id is held out of training, too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(True))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """`docs` without those that score `threshold` or more; columns unchanged."""
    (name,) = fresh(docs, "toxicity")
    scored = score(docs, train(docs, labels), name)
    return scored.where(F.col(name) < threshold).select(*docs.columns)
