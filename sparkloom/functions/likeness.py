"""The best known texts by ``token_set_ratio``, exactly, over blocks of known texts held as arrays.

Three steps, each over many pairs at once: letters in common (where few are near, only in cells of known texts whose digits agree enough), the
longest common subsequence, and the matching blocks that the score itself counts. A pair goes to the next step while its upper bound can still be among the n best.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np

from sparkloom.functions.text import _word_set, token_set_bounds, token_set_ratio

SHORT = 60  # letters of a text as a word set; positions fit 6 bits, and longer texts are compared one by one
CLASSES = 64  # letters counted apart; the rarer ones share
FREQUENT = 6  # words that are no key of their own
CELL = 64  # known texts that a cell holds at least, on average
PAD_A, UNKNOWN, PAD_B, FIRST = 0, 1, 2, 3  # codes; the two pads and a letter that no known text has equal nothing

#: SCORES[total, matched] is the score of so many matched letters of both texts together.
SCORES = np.rint(100 * (2.0 * np.arange(SHORT + 1)[None, :] / np.maximum(1, np.arange(2 * SHORT + 1))[:, None])).clip(0, 100).astype(np.int64)
#: NEED[total, score] is the least number of matched letters for that score; 255 where there is none.
NEED = np.stack([np.where((s := np.searchsorted(row, np.arange(102))) <= SHORT, s, 255) for row in SCORES]).astype(np.uint8)

#: REST[own, size] is the number of letters besides a cell's own in a text of that size; far below 0 where there is none.
REST = np.array([[size - own if size >= own else -999 for size in range(SHORT + 1)] for own in range(SHORT + 1)])


def matched(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, chunk: int = 8192) -> np.ndarray:
    """Letters in the matching blocks of each pair of rows of codes, as difflib's SequenceMatcher finds them (no junk).

    The longest common run, the first of a and then of b, is taken; what is left and right of it is compared in the same way.
    """
    n, (wide_a, wide_b) = len(a), (a.shape[1], b.shape[1])
    total = np.zeros(n, np.int64)
    flat_a, flat_b = (np.concatenate([x.ravel(), np.zeros(SHORT + 1, x.dtype)]) for x in (a, b))
    jobs = np.stack([np.arange(n), np.zeros(n, int), la, np.zeros(n, int), lb]).astype(np.int64)
    jobs = jobs[:, (la > 0) & (lb > 0)]
    while jobs.shape[1]:
        later = []
        for at in range(0, jobs.shape[1], chunk):
            p, a0, a1, b0, b1 = jobs[:, at : at + chunk]
            na, nb = a1 - a0, b1 - b0
            ia, ib = np.arange(na.max())[:, None], np.arange(nb.max())[:, None]
            ca = np.where(ia < na, flat_a[p * wide_a + a0 + ia], PAD_A)
            cb = np.where(ib < nb, flat_b[p * wide_b + b0 + ib], PAD_B)
            run, new = (np.zeros((len(ib) + 1, len(p)), np.uint8) for _ in range(2))
            size, end_a, end_b = np.zeros(len(p), np.uint8), np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
            for i in range(len(ia)):
                np.add(run[:-1], 1, out=new[1:])
                new[1:] *= cb == ca[i]
                top = new[1:].max(0)
                better = np.flatnonzero(top > size)
                if len(better):
                    size[better], end_a[better], end_b[better] = top[better], i, new[1:, better].argmax(0)
                run, new = new, run
            total += np.bincount(p, size, n).astype(np.int64)
            xa, xb = a0 + end_a + 1, b0 + end_b + 1  # behind the run
            for made in ((p, a0, xa - size, b0, xb - size), (p, xa, a1, xb, b1)):
                made = np.stack(made)
                later.append(made[:, (size > 0) & (made[1] < made[2]) & (made[3] < made[4])])
        jobs = np.concatenate(later, axis=1)
    return total


def ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, one after another."""
    return np.repeat(begin - np.cumsum(length) + length, length) + np.arange(length.sum())


class Known:
    """An index of known texts (sorted, distinct) for the n best of them by ``token_set_ratio``, ties by text."""

    def __init__(self, known: list[str]):
        self.known = known
        sets = [_word_set(b) for b in known]
        size = np.array([sum(map(len, s)) + max(0, len(s) - 1) for s in sets], np.int64)
        self.long = [known[i] for i in np.flatnonzero(size > SHORT)]
        self.all_bounds = self.long_bounds = None
        rank = np.flatnonzero(size <= SHORT)
        n = len(rank)

        joined = [" ".join(sorted(sets[i])) for i in rank]
        points, often = np.unique(np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
        points = points[np.argsort(-often, kind="stable")]
        self.code = np.full(0x110000, UNKNOWN, np.uint8 if len(points) < 256 - FIRST else np.uint16 if len(points) < 65536 - FIRST else np.uint32)
        self.code[0] = PAD_A
        self.code[points] = FIRST + np.arange(len(points))
        self.codes = FIRST + len(points)
        counts = np.zeros((min(CLASSES, max(1, len(points))), n), np.uint8)
        rows = self.encode(joined)
        for j in range(rows.shape[1]):
            there = np.flatnonzero(rows[:, j] >= FIRST)
            counts[self.letter_class(rows[there, j]), there] += 1

        # cells of texts with the same counts of some letters, digits first; places go by length, cell and text
        cell, self.keys = np.zeros(n, np.int64), []
        for c in sorted(range(len(counts)), key=lambda c: (c >= len(points) or not chr(points[c]).isdigit(), c)) if n else []:
            found, finer = np.unique(cell * (int(counts[c].max()) + 1) + counts[c], return_inverse=True)
            if len(found) > max(4, n // CELL):
                break
            cell = finer
            self.keys.append(c)
        order = np.lexsort((rank, cell, size[rank]))
        self.rank, self.counts, cell = rank[order], np.ascontiguousarray(counts[:, order]), cell[order]
        self.sets, self.size = [sets[i] for i in self.rank], size[self.rank]
        self.by_place = np.ascontiguousarray(self.counts.T)
        self.at_most = {m: np.minimum(self.counts, m) for m in (1, 2)}
        self.starts = np.searchsorted(self.size, np.arange(SHORT + 2))  # where each length begins
        _, first = np.unique(cell, return_index=True)
        self.cell_counts = {c: self.counts[c, first] for c in self.keys}
        _, self.run_start, self.run_length = np.unique(self.size * len(first) + cell, return_index=True, return_counts=True)  # runs of one length and cell
        self.run_cell, self.run_size = cell[self.run_start], self.size[self.run_start]
        self.cell_letters = sum((self.cell_counts[c].astype(np.int64) for c in self.keys), np.zeros(len(first), np.int64))
        self.run_rest = self.run_size - self.cell_letters[self.run_cell]
        self.cell_size = np.bincount(cell, minlength=len(first))
        self.cell_runs = np.argsort(self.run_cell, kind="stable")  # runs by cell
        self.runs_begin, self.runs_of = np.searchsorted(self.run_cell[self.cell_runs], np.arange(len(first))), np.bincount(self.run_cell, minlength=len(first))

        self.word: dict[str, int] = {}
        held = np.array([self.word.setdefault(w, len(self.word)) for s in self.sets for w in s], np.int64)
        self.holders = np.repeat(np.arange(n), [len(s) for s in self.sets])[np.argsort(held, kind="stable")]  # by word, then by place
        times = np.bincount(held, minlength=len(self.word))
        self.ends = np.cumsum(times)
        often = {w: int(times[i]) for w, i in self.word.items() if times[i] > max(50, n // 100)}
        common = sorted(often, key=lambda w: (-often[w], w))[:FREQUENT]
        self.bit = {w: 1 << k for k, w in enumerate(common)}
        self.joined = np.array([len(" ".join(w for w, bit in self.bit.items() if bit & sign)) for sign in range(1 << len(common))], np.int64)  # letters of the words of a sign
        signs = np.zeros(n, np.int64)
        for w, bit in self.bit.items():
            signs[self.holding(w)] |= bit
            del self.word[w]
        self.signs, self.group = np.unique(signs, return_inverse=True)
        self.members = [np.flatnonzero(self.group == g) for g in range(len(self.signs))]
        self.place = np.zeros(n, np.int64)
        for m in self.members:
            self.place[m] = np.arange(len(m))
        self.shortest = np.array([self.size[m].min() for m in self.members], np.int64)
        frequent = frozenset(self.bit)
        self.bare: dict[int, np.ndarray] = {}  # texts of frequent words only, by rank
        for i in np.flatnonzero(signs)[np.argsort(self.rank[np.flatnonzero(signs)])]:
            if self.sets[i] <= frequent:
                self.bare.setdefault(int(signs[i]), []).append(i)
        self.bare = {sign: np.array(at) for sign, at in self.bare.items()}


        self.variants: dict[tuple[int, int], np.ndarray] = {}
        self.asked: dict[tuple[int, int], int] = {}
        self.guess = -1
        self.out = np.zeros(n, bool)

    def holding(self, word: str) -> np.ndarray:
        """Places of the texts that hold the word."""
        i = self.word[word]
        return self.holders[self.ends[i - 1] if i else 0 : self.ends[i]]

    def letter_class(self, codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.int64) - FIRST) % CLASSES

    def encode(self, texts: list[str]) -> np.ndarray:
        width = max(map(len, texts), default=0) or 1
        return self.code[np.array(texts, f"U{width}").view(np.uint32).reshape(len(texts), width)]

    def variant(self, g: int, sign: int, at: np.ndarray) -> np.ndarray:
        """Codes, by position, of a group's texts at the places with the frequent words of that sign at their start."""

        def codes(places: np.ndarray) -> np.ndarray:
            first = frozenset(w for w, bit in self.bit.items() if bit & sign)
            start = " ".join(sorted(first))
            return np.ascontiguousarray(self.encode([f"{start} {' '.join(sorted(self.sets[i] - first))}".strip() for i in places]).T)

        if (g, sign) not in self.variants:
            self.asked[g, sign] = self.asked.get((g, sign), 0) + len(at)
            if self.asked[g, sign] < len(self.members[g]) // 4:  # not worth those of the whole group yet
                return codes(at)
            self.variants[g, sign] = codes(self.members[g])
        return np.take(self.variants[g, sign], self.place[at], axis=1)

    def shared_words(self, texts: list[_Text], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text the places and upper bounds of the known texts that share a word with it that is no frequent one.

        Where one side is in the other, the score is 100, which the text gets here; with n of them it gets no other places.
        """
        found = [(k, len(w) + 1, self.holding(w)) for k, t in enumerate(texts) for w in t.words if w in self.word]
        none = np.zeros(0, np.int64)
        if not found:
            return [(none, none)] * len(texts)
        of, weight, at = zip(*found)
        times, many = [len(x) for x in at], len(self.rank)
        pair, which = np.unique(np.repeat(of, times) * many + np.concatenate(at), return_inverse=True)
        of, at = np.divmod(pair, many)
        sign, size = np.array([t.sign for t in texts])[of] & self.signs[self.group[at]], np.array([t.size for t in texts])[of]
        # letters of the common words, joined
        common = np.bincount(which, np.repeat(weight, times)).astype(np.int64) - 1 + self.joined[sign] + (sign > 0)
        start = self.start_score(common, size, self.size[at])
        whole = start == 100
        rest = np.flatnonzero(~whole & (np.bincount(of[whole], minlength=len(texts)) < n)[of])
        counts, bag = np.stack([t.counts for t in texts]), np.zeros(len(rest), np.int64)
        for lo in range(0, len(rest), 65536):
            i = rest[lo : lo + 65536]
            bag[lo : lo + 65536] = np.minimum(self.by_place[at[i]], counts[of[i]]).sum(1)
        bound = np.maximum(start[rest], SCORES[size[rest] + self.size[at[rest]], bag])
        ends = [np.searchsorted(x, np.arange(1, len(texts))) for x in (of, of[whole], of[rest])]
        for t, places, full in zip(texts, np.split(at, ends[0]), np.split(at[whole], ends[1])):
            t.seen = np.concatenate([t.seen, places])
            if len(full):
                t.take(np.full(len(full), 100), self.rank[full])
        return list(zip(np.split(at[rest], ends[2]), np.split(bound, ends[2])))

    def start_score(self, common: np.ndarray | int, la: int, lb: np.ndarray) -> np.ndarray:
        """The score of the common words, joined, against the shorter text; 100 where they are one side."""
        return np.rint(100 * (2.0 * common / np.maximum(1, common + np.minimum(la, lb)))).astype(np.int64)

    def letters_in_common(self, text: _Text, at: np.ndarray | slice) -> np.ndarray:
        out = np.zeros_like(self.counts[0][at])
        for c, m in text.letters:
            out += self.at_most[m][c][at] if m in self.at_most else np.minimum(self.counts[c][at], np.uint8(m))
        return out

    def with_letters(self, text: _Text, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places not seen yet of the texts that have the letters in common which the score needs, and how many.

        Only cells that can hold such are looked into, unless these hold much of the index.
        """
        need = NEED[text.size : text.size + SHORT + 1, max(0, least)]
        most, other = np.zeros(len(self.cell_letters), np.uint8), 0
        for c, m in text.letters:
            if c in self.cell_counts:
                most += np.minimum(self.cell_counts[c], np.uint8(m))
            else:
                other += m
        # least letters of the cell that must be had in common, by the number that the cell has
        cells = np.flatnonzero(most >= (need - np.minimum(REST, other)).min(1)[self.cell_letters])
        if self.cell_size[cells].sum() <= len(self.rank) // 8:
            runs = self.cell_runs[ranges(self.runs_begin[cells], self.runs_of[cells])]
            runs = runs[most[self.run_cell[runs]] + np.minimum(self.run_rest[runs], other) >= need[self.run_size[runs]]]
            at = ranges(self.run_start[runs], self.run_length[runs])
            bag = self.letters_in_common(text, at)
            keep = (bag >= need[self.size[at]]) & ~self.out[at]
            return at[keep], bag[keep]
        bag, mask = self.letters_in_common(text, slice(None)), np.zeros(len(self.rank), bool)
        for length in range(SHORT + 1):
            lo, hi = self.starts[length], self.starts[length + 1]
            if lo < hi and need[length] <= min(text.size, length):
                np.greater_equal(bag[lo:hi], need[length], out=mask[lo:hi])
        mask[text.seen] = False
        at = np.flatnonzero(mask)
        return at, bag[at]

    def search(self, text: _Text, least: int, before: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and upper bounds of the pairs, by frequent words alone, that may reach the score (at equality: come before that rank)."""
        self.out[text.seen] = True
        la, (found, bag) = text.size, self.with_letters(text, least)
        starts, more = np.zeros(len(self.signs), np.int64), []
        for g, sign in enumerate(self.signs & text.sign):
            if sign:
                starts[g] = self.joined[sign]
                if self.start_score(starts[g], la, self.shortest[g]) >= least:
                    own = self.members[g]
                    more.append(own[self.start_score(starts[g], la, self.size[own]) >= least])
        if more:
            more = np.concatenate(more)
            more = np.setdiff1d(more[~self.out[more]], found)
            found, bag = np.concatenate([found, more]), np.concatenate([bag, self.letters_in_common(text, more)])
        self.out[text.seen] = False
        if not len(found):
            return found, found
        start = self.start_score(starts[self.group[found]], la, self.size[found])
        bound = np.maximum(start, SCORES[la + self.size[found], bag])
        keep = (bound > least) | (bound == least) & (self.rank[found] < before)
        found, start = found[keep], start[keep]
        bound = np.maximum(start, SCORES[la + self.size[found], self.subsequence(text, found)])
        keep = (bound > least) | (bound == least) & (self.rank[found] < before)
        return found[keep], bound[keep]

    def by_group(self, text: _Text, found: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """sign, which of the places, codes of the text, codes of the known ones by position."""
        group = self.group[found]
        for g in np.unique(group):
            which, sign = np.flatnonzero(group == g), int(self.signs[g]) & text.sign
            yield sign, which, text.codes_of(sign, self), self.variant(g, sign, found[which])

    def subsequence(self, text: _Text, found: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of the text with each of the places, the common words first on either side."""
        kind = np.uint32 if text.size < 32 else np.uint64
        out = np.zeros(len(found), np.int64)
        for _, which, mine, theirs in self.by_group(text, found):
            at = np.zeros(self.codes, kind)
            for i, c in enumerate(mine):
                if c >= FIRST:
                    at[c] |= kind(1) << kind(i)
            v = np.full(len(which), np.iinfo(kind).max, kind)
            for positions in at[theirs]:
                u = v & positions
                v = (v + u) | (v - u)
            out[which] = np.bitwise_count(~v & kind((1 << len(mine)) - 1))
        return out

    def score_pairs(self, texts: list[_Text], wanted: list[np.ndarray], by_words: bool) -> None:
        """Scores each text with its wanted places and keeps the best. by_words: the places share other words than frequent ones."""
        left, right, la, lb, start = [], [], [], [], []
        for text, found in zip(texts, wanted):
            if by_words:
                for i in found:
                    s = self.sets[i]
                    c = text.words & s
                    first = " ".join(sorted(c))
                    mine = text.with_start(c, first)
                    left.append(mine)
                    right.append(f"{first} {' '.join(sorted(s - c))}")
                    start.append(len(first))
            else:
                for sign, which, mine, theirs in self.by_group(text, found):
                    left.append(np.broadcast_to(np.pad(mine, (0, SHORT + 1 - len(mine))), (len(which), SHORT + 1)))
                    right.append(np.pad(theirs.T, ((0, 0), (0, SHORT + 1 - len(theirs)))))
                    start.append(np.full(len(which), self.joined[sign]))
        if not left:
            return
        found = np.concatenate(wanted)
        if by_words:
            left, right, start = self.encode(left), self.encode(right), np.array(start)
            order = np.arange(len(found))
        else:
            left, right, start = np.concatenate(left), np.concatenate(right), np.concatenate(start)
            # groups come apart within a text
            order = np.concatenate([b + np.argsort(self.group[w], kind="stable") for w, b in zip(wanted, np.cumsum([0, *map(len, wanted)]))])
        found = found[order]
        la, lb = np.repeat([t.size for t in texts], [len(w) for w in wanted]), self.size[found]
        score = np.maximum(np.rint(100 * (2.0 * start / np.maximum(1, start + np.minimum(la, lb)))).astype(np.int64), SCORES[la + lb, matched(left, right, la, lb)])
        rank, at = self.rank[found], 0
        for text, w in zip(texts, wanted):
            text.take(score[at : at + len(w)], rank[at : at + len(w)])
            at += len(w)

    def best(self, texts: list[str], n: int, chunk: int = 128) -> Iterator[tuple[str, str, int]]:
        """text, known text, score of the n best known texts of each text."""
        first = max(1, chunk // 8)  # the first few give a guess
        for at in (0, *range(first, len(texts), chunk)):
            upto = at + chunk if at else first
            made, short = [_Text(a, n) for a in texts[at:upto]], []
            for t in made:
                if t.size > SHORT:
                    if self.all_bounds is None:
                        self.all_bounds = token_set_bounds(self.known)
                    yield from one_by_one(t.text, self.known, self.all_bounds(t.text), n, [])
                elif not t.size:
                    yield from ((t.text, b, 0) for b in self.known[:n])
                else:
                    short.append(t)
            self.search_all(short, n)
            for t in short:
                best = [(-s, self.known[r]) for s, r in zip(t.scores.tolist(), t.ranks.tolist())]
                if self.long and self.long_bounds is None:
                    self.long_bounds = token_set_bounds(self.long)
                yield from one_by_one(t.text, self.long, self.long_bounds(t.text), n, best) if self.long else ((t.text, b, -s) for s, b in best)

    def score_best(self, texts: list[_Text], found: list[tuple[np.ndarray, np.ndarray]], first: int, by_words: bool) -> None:
        """Scores the places of the highest bounds, then those that can still be among the best."""
        order = [np.argsort(-bound, kind="stable") for _, bound in found]
        self.score_pairs(texts, [f[o[:first]] for (f, _), o in zip(found, order)], by_words)
        rest = []
        for t, (f, bound), o in zip(texts, found, order):
            o = o[first:]
            least, before = t.least()
            rest.append(f[o[(bound[o] > least) | (bound[o] == least) & (self.rank[f[o]] < before)]])
            t.seen = np.concatenate([t.seen, f])
        self.score_pairs(texts, rest, by_words)

    def search_all(self, texts: list[_Text], n: int) -> None:
        if not texts or not len(self.rank):
            return
        rows = self.encode([t.whole for t in texts])
        there = rows >= FIRST
        counts = np.zeros((len(texts), len(self.counts)), np.uint8)
        np.add.at(counts, (np.nonzero(there)[0], self.letter_class(rows[there])), 1)
        for t, row in zip(texts, counts):
            t.counts = row
            t.sign = sum(bit for w, bit in self.bit.items() if w in t.words)
            for sign, at in self.bare.items():
                if sign & t.sign == sign:  # one side of the text
                    t.take(np.full(len(at[:n]), 100), self.rank[at[:n]])
                    t.seen = np.concatenate([t.seen, at])
        self.score_best(texts, self.shared_words(texts, n), 2 * n, True)
        # only where one side is in the other the score is 100; such are known by now, unless all words of the text are frequent
        texts = [t for t in texts if t.least()[0] < 100 or t.words <= self.bit.keys()]
        # first as if the score were as high as it was before; where it is not, again with what was found
        tried = [max(t.least()[0], self.guess) for t in texts]
        for again in (False, True):
            todo = [(t, t.least() if again or x <= t.least()[0] else (x, len(self.known))) for t, x in zip(texts, tried) if not again or t.least()[0] < x]
            self.score_best([t for t, _ in todo], [self.search(t, *least) for t, least in todo], 4 * n, False)
        if texts:
            self.guess = int(np.quantile([t.least()[0] for t in texts], 0.1))


class _Text:
    """A text that is looked for, with the n best so far."""

    def __init__(self, text: str, n: int):
        self.text, self.n, self.words = text, n, _word_set(text)
        self.whole = " ".join(sorted(self.words))
        self.size = len(self.whole)
        self.scores, self.ranks = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.starts: dict = {}
        self.seen = np.zeros(0, np.int64)  # places that were scored or ruled out
        self.counts, self.sign = np.zeros(0, np.uint8), 0  # of its letters, by class; of its frequent words

    @cached_property
    def letters(self) -> list[tuple[int, int]]:
        return [(int(c), int(self.counts[c])) for c in np.flatnonzero(self.counts)]

    def with_start(self, common: frozenset[str], first: str) -> str:
        if common not in self.starts:
            self.starts[common] = f"{first} {' '.join(sorted(self.words - common))}".strip()
        return self.starts[common]

    def codes_of(self, sign: int, index: Known) -> np.ndarray:
        """Codes of the text with the frequent words of the sign first."""
        if sign not in self.starts:
            common = frozenset(w for w, bit in index.bit.items() if bit & sign)
            self.starts[sign] = index.encode([self.with_start(common, " ".join(sorted(common)))])[0]
        return self.starts[sign]

    def take(self, scores: np.ndarray, ranks: np.ndarray) -> None:
        scores, ranks = np.concatenate([self.scores, scores]), np.concatenate([self.ranks, ranks])
        first = np.lexsort((ranks, -scores))[: self.n]
        self.scores, self.ranks = scores[first], ranks[first]

    def least(self) -> tuple[int, int]:
        """Score and rank of the n-th best; a pair must have more, or as much and a smaller rank."""
        return (int(self.scores[-1]), int(self.ranks[-1])) if len(self.scores) == self.n else (-1, 0)


def one_by_one(a: str, known: list[str], most: np.ndarray, n: int, best: list[tuple[int, str]], scorer=token_set_ratio) -> Iterator[tuple[str, str, int]]:
    """The n best of those given (minus score, text) and the known texts, taken by falling upper bound until none can be among them."""
    for i in np.argsort(-most, kind="stable"):
        if len(best) == n and most[i] < -best[-1][0]:
            break  # no text from here on can be among the n best
        best = sorted([*best, (-scorer(a, known[i]), known[i])])[:n]
    return ((a, b, -s) for s, b in best)
