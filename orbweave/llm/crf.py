"""A linear-chain conditional random field over word-shape features: training, and exact Viterbi decoding in numpy batches."""

from __future__ import annotations

import itertools
import re

import numpy as np

TAGS = ["O", "secret", "id", "spelled_email"]
#: Words whose identity is a feature; all others count by shape alone.
CUES = frozenset("token key secret password passwd pwd api apikey bearer auth ssn passport iban id no number account at dot (at) [at] (dot) [dot] = : is".split())
LONGEST_CUE = max(map(len, CUES))
#: Words of runs that are decoded together, about.
CELLS = 1 << 17
STEPS = 250
RATE = 0.2
RIDGE = 1e-3

_DIGIT = re.compile(r"[0-9]")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")


class _Signs(dict):
    """A character's sign in a shape: a and A for letters, 9 for ASCII digits, ASCII symbols as they are, u for the rest."""

    def __missing__(self, c: int) -> str:
        x = chr(c)
        sign = "9" if "0" <= x <= "9" else "A" if x.isupper() else "a" if x.isalpha() else x if x.isascii() else "u"
        self[c] = sign
        return sign


_SIGNS = _Signs()
_QUOTES = "\"'`.,;:!?()[]{}<>"


def shape(word: str) -> str:
    """Runs of letters as a (A in upper case), of digits as 9, others as they are; at most 12 signs."""
    return "".join(k for k, _ in itertools.groupby(word[:64].translate(_SIGNS)))[:12]


def cue(word: str) -> str:
    low = word.lower().strip("\"'`.,;!?")
    return low if low in CUES else word if word in CUES else ""


def features(word: str) -> list[str]:
    """The features of one word; the field also looks at those of the words beside it."""
    core = word.strip(_QUOTES)
    digits = sum("0" <= c <= "9" for c in core)
    mixed = 0 < digits < len(core) and core.isalnum()
    return [
        f"shape={shape(word)}",
        f"length={min(len(core), 60) // 6}",
        f"digits={-(-4 * digits // max(1, len(core)))}",
        f"hex={len(core) >= 16 and digits > 0 and bool(_HEX.fullmatch(core))}",
        f"mixed={mixed and len(core) >= 16}",
        f"groups={'-'.join(str(len(x)) for x in core.split('-')) if re.fullmatch('[0-9]+(-[0-9]+)+', core) else ''}",
        f"cue={cue(word)}",
        "bias",
    ]


class Crf:
    """Weights: for each feature and offset (-1, 0, 1) a score of each tag, and a score of each pair of tags.

    A word's scores depend on the word alone, so they are worked out once and looked up.
    """

    REMEMBERED = 100_000

    def __init__(self, weights: dict[str, np.ndarray], pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs
        self.none = np.zeros((3, len(TAGS)))
        self.forget()
        #: What a tag can gain over O by its two transitions at most: with a larger lead O wins, whatever the tags beside it are.
        self.gain = (pairs - pairs[:, :1]).max(0)[1:] + (pairs - pairs[:1]).max(1)[1:] + 1e-9

    def forget(self) -> None:
        self.row: dict[str, int] = {}
        self.kinds: dict[tuple, int] = {}
        self.scores = np.zeros((1024, 3, len(TAGS)))

    def __getstate__(self):
        return self.weights, self.pairs

    def __setstate__(self, state):
        self.__init__(*state)

    def _kind(self, word: str) -> int:
        """The row of scores of all words with the same features; a word without digits has no features beside these three."""
        # most words are of letters alone, small or with a capital first: what they have in common is seen at once
        if word.isalpha() and (word.islower() or (word[0].isupper() and word[1:].islower())):
            key = ("a" if word.islower() else "Aa", min(len(word), 60) // 6, cue(word) if len(word) <= LONGEST_CUE else "")
        else:
            key = self._key(word)
        i = self.kinds.get(key)
        if i is None:
            i = self.kinds[key] = len(self.kinds)
            if i == len(self.scores):
                self.scores = np.concatenate((self.scores, np.zeros_like(self.scores)))
            self.scores[i] = sum((self.weights.get(f, self.none) for f in features(word)), self.none)
        return i

    @staticmethod
    def _key(word: str) -> tuple:
        digits = _DIGIT.search(word)
        return tuple(features(word)) if digits else (shape(word), min(len(word.strip(_QUOTES)), 60) // 6, cue(word))

    def rows(self, words: list[str]) -> np.ndarray:
        row = self.row
        out = list(map(row.get, words))
        if None in out:
            for at, w in enumerate(words):
                if out[at] is None:
                    i = row.get(w)
                    if i is None:
                        i = row[w] = self._kind(w)
                    out[at] = i
        return np.array(out, dtype=np.int64)

    def emissions(self, words: list[str], text: np.ndarray | None = None) -> np.ndarray:
        """Scores of each word's tags; with ``text`` (a number for each word) words of different texts don't count as neighbours."""
        rows = self.rows(words)
        s = self.scores[rows]  # rows() may have enlarged the table
        out = s[:, 1].copy()
        beside = 1 if text is None else (text[1:] == text[:-1])[:, None]
        out[1:] += s[:-1, 2] * beside  # what a word says about the one after it
        out[:-1] += s[1:, 0] * beside
        return out

    def decode(self, texts: list[list[str]]) -> list[list[tuple[int, int]]]:
        """(word, tag) of every word that isn't O on the best path of each text.

        If O leads a word's other tags by more than all that its two transitions can be worth, the best path has O there.
        Such words cut a text into short runs, and only these go through the dynamic programme: the result is the same.
        """
        if len(self.row) > self.REMEMBERED:
            self.forget()
        size = [len(words) for words in texts]
        text = np.repeat(np.arange(len(texts)), size)
        first = np.cumsum([0, *size])
        e = self.emissions([w for words in texts for w in words], text)
        open_ = np.nonzero((e[:, :1] - e[:, 1:] <= self.gain).any(1))[0]
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not len(open_):
            return out
        fresh = np.concatenate(([True], (np.diff(open_) > 1) | (np.diff(text[open_]) > 0)))
        starts, ends = open_[fresh], open_[np.append(fresh[1:], True)] + 1
        own = text[starts]
        length, before, after = ends - starts, starts > first[own], ends < first[own + 1]
        order = np.argsort(length, kind="stable")
        found, lo = [], 0
        while lo < len(order):
            # runs of similar length, as many as fit
            hi = lo + max(1, int((length[order[lo : lo + CELLS]] * np.arange(1, len(order[lo : lo + CELLS]) + 1) <= CELLS).sum()))
            part = order[lo:hi]
            tags = self._viterbi(e, starts[part], length[part], before[part], after[part])
            i, j = np.nonzero(tags)
            found.append(np.stack((starts[part[i]] + j, tags[i, j])))
            lo = hi
        words, tags = np.concatenate(found, axis=1)
        for w, k in sorted(zip(words.tolist(), tags.tolist(), strict=True)):
            t = int(text[w])
            out[t].append((w - int(first[t]), k))
        return out

    def _viterbi(self, every: np.ndarray, starts: np.ndarray, length: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Best tags (runs x words) of the runs of words from ``starts`` on; ``before`` and ``after`` tell whether an O stands there."""
        n, longest = len(starts), int(length.max())
        e = every[np.minimum(starts[:, None] + np.arange(longest), len(every) - 1)]
        best = e[:, 0] + before[:, None] * self.pairs[0]
        back = np.zeros((n, longest, len(TAGS)), dtype=np.int8)
        for t in range(1, longest):
            via = best[:, :, None] + self.pairs
            back[:, t] = via.argmax(1)
            best = np.where((t < length)[:, None], via.max(1) + e[:, t], best)
        tag = (best + after[:, None] * self.pairs[:, 0]).argmax(1)
        out, rows = np.zeros((n, longest), dtype=np.int8), np.arange(n)
        for t in range(longest - 1, -1, -1):
            live = t < length
            out[:, t] = np.where(live, tag, 0)
            tag = np.where(live, back[rows, t, tag], tag)
        return out


def train(table: list[tuple[list[str], list[str]]]) -> Crf:
    """Maximum likelihood with a ridge penalty, by AdaGrad over the whole table; forward and backward sums run over all sequences at once.

    table: (words, tags) of each sequence. It is meant to be small: a few thousand words.
    """
    names: dict[str, int] = {}
    n, longest, k = len(table), max(len(w) for w, _ in table), len(TAGS)
    slots = len(features("x")) * 3
    ids = np.full((n, longest, slots), -1, dtype=np.int64)
    gold = np.zeros((n, longest), dtype=np.int64)
    length = np.array([len(w) for w, _ in table])
    for i, (words, tags) in enumerate(table):
        own = [features(w) for w in words]
        gold[i, : len(words)] = [TAGS.index(t) for t in tags]
        for t in range(len(words)):
            # weights lie at offset 0 for the word itself, at 1 for the word before and at -1 for the word after
            for o, s in ((0, t + 1), (1, t), (2, t - 1)):
                if 0 <= s < len(words):
                    for j, f in enumerate(own[s]):
                        ids[i, t, o * slots // 3 + j] = names.setdefault(f"{o}|{f}", len(names))
    mask = np.arange(longest) < length[:, None]
    w, pairs = np.zeros((len(names) + 1, k)), np.zeros((k, k))
    gw, gp = np.full_like(w, 1e-2), np.full_like(pairs, 1e-2)
    one_hot = np.eye(k)[gold] * mask[..., None]
    both = mask[:, 1:]
    gold_pairs = np.einsum("nta,ntb->ab", one_hot[:, :-1] * both[..., None], one_hot[:, 1:])
    for _ in range(STEPS):
        e = w[ids].sum(2)  # the last row, of absent features, stays 0
        fwd, bwd = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        fwd[:, 0] = e[:, 0]
        for t in range(1, longest):
            x = fwd[:, t - 1, :, None] + pairs
            m = x.max(1)
            fwd[:, t] = np.where(mask[:, t, None], m + np.log(np.exp(x - m[:, None]).sum(1)) + e[:, t], fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            x = pairs + (e[:, t + 1] + bwd[:, t + 1])[:, None, :]
            m = x.max(2)
            bwd[:, t] = np.where(mask[:, t + 1, None], m + np.log(np.exp(x - m[:, :, None]).sum(2)), 0)
        last = fwd[np.arange(n), length - 1]
        top = last.max(1, keepdims=True)
        z = top[:, 0] + np.log(np.exp(last - top).sum(1))
        node = np.exp(fwd + bwd - z[:, None, None]) * mask[..., None]
        joint = np.exp(fwd[:, :-1, :, None] + pairs + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[..., None, None]
        slope = np.zeros_like(w)
        np.add.at(slope, ids.reshape(-1), np.repeat((one_hot - node).reshape(-1, k), slots, axis=0))
        slope[-1] = 0
        slope -= RIDGE * n * w / 10
        step_p = gold_pairs - joint.sum((0, 1)) - RIDGE * n * pairs / 10
        gw += slope**2
        gp += step_p**2
        w += RATE * slope / np.sqrt(gw)
        pairs += RATE * step_p / np.sqrt(gp)
        w[-1] = 0
    weights: dict[str, np.ndarray] = {}
    for name, i in names.items():
        o, _, f = name.partition("|")
        weights.setdefault(f, np.zeros((3, k)))[int(o)] = w[i]
    return Crf(weights, pairs)
