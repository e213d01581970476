"""Segmentation lattices of many words at once, in arrays.

The words' bytes lie in one row, every blank as a marker. All positions that begin a character walk the
double array together, a byte at a time; where a piece ends, it becomes an edge between two nodes. A
word has a node before each character and one at its end. Sums and best paths go level by level
(the node's number of characters from the word's start) over the edges of all words.

Only words that are valid UTF-8, without markers of their own, and up to ``LONGEST`` bytes long are for
this form; the caller treats the others one at a time.
"""

from __future__ import annotations

import numpy as np

MARK = "▁".encode()
LONGEST = 256


def by_length(words: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """Places of the words for the lattice, short ones first (so few levels do for most), and of the others."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    good = np.fromiter(map(bytes.isascii, words), bool, len(words))
    for k in np.flatnonzero(~good).tolist():
        good[k] = _valid(words[k])
    good &= size <= LONGEST
    plain = np.flatnonzero(good)
    return plain[np.argsort(size[plain], kind="stable")], np.flatnonzero(~good).tolist()


def _valid(word: bytes) -> bool:
    """UTF-8 without a marker of its own."""
    try:
        return "▁" not in word.decode()
    except UnicodeDecodeError:
        return False


class Lattice:
    """Edges of the given words (see ``by_length``) and the nodes they join."""

    def __init__(self, words: list[bytes], base: np.ndarray, check: np.ndarray, value: np.ndarray) -> None:
        spelt = [w.replace(b" ", MARK) for w in words]  # blanks stand only in front
        self.s = s = np.frombuffer(b"".join(spelt), dtype=np.uint8)
        size = np.array([len(w) for w in spelt], dtype=np.int64)
        stop = np.cumsum(size)
        self.char = char = np.flatnonzero((s & 0xC0) != 0x80)  # first bytes of characters
        of = np.searchsorted(stop, char, "right")
        chars = np.bincount(of, minlength=len(words))
        self.first = np.cumsum(chars) - chars + np.arange(len(words))  # node before each word
        self.last = self.first + chars
        node = np.arange(len(char)) + of
        self.n_nodes = len(char) + len(words)
        node_at = np.full(len(s) + 1, -1, dtype=np.int64)  # of a byte position inside its word
        node_at[char] = node
        level = np.zeros(self.n_nodes, dtype=np.int64)
        level[node] = node - self.first[of]
        level[self.last] = chars
        word_end = stop[of]
        starts, ends, pieces = [], [], []
        # the walk's bytes as steps; a word is followed by a step 0, which no state has
        steps = np.zeros(len(s) + len(words), dtype=np.int64)
        steps[np.arange(len(s)) + np.repeat(np.arange(len(words)), size)] = s.astype(np.int64) + 1
        at, state, pos = np.arange(len(char)), np.zeros(len(char), dtype=np.int64), char + of
        while len(at):
            to = base.take(state) + steps.take(pos)
            good = np.flatnonzero(check.take(to) == state)
            at, state, pos = at.take(good), to.take(good), pos.take(good) + 1
            v = value.take(state)
            hit = np.flatnonzero(v >= 0)
            starts.append(at.take(hit))
            ends.append(pos.take(hit))
            pieces.append(v.take(hit))
        start, end, piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends, pieces))
        end = end - of[start]
        after = np.append(char[1:], len(s))  # end of each character
        single = np.zeros(len(char), dtype=bool)
        single[start[end == after[start]]] = True
        lone = np.flatnonzero(~single)
        start, end = np.concatenate([start, lone]), np.concatenate([end, after[lone]])
        self.piece = np.concatenate([piece, np.full(len(lone), -1, piece.dtype)]).astype(np.int64)
        self.from_char = start
        self.source = node[start]
        self.target = np.where(end == word_end[start], self.last[of[start]], node_at[np.minimum(end, len(s) - 1)])
        # by level and node of the target; equal targets from the longest edge to the shortest
        length = self.target - self.source
        order = np.argsort((level[self.target] << 44) | (self.target << 8) | (255 - np.minimum(length, 255)))
        for name in ("piece", "from_char", "source", "target"):
            setattr(self, name, getattr(self, name)[order])
        self.level, self.word_of_char = level, of
        self.into = _segments(level[self.target], self.target)

    def scores(self, score: np.ndarray, unknown: float) -> np.ndarray:
        return np.where(self.piece >= 0, score[self.piece], unknown)

    def forward(self, weight: np.ndarray) -> np.ndarray:
        """Log sums over the paths from each word's start to a node."""
        out = np.zeros(self.n_nodes)
        for lo, hi, firsts, nodes in self.into:
            out[nodes] = _log_sums(out[self.source[lo:hi]] + weight[lo:hi], firsts)
        return out

    def backward(self, weight: np.ndarray) -> np.ndarray:
        """Log sums over the paths from a node to its word's end."""
        order = np.argsort(((LONGEST - self.level[self.source]) << 44) | (self.source << 8))
        source, target, weight = self.source[order], self.target[order], weight[order]
        out = np.zeros(self.n_nodes)
        for lo, hi, firsts, nodes in _segments(LONGEST - self.level[source], source):
            out[nodes] = _log_sums(out[target[lo:hi]] + weight[lo:hi], firsts)
        return out

    def expected(self, score: np.ndarray, unknown: float, times: np.ndarray, fixed: int, counts: np.ndarray) -> None:
        """Adds the expected counts of the pieces, ``times`` a word, in units of 1/fixed."""
        weight = self.scores(score, unknown)
        fwd, bwd = self.forward(weight), self.backward(weight)
        word = self.word_of_char[self.from_char]
        p = np.exp(np.minimum(fwd[self.source] + weight + bwd[self.target] - fwd[self.last[word]], 0.0))
        real = self.piece >= 0
        np.add.at(counts, self.piece[real], np.rint(times[word[real]] * fixed * p[real]).astype(np.int64))

    def best(self, score: np.ndarray, unknown: float, byte_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every word's best path, one after the other, and how many each word has."""
        weight = self.scores(score, unknown)
        out, back = np.zeros(self.n_nodes), np.full(self.n_nodes, -1, dtype=np.int64)
        for lo, hi, firsts, nodes in self.into:
            x = out[self.source[lo:hi]] + weight[lo:hi]
            top = np.maximum.reduceat(x, firsts)
            out[nodes] = top
            group = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, hi - lo)))
            equal = np.flatnonzero(x == top[group])
            back[nodes[group[equal[::-1]]]] = lo + equal[::-1]  # the first of equals is written last
        words, edges, at = [], [], np.arange(len(self.first))
        node = self.last.copy()
        while len(at):
            more = node > self.first[at]
            at, node = at[more], node[more]
            edge = back[node]
            words.append(at)
            edges.append(edge)
            node = self.source[edge]
        word, edge = np.concatenate(words[::-1]), np.concatenate(edges[::-1])
        order = np.argsort(word, kind="stable")
        word, edge = word[order], edge[order]
        piece, char = self.piece[edge], self.from_char[edge]
        width = np.where(piece >= 0, 1, np.append(self.char[1:], len(self.s))[char] - self.char[char])
        ids = np.repeat(piece, width)
        loose = ids < 0  # bytes of characters that are no piece
        nth = np.arange(len(ids)) - np.repeat(np.cumsum(width) - width, width)
        where = np.repeat(self.char[char], width) + nth
        ids[loose] = byte_ids[self.s[where[loose]]]
        return ids.astype(np.int32), np.bincount(word, width, minlength=len(self.first)).astype(np.int64)


def _segments(level: np.ndarray, node: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of sorted edges, by level: their range, where each node's begin in it, and the nodes."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(level)) + 1, [len(level)]]).tolist()
    out = []
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            part = node[lo:hi]
            firsts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            out.append((lo, hi, firsts, part[firsts]))
    return out


def _log_sums(x: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    top = np.maximum.reduceat(x, firsts)
    sizes = np.diff(np.append(firsts, len(x)))
    return top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, sizes)), firsts))
