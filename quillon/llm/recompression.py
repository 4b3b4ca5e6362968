"""Locally consistent naming of word sequences by recompression, inside one task."""

from __future__ import annotations

import numpy as np

from .words import Words, mix, spans

#: Pair rounds. A symbol of round k has at most 2**k words if no word repeats in a row;
#: a window of w words keeps a symbol inside it when w > 2 * 2**ROUNDS.
ROUNDS = 4
_SIDE = [np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_LEFT, _RIGHT = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F)
_DIGEST_1, _DIGEST_2 = 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D


class Tokens:
    """Word names of some texts, and 128-bit digests of any word ranges."""

    def __init__(self, texts: list[bytes]):
        self.words = Words(texts)
        self.token, self.second = (np.ascontiguousarray(x) for x in self.words.names().T)

    def digests(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return spans(self.token, _DIGEST_1, starts, ends), spans(self.second, _DIGEST_2, starts, ends)


class Parse(Tokens):
    """Names of the words' runs and pairs after all rounds, and for each window of `width`
    words its anchor: the longest symbol that any occurrence of that window must hold.

    Runs of one word become one name, then in each round every symbol falls left or right by
    a bit of its name, and each left symbol followed by a right one becomes one name. Whether
    two symbols join depends on the two alone, so equal word sequences get equal symbols apart
    from a few at their ends. `low` and `high` follow, window by window, what is certain.
    """

    def __init__(self, texts: list[bytes], width: int, rounds: int = ROUNDS):
        super().__init__(texts)
        w, n, self.width = self.words, len(self.words), width
        owner = w.owner()
        # windows: one for each start that leaves width words in its text
        stop = w.first[1:][owner] if n else np.zeros(0, dtype=np.int64)
        self.at = np.flatnonzero(np.arange(n) + width <= stop)
        if not len(self.at):
            self.anchor = self.at
            return
        # token runs
        new = np.ones(n, dtype=bool)
        new[1:] = (self.token[1:] != self.token[:-1]) | (owner[1:] != owner[:-1])
        head = np.flatnonzero(new)
        edge = np.append(head, n)
        run = np.diff(edge)
        name = np.where(run > 1, mix(self.token[head] * _LEFT + run.astype(np.uint64)), self.token[head])
        who = owner[head]
        which = np.cumsum(new) - 1
        low, high = edge[which[self.at] + 1], head[which[self.at + width - 1]]
        # pairs
        for k in range(rounds):
            right = (mix(name ^ _SIDE[k % len(_SIDE)]) >> np.uint64(40)).astype(np.uint8) & 1 == 1
            joint = np.zeros(len(name), dtype=bool)
            joint[:-1] = ~right[:-1] & right[1:] & (who[:-1] == who[1:])
            to_low, to_high = np.arange(n + 1), np.arange(n + 1)
            to_low[edge[:-1][right]] = edge[1:][right]
            to_high[edge[1:][~right]] = edge[:-1][~right]
            sure = low < high
            low = np.where(sure, to_low[low], low)
            sure &= low < high
            high = np.where(sure, to_high[high], high)
            keep = np.ones(len(name), dtype=bool)
            keep[1:] = ~joint[:-1]
            pair = np.flatnonzero(joint)
            name[pair] = mix(name[pair] * _LEFT + (name[pair + 1] ^ _SIDE[k % len(_SIDE)]) * _RIGHT)
            name, who, edge = name[keep], who[keep], np.append(edge[:-1][keep], n)
        self.name, self.edge = name, edge
        self._choose(low, high)

    def _choose(self, low: np.ndarray, high: np.ndarray) -> None:
        """The longest sure symbol of each window; of equally long ones the smallest name, then the first.
        -1 if none is sure, as in windows of hardly more than one repeated word."""
        n = len(self.words)
        index = np.zeros(n + 1, dtype=np.int32)
        index[self.edge] = np.arange(len(self.edge), dtype=np.int32)
        a, b = index[low], index[np.maximum(high, low)]
        length = np.minimum(np.diff(self.edge), 63).astype(np.uint64)
        rank = (length << np.uint64(58)) | (~self.name >> np.uint64(6))
        best, table = np.arange(len(rank), dtype=np.int32), []
        table.append(best)
        for k in range(1, max(1, int((b - a).max(initial=1))).bit_length()):
            step = 1 << (k - 1)
            x = table[-1][: len(table[-1]) - step]
            y = table[-1][step:]
            table.append(np.where(rank[y] > rank[x], y, x))
        size = np.maximum(b - a, 1)
        level = np.frexp(size.astype(np.float64))[1] - 1
        self.anchor = np.full(len(a), -1, dtype=np.int64)
        sure = (low < high) & (b > a)
        for k, best in enumerate(table):
            at = np.flatnonzero(sure & (level == k))
            x, y = best[a[at]], best[b[at] - (1 << k)]
            self.anchor[at] = np.where(rank[y] > rank[x], y, x)

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Neighbouring windows of one anchor: (symbol, context, first word, windows, weight) each.

        `context` digests every word that these windows cover and where the anchor lies, so equal
        contexts hold equal windows at equal places. Windows with no anchor stand for themselves;
        equal ones in a row, as in a long run of a word, make one stretch that weighs as many.
        """
        if not len(self.at):
            none = np.zeros(0, dtype=np.int64)
            return none.view(np.uint64), none.view(np.uint64), none, none, none
        alone = self.anchor < 0
        new = np.ones(len(self.at), dtype=bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.at[1:] != self.at[:-1] + 1)
        lone = np.flatnonzero(alone)
        if len(lone):
            own, _ = self.digests(self.at[lone], self.at[lone] + self.width)
            new[lone[1:]] |= (own[1:] != own[:-1]) | (lone[1:] != lone[:-1] + 1)
        head = np.flatnonzero(new)
        count = np.diff(np.append(head, len(self.at)))
        lead, first = alone[head], self.at[head]
        last = np.where(lead, first, first + count - 1)
        one, two = self.digests(first, last + self.width)
        at = np.maximum(self.anchor[head], 0)
        symbol = np.where(lead, one, self.name[at])
        context = np.where(lead, two, mix(one ^ (two + (self.edge[at] - first).astype(np.uint64))))
        return symbol, context, first, count, np.where(lead, count, 1)
