"""Prefix encoding of byte-pair vocabularies.

A sequence of tokens is what the merges give exactly if every adjacent pair is
stable, that is if merging the two tokens' symbols afresh gives the same two
tokens.  So the encoding of a prefix is the encoding of a shorter prefix plus one
token that is stable after its last token, and exactly one such token exists.
A forward pass over positions finds it for every prefix of a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

PAIR_LIMIT = 500_000
NEVER = float("inf")
Rank = Callable[[str, str], "float | None"]


class Recent(dict):
    """A cache of at most two generations of entries; results never depend on it."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def put(self, key, value):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def known(self, keys: set) -> dict:
        """The entries of those keys that have one."""
        here = keys & self.keys()
        out = dict(zip(here, map(self.__getitem__, here)))
        old = self.old  # putting an entry may begin a new generation
        for key in (keys - here) & old.keys():
            out[key] = self.put(key, old[key])
        return out

    def find(self, key):
        value = self.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value


def merge(symbols: list[str], rank: Rank) -> tuple[list[str], list[tuple[str, float, bool, bool]]]:
    """Join the adjacent pair of lowest rank, leftmost first, until none has a rank.

    Returns the tokens, and the joins in their order: token, rank, at the left end, at the right end.
    """
    ranks = [rank(a, b) for a, b in zip(symbols, symbols[1:])]
    joins = []
    while (best := min((r for r in ranks if r is not None), default=None)) is not None:
        i = ranks.index(best)
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        joins.append((symbols[i], best, i == 0, i == len(symbols) - 1))
        del ranks[i]
        if i < len(ranks):
            ranks[i] = rank(symbols[i], symbols[i + 1])
        if i:
            ranks[i - 1] = rank(symbols[i - 1], symbols[i])
    return symbols, joins


def common_start(a: str, b: str) -> int:
    """The number of characters that two words begin with alike."""
    if b.startswith(a):
        return len(a)
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class Forward:
    """The forward pass over words for one vocabulary and its merge ranks."""

    def __init__(self, vocab: Iterable[str], rank: Rank):
        self.vocab, self.rank = frozenset(vocab), rank
        self.reach: dict[str, int] = {}  # the longest token that ends in three characters
        for t in self.vocab:
            self.reach[t[-3:]] = max(self.reach.get(t[-3:], 2), len(t))
        self.edges: dict[str, tuple] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def edge(self, token: str) -> tuple:
        """The tokens that stand at the right and the left end of a token while it is merged.

        Each with the ranks at which it appears and is joined further.
        """
        out = self.edges.get(token)
        if out is None:
            _, joins = merge([*token], self.rank)
            right, left = [[token[-1], -1.0, NEVER]], [[token[0], -1.0, NEVER]]
            now = -1.0
            for joined, r, at_left, at_right in joins:
                now = max(now, r)
                for end, here in ((left, at_left), (right, at_right)):
                    if here:
                        end[-1][2] = now
                        end.append([joined, now, NEVER])
            if right[-1][0] != token:  # the merges never make this token
                right = left = None
            out = self.edges[token] = (right, left)
        return out

    def stable(self, a: str, b: str) -> bool:
        """Whether the pair survives merging."""
        right, left = self.edge(a)[0], self.edge(b)[1]
        rank = self.rank
        if right is None or left is None:
            return merge([*a, *b], rank)[0] == [a, b]
        for x, x_from, x_to in right:
            for y, y_from, y_to in left:
                r = rank(x, y)
                if r is None:
                    continue
                if r <= x_from or r <= y_from or r == x_to or r == y_to:  # joined out of order or at the same rank: merge to see
                    return merge([*a, *b], rank)[0] == [a, b]
                if r < x_to and r < y_to:
                    return False
        return True

    def extend(self, word: str, last: list[str], counts: list[int]) -> None:
        """Continue over word from the prefix that last and counts cover.

        last[i] is the last token of the encoding of word[:i], counts[i] its number of
        tokens.  A character outside the vocabulary stands for itself.
        """
        vocab, pairs, reach = self.vocab, self.pairs, self.reach.get
        if len(pairs) > PAIR_LIMIT:
            pairs.clear()
        known, add, count = pairs.get, last.append, counts.append
        for i in range(len(last), len(word) + 1):
            # The likeliest token goes first; only one is stable, so the order does not matter.
            first = i - 1 - len(last[-1])
            token = word[first:i]
            if i > 1 and token in vocab:
                if not first:
                    add(token)
                    count(1)
                    continue
                pair = (last[first], token)
                ok = known(pair)
                if ok is None:
                    ok = pairs[pair] = self.stable(*pair)
                if ok:
                    add(token)
                    count(counts[first] + 1)
                    continue
            for start in range(i - 1, max(0, i - reach(word[max(0, i - 3) : i], 2)) - 1, -1):
                token = word[start:i]
                if start < i - 1 and token not in vocab:
                    continue
                if start:
                    pair = (last[start], token)
                    ok = known(pair)
                    if ok is None:
                        ok = pairs[pair] = self.stable(*pair)
                    if not ok:
                        continue
                add(token)
                count(counts[start] + 1)
                break
            else:
                raise ValueError(f"no stable token ends at {i} of {word!r}")

    def walk(self, words: Iterable[str]) -> Iterator[tuple[str, list[str], list[int]]]:
        """Every distinct word with its forward states, in sorted order.

        Sorted words are a trie in depth-first order: each keeps the states of the
        prefix that it shares with the word before it.  The lists are reused.
        """
        before, last, counts = "", [""], [0]
        for word in sorted(set(words)):
            shared = common_start(before, word)
            del last[shared + 1 :], counts[shared + 1 :]
            self.extend(word, last, counts)
            yield word, last, counts
            before = word
