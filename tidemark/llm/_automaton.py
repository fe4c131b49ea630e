"""Minimal acyclic automata with word numbers, built and walked by arrays.

Words are rows of letter codes from 1, padded with 0. The trie of the sorted words is
read off the letters that neighbours share; its nodes are merged from the leaves up, by
height, for nodes of equal right language are equally high. A node's signature is folded
over its edges with exact renaming, so no two languages are ever taken for one. Each edge
carries the number of words that leave its state before it: the sum along a word is its
number, the row of the word among the sorted ones.
"""

from __future__ import annotations

import numpy as np


def code_matrix(words: list[str], alphabet: np.ndarray) -> np.ndarray:
    """Rows of letter codes, padded with 0; ``alphabet`` holds all code points in order."""
    width = max(map(len, words))
    points = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)
    return np.where(points > 0, np.searchsorted(alphabet, points) + 1, 0).astype(np.int32)


class Automaton:
    """The minimal automaton of distinct words given as sorted rows of codes below ``letters``."""

    def __init__(self, rows: np.ndarray, letters: int):
        n, width = rows.shape
        self.letters = letters
        differs = rows[1:] != rows[:-1]
        shared = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        lengths = (rows > 0).sum(axis=1)
        # nodes of the trie, depth after depth: the first row of each prefix stands for it
        ids = np.zeros(n, np.int64)
        total, parents, chars, depths, final = 1, [np.array([-1])], [np.array([0])], [np.array([0])], [np.zeros(1, bool)]
        for depth in range(1, width + 1):
            fresh = np.append(True, shared < depth) & (lengths >= depth)
            at = np.flatnonzero(fresh)
            if not len(at):
                break
            parents.append(ids[at])
            chars.append(rows[at, depth - 1])
            depths.append(np.full(len(at), depth))
            final.append(lengths[at] == depth)  # the shortest word of a prefix is sorted first
            numbers = np.cumsum(fresh) - 1 + total
            ids = np.where(lengths >= depth, numbers, ids)
            total += len(at)
        parent, char, depth_of, ends = (np.concatenate(x) for x in (parents, chars, depths, final))
        height = np.zeros(total, np.int64)
        for depth in range(int(depth_of[-1]), 0, -1):
            a, b = np.searchsorted(depth_of, [depth, depth + 1])
            np.maximum.at(height, parent[a:b], height[a:b] + 1)
        children = np.lexsort((char[1:], parent[1:])) + 1
        first = np.searchsorted(parent[children], np.arange(total + 1))
        state = np.full(total, -1, np.int64)
        self.final: np.ndarray = np.zeros(0, bool)
        kept = []
        for level in range(int(height.max()) + 1):
            nodes = np.flatnonzero(height == level)
            signs = ends[nodes].astype(np.int64)
            degree = first[nodes + 1] - first[nodes]
            for e in range(int(degree.max())):
                has = np.flatnonzero(degree > e)
                child = children[first[nodes[has]] + e]
                _, edge = np.unique(state[child] * letters + char[child], return_inverse=True)
                _, renamed = np.unique(signs[has] * (int(edge.max()) + 1) + edge, return_inverse=True)
                signs[has] = renamed + int(signs.max()) + 1  # apart from nodes of fewer edges
            _, at, where = np.unique(signs, return_index=True, return_inverse=True)
            state[nodes] = where + len(self.final)
            kept.append(nodes[at])
            self.final = np.append(self.final, ends[nodes[at]])
        self.root = int(state[0])
        made = np.concatenate(kept)  # a node of the trie for each state, low ones first
        degree = first[made + 1] - first[made]
        self.first = np.append(0, np.cumsum(degree))
        edges = children[np.repeat(first[made] - self.first[:-1], degree) + np.arange(int(degree.sum()))]
        self.targets, self.chars = state[edges], char[edges].astype(np.int64)
        self.keys = np.repeat(np.arange(len(made)), degree) * letters + self.chars
        # words of each state, low states first, and words before each edge
        words, before = self.final.astype(np.int64), np.zeros(len(edges), np.int64)
        heights = height[made]
        for level in range(1, int(heights.max()) + 1):
            a, b = np.searchsorted(heights, [level, level + 1])
            x, y = self.first[a], self.first[b]
            counts = words[self.targets[x:y]]
            sums = np.append(0, np.cumsum(counts))
            starts = np.repeat(self.first[a:b] - x, degree[a:b])
            before[x:y] = sums[:-1] - sums[starts] + np.repeat(self.final[a:b], degree[a:b])
            words[a:b] += sums[self.first[a + 1 : b + 1] - x] - sums[self.first[a:b] - x]
        self.before, self.size = before, int(words[self.root])

    def step(self, states: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of those that go on, their states, words passed by) for a letter of each state."""
        wanted = states * self.letters + codes
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        on = np.flatnonzero((self.keys[at] == wanted) & (codes > 0)) if len(self.keys) else np.zeros(0, np.int64)
        return on, self.targets[at[on]], self.before[at[on]]

    def fan(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, letter, state, words passed by) for every edge of every state."""
        degree = self.first[states + 1] - self.first[states]
        place = np.repeat(np.arange(len(states)), degree)
        edge = np.repeat(self.first[states] - np.append(0, np.cumsum(degree))[:-1], degree) + np.arange(len(place))
        return place, self.chars[edge], self.targets[edge], self.before[edge]

    def one_error(self, asked: np.ndarray, exact: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``asked``, word number) of all words with one error in letters ``exact`` to ``end`` of a row.

        All rows have one length. The letters before and after are met exactly; a letter
        inserted at ``end`` counts. Pairs are distinct and in order.
        """
        rows = np.arange(len(asked))
        states, numbers = np.full(len(asked), self.root), np.zeros(len(asked), np.int64)
        off = [np.zeros(0, np.int64)] * 3  # rows that have had their error: row, state, number
        for at in range(asked.shape[1] + 1):
            more = []
            if exact <= at <= end and len(rows):
                place, code, target, passed = self.fan(states)
                more.append((rows[place], target, numbers[place] + passed))  # a letter was inserted before this one
                if at < end:
                    other = code != asked[rows[place], at]
                    late = [(rows[place][other], target[other], (numbers[place] + passed)[other]), (rows, states, numbers)]
            if more:
                off = [np.concatenate(x) for x in zip(off, *more)]
            if at == asked.shape[1]:
                break
            on, target, passed = self.step(off[1], asked[off[0], at])
            off = [off[0][on], target, off[2][on] + passed]
            if exact <= at < end and len(rows):
                off = [np.concatenate(x) for x in zip(off, *late)]  # this letter was replaced or deleted
            on, target, passed = self.step(states, asked[rows, at])
            rows, states, numbers = rows[on], target, numbers[on] + passed
        ends = self.final[off[1]]
        pairs = np.unique(off[0][ends] * (self.size + 1) + off[2][ends])
        return pairs // (self.size + 1), pairs % (self.size + 1)
