"""A lexicon of words with id outputs as a minimal acyclic automaton, and the exact merging of words outside it.

Words are byte strings. Their automaton shares suffixes as well as prefixes: states with equal futures are one. A word's number is
the sum of the counts along its path (how many words branch off before it), and its ids stand at that number, so the
automaton is a transducer though its suffixes are shared. It is laid out as a double array in a few flat files that every
worker maps into memory; many words walk through it in step, one byte at a time.
"""

from __future__ import annotations

import base64
import heapq
import json
import os
from dataclasses import dataclass

import numpy as np


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a byte-level BPE: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of ``word`` by byte pair encoding: again and again the adjacent pair of least rank, leftmost first, is merged.

    A heap of candidate pairs over a linked list, so a word of n bytes takes n log n steps.
    """
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    end = list(range(1, n + 1))  # where the part that begins here ends
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = []
    for i in range(n - 1):
        rank = ranks.get(word[i : i + 2])
        if rank is not None:
            heap.append((rank, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i]:
            continue
        j = end[i]
        if j >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            rank = ranks.get(word[i : end[stop]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[stop]))
        p = before[i]
        if p >= 0:
            rank = ranks.get(word[p:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, p, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class _State:
    __slots__ = ("edges", "final", "count", "name")

    def __init__(self) -> None:
        self.edges: dict[int, _State] = {}
        self.final = False
        self.count = -1
        self.name = -1


def minimal_automaton(words: list[bytes]) -> _State:
    """The minimal acyclic automaton of sorted, distinct ``words``, built word by word."""
    root = _State()
    known: dict[tuple, _State] = {}
    path: list[tuple[_State, int, _State]] = []
    last = b""

    def settle(depth: int) -> None:
        while len(path) > depth:
            parent, byte, child = path.pop()
            key = (child.final, *[(b, id(s)) for b, s in child.edges.items()])
            same = known.get(key)
            if same is None:
                known[key] = child
            else:
                parent.edges[byte] = same

    for word in words:
        if word <= last and last:
            raise ValueError("words must be sorted and distinct")
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        settle(common)
        state = path[-1][2] if path else root
        for byte in word[common:]:
            child = _State()
            state.edges[byte] = child
            path.append((state, byte, child))
            state = child
        state.final = True
        last = word
    settle(0)
    return root


def _states(root: _State) -> list[_State]:
    out, todo = [], [root]
    root.name = 0
    while todo:
        s = todo.pop()
        out.append(s)
        for child in s.edges.values():
            if child.name < 0:
                child.name = 0
                todo.append(child)
    return out


def _count(root: _State) -> None:
    """How many words every state accepts."""
    stack = [(root, False)]
    while stack:
        s, ready = stack.pop()
        if s.count >= 0:
            continue
        if ready:
            s.count = int(s.final) + sum(c.count for c in s.edges.values())
        else:
            stack.append((s, True))
            stack += [(c, False) for c in s.edges.values() if c.count < 0]


@dataclass
class Lexicon:
    """The automaton: the edge of state s by byte b is slot base[s] + b if check there is s; then target and skip belong to it."""

    base: np.ndarray
    check: np.ndarray
    target: np.ndarray
    skip: np.ndarray
    final: np.ndarray
    ids: np.ndarray
    start: np.ndarray

    FILES = ("base", "check", "target", "skip", "final", "ids", "start")

    @classmethod
    def compile(cls, entries: dict[bytes, list[int]]) -> Lexicon:
        """The lexicon of words and their ids; words are not empty."""
        words = sorted(w for w in entries if w)
        root = minimal_automaton(words)
        states = _states(root)
        _count(root)
        states.sort(key=lambda s: -len(s.edges))
        states.remove(root)
        states.insert(0, root)
        for i, s in enumerate(states):
            s.name = i
        size = 256 + sum(len(s.edges) for s in states) * 2 + 1024
        base = np.zeros(len(states), np.int32)
        check = np.full(size, -1, np.int32)
        target = np.zeros(size, np.int32)
        skip = np.zeros(size, np.int32)
        free_from = 0
        taken = bytearray(size)
        for s in states:
            if not s.edges:
                continue
            labels = sorted(s.edges)
            low = labels[0]
            at = taken.find(0, free_from)
            if len(labels) <= 2:
                free_from = at
            tries = 0
            while True:
                b = at - low
                if b + 255 >= size:
                    grow = size // 2 + 1024
                    taken.extend(bytes(grow))
                    check = np.append(check, np.full(grow, -1, np.int32))
                    target, skip = np.append(target, np.zeros(grow, np.int32)), np.append(skip, np.zeros(grow, np.int32))
                    size += grow
                if b >= 0 and all(not taken[b + x] for x in labels):
                    break
                at = taken.find(0, at + 1)
                if at < 0:
                    at = size
                tries += 1
                if tries == 400 and len(labels) > 2:
                    free_from = max(free_from, at - 512)
            base[s.name] = b
            before = int(s.final)
            for x in labels:
                child = s.edges[x]
                taken[b + x] = 1
                check[b + x], target[b + x], skip[b + x] = s.name, child.name, before
                before += child.count
        final = np.array([s.final for s in states], bool)
        lists = [entries[w] for w in words]
        start = np.zeros(len(lists) + 1, np.int64)
        np.cumsum([len(x) for x in lists], out=start[1:])
        ids = np.array([i for x in lists for i in x], np.int32)
        return cls(base, check, target, skip, final, ids, start)

    def save(self, folder: str) -> None:
        """Write the arrays as files; the manifest comes last and marks them complete."""
        os.makedirs(folder, exist_ok=True)
        for name in self.FILES:
            np.save(f"{folder}/{name}.npy", getattr(self, name))
        with open(f"{folder}/manifest.json", "w") as f:
            json.dump({"words": len(self.start) - 1, "states": len(self.base)}, f)

    @classmethod
    def load(cls, folder: str) -> Lexicon:
        """Map the files into memory; workers of one machine share the pages."""
        if not os.path.exists(f"{folder}/manifest.json"):
            raise FileNotFoundError(f"no complete lexicon in {folder}")
        return cls(*[np.load(f"{folder}/{name}.npy", mmap_mode="r") for name in cls.FILES])

    def numbers(self, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """The number of each word (bytes between consecutive borders), or -1 for a word outside the lexicon."""
        n = len(borders) - 1
        size = np.diff(borders)
        number = np.full(n, -1, np.int64)
        at = borders[:-1].copy()
        left = size.copy()
        index = np.flatnonzero(left > 0)
        at, left = at[index], left[index]
        state = np.zeros(len(index), np.int32)
        total = np.zeros(len(index), np.int64)
        base, check, target, skip, final = (np.asarray(x) for x in (self.base, self.check, self.target, self.skip, self.final))
        while len(index):
            slot = base[state] + data[at]
            ok = check[slot] == state
            total += skip[slot]
            state = target[slot]
            at += 1
            left -= 1
            over = left == 0
            done = ok & over
            hit = done & final[state]
            number[index[hit]] = total[hit]
            go = ok & ~over
            index, state, total, at, left = index[go], state[go], total[go], at[go], left[go]
        return number
