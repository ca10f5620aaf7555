"""Byte-pair encoding by a trie of words whose nodes hold the last token of their prefix.

For a fixed merge list the encoding of a byte string is determined by the last token of each of its prefixes: the
encoding of a prefix is that last token, preceded by the encoding of what stands before it. A token ``t`` that is a
suffix of the prefix is its last token exactly if ``t`` is compatible with the last token of the part before it, that
is, if encoding the two tokens' bytes together gives those two tokens again. So one state (a token id) for each node of
a trie of words is enough, and words that share a prefix share its states. Words are inserted in sorted order, which
visits the trie depth first.
"""

from __future__ import annotations

import gc
import json
import re
import struct
from array import array

import regex

#: The split pattern of the byte-level vocabulary.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A run of text that can be split on its own: the pattern above never crosses from a non-space to a following space.
#: Only plain spaces open a new run, as the libraries differ about the rarer ones.
_RUN = re.compile(r"\s*\S+(?:(?![ \t\r\n])\s+\S*)*|\s+")

_BETWEEN_RUNS = re.compile(r"(?<=\S)[ \t\r\n]")

#: Characters taken apart at once.
AT_ONCE = 2_000_000

#: Words longer than this leave no nodes in the trie, so that it can't fill with texts without spaces. They are visited in
#: the same order, and the states of a prefix shared with the one before are taken from there.
LONGEST_KEPT_WORD = 64


def _shared_prefix(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:  # a[:low] == b[:low] holds
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _byte_names() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes for themselves, the rest from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _cut(text: str, most: int) -> list[str]:
    """The text in parts of about ``most`` characters that end between two runs; one part if there is no such place."""
    parts, start = [], 0
    while len(text) - start > most and (cut := _BETWEEN_RUNS.search(text, start + most)):
        parts.append(text[start : cut.start()])
        start = cut.start()
    parts.append(text[start:] if start else text)
    return parts


class TrieEncoder:
    """Encodes texts by the vocabulary file ``path`` (JSON with ``model.vocab`` and ``model.merges``).

    Caches are memos only: emptying them when they reach ``most_cached`` entries changes no result.
    """

    def __init__(self, path: str, most_cached: int = 400_000):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        names = _byte_names()
        ids: dict[str, int] = model["vocab"]
        raw = {name: bytes(names[c] for c in name) for name in ids if all(c in names for c in name)}
        self.id_of: dict[bytes, int] = {raw[name]: i for name, i in ids.items() if name in raw}
        self.bytes_of: dict[int, bytes] = {i: b for b, i in self.id_of.items()}
        self._made: dict[int, tuple[int, int, int]] = {}  # token: (rank, left part, right part)
        self._rank: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, whole = ids[left], ids[right], ids[left + right]
            self._rank[a, b] = rank
            self._made.setdefault(whole, (rank, a, b))
        self._right: dict[int, list[tuple[int, float]]] = {}
        self._left: dict[int, list[tuple[int, float]]] = {}
        # Suffixes of tokens as an automaton read backwards: (state << 8 | byte) -> state; a state may end a token.
        self._back: dict[int, int] = {}
        self._ends: list[int] = [-1]
        for token, i in self.id_of.items():
            at = 0
            for byte in reversed(token):
                key = at << 8 | byte
                at = self._back.get(key, 0)
                if not at:
                    at = self._back[key] = len(self._ends)
                    self._ends.append(-1)
            self._ends[at] = i
        self._length = {i: len(b) for b, i in self.id_of.items()}
        self._split = regex.compile(SPLIT_PATTERN)
        self._most = most_cached
        self._runs: dict[str, bytes] = {}
        self._clear_trie()

    def _clear_trie(self) -> None:
        self._pairs: dict[int, bool] = {}
        self._words: dict[str, bytes] = {}
        self._child: dict[int, int] = {}
        self._last: list[int] = [-1]  # by trie node: the last token of its prefix
        self._before: list[int] = [0]  # by trie node: the node where that token starts

    def _edge(self, token: int, right: bool) -> list[tuple[int, float]]:
        """The tokens that stand at one edge of ``token`` while it is merged, each with the rank at which it is used up."""
        known = self._right if right else self._left
        found = known.get(token)
        if found is None:
            found, until, at = [], float("inf"), token
            while True:
                found.append((at, until))
                if at not in self._made:
                    break
                until, a, b = self._made[at]
                at = b if right else a
            known[token] = found
        return found

    def _compatible(self, first: int, second: int) -> bool:
        """Whether no merge ever crosses from ``first`` to ``second``; of equal ranks the leftmost merge comes first."""
        key = first << 20 | second
        known = self._pairs.get(key)
        if known is None:
            known, ranks = True, self._rank
            for x, x_until in self._edge(first, True):
                for y, y_until in self._edge(second, False):
                    rank = ranks.get((x, y))
                    if rank is not None and rank < x_until and rank <= y_until:
                        known = False
            self._pairs[key] = known
        return known

    def _last_token(self, word: bytes, end: int, last: list[int]) -> int:
        """The last token of ``word[:end]``; ``last[i]`` is that of ``word[:i]``."""
        back, ends, at, i = self._back, self._ends, 0, end
        found = []
        while i:
            at = back.get(at << 8 | word[i - 1], 0)
            if not at:
                break
            i -= 1
            if ends[at] >= 0:
                found.append((i, ends[at]))
        for i, token in reversed(found):
            if not i or self._compatible(last[i], token):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def _follow(self, word: bytes, last: list[int]) -> bytes:
        """The encoding of one word from the states of a prefix of it; ``last`` becomes the states of all its prefixes."""
        for end in range(len(last), len(word) + 1):
            last.append(self._last_token(word, end, last))
        at, out = len(word), []
        while at:
            out.append(last[at])
            at -= self._length[last[at]]
        return struct.pack(f"<{len(out)}i", *reversed(out))

    def learn(self, words: list[str]) -> None:
        """Puts the encodings of distinct words into the memo, visiting the trie depth first.

        The loop over new nodes repeats ``_last_token`` in line: it is nearly all of the work.
        """
        child, lasts, befores, length = self._child, self._last, self._before, self._length
        back, ends, pairs, known, compatible = self._back.get, self._ends, self._pairs.get, self._words, self._compatible
        path, states, previous = [0], [-1], b""
        long_word, long_states = b"", [-1]
        collecting = gc.isenabled()
        gc.disable()  # nothing here makes cycles
        for word, raw in sorted((w.encode("utf-8", "replace"), w) for w in words):
            size = len(word)
            if size > LONGEST_KEPT_WORD:
                del long_states[_shared_prefix(word, long_word) + 1 :]
                known[raw] = self._follow(word, long_states)
                long_word = word
                continue
            if previous[: len(path) - 1] == word[: len(path) - 1]:
                shared = len(path) - 1
            else:
                shared = 0
                for x, y in zip(word, previous):
                    if x != y:
                        break
                    shared += 1
                del path[shared + 1 :], states[shared + 1 :]
            previous = word
            at_end = path[-1]
            for end in range(shared, size):
                key = at_end << 8 | word[end]
                node = child.get(key)
                if node is None:
                    at, i, found = 0, end, []
                    while i >= 0 and (at := back(at << 8 | word[i], 0)):
                        if (token := ends[at]) >= 0:
                            found.append(token)
                        i -= 1
                    while True:
                        token = found.pop()
                        start = end + 1 - length[token]
                        if not start or ((fits := pairs(states[start] << 20 | token)) is None and compatible(states[start], token)) or fits:
                            break
                    node = child[key] = len(lasts)
                    lasts.append(token)
                    befores.append(path[start])
                path.append(node)
                states.append(lasts[node])
                at_end = node
            node, out = at_end, []
            while node:
                out.append(lasts[node])
                node = befores[node]
            out.reverse()
            known[raw] = array("i", out).tobytes()
        if collecting:
            gc.enable()

    def encode_batch(self, texts: list[str | None], most_characters: int = AT_ONCE) -> list[bytes]:
        """The ids of each text as packed 32-bit integers; empty for empty and for null texts.

        About ``most_characters`` are taken apart at once, longer texts in parts that end between two runs.
        """
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, str]] = []
        size = 0
        for i, text in enumerate(texts):
            for part in _cut(text, most_characters) if text else ():
                waiting.append((i, part))
                size += len(part)
                if size >= most_characters:
                    self._encode(waiting, out)
                    waiting, size = [], 0
        self._encode(waiting, out)
        return [own[0] if len(own) == 1 else b"".join(own) for own in out]

    def _encode(self, parts: list[tuple[int, str]], out: list[list[bytes]]) -> None:
        runs = [_RUN.findall(part) for _, part in parts]
        cache = self._runs
        if len(cache) > self._most:
            cache.clear()
        if len(self._words) > self._most:
            self._clear_trie()
        new = {run for own in runs for run in own if run not in cache}
        if new:
            split, known = self._split.findall, self._words
            words = {run: split(run) for run in new}
            unseen = {w for own in words.values() for w in own if w not in known}
            if unseen:
                self.learn(list(unseen))
            for run, own in words.items():
                cache[run] = b"".join([known[w] for w in own])
        get = cache.__getitem__
        for (i, _), own in zip(parts, runs):
            out[i].append(b"".join(map(get, own)))


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """One encoder a worker process, kept for its later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]
