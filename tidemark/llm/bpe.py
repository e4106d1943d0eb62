"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding as a byte-to-text state machine.

Symbols are read from left to right. The encoding of each beginning of a word is the encoding of a shorter beginning and one token more:
of the tokens that end at a place there is one which no merge joins or splits across its edge with the token before it. So a place
needs its last token only, and the encodings of all beginnings form a tree. The state is the part of this tree that a later symbol
can still hang on: the places from which some token may go on beyond the symbols read. What all of them descend from is stable and is
emitted at once, in ordinary words mostly a few symbols behind.

How much can be held at most: let what follows a text change. The merges on both sides of the change differ first in one that crosses
its edge. Each further difference to the left is a merge of a later rank whose right part begins, as a string, with the left part of
the one before, and moves the edge by the length of its own left part. So the longest such chain through the list, weighted by the
lengths of left parts, bounds how far a change reaches: that is the merge list's sufficient lookahead, and memory is constant. It
presumes that each part of a merge was made by an earlier one.

The query runs the same transducer over many words at once, one symbol of each at a time, with arrays for states.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import Remembered, prepare, tidy

#: Words of more symbols than this are read one by one, others many at once.
ABREAST = 48
NEVER = 1 << 30


def byte_symbols() -> list[str]:
    """Byte-level vocabularies write a printable byte as its Latin-1 character and the others as the characters from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Table:
    """Whole numbers by whole-number keys, for arrays of keys: each key has one slot, or, where that is taken, one in the next table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.levels, seed = [], 0x9E3779B97F4A7C15
        while len(keys):
            bits = max(4, (4 * len(keys)).bit_length())
            slot = self._slot(keys, seed, bits)
            _, first = np.unique(slot, return_index=True)
            held, told, full = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32), np.zeros(1 << bits, bool)
            held[slot[first]], told[slot[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            full[slot[rest]] = True
            self.levels.append((seed, bits, held, told, full))
            keys, values, seed = keys[rest], values[rest], (seed * 0xD1342543DE82EF95 + 2) % (1 << 64) | 1

    @staticmethod
    def _slot(keys: np.ndarray, seed: int, bits: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(seed)) >> np.uint64(64 - bits)).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        out, at = None, None
        for seed, bits, held, told, full in self.levels:
            slot = self._slot(keys, seed, bits)
            found = np.where(held[slot] == keys, told[slot], -1)
            if out is None:
                out = found
            else:
                out[at] = found
            more = np.flatnonzero((found < 0) & full[slot])
            if not len(more):
                break
            at, keys = more if at is None else at[more], keys[more]
        return out


class Transducer:
    """The tokenizer of a tokenizers JSON file of this kind: NFC, white space as one space, lower case; pieces by a pattern; byte-level
    BPE with an end-of-word suffix. Special tokens written in a text are taken as such.

    A symbol is a byte of a word in UTF-8, or 256 more than it for a word's last byte.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model = made["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.words = regex.compile(made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        symbols = byte_symbols()
        self.pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = np.zeros(max(self.vocab.values()) + 1, np.int32)
        for t, i in self.vocab.items():
            self.size[i] = len(t.removesuffix(self.suffix)) if self.suffix else len(t)
        self.longest = int(self.size.max())
        self.lookahead = self.sufficient_lookahead(self.pairs)
        self.texts = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        raw = {s: b for b, s in enumerate(symbols)}
        self.raw = {i: bytes(raw[c] for c in t.removesuffix(self.suffix)) + b" " * t.endswith(self.suffix) for t, i in self.vocab.items()}
        self._derivations(symbols)
        self._suffixes(symbols)

    def sufficient_lookahead(self, pairs: list[tuple[str, str]]) -> int:
        """The longest chain of differing merges, in symbols; ValueError if a part is used before it is made."""
        born: dict[str, int] = {}
        reach: dict[str, int] = {}  # left part -> longest chain that ends with a merge of that left part
        for rank, (a, b) in enumerate(pairs):
            for x in (a, b):
                if len(x.removesuffix(self.suffix)) > 1 and x not in born:
                    raise ValueError(f"{x!r} is merged before it is made")
            whole = b.removesuffix(self.suffix)
            chain = max([0, *(reach.get(b[:k], 0) for k in range(1, len(whole) + 1)), reach.get(b, 0)])
            reach[a] = max(reach.get(a, 0), chain + len(a))
            if a + b in born:
                raise ValueError(f"{a + b!r} is made in two ways")
            born[a + b] = rank
        return max(reach.values(), default=0)

    def _derivations(self, symbols: list[str]) -> None:
        """How each token is made: its parts and the rank of their merge (-1 for symbols); which tokens are ever made."""
        n, get = len(self.size), self.vocab.__getitem__
        self.left, self.right, self.born = np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32), np.full(n, -1, np.int32)
        a, b = (np.array([get(p[k]) for p in self.pairs], np.int64) for k in (0, 1))
        t = np.array([get(x + y) for x, y in self.pairs], np.int64)
        self.left[t], self.right[t], self.born[t] = a, b, np.arange(len(t))
        self.ranks = Table(a << 20 | b, np.arange(len(t), dtype=np.int32))
        self.of_symbol = np.array([get(s) for s in symbols] + [get(s + self.suffix) for s in symbols], np.int32)
        self.made = np.zeros(n, bool)
        self.made[self.of_symbol] = True
        alone = self._apart(a, b, np.arange(len(t), dtype=np.int64))
        for k, (x, y, z) in enumerate(zip(a.tolist(), b.tolist(), t.tolist(), strict=True)):
            self.made[z] = alone[k] and self.made[x] and self.made[y]
        self.seen_key, self.seen = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    def _apart(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether no merge of a rank below limit joins parts of neighbouring tokens x and y across their edge.

        Both are taken apart from their last merges back; at each state the parts at the edge must not have a merge before the next
        merge that uses one of them. Of one rank the leftmost merge is the first, so x's own merges go before a crossing one of their
        rank and y's behind it.
        """
        out, at = np.ones(len(x), bool), np.arange(len(x))
        while len(at):
            rank = self.ranks.get(x << 20 | y).astype(np.int64)
            crossed = (rank >= 0) & (rank < limit)
            out[at[crossed]] = False
            bx, by = self.born[x], self.born[y]
            more = np.flatnonzero(~crossed & ((bx >= 0) | (by >= 0)))
            at, x, y, bx, by, limit = at[more], x[more], y[more], bx[more], by[more], limit[more]
            first = bx > by
            limit = np.minimum(limit, np.where(first, bx, by + 1))
            x, y = np.where(first, self.right[x], x).astype(np.int64), np.where(first, y, self.left[y]).astype(np.int64)
        return out

    def neighbours(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether tokens x and y stay as they are side by side; pairs met lately are remembered."""
        key = x.astype(np.int64) << 20 | y
        slot = Table._slot(key, 0xC2B2AE3D27D4EB4F, 20)
        out = self.seen[slot]
        new = np.flatnonzero(self.seen_key[slot] != key)
        if len(new):
            k = key[new]
            out[new] = found = self._apart(k >> 20, k & 0xFFFFF, np.full(len(new), NEVER))
            self.seen_key[slot[new]], self.seen[slot[new]] = k, found
        return out

    def _symbols_of(self, symbols: list[str]) -> Iterator[tuple[int, list[int]]]:
        place = {s: b for b, s in enumerate(symbols)}
        for t, i in self.vocab.items():
            if self.made[i]:
                ends = bool(self.suffix) and t.endswith(self.suffix)
                out = [place[c] for c in (t.removesuffix(self.suffix) if ends else t)]
                out[-1] += 256 * ends
                yield i, out

    def _suffixes(self, symbols: list[str]) -> None:
        """A tree of the tokens read from their ends, and one of them read from their beginnings."""
        behind: dict[int, int] = {}
        self.ahead: dict[int, int] = {}
        ends, self.token_at, self.goes_on = [-1], {}, set()
        starts = 0
        for i, word in self._symbols_of(symbols):
            node = 0
            for s in reversed(word):
                node = behind.setdefault(node << 9 | s, len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = i
            node = 0
            for s in word:
                self.goes_on.add(node)
                node = self.ahead.setdefault(node << 9 | s, starts + 1)
                starts = max(starts, node)
            self.token_at[node] = i
        self.ends = np.array(ends, np.int32)
        self.behind = Table(np.array([*behind], np.int64), np.array([*behind.values()], np.int32))
        # the first two steps without a search
        self.one = np.array([behind[s] for s in range(512)], np.int32)
        self.two = np.full((512, 512), -1, np.int32)
        first = {n: s for s, n in enumerate(self.one.tolist())}
        for k, n in behind.items():
            if k >> 9 in first:
                self.two[first[k >> 9], k & 511] = n

    def tokens(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of many words in a row and how many each has: the bytes of all words, and where each begins (and the end)."""
        size = np.diff(starts)
        n = np.zeros(len(size), np.int64)
        short = np.flatnonzero(size <= ABREAST)
        short = short[np.argsort(-size[short], kind="stable")]
        found, last, steps = self._abreast(data, starts[short], size[short])
        n[short] = steps
        longer = {}
        for w in np.flatnonzero(size > ABREAST).tolist():
            longer[w] = list(self.stable(marked(data[starts[w] : starts[w + 1]].tobytes())))
            n[w] = len(longer[w])
        out, ends = np.empty(int(n.sum()), np.int32), np.cumsum(n)
        # from each word's end back, token by token
        at, place, row = size[short].copy(), ends[short] - 1, np.arange(len(short))
        while len(row):
            t = found[row, at]
            out[place] = t
            at = at - self.size[t]
            left = np.flatnonzero(at > 0)
            row, at, place = row[left], at[left], place[left] - 1
        for w, ids in longer.items():
            out[ends[w] - n[w] : ends[w]] = ids
        return out, n

    def _abreast(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For words in falling order of size: last token at each place, and numbers of tokens."""
        top = int(size[0]) if len(size) else 0
        last, steps = np.full((len(size), top + 1), -1, np.int32), np.zeros((len(size), top + 1), np.int16)
        symbol = np.zeros((len(size), top), np.int32)
        for i in range(top):
            n = int(np.searchsorted(-size, -i, side="left"))  # words that have a place i
            symbol[:n, i] = data[starts[:n] + i]
            symbol[:n, i] += 256 * (size[:n] == i + 1)
            row, node, hits = np.arange(n), self.one[symbol[:n, i]], []
            for k in range(1, min(i + 1, self.longest) + 1):
                token = self.ends[node]
                there = np.flatnonzero(token >= 0)
                hits.append((k, row[there], token[there]))
                if k > i:
                    break
                before = symbol[row, i - k]
                node = self.two[symbol[row, i], before] if k == 1 else self.behind.get(node.astype(np.int64) << 9 | before)
                alive = np.flatnonzero(node >= 0)
                row, node = row[alive], node[alive]
                if not len(row):
                    break
            for k, row, token in reversed(hits):
                open_ = np.flatnonzero(last[row, i + 1] < 0)
                if not len(open_):
                    continue
                row, token = row[open_], token[open_]
                if k <= i:
                    fits = np.flatnonzero(self.neighbours(last[row, i + 1 - k], token))
                    row, token = row[fits], token[fits]
                last[row, i + 1] = token
                steps[row, i + 1] = steps[row, i + 1 - k] + 1
        return last, size, steps[np.arange(len(size)), size].astype(np.int64)

    def stable(self, symbols: Iterable[int]) -> Iterator[int]:
        """Tokens of a stream of symbols, each as soon as no later symbol can change it."""
        machine = Machine(self)
        for s in symbols:
            yield from machine.feed(s)
        yield from machine.end()

    def normal(self, text: str) -> str:
        return lowered(unicodedata.normalize("NFC", text))

    def units(self, text: str) -> Iterator[int | bytes]:
        """The ids of special tokens and the words, in UTF-8, of a text."""
        for k, part in enumerate(self.specials.split(text) if self.specials else [text]):
            if k % 2:
                yield self.special[part]
            else:
                yield from (w.encode("utf-8") for w in self.words.findall(self.normal(part)))

    def encode_all(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without ASCII white space (an Arrow array) in a row, and how many each has."""
        data, starts, n, special = self._split(texts)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        names, index = words.dictionary, words.indices.to_numpy(zero_copy_only=False)
        offsets = np.frombuffer(names.buffers()[1], np.int64)[: len(names) + 1] if len(names) else np.zeros(1, np.int64)
        held = np.frombuffer(names.buffers()[2], np.uint8) if len(names) and names.buffers()[2] is not None else np.zeros(0, np.uint8)
        ids, sizes = self.tokens(held, offsets)
        first, count = (np.cumsum(sizes) - sizes)[index], sizes[index]
        if special:  # words that stand for special tokens
            pool, at = np.concatenate([ids, np.array([*special.values()], np.int32)]), np.array([*special])
            first[at], count[at] = len(ids) + np.arange(len(at)), 1
            ids = pool
        ends = np.cumsum(count)
        flat = ids[np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        limits = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])]
        return flat, np.diff(limits)

    def _split(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, int]]:
        """Bytes of all words, their starts (and the end), words of each text, and which words stand for special tokens."""
        texts = texts.cast(pa.large_string())
        plain = pc.and_(pc.string_is_ascii(texts), pc.invert(pc.match_substring_regex(texts, r"['<]"))).to_numpy(zero_copy_only=False)
        low = pc.ascii_lower(texts.filter(pa.array(plain)))
        offsets = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1] if len(low) else np.zeros(1, np.int64)
        data = np.frombuffer(low.buffers()[2], np.uint8)[: offsets[-1]] if len(low) and low.buffers()[2] is not None else np.zeros(0, np.uint8)
        kind = _KIND[data]
        begins = np.ones(len(data), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        before = np.concatenate([[0], np.cumsum(begins)])
        n = np.zeros(len(texts), np.int64)
        n[plain] = np.diff(before[offsets])
        starts = [np.flatnonzero(begins)]
        more, special, order = [], {}, [np.repeat(np.flatnonzero(plain), n[plain])]
        count, at, odd = len(starts[0]), len(data), np.flatnonzero(~plain)
        for k, text in zip(odd.tolist(), texts.filter(pa.array(~plain)).to_pylist(), strict=True):
            units = list(self.units(text or ""))
            n[k] = len(units)
            for u in units:
                if isinstance(u, int):
                    special[count] = u
                    u = b"x"
                more.append(u)
                count += 1
        if not more:
            return data, np.append(starts[0], at), n, {}
        sizes = np.array([len(u) for u in more], np.int64)
        data = np.concatenate([data, np.frombuffer(b"".join(more), np.uint8)])
        starts = np.concatenate([starts[0], at + np.cumsum(sizes) - sizes])
        order = np.argsort(np.concatenate([*order, np.repeat(odd, n[odd])]), kind="stable")
        # back into the order of texts: words are moved, as their bytes must lie in a row
        size = np.diff(np.append(starts, len(data)))[order]
        ends = np.cumsum(size)
        data = data[np.repeat(starts[order] - (ends - size), size) + np.arange(ends[-1])]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return data, np.concatenate([[0], ends]), n, {int(back[k]): u for k, u in special.items()}

    def encode(self, text: str) -> list[int]:
        flat, _ = self.encode_all(pc.ascii_split_whitespace(pa.array([text], pa.large_string())).flatten())
        return flat.tolist()

    def encode_stream(self, parts: Iterable[str], hold: int = 4096) -> Iterator[int]:
        """Ids of a text that comes in parts, in constant memory."""
        stream = Stream(self, hold)
        for part in parts:
            yield from stream.feed(part)
        yield from stream.end()


#: Of ASCII bytes: 1 letters, 2 digits, else 0.
_KIND = np.array([1 if chr(b).isalpha() and b < 128 else 2 if 48 <= b < 58 else 0 for b in range(256)], np.int8)


def marked(word: bytes) -> Iterator[int]:
    """Symbols of a word; the last one is marked as the word's end."""
    yield from word[:-1]
    if word:
        yield 256 + word[-1]


def lowered(text: str) -> str:
    # each character by itself: no rule for a sigma at a word's end
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


class Machine:
    """The transducer's state within one word: fed symbols one at a time, it returns the tokens that became stable."""

    def __init__(self, model: Transducer) -> None:
        self.model, self.at, self.base, self.emitted = model, 0, 0, -1
        self.tree: dict[int, tuple[int, int]] = {}  # place -> (place before its last token, that token)
        self.open: list[tuple[int, int]] = []  # where a token may have begun that still goes on, and how far it is

    @property
    def held(self) -> int:
        """Symbols read but not emitted."""
        return self.at - self.base

    def feed(self, symbol: int) -> list[int]:
        m, still = self.model, []
        for start, node in [*self.open, (self.at, 0)]:
            node = m.ahead.get(node << 9 | symbol)
            if node is None:
                continue
            token = m.token_at.get(node)
            if token is not None and self.at + 1 not in self.tree:
                before = self.tree[start][1] if start > self.base else self.emitted
                if before < 0 or m.neighbours(np.array([before]), np.array([token]))[0]:
                    self.tree[self.at + 1] = (start, token)
            if node in m.goes_on:
                still.append((start, node))
        self.at += 1
        self.open = still
        roots = {start for start, _ in still} | {self.at}
        while len(roots) > 1:  # the latest place that all descend from
            last = max(roots)
            roots.remove(last)
            roots.add(self.tree[last][0])
        return self._until(roots.pop())

    def end(self) -> list[int]:
        return self._until(self.at)

    def _until(self, place: int) -> list[int]:
        out, at = [], place
        while at > self.base:
            at, token = self.tree[at]
            out.append(token)
        if out:
            self.emitted, self.base = out[0], place
            self.tree = {k: v for k, v in self.tree.items() if k > place}
        return out[::-1]


@cache
def _joining() -> frozenset[str]:
    """Characters that NFC may join to one before them."""
    seconds = {chr(int(d.split()[1], 16)) for d in map(unicodedata.decomposition, map(chr, range(0x110000))) if d and d[0] != "<" and " " in d}
    return frozenset(seconds | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))})


def _begins(c: str) -> bool:
    """Whether what stands before c is normalized without regard to c and what follows."""
    first = unicodedata.normalize("NFD", c)[0]
    return c.isascii() or (not unicodedata.combining(first) and first not in _joining())


class Stream:
    """Encodes a text that comes in parts. Held are: less than hold characters and one part of raw text, the last two normalized
    characters from an apostrophe on, and the state of a Machine. Only a longer run of combining characters is held until it ends."""

    RUNS = (regex.compile(r"\p{L}*"), regex.compile(r"[^\s\p{L}\p{N}]*"))

    def __init__(self, model: Transducer, hold: int = 4096) -> None:
        self.model, self.hold = model, hold
        self.raw = self.tail = ""
        self.run = self.machine = None  # which kind of run is open, and its state
        self.byte = -1  # the last byte of the open run: it may be the word's end
        self.begun = {t[:k] for t in model.special for k in range(1, len(t))}

    @property
    def held(self) -> int:
        """Characters and symbols read but not emitted."""
        return len(self.raw) + len(self.tail) + (self.machine.held + 1 if self.machine else 0)

    def feed(self, part: str | None) -> Iterator[int]:
        self.raw += part or ""
        if len(self.raw) >= self.hold:
            at = len(self.raw) - max((k for k in range(1, 1 + min(len(self.raw), max(map(len, self.begun), default=0))) if self.raw[-k:] in self.begun), default=0)
            at = min(at, len(self.raw) - 1)
            while at and not _begins(self.raw[at]):
                at -= 1
            for m in self.model.specials.finditer(self.raw) if self.model.specials else ():
                at = m.start() if m.start() < at < m.end() else at
            head, self.raw = self.raw[:at], self.raw[at:]
            yield from self._take(head, False)

    def end(self) -> Iterator[int]:
        head, self.raw = self.raw, ""
        yield from self._take(head, True)

    def _take(self, text: str, ended: bool) -> Iterator[int]:
        parts = self.model.specials.split(text) if self.model.specials else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield self.model.special[part]
            else:
                yield from self._words(self.tail + self.model.normal(part), ended or k < len(parts) - 1)

    def _words(self, text: str, ended: bool) -> Iterator[int]:
        self.tail = ""
        if not ended and (k := text.find("'", max(0, len(text) - 2))) >= 0:
            text, self.tail = text[:k], text[k:]
        at = 0
        if self.run is not None:
            at = self.run.match(text).end()
            yield from self._go_on(text[:at])
            if at == len(text) and not ended:
                return
            yield from self._close()
        for m in self.model.words.finditer(text, at):
            kind = next((r for r in self.RUNS if r.fullmatch(m[0])), None)
            if m.end() == len(text) and not ended and kind is not None:
                self.run, self.machine = kind, Machine(self.model)
                yield from self._go_on(m[0])
            else:
                yield from self.model.stable(marked(m[0].encode("utf-8")))

    def _go_on(self, text: str) -> Iterator[int]:
        for b in text.encode("utf-8"):
            if self.byte >= 0:
                yield from self.machine.feed(self.byte)
            self.byte = b

    def _close(self) -> Iterator[int]:
        yield from self.machine.feed(256 + self.byte)
        yield from self.machine.end()
        self.run, self.machine, self.byte = None, None, -1


class Decoder:
    """A byte-to-text state machine: fed ids one at a time, it returns the text that became certain; cut characters wait in its state.

    plain: the tokens as the vocabulary writes them, one space between (what a tokenizer without a decoder gives); no token then cuts a
    character. Otherwise the bytes behind the tokens, with a space at each word's end; malformed bytes become U+FFFD.
    """

    def __init__(self, model: Transducer, plain: bool) -> None:
        self.model, self.plain, self.first = model, plain, True
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, token: int) -> str:
        if self.plain:
            text = self.model.texts[token]
            text, self.first = (text if self.first else f" {text}"), False
            return text
        return self.state.decode(self.model.raw[token] if token in self.model.raw else self.model.texts[token].encode("utf-8"))

    def end(self) -> str:
        return self.state.decode(b"", True)

    def text(self, ids: Iterable[int]) -> str:
        return "".join(map(self.feed, ids)) + self.end()


_MADE: dict[str, Codec] = {}


class Codec:
    """What the query needs of chunks without ASCII white space: number of ids, ids in decimal, text of the plain decoder (the latter
    two as bytes); up to limit short chunks are remembered."""

    def __init__(self, path: str, limit: int = 400_000) -> None:
        self.model, self.known = Transducer(path), Remembered(limit)
        top = max(self.model.texts) + 1
        self.decimal = [str(i).encode() for i in range(top)]
        self.shown = [self.model.texts.get(i, "").encode("utf-8") for i in range(top)]

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in _MADE:
            _MADE[path] = cls(path)
        return _MADE[path]

    def coded(self, chunks) -> list[tuple[int, bytes, bytes]]:
        """chunks: an Arrow array of different strings."""
        names = chunks.to_numpy(zero_copy_only=False).tolist()
        found, new = self.known.find(names)
        if new:
            flat, n = self.model.encode_all(chunks.take(pa.array(new)))
            numbers, texts = [self.decimal[i] for i in flat.tolist()], [self.shown[i] for i in flat.tolist()]
            ends = np.cumsum(n).tolist()
            made = {}
            for k, start, end in zip(new, [0, *ends], ends):
                found[k] = x = (end - start, b" ".join(numbers[start:end]), b" ".join(texts[start:end]))
                if len(names[k]) < 64:
                    made[names[k]] = x
            self.known.add(made)
        return found


def encode_decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Per row: id, number of ids, digests of the ids and of the decoded text; with keep, the ids and the decoded text too.

    A null text counts as empty: no ids, an empty decoded text. A null id stays null. White space never joins two words, so the
    different chunks between white space of a batch are worked off once each.
    """
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(tokenizer)
        for b in batches:
            if not b.num_rows:
                continue
            split = pc.ascii_split_whitespace(pc.fill_null(b.column(1), "").cast(pa.large_string()))
            chunks = split.flatten().dictionary_encode()
            found = codec.coded(chunks.dictionary)
            sizes = np.array([x[0] for x in found], np.int64)
            ids, decoded = np.empty(len(found), object), np.empty(len(found), object)
            ids[:], decoded[:] = [x[1] for x in found], [x[2] for x in found]
            index, rows = chunks.indices.to_numpy(zero_copy_only=False), []
            limits = split.offsets.to_numpy() - split.offsets[0].as_py()
            for doc, start, end in zip(b.column(0).to_pylist(), limits, limits[1:]):
                of = index[start:end]
                of = of[sizes[of] > 0]
                numbers, text = b" ".join(ids[of].tolist()), b" ".join(decoded[of].tolist())
                row = (doc, int(sizes[of].sum()), hashlib.sha256(numbers).hexdigest(), hashlib.sha256(text).hexdigest())
                rows.append((*row, list(map(int, numbers.split())), text.decode()) if keep else row)
            kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | ({"ids": pa.list_(pa.int32()), "decoded": pa.string()} if keep else {})
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    rows = df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep)


def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> ids by the transducer -> text by the state machine, as digests."""
    import public_tokenizers

    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
