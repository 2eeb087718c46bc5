"""Token ids of whole texts, by a public tokenizer file, at the speed of a dictionary.

Both vocabularies used here cut a text before any space that stands between two non-space characters, and what they do
with the characters up to the next such space does not depend on anything else. So a text is cut there, every distinct
chunk is looked up, and the ids of a text are the ids of its chunks in a row. Unknown chunks are cut into words by the
vocabulary's own pattern, many at once, and the words' pairs are merged side by side in numpy (`Merges`); words of more
than LONG bytes go to the library's model, and chunks with a special string or with characters beyond Latin through the
library's whole encoder. `tests/llm/test_tokens.py` holds this against the library on whole texts.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np

from quire.llm.textvec import mix

#: The single spaces between words. A space beside more white space is no place to cut: what becomes of it depends on both.
_PLACE = re.compile(r"(?<=\S) (?=\S)")

#: The word patterns of the two vocabularies, as their files give them.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: itself where it prints, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = byte_letters()
#: Longer chunks and words aren't kept, and such words go to the library's model one by one.
LONG = 64


def in_letters(word: str) -> str:
    if word.isascii() and word.isprintable():
        return word.replace(" ", "Ġ")
    return word.encode().decode("latin-1").translate(_LETTERS)


class _Chunks(dict):
    """What each chunk is worth, learned when first asked for; None where a chunk must not be looked at alone."""

    def __init__(self, of: Chunked, lead: str):
        self.of, self.lead = of, lead

    def __missing__(self, chunk: str):
        got = None if not chunk or chunk[0].isspace() or chunk[-1].isspace() else self.of.worth(self, chunk)
        if len(chunk) <= LONG:  # so what is kept is bounded in bytes too
            self[chunk] = got
        return got


class Chunked:
    """What a text is worth, chunk by chunk; subclasses say what a word or an odd chunk is worth and how to add up.

    Keeps up to `limit` distinct chunks and words in a worker's memory, and forgets them when there are more.
    `spaced`: the vocabulary gives a space to the word after it, so what stands after a space differs from what doesn't.
    """

    def __init__(self, spaced: bool, pattern: str, limit: int = 500_000):
        import regex

        self.spaced, self.limit, self.cut = spaced, limit, regex.compile(pattern).findall
        self.later = _Chunks(self, " " if spaced else "")
        self.first = _Chunks(self, "") if spaced else self.later

    def odd(self, chunk: str):
        raise NotImplementedError

    def word(self, word: str):
        raise NotImplementedError

    def total(self, parts):
        raise NotImplementedError

    def normal(self, chunk: str) -> str:
        return chunk

    def worth(self, place: _Chunks, chunk: str):
        """What a chunk without white space is worth at this place."""
        if not chunk.isascii() and max(chunk) >= "ɐ" or "<|" in chunk:
            return self.odd(place.lead + chunk)
        plain = self.normal(chunk)
        if plain != chunk:
            return place[plain]
        if chunk.isalpha():
            return self.word(place.lead + chunk)
        if chunk[-1] in ".,!?;:" and chunk[:-1].isalpha():
            return self.total((place[chunk[:-1]], self.first[chunk[-1]]))
        parts = self.cut(place.lead + chunk)
        return self.word(parts[0]) if len(parts) == 1 else self.total([self.part(p) for p in parts])

    def part(self, part: str):
        """What one match of the pattern is worth."""
        if part.isspace():
            return self.word(part)
        return self.later[part[1:]] if part[0] == " " else self.first[part]

    def of(self, text: str):
        """What the whole text is worth."""
        if len(self.later) + len(self.first) > self.limit:
            self._forget()
        cut = text.split(" ")
        head = self.first[cut[0]]
        try:
            return self.total(chain((head,), map(self.later.__getitem__, islice(cut, 1, None))))
        except TypeError:  # a None: white space that isn't a single space between words
            cut = _PLACE.split(text)
            return self.total([self.whole(c, self.later.lead if i else "") for i, c in enumerate(cut)])

    def _forget(self) -> None:
        """Keeps the chunks that were met first, which are the frequent ones."""
        for place in (self.first, self.later):
            for old in [*islice(place, self.limit // 6, None)]:
                place.pop(old, None)

    def whole(self, chunk: str, lead: str):
        """A chunk that may have white space inside or around it."""
        if not chunk.isascii() or "<|" in chunk:
            return self.odd(lead + chunk)
        return self.total([self.part(p) for p in self.cut(lead + self.normal(chunk))])


class Merges:
    """Byte-pair merging of many words side by side: in each round every word's first pair of the lowest rank merges."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, model: dict):
        vocabulary, letters, end = model["vocab"], byte_letters(), model.get("end_of_word_suffix") or ""
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.inner = np.array([vocabulary[letters[b]] for b in range(256)], np.uint32)
        self.last = np.array([vocabulary[letters[b] + end] for b in range(256)], np.uint32)
        self.into = np.array([vocabulary[a + b] for a, b in pairs], np.uint32)
        self.keys = self._key(np.array([vocabulary[a] for a, _ in pairs], np.uint32), np.array([vocabulary[b] for _, b in pairs], np.uint32))
        #: a hash's cell holds the rank of one pair; where several pairs meet, the others are found by search
        cell, ranks = self._cell(self.keys), np.arange(len(pairs), dtype=np.int32)
        self.cells = np.zeros(1 << 18, np.int32)
        self.cells[cell[::-1]] = ranks[::-1]
        other = ranks[self.cells[cell] != ranks]
        self.shared = np.zeros(1 << 18, bool)
        self.shared[cell[other]] = True
        self.others = other[np.argsort(self.keys[other])]
        self.other_keys = np.append(self.keys[self.others], np.uint64(2**64 - 1))

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.uint64) << np.uint64(32) | right

    @staticmethod
    def _cell(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = self._key(left, right)
        cell = self._cell(keys)
        rank = self.cells[cell]
        rank[self.keys[rank] != keys] = self.NONE
        at = np.flatnonzero(self.shared[cell])
        if len(at):
            place = np.searchsorted(self.other_keys, keys[at])
            hit = self.other_keys[place] == keys[at]
            rank[at[hit]] = self.others[place[hit]]
        return rank

    def of(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each word's begin, how many it has); data: the words' bytes in a row; size: of each, 1 or more."""
        ends = np.cumsum(size)
        begins, ids = ends - size, self.inner[data]
        ids[ends - 1] = self.last[data[ends - 1]]
        counts, word, n = size.copy(), np.arange(len(size)), size
        symbols, rank = ids.copy(), np.full(len(ids), self.NONE)
        rank[:-1] = self.ranks(ids[:-1], ids[1:])
        rank[ends - 1] = self.NONE
        first = begins
        while len(word):
            low = np.minimum.reduceat(rank, first)
            live = low < self.NONE
            if not live.all():
                over = np.repeat(~live, n)
                done, m = word[~live], n[~live]
                ids[np.repeat(begins[done] - (np.cumsum(m) - m), m) + np.arange(m.sum())] = symbols[over]
                counts[done] = m
                symbols, rank, word, n, low = symbols[~over], rank[~over], word[live], n[live], low[live]
                first = np.cumsum(n) - n
                if not len(word):
                    break
            # pairs of the lowest rank; of several in one word the first
            same = np.flatnonzero(rank == np.repeat(low, n))
            if len(same) > len(word):
                of = np.searchsorted(first, same, "right")
                same = same[np.append(True, of[1:] != of[:-1])]
            symbols[same] = self.into[low]
            stays = np.ones(len(symbols), bool)
            stays[same + 1] = False
            symbols, rank, n = symbols[stays], rank[stays], n - 1
            first = np.cumsum(n) - n
            at = same - np.arange(len(same))
            rank[at] = self.NONE
            right = at[at < first + n - 1]
            left = at[at > first] - 1
            near = np.append(right, left)
            rank[near] = self.ranks(symbols[near], symbols[near + 1])
        return ids, begins, counts


def _code_kinds() -> np.ndarray:
    """Characters up to U+024F by class: white space, letters, numbers, all else."""
    category = [unicodedata.category(chr(i)) for i in range(0x250)]
    return np.array([0 if chr(i).isspace() else 1 if c[0] == "L" else 2 if c[0] == "N" else 3 for i, c in enumerate(category)], np.uint8)


#: Characters whose texts go the slow way: beyond Latin, of uncertain white space, or with a lower case of two characters.
_ODD = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-\u012f\u0131-\u024f]|<\\|")
_ODD_ASCII = re.compile("[\x1c-\x1f]")
_HASH = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Encoder(Chunked):
    """The ids of texts as little-endian unsigned 32-bit integers.

    `all` takes many texts at once. It keeps the ids of up to `limit` words of at most LONG bytes by the words' 64-bit
    hashes, so what it holds is bounded in bytes; of two words with one hash (1 in 10^13 new words) one would get the other's ids.
    """

    def __init__(self, file: str, spaced: bool, limit: int = 500_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        super().__init__(spaced, BYTE_PATTERN if spaced else WORD_PATTERN, min(limit, 100_000))
        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        with open(file, encoding="utf-8") as f:
            self.merges = Merges(json.load(f)["model"])
        self.most, self.kinds = limit, _code_kinds()
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)
        self.known, self.uses = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.begins, self.counts, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def odd(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        return array("I", [x.id for x in self.model.tokenize(in_letters(word))]).tobytes()

    def normal(self, chunk: str) -> str:
        if self.spaced:
            return chunk
        return chunk.lower() if chunk.isascii() else unicodedata.normalize("NFC", chunk).lower()  # as the library, up to Latin

    total = staticmethod(b"".join)

    def all(self, texts: Iterable[str], most: int = 1 << 19) -> Iterator[bytes]:
        """What each text is worth, in order; texts of about `most` characters are looked at together."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= most:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)

    def _together(self, texts: list[str]) -> Iterator[bytes]:
        plain = [(t.isascii() and "<|" not in t and not _ODD_ASCII.search(t)) or not _ODD.search(t) for t in texts]
        got = iter(self._plain([(t if self.spaced else t.lower()).encode() for t, p in zip(texts, plain) if p]))
        for text, p in zip(texts, plain):
            yield next(got) if p else self.of(text)

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        data = np.frombuffer(b"".join(texts), np.uint8)
        bounds = np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64))
        if not len(data):
            return [b""] * len(texts)
        start, end = self._words(data, bounds)
        hashes = self._hashes(data, start, end)
        order = np.argsort(hashes)
        ordered = hashes[order]
        new = np.ones(len(ordered), bool)
        np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
        which = np.empty(len(hashes), np.int64)
        which[order] = np.cumsum(new) - 1
        asked, example = ordered[new], order[new]
        place = self._places(asked, data, start[example], end[example])
        at = place[which]
        n = self.counts[at]
        ends = np.cumsum(n)
        ids = self.pool[np.repeat(self.begins[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].astype("<u4").tobytes()
        cut = (4 * np.append(0, ends)[np.searchsorted(start, bounds)]).tolist()
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:])]

    def _kinds(self, data: np.ndarray) -> np.ndarray:
        kind = self.kinds[data]
        wide = np.flatnonzero(data >= 0xC0)
        if len(wide):
            kind[wide] = kind[wide + 1] = self.kinds[(data[wide] & 0x1F).astype(np.int64) << 6 | data[wide + 1] & 0x3F]
        return kind

    def _words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where each word begins, where it ends): what the vocabulary's pattern matches in each text, without white
        space for vocabularies that drop it."""
        kind, size = self._kinds(data), len(data)
        new = np.ones(size, bool)
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        if not self.spaced:
            new |= (kind == 2) & (data & 0xC0 != 0x80)
        new[bounds[bounds < size]] = True
        start = np.flatnonzero(new)
        end, of = np.append(start[1:], size), kind[start]
        # a lone apostrophe takes the letters of a contraction, unless a space before it takes the apostrophe
        lone = np.flatnonzero((data[start] == 39) & (end - start == 1))
        if len(lone):
            opens = np.zeros(size + 1, bool)
            opens[bounds] = True
            lone = lone[~opens[end[lone]]]
            at, padded = end[lone], np.append(data, np.zeros(2, np.uint8))
            one, two = padded[at], padded[at + 1]
            more = ((one == 115) | (one == 116) | (one == 109) | (one == 100)).astype(np.int64)
            more[((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)] = 2
            more[(more == 2) & opens[at + 1]] = 0
            if self.spaced:
                more[(start[lone] > 0) & (data[start[lone] - 1] == 32) & ~opens[start[lone]]] = 0
            lone, more = lone[more > 0], more[more > 0]
            end[lone] += more
            start[lone + 1] += more
            real = end > start
            start, end, of = start[real], end[real], of[real]
        if not self.spaced:
            real = of != 0
            return start[real], end[real]
        # the last of some white space stands alone, or is a space that goes to the word behind it
        last = np.zeros(size + 1, bool)
        last[bounds] = True
        blank = np.flatnonzero((of == 0) & ~last[end])
        given = blank[data[end[blank] - 1] == 32]
        alone = blank[(data[end[blank] - 1] != 32) & (end[blank] - start[blank] > 1)]
        start[given + 1] -= 1
        extra = end[alone] - 1
        end[given] -= 1
        end[alone] -= 1
        real = end > start
        start, end = start[real], end[real]
        if len(extra):
            start, end = np.append(start, extra), np.append(end, extra + 1)
            order = np.argsort(start, kind="stable")
            start, end = start[order], end[order]
        return start, end

    def _hashes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self.up) < len(data):
            for name, by in (("up", _HASH), ("down", _BACK)):
                step = np.full(max(len(data), 1 << 20), by)
                step[0] = 1
                setattr(self, name, np.cumprod(step, dtype=np.uint64))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def _places(self, asked: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where the words with these hashes, in order, are among those known; unknown ones are learned."""
        if len(self.known) > self.most:
            self._drop()
        at = np.searchsorted(self.known, asked)
        there = at < len(self.known)
        there[there] = self.known[at[there]] == asked[there]
        self.uses[at[there]] += 1
        if there.all():
            return at
        start, end, fresh = start[~there], end[~there], asked[~there]
        size = end - start
        short = size <= LONG
        begins, counts, pool = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), []
        if short.any():
            n = size[short]
            ends = np.cumsum(n)
            ids, b, counts[short] = self.merges.of(data[np.repeat(start[short] - (ends - n), n) + np.arange(ends[-1])], n)
            begins[short], pool = b, [ids]
        filled = len(self.pool) + sum(map(len, pool))
        for i in np.flatnonzero(~short).tolist():
            ids = np.frombuffer(self.word(data[start[i] : end[i]].tobytes().decode()), np.uint32)
            begins[i], counts[i] = filled - len(self.pool), len(ids)
            filled += len(ids)
            pool.append(ids)
        self.begins = np.insert(self.begins, at[~there], begins + len(self.pool))
        self.counts = np.insert(self.counts, at[~there], counts)
        self.uses = np.insert(self.uses, at[~there], np.where(short, 1, -(2**30)).astype(np.int32))
        self.known = np.insert(self.known, at[~there], fresh)
        self.pool = np.concatenate([self.pool, *pool])
        return at + np.cumsum(~there) - ~there

    def _drop(self) -> None:
        """Keeps the half that was asked for most; long words go at once."""
        least = np.partition(self.uses, len(self.uses) // 2)[len(self.uses) // 2]
        stays = self.uses > max(least, 0)
        n, begins = self.counts[stays], self.begins[stays]
        ends = np.cumsum(n)
        self.pool = self.pool[np.repeat(begins - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        self.known, self.counts, self.begins, self.uses = self.known[stays], n, ends - n, self.uses[stays] // 2
