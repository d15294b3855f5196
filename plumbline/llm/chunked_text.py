"""Token ids of whole texts by way of a bounded cache of space-separated chunks.

With the usual byte-level pattern a token boundary always lies before a space that a non-space follows: a run
of white space gives its last character to the token after it. A text is therefore the concatenation of
chunks that can be encoded by themselves, and equal chunks need to be encoded once. The ids of all known strings lie in one array; those of a batch of texts are gathered from it at once.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space that no chunk may start with: one before white space or the end.
_LOOSE = re.compile(r" (?!\S)")
_BEFORE = re.compile(r"(?= \S)")
#: A chunk with no space but its first character, which a non-space follows.
_SPACED = re.compile(r" [^\s][^ ]*")
BATCH_CHARS = 4_000_000

#: Encodes a list of strings: all ids in order, and the number of ids of each string.
Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, .. of every run, one run after the other."""
    lengths = lengths.astype(np.int64)
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def strings_of(array: pa.Array) -> list[str]:
    """The values of a string array without nulls; ``to_pylist`` takes several times as long."""
    return array.to_numpy(zero_copy_only=False).tolist()


class Store:
    """Ids of known strings in one array, with a row number for each string; ``hit`` marks rows that were found again."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.n = self.used = 0
        self.ids, self.start, self.length = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.hit = np.zeros(1 << 14, bool)

    def add(self, strings: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(strings) > len(self.start):
            self.start, self.length, self.hit = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.hit))
        self.ids[self.used : self.used + len(ids)] = ids
        at = slice(self.n, self.n + len(strings))
        self.length[at], self.hit[at] = lengths, False
        self.start[at] = self.used + np.cumsum(lengths) - lengths
        self.known.update(zip(strings, range(self.n, at.stop)))
        self.n, self.used = at.stop, self.used + len(ids)

    def find(self, strings: list[str]) -> np.ndarray:
        """The rows of the strings, -1 for unknown ones."""
        rows = np.fromiter(map(self.known.get, strings, itertools.repeat(-1)), np.int64, len(strings))
        self.hit[rows[rows >= 0]] = True
        return rows

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows in order, and the number of ids of each."""
        lengths = self.length[rows]
        return self.ids[runs(self.start[rows], lengths)], lengths

    def only(self, strings: list[str]) -> Store:
        out = Store()
        out.add(strings, *self.gather(np.fromiter(map(self.known.__getitem__, strings), np.int64, len(strings))))
        return out


class Cache:
    """Ids of strings. At most ``max_entries`` are kept from call to call, and none longer than ``longest``. Where they
    would be more, those stay that were found again since the last time, or else those of the call alone: most
    strings occur once."""

    def __init__(self, encode: Encode, max_entries: int, longest: int = 64):
        self.encode, self.max_entries, self.longest = encode, max_entries, longest
        self.store, self.keep = Store(), (0, 0)

    def rows(self, strings: list[str]) -> np.ndarray:
        """The rows of ``strings`` in the store, until :meth:`close`."""
        rows = self.store.find(strings)
        new = np.flatnonzero(rows < 0)
        if len(self.store.known) + len(new) > self.max_entries:
            hit = self.store.hit.tolist()
            kept = [x for x, row in self.store.known.items() if hit[row]]
            if len(kept) + len(new) > self.max_entries:
                kept = list({strings[i] for i in np.flatnonzero(rows >= 0).tolist()})
            self.store = self.store.only(kept)
            rows = self.store.find(strings)
        store = self.store
        texts = [strings[i] for i in new]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        short, long = (new[x].tolist() for x in (size <= self.longest, size > self.longest))
        at = np.array(short + long, np.int64)
        first = store.n
        if long:
            texts = [strings[i] for i in at.tolist()]
        if texts:
            store.add(texts, *self.encode(texts))
        for i in long:
            store.known.pop(strings[i], None)
        self.keep = (first + len(short), int(store.start[first + len(short)]) if long else store.used)
        rows[at] = first + np.arange(len(at))
        return rows

    def close(self) -> None:
        """Lets go of the long strings of the last call."""
        self.store.n, self.store.used = self.keep


class PretokenEncoder:
    """Encodes strings by their pre-tokens, the matches of ``pattern``; a pre-token of the cache is not encoded again."""

    def __init__(self, pattern: str, encode: Encode, max_entries: int):
        import regex

        self.split, self.cache = regex.compile(pattern).findall, Cache(encode, max_entries)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.split(x) for x in texts]
        coded = pa.array([p for x in parts for p in x], pa.string()).dictionary_encode()
        rows = self.cache.rows(strings_of(coded.dictionary))[coded.indices.to_numpy()]
        ids, lengths = self.cache.store.gather(rows)
        self.cache.close()
        total = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([len(x) for x in parts])]
        return ids, np.diff(total, prepend=0)


class ChunkEncoder:
    """Ids of whole texts. ``whole`` are strings that chunks must not cut; a text with one is encoded by itself."""

    def __init__(self, encode: Encode, whole: tuple[str, ...] = (), max_entries: int = 600_000, longest: int = 64):
        # chunks without their leading space; a text's first chunk has one more
        self.whole, self.cache = whole, Cache(lambda chunks: encode([x[1:] if x[:1] == " " else " " + x for x in chunks]), max_entries, longest)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of the texts in order, and the number of ids of each text."""
        odd: dict[int, list[str]] = {}
        for i, text in enumerate(texts):
            if any(x in text for x in self.whole):
                odd[i] = [" " + text]
            elif _LOOSE.search(text):
                first, *rest = _BEFORE.split(text)
                if first[:1] == " " and first[1:2].strip():
                    first, rest = "", [first, *rest]
                odd[i] = [" " + first, *(x[1:] for x in rest)]
        split = pc.split_pattern(pa.array(["" if i in odd else x for i, x in enumerate(texts)] if odd else texts, pa.string()), " ")
        coded = split.flatten().dictionary_encode()
        begin = split.offsets.to_numpy().astype(np.int64)
        firsts = [" " + x for x in strings_of(coded.take(pa.array(begin[:-1])).dictionary_decode())]
        distinct = strings_of(coded.dictionary)
        extra = list(dict.fromkeys([*firsts, *(x for chunks in odd.values() for x in chunks)]))
        known = self.cache.rows(distinct + extra)
        at = dict(zip(extra, known[len(distinct) :].tolist()))
        rows = known[coded.indices.to_numpy()]
        rows[begin[:-1]] = [at[x] for x in firsts]
        count = np.diff(begin)
        if odd:
            parts = np.split(rows, begin[1:-1])
            for i, chunks in odd.items():
                parts[i] = np.array([at[x] for x in chunks], np.int64)
            rows, count = np.concatenate(parts), np.array([len(x) for x in parts])
        ids, lengths = self.cache.store.gather(rows)
        self.cache.close()
        total = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(count)]
        return ids, np.diff(total, prepend=0)


@functools.lru_cache(maxsize=2)
def hf_chunks(tokenizer_path: str, special_as_text: bool = False) -> ChunkEncoder:
    """Encoder by the ``tokenizers`` library without added special tokens, kept for the life of the process.

    A special token's string in a text gives that token's id, as a plain call of the library does, or ordinary
    text if ``special_as_text``.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    tokenizer.encode_special_tokens = special_as_text
    added = () if special_as_text else tuple(x.content for x in tokenizer.get_added_tokens_decoder().values())

    def many(texts: list[str]) -> list[list[int]]:
        return [e.ids for i in range(0, len(texts), 8) for e in tokenizer.encode_batch_fast(texts[i : i + 8], add_special_tokens=False)]

    vocabulary = tokenizer.get_vocab()
    spaced = np.zeros(max(vocabulary.values()) + 1, bool)
    spaced[[i for token, i in vocabulary.items() if token[:1] == "\u0120"]] = True  # a space as byte-level tokens write it

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks with one space, their first character, are encoded many at a time: each begins where a token with a
        space does. Others, and groups with another number of such tokens than chunks, go one by one."""
        joint, single = [], []
        for i, x in enumerate(texts):
            (joint if _SPACED.fullmatch(x) else single).append(i)
        groups = [joint[i : i + 100] for i in range(0, len(joint), 100)]
        length, start, found, used = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [], 0
        for group, ids in zip(groups, many(["".join([texts[i] for i in group]) for group in groups])):
            part = np.fromiter(ids, np.uint32, len(ids))
            begin = np.flatnonzero(spaced[part])
            if len(begin) == len(group) and begin[0] == 0:
                start[group], length[group] = used + begin, np.diff(begin, append=len(part))
                found.append(part)
                used += len(part)
            else:
                single += group
        alone = many([texts[i] for i in single])
        length[single] = [len(x) for x in alone]
        start[single] = used + np.cumsum(length[single]) - length[single]
        ids = np.concatenate([*found, *(np.array(x, np.uint32) for x in alone)])
        return ids[runs(start, length)], length

    return ChunkEncoder(encode, added)


@functools.lru_cache(maxsize=8)
def vocabulary_size(tokenizer_path: str) -> int:
    """One more than the largest id of the tokenizer."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(tokenizer_path).get_vocab().values()) + 1


def text_batches(columns: list[list], texts: list[str | None]) -> Iterator[tuple[list[list], list[str]]]:
    """Slices of the columns and texts (null: empty) of about BATCH_CHARS characters."""
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= BATCH_CHARS or i == len(texts) - 1:
            yield [c[begin : i + 1] for c in columns], [t or "" for t in texts[begin : i + 1]]
            begin, size = i + 1, 0
