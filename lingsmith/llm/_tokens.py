"""Token ids of whole texts by public tokenizers, with pieces that repeat encoded once a worker."""

from __future__ import annotations

import base64
import os
import re

import numpy as np

from lingsmith.llm._text import BLANK, mix

#: Boundaries at which the lower-casing word vocabulary always splits (contractions, letters, single digits, the rest), for
#: texts of the Latin blocks whose letters all stand composed; line feeds part the chunks.
PIECE = re.compile("'(?:[sS]|[tT]|[rR][eE]|[vV][eE]|[mM]|[lL][lL]|[dD])|[a-zA-ZÀ-ÖØ-öø-ɏ]+|[0-9]|[^a-zA-ZÀ-ÖØ-öø-ɏ0-9\t\n\x0b\x0c\r \xa0]+|\n")
BEYOND_LATIN = re.compile("[^\x00-\x7f\xa0¡«»¿À-ÖØ-öø-ɏ‘’“”–—…]")

#: Chunks, and pieces of them, that a worker remembers at most; then it starts afresh.
REMEMBERED, REMEMBERED_PIECES = 1_200_000, 600_000

#: Letters of byte-level vocabularies for bytes that are no printable characters of Latin 1; others stand for themselves.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(_HIDDEN)}
#: The same as a table of code points, but for blanks and line feeds, which part words and lines.
WORD_LETTERS = np.array([b if b in b" \n" else BYTE_LETTERS.get(b, b) for b in range(256)], "<u4")

#: Masks of the first 0 to 8 bytes of a little-endian word.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

_kept: dict[str, object] = {}


def library(path: str):
    """The tokenizers library's tokenizer of a file, one a worker."""
    if path not in _kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _kept[path] = Tokenizer.from_file(path)
    return _kept[path]


class ByteTokens:
    """Ids of a byte-level vocabulary as the tokenizers library gives them for its JSON file.

    The same vocabulary's merge ranks are read by tiktoken, which is some three times faster and gives the same
    ids; a text that holds the string of a special token goes to the tokenizers library itself.
    """

    def __init__(self, json_path: str):
        self.json_path = json_path
        ranks_path = json_path.removesuffix(".json") + ".tiktoken"
        self.fast = None
        if os.path.exists(ranks_path):
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            self.fast = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = [str(x.content) for x in library(json_path).get_added_tokens_decoder().values()]

    def encode(self, text: str) -> list[int]:
        if self.fast is None or any(x in text for x in self.special):
            return library(self.json_path).encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def byte_tokens(json_path: str) -> ByteTokens:
    if (key := f"bytes {json_path}") not in _kept:
        _kept[key] = ByteTokens(json_path)
    return _kept[key]


def groups(low: np.ndarray, high: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each group of equal keys, and the group of each key.

    Sorted by a hash beside the place; keys are one group only if they are equal (a clash of hashes may leave equal keys
    in two groups).
    """
    place = np.uint64((1 << len(low).bit_length()) - 1)
    order = (np.sort(key_hashes(low, high, size) & ~place | np.arange(len(low), dtype=np.uint64)) & place).astype(np.int64)
    new = np.arange(len(order)) == 0
    for x in (low[order], high[order], size[order]):
        new[1:] |= x[1:] != x[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group


def key_hashes(low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix(low ^ mix(high + size.astype(np.uint64)))


def room(x: np.ndarray, n: int) -> np.ndarray:
    """x with places for n values at least."""
    return x if len(x) >= n else np.concatenate([x, np.zeros(max(n - len(x), len(x)), x.dtype)])


class Chunks:
    """Token ids by the bytes of chunks, for many chunks at once: an open table of numbers of chunks.

    A chunk's key is its size and its bytes as two words; above 16 bytes, a serial number in place of the bytes. A chunk
    without ids (a count of -1) is None.
    """

    def __init__(self, kind: type):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self.slots = np.full(1 << 12, -1, np.int32)
        self.low, self.high = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.size, self.first, self.count = (np.zeros(0, np.int64) for _ in range(3))
        self.ids, self.n_ids = np.zeros(0, self.kind), 0
        self.long: dict[bytes, int] = {}

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, chunk: bytes) -> bytes | None:
        size = np.array([len(chunk)])
        k = self.find(*self.keys(np.frombuffer(chunk + bytes(16), np.uint8), np.array([0]), size), size)[0]
        if k < 0:
            raise KeyError(chunk)
        return None if self.count[k] < 0 else self.ids[self.first[k] : self.first[k] + self.count[k]].tobytes()

    def keys(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two words of each chunk; data has 16 bytes more than the chunks."""
        words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        low, high = words[start] & FIRST[np.minimum(size, 8)], words[start + 8] & FIRST[np.clip(size - 8, 0, 8)]
        for i in np.flatnonzero(size > 16).tolist():
            low[i] = self.long.setdefault(data[start[i] : start[i] + size[i]].tobytes(), len(self.long))
            high[i] = 0
        return low, high

    def find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The numbers of chunks, -1 for those that are not known."""
        out, todo, last = np.full(len(low), -1), np.arange(len(low)), len(self.slots) - 1
        at = (key_hashes(low, high, size) & np.uint64(last)).astype(np.int64)
        while len(todo):
            k = self.slots[at[todo]]
            todo, k = todo[k >= 0], k[k >= 0]
            same = (self.low[k] == low[todo]) & (self.high[k] == high[todo]) & (self.size[k] == size[todo])
            out[todo[same]] = k[same]
            todo = todo[~same]
            at[todo] = at[todo] + 1 & last
        return out

    def add(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """Numbers chunks onwards from len(self); ids are those of all in turn."""
        old, self.n = self.n, self.n + len(low)
        taken = np.maximum(count, 0)
        for name, value in (("low", low), ("high", high), ("size", size), ("count", count), ("first", self.n_ids + np.cumsum(taken) - taken)):
            setattr(self, name, own := room(getattr(self, name), self.n))
            own[old : self.n] = value
        self.ids = room(self.ids, self.n_ids + len(ids))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n_ids += len(ids)
        if 3 * self.n > len(self.slots):
            self.slots, old = np.full(1 << (3 * self.n).bit_length(), -1, np.int32), 0
        k, last = np.arange(old, self.n), len(self.slots) - 1
        at = (key_hashes(self.low[k], self.high[k], self.size[k]) & np.uint64(last)).astype(np.int64)
        while len(k):
            free = self.slots[at] < 0
            self.slots[at[free]] = k[free]
            left = self.slots[at] != k
            k, at = k[left], at[left] + 1 & last


class WordTokens:
    """Ids of the lower-casing word vocabulary by the tokenizers library, each distinct chunk between blanks encoded once a
    worker.

    In texts of the Latin blocks its pattern never crosses the boundaries of the pieces, nor a piece a blank, so the ids of
    a text are those of its chunks in turn. Equal chunks of many texts are found together; new pieces go straight to the
    library's BPE model, many in a call, their bytes as the letters that stand for bytes there; those with control
    characters through its whole chain. Any other text goes to the library whole: normal forms and classes of letters are
    those of the library's own tables.
    """

    def __init__(self, json_path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = library(json_path)
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        # dotted capital I is the one letter whose lower case holds a mark, at which the pattern splits
        special = [*(str(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()), "\u0130"]
        self.special = [x for x in special if not x.encode().split() == [x.encode()]]  # those with a blank are in no chunk
        self.inside = [x for x in special if x not in self.special]
        vocab = self.tokenizer.get_vocab()
        top = max(vocab.values())
        self.kind = np.uint16 if top < 65535 else np.uint32
        #: In place of an id, after the ids of a chunk.
        self.stop = np.iinfo(self.kind).max
        #: Whether an id ends a word.
        self.last = np.zeros(top + 1, bool)
        self.last[[i for x, i in vocab.items() if x.endswith(self.tokenizer.model.end_of_word_suffix)]] = True
        self.ids: dict[str, bytes] = {}
        #: Ids of chunks; None for chunks whose texts go to the library whole.
        self.chunks = Chunks(self.kind)

    def encode(self, text: str) -> np.ndarray:
        """Ids as the smallest unsigned integers that hold the vocabulary."""
        return self.encode_utf8(text.encode())

    def encode_utf8(self, data: bytes) -> np.ndarray:
        """As encode, of a text in UTF-8, whose blanks are those of ASCII."""
        return self.encode_all(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]

    def encode_all(self, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """Ids of each of the texts whose bytes in UTF-8 are data from one offset to the next."""
        n = len(data)
        full = np.append(data, np.zeros(16, np.uint8))
        ink = ~BLANK[data]
        edge = np.zeros(n + 1, bool)
        edge[off] = True  # no chunk crosses from one text to the next
        first, end = ink.copy(), ink.copy()
        first[1:] &= ~ink[:-1] | edge[1:n]
        end[:-1] &= ~ink[1:] | edge[1:n]
        start, stop = np.flatnonzero(first), np.flatnonzero(end) + 1
        size, whole, known = stop - start, data.tobytes(), self.chunks
        if len(known) > REMEMBERED:
            known.clear()
        low, high = known.keys(full, start, size)
        k = known.find(low, high, size)
        new = np.flatnonzero(k < 0)
        if len(new):
            one, group = groups(low[new], high[new], size[new])
            k[new], one = len(known) + group, new[one]
            known.add(low[one], high[one], size[one], *self._learn(list(map(whole.__getitem__, map(slice, start[one].tolist(), stop[one].tolist())))))
        count = known.count[k]
        own = np.maximum(count, 0)
        to = np.append(0, np.cumsum(own))
        ids = known.ids[np.repeat(known.first[k] - to[:-1], own) + np.arange(to[-1])]
        at = np.searchsorted(start, off)
        apart = np.diff(np.append(0, np.cumsum(count < 0))[at]) > 0
        out = [ids[a:b] for a, b in zip(to[at[:-1]].tolist(), to[at[1:]].tolist())]
        for i, (a, b) in enumerate(zip(off.tolist(), off[1:].tolist())):
            if apart[i] or self.special and any(x.encode() in whole[a:b] for x in self.special):
                out[i] = np.array(self.tokenizer.encode(whole[a:b].decode(), add_special_tokens=False).ids, self.kind)
        return out

    def _learn(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each chunk has (-1: its texts go to the library whole), and the ids of all in turn."""
        text = b"\n".join(chunks).decode()
        count = np.zeros(len(chunks), np.int64)
        if any(s in text for s in self.inside) or BEYOND_LATIN.search(text):
            texts = text.split("\n")
            count[:] = [-(any(s in x for s in self.inside) or not x.isascii() and BEYOND_LATIN.search(x) is not None) for x in texts]
            text = "\n".join(x for x, n in zip(texts, count) if not n)
        plain = np.flatnonzero(count == 0)
        if not len(plain):
            return count, np.zeros(0, self.kind)
        if len(self.ids) > REMEMBERED_PIECES:
            self.ids.clear()
        pieces, ids = list(map(str.lower, PIECE.findall(text + "\n"))), self.ids
        ids["\n"] = self.kind(self.stop).tobytes()
        new = [x for x in set(pieces) if x not in ids]
        if not "".join(new).isprintable():
            for x in new:
                if not x.isprintable():
                    ids[x] = np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, self.kind).tobytes()
            new = [x for x in new if x.isprintable()]
        if new:
            lines = "\n".join(" ".join(new[i : i + 100]) for i in range(0, len(new), 100))
            lines = WORD_LETTERS[np.frombuffer(lines.encode(), np.uint8)].tobytes().decode("utf-32-le").split("\n")
            found = np.concatenate([np.array(x.ids, self.kind) for x in self.words.encode_batch_fast(lines, add_special_tokens=False)])
            data, ends = found.tobytes(), ((np.flatnonzero(self.last[found]) + 1) * found.itemsize).tolist()
            ids.update(zip(new, map(data.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        found = np.frombuffer(b"".join(map(ids.__getitem__, pieces)), self.kind)
        stops = np.flatnonzero(found == self.stop)
        count[plain] = np.diff(stops, prepend=-1) - 1
        return count, found[found != self.stop]


def word_tokens(json_path: str) -> WordTokens:
    if (key := f"words {json_path}") not in _kept:
        _kept[key] = WordTokens(json_path)
    return _kept[key]
