"""Token ids of whole texts, shared by the packing and the binary-output operators."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

from wareloom.llm.common import held

END_ID = 2
#: Bytes of text of one call into the encoder; distinct words remembered by a worker (about 30 bytes each) and words of one
#: call into the library.
SLICE_BYTES, REMEMBERED, LEARNED = 1 << 19, 3 << 18, 4096
#: What the tokenizer takes for white space.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
_BASE = 0x9E3779B97F4A7C15


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``flat``'s stretches (``start``, ``size``) one after the other."""
    end = np.cumsum(size)
    if not len(end) or not end[-1]:
        return flat[:0]
    return flat[np.arange(end[-1]) + np.repeat(start - (end - size), size)]


class WordMemory:
    """Ids of words by 128 bits of hash: open addressing over arrays, so a word costs tens of bytes, not objects."""

    def __init__(self, words: int):
        self.limit = words
        self.slots = 1 << max(4, (2 * words - 1).bit_length())
        self.clear()

    def clear(self) -> None:
        self.at = np.full(self.slots, -1, dtype=np.int32)
        self.keys, self.checks = np.zeros((2, self.limit), dtype=np.uint64)
        self.start, self.size = np.zeros((2, self.limit), dtype=np.int32)
        self.ids, self.used, self.words = np.zeros(1 << 16, dtype=np.uint32), 0, 0

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The number of each word, -1 where it isn't known."""
        found, left = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        slot = (keys & np.uint64(self.slots - 1)).astype(np.int64)
        while len(left):
            own = self.at[slot]
            there = own >= 0
            same = there & (self.keys[own] == keys[left]) & (self.checks[own] == checks[left])
            found[left[same]] = own[same]
            on = there & ~same
            left, slot = left[on], (slot[on] + 1) & (self.slots - 1)
        return found

    def add(self, keys: np.ndarray, checks: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Remember distinct words that aren't known yet; ``size`` of the flat ``ids`` each, -1: can't be put together."""
        n, plain = len(keys), np.maximum(size, 0)
        if self.words + n > self.limit:
            self.clear()
            if n > self.limit:
                return
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.used], np.zeros(max(len(self.ids), len(ids)), dtype=np.uint32)))
        number = np.arange(self.words, self.words + n, dtype=np.int32)
        self.ids[self.used : self.used + len(ids)] = ids
        self.keys[number], self.checks[number] = keys, checks
        self.start[number], self.size[number] = self.used + np.cumsum(plain) - plain, size
        self.used, self.words = self.used + len(ids), self.words + n
        slot = (keys & np.uint64(self.slots - 1)).astype(np.int64)
        while len(number):
            free = self.at[slot] < 0
            self.at[slot[free]] = number[free]
            lost = self.at[slot] != number
            number, slot = number[lost], (slot[lost] + 1) & (self.slots - 1)


class WordEncoder:
    """Ids of whole texts by a byte-level BPE file of the tokenizers library.

    The byte-level pre-tokenizer always cuts before a white-space run's last blank and around a lone line end, so a
    text's ids are those of its blank-separated words, each with the blank or line end before it. Arrow cuts a slice of
    texts and numbers its distinct words; the library encodes those not remembered, all in one piece, which is then cut
    at the words' ends by the ids' byte lengths. A text in which some word is empty or has white space at an edge isn't
    put together from words but encoded by the library as it is. Strings of special tokens count as ordinary text.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max(names.values(), default=0) + 1, dtype=np.int64)
        self.bytes_of[list(names.values())] = [len(name) for name in names]  # one character stands for one byte
        del names
        self.memory = WordMemory(remembered)
        self.powers = np.zeros(0, dtype=np.uint64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _hashes(self, words) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each string of an Arrow array."""
        edges = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        raw = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[edges[0] : edges[-1]]
        edges -= edges[0]
        size = np.diff(edges)
        if len(self.powers) < size.max(initial=0):
            table = np.full(int(size.max()) * 2, _BASE, dtype=np.uint64)
            self.powers = np.cumprod(table, dtype=np.uint64)
        inside = np.arange(len(raw)) - np.repeat(edges[:-1], size)
        terms = _mixed(raw + np.uint64(1)) * self.powers[inside]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
        first = total[edges[1:]] - total[edges[:-1]]
        total[1:] = np.cumsum(_mixed(terms), dtype=np.uint64)
        return _mixed(first + size.astype(np.uint64)), _mixed(total[edges[1:]] - total[edges[:-1]])

    def _learn(self, words, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The flat ids and the sizes of new words, which are remembered."""
        import pyarrow as pa
        import pyarrow.compute as pc

        line = pc.starts_with(words, "\n")
        body = pc.if_else(line, pc.utf8_slice_codeunits(words, 1), words)
        plain = pc.and_(pc.not_equal(body, ""), pc.equal(pc.utf8_trim(body, SPACES), body))
        led = pc.if_else(line, words, pc.binary_join_element_wise(pa.scalar(" "), words, pa.scalar("")))
        led, plain = led.filter(plain), plain.to_numpy(zero_copy_only=False)
        ids = np.concatenate([self.whole(["".join(led.slice(k, LEARNED).to_pylist())])[0] for k in range(0, max(1, len(led)), LEARNED)])
        ends = np.cumsum(self.bytes_of[ids])
        cut = np.searchsorted(ends, np.cumsum(pc.binary_length(led).to_numpy(zero_copy_only=False)), side="right")
        size = np.full(len(words), -1, dtype=np.int64)
        size[plain] = np.diff(cut, prepend=0)
        self.memory.add(keys, checks, ids, size)
        return ids, size

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow array of strings (null: no ids), one text after the other, and each text's number of ids."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.string()), "")
        parts = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(pa.scalar("\n"), texts, pa.scalar("")), "\n", " \n"), " ")
        edges = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.values.slice(edges[0], edges[-1] - edges[0]).dictionary_encode()
        edges -= edges[0]
        words, which = coded.dictionary, coded.indices.to_numpy()
        keys, checks = self._hashes(words)
        number = self.memory.find(keys, checks)
        new = np.flatnonzero(number < 0)
        flat, start, size = self.memory.ids, self.memory.start[number].astype(np.int64), self.memory.size[number].astype(np.int64)
        if len(new):
            ids, own = self._learn(words.take(pa.array(new)), keys[new], checks[new])
            at, own_size = len(flat), np.maximum(own, 0)
            flat = np.concatenate((flat, ids))
            start[new], size[new] = at + np.cumsum(own_size) - own_size, own
        start, size = start[which], size[which]
        # the first part is what stands before the line end put in front; that line end is one id
        size[edges[:-1]] = 0
        start[edges[:-1] + 1] += 1
        odd = np.add.reduceat(size < 0, edges[:-1]) > 0 if len(texts) else np.zeros(0, bool)
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        size[edges[:-1] + 1] -= 1
        row = np.repeat(np.arange(len(texts)), np.diff(edges))
        size[odd[row] | empty[row]] = 0
        counts = np.add.reduceat(size, edges[:-1]) if len(texts) else np.zeros(0, np.int64)
        ids = _gathered(flat, start, size)
        rest = np.flatnonzero(odd & ~empty)
        if not len(rest):
            return ids, counts
        pieces = np.split(ids, np.cumsum(counts)[:-1])
        for k, own in zip(rest.tolist(), self.whole(texts.take(pa.array(rest)).to_pylist()), strict=True):
            pieces[k], counts[k] = own, len(own)
        return np.concatenate(pieces), counts

    def slices(self, texts) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first, last, ids, counts) of ``encode`` over stretches of about SLICE_BYTES of an Arrow array of strings."""
        import pyarrow as pa
        import pyarrow.compute as pc

        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            before = size[at - 1] if at else 0
            to = min(len(texts), max(at + 1, int(np.searchsorted(size, before + SLICE_BYTES))))
            yield at, to, *self.encode(texts.slice(at, to - at))
            at = to
        pa.default_memory_pool().release_unused()


def worker_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker; tasks that follow one another find its words remembered."""
    return held(("encoder", path), lambda: WordEncoder(path))
