"""Token ids of whole texts, for tokenizers that drop white space, with a bounded memory of the pieces seen before."""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np

from scoreframe.llm.texthash import SPACED, run_hashes

#: The string of a special token that parts pieces which are encoded together, and its id.
_PART, _PART_ID = "<|endoftext|>", 49407
#: Bytes that are worked on at once; a longer text is taken in parts that end at white space.
CHUNK = 2_000_000
#: Classes of the ASCII bytes that a run is told by: 1 letters, 2 marks but the apostrophe, 3 digits; 0 white space, 4 all else.
_CLASS = np.array([0 if b in b" \t\n\x0b\x0c\r" else 1 if 97 <= b <= 122 else 3 if 48 <= b <= 57 else 2 if 33 <= b <= 126 and b != 39 and not 65 <= b <= 90 else 4 for b in range(256)], np.uint8)
_MARKED = re.compile(r"(.+?)([!-&(-/:-@\[-`{-~]*)", re.DOTALL)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file, as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _only_letters(text: str) -> bool:
    """Whether a text is one run of letters for the tokenizer and stays as it is when normalised; in doubt, no."""
    return text.isalpha() and max(text) < "԰" and text.lower() == text and unicodedata.is_normalized("NFC", text)


@functools.lru_cache(1)
def _byte_letters() -> dict[int, int]:
    """What byte-level vocabularies write for each byte: printable ones as they are, the rest in order from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


def _gather(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of a pool, one after the other."""
    stop = np.cumsum(size)
    return pool[np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin - stop + size, size)]


class WordTokenizer:
    """Encodes texts piece by piece between ASCII white space, which the tokenizer drops, so pieces don't depend on each other.

    The tokenizer lower-cases, so A-Z are lower-cased first, which leaves fewer pieces to remember; texts that might hold
    the string of a special token are left as they are. ``special``: whether the strings of special tokens in a text stand
    for those tokens. Ids are 16-bit. Pieces are known by 64-bit hashes: of a million, two share one with a probability of 3e-8.
    """

    MOST = 2_000_000

    def __init__(self, path: str, special: bool = True):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.parting = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        #: The same vocabulary and merges for runs that are told apart beforehand.
        self.runs = Tokenizer(self.tokenizer.model)
        self.runs.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        #: Whether a token ends a run.
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        """Known pieces: their hashes in order, where their ids begin in the pool, and how many these are."""
        self.known, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, "<u2")

    def _encode_runs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, where each run's ids end) of texts that hold runs parted by spaces."""
        parts = [" ".join(texts[i : i + 500]) for i in range(0, len(texts), 500)]
        ids = np.concatenate([np.zeros(0, "<u2"), *[np.array(c.ids, "<u2") for c in self.runs.encode_batch_fast(parts, add_special_tokens=False)]])
        return ids, np.flatnonzero(self.ends[ids]) + 1

    def _encode_plain(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each piece has) of pieces of lower-case ASCII letters, digits and marks but the apostrophe."""
        data = np.frombuffer(b" ".join(pieces), np.uint8)
        kind = _CLASS[data]
        before = np.append(np.uint8(0), kind[:-1])
        run = (kind != 0) & ((kind != before) | (kind == 3))
        inside = np.flatnonzero(run & (before != 0))  # runs that begin within a piece get a space before them
        spaced = np.insert(data, inside, 32).tobytes().decode()
        ids, stops = self._encode_runs(spaced.split(" "))
        last = np.cumsum(np.add.reduceat(run, np.flatnonzero((kind != 0) & (before == 0)), dtype=np.int64))
        return ids, np.diff(stops[last - 1], prepend=0)

    def _encode_new(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each piece has): plain pieces by their runs, words beyond ASCII with or without marks as well,
        and the rest by the whole tokenizer, parted by a special token, or alone where a piece may hold one."""
        low = [p if b"<|" in p else p.lower() for p in pieces]
        flat = _CLASS[np.frombuffer(b" ".join(low), np.uint8)]
        odd = np.add.reduceat(flat == 4, np.append(0, np.cumsum([len(p) + 1 for p in low])[:-1]), dtype=np.int64) > 0
        plain, words, marks, others, alone = [], [], [], [], []
        for i, p in enumerate(low):
            if b"<|" in p:
                alone.append(i)
            elif not odd[i]:
                plain.append(i)
            else:
                word, mark = _MARKED.fullmatch(p.decode()).groups()
                if _only_letters(word):
                    words.append(i)
                    marks.append(f"{word.encode().decode('latin-1').translate(_byte_letters())} {mark}".rstrip())
                else:
                    others.append(i)
        order, parts, sizes = np.array(plain + words + others + alone, np.int64), [], []
        if plain:
            ids, size = self._encode_plain([low[i] for i in plain])
            parts.append(ids)
            sizes.append(size)
        if words:
            ids, stops = self._encode_runs(marks)
            last = np.cumsum([1 + (" " in m) for m in marks])
            parts.append(ids)
            sizes.append(np.diff(stops[last - 1], prepend=0))
        for at in range(0, len(others), 500):
            text = _PART.join([low[i].decode() for i in others[at : at + 500]])
            ids = np.array(self.parting.encode(text, add_special_tokens=False).ids, "<u2")
            parts.append(ids[ids != _PART_ID])
            sizes.append(np.diff(np.append(np.flatnonzero(ids == _PART_ID), len(ids)), prepend=-1) - 1)
        for i in alone:
            parts.append(np.array(self.tokenizer.encode(low[i].decode(), add_special_tokens=False).ids, "<u2"))
            sizes.append(np.array([len(parts[-1])]))
        ids, size = np.concatenate(parts), np.concatenate(sizes)
        back = np.argsort(order)  # from the groups' order to that of the pieces
        begin = (np.cumsum(size) - size)[back]
        return _gather(ids, begin, size[back]), size[back]

    def _encode_chunk(self, chunk: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start of each piece in the chunk, how many ids it has, all ids)."""
        data = np.frombuffer(chunk, np.uint8)
        edges = np.append(np.flatnonzero(np.diff(SPACED[data], prepend=np.uint8(0))), len(data))
        start, end = edges[:-1:2], edges[1::2]  # pieces and white space take turns, a piece first
        start = start[: len(end)]
        if not len(start):
            return start, np.zeros(0, np.int64), np.zeros(0, "<u2")
        hashes, first, place = np.unique(run_hashes(data, start, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, hashes)
        new = (at == len(self.known)) | (np.append(self.known, np.uint64(0))[at] != hashes)
        if new.any():
            if len(self.known) + np.count_nonzero(new) > self.MOST:
                self._forget()
                at, new = np.zeros(len(hashes), np.int64), np.ones(len(hashes), bool)
            ids, size = self._encode_new([chunk[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
            begin = len(self.pool) + np.cumsum(size) - size
            self.known, self.begin, self.size = np.insert(self.known, at[new], hashes[new]), np.insert(self.begin, at[new], begin), np.insert(self.size, at[new], size)
            self.pool = np.concatenate([self.pool, ids])
            at = at + np.cumsum(new) - new
        at = at[place]
        return start, self.size[at], _gather(self.pool, self.begin[at], self.size[at])

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids of the texts, one text after the other; where each text's ids end)."""
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        whole = b"\n".join([d if b"<|" in d else d.lower() for d in raw]) + b"\n"
        ends = np.cumsum([len(d) + 1 for d in raw])
        at, starts, sizes, out = 0, [], [], []
        while at < len(whole):
            stop = at + CHUNK
            if stop < len(whole):
                stop = 1 + min((p for p in (whole.find(b" ", stop), whole.find(b"\n", stop)) if p >= 0), default=len(whole) - 1)
            start, size, ids = self._encode_chunk(whole[at:stop])
            starts.append(start + at)
            sizes.append(size)
            out.append(ids)
            at = stop
        count = np.append(0, np.cumsum(np.concatenate(sizes)))
        return np.concatenate(out), count[np.searchsorted(np.concatenate(starts), ends)]

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian 16-bit numbers."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """The same for many texts, whose unseen pieces are encoded together."""
        if not texts:
            return []
        ids, ends = self.encode_flat(texts)
        data, stops = ids.tobytes(), (2 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]


@functools.lru_cache(4)
def word_tokenizer(path: str, special: bool = True) -> WordTokenizer:
    """One tokenizer for each worker process."""
    return WordTokenizer(path, special)
