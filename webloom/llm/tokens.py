"""Token ids of whole texts by a public vocabulary, at the speed of a dictionary lookup a word.

BPE never merges across the pieces that a vocabulary's pre-tokeniser cuts a text into, and a single
blank between two non-blank characters always starts such a piece. So a text is cut there, each
distinct piece that isn't remembered goes through the library, and a text's ids are the concatenation of its pieces'.
A text that holds the string of a special token is cut there first by the library, so that blanks beside
it count as ends of a text: such texts go through the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from itertools import chain

import numpy as np

#: White space as Unicode defines it; the vocabularies' patterns call it \s.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Where one of these stands, a blank isn't single.
_UNEVEN = tuple({f" {x}" for x in SPACE} | {f"{x} " for x in SPACE})
_PIECES = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Letters, then ASCII punctuation but the apostrophe: either vocabulary cuts such a piece between the two only.
_PLAIN = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where printable, else one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(0x100 + n) for n, b in enumerate(hidden)}


_BYTES = _byte_letters()
#: Pieces that are encoded at once.
BLOCK_PIECES = 200_000


class _Slots:
    """64-bit keys to numbers, in a table of fixed size with open addressing; all its work is on whole arrays.

    Takes 12 bytes a slot. Keys are hashes of pieces: a new piece is taken for one of n known ones with probability n / 2^64.
    """

    def __init__(self, bits: int):
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.numbers = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers; -1 where a key is new."""
        slot = self._first(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.numbers[slot], np.int32(-1))
        todo = np.flatnonzero((held != keys) & (held != 0))
        at = slot[todo]
        while len(todo):
            at = (at + 1) & self.mask
            held, wanted = self.keys[at], keys[todo]
            hit = held == wanted
            out[todo[hit]] = self.numbers[at[hit]]
            going = ~hit & (held != 0)
            todo, at = todo[going], at[going]
        return out

    def add(self, keys: np.ndarray, first: int) -> None:
        """New, distinct keys, numbered from first on."""
        todo, at = np.arange(len(keys)), self._first(keys)
        while len(todo):
            free = np.flatnonzero(self.keys[at] == 0)
            self.keys[at[free]] = keys[todo[free]]  # of several that want a slot, the last gets it
            won = self.keys[at] == keys[todo]
            self.numbers[at[won]] = todo[won] + first
            todo, at = todo[~won], (at[~won] + 1) & self.mask


def pieces(text: str) -> list[str]:
    """The text in parts that can be encoded one by one.

    A part is written without its leading blank; one that has none gets a trailing blank instead. So
    most parts are the very strings that splitting at blanks yields.
    """
    if text[0] == " " or text[-1] == " " or any(x in text for x in _UNEVEN):
        return [x[1:] if len(x) > 1 and x[0] == " " and x[1] not in SPACE else f"{x} " for x in _PIECES.findall(text)]
    out = text.split(" ")
    out[0] += " "
    return out


def spelled(piece: str) -> str:
    """The text of a part."""
    return piece[:-1] if piece[-1] == " " else f" {piece}"


class Encoder:
    """ids(texts): for each text an array of unsigned 32-bit ids.

    Remembers max_pieces pieces, about 50 bytes each (24 in the table of slots, 8 for the place of their ids, and
    these), and forgets all of them when they are more: 50 MB a worker by default.
    """

    def __init__(self, path: str, max_pieces: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.max_pieces = max_pieces
        self.lower = "Lowercase" in str(self.tokenizer.normalizer)  # such a vocabulary drops white space too
        special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.heads = {h for x in special for h in (x[0].lower(), x[0].upper())}
        self.special = re.compile("|".join(map(re.escape, special)), re.IGNORECASE if self.lower else 0)
        self._forget()

    def _forget(self) -> None:
        # a block of texts may add BLOCK_PIECES to max_pieces, and half of the slots stay free
        self.slots = _Slots((2 * (self.max_pieces + BLOCK_PIECES)).bit_length())
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1, np.int64)  # of piece i in flat; one more entry than pieces

    def _part(self, part: str) -> Sequence[int]:
        """Ids of letters alone or punctuation alone: one piece of the pre-tokeniser, straight to the merges."""
        if self.lower:
            part = part.strip(" ").lower()
        if not part:
            return ()
        shown = part.replace(" ", _BYTES[0x20]) if part.isascii() else part.encode().decode("latin-1").translate(_BYTES)
        return [x.id for x in self.tokenizer.model.tokenize(shown)]

    def _learn(self, new: list[str]) -> None:
        ids: list[Sequence[int]] = []
        hard: list[tuple[int, str]] = []
        parts: dict[str, Sequence[int]] = {}
        for x in map(spelled, new):
            if plain := _PLAIN.fullmatch(x):
                both: Sequence[int] = ()
                for part in plain.groups():
                    if part:
                        found = parts.get(part)
                        if found is None:
                            found = parts[part] = self._part(part)
                        both = [*both, *found] if both else found
                ids.append(both)
            else:
                hard.append((len(ids), x))
                ids.append(())
        for (at, _), found in zip(hard, self.tokenizer.encode_batch_fast([x for _, x in hard], add_special_tokens=False), strict=True):
            ids[at] = found.ids
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        used = int(self.start[-1])
        need = used + int(lengths.sum())
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(need, len(self.flat) + len(self.flat) // 2) - len(self.flat), np.uint32)])
        self.flat[used:need] = np.fromiter(chain.from_iterable(ids), np.uint32, need - used)
        self.start = np.concatenate([self.start, used + np.cumsum(lengths)])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        whole = [i for i, text in enumerate(texts) if text and self._has_special(text)]
        if not whole:
            return self._by_pieces(texts)
        texts = list(texts)
        found = {}
        for i in whole:
            found[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
            texts[i] = ""
        return [found.get(i, x) for i, x in enumerate(self._by_pieces(texts))]

    def _has_special(self, text: str) -> bool:
        return any(h in text for h in self.heads) and self.special.search(text) is not None

    def _by_pieces(self, texts: list[str]) -> list[np.ndarray]:
        """A very long text is encoded in runs of BLOCK_PIECES of its pieces, so what a block holds is bounded."""
        out: list[np.ndarray] = []
        block: list[list[str]] = []
        size = 0
        for text in texts:
            own = pieces(text) if text else []
            if size + len(own) > BLOCK_PIECES:
                out += self._block(block)
                block, size = [], 0
            if len(own) > BLOCK_PIECES:
                out.append(np.concatenate([self._block([own[at : at + BLOCK_PIECES]])[0] for at in range(0, len(own), BLOCK_PIECES)]))
            else:
                block.append(own)
                size += len(own)
        return out + self._block(block)

    def _block(self, block: list[list[str]]) -> list[np.ndarray]:
        if not block:
            return []
        if len(self.start) > self.max_pieces:
            self._forget()
        counts = np.fromiter(map(len, block), np.int64, len(block))
        every = list(chain.from_iterable(block))
        keys = np.fromiter(map(hash, every), np.int64, len(every)).view(np.uint64)
        keys[keys == 0] = 1  # 0 is a free slot
        at = self.slots.find(keys)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, first, number = np.unique(keys[missing], return_index=True, return_inverse=True)
            known = len(self.start) - 1
            self._learn([every[i] for i in missing[first].tolist()])
            self.slots.add(new, known)
            at[missing] = number + known
        first = self.start[at]
        lengths = self.start[at + 1] - first
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(first - ends + lengths, lengths) + np.arange(total)]
        doc_ends = np.concatenate([[0], ends])[np.cumsum(counts)]
        return np.split(ids, np.asarray(doc_ends[:-1], np.int64))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per vocabulary and Python worker."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
