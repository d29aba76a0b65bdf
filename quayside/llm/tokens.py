"""Token ids of whole texts by a public tokenizer, remembered by space-separated chunk."""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from itertools import count, filterfalse, islice, pairwise

import numpy as np

from . import common

#: Chunks whose ids a worker keeps (about 230 bytes each); beyond that the latest learnt go, down to BACK of them: frequent
#: chunks are learnt early. Only speed and memory depend on it.
KEPT, BACK = 1_200_000, 0.625
#: Missing chunks that are encoded together.
TOGETHER = 4_000
#: White space of the tokenizers' patterns but for the space and the line break.
RARE = [chr(c) for c in (9, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]

#: Where a chunk may be cut besides its first space: a line break between characters that aren't white space, and a full
#: stop or comma at its end behind an ASCII letter or digit.
_line = re.compile(r"(?<=\S)\n(?=\S)")
_STOPS, _PLAIN = frozenset(".,"), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


class Encoder:
    """encode(texts) gives what encode_batch(texts, add_special_tokens=False) of the tokenizers library gives, as uint32 arrays.

    A pre-token of these tokenizers never holds a character that isn't white space with white space behind it, so a text
    may be cut before a space that follows such a character, and each chunk's ids depend on the chunk alone. The chunks
    repeat, so most ids come from a dictionary; the library encodes the others. Likewise a full stop or comma at a
    chunk's end, behind an ASCII letter or digit, is a pre-token of its own (other letters may become a letter and a mark
    in normalisation, which the full stop would join), and a single line break between two characters that aren't white
    space. Texts that hold a special token's string are encoded whole.
    """

    def __init__(self, path: str, kept: int = KEPT):
        from tokenizers import Tokenizer

        self.kept = kept
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.vocabulary = self.tokenizer.get_vocab_size()
        # Ids that end a word, by the model's suffix, or that start with a space (byte-level: a dotted G).
        suffix = self.tokenizer.model.end_of_word_suffix
        self.by_end = bool(suffix)
        self.marked = np.zeros(self.vocabulary, bool)
        self.marked[[i for t, i in self.tokenizer.get_vocab().items() if (t.endswith(suffix) if suffix else t.startswith("Ġ"))]] = True
        #: By chunk, and by chunk without the space that it starts with.
        self.first: dict = {}
        # What is looked up in vain gets the next number in place of ids.
        self.later: defaultdict = defaultdict(count().__next__, {None: b""})

    def _library(self, chunks: list[str], into: dict, space: str) -> None:
        for i in range(0, len(chunks), TOGETHER):
            part = chunks[i : i + TOGETHER]
            for c, e in zip(part, self.tokenizer.encode_batch_fast([space + c for c in part], add_special_tokens=False), strict=True):
                into[c] = array("I", e.ids).tobytes()

    def _letters(self, chunks: list[str], into: dict, space: str) -> None:
        """Chunks of letters alone: each is one pre-token, so many are encoded as one text and told apart by their first or last ids."""
        for i in range(0, len(chunks), TOGETHER):
            part = chunks[i : i + TOGETHER]
            ids = self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids
            data = array("I", ids).tobytes()
            marked = self.marked[np.frombuffer(data, np.uint32)]
            if self.by_end:
                ends = [0, *(4 * np.flatnonzero(marked) + 4).tolist()]
            else:
                ends = [*(4 * np.flatnonzero(marked)).tolist(), len(data)]
            if len(ends) != len(part) + 1 or ends[0] or ends[-1] != len(data):  # letters to Python, but not to the library
                self._library(part, into, space)
            else:
                into.update(zip(part, [data[a:b] for a, b in pairwise(ends)], strict=True))

    def _learn(self, chunks: set[str], into: dict, space: str) -> None:
        """Put the ids of chunks into a dictionary; space: what stands before each of them."""
        letters = list(filter(str.isalpha, chunks)) if space else []
        ended, whole, lines = [], [], []
        for c in filterfalse(str.isalpha, chunks) if space else chunks:
            if "\n" in c and _line.search(c):
                lines.append((c, _line.split(c)))
            elif c[-1:] in _STOPS and c[-2:-1] in _PLAIN:
                ended.append(c)
            else:
                whole.append(c)
        self._letters(letters, into, space)
        self._library(whole, into, space)
        # What is cut off is learnt by itself; neither kind of piece is cut into lines again.
        heads = {c[:-1] for c in ended}.union(x[0] for _, x in lines)
        if heads := {c for c in heads if into.get(c).__class__ is not bytes}:
            self._learn(heads, into, space)
        first = self.first
        if tails := {t for _, x in lines for t in x[1:]}.difference(first):
            self._learn(tails, first, "")
        if marks := {".", ",", "\n"}.difference(first):
            self._library(list(marks), first, "")
        for c in ended:
            into[c] = into[c[:-1]] + first[c[-1]]
        for c, (head, *rest) in lines:
            into[c] = first["\n"].join([into[head], *map(first.__getitem__, rest)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.later) > self.kept:
            self.later = defaultdict(count().__next__, islice(self.later.items(), int(BACK * self.kept)))
        if len(self.first) > self.kept // 10:
            self.first = dict(islice(self.first.items(), int(BACK * self.kept / 10)))
        first, later = self.first, self.later
        split: list[list | None] = []
        heads: list[str] = []
        for x in texts:
            if any(s in x for s in self.special):
                split.append(None)
                heads.append("")
                continue
            parts: list = x.split(" ")
            if x[:1] == " " or "  " in x or "\n " in x or any(g in x for g in RARE):
                merged = parts[:1]
                for p in parts[1:]:
                    if not merged[-1] or merged[-1][-1].isspace():
                        merged[-1] += " " + p
                    else:
                        merged.append(p)
                parts = merged
            heads.append(parts[0])
            parts[0] = None  # the first chunk has no space before it
            split.append(parts)
        if new := set(heads).difference(first):
            self._learn(new, first, "")
        # Each chunk is looked up once; those that are missing are learnt together, and their ids put in place of their numbers.
        get, before = later.__getitem__, len(later)
        split = [x if x is None else list(map(get, x)) for x in split]
        new = list(islice(reversed(later), len(later) - before))[::-1]
        base = later[new[0]] if new else 0
        if new:
            self._learn(set(new), later, " ")
        found, out = [later[c] for c in new], []
        for text, head, x in zip(texts, heads, split, strict=True):
            if x is None:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
            else:
                if new:
                    x = [v if v.__class__ is bytes else found[v - base] for v in x]
                x[0] = first[head]
                out.append(np.frombuffer(b"".join(x), np.uint32))
        return out


#: Characters of texts that are encoded together.
RUN = 6_000_000


def runs(texts: list[str], chars: int = RUN):
    """Slices of texts of about so many characters, or of one text."""
    a = held = 0
    for i, x in enumerate(texts):
        if held and held + len(x) > chars:
            yield slice(a, i)
            a, held = i, 0
        held += len(x)
    if a < len(texts):
        yield slice(a, len(texts))


_encoders: dict[tuple[str, int], Encoder] = {}
common.forget["tokens"] = _encoders.clear


def encoder(path: str, kept: int = KEPT) -> Encoder:
    """One encoder for each worker process, file and number of chunks to keep."""
    common.hold("tokens")
    if (path, kept) not in _encoders:
        _encoders.clear()
        _encoders[path, kept] = Encoder(path, kept)
    return _encoders[path, kept]
