"""Token ids and exact prefix counts for a BPE vocabulary with word ends, one Python object for each worker process.

White space ends every pre-token of such a vocabulary, so that a text's ids are those of its
white-space-delimited chunks, one after the other. Chunks repeat, thus each worker keeps the ids of
chunks it has met in a table of bounded size. That shortcut is taken only for texts of characters on
which normalisation cannot act across a chunk's border; the library itself does any other text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from functools import cache, cached_property
from itertools import islice

import numpy as np

#: Chunks kept by a worker; at about 250 bytes each.
KEPT = 120_000

#: Outside: what may compose or be special white space or a number other than 0-9; dotted capital I, whose lower case is two characters.
UNSAFE = re.compile("[^\t\n\r -~À-ÖØ-öø-įı-ķĹ-ňŊ-ž]|<\\|")
#: The vocabulary's pre-tokens, for safe characters in lower case.
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ž]+|[0-9]|[^\\sa-zÀ-ž0-9]+")
WORD_END = "</w>"
#: What the vocabulary's patterns call white space (Python's own notion has four control characters more).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f"[^{SPACE}]+")
#: Chunks of more code points than this have a stored count every so many.
STEP = 256


def byte_letters() -> list[str]:
    """A printable letter for each byte value: printable bytes stand for themselves, the others follow from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Known(dict):
    """What make() gave for the keys it was asked to keep; for any other key make() is asked."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        return self.make(key)


class WordBpe:
    """A vocabulary file of the tokenizers library, byte-level with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path = path
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.letters = byte_letters()
        self.known: dict[str, bytes] = Known(self._chunk)
        self.older: dict[str, bytes] = {}
        self.counted: dict[str, int] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.lower: dict[str, str] = {}

    # -- what only prefix counts need, read when they are first asked for -----------------------------

    def _file(self) -> dict:
        import json

        with open(self.path, encoding="utf-8") as f:
            return json.load(f)

    @cached_property
    def rank(self) -> dict[tuple[str, str], int]:
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in self._file()["model"]["merges"])
        return {pair: k for k, pair in enumerate(pairs)}

    @cached_property
    def parts(self) -> tuple[set[str], set[str], set[str]]:
        """Beginnings of tokens, tokens inside a word, and tokens at its end without the mark."""
        vocab = self._file()["model"]["vocab"]
        inside = {t for t in vocab if not t.endswith(WORD_END)}
        at_end = {t.removesuffix(WORD_END) for t in vocab if t.endswith(WORD_END)}
        return {t[:n] for t in inside | at_end for n in range(1, len(t) + 1)}, inside, at_end

    @cached_property
    def special(self) -> list[str]:
        return [t["content"] for t in self._file()["added_tokens"]]

    # -- ids ----------------------------------------------------------------------------------

    def letters_of(self, piece: str) -> str:
        return piece if piece.isascii() and piece.isprintable() else "".join(map(self.letters.__getitem__, piece.encode()))

    def _piece(self, piece: str) -> bytes:
        got = self.older.get(piece)
        if got is None:
            got = array("I", [t.id for t in self.model.tokenize(self.letters_of(piece))]).tobytes()
        if len(piece) <= 64:
            self.known[piece] = got
        return got

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk of safe characters in lower case that is not known, as little-endian 32-bit integers."""
        if chunk.isalpha():
            return self._piece(chunk)
        got = self.older.get(chunk)
        if got is None:
            known, size = self.known, len(self.known)
            got = b"".join([known.get(p) or self._piece(p) for p in PIECE.findall(chunk)])
            if len(known) > size:  # a chunk whose pieces are new may never come again
                return got
        if len(chunk) <= 64:
            self.known[chunk] = got
        return got

    def ids(self, text: str) -> bytes:
        """The text's ids as little-endian 32-bit integers, without added special tokens."""
        if UNSAFE.search(text):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self.known) > KEPT // 2:  # what is met again meanwhile stays
            self.known, self.older = Known(self._chunk), self.known
        return b"".join(map(self.known.__getitem__, text.lower().split()))

    # -- exact counts at every prefix -------------------------------------------------------------

    def _merged(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            best, at = min((self.rank.get(p, 1 << 60), k) for k, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if best == 1 << 60:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _fit(self, left: str, right: str) -> bool:
        """Whether merging left's and right's letters together ends with just these two tokens; left may be empty."""
        got = self.fits.get((left, right))
        if got is None:
            body, end = (right[: -len(WORD_END)], WORD_END) if right.endswith(WORD_END) else (right, "")
            symbols = [*left, *body]
            symbols[-1] += end
            got = self._merged(symbols) == [x for x in (left, right) if x]
            if len(self.fits) > KEPT:
                self.fits.clear()
            self.fits[left, right] = got
        return got

    def piece_prefixes(self, letters: str) -> list[int]:
        """Tokens of letters[:i] as a whole pre-token, for i from 0 to its length.

        Of a merged sequence every run of first tokens is what its letters merge to by themselves.
        Thus of all tokens that end at i just one fits the last token before it, known by then; one
        pass over the letters finds all counts, without encoding any prefix again.
        """
        size, fit, (starts, inside, at_end) = len(letters), self._fit, self.parts
        last: list[str | None] = [None] * (size + 1)
        inner, whole = [0] * (size + 1), [0] * (size + 1)
        last[0] = ""
        for i in range(size):
            left = last[i]
            if left is None:
                continue
            for j in range(i + 1, size + 1):
                body = letters[i:j]
                if body not in starts:
                    break
                if last[j] is None and body in inside and fit(left, body):
                    last[j], inner[j] = body, inner[i] + 1
                if not whole[j] and body in at_end and fit(left, body + WORD_END):
                    whole[j] = inner[i] + 1
        return whole

    def piece_count(self, letters: str) -> int:
        """piece_prefixes(letters)[-1]; word ends are tried at the last letter only."""
        size, fit, (starts, inside, at_end) = len(letters), self._fit, self.parts
        last: list[str | None] = [None] * (size + 1)
        inner = [0] * (size + 1)
        last[0] = ""
        for i in range(size):
            left = last[i]
            if left is None:
                continue
            for j in range(i + 1, size + 1):
                body = letters[i:j]
                if body not in starts:
                    break
                if j == size:
                    if body in at_end and fit(left, body + WORD_END):
                        return inner[i] + 1
                elif last[j] is None and body in inside and fit(left, body):
                    last[j], inner[j] = body, inner[i] + 1
        raise ValueError(f"no token ends {letters!r}")

    def _count(self, chunk: str) -> int:
        if (got := self.counted.get(chunk)) is not None:
            return got
        total = 0
        for piece in PIECE.findall(chunk):
            got = self.counted.get(piece)
            if got is None:
                got = len(self.model.tokenize(self.letters_of(piece)))
                if len(piece) <= 64:
                    self.counted[piece] = got
            total += got
        if len(chunk) <= 64:
            self.counted[chunk] = total
        return total

    def _normal(self, chunk: str) -> list[str] | None:
        """What the library makes of each character of a chunk without white space; None where that isn't what it makes of the chunk, or a special token is in it."""
        known = self.lower
        if len(known) > KEPT:
            known.clear()
        for c in set(chunk) - known.keys():
            known[c] = self.library.normalizer.normalize_str(c)
        low = [known[c] for c in chunk]
        return None if any(t in chunk for t in self.special) or self.library.normalizer.normalize_str(chunk) != "".join(low) else low

    def _pieces(self, low: str) -> list[tuple[str, str]]:
        """(piece, its letters): the library's own pre-tokens, whose notion of a letter is that of its tables and not of Python's."""
        return [(low[s:e], letters) for letters, (s, e) in self.library.pre_tokenizer.pre_tokenize_str(low)]

    def _odd_count(self, chunk: str) -> int:
        """Tokens of a chunk with characters that are not safe; the library encodes it where its characters don't stand for themselves."""
        if (got := self.counted.get(chunk)) is None:
            low = self._normal(chunk)
            got = len(self.library.encode(chunk, add_special_tokens=False).ids) if low is None else sum(self.piece_count(x) for _, x in self._pieces("".join(low)))
            if len(chunk) <= 64:
                self.counted[chunk] = got
        return got

    def _chunks(self, text: str) -> tuple[list[str], list[int]]:
        """The text's chunks of characters other than white space (in lower case where all are safe) and the tokens of each."""
        if len(self.counted) > KEPT:
            self.counted.clear()
        if UNSAFE.search(text):
            chunks = CHUNK.findall(text)
            return chunks, [self._odd_count(c) if UNSAFE.search(c) else self._count(c.lower()) for c in chunks]
        chunks = text.lower().split()
        found = [*map(self.counted.get, chunks)]
        if None in found:
            do = self._count
            found = [do(c) if got is None else got for c, got in zip(chunks, found, strict=True)]
        return chunks, found

    def chunk_counts(self, text: str) -> np.ndarray:
        """Tokens of the text up to the end of its k-th chunk, for k from 0.

        White space ends every pre-token, and no normalisation acts across it, so a prefix's count is that of the prefix before and its last chunk's.
        """
        return up_to(self._chunks(text)[1])

    def chunk_prefixes(self, chunk: str, first: int = 0, last: int | None = None, before: int = 0) -> list[int]:
        """Tokens of chunk[:i] for i from `first` to `last` of a chunk without white space, of any script, by piece_prefixes(); `before` are those of chunk[:first].

        Where the library takes a chunk character by character, the pre-tokens of a prefix are the chunk's own, the last cut short, and only the pre-tokens
        that reach into the range are gone through. Other chunks have these prefixes encoded.
        """
        last = len(chunk) if last is None else last
        low = self._normal(chunk)
        if low is None:
            counts = [len(self.library.encode(chunk[:i], add_special_tokens=False).ids) for i in range(first, last + 1)]
            return [c + before - counts[0] for c in counts]
        at_byte = np.cumsum([0, *(len(c.encode()) for c in low)])
        begin, end = at_byte[first], at_byte[last]
        counts, start, at = {0: 0}, 0, 0
        for piece, letters in self._pieces("".join(low)):
            size = len(letters)
            if at > end:
                break
            if at + size >= begin:  # counts from here on are right but for a shift, which the count at `first` gives
                if piece[0] == "'" and len(piece) > 1 and piece[1].isalpha():  # cut short, it is no contraction yet
                    of = [0, *(sum(self._count(x) for x in PIECE.findall(piece[:k])) for k in range(1, len(piece))), self._count(piece)]
                else:
                    of = self.piece_prefixes(letters)
                counts |= {at + k: start + of[k] for k in range(1, len(of))}
                start += of[-1]
            elif at + size not in counts:
                counts[at + size] = start
            at += size
        shift = before - counts[begin]
        return [counts[b] + shift for b in at_byte[first : last + 1]]

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of text[:i] for i from 0 to the text's length, exactly as the library counts them."""
        out, before = [0], 0
        for m in CHUNK.finditer(text):
            out += [before] * (m.start() + 1 - len(out))
            counts = self.chunk_prefixes(m[0])
            out += [before + c for c in counts[1:]]
            before += counts[-1]
        return out + [before] * (len(text) + 1 - len(out))

    def stored_counts(self, text: str) -> np.ndarray:
        """Tokens of the text up to each of its stops(), from 0: what a store keeps to answer from."""
        chunks, found = self._chunks(text)
        counts = up_to(found)
        if max(map(len, chunks), default=0) <= STEP:
            return counts
        chunks = CHUNK.findall(text)
        out = [np.zeros(1, np.int32)]
        for chunk, before, after in zip(chunks, counts[:-1], counts[1:], strict=True):
            inner = before + np.array(self.chunk_prefixes(chunk)[STEP:-1:STEP], np.int32) if len(chunk) > STEP else []
            out += [np.asarray(inner, np.int32), after[None]]
        return np.concatenate(out)

    def cut(self, text: str, limit: int, counts: np.ndarray | None = None) -> int:
        """The length of the longest prefix of at most `limit` tokens: between two stops by their stored counts, then by the prefixes between these."""
        counts = self.stored_counts(text) if counts is None else counts
        if counts[-1] <= limit:
            return len(text)
        k = int(np.searchsorted(counts, limit, side="right"))  # the k-th stop, from 1, is the first that doesn't fit
        chunk, first, last = next(islice(stops(text), k - 1, None))
        inside = self.chunk_prefixes(chunk[0], first, last, int(counts[k - 1]))
        return chunk.start() + first + max(i for i, c in enumerate(inside) if c <= limit)


def up_to(found: list[int]) -> np.ndarray:
    out = np.zeros(len(found) + 1, np.int32)
    np.cumsum(np.fromiter(found, np.int32, len(found)), out=out[1:])
    return out


def stops(text: str):
    """(chunk, from, to) for each stretch with a stored count at its end: chunks of characters other than white space, long ones in stretches of STEP."""
    for m in CHUNK.finditer(text):
        for first in range(0, len(m[0]), STEP):
            yield m, first, min(first + STEP, len(m[0]))


@cache
def word_bpe(path: str) -> WordBpe:
    """The vocabulary at path, loaded once in each process."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordBpe(path)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
