"""Byte-pair encoders for tasks: exact token ids and prefix counts, with a bounded memo of what was seen.

Both classes take a vocabulary file of the `tokenizers` library and give what that library gives. Text is cut
where no token can span, each distinct piece is worked out once for a worker, and the rest is look-ups.
"""

import json
import re
import unicodedata
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: Bytes, roughly, of the pieces that a worker remembers, in each of two generations of each of its maps.
MEMO = 72 << 20
#: What an entry costs besides its texts.
ENTRY = 200
#: Pairs of tokens of which a worker remembers whether one may follow the other.
PAIRS = 600_000


def _byte_of() -> dict[str, int]:
    """The byte for each printable stand-in character of a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Memo:
    """A map of at most 2 * shares * MEMO bytes, roughly, and one text's keys; the generation that was filled longest ago goes first."""

    def __init__(self, make, shares: int = 1):
        self.new: dict = {}
        self.shares = shares
        self.old: dict = {}
        self.make = make
        self.size = 0

    def fill(self, keys) -> dict:
        """A map that has all the keys."""
        if self.size > self.shares * MEMO:
            self.old, self.new, self.size = self.new, {}, 0
        new, old = self.new, self.old
        for k in keys:
            if k not in new:
                v = old.get(k)
                new[k] = v = self.make(k) if v is None else v
                self.size += ENTRY + 2 * len(k) + (len(v) if isinstance(v, bytes) else 8 * len(v))
        return new

    def get(self, key):
        v = self.new.get(key)
        return v if v is not None else self.fill((key,))[key]

    def joined(self, keys: list) -> bytes:
        try:
            return b"".join(map(self.new.__getitem__, keys))
        except KeyError:
            return b"".join(map(self.fill(keys).__getitem__, keys))


class WordIds:
    """Ids of a lower-casing word vocabulary: white space is dropped, a word's last token bears an end mark.

    A word's bytes are encoded with 0xFF, which UTF-8 never holds, as the end mark; merging the pair of least
    rank is then what the library does, since each token's parts have lower ranks than it. Pieces with characters
    beyond Latin letters go to the library itself, and so do texts that hold a special token's string.
    """

    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    #: The same pieces of lower-case ASCII.
    ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+").findall
    PLAIN = re.compile("[!-~À-İı-ž]+").fullmatch
    NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        byte_of = _byte_of()
        raw = lambda t: bytes(byte_of[c] for c in t)
        special = [t["content"] for t in model["added_tokens"]]
        ranks = {(raw(t[:-4]) + b"\xff" if t.endswith("</w>") else raw(t)): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.core = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.library = Tokenizer.from_file(path)
        self.special = special
        self.dtype = np.dtype("<u2") if max(model["model"]["vocab"].values(), default=0) < 65536 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        # Chunks only: their words are made anew, which costs less than a second map to remember them in.
        self.chunk = Memo(self._chunk, 2)

    def _word(self, word: str) -> bytes:
        return array(self.code, self.core.encode_single_piece(word.encode() + b"\xff")).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isprintable():
            low = chunk.lower()
            return self._word(low) if low.isalpha() else b"".join(map(self._word, self.ASCII(low)))
        if not self.PLAIN(chunk) or "İ" in chunk:
            return np.array(self.library.encode(chunk, add_special_tokens=False).ids, self.dtype).tobytes()
        return b"".join(map(self._word, self.PIECES.findall(unicodedata.normalize("NFC", chunk).lower())))

    def ids(self, text: str) -> bytes:
        """The ids as little-endian integers of self.dtype."""
        if any(s in text for s in self.special) or any(c in text for c in self.NOT_SPACE):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        return self.chunk.joined(text.split())


class PrefixCounts:
    """Token counts of every prefix of a text, for a byte-level vocabulary.

    Within a piece that the vocabulary's pattern cuts out, the last token of each prefix is found from those of
    shorter prefixes: it is the one token that ends there and may follow the last token of the prefix before it.
    So count[i] = count[i - len(token)] + 1, and no prefix is encoded anew. Steps from prefix to prefix are kept
    as 16-bit integers, which joined over a text's pieces and summed give the count at every code point.
    """

    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    BESIDE = re.compile(r" \s|\s ")
    CUT = re.compile(r"(?<=\S)(?= \S)")
    TWO_SPACES = re.compile(r"\s\s").search

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        byte_of = _byte_of()
        self.special = [t["content"] for t in model["added_tokens"] if t["special"]]
        ranks = {bytes(byte_of[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in self.special}
        # Of special strings that begin at one place, the longest counts.
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.core = tiktoken.Encoding("bytes", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.ends = ahocorasick.Automaton()
        self.bytes_of = {i: b for b, i in ranks.items()}
        for b, i in ranks.items():
            self.ends.add_word(b.decode("latin-1"), (len(b), i))
        self.ends.make_automaton()
        self.follows: dict[int, bool] = {}  # by first << 20 | second
        self.piece = Memo(self._piece)
        self.piece_steps = Memo(lambda piece: self._steps_of(self._piece(piece)))
        self.chunk = Memo(self._chunk)

    def _may_follow(self, a: int, b: int) -> bool:
        if len(self.follows) > PAIRS:
            self.follows.clear()
        found = self.follows[a << 20 | b] = self.core.encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return found

    def _by_byte(self, raw: bytes) -> list[int]:
        """count[i] for the first i bytes of one piece."""
        n = len(raw)
        count, last, known = [0] * (n + 1), [-1] * (n + 1), self.follows.get
        for end, (size, token) in self.ends.iter(raw.decode("latin-1")):
            i = end + 1
            if last[i] < 0:
                j = i - size
                if j:
                    fits = known(last[j] << 20 | token)
                    if not (self._may_follow(last[j], token) if fits is None else fits):
                        continue
                last[i], count[i] = token, count[j] + 1
        return count

    def _piece(self, piece: str) -> tuple[int, ...]:
        """Counts at the code points of one piece, from 1 on."""
        raw = piece.encode()
        count = self._by_byte(raw)
        if len(raw) == len(piece):
            return tuple(count[1:])
        at, out = 0, []
        for c in piece:
            at += len(c.encode())
            out.append(count[at])
        return tuple(out)

    def _counts(self, text: str) -> list[int]:
        """Counts at every code point of a text without special tokens, from 1 on."""
        out: list[int] = []
        before = 0
        run, run_before = "", 0  # the white space that ends what has been read, and the count before it
        for m in self.PIECES.finditer(text):
            piece = m.group()
            if piece.isspace():
                if not run:
                    run_before = before
                run += piece
                out += [run_before + c for c in self.piece.get(run)[-len(piece) :]]
                before += self.piece.get(piece)[-1]
                continue
            counts = self.piece.get(piece)
            for k, c in enumerate(counts, 1):
                if k < len(counts) and piece[0] == "'" and k > 1 and piece[1].isalpha():
                    c = sum(self.piece.get(p)[-1] for p in self.PIECES.findall(piece[:k]))
                elif k == 1 and run and piece[0] == " ":  # so far it only lengthens the white space before
                    c = run_before + self.piece.get(run + " ")[-1] - before
                out.append(before + c)
            before += counts[-1]
            run = ""
        return out

    def _chunk(self, chunk: str) -> bytes:
        if "'" not in chunk and not self.TWO_SPACES(chunk):  # each piece's prefixes stand for themselves
            return b"".join(map(self.piece_steps.get, self.PIECES.findall(chunk)))
        return self._steps_of(self._counts(chunk))

    @staticmethod
    def _steps_of(counts) -> bytes:
        before, out = 0, []
        for c in counts:
            out.append(c - before)
            before = c
        return array("h", out).tobytes()

    def steps(self, text: str) -> bytes:
        """Steps of the count from code point to code point."""
        if not any(s in text for s in self.special):
            return self._plain(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            # A special string is one token once whole, and plain text before that.
            before, mark = text[at : m.start()], m.group()
            head = self._plain(before)
            partly = np.frombuffer(self._plain(before + mark[:-1]), "<i2").astype(np.int64)
            until = int(np.frombuffer(head, "<i2").sum(dtype=np.int64))
            own = np.append(partly[len(before) :], until + 1 - int(partly.sum()))
            own[0:1] += int(partly[: len(before)].sum()) - until if len(mark) > 1 else 0
            out += [head, own.astype("<i2").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        if self.BESIDE.search(text):
            return self.chunk.joined(self.CUT.split(text))
        head, *rest = text.split(" ")
        chunks = [" " + c for c in rest]
        return self.chunk.joined([head, *chunks] if head else chunks)


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


@lru_cache(2)
def prefix_counts(path: str) -> PrefixCounts:
    return PrefixCounts(path)
