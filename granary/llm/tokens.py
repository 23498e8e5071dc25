"""Token ids of whole texts, by the tokenizers library, with what a worker has encoded before kept at hand."""

from __future__ import annotations

import functools
import re
from array import array
from unicodedata import is_normalized

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

BYTE_LEVEL, WORD_LEVEL = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Words longer than this are encoded but not kept; when so many are kept, those that have not been used since the last such time are forgotten.
KEPT_LENGTH, KEPT_PIECES = 48, 120_000
#: The same for the word vocabulary's table of words with their marks, which Arrow holds.
KEPT_WORDS = 300_000
#: White space that the libraries may see differently; and letters whose lower case or composition depends on more than one character.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‍    ⁠　﻿]")
#: White space that keeps a text from being cut at single spaces and line feeds.
SPACE_RUNS = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\v", "\f")

#: The patterns by which the two vocabularies cut a text before they merge.
BYTE_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORD_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The same for ASCII alone, which is found faster.
ASCII_WORD_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^\sA-Za-z0-9]+", re.A)


def _byte_letters() -> dict[int, str]:
    """The visible character that stands for each byte in byte-level vocabularies: itself if printable Latin-1, else one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


def _lists(found: list[bytes]) -> pa.Array:
    """Ids of each, as lists of 32-bit integers."""
    ends = np.cumsum([0, *map(len, found)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))


class Encoder:
    """encode(text) gives the ids that the library gives for the whole text, as little-endian 32-bit integers; encode_all() does for many texts.

    Both vocabularies cut a text before they merge, and never across a single space or line feed between other
    characters, nor between a letter and a full stop or comma; so a word is encoded once and looked up afterwards.
    Texts with rare white space, with a special token's own string, (byte level) with white space next to white space or
    (word vocabulary) with characters whose lower case or composition depends on their neighbours go to the library whole; so
    do all texts with any other vocabulary, whose rules are not known here.
    """

    def __init__(self, name: str):
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.known = name in (BYTE_LEVEL, WORD_LEVEL)
        self.words = name == WORD_LEVEL
        #: Word vocabulary: ids of the pattern's matches, of those used lately and of those before; words, their ids, and whether each was used lately.
        self.kept: list[dict[str, bytes]] = [{}, {}]
        self.table = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32())), np.zeros(0, bool)
        if not self.known:
            return
        self.model = self.tokenizer.model
        added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.special = re.compile("|".join(map(re.escape, added)), re.I) if added else None
        #: Ids of words with a space before them, and without; of each the ones used lately and those before.
        self.spaced: list[dict[str, bytes]] = [{}, {}]
        self.bare: list[dict[str, bytes]] = [{}, {}]
        self.marks = {c: self.merge(c) for c in ".,\n"}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def merge(self, piece: str) -> bytes:
        """Ids of what the vocabulary's pattern leaves in one piece."""
        if piece[0] == " ":
            letters = "Ġ" + (rest if (rest := piece[1:]).isascii() else rest.encode().decode("latin-1").translate(BYTE_LETTERS))
        else:
            letters = piece if piece.isascii() and piece.isalpha() else piece.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def word(self, word: str, space: bool) -> bytes:
        """Byte level: ids of a stretch without white space, with or without a space before it."""
        kept, before = self.spaced if space else self.bare
        got = kept.get(word) or before.get(word)
        if got is None:
            if word.isalpha():
                got = self.merge(" " + word if space else word)
            elif word and word[-1] in ".," and word[:-1].isalpha():
                return self.word(word[:-1], space) + self.marks[word[-1]]
            else:
                got = b"".join(map(self.merge, BYTE_PATTERN.findall(" " + word if space else word)))
        if len(word) <= KEPT_LENGTH:
            kept[word] = got
        return got

    def words_after(self, tail: list[str], out: list[bytes]) -> None:
        """Byte level: adds the ids of words with a space before each."""
        kept = self.spaced[0]
        found = list(map(kept.get, tail))
        if None in found:
            marks, at = self.marks, -1
            try:
                while True:
                    at = found.index(None, at + 1)
                    word = tail[at]
                    stem = kept.get(word[:-1]) if word[-1] in ".," and word[:-1].isalpha() else None
                    found[at] = self.word(word, True) if stem is None else stem + marks[word[-1]]
            except ValueError:
                pass
        out += found

    def piece(self, piece: str) -> bytes:
        """Word vocabulary: ids of one match of its pattern."""
        kept, before = self.kept
        got = kept.get(piece)
        if got is None:
            got = before.get(piece) or self.merge(piece)
            if len(piece) <= KEPT_LENGTH:
                if len(kept) >= KEPT_PIECES:
                    self.kept = [kept := {}, kept]
                kept[piece] = got
        return got

    def bare_word(self, word: str) -> bytes:
        """Word vocabulary: ids of a stretch in lower case without white space; an empty one has none."""
        if word.isascii():
            if word.isalpha():
                return self.piece(word)
            pieces = ASCII_WORD_PATTERN.findall(word)
        # up to there all versions of Unicode agree on what a letter is
        elif max(word) < "\u0250" and word.isalpha():
            return self.piece(word)
        elif word[-1] in ".," and max(word) < "\u0250" and word[:-1].isalpha():
            return self.piece(word[:-1]) + self.marks[word[-1]]
        else:
            pieces = WORD_PATTERN.findall(word)
        return b"".join(map(self.piece, pieces))

    def apart(self, text: str) -> bool:
        """Whether a text goes to the library whole."""
        if not self.known or self.special and "<" in text and self.special.search(text) or ODD_SPACE.search(text):
            return True
        if self.words:
            return not text.isascii() and ("Σ" in text or not is_normalized("NFC", text))
        return text[0].isspace() or text[-1].isspace() or any(x in text for x in SPACE_RUNS)

    def looked_up(self, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Word vocabulary: the place of each of some different words in a table of ids, and that table."""
        known, ids, used = self.table
        at = pc.index_in(words, value_set=known)
        new = words.filter(at.is_null())
        fresh = _lists(list(map(self.bare_word, new.to_pylist())))
        places = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        used[places[places >= 0]] = True
        places[places < 0] = len(known) + np.arange(len(new))
        found = pa.concat_arrays([ids, fresh])
        short = pc.less_equal(pc.binary_length(new), 2 * KEPT_LENGTH)
        known, ids = pa.concat_arrays([known, new.filter(short)]), pa.concat_arrays([ids, fresh.filter(short)])
        used = np.concatenate([used, np.ones(len(known) - len(used), bool)])
        if len(known) > KEPT_WORDS:
            known, ids, used = known.filter(pa.array(used)), ids.filter(pa.array(used)), np.zeros(used.sum(), bool)
        self.table = known, ids, used
        return places, found

    def encode_all(self, texts: list[str], end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other and each with those of end after it, and how many each has.

        Word vocabulary: each word is looked up once for all these texts, and its ids are laid out by Arrow wherever it stands.
        """
        if not self.words:
            found = [self.encode(text) + end for text in texts]
            return np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found], np.int64)
        alone = np.array([self.apart(text) for text in texts], bool)
        words = pc.ascii_split_whitespace(pa.array(["" if whole else text.lower() for text, whole in zip(texts, alone, strict=True)], pa.string()))
        seen = words.flatten().dictionary_encode()
        places, known = self.looked_up(seen.dictionary)
        known, n = pa.concat_arrays([known, _lists([end, *(self.whole(texts[k]) for k in np.flatnonzero(alone))])]), len(known)
        # after a text's words come its own ids if it was encoded whole, then the end
        added, last = np.repeat(np.arange(len(texts)), 1 + alone), np.cumsum(1 + alone)
        what = np.full(len(added), n)
        what[last[alone] - 2] = n + 1 + np.arange(alone.sum())
        ends = np.asarray(words.offsets)[1:]
        order = np.insert(places[np.asarray(seen.indices)], ends[added], what)
        ids = known.take(pa.array(order)).flatten()
        sums = np.concatenate([[0], np.cumsum(np.diff(np.asarray(known.offsets))[order])])
        return np.asarray(ids).view("<u4"), np.diff(sums[np.concatenate([[0], ends + last])])

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.words:
            return self.encode_all([text])[0].tobytes()
        if self.apart(text):
            return self.whole(text)
        for kept in (self.spaced, self.bare):
            if len(kept[0]) > KEPT_PIECES:
                kept[:] = {}, kept[0]
        out: list[bytes] = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(self.marks["\n"])
            if line:
                head, *tail = line.split(" ")
                out.append(self.word(head, False))
                self.words_after(tail, out)
        return b"".join(out)


@functools.cache
def encoder(name: str) -> Encoder:
    """One for each worker process."""
    return Encoder(name)
