"""Splitting texts into the words that byte-level BPE encodes one by one."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex

# What \p{L}, \p{N} and \s of the public pattern match among the first 256 code points.
LATIN_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
LATIN_NUMBERS = "0-9²³¹¼½¾"
LATIN_SPACES = r"\t-\r \x85\xa0"

_latin = re.compile(
    public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{LATIN_SPACES}{LATIN_LETTERS}{LATIN_NUMBERS}]")
    .replace(r"\p{L}", f"[{LATIN_LETTERS}]")
    .replace(r"\p{N}", f"[{LATIN_NUMBERS}]")
    .replace(r"\S", f"[^{LATIN_SPACES}]")
    .replace(r"\s", f"[{LATIN_SPACES}]")
)
_any = regex.compile(public_tokenizers.PATTERN)
_space_run = re.compile(r" \s")


def split_words(text: str) -> list[str]:
    """All matches of the public pattern; texts of the first 256 code points take a faster equal pattern."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _any.findall(text)
    return _latin.findall(text)


def _heads_and_rests(texts: list[str]) -> tuple[list[list[str]], list[str | None]]:
    """The words of each text up to its first space, and what follows that space (None: nothing).

    A match of the pattern always ends before a space, unless white space follows that space; so the words of the rest
    are those of each of its pieces between spaces, with the space before it. A text with a space before white space is
    all head.
    """
    heads, rests = [], []
    for text in texts:
        start, gap, rest = (text, "", None) if _space_run.search(text) else text.partition(" ")
        heads.append(split_words(start))
        rests.append(rest if gap else None)
    return heads, rests


@contextmanager
def _uncollected() -> Iterator[None]:
    """Python's search for reference cycles is off: it would walk through all that is remembered, which has none."""
    was_on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was_on:
            gc.enable()


class _Recent:
    """Values of keys, of which the older half is forgotten whenever the newer half holds ``most``."""

    def __init__(self, most: int):
        self.most = most
        self.new: dict[str, tuple[bytes, ...]] = {}
        self.old: dict[str, tuple[bytes, ...]] = {}

    def find(self, keys: list[str]) -> list[tuple[bytes, ...] | None]:
        """The values of the keys, None for unknown ones; what is found in the older half moves to the newer one."""
        if len(self.new) > self.most:
            self.new, self.old = {}, self.new
        found = list(map(self.new.get, keys))
        for i, value in enumerate(found):
            if value is None and (value := self.old.get(keys[i])) is not None:
                found[i] = self.new[keys[i]] = value
        return found


class PieceMemory:
    """Numbers made of words, put together text by text.

    ``encode`` gives for a list of new words, for each of ``kinds`` (a numpy dtype), their numbers as bytes. What was made
    of recent words and of recent pieces between spaces is remembered, twice ``most`` of each and those of one call; results
    do not depend on it.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[bytes]]], kinds: list[str], most: int = 350_000):
        self.encode, self.kinds = encode, kinds
        self.words, self.pieces = _Recent(most), _Recent(most)

    def _of_words(self, words: list[str]) -> dict[str, tuple[bytes, ...]]:
        found = self.words.find(words)
        new = [w for w, value in zip(words, found, strict=True) if value is None]
        made = dict(zip(new, zip(*self.encode(new), strict=True), strict=True)) if new else {}
        self.words.new.update(made)
        return {w: made[w] if value is None else value for w, value in zip(words, found, strict=True)}

    def _known(self, heads: list[list[str]], pieces: list[str]) -> tuple[dict[str, tuple[bytes, ...]], list[tuple[bytes, ...]]]:
        """What the words of the heads and each piece became."""
        known = self.pieces.find(pieces)
        new = [i for i, k in enumerate(known) if k is None]
        inside = [[" " + p] if p.isascii() and p.isalpha() else split_words(" " + p) for p in (pieces[i] for i in new)]
        of_word = self._of_words(list(set().union(*heads, *inside)))
        for i, parts in zip(new, inside, strict=True):
            found = [of_word[w] for w in parts]
            known[i] = self.pieces.new[pieces[i]] = found[0] if len(found) == 1 else tuple(map(b"".join, zip(*found, strict=True)))
        return of_word, known

    def join(self, texts: list[str]) -> Iterator[tuple[bytes, ...]]:
        """For each text, the numbers of all its words in order, of each kind."""
        heads, rests = _heads_and_rests(texts)
        lists = pc.split_pattern(pa.array(rests, pa.string()), " ")
        coded = lists.flatten().dictionary_encode()
        with _uncollected():
            of_word, known = self._known(heads, coded.dictionary.to_pylist())
        codes = coded.indices.to_numpy()
        bounds = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))))
        made = []
        for kind, dtype in enumerate(self.kinds):
            size = np.dtype(dtype).itemsize
            lengths = np.fromiter((len(k[kind]) // size for k in known), np.int64, len(known))
            flat = np.frombuffer(b"".join([k[kind] for k in known]), dtype)
            each = lengths[codes]
            ends = np.concatenate(([0], np.cumsum(each)))
            at = np.arange(ends[-1]) + np.repeat((np.cumsum(lengths) - lengths)[codes] - ends[:-1], each)
            made.append((flat[at], ends[bounds].tolist()))
        for i, head in enumerate(heads):
            words = [of_word[w] for w in head]
            yield tuple(b"".join([w[k] for w in words]) + data[ends[i] : ends[i + 1]].tobytes() for k, (data, ends) in enumerate(made))
