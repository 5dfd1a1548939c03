"""Texts to token ids with a given public tokenizer, quickly.

Encoding is by far the dearest step, and words recur. A tokenizer that drops white space and splits
at it gives the same ids word by word, so each Python worker encodes only words it doesn't know, in one batch
per slice of texts, and looks the others up. Its table has a digest of 128 bits and the ids of each word in flat arrays, some
thirty bytes a word, and is kept from task to task. When it is full it becomes the old one, and words still in use move from
there to a new one: memory is bounded, and words that recur are encoded once.
"""

from __future__ import annotations

import os
import sys
import types
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.arrays import Words, byte_table, stretches

#: Words in the newer and in the older table at most: some 10 MB each.
TABLE_WORDS = 300_000
#: Text that a task encodes at once.
SLICE_BYTES = 1 << 20

BLANKS = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Keys of the two halves of a digest.
KEYS = ("tidemark-words-1", "tidemark-words-2")
WORD_END = "</w>"


def digests(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers for each word, given in UTF-8."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    listed = words.to_numpy(zero_copy_only=False)
    first, second = (pd.util.hash_array(listed, hash_key=key, categorize=False) for key in KEYS)
    return first, second


Digests = tuple[np.ndarray, np.ndarray]


def picked(keys: Digests, which: np.ndarray) -> Digests:
    return keys[0][which], keys[1][which]


class WordTable:
    """Ids of words by digest: sorted digests, the place of each word, and the ids of each place one behind the other."""

    def __init__(self, kind: type):
        self.first, self.second = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int32)
        self.ids, self.ends, self.size = np.zeros(1 << 16, kind), np.zeros(1 << 14, np.int32), 0

    def find(self, keys: Digests) -> np.ndarray:
        """The place of each word, from 1; 0 if unknown."""
        found = np.zeros(len(keys[0]), np.int32)
        if not self.size:
            return found
        order = np.argsort(keys[0])  # neighbours are sought near each other
        first, second = picked(keys, order)
        at = np.searchsorted(self.first, first)
        for step in (0, 1):  # two words may share the first half of their digests
            here = np.minimum(at + step, self.size - 1)
            same = (self.first[here] == first) & (self.second[here] == second)
            found[order[same]] = self.place[here[same]]
        return found

    def add(self, keys: Digests, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Add words that are not in the table, and differ."""
        if not len(sizes):
            return
        stop, begin = self.size + len(sizes), int(self.ends[self.size])
        self.ids, self.ends = _room(self.ids, begin + len(ids)), _room(self.ends, stop + 1)
        self.ids[begin : begin + len(ids)] = ids
        self.ends[self.size + 1 : stop + 1] = begin + np.cumsum(sizes)
        order = np.argsort(keys[0], kind="stable")
        first, second = picked(keys, order)
        at = np.searchsorted(self.first, first)
        self.first, self.second = np.insert(self.first, at, first), np.insert(self.second, at, second)
        self.place = np.insert(self.place, at, (self.size + 1 + order).astype(np.int32))
        self.size = stop

    def ids_of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at these places, one word behind the other, and how many each has."""
        begins = self.ends[np.maximum(places - 1, 0)] * (places > 0)
        sizes = self.ends[places] - begins
        return self.ids[stretches(begins, sizes)], sizes


class WordEncoder:
    """Ids of texts, for a tokenizer whose ids don't depend on the words around a word.

    Words are what ASCII white space separates. An unknown word of Latin letters, perhaps followed by
    signs, is taken as its lower-case letters and its signs, as the tokenizer itself
    lowers case and splits there (``plain_parts``), and the letters are looked up again; any other word is encoded as it
    stands, special tokens included.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same model for words that are lower-case letters already: nothing to normalise, blanks part them.
        self.lean = Tokenizer(self.tokenizer.model)
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), byte_level])
        vocabulary = self.tokenizer.get_vocab()
        highest = max(vocabulary.values())
        self.kind = np.uint16 if highest < 1 << 16 else np.uint32
        self.ends_word = np.zeros(highest + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.table, self.old = WordTable(self.kind), WordTable(self.kind)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each text's ids begin (with the end of the last)."""
        split = Words(texts, BLANKS)
        coded = split.words.dictionary_encode()
        flat, sizes = self._known(coded.dictionary)
        sizes = sizes.astype(np.int32)
        ends = np.cumsum(sizes, dtype=np.int32)
        codes = coded.indices.to_numpy()
        begins, counts = (ends - sizes)[codes], sizes[codes]
        return flat[stretches(begins, counts)].astype(np.uint32), np.concatenate([[0], np.cumsum(counts)])[split.starts]

    def _known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, and how many each has; unknown ones are learned."""
        if self.table.size > TABLE_WORDS:
            self.table, self.old = WordTable(self.kind), self.table
        keys = digests(words)
        missing = self._missing(keys)
        if len(missing):
            self._learn(words.take(pa.array(missing)).cast(pa.string()), picked(keys, missing))
        return self.table.ids_of(self.table.find(keys))

    def _missing(self, keys: Digests) -> np.ndarray:
        """Which words neither table has; those that only the old one has move to the new one."""
        missing = np.flatnonzero(self.table.find(keys) == 0)
        before = self.old.find(picked(keys, missing))
        self.table.add(picked(keys, missing[before > 0]), *self.old.ids_of(before[before > 0]))
        return missing[before == 0]

    def _learn(self, words: pa.Array, keys: Digests) -> None:
        plain, letters, signs = plain_parts(words)
        letters = letters.dictionary_encode()
        self._learn_letters(letters.dictionary)
        signs = signs.dictionary_encode()
        of_letters = self.table.ids_of(self.table.find(digests(letters.dictionary.cast(pa.binary()))))
        of_signs = self._encoded(signs.dictionary.to_pylist())
        # Letters and signs of each word in turn, out of all letters and then all signs.
        flat = np.concatenate([of_letters[0], of_signs[0]])
        sizes = np.concatenate([of_letters[1], of_signs[1]])
        begins = np.cumsum(sizes) - sizes
        both = np.stack([letters.indices.to_numpy(), len(letters.dictionary) + signs.indices.to_numpy()], axis=1).ravel()
        self._add_new(picked(keys, plain), flat[stretches(begins[both], sizes[both])], sizes[both].reshape(-1, 2).sum(axis=1))
        self._add_new(picked(keys, ~plain), *self._encoded(words.filter(pa.array(~plain)).to_pylist()))

    def _add_new(self, keys: Digests, ids: np.ndarray, sizes: np.ndarray) -> None:
        new = self.table.find(keys) == 0  # plain letters are in the table by now
        self.table.add(picked(keys, new), ids[np.repeat(new, sizes)], sizes[new])

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return np.fromiter(chain.from_iterable(e.ids for e in coded), self.kind), np.array([len(e.ids) for e in coded], np.int64)

    def _learn_letters(self, words: pa.Array) -> None:
        """Add words of lower-case letters, many at once, if they are not in the table."""
        keys = digests(words.cast(pa.binary()))
        missing = self._missing(keys)
        new = words.take(pa.array(missing)).to_pylist()
        coded = self.lean.encode_batch_fast([" ".join(new[k : k + 256]) for k in range(0, len(new), 256)], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in coded), self.kind)
        cuts = np.flatnonzero(self.ends_word[ids]) + 1
        if len(cuts) != len(new):
            raise ValueError("this tokenizer doesn't mark the end of each word")
        self.table.add(picked(keys, missing), ids, np.diff(cuts, prepend=0))


def _room(array: np.ndarray, size: int) -> np.ndarray:
    return array if len(array) >= size else np.concatenate([array, np.zeros(max(size - len(array), len(array)), array.dtype)])


# Signs that may follow a word and are encoded apart, and the letters with no combining forms. U+0130 is
# not among them: its lower case has one, which joins with what follows.
SIGNS = ".,;:!?|"
SIMPLE_LETTERS = r"^[\x{0}-\x{12F}\x{131}-\x{24F}]+$"


def plain_parts(words: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Which words are letters, perhaps with signs behind them, that the tokenizer encodes alike and apart; of those, the
    letters in lower case, and the signs.

    The letters' lower case and composition act on each alone. A run of other characters than letters, digits,
    apostrophes and spaces behind them is a part of its own.
    """
    core = pc.utf8_rtrim(words, SIGNS)
    plain = pc.and_(pc.utf8_is_alpha(core), pc.match_substring_regex(core, SIMPLE_LETTERS))
    core, whole = core.filter(plain), words.filter(plain)
    bytes_of = lambda x: pc.binary_length(x).to_numpy()
    sizes = bytes_of(whole) - bytes_of(core)  # signs are single bytes
    raw, ends = np.frombuffer(b"".join(whole.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.uint8), np.cumsum(bytes_of(whole), dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    signs = pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(raw[stretches(ends - sizes, sizes)])])
    return plain.to_numpy(zero_copy_only=False), pc.utf8_lower(core), signs


def worker_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, kept from task to task."""
    kept = sys.modules.setdefault("_tidemark_encoders", types.ModuleType("_tidemark_encoders")).__dict__
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def id_bytes(path: str) -> int:
    """Bytes that hold any id of a tokenizer: 2 or 4."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(path).get_vocab().values()) < 1 << 16 else 4
