"""Token ids of whole texts, asked of a tokenizer once for each distinct piece of a word."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .common import split_words

# Pieces of words that a task remembers, and pieces that the tokenizer reads as one text.
REMEMBERED = 600_000
AT_ONCE = 20_000
# Letters that every version of Unicode counts as such and that no normal form joins with what stands beside them.
LETTERS = (
    "a-z\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{2AF}\\x{391}-\\x{3A1}\\x{3A3}-\\x{3CE}\\x{400}-\\x{481}"
    "\\x{48A}-\\x{52F}\\x{3041}-\\x{3096}\\x{30A1}-\\x{30FA}\\x{4E00}-\\x{9FA5}\\x{AC00}-\\x{D7A3}"
)
SIGNS = "!-&(-/:-@\\[-`{-~"
PLAIN = f"^[{LETTERS}0-9{SIGNS}]+$"
RUNS = f"([{LETTERS}]+|[0-9]|[{SIGNS}]+)"


class WordIds:
    """Token ids of texts; the ids of a piece of a word are asked of the tokenizer once and remembered.

    That is exact for tokenizers that fold case, split at white space, which they drop, and keep runs of
    letters, single digits and runs of signs apart.  Words of such plain characters are cut into their runs;
    words with an apostrophe (which may begin a token), a special token or any other character go to the
    tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = None
        if suffix:
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces end to end and the number of each."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())), size

    def _ids_of_runs(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for runs, which are one word to the tokenizer: read as one text where tokens mark word ends."""
        if self.ends is not None:
            (found,) = self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)
            ids = np.array(found.ids, np.uint32)
            ends = np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1
            if len(ends) == len(pieces) and ends[-1] == len(ids):
                return ids, np.diff(ends, prepend=0)
        return self._ids(pieces)

    def _learn(self, runs: list[str], words: list[str]) -> None:
        new_runs, new_words = ([w for w in x if w not in self.number] for x in (runs, words))
        if len(self.number) + len(new_runs) + len(new_words) > REMEMBERED:
            self._forget()
            new_runs, new_words = runs, words
        for new, ask in ((new_runs, self._ids_of_runs), (new_words, self._ids)):
            for lo in range(0, len(new), AT_ONCE):
                some = new[lo : lo + AT_ONCE]
                ids, size = ask(some)
                self.number.update(zip(some, range(len(self.number), len(self.number) + len(some)), strict=True))
                self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
                self.size = np.concatenate([self.size, size])
                self.flat = np.concatenate([self.flat, ids])

    def flat_ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a string column end to end, and where each text ends."""
        distinct, word, text_ends = split_words(column)
        low = pc.ascii_lower(distinct)
        plain = pc.and_not(pc.match_substring_regex(low, PLAIN), pc.match_substring(low, "<|"))
        runs = pc.ascii_split_whitespace(pc.utf8_rtrim_whitespace(pc.replace_substring_regex(low.filter(plain), RUNS, "\\1 ")))
        coded = runs.flatten().dictionary_encode()
        some, other = coded.dictionary.to_pylist(), distinct.filter(pc.invert(plain)).to_pylist()
        self._learn(some, other)
        # texts are runs of words, words are runs of pieces, pieces are runs of ids
        is_plain = plain.to_numpy(zero_copy_only=False)
        many = np.ones(len(distinct), np.int64)
        many[is_plain] = pc.list_value_length(runs).to_numpy()
        first = np.cumsum(many) - many
        known = np.empty(int(many.sum()), np.int64)
        number = np.fromiter(map(self.number.__getitem__, some), np.int64, len(some))
        known[_runs(first[is_plain], many[is_plain])] = number[coded.indices.to_numpy()]
        known[first[~is_plain]] = np.fromiter(map(self.number.__getitem__, other), np.int64, len(other))
        # the ids of every distinct word, then those of the words in their order
        size = self.size[known]
        ids = self.flat[_runs(self.begin[known], size)]
        upto = np.concatenate([[0], np.cumsum(size)])
        begin, size = upto[first], upto[first + many] - upto[first]
        ends = np.concatenate([[0], np.cumsum(size[word])])[text_ends]
        return ids[_runs(begin[word], size[word])], ends

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a string column."""
        ids, ends = self.flat_ids(column)
        lo = 0
        for hi in ends.tolist():
            yield ids[lo:hi]
            lo = hi


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of runs of the given sizes, end to end."""
    ends = np.cumsum(size)
    out = np.repeat(begin - (ends - size), size)
    out += np.arange(len(out))
    return out
