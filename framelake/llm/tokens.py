"""Token ids of whole texts, by the ``tokenizers`` library, a distinct word once.

Both public BPE files split a text at white space before any merge, so a text's
ids are the concatenation of its words' ids.  A batch's words are dictionary
encoded by Arrow; only words not met before go to the library, and the batch's
ids are gathered from a pool with numpy.  Texts or tokenizer files for which the
split isn't exact go to the library whole.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units (words of letters, punctuation) that a worker remembers, about 40 bytes each; beyond it the pool starts anew.
POOL_WORDS = 600_000
#: Bytes of remembered units and of their ids, at most.
POOL_BYTES = 64 << 20
#: Punctuation after a word of letters is a token run of its own; the apostrophe isn't here, it can begin a contraction.
TAIL = ".,;:!?"

# Neighbouring white space, or white space at an end: there a byte-level
# splitter looks across the gap.
_ODD_SPACE = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
_UNSAFE = rf"{_ODD_SPACE}{_ODD_SPACE}|^{_ODD_SPACE}|{_ODD_SPACE}$"


def split_kind(tokenizer_json: dict) -> str:
    """How texts may be cut into words: 'space' (white space is dropped), 'byte' (it leads a word) or 'whole'."""
    pre = tokenizer_json.get("pre_tokenizer") or {}
    norm = tokenizer_json.get("normalizer")
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "byte"
    steps = pre.get("pretokenizers") or []
    if steps and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert"):
        pattern = steps[0].get("pattern", {}).get("Regex", "")
        if r"[^\s\p{L}\p{N}]+" in pattern and " ?" not in pattern:
            return "space"
    return "whole"


class WordEncoder:
    """Ids of a batch of texts.

    ``encode`` takes a string array (null counts as empty) and returns the flat
    uint32 ids and the int64 offsets of the texts in them.
    """

    def __init__(self, path: str, pool_words: int = POOL_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.kind = split_kind(json.load(f))
        self.tokenizer = Tokenizer.from_file(path)
        self.pool_words = pool_words
        #: By id: it begins (byte) or ends (space) a word.
        self.edge = np.zeros(max(self.tokenizer.get_vocab().values(), default=0) + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.edge[i] = token.startswith("\u0120") if self.kind == "byte" else token.endswith("</w>")
        self._reset()
        # A line break before the first word marks it as one without a leading space.
        self.lead = len(self._ids(["\n"])[0]) if self.kind == "byte" else 0

    def _reset(self) -> None:
        """Unit 0 has no ids."""
        self.units = pa.array([""], pa.large_string())
        self.lens = np.zeros(1, np.int32)
        self.starts = np.zeros(1, np.int32)
        self.pool = np.zeros(1 << 15, np.uint32)
        self.used = 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, cores: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and counts of words of letters only, many to a call; the vocabulary tells where each begins or ends."""
        flats, counts = [], []
        lead = " " if self.kind == "byte" else ""
        at = np.arange(0, len(cores) + 256, 256).clip(max=len(cores))
        at = at[: np.searchsorted(at, len(cores)) + 1]
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), cores.cast(pa.string())), " ").to_pylist()
        for k, ids in enumerate(self._ids([lead + j for j in joined])):
            flat = np.asarray(ids, np.uint32)
            edges = np.flatnonzero(self.edge[flat])
            if len(edges) == at[k + 1] - at[k]:
                ends = np.append(edges[1:], len(flat)) if self.kind == "byte" else edges + 1
                counts.append(np.diff(ends, prepend=0))
            else:
                each = self._ids([lead + w for w in cores.slice(at[k], at[k + 1] - at[k]).to_pylist()])
                flat = np.fromiter((i for e in each for i in e), np.uint32)
                counts.append(np.fromiter(map(len, each), np.int64, len(each)))
            flats.append(flat)
        return np.concatenate(flats or [np.zeros(0, np.uint32)]), np.concatenate(counts or [np.zeros(0, np.int64)])

    def _add(self, units: pa.Array, flat: np.ndarray, counts: np.ndarray) -> None:
        while len(self.pool) < self.used + len(flat):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used : self.used + len(flat)] = flat
        self.starts = np.concatenate([self.starts, (self.used + np.cumsum(counts) - counts).astype(np.int32)])
        self.lens = np.concatenate([self.lens, counts.astype(np.int32)])
        self.units = pa.concat_arrays([self.units, units])
        self.used += len(flat)

    def _others(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and counts of tails and whole words, one by one."""
        lead = lambda w: "" if w[0] == "\0" or self.kind != "byte" or w[1:2] == "\n" else " "
        each = self._ids([lead(w) + w[1:] for w in units.to_pylist()])
        return np.fromiter((i for e in each for i in e), np.uint32), np.fromiter(map(len, each), np.int64, len(each))

    @staticmethod
    def _ends(words: pa.Array, sizes: np.ndarray) -> pa.Array:
        """The last ``sizes`` bytes of each word."""
        ends = np.cumsum(sizes)
        stops = np.frombuffer(words.buffers()[1], np.int64)[words.offset + 1 : words.offset + len(words) + 1]
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(stops - ends, sizes)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[at]
        return pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(data))

    def _units(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The two units that make up each distinct word: a word of letters and its closing punctuation, or the whole word and none.

        In ``units`` a tail begins with code 0 and a whole word with code 1.
        """
        if self.kind == "space":  # this file's words are lower-cased anyway; markers of special tokens aren't
            words = pc.if_else(pc.match_substring(words, "<|"), words, pc.ascii_lower(words))
        core = pc.utf8_rtrim(words, characters=TAIL)
        lettered = pc.utf8_is_alpha(core)
        tail = self._ends(words, pc.subtract(pc.binary_length(words), pc.binary_length(core)).to_numpy())
        code = lambda c: pa.scalar(c, pa.large_string())
        none = code("")
        first = pc.if_else(lettered, core, pc.binary_join_element_wise(code("\x01"), words, none))
        second = pc.if_else(pc.and_(lettered, pc.not_equal(tail, "")), pc.binary_join_element_wise(code("\x00"), tail, none), none)
        if len(self.units) > self.pool_words or self.units.nbytes + 4 * self.used > POOL_BYTES:
            self._reset()
        both = pc.dictionary_encode(pa.concat_arrays([first, second]))
        units = both.dictionary
        place = pc.fill_null(pc.index_in(units, value_set=self.units), -1).to_numpy().copy()
        unknown = place < 0
        if unknown.any():
            letters = pc.utf8_is_alpha(units).to_numpy(zero_copy_only=False)
            for mask, ids_of in ((unknown & letters, self._letters), (unknown & ~letters, self._others)):
                new = units.filter(pa.array(mask))
                place[mask] = len(self.units) + np.arange(len(new))
                self._add(new, *ids_of(new))
        index = both.indices.to_numpy()
        return place[index[: len(words)]], place[index[len(words) :]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.kind == "whole":
            return self._whole(texts)
        if self.kind == "space":
            return self._words(pc.replace_substring(texts, "\n", " "), 0)
        unsafe = pc.or_(pc.match_substring_regex(texts, _UNSAFE), pc.equal(texts, ""))
        safe_at = np.flatnonzero(~unsafe.to_numpy(zero_copy_only=False))
        if len(safe_at) == len(texts):
            return self._words(self._marked(texts), self.lead)
        ids, offsets = self._words(self._marked(texts.take(pa.array(safe_at))), self.lead)
        rest_at = np.flatnonzero(unsafe.to_numpy(zero_copy_only=False))
        more, more_offsets = self._whole(texts.take(pa.array(rest_at)))
        lens = np.zeros(len(texts), np.int64)
        lens[safe_at], lens[rest_at] = np.diff(offsets), np.diff(more_offsets)
        out_offsets = np.concatenate([[0], np.cumsum(lens)])
        out = np.empty(out_offsets[-1], np.uint32)
        for at, src, off in ((safe_at, ids, offsets), (rest_at, more, more_offsets)):
            for k, row in enumerate(at):
                out[out_offsets[row] : out_offsets[row + 1]] = src[off[k] : off[k + 1]]
        return out, out_offsets

    @staticmethod
    def _marked(texts: pa.Array) -> pa.Array:
        mark, none = pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())
        return pc.binary_join_element_wise(mark, pc.replace_substring(texts, "\n", " \n"), none)

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lens, flat = [0], []
        for i in range(0, len(texts), 16):
            for ids in self._ids(texts.slice(i, 16).to_pylist()):
                lens.append(len(ids))
                flat.append(np.asarray(ids, np.uint32))
        return (np.concatenate(flat) if flat else np.zeros(0, np.uint32)), np.cumsum(lens)

    def _words(self, texts: pa.Array, lead: int) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        split = pc.split_pattern(texts, " ")
        word_at = split.offsets.to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(split.flatten())
        word_at = word_at - word_at[0]
        index = coded.indices.to_numpy()
        place = np.empty(2 * len(index), np.int32)  # a batch has less than 2^31 ids, as each takes a byte of text at least
        for k, unit in enumerate(self._units(coded.dictionary)):
            place[k::2] = unit[index]
        lens, starts = self.lens[place], self.starts[place]
        if lead:
            firsts = 2 * word_at[:-1]
            lens[firsts] -= lead
            starts[firsts] += lead
        del place, index
        ends = np.cumsum(lens, dtype=np.int32)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(starts - (ends - lens), lens)
        at += np.arange(total, dtype=np.int32)
        return self.pool[at], np.concatenate([[0], ends])[2 * word_at].astype(np.int64)


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    """One encoder a worker and file."""
    return WordEncoder(path)
