"""Token ids of texts with the tokenizers library, for the operators that store or pack ids.

A space that stands between two other characters always begins a pre-token of the byte-level pattern, so a text may be
encoded part by part between such spaces. Parts repeat (they are mostly words); the distinct parts of a batch are found
with Arrow's kernels. A distinct part is cut again where a pre-token always ends, into units: around a line end that stands
between two other characters, and between a letter or digit and the signs that close the part. So a word is one unit, with
whatever signs it ends. The library encodes the distinct units as a few long texts, which are cut again by the tokens' byte
lengths; the ids of parts are gathered from those of units, and the ids of texts from those of parts. The ids of at most
KEPT_UNITS units are kept from one batch of a process to the next, about 40 bytes each.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lumencat.llm.common import single_threaded

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
JOINED_UNITS = 4000
KEPT_UNITS = 1_000_000
BLOCK_PARTS = 1 << 16
_SIGNS = ".,;:!?*$%&#|<>()[]{}\"-/"  # no letters, digits or white space; an apostrophe may begin a pre-token of letters
_SPACE = frozenset(c for c in map(chr, range(0x3001)) if c.isspace())
_SPACES = "".join(sorted(_SPACE))
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def gathered(pool: np.ndarray, begin: np.ndarray, count: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """pool[begin:begin + count] of each entry, one after another; block by block, as temporary arrays of all ids cost more."""
    out = np.empty(int(sum(count[entry[lo : lo + BLOCK_PARTS]].sum() for lo in range(0, len(entry), BLOCK_PARTS))), pool.dtype)
    at = 0
    for lo in range(0, len(entry), BLOCK_PARTS):
        some = entry[lo : lo + BLOCK_PARTS]
        n = count[some]
        stop = np.cumsum(n)
        out[at : at + stop[-1]] = pool[np.repeat(begin[some] - (stop - n), n) + np.arange(stop[-1])]
        at += int(stop[-1])
    return out


def _buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an array of strings."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]
    return offsets.astype(np.int64), np.frombuffer(strings.buffers()[2] or b"", np.uint8)


def ends_in_letter(strings: pa.Array) -> np.ndarray:
    """Whether a string surely ends in a letter or digit: ASCII, Latin up to U+017F or Cyrillic up to U+047F."""
    if not len(strings):
        return np.zeros(0, bool)
    offsets, raw = _buffers(strings)
    raw = np.concatenate([np.zeros(2, np.uint8), raw])  # a string's end is two further on
    last, lead = raw[offsets[1:] + 1], raw[offsets[1:]]
    size = np.diff(offsets)
    ascii_ = ((last | 32) >= ord("a")) & ((last | 32) <= ord("z")) | (last >= ord("0")) & (last <= ord("9"))
    times_or_divided = (lead == 0xC3) & ((last == 0x97) | (last == 0xB7))
    wide = (last >= 0x80) & np.isin(lead, np.array([0xC3, 0xC4, 0xC5, 0xD0, 0xD1], np.uint8)) & ~times_or_divided
    return (size > 0) & ascii_ | (size > 1) & wide


def _after(strings: pa.Array, starts: pa.Array) -> pa.Array:
    """What follows its start in each string."""
    offsets, raw = _buffers(strings)
    size = pc.binary_length(starts).to_numpy().astype(np.int64)
    n = np.diff(offsets) - size
    bounds = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    rest = gathered(raw, offsets[:-1] + size, n, np.arange(len(strings)))
    return pa.StringArray.from_buffers(len(strings), pa.py_buffer(bounds.tobytes()), pa.py_buffer(rest.tobytes()))


class Encoder:
    """encode(texts): the ids of each text, without special tokens, as an array of unsigned 16- or 32-bit numbers."""

    def __init__(self, path: str):
        single_threaded()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        n = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if n <= 1 << 16 else np.dtype("<u4")
        # a byte-level token has one character for each byte of text
        self.n_bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(n)], np.int64)
        self.line_end = self._ids(["\n"])[0]
        self.kept, self.pool = pa.array([], pa.string()), np.empty(0, self.dtype)
        self.begin, self.count, self.batches = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.uint8)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, units: pa.Array, spaced: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of units, all with a space before them or none, and where each unit's ids begin and how many they are."""
        strings = units.to_pylist()
        between = "" if spaced else "\n"
        texts = [between.join([*strings[lo : lo + JOINED_UNITS], ""]) for lo in range(0, len(strings), JOINED_UNITS)]
        ids = np.concatenate([np.empty(0, self.dtype), *self._ids(texts)])
        size = pc.binary_length(units).to_numpy().astype(np.int64) + len(between)
        ends = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(size)) + 1
        begin = np.concatenate([np.zeros(1, np.int64), ends])[: len(ends)]
        return ids, begin, ends - begin - len(between)  # a line end is one id

    def _of_units(self, units: pa.Array, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, begin, count): the ids of distinct units. Those not kept from an earlier batch are encoded."""
        at = pc.index_in(units, value_set=self.kept)
        new = units.filter(pc.is_null(at))
        at = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        spaced = pc.starts_with(new, " ")
        pool, begin, count, held = [self.pool], [self.begin], [self.count], [self.kept]
        for some, space in ((new.filter(spaced), True), (new.filter(pc.invert(spaced)), False)):
            ids, b, n = self._joined(some, space)
            begin.append(b + sum(map(len, pool)))
            pool.append(ids)
            count.append(n)
            held.append(some)
        self.pool, self.kept = np.concatenate(pool), pa.concat_arrays(held)
        self.begin, self.count = np.concatenate(begin).astype(np.int32), np.concatenate(count).astype(np.int32)
        rank = pc.fill_null(spaced, False).to_numpy(zero_copy_only=False)
        n_old = len(held[0])
        where = np.where(rank, np.cumsum(rank) - 1, int(rank.sum()) + np.cumsum(~rank) - 1)
        at[at < 0] = n_old + where
        found = self.pool, self.begin[at].astype(np.int64), self.count[at].astype(np.int64)
        self.batches = np.concatenate([self.batches, np.zeros(len(new), np.uint8)])
        self.batches[at] = np.minimum(self.batches[at], 254) + 1
        if len(self.kept) > most:  # what more than one batch had stays, if it leaves room, or else nothing
            often = np.flatnonzero(self.batches > 1)
            self._keep(often if 4 * len(often) <= 3 * most else often[:0])
        return found

    def _keep(self, at: np.ndarray) -> None:
        pool = gathered(self.pool, self.begin.astype(np.int64), self.count.astype(np.int64), at)
        self.kept, self.count, self.batches = self.kept.take(pa.array(at)), self.count[at], np.ones(len(at), np.uint8)
        self.pool, self.begin = pool, (np.cumsum(self.count) - self.count).astype(np.int32)

    def _of_parts(self, parts: pa.Array, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, begin, count): the ids of distinct parts, each with a space before it.

        No part is empty or begins or ends in white space.
        """
        lined = np.flatnonzero(pc.match_substring(parts, "\n").to_numpy(zero_copy_only=False))
        lists = pc.split_pattern(parts.take(pa.array(lined)), "\n")
        n_lines = pc.list_value_length(lists).to_numpy().astype(np.int64)
        # a line that is empty, begins or ends in white space: its part stays whole
        lines = lists.flatten()
        bare = pc.binary_length(pc.utf8_trim(lines, _SPACES)).to_numpy()
        bad = (bare == 0) | (bare != pc.binary_length(lines).to_numpy())
        clean = np.bincount(np.repeat(np.arange(len(lined)), n_lines), bad, len(lined)) == 0
        lines = lines.filter(pa.array(np.repeat(clean, n_lines)))
        single = np.ones(len(parts), bool)
        single[lined[clean]] = False
        order = np.concatenate([np.flatnonzero(single), lined[clean]])
        n_lines = np.concatenate([np.ones(int(single.sum()), np.int64), n_lines[clean]])
        lines = pa.concat_arrays([parts.filter(pa.array(single)), lines])
        last = np.cumsum(n_lines) - 1
        stem = pc.utf8_rtrim(lines, _SIGNS)
        stem = pc.if_else(pa.array(ends_in_letter(stem)), stem, lines)
        tail = _after(lines, stem)
        opens = np.zeros(len(lines), bool)
        opens[last - n_lines + 1] = True
        # three slots a line: its stem, its closing signs, its line end; an absent one is the empty unit
        spaced = pc.binary_join_element_wise(pc.if_else(pa.array(opens), " ", ""), stem, "")
        coded = pa.concat_arrays([pa.array(["", "\n"]), spaced, tail]).dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        slots = np.zeros((len(lines), 3), np.int64)
        slots[:, 0], slots[:, 1] = code[2 : 2 + len(lines)], code[2 + len(lines) :]
        slots[:, 2] = 1
        slots[last, 2] = 0
        # the first two are the empty unit, without ids, and the line end, one id
        pool, begin, count = self._of_units(coded.dictionary.slice(2), most)
        begin, count = np.concatenate([[0, len(pool)], begin]), np.concatenate([[0, 1], count])
        pool = np.concatenate([pool, self.line_end])
        n_ids = np.zeros(len(parts), np.int64)
        n_ids[order] = n = np.add.reduceat(count[slots].sum(axis=1), last - n_lines + 1) if len(parts) else 0
        starts = np.zeros(len(parts), np.int64)
        starts[order] = np.cumsum(n) - n
        return gathered(pool, begin, count, slots.ravel()), starts, n_ids

    def encode(self, texts: list[str] | pa.Array, kept_units: int | None = None) -> list[np.ndarray]:
        """kept_units: units whose ids stay for later batches, KEPT_UNITS by default."""
        most = KEPT_UNITS if kept_units is None else kept_units
        column = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if not len(column):
            return []
        lists = pc.split_pattern(column, " ")
        parts, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        first = offsets[:-1]
        # a text's first part has no space before it
        heads = parts.take(pa.array(first)).dictionary_encode()
        table = parts.dictionary_encode()
        del lists, parts
        entry = table.indices.to_numpy().copy()
        distinct = table.dictionary.cast(pa.string())
        # an empty part or one that ends in white space is next to a run of white space, which must not be cut
        bare = pc.binary_length(pc.utf8_trim(distinct, _SPACES)).to_numpy()
        whole = (bare > 0) & (bare == pc.binary_length(distinct).to_numpy())
        begin, count = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        pool, begin[whole], count[whole] = self._of_parts(distinct.filter(pa.array(whole)), most)
        head_ids = self._ids(heads.dictionary.to_pylist())
        head_count = np.array([len(h) for h in head_ids], np.int64)
        begin = np.concatenate([begin, len(pool) + np.cumsum(head_count) - head_count])
        count = np.concatenate([count, head_count])
        odd = ~whole[entry]
        odd[first] = False
        entry[first] = len(distinct) + heads.indices.to_numpy()
        pool = np.concatenate([pool, *head_ids])
        del table, distinct, heads
        pa.default_memory_pool().release_unused()  # else a worker holds it while other stages run
        flat = gathered(pool, begin, count, entry)
        bounds = np.concatenate([[0], np.cumsum(count[entry])])[offsets].tolist()
        out = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for d in np.unique(np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1).tolist():
            out[d] = np.concatenate([np.empty(0, self.dtype), *self._ids(self.split(column[d].as_py()))])
        return out

    @staticmethod
    def split(text: str) -> list[str]:
        """Cuts before each space that stands between two other characters."""
        return [p if k == 0 else " " + p for k, p in enumerate(_BETWEEN.split(text))]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each file and process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


_sentence_ends: dict[str, np.ndarray] = {}


def sentence_ends(path: str) -> np.ndarray:
    """Of each id whether its text ends a sentence or a line; looked up once for each file and process."""
    if path not in _sentence_ends:
        e = encoder(path)
        _sentence_ends[path] = np.array([(e.tokenizer.id_to_token(i) or "")[-1:] in {".", "!", "?", "\u010a"} for i in range(len(e.n_bytes))])
    return _sentence_ends[path]
