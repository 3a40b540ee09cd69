"""BPE encoding and decoding with a pair occurrence index.

A batch of distinct words is laid out as one symbol array.  An index maps each
adjacent pair with a rank to all of its positions; the active ranks are taken
in ascending order, all live positions of that pair are merged at once, and only
the lists of the pairs that touch a merge are updated.  Texts are cut at white
space by Arrow; each distinct part of a batch is encoded once, and the ids of
the texts are gathered from those of the parts.  Words are kept in a bounded
table, which a task empties when it ends.

The vocabulary file follows the Hugging Face ``tokenizers`` JSON format: NFC,
white-space folding and lower case, a split pattern, byte-level symbols, and a
suffix that marks word ends.  Files of another form are refused.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import release

_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: ``str.split`` parts text at these four controls too, the format does not.
_NO_SPACE = re.compile("[\x1c-\x1f]")
_MARKS = frozenset(".,;:!?")
_SPACE = regex.compile(r"\p{White_Space}+")
#: Distinct words a task remembers before it starts anew.
CACHE_WORDS = 250_000
#: Longest word, in bytes of UTF-8, that is remembered.
CACHE_BYTES = 64


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if visible in Latin-1, else the next code from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 256
    for byte in range(256):
        if byte in visible:
            out.append(chr(byte))
        else:
            out.append(chr(spare))
            spare += 1
    return out


@dataclass
class Encoded:
    """The texts of a batch: which distinct parts they hold, and what each part is."""

    #: Distinct part of each place, and the first place of each text (one more at the end).
    codes: np.ndarray
    rows: np.ndarray
    #: Ids of the distinct parts, end to end, and their first places (one more at the end).
    ids: np.ndarray
    starts: np.ndarray

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, first place of each text and one more)."""
        counts = np.diff(self.starts)[self.codes]
        ends = np.concatenate(([0], np.cumsum(counts)))
        at = np.arange(ends[-1], dtype=np.int64) + np.repeat(self.starts[self.codes] - ends[:-1], counts)
        return self.ids[at], ends[self.rows]


class WordBpe:
    """Encoder and decoder for a word-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [n.get("type") for n in spec["normalizer"]["normalizers"]]
        splitter = spec["pre_tokenizer"]["pretokenizers"][0]
        if steps != ["NFC", "Replace", "Lowercase"] or splitter["pattern"]["Regex"] != _SPLIT or spec.get("decoder"):
            raise ValueError("vocabulary file of an unsupported form")
        self.suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = np.empty((len(model["merges"]), 3), np.int64)
        made: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            # Ascending ranks are exact because a part is always made before it is used.
            if max(made.get(left, -1), made.get(right, -1)) >= rank or whole in made:
                raise ValueError("merges are not in the order of their parts")
            made[whole] = rank
            merges[rank] = left, right, whole
            if a.endswith(self.suffix):
                raise ValueError("a merge goes beyond the end of a word")
        self.merges = merges
        self._shift = max(vocab.values()).bit_length()
        size = max(vocab.values()) + 2
        # The pairs that a symbol begins, and those that it ends, each with the other symbol ascending.
        by_left, by_right = np.lexsort((merges[:, 1], merges[:, 0])), np.lexsort((merges[:, 0], merges[:, 1]))
        self._pairs, self._pair_ranks = merges[by_left, 0] << self._shift | merges[by_left, 1], by_left
        self._after = merges[by_left, 1], by_left, np.searchsorted(merges[by_left, 0], np.arange(size))
        self._before = merges[by_right, 0], by_right, np.searchsorted(merges[by_right, 1], np.arange(size))
        self.names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        symbols = _byte_symbols()
        self._inner = np.array([vocab[s] for s in symbols], np.int64)
        self._final = np.array([vocab[s + self.suffix] for s in symbols], np.int64)
        self._find = regex.compile(_SPLIT).findall
        self._special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special))) + ")")
        self.words: dict[str, bytes] = {}

    # -- the pair occurrence index -------------------------------------------
    def merge_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers, all words through one pair index."""
        if not words:
            return []
        raw = [w.encode("utf-8") for w in words]
        heads = np.cumsum([0, *map(len, raw)])
        last = heads[1:] - 1
        data = np.frombuffer(b"".join(raw), np.uint8)
        ids = self._inner[data]
        ids[last] = self._final[data[last]]
        self._merge(ids := np.append(ids, -1))
        alive = ids[:-1] >= 0
        ends = (np.concatenate(([0], np.cumsum(alive)))[heads] * 4).tolist()
        flat = ids[:-1][alive].astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _merge(self, ids: np.ndarray) -> None:
        """Applies all merges to the symbols ``ids`` (-1 at the end); a symbol taken by its left neighbour becomes -1.

        Symbols that end a word never join to the right, so no pair spans two words.
        """
        count = len(ids) - 1
        nxt, prv = np.arange(1, count + 2), np.arange(-1, count)
        pairs = ids[: count - 1] << self._shift | ids[1:count]
        at = np.minimum(np.searchsorted(self._pairs, pairs), len(self._pairs) - 1)
        places = np.flatnonzero(self._pairs[at] == pairs)
        where: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(ranks: np.ndarray, places: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            edges = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                rank = int(ranks[a])
                if rank in where:
                    where[rank].append(places[a:b])
                else:
                    where[rank] = [places[a:b]]
                    heapq.heappush(active, rank)

        def known(table: tuple, symbol: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
            """Ranks of the pairs of ``symbol`` with each of ``others``, and which of them are pairs."""
            low, high = table[2][symbol], table[2][symbol + 1]
            if low == high:
                return None
            partners = table[0][low:high]
            at = np.minimum(np.searchsorted(partners, others), high - low - 1)
            hit = partners[at] == others
            return table[1][low + at[hit]], hit

        if len(places):
            enter(self._pair_ranks[at[places]], places)
        while active:
            rank = heapq.heappop(active)
            lists = where.pop(rank)
            left, right, whole = self.merges[rank].tolist()
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            after = nxt[at]
            live = (ids[at] == left) & (ids[after] == right)  # else a neighbouring merge took one of the two
            at = at[live]
            if left == right and len(at) > 1:
                # Of a chain of overlapping places, every second one.
                at = np.sort(at)
                index = np.arange(len(at))
                fresh = np.append(True, at[1:] != nxt[at[:-1]])
                at = at[(index - np.maximum.accumulate(np.where(fresh, index, 0))) % 2 == 0]
                after = nxt[at]
            else:
                after = after[live]
            if not len(at):
                continue
            ids[at], ids[after] = whole, -1
            beyond = nxt[at] = nxt[after]
            prv[beyond] = at
            before = prv[at]
            inner = before >= 0
            if (hit := known(self._before, whole, ids[before[inner]])) is not None and len(hit[0]):
                enter(hit[0], before[inner][hit[1]])
            # Where the next symbol was just made too, the pair is entered above.
            if (hit := known(self._after, whole, ids[beyond])) is not None:
                single = ids[beyond][hit[1]] != whole
                if single.any():
                    enter(hit[0][single], at[hit[1]][single])

    # -- texts ---------------------------------------------------------------
    def _normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def _odd(self, text: str) -> list[str]:
        """Special tokens and parts between white space, of texts that need a closer look.

        Special strings are found in the raw text.  They keep a leading space,
        which no part has, so that the two share no spelling.
        """
        out: list[str] = []
        for k, piece in enumerate(self._special_at.split(text)):
            out += [" " + piece] if k % 2 else [p for p in _SPACE.split(self._normal(piece)) if p]
        return out

    def _parts(self, texts: list[str]) -> pa.ListArray:
        """Lower-case parts between white space; no pre-token spans two of them.

        A text without any has one empty part, which has no ids.
        """
        odd = [k for k, t in enumerate(texts) if "<|" in t or _NO_SPACE.search(t)]
        if not odd:
            return pc.utf8_split_whitespace(pa.array([self._normal(t).strip() for t in texts], pa.large_string()))
        look = set(odd)
        plain = pc.utf8_split_whitespace(pa.array(["" if k in look else self._normal(t).strip() for k, t in enumerate(texts)], pa.large_string()))
        other = pa.array([self._odd(texts[k]) for k in odd], pa.list_(pa.large_string()))
        place = np.arange(len(texts))
        place[odd] = len(texts) + np.arange(len(odd))
        return pa.concat_arrays([plain, other]).take(pa.array(place))

    def _pre_tokens(self, part: str) -> tuple[str, ...] | list[str]:
        """A part of letters alone is one pre-token, and so is a mark behind letters."""
        if part.isalpha():
            return (part,)
        if part[-1:] in _MARKS and part[:-1].isalpha():
            return part[:-1], part[-1]
        return self._find(part) if part[:1] != " " else ()

    def encode_batch(self, texts: list[str]) -> Encoded:
        """Ids of the texts; each distinct part is looked at once."""
        parts = self._parts(texts)
        rows = parts.offsets.to_numpy()
        coded = parts.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        found = list(map(self._pre_tokens, distinct))
        words = self.words
        new = list(set(chain.from_iterable(found)).difference(words))
        words.update(zip(new, self.merge_words(new), strict=True))
        get, special = words.__getitem__, self.special
        raw = [get(f[0]) if len(f) == 1 else b"".join(map(get, f)) if f else special[p[1:]].to_bytes(4, "little") if p else b"" for p, f in zip(distinct, found, strict=True)]
        starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) // 4)))
        if len(words) > CACHE_WORDS:
            words.clear()
        for word in new:
            if len(word) > CACHE_BYTES:
                words.pop(word, None)
        return Encoded(coded.indices.to_numpy(), rows - rows[0], np.frombuffer(b"".join(raw), "<u4"), starts)

    def decode_batch(self, e: Encoded) -> pa.LargeStringArray:
        """The texts that the ids of each row decode to."""
        names = list(map(self.names.__getitem__, e.ids.tolist()))
        edges = e.starts.tolist()
        texts = pa.array([" ".join(names[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.large_string())
        rows = pa.ListArray.from_arrays(pa.array(e.rows, pa.int32()), texts.take(pa.array(e.codes)))
        return pc.binary_join(rows, pa.scalar(" ", pa.large_string()))

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text]).tokens()[0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """Token strings joined by spaces, as the format does without a decoder; unknown ids are left out."""
        return " ".join(self.names[i] for i in ids if i in self.names)


_loaded: dict[str, WordBpe] = {}


@contextmanager
def loaded(path: str) -> Iterator[WordBpe]:
    """The encoder of a Python worker for a file; what it has remembered goes at the end."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    try:
        yield _loaded[path]
    finally:
        _loaded[path].words.clear()
        release()
