"""Whole-text byte-level BPE encoding by the distinct words of a batch.

A byte-level BPE with the usual word pattern never merges across a single
space or line end that has other characters on both sides, because it always
opens the next word.  So texts are cut there, and of a batch each distinct word
is looked up once; words not met before go to the library together.  Ids lie
in one pool, and an array gather puts the texts together again.  New words of
letters, digits and ASCII marks go without the search for words: no id of the
vocabulary spans two of these kinds (which is tested at the start).  A text in
which white space touches other white space goes to the library as a whole,
and so does everything if the tokenizer is built in another way.  The ids are
those of ``Tokenizer.encode`` in every case.
"""

from __future__ import annotations

import json
import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct words kept by a worker.  Beyond that it forgets the later half: words met early are the frequent ones.
CACHE_WORDS = 500_000
#: Bytes of text that share one look-up of distinct words, and new words in one text for the library.
ENCODE_BYTES, GROUP = 2 << 20, 64
_encoders: dict[str, "WordEncoder"] = {}
#: Words of letters, digits and ASCII marks but the apostrophe, which opens words of the pattern.
_EASY = r"^[ \n][\pL0-9!-&(-/:-@\[-`{-~]+$"


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: its own code if it prints, else the next one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {chr(b if b in prints else next(rest)): b for b in range(256)}


def _kind(byte: int) -> int:
    """Letters and all bytes beyond ASCII; digits; marks; white space."""
    x = chr(byte)
    return 0 if byte >= 128 or x.isalpha() else 1 if x.isdigit() else 3 if x.isspace() else 2


class WordEncoder:
    """Encodes texts to ids of ``dtype``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        how = json.loads(self.tok.to_str())
        kind = how.get("pre_tokenizer") or {}
        self.cuts = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not how.get("normalizer") and not how.get("truncation") and not how.get("padding")
        # Strings that are ids as they stand, wherever they are in a text; with white space in or around them nothing can be cut.
        added = how.get("added_tokens") or []
        self.added = [x["content"] for x in added]
        self.cuts = self.cuts and not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or any(c.isspace() for c in x["content"]) for x in added)
        self.words: dict[str, int] = {}  # place in `at` (0 is of no word) of a word with the space or line end before it; -1: not to be cut off
        self.at, self.pool = np.zeros(2, np.int32), np.zeros(0, self.dtype)
        if not self.cuts:
            return
        letters = _byte_letters()
        self.opens, mixed = np.zeros(self.size, bool), False
        for word, i in self.tok.get_vocab(with_added_tokens=False).items():
            raw = [letters.get(c, 0) for c in word]
            self.opens[i] = raw[0] in (10, 32)
            kinds = {_kind(b) for b in raw[raw[0] == 32 :]}
            mixed |= len(kinds) > 1 and all(b < 128 and b != 39 for b in raw)
        self.safe = not mixed
        how["pre_tokenizer"]["use_regex"], how["added_tokens"] = False, []
        self.model = Tokenizer.from_str(json.dumps(how))

    def plain(self, text: str) -> np.ndarray:
        """One text by the library alone."""
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _add(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Puts words' ids into the pool; their places, in order."""
        first, base = len(self.at) - 1, len(self.pool)
        self.at = np.concatenate([self.at, starts[1:] + base, [base + len(ids)]]).astype(np.int32)
        self.pool = np.concatenate([self.pool, ids])
        return np.arange(first, first + len(starts))

    def _apart(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one by one, and where each word's begin."""
        parts = [np.array(e.ids, self.dtype) for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts[:-1])])

    def _together(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of plain kinds, in groups: the id that opens each word tells them apart."""
        at = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
        raw = memoryview(words.buffers()[2])
        cuts = [*at[:-1:GROUP].tolist(), int(at[-1])]
        texts = [str(raw[x:y], "utf-8") for x, y in zip(cuts, cuts[1:])]
        ids = np.concatenate([np.array(e.ids, self.dtype) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)])
        starts = np.flatnonzero(self.opens[ids])
        return (ids, starts) if len(starts) == len(words) else self._apart(words.to_pylist())

    def _forget(self) -> None:
        keep = CACHE_WORDS // 2
        self.words = {w: k for w, k in self.words.items() if k < keep}
        self.at = self.at[: keep + 1].copy()
        self.pool = self.pool[: self.at[-1]].copy()

    def _places(self, coded: pa.Array) -> np.ndarray:
        """Where each of the distinct words is in the pool; -1: not to be cut off."""
        distinct, words = coded.to_numpy(zero_copy_only=False).tolist(), self.words
        found = np.fromiter(map(words.get, distinct, repeat(-2)), np.int32, len(distinct))
        new = np.flatnonzero(found == -2)
        if not len(new):
            return found
        fresh = coded.take(pa.array(new))
        spaced = pc.if_else(pc.starts_with(fresh, "\n"), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
        fresh = pc.binary_join_element_wise(spaced, fresh, pa.scalar("", pa.large_string()))
        easy = pc.match_substring_regex(fresh, _EASY).to_numpy(zero_copy_only=False) & self.safe
        for content in self.added:
            easy &= ~pc.match_substring(fresh, content).to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(~easy).tolist():
            own = distinct[new[k]].removeprefix("\n")
            if not own or own[0].isspace() or own[-1].isspace():
                found[new[k]] = -1
        for mask, learn in ((easy, self._together), (~easy & (found[new] == -2), lambda rows: self._apart(rows.to_pylist()))):
            if mask.any():
                found[new[mask]] = self._add(*learn(fresh.filter(pa.array(mask))))
        words.update(zip([distinct[k] for k in new.tolist()], found[new].tolist()))
        return found

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, and the bounds of the texts among them; null is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(1, np.int64)
        if not self.cuts:
            parts = [self.plain(t) for t in texts.to_pylist()]
            return np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        if len(self.at) > CACHE_WORDS:
            self._forget()
        # A text's first word is taken with a line end before it, whose id is left out.
        cut = pc.split_pattern(pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in ("\n", pc.replace_substring(texts, "\n", " \n"), ""))), " ")
        bounds = cut.offsets.to_numpy()
        coded = cut.values.dictionary_encode()
        place = self._places(coded.dictionary)[coded.indices.to_numpy()]
        odd = np.flatnonzero(place < 0)
        if len(odd):
            place[odd] = 0
            odd = np.unique(np.searchsorted(bounds, odd, side="right") - 1)
        start, end = self.at[place], self.at[place + 1]
        start[bounds[:-1]] += 1
        sizes = np.maximum(end - start, 0)
        ends = np.zeros(len(sizes) + 1, np.int32)
        np.cumsum(sizes, out=ends[1:])
        ids = self.pool.take(np.repeat(start - ends[:-1], sizes) + np.arange(ends[-1], dtype=np.int32))
        ends = ends[bounds]
        if not len(odd):
            return ids, ends
        parts = np.split(ids, ends[1:-1])
        for k in odd.tolist():
            parts[k] = self.plain(texts[k].as_py())
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian ids of each text."""
        ids, bounds = self.encode_column(pa.array(texts, pa.large_string()))
        return [x.tobytes() for x in np.split(ids, bounds[1:-1])] if texts else []


def encoder(path: str) -> WordEncoder:
    """The process-wide encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
