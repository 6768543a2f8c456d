"""Token ids of whole texts by the tokenizers library, a piece between spaces at a time.

In the vocabularies used here a space between two other characters always starts a new
pre-token, so a text's ids are those of its pieces end to end. Pieces recur: each distinct one
is encoded once and remembered under its 64-bit hash, and a batch is put together from arrays.
Strings of special tokens hold no space, so each lies in one piece, and the library reads it there.
"""

from __future__ import annotations

import os
from functools import cache

import numpy as np

from tickloom.llm.words import word_hashes

#: Distinct pieces that a worker remembers (some 30 bytes each); beyond it, it starts anew.
REMEMBERED = 2_000_000
#: New pieces that are encoded as one string, with a mark between them.
AT_ONCE = 500
LETTER = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))
#: First bytes of the white space outside ASCII (and of other characters, which does no harm).
WIDE = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])


def pieces(data: np.ndarray, bounds: np.ndarray, stops: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pieces of the texts that lie end to end in `data`, and pieces per text.

    A piece begins with each text that is not empty, at each space with no white space before
    or after it, and (`stops`) at a comma or full stop between a letter and a space. Where a
    neighbour may be white space, the piece goes on.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        tight = (data > 32) & (data != 0x7F)
        inner = (data[1:-1] == 32) & tight[:-2] & tight[2:] & ~WIDE[data[2:]]
        wide = WIDE[data]
        inner[1:] &= ~wide[:-3]
        inner[2:] &= ~wide[:-4]
        if stops:
            middle = data[1:-1]
            inner |= ((middle == 44) | (middle == 46)) & LETTER[data[:-2]] & (data[2:] == 32)
        cut[1 : n - 1] = inner
    cut[bounds] = True
    starts = np.flatnonzero(cut[:n])
    return starts, np.diff(np.searchsorted(starts, bounds))


class Encoder:
    """Ids of one vocabulary. `mark` is one token and joins with no piece beside it."""

    stops = True

    def __init__(self, tokenizer, mark: str):
        self.tokenizer, self.mark, self.sign = tokenizer, mark, mark.strip(" ")
        self.special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        if any(" " in t for t in self.special):
            raise ValueError("a special token with a space has no place in one piece")
        (self.mark_id,) = self._batch([mark])[0].tolist()
        self._forget()

    def _forget(self) -> None:
        self.keys, self.entry = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.bounds, self.pool = np.zeros(1, np.int64), np.empty(0, np.uint32)

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, np.uint32) for x in found]

    def _new(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        easy, odd = [], []
        for i, text in enumerate(texts):
            core = text[1:] if text[0] == " " else text
            hard = not core or self.sign in core or core[0].isspace() or core[-1].isspace()
            hard = hard or any(t in core for t in self.special)
            (odd if hard else easy).append(i)
        for i, ids in zip(odd, self._batch([texts[i] for i in odd]), strict=True):
            out[i] = ids
        groups = [easy[i : i + AT_ONCE] for i in range(0, len(easy), AT_ONCE)]
        joined = self._batch([self.mark.join(texts[i] for i in group) for group in groups])
        for group, ids in zip(groups, joined, strict=True):
            cuts = np.flatnonzero(ids == self.mark_id)
            ends = [*cuts.tolist(), len(ids)]
            for i, a, b in zip(group, [0, *(cuts + 1).tolist()], ends, strict=True):
                out[i] = ids[a:b]
        return out

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> None:
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        found = self._new(texts)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        entry = len(self.bounds) - 1 + np.arange(len(found))
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
        self.pool = np.concatenate([self.pool, *found])
        where = np.searchsorted(self.keys, keys)
        self.keys, self.entry = np.insert(self.keys, where, keys), np.insert(self.entry, where, entry)

    def encode(self, data: np.ndarray, bounds: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each text's followed by `end` (if any), and their bounds."""
        starts, counts = pieces(data, bounds, self.stops)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        keys, first, which = np.unique(
            word_hashes(data, starts, ends), return_index=True, return_inverse=True
        )
        if len(self.keys) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        if not known.all():
            new = first[~known]
            self._learn(data, starts[new], ends[new], keys[~known])
            at = np.searchsorted(self.keys, keys)
        entry = self.entry[at][which]
        sizes = np.diff(self.bounds)[entry]
        tokens = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=tokens[1:])
        of_text = np.append(0, np.cumsum(counts))
        place = np.arange(tokens[-1])
        ids = self.pool[place + np.repeat(self.bounds[entry] - tokens[:-1], sizes)]
        if end is None:
            return ids, tokens[of_text]
        cuts = tokens[of_text] + np.arange(len(bounds))
        out = np.full(cuts[-1], end, np.uint32)
        out[place + np.repeat(np.arange(len(counts)), np.diff(tokens[of_text]))] = ids
        return out, cuts


@cache
def encoder(file: str, mark: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Encoder(Tokenizer.from_file(file), mark)


#: Marks for vocabularies that keep the space before a word, and for those that drop it.
BYTE_LEVEL, SPACE_DROPPED = "\t", " \x01 "
