"""BPE encoding by one walk over a trie of the distinct words, and decoding.

Merges of lowest rank first have two properties: every head of an encoding is the encoding of its
own text, and a row of tokens is an encoding if each two neighbours are. So a word's prefix is
known by its last token alone (the rest is the state of the shorter prefix before that token), and
the last token of a longer prefix is the one token that ends there and may follow the state before
it. Distinct words go into a trie; the walk goes depth first and works out the last token of each
node once, for all words that share the prefix. Reading the last tokens back from a word's node
gives its ids.

Two tokens may be neighbours unless a merge across their border comes before the merges that took
their pieces in. These are found on the right edge of the first and the left edge of the second.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.common import buffer_of, plain, slices
from tickloom.llm.tokens import Encoder

#: Distinct words in one trie, and remembered pairs of tokens; bounds memory, results stay.
WORDS, PAIRS = 50_000, 2_000_000
#: A word of more symbols is walked without nodes: it would be a path of its own.
LONG = 512
#: Above every rank; the state before a word; as a key of a node: a word ends here.
NEVER, NONE, END = 1 << 60, -1, ""


class Merges:
    """The merges of one vocabulary: which tokens may stand beside each other."""

    def __init__(self, model: dict):
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix"):
            raise ValueError("a plain BPE model is needed")
        suffix = model.get("end_of_word_suffix") or ""
        ids = model["vocab"]
        self.parts: dict[int, tuple[int, int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, made = ids[left], ids[right], ids[left + right]
            if made in self.parts or any(self.parts.get(x, (0, 0, -1))[2] > rank for x in (a, b)):
                raise ValueError("each token needs one merge, later than those of its parts")
            self.parts[made] = a, b, rank
            self.rank[a << 32 | b] = rank
        self.edges: dict[int, tuple[list, list]] = {}
        self.beside: dict[int, bool] = {}
        #: By text: tokens inside a word, and tokens at its end.
        self.inner, self.last = {}, {}
        for token, i in ids.items():
            core = token.removesuffix(suffix) if suffix else token
            if i in self.parts and not self._whole(i) or i not in self.parts and len(core) != 1:
                continue
            if not suffix or core == token:
                self.inner[token] = i
            if not suffix or core != token:
                self.last[core] = i
        if any(c not in side for side in (self.inner, self.last) for c in alphabet()):
            raise ValueError("the vocabulary lacks a byte")
        self.longest = max(map(len, [*self.inner, *self.last]))
        self.size = {i: len(t) for side in (self.inner, self.last) for t, i in side.items()}

    def _whole(self, token: int) -> bool:
        """Whether the token's own text becomes that token."""
        if token not in self.parts:
            return True
        a, b, rank = self.parts[token]
        return self._whole(a) and self._whole(b) and not self._crossed(a, b, rank)

    def _edge(self, token: int) -> tuple[list, list]:
        """Left and right edge: (token, rank of the merge that takes it in), outermost first."""
        found = self.edges.get(token)
        if found is None:
            found = ([], [])
            for side, out in enumerate(found):
                now, until = token, NEVER
                out.append((now, until))
                while now in self.parts:
                    until, now = self.parts[now][2], self.parts[now][side]
                    out.append((now, until))
            self.edges[token] = found
        return found

    def _crossed(self, a: int, b: int, before: int) -> bool:
        """Whether a merge of a lower rank than `before` crosses the border; of equal merges the left one is first."""
        right, left = self._edge(a)[1], self._edge(b)[0]
        for x, x_until in right:
            for y, y_until in left:
                rank = self.rank.get(x << 32 | y)
                if rank is not None and rank < before and rank < x_until and rank <= y_until:
                    return True
        return False

    def may_follow(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self.beside.get(key)
        if found is None:
            if len(self.beside) >= PAIRS:
                self.beside.clear()
            found = self.beside[key] = not self._crossed(a, b, NEVER)
        return found

    def state(self, tail: str, states: list[int], tokens: dict[str, int]) -> int:
        """The last token of a prefix: `tail` is its last symbols, `states` those of all shorter prefixes."""
        may_follow, depth = self.may_follow, len(states)
        for start in range(max(0, len(tail) - self.longest), len(tail)):
            token = tokens.get(tail[start:])
            if token is not None and (depth == len(tail) - start or may_follow(states[depth - len(tail) + start], token)):
                return token
        raise ValueError(f"no token ends {tail!r}")

    def encode(self, words: Iterable[str]) -> dict[str, list[int]]:
        """The ids of each word (not empty, in the alphabet of bytes)."""
        root: dict = {}
        out: dict[str, list[int]] = {}
        for word in words:
            if len(word) > LONG:
                out[word] = self._alone(word)
                continue
            node = root
            for symbol in word:
                node = node.setdefault(symbol, {})
            node[END] = word
        states: list[int] = []
        todo = [(root, "", 0)]
        while todo:
            node, tail, depth = todo.pop()
            del states[depth:]
            word = node.get(END)
            if word is not None:
                out[word] = self._read(word, states)
            if len(node) > (word is not None):
                states.append(self.state(tail, states, self.inner) if depth else NONE)
                for symbol, below in node.items():
                    if symbol != END:
                        todo.append((below, (tail + symbol)[-self.longest :], depth + 1))
        return out

    def _alone(self, word: str) -> list[int]:
        states = [NONE]
        for depth in range(1, len(word)):
            states.append(self.state(word[max(0, depth - self.longest) : depth], states, self.inner))
        return self._read(word, states)

    def _read(self, word: str, states: list[int]) -> list[int]:
        """Last token first: the one that ends the word, then the state before it, and so on."""
        ids, at = [self.state(word[-self.longest :], states, self.last)], len(word)
        while (at := at - self.size[ids[-1]]) > 0:
            ids.append(states[at])
        return ids[::-1]


@cache
def alphabet() -> str:
    """The characters that stand for the 256 bytes: printable ones for themselves, the rest from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in own]
    return "".join(chr(b if b in own else 256 + others.index(b)) for b in range(256))


class TrieEncoder(Encoder):
    """Pieces of texts as in Encoder; normaliser and word limits from the library, merges by the trie."""

    def __init__(self, tokenizer, mark: str):
        self.merges = Merges(json.loads(tokenizer.to_str())["model"])
        added = tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("special tokens must stand for their exact text")
        names = sorted((t.content for t in added.values()), key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, names)) + ")" if names else "(?!)")
        super().__init__(tokenizer, mark)

    def _words(self, text: str) -> list[str | int]:
        """The words of a text; a special token is its id."""
        out: list[str | int] = []
        normal, split = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        for part in self.cut.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                clean = normal.normalize_str(part) if normal else part
                out += [w for w, _ in split.pre_tokenize_str(clean)] if clean else []
        return out

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        rows = [self._words(t) for t in texts]
        new = sorted({w for row in rows for w in row if isinstance(w, str)})
        known: dict[str | int, list[int]] = {i: [i] for i in self.special.values()}
        for low in range(0, len(new), WORDS):
            known |= self.merges.encode(new[low : low + WORDS])
        return [np.array([i for w in row for i in known[w]], np.uint32) for row in rows]


class Decoder:
    """What the library's decode gives, special tokens included, as UTF-8."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        self.tokens = [(tokenizer.id_to_token(i) or "").encode() for i in range(size)]

    def decode(self, ids: np.ndarray) -> bytes:
        if self.tokenizer.decoder is None:
            return b" ".join(map(self.tokens.__getitem__, ids.tolist()))
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False).encode()


@cache
def coder(file: str, mark: str) -> tuple[TrieEncoder, Decoder]:
    """One of each per worker process and vocabulary; limits and fillings of the file are not used."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(file)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return TrieEncoder(tokenizer, mark), Decoder(tokenizer)


def encode(docs: DataFrame, file: str, mark: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian, four bytes each) and decoded of every row of doc_id and text.

    Null and empty texts have no ids and decode to the empty text; null and repeated doc_ids keep
    their rows; of an empty table nothing comes back; other columns go, whatever their names. No
    row needs another: there is no shuffle, and a lost executor repeats its own files only. A task
    holds the texts of one batch (4 MB, or one longer text), one trie and the remembered pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = coder(file, mark)
        for batch in slices(batches, "text"):
            ids, cuts = encoder.encode(*buffer_of(batch.column("text")), None)
            ids = ids.astype("<u4")
            rows = [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(cuts), pa.int64()),
                    pa.array([r.tobytes() for r in rows], pa.binary()),
                    pa.array([decoder.decode(r) for r in rows], pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    return plain(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
