"""Hard negatives, trie encoding and lexical search against brute force, the library and DuckDB."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given as drawn
from hypothesis import settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.cases import ROOT, hard_texts
from tickloom.llm import bpe, lexical, negatives, queries, tokens, words
from tickloom.llm.common import buffer_of

WORDS, BYTES = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
KINDS = [(WORDS, tokens.SPACE_DROPPED), (BYTES, tokens.BYTE_LEVEL)]


def by_sql(name, root):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return sorted(con.execute(queries.SQL[name]).fetchall())


@pytest.mark.parametrize("name", ["op11_strassen_negatives", "op13_bit_sliced_search"])
def test_queries_match_sql(session, name):
    df = queries.QUERIES[name](session, ROOT)
    assert sorted(map(tuple, df.collect())) == by_sql(name, ROOT)


# --- products and heaps


@settings(max_examples=60, deadline=None)
@drawn(st.integers(0, 70), st.integers(0, 70), st.integers(0, 70), st.integers(0, 2**32 - 1), st.booleans())
def test_strassen_is_the_product(m, k, n, seed, wide):
    rng = np.random.default_rng(seed)
    low, high = (-(2**63), 2**63 - 1) if wide else (-300, 300)
    a, b = rng.integers(low, high, (m, k)), rng.integers(low, high, (k, n))
    want = np.zeros((m, n), np.int64)
    for i in range(k):
        want += a[:, i : i + 1] * b[i : i + 1]
    assert (negatives.product(a, b) == want).all()


@settings(max_examples=60, deadline=None)
@drawn(st.lists(st.tuples(st.integers(-3, 3), st.booleans()), min_size=1, max_size=40), st.integers(1, 6), st.integers(1, 5))
def test_heaps_merge_to_the_best(row, k, parts):
    want = sorted(((-s, i) for i, (s, ok) in enumerate(row) if ok))[:k]
    heaps = [negatives.Heaps(1, k) for _ in range(parts)]
    for p, heap in enumerate(heaps):
        mine = np.arange(p, len(row), parts)
        if len(mine):
            score, ok = np.array([[row[i][0] for i in mine]]), np.array([[row[i][1] for i in mine]])
            negatives.kept(score, ok, mine, heap)
    for other in heaps[1:]:
        heaps[0].merge(other)
    _, ids, score = heaps[0].entries()
    assert list(zip((-score).tolist(), ids.tolist(), strict=True)) == want


@drawn(st.integers(-(2**62), 2**62))
def test_score_window(p):
    low, high = (int(x[0]) for x in negatives.score_window(np.array([p])))
    assert 30 * p <= 100 * low < 30 * p + 100 and 90 * p - 100 < 100 * high <= 90 * p


def mined(rows, every, positive=5, negative=10):
    """Rows of (vec_id, label, vector) by the contract's words."""
    once = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        once[i] = min(once.get(i, (label, v)), (label, v))
    q = {i: ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]) for i, (label, v) in once.items()}
    out = []
    for a in sorted(i for i in q if i % every == 0):
        score = {i: sum(x * y for x, y in zip(q[a][1], q[i][1], strict=False)) for i in q if i != a}
        best = lambda ids, k: sorted(ids, key=lambda i: (-score[i], i))[:k]
        for p in best((i for i in score if q[i][0] == q[a][0]), positive):
            inside = [i for i in score if q[i][0] != q[a][0] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(a, p, n + 1, i, score[p], score[i]) for n, i in enumerate(best(inside, negative))]
    return sorted(out)


def test_negatives_in_small_blocks_with_hot_label_and_copies(session, monkeypatch):
    for name, value in {"ANCHORS": 16, "CANDIDATES": 64, "TILE": 4, "TILE_BYTES": 4 * 8 * 24}.items():
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(3)
    common = rng.normal(size=19).tolist()
    rows = [(i, 3 if i % 3 == 0 else int(rng.integers(10)), common if i % 3 == 1 else rng.normal(size=19).round(2).tolist()) for i in range(400)]
    df = session.createDataFrame([(i, x, v, 1, True) for i, x, v in rows], "vec_id long, label int, embedding array<double>, block int, asks boolean").repartition(5)
    got = sorted(map(tuple, negatives.mine(df, 10).collect()))
    assert got == mined(rows, 10) and len({r[0] for r in got}) > 30


def test_negatives_odd_rows(session):
    one = [0.5, -0.25, 1.0]
    rows = [(0, 1, one), (1, 1, one), (2, 2, [0.25, 0.0, 0.5]), (2, 2, [0.25, 0.0, 0.5]), (3, 2, [0.5]), (4, 2, []), (100, 2, [1.0, 1.0, 1.0])]
    rows += [(5, None, one), (6, 2, None), (8, 2, [1.0, None, 1.0]), (9, 2, [math.nan, 1.0, 1.0]), (10, 2, [math.inf, 1.0, 1.0]), (None, 2, one), (2, 1, one)]
    rows += [(200, 2**62, one), (7, 9, one), (300, -7, [-1.0, 0.0, 0.0])]
    kind = "vec_id long, label long, embedding array<double>"
    df = session.createDataFrame(rows, kind)
    assert sorted(map(tuple, negatives.mine(df, 100).collect())) == mined(rows, 100)
    huge = session.createDataFrame([(0, 1, [1e300]), (1, 1, [-1e300]), (2, 2, [3.0]), (7, 2**63 - 1, [1.0])], kind)
    assert negatives.mine(huge, 100).count() >= 0
    assert negatives.mine(df.limit(0), 100).count() == 0


# --- encoding


def odd_texts(n, seed):
    rng = random.Random(seed)
    parts = ["a", "b", "ab", "th", "e", " ", "  ", "\n", "\t", ".", ",", "'s", "1", "23", "é", "é", "日本", "<|endoftext|>",
             "<|startoftext|>", "<|endoftext", "|>", "Σ", "İ", "\x01", " \x01 ", "　", "\xa0", "aaa", "!!!", "hello", "World", "'ll", "ß",
             "🙂", "​", "\x85", "ab" * 300]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


LONGER = ["z" * 70_000, "abc" * 400, "the" * 50_000, "", None]


@pytest.mark.parametrize(("file", "mark"), KINDS)
def test_trie_and_pieces_give_the_library_s_ids(file, mark):
    """20,000 texts with special strings, against a tokenizer as it comes from its file."""
    fresh = Tokenizer.from_file(file)
    texts = [t for _, t in hard_texts()] + LONGER + odd_texts(20_000, 1)
    want = [x.ids for x in fresh.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    trie, decoder = bpe.coder(file, mark)
    for ours in (trie, tokens.encoder(file, mark)):
        ids, cuts = ours.encode(*buffer_of(pa.array(texts)), None)
        got = [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        assert got == want
    for ids in want[:2000]:
        assert decoder.decode(np.array(ids, np.uint32)).decode() == fresh.decode(ids, skip_special_tokens=False)


def test_a_walk_visits_shared_prefixes_once(monkeypatch):
    trie, _ = bpe.coder(*KINDS[0])
    seen = Counter()
    state = bpe.Merges.state

    def counted(self, tail, states, side):
        seen[side is self.inner] += 1
        return state(self, tail, states, side)

    monkeypatch.setattr(bpe.Merges, "state", counted)
    trie.merges.encode([f"understand{x}" for x in ("", "s", "ing", "ings", "able")])
    assert seen == {True: len("understand") + len("ing") + len("abl"), False: 5}


def test_encode_rows(session, docs, texts, nothing):
    fresh = Tokenizer.from_file(WORDS)
    done = bpe.encode(docs, WORDS, tokens.SPACE_DROPPED)
    want = []
    for doc, text in texts:
        ids = fresh.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), np.array(ids, "<u4").tobytes(), fresh.decode(ids, skip_special_tokens=False)))
    got = [(r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in done.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert bpe.encode(nothing, WORDS, tokens.SPACE_DROPPED).count() == 0
    query = queries.QUERIES["op12_trie_bpe"](session, ROOT)
    row = query.orderBy("doc_id").first()
    text = session.read.parquet(f"{ROOT}/documents.parquet").where(f"doc_id = {row.doc_id}").first().text
    ids = fresh.encode(text, add_special_tokens=False).ids
    assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and row.n_tokens == len(ids)
    assert row.decoded_sha256 == hashlib.sha256(fresh.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_words_of_two_letters_with_one_polynomial():
    """The pair of Thue and Morse: 2,048 letters, the second word with both letters exchanged."""
    one = b"".join(b"ab"[bin(i).count("1") & 1 :][:1] for i in range(2048))
    other = one.translate(bytes.maketrans(b"ab", b"ba"))
    data = np.frombuffer(one + other, np.uint8)
    found = words.word_hashes(data, np.array([0, 2048]), np.array([2048, 4096]))
    assert found[0] != found[1]


# --- lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(docs, items, k=20):
    counts = [(d, Counter(TERM.findall((t or "").translate(FOLD)))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n, length = sum(x > 0 for x in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for (doc, c), size in zip(counts, sizes, strict=True):
            score = 0
            for t in TERM.findall((text or "").translate(FOLD)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * (75 + 25 * size * n // length)))
            if score and doc is not None:
                found.append((-score, doc))
        out += [(item, r + 1, doc, -s) for r, (s, doc) in enumerate(sorted(found)[:k])]
    return sorted(out)


def test_search_is_exact(session, docs, texts, nothing, monkeypatch):
    """Small blocks and batches of one item; ties, copies, very long and odd texts among both."""
    monkeypatch.setattr(lexical, "DOCUMENTS", 16)
    monkeypatch.setattr(lexical, "PAIRS", 3000)
    monkeypatch.setattr(lexical, "ITEM_BYTES", 400)
    monkeypatch.setattr(lexical, "FIRST", 2)
    rows = [(r["item_id"], r["text"]) for r in session.read.parquet(f"{ROOT}/benchmark.parquet").collect()][:12]
    rows += [(900, "w1 w2 w2 W3"), (901, "é ñ 日本語 x"), (902, ""), (903, None), (904, "!? ."), (905, "zzz"), (906, "w5 " * 3000), (907, "repeated row")]
    items = session.createDataFrame([(i, t, 1, 2) for i, t in rows] + [(None, "w1", 1, 2)], "item_id long, text string, doc_id long, score long")
    got = sorted(map(tuple, lexical.rank(docs, items).collect()))
    assert got == ranked(texts, rows)
    assert lexical.rank(nothing, items).count() == 0 and lexical.rank(docs, items.limit(0)).count() == 0


def test_most_documents_are_never_scored():
    """What the bounds are for: with one document to find, few others are scored."""
    rng = random.Random(2)
    vocabulary = [f"t{i}" for i in range(3000)]
    found = [" ".join(rng.choices(vocabulary, k=80)) for _ in range(2000)]
    hashes, counts = lexical.terms_of(pa.array(found))
    ends = np.cumsum(counts)
    pairs = [np.unique(hashes[e - c : e], return_counts=True) for c, e in zip(counts, ends, strict=True)]
    starts = np.append(0, np.cumsum([len(t) for t, _ in pairs]))
    docs = np.stack([np.ones(2000, np.int64), np.arange(2000)], 1)
    block = lexical.Block(docs, counts, starts, *(np.concatenate(x) for x in zip(*pairs, strict=True)))
    read = lexical.Block.of(block.row())
    terms, weights = pairs[7][0], np.full(len(pairs[7][0]), 5000)
    part, best = np.full(2000, 100), lexical.Best(1)
    assert lexical.search_block(read, terms, weights, part, best) < 50 and best.doc.tolist() == [7]
    bound, exact = read.bounds(terms, weights, part), read.scores(np.arange(2000), terms, weights, part)
    assert (bound >= exact).all() and (bound == exact).mean() > 0.3
