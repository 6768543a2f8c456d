"""Quality ledger, license scan, near-duplicates and repeated windows against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.cases import ROOT, given
from tickloom.llm import license_texts, licenses, quality, queries, simhash, substring

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def by_sql(name: str, rows) -> list[tuple]:
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    found = con.execute(queries.SQL[name])
    names = sorted(range(len(found.description)), key=lambda i: found.description[i][0])
    return sorted((tuple(r[i] for i in names) for r in found.fetchall()), key=repr)


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def judged(docs):
    rows = quality.judged(quality.judged(quality.ledger(docs), quality.BASE, "base"), quality.WEB)
    return rows.withColumn("base_failed", ~F.col("base")).drop("base")


def test_ledger(docs, texts, nothing):
    assert rows_of(judged(docs)) == by_sql("op1_rule_ledger", texts)
    assert judged(nothing).count() == 0
    kept = quality.kept_rows(docs, quality.WEB)
    assert kept.columns == docs.columns
    assert kept.count() == judged(docs).where("kept").count()


def test_ablations_count_bit_patterns(docs):
    rows = quality.ledger(docs)
    bits = [r.fail_bits for r in rows.collect()]
    for r in quality.ablations(rows, quality.BASE, quality.WEB).collect():
        policy = {"base": quality.BASE, "web": quality.WEB}[r.policy]
        bit = 1 << [n for n, _ in quality.RULES].index(r.rule)
        assert (r.n_rows, r.n_kept) == (len(bits), sum(not b & policy.mask for b in bits))
        assert r.n_failed == sum(bool(b & bit) for b in bits)
        assert r.n_only == sum((b & policy.mask) == bit for b in bits)


def test_licenses(docs, texts, nothing):
    found = licenses.scan(docs)
    assert rows_of(found) == by_sql("op9_license_templates", texts)
    assert licenses.scan(nothing).count() == 0
    (row,) = found.where("doc_id = 18").collect()
    assert (row.n_base, row.base_labels, row.labels, row.score) == (2, "cc-by-nc,mit", "cc-by-nc,mit", 0.6)


def wordings(template):
    """The longest and the shortest wording of a template."""
    full = re.sub(r"<\d+-(\d+)>", lambda m: " ".join("v" for _ in range(int(m[1]))), template.replace("[[", "").replace("]]", ""))
    bare = re.sub(r"<(\d+)-\d+>", lambda m: " ".join("v" for _ in range(int(m[1]))), re.sub(r"\[\[.*?\]\]", "", template))
    return " ".join(full.split()), " ".join(bare.split())


@pytest.mark.parametrize("number", range(len(licenses.TEMPLATES)))
def test_automata_agree_with_the_printed_texts(number):
    """Both were written down apart: each word of either that is changed is missed by both."""
    label, score, template = licenses.TEMPLATES[number]
    automaton, (named, graded, pattern) = licenses.compiled(label, score, template), license_texts.patterns()[number]
    assert (named, graded) == (label, score)
    regex = re.compile(pattern)
    full, bare = wordings(template)
    words = full.split()
    changed = [" ".join([*words[:i], "changed", *words[i + 1 :]]) for i in range(len(words))]
    for wording in (full, bare, *changed):
        split = wording.encode().split()
        accepted = automaton.accepts(split)
        assert accepted == automaton.accepts([licenses.word_hash(w.decode()) for w in split], automaton.hashed)
        assert accepted == bool(regex.match(f" {wording} "))
    assert automaton.accepts([*full.encode().split(), b"more"])


def test_a_changed_condition_scores_less(session):
    """Whole licences score 1, with any one condition changed less; in the scan and in SQL."""
    whole = [(label, wordings(t)[0]) for label, score, t in licenses.TEMPLATES if score == 1.0]
    assert {label for label, _ in whole} == {"mit", "isc", "bsd-2", "bsd-3"}
    rows = []
    for label, text in whole:
        for old, new in (("this", "this"), ("copyright notice", "copyright mark"), ("as is", "as it is"), ("damages", "losses"), ("warranties", "promises")):
            rows.append((len(rows), text.replace(old, new).title()))
    rows.append((len(rows), "x" * 2048 + " " + whole[0][1]))
    df = session.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(licenses.scan(df))
    assert got == by_sql("op9_license_templates", rows)
    score = {r.doc_id: (r.score, r.labels) for r in licenses.scan(df).collect()}
    for i, (label, _) in enumerate(whole):
        assert score[5 * i][0] == 1.0 and label in score[5 * i][1].split(",")
        assert all(score[5 * i + k][0] < 1 for k in range(1, 5))


def fingerprint(text) -> int:
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    grams = [words[i : i + 3] for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(rows) -> list[tuple]:
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    values = np.array(fps, np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3).tolist():
            root[find(i)] = find(j)
    least: dict[int, int | None] = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), doc) if x is not None), default=None)
    return sorted(((least[find(i)], d, f"{fps[i]:016x}") for i, (d, _) in enumerate(rows)), key=repr)


def test_near_duplicates(docs, texts, nothing):
    assert rows_of(simhash.near_duplicates(docs)) == linked(texts)
    assert simhash.near_duplicates(nothing).count() == 0


def test_one_of_each(docs, texts, nothing):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {d for c, d, _ in linked([x for x in texts if x[0] is not None]) if c == d}
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert Counter(ids) == Counter(want) + Counter({None: sum(d is None for d, _ in texts)})
    assert simhash.one_of_each(nothing).count() == 0


def test_golay_keys_meet():
    """Any two values of 23 bits that differ in one bit: the first's word is among the second's."""
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 23, 4000)
    nearest = simhash.code_words(values)[:, 0]
    for bit in range(23):
        other = simhash.code_words(values ^ (1 << bit))
        assert (other == nearest[:, None]).any(1).all()
    keys, more = simhash.golay()
    assert {int(x).bit_count() for x in keys} == {0, 1, 2, 3} and len(keys) == 2048
    assert ((more >= 0).sum(1) == np.where([int(x).bit_count() == 3 for x in keys], 5, 0)).all()


def test_all_pairs_within_three_bits_are_found(session):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    values = {int(b) for b in base}
    for b in base.view(np.uint64).tolist():
        for k in (1, 2, 3, 3, 4):
            values.add(int(np.uint64(b ^ sum(1 << int(i) for i in rng.choice(64, k, replace=False))).view(np.int64)))
    fps = session.createDataFrame([(v,) for v in values], "fp long")
    array = np.array(sorted(values))
    far = np.bitwise_count(array[:, None].view(np.uint64) ^ array[None].view(np.uint64))
    want = {(int(array[i]), int(array[j])) for i, j in np.argwhere(far <= 3) if array[i] < array[j]}
    assert {(r.a, r.b) for r in simhash.links(fps).collect()} == want


def test_keys_are_never_broadcast(session, tmp_path):
    """A table of fingerprints is small, the keys made of it are not: no side of their join goes through the driver."""
    path = f"file://{tmp_path}/fps"
    session.range(1000).select(F.xxhash64("id").alias("fp")).write.parquet(path)
    found = simhash.links(session.read.parquet(path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def kept(rows, width):
    split = [(t or "").encode().split() for _, t in rows]
    count = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for (doc, _), w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        text = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, hashlib.sha256(text).hexdigest(), len(gone), len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width", [35, 4])
def test_repeated_windows(docs, texts, nothing, width, monkeypatch):
    monkeypatch.setattr(substring, "GROUP_BYTES", 50_000)
    done = substring.remove_repeated(docs, width)
    assert set(done.columns) == {*docs.columns, "n_words", "n_removed", "kept_text"}
    got = done.select("doc_id", F.sha2("kept_text", 256).alias("kept"), "n_removed", F.col("n_words").alias("words"))
    assert sorted(map(tuple, got.collect()), key=repr) == kept(texts, width)
    assert substring.remove_repeated(nothing).count() == 0


def test_rows_of_a_batch_do_not_grow_with_the_groups(docs, texts, monkeypatch):
    """Coarse ranges first: the same result, and no more rows a batch, however many groups."""
    monkeypatch.setattr(substring, "COARSE", 8)
    monkeypatch.setattr(substring, "DEALT", 5000)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    most = []
    for size in (200_000, 2_000, 100):
        monkeypatch.setattr(substring, "GROUP_BYTES", size)
        groups = -(-substring.text_bytes(docs) // size)
        windows = substring._windows(rows, 4, min(groups, substring.COARSE))
        most.append(windows.groupBy("batch").count().agg(F.max("count")).first()[0])
        done = substring.remove_repeated(docs, 4)
        got = done.select("doc_id", F.sha2("kept_text", 256).alias("kept"), "n_removed", F.col("n_words").alias("words"))
        assert sorted(map(tuple, got.collect()), key=repr) == kept(texts, 4)
    assert groups > 2000 and max(most) <= 8


def test_a_batch_computed_again_keeps_its_name(docs):
    """A lost executor has map outputs made again under another stage id."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    windows = substring._windows(rows, 35, 4)
    first, second = ({r.batch for r in windows.select("batch").distinct().collect()} for _ in range(2))
    assert first and first == second


def test_intervals_are_maximal():
    edges = np.array([0, 100, 300])
    first, last = substring.merged(np.array([0, 1, 2, 36, 72, 99, 100]), 35, edges)
    assert list(zip(first.tolist(), last.tolist(), strict=True)) == [(0, 71), (72, 134), (100, 135)]


@pytest.mark.parametrize("name", ["op3_golay_simhash", "op4_repeated_windows"])
def test_queries_on_the_given_table(session, name):
    rows = [(r["doc_id"], r["text"]) for r in given()]
    got = rows_of(queries.QUERIES[name](session, ROOT))
    want = linked(rows) if name.startswith("op3") else sorted(((d, k, g, n) for d, k, g, n in kept(rows, 35)), key=repr)
    assert got == want
