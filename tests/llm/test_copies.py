"""Suffix-array dedup, chunk dedup and SimHash: brute force, odd rows, empty tables."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from schemaloom.llm import chunk_dedup, simhash, suffix_dedup


def brute_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        mark = np.zeros(len(r) + 1, np.int64)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                mark[i] += 1
                mark[i + length] -= 1
        gone = np.cumsum(mark)[: len(r)] > 0
        kept = np.frombuffer(r, np.uint8)[~gone].tobytes()
        out.append((len(r), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def suffix_rows(docs, **how):
    rows = suffix_dedup.deduplicated(docs, **how).collect()
    return sorted((r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept_bytes).hexdigest()) for r in rows)


def test_suffix_dedup_is_exact(some):
    assert suffix_rows(some) == brute_repeats([r.text for r in some.collect()], 400)


def test_suffix_dedup_on_odd_and_empty_tables(odd, none):
    texts = [r.text for r in odd.collect()]
    assert suffix_rows(odd) == brute_repeats(texts, 400)
    assert suffix_rows(none) == []


def test_crowded_anchors_are_merged_across_shards(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", 3)
    draw = np.random.default_rng(3)
    word = lambda n: "".join(draw.choice(list("abcdef"), n))
    passage = word(500)
    texts = [word(int(draw.integers(0, 300))) + passage[int(draw.integers(0, 60)) :] + word(200) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert suffix_rows(docs) == brute_repeats(texts, 400)


@pytest.mark.parametrize("alphabet", [1, 2, 200])
def test_ranks_and_prefixes(alphabet):
    data = np.random.default_rng(alphabet).integers(0, alphabet, 300).astype(np.uint8)
    raw, depth = data.tobytes(), 50
    order, rank = suffix_dedup.suffix_ranks(data, depth)
    # The end sorts before any byte, as in Python.
    assert [raw[i : i + depth] for i in order] == sorted(raw[i : i + depth] for i in range(300))
    lanes = np.array([0, 100, 130])
    prefix = suffix_dedup.common_prefixes(data, order, rank, lanes, depth)
    for k in range(1, 300):
        a, b = raw[order[k - 1] :], raw[order[k] :]
        n = 0
        while n < min(len(a), len(b), depth) and a[n] == b[n]:
            n += 1
        assert prefix[k] == n or (prefix[k] == depth and a[:depth] == b[:depth])


def test_binary_merge():
    a, b = np.array([1, 3, 3, 9]), np.array([0, 3, 10])
    assert suffix_dedup.merged_by_search(a, b).tolist() == [0, 1, 3, 3, 3, 9, 10]


def test_chunks_resist_insertions():
    data = np.random.default_rng(0).integers(97, 123, 20_000).astype(np.uint8)
    moved = np.concatenate([data[:5000], np.frombuffer(b"inserted", np.uint8), data[5000:]])
    pieces = lambda d: {d[a:b].tobytes() for a, b in zip([0, *chunk_dedup.chunk_ends(d)], chunk_dedup.chunk_ends(d))}
    assert len(pieces(moved) - pieces(data)) <= 8
    assert chunk_dedup.chunk_ends(data)[-1] == len(data)
    assert max(np.diff([0, *chunk_dedup.chunk_ends(np.zeros(1000, np.uint8))])) <= chunk_dedup.LONGEST


def test_chunk_dedup_keeps_first_and_finds_passages(spark):
    draw = np.random.default_rng(5)
    words = lambda n: " ".join("".join(draw.choice(list("abcdefgh"), 6)) for _ in range(n))
    passage = words(55)
    texts = [words(80) + " " + passage + " " + words(30), words(10) + " " + passage + " " + words(99), words(150), words(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in chunk_dedup.deduplicated(docs).collect()}
    assert [rows[n].n_covered > 150 for n in range(4)] == [True, True, False, False]
    assert [rows[n].n_removed > 150 for n in range(4)] == [False, True, False, False]
    assert rows[0].kept_bytes.decode() == texts[0]
    assert len(rows[1].kept_bytes) == rows[1].n_bytes - rows[1].n_removed


def test_chunk_dedup_odd_and_empty(odd, none):
    cut = chunk_dedup.deduplicated(odd)
    assert cut.columns[: len(odd.columns)] == odd.columns
    rows = cut.collect()
    assert len(rows) == odd.count()
    assert all(r.n_bytes == len((r.text or "").encode()) for r in rows)
    assert all(len(r.kept_bytes) == r.n_bytes - r.n_removed for r in rows)
    assert chunk_dedup.deduplicated(none).count() == 0


def brute_components(rows, distance):
    """rows: (id, fingerprint). Smallest id reachable, for each row."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if bin(a ^ rows[j][1]).count("1") <= distance:
                parent[find(i)] = find(j)
    least = collections.defaultdict(list)
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)].append(i)
    return [min(least[find(n)], default=None) for n in range(len(rows))]


def test_simhash_equals_brute_force(odd, some, none):
    for docs in (odd, some):
        rows = [(r.id, r.fingerprint & (1 << 64) - 1, r.component) for r in simhash.near_duplicates(docs).collect()]
        assert [r[2] for r in rows] == brute_components([r[:2] for r in rows], 2)
        want = sorted(simhash.fingerprint(r.text, 3) for r in docs.collect())
        assert sorted(r[1] for r in rows) == want
    assert simhash.near_duplicates(none).count() == 0


def test_fingerprint_by_definition():
    import xxhash

    text = "A b  C\td e É f g a b c"
    words = "a b c d e É f g a b c".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text, 3) == want
    assert simhash.fingerprint("", 3) == simhash.fingerprint(None, 3) == simhash.fingerprint(" \n", 3) == 0
    assert simhash.fingerprint("Only two", 3) == xxhash.xxh64_intdigest("only two", 42)


@pytest.mark.parametrize("crowd", [1, 32])
def test_all_close_fingerprints_are_reached(spark, monkeypatch, crowd):
    """Also when crowds under one block are split by the points next to their members."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    draw = np.random.default_rng(crowd)
    center = int(draw.integers(0, 1 << 62))
    values = {center ^ sum(1 << int(b) for b in draw.choice(64, int(draw.integers(0, 6)), replace=False)) for _ in range(150)}
    values |= {int(v) for v in draw.integers(0, 1 << 62, 50)}
    rows = [(n, v) for n, v in enumerate(sorted(values))]
    signed = [(simhash._signed(v),) for _, v in rows]
    links = simhash.close_pairs(spark.createDataFrame(signed, "fingerprint bigint"))
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    group = collections.defaultdict(list)
    for n, v in rows:
        group[roots.get(simhash._signed(v), simhash._signed(v))].append(n)
    got = {n: min(g) for g in group.values() for n in g}
    assert [got[n] for n, _ in rows] == brute_components(rows, 2)


def test_similar_documents(spark, odd, none, monkeypatch):
    draw = np.random.default_rng(9)
    vocabulary = ["".join(draw.choice(list("abcdefghij"), 6)) for _ in range(5000)]
    base = draw.choice(vocabulary, 400).tolist()
    texts = []
    for _ in range(45):  # copies with three changed words: a similarity of about 0.93
        own = list(base)
        for at in draw.integers(0, 400, 3):
            own[at] = "changed"
        texts.append(" ".join(own))
    texts += [" ".join(draw.choice(vocabulary, 300)) for _ in range(40)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for crowd in (32, 4):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        got = {r.id: r.component for r in simhash.similar_documents(docs).collect()}
        assert {got[n] for n in range(45)} == {0} and [got[n] for n in range(45, 85)] == list(range(45, 85))
        assert got[85] == got[86] == 85
    stays = simhash.kept(odd)
    assert stays.columns == odd.columns
    ids = [r.doc_id for r in stays.collect()]
    assert len(ids) == len(set(ids)) and 8 in ids and 9 not in ids and 12 not in ids
    assert simhash.kept(none).count() == 0


def test_other_distances_are_refused(spark):
    distinct = spark.createDataFrame([(1,)], "fingerprint bigint")
    for distance in (0, 1, 3):
        with pytest.raises(ValueError):
            simhash.close_pairs(distinct, distance)


def brute_similar(texts, similarity=0.8):
    """Smallest position reachable over pairs of this exact Jaccard similarity of five-word shingles."""
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= similarity * len(a | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def edited(draw, base, edits):
    own = list(base)
    for at in draw.choice(len(own), edits, replace=False):
        own[at] = f"e{draw.integers(1 << 30)}"
    return own


def test_similar_documents_at_the_threshold(spark):
    """Pairs just above and below 0.8 are decided by their shingles, whatever the size of the table."""
    draw = np.random.default_rng(4)
    texts = []
    for n in range(40):
        base = [f"d{n}w{k}" for k in range(300)]
        texts += [" ".join(base), " ".join(edited(draw, base, 5 + n % 5))]
    want = brute_similar(texts)
    assert 10 < sum(want[k] != k for k in range(80)) < 35
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.id: r.component for r in simhash.similar_documents(docs).collect()}
    assert [got[n] for n in range(80)] == want


def test_kept_leaves_a_row_of_each_group(spark):
    """Several null ids, and one id on two texts, of which one has a copy of a smaller id."""
    a, b, c, d = (" ".join(f"{x}{n}" for n in range(50)) for x in "abcd")
    rows = [(5, a, 1), (3, b, 2), (5, b, 3), (None, c, 4), (None, d, 5), (None, d, 6), (7, c + " more", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, other int")
    for parts in (1, 7):
        got = [(r.doc_id, r.text) for r in simhash.kept(docs.repartition(parts)).collect()]
        assert sorted(got, key=lambda r: r[1]) == [(5, a), (3, b), (7, c + " more"), (None, d)]


def test_crowds_lose_no_pair(spark, monkeypatch):
    """Chains of versions, where a text is close to its neighbours only and to no leader, in crowds dealt over several tasks."""
    monkeypatch.setattr(simhash, "CROWD", 3)
    monkeypatch.setattr(simhash, "SALTED", 4)
    draw = np.random.default_rng(6)
    base, texts = [f"w{k}" for k in range(300)], []
    for n in range(36):
        base = edited(draw, base, 6) if n % 12 else [f"v{n}"] * 5 + edited(draw, base[5:], 20)
        texts.append(" ".join(base))
    order = draw.permutation(36)
    texts = [texts[n] for n in order]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.id: r.component for r in simhash.similar_documents(docs).collect()}
    assert [got[n] for n in range(36)] == brute_similar(texts)


def test_repeated_lines_weigh_once(spark):
    line = "the same line again and again "
    a, b = (" ".join(f"{x}{n}" for n in range(200)) for x in "ab")
    docs = spark.createDataFrame([(1, line * 300 + a), (2, line * 300 + b), (3, a + " " + line * 2), (4, line * 90 + a)], "doc_id bigint, text string")
    want = brute_similar([r.text for r in docs.orderBy("doc_id").collect()])
    got = {r.id: r.component for r in simhash.similar_documents(docs).collect()}
    assert [got[n] - 1 for n in (1, 2, 3, 4)] == want and got[1] != got[2]


def test_shingle_sets_hold_each_shingle_once():
    odd = [None, "", "  ", "a", "A b", " a  b\tc\n", "a b c d", "a b c d e", "é É x y z w", "a\x1cb c d e f g", "a b c d e " * 4, "b a c d e", "\x85 a b c d e"]
    draw = random.Random(1)
    odd += [" ".join(draw.choice("abcXé") for _ in range(draw.randrange(12))) for _ in range(500)]

    def plain(text):
        words = (text or "").encode().lower().split()
        return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[n : n + 5]) for n in range(len(words) - 4)}

    sets = simhash.shingle_sets(pa.array(odd), 5)
    for n, (text, own) in enumerate(zip(odd, sets)):
        unsigned = own.view(np.uint64).tolist()
        assert unsigned == sorted(unsigned) and len(own) == len(plain(text))
        other = draw.randrange(len(odd))
        assert len(np.intersect1d(own, sets[other])) == len(plain(text) & plain(odd[other]))
    assert simhash.shingle_sets(pa.array([], pa.string()), 5) == []
    # Other texts at once, or a slice, change nothing.
    assert [s.tolist() for s in simhash.shingle_sets(pa.array(odd).slice(3, 40), 5)] == [s.tolist() for s in sets[3:43]]


def test_near_duplicate_stage_meets_by_fingerprints(spark):
    sets = spark.createDataFrame([(1, 5), (2, 5), (3, 6), (4, 1 << 40 | 0x7F)], "node bigint, fingerprint bigint")
    assert {tuple(r) for r in simhash._close_nodes(sets).collect()} == {(1, 2), (1, 3)}
