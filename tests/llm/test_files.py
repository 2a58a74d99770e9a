"""Token files, WARC audit, chat formatting, pipeline: round trips, odd rows, empty tables."""

import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from schemaloom.llm import decontamination, range_coder, reply_trees, token_files, warc_fixity
from schemaloom.workspace import new_folder
from tests.llm.conftest import SF


@pytest.mark.parametrize("size,vocabulary", [(0, 10), (1, 1), (1, 49408), (700, 2), (3000, 70000), (9000, 300)])
def test_coder_round_trip(size, vocabulary):
    draw = np.random.default_rng(size)
    ids = np.minimum((draw.pareto(1.0, size) * 3).astype(np.int64), vocabulary - 1)
    blocks = range_coder.encode(ids, vocabulary)
    assert np.array_equal(np.concatenate(range_coder.decode(blocks) or [ids[:0]]), ids)
    # Blocks are independent.
    alone = [range_coder.decode([b])[0] for b in reversed(blocks)][::-1]
    assert np.array_equal(np.concatenate(alone or [ids[:0]]), ids)


def test_coder_compresses_and_notices_damage():
    ids = np.tile(np.arange(50), 100)
    blocks = range_coder.encode(ids, 49408)
    assert sum(map(len, blocks)) < 0.8 * 2 * len(ids)
    broken = bytearray(blocks[0])
    broken[40] ^= 4
    with pytest.raises(ValueError, match="damaged"):
        range_coder.decode([bytes(broken)])
    with pytest.raises(ValueError, match="format"):
        range_coder.decode([b"????" + blocks[0][4:]])


def test_joined_crc32():
    a, b = b"some bytes", bytes(range(256)) * 5
    assert token_files.joined_crc32(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert token_files.joined_crc32(zlib.crc32(a), zlib.crc32(b""), 0) == zlib.crc32(a)


def brute_tokens(rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out, start


@pytest.mark.parametrize("which", ["odd", "some", "none"])
def test_token_files(spark, request, which):
    docs = request.getfixturevalue(which)
    folder = new_folder(spark, "tokens-test")
    token_files.write_blocks(docs, folder)
    blocks = spark.read.schema(token_files.BLOCKS).parquet(folder)
    got = sorted(token_files.document_checksums(blocks).collect(), key=lambda r: r.start)
    want, total = brute_tokens([(r.doc_id, r.text) for r in docs.collect()])
    # Rows of one id may come in any order among themselves.
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == collections.Counter(want)
    assert [r.doc_id for r in got] == [w[0] for w in want]
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])])[: len(got)].tolist()
    assert sum(r.n_tokens for r in got) == total


def test_words_are_encoded_as_in_their_text(some):
    encoder = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = [r.text for r in some.collect()] + ["ΟΔΥΣΣΕΎΣ ΣΑΣ", "a<|endoftext|>b", "é é ́x", "it's 12,5 %\x1cz"]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def warc(spark, rows, name):
    frame = spark.createDataFrame(rows, "file bigint, place int, name string, url string, html string")
    folder = new_folder(spark, name)
    warc_fixity.write_files(frame.select("file", "place", warc_fixity.record(F.col("name"), F.col("url"), F.col("html")).alias("record")), folder)
    return folder


def test_warc_audit(spark):
    rows = [(f, n, f"urn:{f}-{n}", None if n == 1 else f"http://x/\r\n{n}", None if n == 2 else f"é\r\n\r\n{n}\n" * (n * 400)) for f in (0, 1, 5, 40) for n in range(12)]
    rows.append((41, 0, "urn:big", "u", "y" * 300_000))
    folder = warc(spark, rows, "warc-test")
    records = warc_fixity.read_files(spark, folder)
    assert records.count() == len(rows)
    raw = {(r.file, r.record_offset): bytes(r.record) for r in records.collect()}
    assert all(b.startswith(b"WARC/1.1\r\n") and b.endswith(b"\r\n\r\n") for b in raw.values())

    def change(number, own):
        if number == 5:
            return []
        own = list(own)
        if number == 1:
            own[3] = own[3][:-6] + b"?" + own[3][-5:]
            own[7] = b"Q" + own[7][1:]
        if number == 40:
            own = own[:-1]
        return own

    copy = new_folder(spark, "replica-test")
    warc_fixity.damaged_copy(spark, folder, copy, change)
    tree, other = (warc_fixity.Tree(warc_fixity.hashed(warc_fixity.read_files(spark, f))) for f in (folder, copy))
    got = {(r.record_id, r.status) for r in warc_fixity.audit(tree, other).collect()}
    want = {("urn:1-3", "altered"), ("urn:1-7", "altered"), ("urn:40-11", "missing")} | {(f"urn:5-{n}", "missing") for n in range(12)}
    assert got == want
    assert {(r.record_id, r.status) for r in warc_fixity.audit(other, tree).collect()} >= {("urn:40-11", "extra")}
    assert warc_fixity.audit(tree, tree).count() == 0


def test_warc_of_nothing(spark):
    empty = warc_fixity.Tree(warc_fixity.hashed(spark.createDataFrame([], "file bigint, record_offset bigint, record binary")))
    assert warc_fixity.audit(empty, empty).count() == 0


def brute_paths(messages, top):
    children, nodes = collections.defaultdict(list), {(m[0], m[1]): m for m in messages}
    for m in messages:
        parent = (m[0], m[2]) if m[2] is not None and (m[0], m[2]) in nodes else None
        children[parent].append((m[0], m[1]))
    paths = collections.defaultdict(list)

    def walk(node, path):
        path = [*path, node]
        if not children[node]:
            mean = sum(nodes[n][3] or 0.0 for n in path) / len(path)
            paths[node[0]].append((-mean, node[1], [n[1] for n in path]))
        for child in children[node]:
            walk(child, path)

    for root in children[None]:
        walk(root, [])
    return {(t, k): p[2] for t, own in paths.items() for k, p in enumerate(sorted(own)[:top], 1)}


@pytest.mark.parametrize("top", [1, 3])
def test_reply_paths(spark, top):
    draw = np.random.default_rng(top)
    rows = [(t, n, int(draw.integers(max(0, n - 6), n)) if n and draw.random() < 0.97 else None, None if n % 7 == 0 else float(draw.integers(0, 4))) for t in ("a", "b", "") for n in range(70)]
    rows += [("chain", n, n - 1, 1.0) for n in range(37)] + [("loop", 1, 2, 1.0), ("loop", 2, 1, 1.0)]
    messages = spark.createDataFrame(rows, "tree string, node bigint, parent bigint, score double")
    got = collections.defaultdict(dict)
    for r in reply_trees.chosen_paths(messages, top).collect():
        got[r.tree, r.path][r.position] = r.node
    assert {k: [v[p] for p in range(len(v))] for k, v in got.items()} == brute_paths(rows, top)
    assert reply_trees.chosen_paths(messages.limit(0)).count() == 0


def test_chat_round_trip(spark):
    tricky = ["", None, "<|im_end|><|im_start|>assistant ok", "\\", "\\<|\\\\", "a\n\n%0A%25", "<\\|", "🙂<|x|>é", "<|im_end|>\n"]
    rows = [(c, n, role, t) for c in (None, 7, 1 << 60) for n, (t, role) in enumerate((t, r) for t in tricky for r in ("assistant", "user\n%0A<|", None))]
    rows += [(3, None, "user", "x"), (3, 1, "assistant", "y"), (3, 1, "assistant", "y")]
    given = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    pieces = reply_trees.format_trees(reply_trees.conversations_as_trees(given))
    assert pieces.where("length(piece) - length(replace(piece, '<|', '')) <> 4").count() == 0  # two control strings each
    got = {r.conv_id: r for r in reply_trees.digests(pieces).collect()}
    for conv in (None, 7, 1 << 60, 3):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv].n_turns == len(own) and got[conv].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert got[conv].loss_chars == len(loss) and got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_stages_keep_columns_and_clean_documents(spark, odd, none):
    """Stage by stage on odd rows and on none; the last gives tokens of what the fourth returned."""
    for docs in (odd.select("doc_id", "text", "lang", "source", "n_chars"), none.select("doc_id", "text", "lang", "source", "n_chars")):
        before, columns = docs.count(), docs.columns
        for name, stage in corpus_pipeline.STAGES[:3]:
            docs = stage(spark, docs, SF).cache()
            assert docs.columns == columns and docs.count() <= before, name
        kept = {(r.doc_id, r.text) for r in docs.collect()}
        mixed = corpus_pipeline.mix_sources(spark, docs, SF)
        assert mixed.columns == columns and {(r.doc_id, r.text) for r in mixed.collect()} <= kept
        assert corpus_pipeline.token_output(spark, mixed, SF).count() == mixed.count()


def test_pipeline_against_its_parts(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in rows:
        ids = [*tokenizer.encode(docs[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    kept = {r.doc_id for r in rows}
    table = spark.read.parquet(f"{SF}/documents.parquet")
    dirty = decontamination.contamination(table, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated")
    assert not kept & {r.doc_id for r in dirty.collect()}
    by_text = collections.Counter(docs[d] for d in kept)
    assert max(by_text.values()) == 1
    assert max(collections.Counter(r.doc_id for r in rows).values()) <= 2
