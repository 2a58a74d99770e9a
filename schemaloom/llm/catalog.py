"""Registered queries over the given tables, one per operator, and their DuckDB statements."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm import chunk_dedup, decontamination, embedding_dedup, filter_audit, hard_negatives, mixing, quality_rules, reply_trees, simhash, suffix_dedup, token_files, toxicity, warc_fixity
from schemaloom.llm.tables import table
from schemaloom.workspace import new_folder, written


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of all documents, the base test and the verdict of the learned decision list."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


#: Pages of one WARC file, and the damage of the replica that op2 audits: which pages have a byte of their payload or
#: their first header line changed, which files lose their last record, which are lost.
PAGES_PER_FILE = 256
CHANGED_PAYLOAD, CHANGED_HEADER, CUT_FILE, LOST_FILE = (101, 7), (307, 11), (17, 3), (23, 5)


def _damage(file: int, records: list[bytes]) -> list[bytes]:
    def rest(n: int, by: int) -> int:
        return n % by if n >= 0 else -(-n % by)  # as SQL has it

    if rest(file, LOST_FILE[0]) == LOST_FILE[1]:
        return []
    out = []
    for raw in records:
        name = re.search(rb"<urn:page:(-?\d+)>", raw)  # pages without an id keep their bytes
        page = int(name[1]) if name else 0
        if rest(page, CHANGED_HEADER[0]) == CHANGED_HEADER[1]:
            raw = b"X" + raw[1:]
        elif rest(page, CHANGED_PAYLOAD[0]) == CHANGED_PAYLOAD[1] and b"\r\nContent-Length: 0\r\n" not in raw:
            raw = raw[:-5] + bytes([raw[-5] ^ 1]) + raw[-4:]
        out.append(raw)
    return out[:-1] if rest(file, CUT_FILE[0]) == CUT_FILE[1] else out


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC files, a damaged replica of them, and where their trees show the damage.

    Pages without an id are named null; a hash of their content deals them to files with numbers below 0.
    """
    pages = table(spark, sf_dir, "pages")
    name = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
    nameless = "-1 - CAST(conv(left(md5(concat(coalesce(url, ''), '|', coalesce(html, ''))), 4), 16, 10) AS BIGINT)"
    records = pages.select(
        F.expr(f"CASE WHEN page_id IS NULL THEN {nameless} ELSE CAST(floor(page_id / {PAGES_PER_FILE}) AS BIGINT) END").alias("file"),
        F.struct("page_id", "url", "html").alias("place"),
        warc_fixity.record(name, F.col("url"), F.col("html")).alias("record"),
    )
    first, second = new_folder(spark, "warc"), new_folder(spark, "replica")
    warc_fixity.write_files(records, first)
    warc_fixity.damaged_copy(spark, first, second, _damage)
    trees = [warc_fixity.Tree(warc_fixity.read_leaves(spark, f)) for f in (first, second)]
    return warc_fixity.audit(*trees)


def token_table(docs: DataFrame) -> DataFrame:
    """Write the block file of documents, read it back and sum it up per document."""
    spark, folder = docs.sparkSession, new_folder(docs.sparkSession, "tokens")
    token_files.write_blocks(docs, folder)
    return token_files.document_checksums(spark.read.schema(token_files.BLOCKS).parquet(folder))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of the ids of all documents, read back from the block file."""
    return token_table(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without the bytes of repeated 400-byte strings."""
    cut = suffix_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their size, the target of their source and the words that the mix takes of them."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_repeats")).alias("taken"),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of benchmark windows in all documents."""
    judged = decontamination.contamination(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    )
    return judged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op8_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What chunk dedup removes from all documents."""
    cut = chunk_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id", "n_bytes", F.col("n_covered").alias("n_repeated"), "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256")
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of all documents by a network that has learned from the learning fold only."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs.select("doc_id", "lang", "text"), model).select(
        "doc_id",
        (~toxicity.learning_fold()).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
        F.col("toxic_threshold").alias("threshold"),
    )


def op10_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and number -1, formatted, written, read back and digested."""
    tricky = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(tricky).alias("text"),
    )
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    messages = written(reply_trees.conversations_as_trees(given), "messages")
    output = reply_trees.format_trees(messages).select(
        "tree", "conv_id", "path", "position", "piece", "loss_start", "loss_end"
    )
    return reply_trees.digests(written(output, "chat"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of all orders of five filters over all documents, by language."""
    judged = filter_audit.verdicts(table(spark, sf_dir, "documents"))
    return filter_audit.audit(filter_audit.labelled(judged, table(spark, sf_dir, "labels")), "ABCDE")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for the positives of every hundredth vector, out of all vectors."""
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END")
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label=label, anchor=F.expr("vec_id % 100 = 0"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of all vectors."""
    found = embedding_dedup.linked(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_warc_fixity": op2_warc_fixity,
    "op3_token_files": op3_token_files,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_simhash": op5_simhash,
    "op6_mixing": op6_mixing,
    "op7_decontamination": op7_decontamination,
    "op8_chunk_dedup": op8_chunk_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_reply_trees": op10_reply_trees,
    "op11_filter_audit": op11_filter_audit,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_embedding_dedup": op13_embedding_dedup,
}

ORACLES = {
    "op2_warc_fixity": r"""
WITH named AS (
  SELECT page_id, url, html, coalesce(html, '') AS body, 'urn:page:' || coalesce(CAST(page_id AS VARCHAR), 'null') AS name,
    CASE WHEN page_id IS NULL THEN -1 - ('0x' || left(md5(coalesce(url, '') || '|' || coalesce(html, '')), 4))::BIGINT
      ELSE CAST(floor(page_id / 256) AS BIGINT) END AS file
  FROM pages
), records AS (
  SELECT *, row_number() OVER o AS n, count(*) OVER (PARTITION BY file) AS own,
    strlen('WARC/1.1') + 2 + strlen('WARC-Type: resource') + 2 + strlen('WARC-Record-ID: <>') + strlen(name) + 2
    + strlen('WARC-Date: 2024-01-01T00:00:00Z') + 2
    + strlen('WARC-Target-URI: ') + strlen(replace(replace(coalesce(url, name), chr(13), '%0D'), chr(10), '%0A')) + 2
    + strlen('Content-Type: text/html') + 2 + strlen('WARC-Block-Digest: sha256:') + 64 + 2
    + strlen('Content-Length: ') + strlen(CAST(strlen(body) AS VARCHAR)) + 4 + strlen(body) + 4 AS length
  FROM named WINDOW o AS (PARTITION BY file ORDER BY page_id NULLS FIRST, url NULLS FIRST, html NULLS FIRST)
), placed AS (
  SELECT *, coalesce(sum(length) OVER (PARTITION BY file ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS record_offset
  FROM records
), judged AS (
  SELECT *, CASE WHEN file % 23 = 5 OR (file % 17 = 3 AND n = own) THEN 'missing'
    WHEN page_id % 307 = 11 OR (page_id % 101 = 7 AND body <> '') THEN 'altered' END AS status
  FROM placed
)
SELECT file, CAST(record_offset AS BIGINT) AS record_offset, CAST(length AS BIGINT) AS length, name AS record_id, status
FROM judged WHERE status IS NOT NULL""",
    # The water level by its definition: the least level at which the capped shares use up the budget.
    "op6_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(text, '') AS text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * sum(size) AS cap FROM sized GROUP BY source
), weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM sources
), levels AS (
  SELECT l.source,
    ((SELECT 1.5::DOUBLE * sum(source_size) FROM weighed) - coalesce((SELECT sum(o.cap) FROM weighed o WHERE o.cap / o.w < l.cap / l.w), 0))
      / (SELECT sum(o.w) FROM weighed o WHERE o.cap / o.w >= l.cap / l.w) AS level,
    l.cap / l.w AS stop
  FROM weighed l
), final AS (SELECT min_by(level, stop) AS level FROM levels WHERE stop >= level),
targets AS (
  SELECT source, source_size, least(cap, (SELECT level FROM final) * w) AS target FROM weighed
), parts AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
    ('0x' || left(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size || ':' || text), 15))::BIGINT AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    row_number() OVER (PARTITION BY source, draw) AS j
  FROM parts
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * (whole + CASE WHEN 2 * before + (2 * j - 1) * size <= 2 * (target - whole * source_size) AND target > whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed""",
    "op7_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), starts AS (
  SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0
), windows AS (
  SELECT item, least(len(w), 13) AS n, array_to_string(list_slice(w, s, s + 12), ' ') AS key FROM starts
), sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, w, unnest(range(1, len(w) + 1)) AS s FROM d
), grams AS (
  SELECT r, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS key FROM places, sizes WHERE s + n - 1 <= len(w)
), hits AS (
  SELECT DISTINCT g.r, g.s, g.n, x.item FROM grams g JOIN windows x ON g.key = x.key AND g.n = x.n
), covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r
), named AS (
  SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list_distinct(list(item))), ',') AS items FROM hits GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)""",
    "op10_reply_trees": r"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), filled AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY n)) AS loss_sha256,
  CAST(sum(length(role) + 2 * (length(role) - length(replace(replace(role, '%', ''), chr(10), '')))
    + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length('<|im_start|>') + 1 + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM filled GROUP BY conv_id""",
    # By the definition of each column, from documents counted by the filters that they fail.
    "op11_filter_audit": r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents
), worded AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts
), known AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * list_unique(w) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS fails
  FROM worded LEFT JOIN known USING (doc_id)
), cells AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS bad FROM judged GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), moves AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS f, filter_order[1:step - 1] AS before
  FROM orders, range(1, 6) s(step)
), counted AS (
  SELECT part, filter_order, step, f, sum(n) AS total,
    coalesce(sum(n) FILTER (WHERE translate(fails, before || f, '') = fails), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE contains(fails, f) AND translate(fails, before, '') = fails), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE contains(fails, f) AND translate(fails, before, '') <> fails), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE fails = f), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE contains(fails, f) AND translate(fails, before, '') = fails), 0) AS good_lost,
    coalesce(sum(bad) FILTER (WHERE contains(fails, f) AND translate(fails, before, '') = fails), 0) AS toxic_lost
  FROM cells, moves GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted""",
    "op12_hard_negatives": r"""
WITH taking AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(coalesce(list_dot_product(a.q, c.q), 0) AS BIGINT) AS score
  FROM taking a JOIN taking c ON a.r <> c.r AND len(a.q) = len(c.q) WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) AS n FROM scored WHERE same) WHERE n <= 5
), met AS (
  SELECT p.anchor, p.n, p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.n ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank
  FROM positives p JOIN scored s ON p.anchor = s.anchor
  WHERE NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM met WHERE rank <= 5""",
    "op13_embedding_dedup": r"""
WITH RECURSIVE given AS (
  SELECT row_number() OVER () AS r, vec_id, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings
), good AS (
  SELECT * FROM given WHERE v IS NOT NULL AND len([x for x in v if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in v if x <> 0]) > 0
), links AS (
  SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.r <> b.r AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.95
), reach AS (
  SELECT r AS a, r AS b FROM given UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (
  SELECT reach.a, min(g.vec_id) AS component_id FROM reach JOIN given g ON g.r = reach.b GROUP BY reach.a
)
SELECT g.vec_id, CAST(count(links.b) AS BIGINT) AS n_links, any_value(l.component_id) AS component_id,
  g.vec_id IS NOT DISTINCT FROM any_value(l.component_id) AS kept
FROM given g JOIN least l ON l.a = g.r LEFT JOIN links ON links.a = g.r GROUP BY g.r, g.vec_id""",
}
