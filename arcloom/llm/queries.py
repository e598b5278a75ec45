"""The registered queries: each operator on its whole table, as digests."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.llm import align, decontaminate, lines, merkle, neardup, passages, pieces, pii, quality, records, subspace, urls, winnow
from arcloom.llm.components import stored
from arcloom.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, usable=~quality.held_out(F.col("doc_id")))
    score = F.col("quality_score")
    return quality.scores(docs, model).select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        score.alias("score"),
        (score >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.drop_shared_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


ORACLE["op10_lines"] = """
WITH line AS (
  SELECT doc_id, row, i, lines[i] AS line,
         translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT doc_id, row_number() OVER () AS row,
                     string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), shared AS (
  SELECT key FROM line WHERE key <> '' GROUP BY key HAVING count(DISTINCT row) >= 10
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(s.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (s.key IS NULL), '')) AS kept_sha256
FROM line LEFT JOIN shared s USING (key) GROUP BY row
"""


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE["op2_decontaminate"] = r"""
WITH item AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark
), win AS (
  SELECT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)
), doc AS (
  SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
), place AS (
  SELECT row, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM doc
), phrase AS (
  SELECT row, i, size, string_agg(word, ' ') OVER next AS phrase, count(*) OVER next AS found
  FROM (SELECT row, i, word, 10 AS size FROM place)
  WINDOW next AS (PARTITION BY row ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)
  UNION ALL
  SELECT row, i, size, array_to_string(w[i:i + size - 1], ' '), size
  FROM (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM doc, (SELECT DISTINCT size FROM win WHERE size < 10) WHERE len(w) >= size)
), hit AS (
  SELECT p.row, p.i, p.size, win.item_id
  FROM phrase p JOIN win ON win.size = p.size AND win.phrase = p.phrase WHERE p.found = p.size
), words AS (
  SELECT row, count(DISTINCT pos) AS n_hit
  FROM (SELECT row, unnest(range(i, i + size)) AS pos FROM hit) GROUP BY row
), items AS (
  SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT row, item_id::VARCHAR AS id FROM hit) GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (row) LEFT JOIN items USING (row)
"""


@query
def op4_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.NearCopies().classes(docs).select("doc_id", "class_id", "class_size", "copies")


PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS_FILE = public_tokenizers.path("word_bpe_49k.json")
BYTES_FILE = public_tokenizers.path("byte_bpe_50k.json")


@query
def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = pieces.encode(docs, PIECES, decoded="decoded")
    return both.select(
        "doc_id",
        F.size("pieces").cast("long").alias("n_pieces"),
        F.xxhash64("pieces").alias("pieces_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text")).alias("same_text"),
    )


@query
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = winnow.edited(docs).select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        winnow.values(winnow.fingerprint(F.col("text"))).alias("own"),
        winnow.values(winnow.fingerprint(F.col("edited"))).alias("edited"),
        "next_values",
    )

    def written(values):
        return F.array_join(F.transform(values, lambda v: F.lower(F.hex(v))), " ")

    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written("own").alias("fingerprint"),
        written("edited").alias("edited_fingerprint"),
        winnow.likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        winnow.likeness(F.col("own"), F.col("next_values")).alias("near_next"),
    )


@query
def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    # Labels are by document; a page carries the label of the document of its number.
    labels = table(spark, sf_dir, "labels").where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    labelled = pages.join(labels, F.col("page_id") == F.col("doc_id")).select("url", (F.col("q") == 0).alias("blocked"))
    return urls.judge(pages, urls.rule_table(spark), urls.RuleMiner().mine(labelled))


@query
def op7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = scratch_path(spark, "records")
    index = records.write_records(docs, folder, WORDS_FILE, end_id=2)
    return records.read_digests(records.starts(index), folder)


@query
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(kind):
        return lambda span: span["kind"] == kind

    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        *[
            F.size(F.filter(base, of(kind))).cast("long").alias(f"n_{kind}")
            for kind in ("email", "ip", "card", "phone")
        ],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


@query
def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages between first documents of texts, and copies of texts as passages of all their words."""
    shared = passages.SharedPassages()
    found, members = shared.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    copies = members.where((F.col("doc_id") != F.col("first")) & (F.col("n_words") >= shared.min_words))
    return found.drop("n_same").unionByName(
        copies.select(
            "doc_id",
            F.lit(0).alias("start"),
            F.col("n_words").cast("int").alias("end"),
            F.col("first").alias("other_id"),
            F.lit(0).alias("other_start"),
            F.col("n_words").cast("int").alias("other_end"),
            F.lit(1.0).alias("likeness"),
        )
    )


@query
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh document (by checksum of its id) is claimed to have one more character than it has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claim = F.when(chosen, F.try_add("n_chars", F.lit(1))).otherwise(F.col("n_chars"))

    def written(digest: str):
        return F.lower(F.hex(digest))

    proved = merkle.manifest(docs.withColumn("claim", claim)).withColumn("folded", merkle.fold(F.col("claimed"), F.col("proof"), F.col("sides")))
    return proved.select(
        "doc_id",
        written("leaf").alias("leaf"),
        written("subroot").alias("subroot"),
        written("root").alias("root"),
        F.sha2(written("proof"), 256).alias("proof_sha256"),
        written("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


ORACLE["op13_manifest"] = """
WITH RECURSIVE field AS (
  SELECT doc_id, lang, row_number() OVER () AS row, n_chars,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail,
         list_reduce(list_concat([4294967295::UBIGINT],
             list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
           lambda crc, b: list_reduce(list_concat([xor(crc, b)], list_transform(range(8), lambda i: 0::UBIGINT)),
             lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)) AS crc
  FROM documents
), doc AS (
  SELECT doc_id, lang, row, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
         sha256(head || coalesce(strlen(claim::VARCHAR) || ':' || claim, '-') || tail) AS claimed
  FROM (SELECT *, n_chars + coalesce((xor(crc, 4294967295::UBIGINT) % 7 = 0)::INT, 0) AS claim FROM field)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM doc
), node AS (
  SELECT lang, 0 AS level, pos AS i, leaf AS h FROM placed
  UNION ALL
  SELECT lang, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM
    (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM node) WHERE n > 1 GROUP BY lang, level, i // 2
), top AS (
  SELECT lang, max(level) AS level FROM node GROUP BY lang
), subroot AS (
  SELECT t.lang, n.h, row_number() OVER (ORDER BY t.lang NULLS FIRST) - 1 AS pos
  FROM top t JOIN node n ON t.lang IS NOT DISTINCT FROM n.lang AND t.level = n.level
), upper AS (
  SELECT 0 AS level, pos AS i, h FROM subroot
  UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM
    (SELECT *, count(*) OVER () AS n FROM upper) WHERE n > 1 GROUP BY level, i // 2
), root AS (
  SELECT level, h FROM upper ORDER BY level DESC LIMIT 1
), climb AS (
  SELECT p.row, p.lang, 0 AS level, p.pos AS i, p.claimed AS h, '' AS proof, t.level AS top
  FROM placed p JOIN top t ON p.lang IS NOT DISTINCT FROM t.lang
  UNION ALL
  SELECT c.row, c.lang, c.level + 1, c.i // 2,
         sha256(CASE WHEN c.i % 2 = 1 THEN coalesce(n.h, '') || c.h ELSE c.h || coalesce(n.h, '') END),
         c.proof || coalesce(n.h, ''), c.top
  FROM climb c LEFT JOIN node n
    ON n.lang IS NOT DISTINCT FROM c.lang AND n.level = c.level AND n.i = xor(c.i, 1) WHERE c.level < c.top
), climbed AS (
  SELECT row, 0 AS level, s.pos AS i, c.h, c.proof
  FROM climb c JOIN subroot s ON c.lang IS NOT DISTINCT FROM s.lang WHERE c.level = c.top
  UNION ALL
  SELECT c.row, c.level + 1, c.i // 2,
         sha256(CASE WHEN c.i % 2 = 1 THEN coalesce(u.h, '') || c.h ELSE c.h || coalesce(u.h, '') END),
         c.proof || coalesce(u.h, '')
  FROM climbed c LEFT JOIN upper u ON u.level = c.level AND u.i = xor(c.i, 1)
  WHERE c.level < (SELECT level FROM root)
)
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, sha256(c.proof) AS proof_sha256,
       c.h AS folded_root, c.h = r.h AS verified
FROM placed p JOIN subroot s ON p.lang IS NOT DISTINCT FROM s.lang
JOIN root r ON true JOIN climbed c ON c.row = p.row AND c.level = r.level
"""


@query
def op12_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = subspace.NearVectors().classes(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE["op12_embeddings"] = """
WITH RECURSIVE vec AS (
  SELECT row_number() OVER () AS row, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
), good AS (
  SELECT row, label, v, sqrt(list_dot_product(v, v)) AS norm FROM vec
  WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_dot_product(v, v) > 0
), link AS (
  SELECT a.row AS a, b.row AS b FROM good a JOIN good b ON a.label = b.label AND a.row <> b.row AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98
), reach AS (
  SELECT row AS first, row AS met FROM vec
  UNION
  SELECT first, b FROM reach JOIN link ON a = met
), low AS (
  SELECT first, min(vec_id) AS component_id FROM reach JOIN vec ON row = met GROUP BY first
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM vec JOIN low ON row = first LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) ON a = row
"""


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = align.Alignment(BYTES_FILE, PIECES)
    aligned = stored(both.align(table(spark, sf_dir, "documents")), "aligned")
    return both.scores(aligned, both.pair_counts(aligned)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
