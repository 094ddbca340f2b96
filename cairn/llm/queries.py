"""Registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import (audit, embeddings, licenses, mixing, packing, prefixes, quality, secrets, shards,
                       simhash, substrings, suffixes, warc)
from cairn.plans.catalog import Catalog
from cairn.session import configure

catalog = Catalog()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@catalog.add()
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = mixing.quality_domains(table(spark, sf_dir, "labels"))
    rows, report = mixing.mix(table(spark, sf_dir, "documents"), labelled,
                              {"clean": 0.9, "poor": 0.04, "toxic": 0.06})
    return rows.withColumns({"met": F.lit(report["met"]), "steps": F.lit(report["steps"])})


@catalog.add()
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@catalog.add()
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@catalog.add()
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows


@catalog.add("""
WITH hashed AS (
    SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
digits AS (
    SELECT page_id, hex, strlen(body) AS payload_bytes, list_transform(range(0, 8),
        lambda i: ('0x' || substring(hex, 1 + 5 * CAST(i AS INT), 5))::BIGINT) AS fives
    FROM hashed),
named AS (
    SELECT page_id, hex, payload_bytes, array_to_string(list_transform(fives, lambda v:
        substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((v >> 15) & 31 AS INT), 1)
        || substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((v >> 10) & 31 AS INT), 1)
        || substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((v >> 5) & 31 AS INT), 1)
        || substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(v & 31 AS INT), 1)), '')
        AS payload_digest, max(page_id) OVER (PARTITION BY hex) AS newest
    FROM digits)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN page_id < newest THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < newest THEN newest END AS refers_to
FROM named""")
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@catalog.add()
def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign_shards(table(spark, sf_dir, "documents"))


@catalog.add()
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@catalog.add(r"""
WITH split AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents),
windows AS (
    SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS piece
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM split)),
firsts AS (SELECT piece, min(doc_id) AS least FROM windows GROUP BY piece),
gone AS (
    SELECT DISTINCT doc_id, i + k AS place
    FROM windows JOIN firsts USING (piece), (SELECT unnest(range(0, 13)) AS k)
    WHERE least < doc_id),
kept AS (
    SELECT w.doc_id, count(*) AS n_kept, string_agg(w.word, ' ' ORDER BY w.place) AS line
    FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place
          FROM split) w
    ANTI JOIN gone ON w.doc_id = gone.doc_id AND w.place = gone.place GROUP BY w.doc_id)
SELECT split.doc_id, len(words)::BIGINT AS n_words,
    (len(words) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM split LEFT JOIN kept ON split.doc_id = kept.doc_id""")
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


@catalog.add()
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


@catalog.add()
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings, _ = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return findings


@catalog.add("""
WITH said AS (
    SELECT conv_id AS c, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS turn,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
    FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(turn ORDER BY k) AS turns FROM said GROUP BY c),
hashed AS (
    SELECT c, turns, c - c % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(
        list_transform(string_split(c::VARCHAR, ''), lambda x:
            [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END),
        4294967295::BIGINT) % 9 AS h
    FROM own),
whole AS (
    SELECT a.c, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS seq
    FROM hashed a LEFT JOIN own b ON b.c = a.base),
members AS (
    SELECT c, d, len(seq) AS depth_of_c, md5(to_json(seq[1:d])::VARCHAR) AS name,
        CASE WHEN d > 0 THEN md5(to_json(seq[1:d - 1])::VARCHAR) END AS up,
        CASE WHEN d > 0 THEN strlen(seq[d].t) ELSE 0 END AS bytes
    FROM (SELECT c, seq, unnest(range(0, len(seq) + 1)) AS d FROM whole)),
nodes AS (
    SELECT name, d, min(c) AS conv_id, count(*) AS n, any_value(up) AS up, any_value(bytes) AS bytes,
        sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (depth_of_c = d), '')) AS ends
    FROM members GROUP BY name, d),
kids AS (SELECT up, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
lines AS (
    SELECT DISTINCT a.name AS top, b.name AS low FROM members a JOIN members b ON a.c = b.c AND a.d <= b.d),
sums AS (
    SELECT top, count(*) FILTER (kids.n IS NULL) AS leaves, sum((nodes.n - 1) * bytes) AS saved
    FROM lines JOIN nodes ON nodes.name = low LEFT JOIN kids ON kids.up = low GROUP BY top)
SELECT nodes.conv_id, nodes.d::BIGINT AS depth, parent.conv_id AS parent_conv_id, nodes.n AS n_convs,
    coalesce(kids.n, 0) AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, nodes.ends AS ends_sha256
FROM nodes JOIN sums ON sums.top = nodes.name LEFT JOIN kids ON kids.up = nodes.name
LEFT JOIN nodes parent ON parent.name = nodes.up""")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(table(spark, sf_dir, "conversations"))


@catalog.add(r"""
WITH read AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
flags AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
judged AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY body) THEN 16 ELSE 0 END AS mask
    FROM read LEFT JOIN flags USING (doc_id)),
counted AS (SELECT part, mask, good, toxic, count(*) AS n FROM judged GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
        AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (
    SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
    FROM orders, (SELECT unnest(range(1, 6)) AS step)),
report AS (
    SELECT part, filter_order, own, step::INT AS step,
        sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN mask & before > 0 AND mask & own > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN good AND mask & before = 0 AND mask & own > 0 THEN n ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN toxic AND mask & before = 0 AND mask & own > 0 THEN n ELSE 0 END)::BIGINT AS toxic_lost
    FROM counted, steps GROUP BY ALL),
shares AS (SELECT part, own, sum(removed)::BIGINT AS shapley FROM report GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley
FROM report JOIN shares USING (part, own)""")
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return audit.audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


@catalog.add("""
WITH src AS (
    SELECT doc_id, encode(coalesce(text, '')) AS body, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (
    SELECT doc_id, h, unnest(range(0, (length(h) // 2) // 1000 + 1)) AS k FROM src),
cuts AS (SELECT doc_id, k * 1000 AS base, substring(h, 1 + 2000 * k, 2098) AS part FROM pieces),
windows AS (
    SELECT doc_id, base + j AS pos, unhex(substring(part, 1 + 2 * j, 100)) AS piece
    FROM (SELECT doc_id, base, part, unnest(range(0, least(1000, length(part) // 2 - 49))) AS j FROM cuts)),
firsts AS (SELECT piece, min(doc_id) AS least FROM windows GROUP BY piece),
hits AS (SELECT doc_id, pos FROM windows JOIN firsts USING (piece) WHERE least < doc_id),
runs AS (
    SELECT doc_id, min(pos) AS a, max(pos) + 50 AS b FROM (
        SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (
            SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50 THEN 0 ELSE 1 END AS fresh
            FROM hits))
    GROUP BY doc_id, run),
gone AS (SELECT doc_id, sum(b - a) AS n, count(*) AS spans, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM runs GROUP BY doc_id)
SELECT src.doc_id, octet_length(body)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
    sha256(CASE WHEN n IS NULL THEN body ELSE unhex(array_to_string(list_transform(range(1, len(a) + 2), lambda i:
        substring(h, 1 + 2 * coalesce(b[i - 1], 0), 2 * (coalesce(a[i], octet_length(body)) - coalesce(b[i - 1], 0)))), '')) END) AS kept_sha256
FROM src LEFT JOIN gone ON gone.doc_id = src.doc_id""")
def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeated_bytes(table(spark, sf_dir, "documents"))
