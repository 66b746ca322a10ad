"""The registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsift.llm import alignment, byte_bpe, idfiles, jaccard, langid, merkle, packing, permindex, quality_net, repeats, rules, secret_scan, urls
from oddsift.llm.base import crc_of, table
from oddsift.session import shared_folder

BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.pmod(crc_of("doc_id"), F.lit(5)) == 0, F.lit(False))
    vectors = quality_net.contexts(docs.select("text"))
    scored = quality_net.score(docs, quality_net.train(docs, labels, ~held_out, vectors), vectors)
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.pair_ratios(secret_scan.labelled_strings(spark, docs)))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.train(urls.labels_from_rules(pages, urls.RULES)), urls.RULES)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(table(spark, sf_dir, "documents"), byte_bpe.read_ranks(BYTE_RANKS), public_tokenizers.PATTERN)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.group(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.score(docs, rules.references(docs))


def op7_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    idfiles.write(table(spark, sf_dir, "documents"), path, WORD_BPE)
    return idfiles.digest(spark, path)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"), WORD_BPE)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(crc_of("doc_id"), F.lit(3)) == 1, F.lit(False))
    found = langid.predict(docs, langid.train(docs, ~held_out, PIECES))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permindex.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned_counts(table(spark, sf_dir, "documents"), BYTE_BPE, PIECES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_secret_scans": op2_secret_scans,
    "op3_url_filters": op3_url_filters,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_quality_rules": op6_quality_rules,
    "op7_id_files": op7_id_files,
    "op8_packing": op8_packing,
    "op9_language_id": op9_language_id,
    "op10_permutation_index": op10_permutation_index,
    "op11_repeated_passages": op11_repeated_passages,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_token_alignment": op13_token_alignment,
}

#: the Jaccard groups in SQL: distinct shingles, a join of different sets within each other's size, and reachable sets
JACCARD_SQL = """
with recursive
w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                                          when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
sized as materialized (select doc_id, count(*) as n, sum(hash(s)) as h from s group by 1),
kinds as materialized (select min(doc_id) as id, any_value(n) as n, n as nn, h from sized group by n, h),
ks as materialized (select s.doc_id as id, s.s, k.n from s join kinds k on s.doc_id = k.id),
pair as (select a.id as a, b.id as b, a.n as n, b.n as m, count(*) as c from ks a join ks b on a.s = b.s and a.id < b.id
                and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by 1, 2, 3, 4),
link as materialized (select a, b from pair where 100 * c >= 85 * (n + m - c)),
both_ways as materialized (select a, b from link union all select b, a from link),
reach(a, b) as (select id, id from kinds union select r.a, l.b from reach r join both_ways l on r.b = l.a),
least_id as (select a, min(b) as c from reach group by 1)
select w.doc_id, cast(coalesce(sized.n, 0) as bigint) as n_shingles, coalesce(l.c, w.doc_id) as component_id
from w left join sized using (doc_id) left join kinds k on sized.n = k.n and sized.h = k.h left join least_id l on l.a = k.id
"""

#: the others need code beyond SQL (models, tokenizers, digests of byte arrays); tests hold them against brute force instead
ORACLES: dict[str, str] = {"op5_jaccard_join": JACCARD_SQL}
