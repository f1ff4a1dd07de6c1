"""The registered queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import table

#: The tokenizer's file, by the public_tokenizers module's name for it.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.licenses import document_paths, scan_licenses

    return scan_licenses(document_paths(table(spark, sf_dir, "documents")))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.topk import exact_topk

    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.mixing import mix_sources, taken_per_document

    return taken_per_document(*mix_sources(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.warc import archive_pages, read_warc

    return read_warc(archive_pages(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.quality import score_quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return score_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "p_content", "p_metadata", "score", "keep")


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.wavelet import read_token_shards, write_token_shards

    return read_token_shards(write_token_shards(table(spark, sf_dir, "documents"), tokenizer_path()))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.suffix_tree import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.periodic import periodic_runs, rewritten

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    found = periodic_runs(docs.mapInArrow(rewritten, "doc_id long, text binary"))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.negatives import mine_negatives

    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return mine_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.substrings import drop_repeated

    found = drop_repeated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_licenses, op3_exact_topk, op4_decontaminate, op5_mix, op6_warc, op7_quality, op8_tokens, op9_secrets, op10_suffix_tree, op11_periodic, op12_hard_negatives, op13_substrings, pipeline)
}

#: Where SQL expresses an operator's whole result.
ORACLES = {
    "op3_exact_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
                   where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        q as (select * from v where vec_id % 50 = 0),
        s as (select q.vec_id as query_id, v.vec_id, cast(list_sum(list_transform(list_zip(q.v, v.v), lambda p: p[1] * p[2])) as bigint) as score
              from q join v on q.vec_id <> v.vec_id and len(q.v) = len(v.v)),
        r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
        select * from r where rank <= 5""",
    "op6_warc": """
        with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as d from pages),
        g as (select d, max(page_id) as keeper, count(*) as c from p where n >= 1000 group by d)
        select page_id, cast(n as bigint) as payload_bytes, p.d as payload_digest,
               case when c > 1 and page_id is distinct from keeper then 'revisit' else 'response' end as record_type,
               case when c > 1 and page_id is distinct from keeper then keeper end as refers_to
        from p left join g on p.d = g.d and n >= 1000""",
    "op12_hard_negatives": """
        with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
                   where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select a.vec_id as anchor_id, a.label as own, v.vec_id, v.label, cast(list_sum(list_transform(list_zip(a.v, v.v), lambda p: p[1] * p[2])) as bigint) as score
              from v a join v on a.vec_id <> v.vec_id and len(a.v) = len(v.v) where a.vec_id % 100 = 0),
        p as (select anchor_id, own, vec_id as positive_id, score as positive_score from s where own = label qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
        select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) as integer) as rank, vec_id as negative_id, positive_score, score as negative_score
        from p join s on s.anchor_id = p.anchor_id and s.label <> p.own and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
        qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) <= 5""",
    "op13_substrings": r"""
        with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        g as (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13),
        k as (select doc_id, i, array_to_string(w[i : i + 12], ' ') as gram from g),
        f as (select gram, min(doc_id) as first from k group by gram),
        r as (select distinct doc_id, unnest(range(i, i + 13)) as pos from k join f using (gram) where first < doc_id),
        x as (select doc_id, list(pos) as gone from r group by doc_id)
        select doc_id, len(w)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
               sha256(array_to_string(case when gone is null then w else list_filter(w, lambda y, j: not list_contains(gone, j)) end, ' ')) as kept_sha256
        from d left join x using (doc_id)""",
}
