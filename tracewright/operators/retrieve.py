"""Retrieval: chunks of lines, vector search with metadata filters, budgets, routing of snippets, redaction at the sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.text import chunk_id
from tracewright.functions.vectors import cosine, norm
from tracewright.sources.scratch import stored


def chunks(files: DataFrame, lines_per_chunk: int) -> DataFrame:
    """(path, start_line, end_line, text, chunk_id) of runs of lines; blank runs go."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    starts = F.sequence(F.lit(0), F.size("lines") - 1, F.lit(lines_per_chunk))
    pieces = F.transform(starts, lambda i: F.struct((i + 1).alias("start_line"), F.least(i + lines_per_chunk, F.size("lines")).alias("end_line"), F.array_join(F.slice("lines", i + 1, lines_per_chunk), "\n").alias("text")))
    rows = files.select("path", lines.alias("lines")).select("path", F.explode(pieces).alias("c")).select("path", "c.*").where(F.col("text").rlike(r"\S"))
    return rows.withColumn("chunk_id", chunk_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("text")))


def top_by_cosine(vectors: DataFrame, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """(vec_id, score) of the k best by cosine, ties to the smaller id; the filter reaches the scan."""
    rows = vectors if where is None else vectors.where(where)
    scored = rows.select("vec_id", F.round(cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(k)


def top_for_queries(vectors: DataFrame, queries: DataFrame, k: int, on: tuple[str, ...] = ("namespace",)) -> DataFrame:
    """vectors' columns with query_id, score and rank: each query's k best by cosine, ties to the smaller vec_id.

    queries: query_id, q_embedding and the columns `on`, by which they meet the vectors: a table stored by namespace is read only
    where a query looks. Only keys and scores are compared, and the k best are kept by every task before the shuffle; these are
    stored, and the vectors' other columns are looked up for them alone, by a hash of the row as ids may occur several times.
    """
    rest = [c for c in vectors.columns if c != "embedding"]
    hashed = F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in vectors.dtypes if c != "embedding"])
    wide = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", *on, hashed.alias("_row"), wide.alias("_v"), norm(wide).alias("_n"))
    asked = F.col("q_embedding").cast("array<double>")
    met = rows.join(queries.select("query_id", *on, asked.alias("_q"), norm(asked).alias("_qn")), list(on))
    score = F.round(cosine(F.col("_v"), F.col("_q"), F.col("_n"), F.col("_qn")), 6)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "_row"))
    best = met.select("query_id", "vec_id", *on, "_row", score.alias("score")).withColumn("rank", place).where(F.col("rank") <= k)
    best = stored(best.select("query_id", "score", "rank", *on, "_row"), "hits")
    # Rows that are the same in all columns meet each other's hits; each hit is one row.
    return vectors.select(*rest).withColumn("_row", hashed).join(best, [*on, "_row"]).dropDuplicates(["query_id", "rank"]).select(*rest, "query_id", "score", "rank")


def packages(hits: DataFrame, budget: int = 4000) -> DataFrame:
    """(query_id, hits, text, truncated): each query's blocks in order of rank, up to the first that overflows the budget.

    hits: query_id, rank, namespace, path, start_line, end_line, text. A block is its place and its text; blocks are joined by
    an empty line, which the budget doesn't count. Nothing after a block that doesn't fit is taken, and truncated says so.
    """
    block = F.concat(F.lit("["), "namespace", F.lit("] "), "path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")))
    rows = hits.select("query_id", "rank", block.alias("block"))
    running = F.sum(F.length("block")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    fits = F.col("running") <= budget
    blocks = F.array_sort(F.collect_list(F.when(fits, F.struct("rank", "block"))))  # at most as many as a search returns
    out = rows.withColumn("running", running).groupBy("query_id").agg(blocks.alias("b"), F.bool_or(~fits).alias("truncated"))
    return out.select("query_id", F.size("b").alias("hits"), F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("text"), "truncated")


def reuse_key(snapshot: DataFrame, model: str) -> DataFrame:
    """snapshot (root, commit, file_count, languages) with the key under which its index can be used again: any change gives another."""
    quote = lambda c: F.coalesce(F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2), F.lit("null"))
    languages = F.array_join(F.transform(F.array_sort(F.map_entries("languages")), lambda e: F.concat(quote(e["key"]), F.lit(": "), e["value"].cast("string"))), ", ")
    commit = F.when(F.col("commit").isNull(), "null").otherwise(quote(F.col("commit")))
    whole = F.concat(F.lit('{"commit": '), commit, F.lit(', "embedding_model": '), quote(F.lit(model)), F.lit(', "file_count": '), F.col("file_count").cast("string"), F.lit(', "languages": {'), languages, F.lit('}, "root": '), quote(F.col("root")), F.lit("}"))
    return snapshot.withColumn("reuse_key", F.substring(F.sha2(whole, 256), 1, 24))


def within_budget(blocks: DataFrame, budget: int, size: Column, order: list[Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """The leading blocks of each key whose running size stays within the budget; nothing after the first that overflows."""
    running = F.sum(size).over(Window.partitionBy(*(keys or (F.lit(0),))).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return blocks.withColumn("running", running).where(F.col("running") <= budget)


def with_classes(targets: DataFrame, classes: dict[str, str]) -> DataFrame:
    """targets with `classes`, the vulnerability classes that their tags stand for, each once."""
    names = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])
    return targets.withColumn("classes", F.array_distinct(F.array_compact(F.transform("tags", lambda x: F.try_element_at(names, x)))))


def routed(targets: DataFrame, skills: DataFrame, most: int = 4) -> DataFrame:
    """(path, skill_id, score): the best snippets of each target.

    skills: skill_id, language?, tags, classes. A snippet qualifies by a shared tag or class:
    score = 2 x shared classes + shared tags + 3 for its language. Targets meet snippets by
    their tags and classes, so pairs without a signal don't arise.
    """
    signals = lambda df, key: df.select(key, F.explode(F.concat(F.transform("tags", lambda t: F.concat(F.lit("t:"), t)), F.transform("classes", lambda c: F.concat(F.lit("c:"), c)))).alias("signal")).distinct()
    met = signals(targets, "path").join(signals(skills, "skill_id"), "signal").groupBy("path", "skill_id").agg(F.sum(F.when(F.col("signal").startswith("c:"), 2).otherwise(1)).alias("score"))
    scored = met.join(targets.select("path", "language"), "path").join(skills.select("skill_id", F.col("language").alias("s_language")), "skill_id")
    scored = scored.select("path", "skill_id", (F.col("score") + F.when(F.col("language") == F.col("s_language"), 3).otherwise(0)).alias("score"))
    place = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("score"), "skill_id"))
    return scored.withColumn("place", place).where(F.col("place") <= most)
