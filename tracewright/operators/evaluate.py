"""Evaluation against ground truth: one-to-one matching in parallel rounds, metrics of manifests and rules, baselines, rates and gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.text import normalised
from tracewright.sources.scratch import stored

RECALL_FLOOR, FALSE_POSITIVE_CEILING = 0.90, 0.10
# Why a rule is kept or changed, and what a miss and a false positive say.
ACTIONS = (
    ("shadow", "rule produced false positives; stage it before it drags precision"),
    ("loosen", "rule missed expected findings; widen or lower its evidence floor"),
    ("keep", "rule matched expected findings with no false positives"),
)
MISS_REASON = "no finding matched the expected benchmark vulnerability"
FALSE_POSITIVE_REASON = "finding did not match any expected benchmark vulnerability"
FAILED_STAGE = "benchmark_ground_truth_matching"


def evidence_words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: F.length(w) > 2)


def contained_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id): the items whose text stands in a document's text, anywhere.

    docs: doc_id, text; items: item_id, text. Pieces are what stands between white space. An item of three pieces or more
    meets the documents that hold its longest inner piece, which must stand there whole. The first and last piece may be parts of a
    document's, so an item of one or two pieces looks for its longest one in the vocabulary by grams of up to three
    characters, and meets the documents of the words that hold it. All pairs are verified on the texts. Items of
    white space alone aren't looked for.
    """
    pieces = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    longest = lambda ws: F.array_max(F.transform(ws, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    words = docs.select("doc_id", F.explode(F.array_distinct(pieces(F.coalesce("text", F.lit(""))))).alias("word"))
    cut = items.select("item_id", pieces(F.coalesce("text", F.lit(""))).alias("ws"))
    inner = cut.where(F.size("ws") > 2).select("item_id", longest(F.slice("ws", F.lit(2), F.size("ws") - 2)).alias("word"))
    short = cut.where(F.size("ws").between(1, 2)).select("item_id", longest(F.col("ws")).alias("part")).withColumn("n", F.least(F.length("part"), F.lit(3)))
    grams = lambda c, n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(c, i, F.lit(n)))
    all_grams = F.flatten(F.array(*[F.when(F.length("word") >= n, grams(F.col("word"), n)).otherwise(F.expr("cast(array() as array<string>)")) for n in (1, 2, 3)]))
    if short.isEmpty():
        met = inner
    else:
        lengths = F.broadcast(short.select("n").distinct())  # three rows at most
        vocabulary = words.select("word").distinct().select("word", F.explode(F.array_distinct(all_grams)).alias("gram")).withColumn("n", F.length("gram")).join(lengths, "n", "left_semi")
        keyed = short.withColumn("gram", F.substring("part", 1, 3))
        met = inner.unionByName(vocabulary.join(keyed, "gram").where(F.col("word").contains(F.col("part"))).select("item_id", "word")).distinct()
    pairs = words.join(met, "word").select("doc_id", "item_id").distinct()
    whole = docs.select("doc_id", F.col("text").alias("d_text"))
    return pairs.join(whole, "doc_id").join(items.select("item_id", F.col("text").alias("i_text")), "item_id").where(F.col("d_text").contains(F.col("i_text"))).select("item_id", "doc_id")


def rule_of(finding_id: Column) -> Column:
    return F.substring_index(finding_id, ":", 1)


def finding_text(findings: DataFrame) -> Column:
    """What evidence and sinks are looked for in: id, title, rationale, function, tags and conditions, normalised."""
    have = lambda c, kind="string": F.col(c) if c in findings.columns else F.lit(None).cast(kind)
    parts = [F.coalesce(have(c), F.lit("")) for c in ("finding_id", "title", "rationale", "function_name")]
    parts += [F.coalesce(F.array_join(have(c, "array<string>"), " "), F.lit("")) for c in ("tags", "conditions")]
    return normalised(F.concat_ws(" ", *parts))


def _filled(column: Column) -> Column:
    return F.coalesce(column, F.lit("")) != ""


def _within(e: DataFrame, f: DataFrame, hit: Column) -> DataFrame:
    """Pairs of a key that hit: rows that state a line meet the findings of that line only, the others all of their key."""
    same = F.col("e.key") == F.col("f.key")
    placed = e.where("line is not null").alias("e").join(f.alias("f"), same & (F.col("e.line") == F.col("f.line")) & hit)
    free = e.where("line is null").alias("e").join(f.alias("f"), same & hit)
    return placed.select("e.key", "e_ord", "f_ord").unionByName(free.select("e.key", "e_ord", "f_ord"))


def expected_matches(expected: DataFrame, findings: DataFrame) -> DataFrame:
    """Candidate pairs (key, e_ord, f_ord): expected rows and the findings of their key that satisfy them; nulls and empty texts are wildcards.

    expected: key, e_ord, rule_id?, line?, path, function?, sink?, evidence, cwe?; findings: key, f_ord,
    path, line, finding_id (or rule_id) and what finding_text() reads (or `text`, normalised). A sink is normalised before it is
    looked for, and one word of the evidence that is longer than two characters suffices. A weakness counts only where a
    text still names one with its hyphen, which normalisation takes away.
    """
    rule = rule_of(F.col("finding_id")) if "finding_id" in findings.columns else F.col("rule_id")
    function = next((F.col(c) for c in ("function_name", "function") if c in findings.columns), F.lit(None).cast("string"))
    f = findings.select("key", "f_ord", "path", "line", rule.alias("rule_id"), function.alias("function"), (F.col("text") if "text" in findings.columns else finding_text(findings)).alias("text"))
    columns = expected.columns
    e = expected.withColumns({c: F.lit(None).cast("string") for c in ("rule_id", "function", "sink", "evidence", "cwe") if c not in columns})
    e = e.withColumns({"sink": normalised(F.col("sink")), "evidence": normalised(F.col("evidence"))})
    path = F.regexp_replace(F.coalesce("e.path", F.lit("")), r"^\*+|\*+$", "")
    words = evidence_words(F.col("e.evidence"))
    hit = (
        (~_filled(F.col("e.rule_id")) | (F.col("f.rule_id") == F.col("e.rule_id")))
        & F.col("f.path").contains(path)
        & (~_filled(F.col("e.function")) | (F.col("f.function") == F.col("e.function")))
        & F.col("f.text").contains(F.col("e.sink"))
        & ((F.size(words) == 0) | F.exists(words, lambda w: F.col("f.text").contains(w)))
        & (~F.col("f.text").contains("cwe-") | F.col("f.text").contains(F.lower(F.coalesce("e.cwe", F.lit("")))))
    )
    return _within(e, f, hit)


def one_to_one(pairs: DataFrame) -> DataFrame:
    """(key, e_ord, f_ord): as if, within each key, expected rows in order each took the first finding not taken yet.

    In rounds, all keys at once: every row asks for the first finding left to it, and a finding keeps the first row that asks. Whoever
    holds it in the end stands no later than that row, so later rows lose it for good. A key in which no two rows ask for
    the same is settled, and leaves. A round is two aggregates and a join by key and finding, so a manifest of any size
    spreads over the tasks. Before that, of rows that share all their candidates the n-th can't get one of the first n - 1, since
    the rows before it take these or find them taken: so equal wildcards, which would take a round each, are settled together.
    """
    every = pairs.select("key", "e_ord", "f_ord").distinct()
    # Rows of equal candidates: by their number and two sums of hashes.
    own = every.groupBy("key", "e_ord").agg(F.count("*").alias("n"), F.sum(F.xxhash64("f_ord").cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64("f_ord", F.lit(1)).cast("decimal(38,0)")).alias("b"))
    among = own.withColumn("nth", F.row_number().over(Window.partitionBy("key", "n", "a", "b").orderBy("e_ord"))).where("nth > 1").select("key", "e_ord", "nth")
    placed = every.withColumn("place", F.row_number().over(Window.partitionBy("key", "e_ord").orderBy("f_ord")))
    left = stored(placed.join(among, ["key", "e_ord"], "left").where("nth is null or place >= nth").select("key", "e_ord", "f_ord"), "pairs")
    done: list[DataFrame] = []
    while not left.isEmpty():
        asked = left.groupBy("key", "e_ord").agg(F.min("f_ord").alias("f_ord"))
        held = stored(asked.groupBy("key", "f_ord").agg(F.min("e_ord").alias("e_ord"), F.count("*").alias("n")), "held")
        open_ = held.where("n > 1").select("key").distinct()
        done.append(held.join(open_, "key", "left_anti").select("key", "e_ord", "f_ord"))
        kept = left.join(open_, "key", "left_semi").join(held.select("key", "f_ord", F.col("e_ord").alias("holder")), ["key", "f_ord"], "left")
        left = stored(kept.where("holder is null or e_ord <= holder").select("key", "e_ord", "f_ord"), "pairs")
    out = left
    for final in done:
        out = out.unionByName(final)
    return out


#: The name that the sequence gives it.
greedy_one_to_one = one_to_one


def misses(expected: DataFrame, matches: DataFrame) -> DataFrame:
    return expected.join(matches.select("key", "e_ord"), ["key", "e_ord"], "left_anti")


def false_positives(findings: DataFrame, matches: DataFrame) -> DataFrame:
    return findings.join(matches.select("key", "f_ord"), ["key", "f_ord"], "left_anti")


def _with_action(counts: DataFrame) -> DataFrame:
    which = F.when(F.col("false_positives") > 0, 0).when(F.col("missed") > 0, 1).otherwise(2)
    pick = lambda i: F.element_at(F.array(*[F.lit(a[i]) for a in ACTIONS]), which + 1)
    return counts.withColumns({"recommendation": pick(0), "rationale": pick(1)})


def rule_metrics(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, rule_id, matched, false_positives, missed, recommendation, rationale) from rows of rule_id and kind ('matched', 'false_positive', 'missed')."""
    named = rows.where("coalesce(rule_id, '') <> ''").groupBy(*keys, "rule_id")
    return _with_action(named.agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("matched", "matched"), ("false_positive", "false_positives"), ("missed", "missed"))]))


@dataclass(frozen=True)
class Evaluation:
    """What an evaluation of manifests gives, each a DataFrame by key.

    metrics: expected, actual, matched, missed, false_positives, recall (null without expected rows) and precision (null
    without findings); matches: e_ord, f_ord; misses and false_positives: their rows with a reason; rules: rule_metrics per key;
    calibration: one record a miss, naming the stage that failed and what to improve next.
    """

    metrics: DataFrame
    matches: DataFrame
    misses: DataFrame
    false_positives: DataFrame
    rules: DataFrame
    calibration: DataFrame


def evaluate_manifests(expected: DataFrame, findings: DataFrame) -> Evaluation:
    """All manifests at once: expected and findings as expected_matches() takes them, findings with finding_id."""
    matches = stored(one_to_one(expected_matches(expected, findings)), "matches")
    missed = misses(expected, matches).withColumn("reason", F.lit(MISS_REASON))
    wrong = false_positives(findings, matches).withColumns({"rule_id": rule_of(F.col("finding_id")), "reason": F.lit(FALSE_POSITIVE_REASON)})
    sizes = expected.select("key", F.lit("expected").alias("kind")).unionByName(findings.select("key", F.lit("actual").alias("kind"))).unionByName(matches.select("key", F.lit("matched").alias("kind")))
    n = {k: F.count_if(F.col("kind") == k) for k in ("expected", "actual", "matched")}
    metrics = sizes.groupBy("key").agg(*[c.alias(k) for k, c in n.items()])
    metrics = metrics.withColumns({
        "missed": F.col("expected") - F.col("matched"), "false_positives": F.col("actual") - F.col("matched"),
        "recall": F.when(F.col("expected") > 0, F.col("matched") / F.col("expected")), "precision": F.when(F.col("actual") > 0, F.col("matched") / F.col("actual")),
    })
    hit = findings.join(matches.select("key", "f_ord"), ["key", "f_ord"], "left_semi").select("key", rule_of(F.col("finding_id")).alias("rule_id"), F.lit("matched").alias("kind"))
    kinds = hit.unionByName(wrong.select("key", "rule_id", F.lit("false_positive").alias("kind"))).unionByName(missed.select("key", F.col("rule_id"), F.lit("missed").alias("kind")))
    calibration = missed.withColumns({"failed_stage": F.lit(FAILED_STAGE), "next_improvement_candidate": F.when(_filled(F.col("rule_id")), F.concat(F.lit("rule:"), "rule_id")).otherwise("language_hunter")})
    return Evaluation(metrics, matches, missed, wrong, rule_metrics(kinds, ("key",)), calibration)


def baseline_matches(expected: DataFrame, baseline: DataFrame) -> DataFrame:
    """Candidate pairs (key, e_ord, f_ord) per manifest and tool: what either side doesn't state can't disagree.

    baseline: manifest, tool, f_ord, path, line?, rule_id?, cwe?, evidence; expected: key (a manifest), e_ord and the
    columns of expected_matches(). key becomes the pair of manifest and tool.
    """
    tools = baseline.select("manifest", "tool").distinct()
    e = expected.withColumnRenamed("key", "manifest").join(tools, "manifest").withColumn("key", F.struct("manifest", "tool")).alias("e")
    f = baseline.withColumn("key", F.struct("manifest", "tool")).withColumn("text", normalised(F.col("evidence"))).alias("f")
    agree = lambda c: ~_filled(F.col(f"e.{c}")) | ~_filled(F.col(f"f.{c}")) | (F.col(f"e.{c}") == F.col(f"f.{c}"))
    hit = (
        agree("rule_id")
        & (F.col("e.line").isNull() | F.col("f.line").isNull() | (F.col("e.line") == F.col("f.line")))
        & F.col("f.path").contains(F.regexp_replace(F.coalesce("e.path", F.lit("")), r"^\*+|\*+$", ""))
        & (~_filled(F.col("f.cwe")) | (F.lower("f.cwe") == F.lower("e.cwe")))
        & (~_filled(F.col("e.sink")) | F.col("f.text").contains(F.lower("e.sink")))
    )
    return e.join(f, (F.col("e.manifest") == F.col("f.manifest")) & (F.col("e.tool") == F.col("f.tool")) & hit).select("e.key", "e_ord", "f_ord")


def baseline_deltas(expected: DataFrame, baseline: DataFrame) -> DataFrame:
    """(manifest, tool, matched, missed, extra): each tool's findings against the manifest's expected rows, all tools in one run."""
    matched = one_to_one(baseline_matches(expected, baseline)).groupBy("key").agg(F.count("*").alias("matched")).select("key.*", "matched")
    sizes = baseline.groupBy("manifest", "tool").agg(F.count("*").alias("found"))
    wanted = expected.groupBy(F.col("key").alias("manifest")).agg(F.count("*").alias("expected"))
    n, all_, seen = F.coalesce("matched", F.lit(0)), F.coalesce("expected", F.lit(0)), F.col("found")
    return sizes.join(matched, ["manifest", "tool"], "left").join(wanted, "manifest", "left").select("manifest", "tool", n.alias("matched"), (all_ - n).alias("missed"), (seen - n).alias("extra"))


def detection_rollup(counts: DataFrame, key: str) -> DataFrame:
    """Sums per key and overall (key null, overall true) with recall (1 without expected) and the false-positive share of all findings (0 without any)."""
    out = counts.rollup(key).agg(*[F.sum(c).alias(c) for c in ("expected", "matched", "actual", "false_positives")], F.grouping(key).alias("_all"))
    recall = F.when(F.col("expected") > 0, F.col("matched") / F.col("expected")).otherwise(1.0)
    rate = F.when(F.col("actual") > 0, F.col("false_positives") / F.col("actual")).otherwise(0.0)
    return out.withColumns({"recall": F.round(recall, 6), "false_positive_rate": F.round(rate, 6), "overall": F.col("_all") == 1}).drop("_all")


def detection_gate(rates: DataFrame, floor: float = RECALL_FLOOR, ceiling: float = FALSE_POSITIVE_CEILING) -> DataFrame:
    """rates with passed: recall at or above the floor and the false-positive rate below the ceiling."""
    return rates.withColumn("passed", (F.col("recall") >= floor) & (F.col("false_positive_rate") < ceiling))


def _percent(share: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f%%", F.bround(share * 100, digits))


def breaches(rates: DataFrame, key: str, floor: float = RECALL_FLOOR, ceiling: float = FALSE_POSITIVE_CEILING) -> DataFrame:
    """rates (of detection_rollup) with `breaches`, the sentences of what fails: recall, then the false-positive rate."""
    recall = F.when(F.col("expected") > 0, F.col("matched") / F.col("expected")).otherwise(1.0)
    rate = F.when(F.col("actual") > 0, F.col("false_positives") / F.col("actual")).otherwise(0.0)
    name = F.when(F.col("overall"), "overall").otherwise(F.col(key))
    count = lambda a, b: F.concat(F.lit(" ("), F.col(a).cast("string"), F.lit("/"), F.col(b).cast("string"), F.lit(")"))
    low = F.when(recall < floor, F.concat(name, F.lit(" recall "), _percent(recall, 2), F.lit(f" below {floor:.0%}"), count("matched", "expected")))
    high = F.when(rate >= ceiling, F.concat(name, F.lit(" FP rate "), _percent(rate, 2), F.lit(f" at or above {ceiling:.0%}"), count("false_positives", "actual")))
    return rates.withColumn("breaches", F.array_compact(F.array(low, high)))


def gate_verdict(rates: DataFrame, key: str, score_passed: DataFrame | None = None, floor: float = RECALL_FLOOR, ceiling: float = FALSE_POSITIVE_CEILING) -> DataFrame:
    """One row (passed, detection_passed, score_passed, reasons) from detection_rollup's rates.

    Reasons stand by key, those of the whole last. score_passed: rows with `passed`; a failed score blocks, a
    passed one never lifts a detection that failed. As many reasons as there are languages, so they fit one row.
    """
    rows = breaches(rates, key, floor, ceiling)
    order = F.array_sort(F.collect_list(F.struct("overall", F.coalesce(F.col(key), F.lit("")).alias("name"), "breaches")))
    reasons = F.flatten(F.transform(order, lambda r: r["breaches"]))
    out = rows.agg(reasons.alias("reasons")).withColumn("detection_passed", F.size("reasons") == 0)
    if score_passed is None:
        out = out.withColumn("score_passed", F.lit(True))
    else:
        out = out.join(F.broadcast(score_passed.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("score_passed"))))  # one row
    return out.select((F.col("detection_passed") & F.col("score_passed")).alias("passed"), "detection_passed", "score_passed", "reasons")


def within_tolerance(baseline: DataFrame, candidate: DataFrame, key: str, recall_band: float = 0.05, rate_band: float = 0.05) -> DataFrame:
    """(key, recall_ok, rate_ok, within): whether a candidate's rates stay in a band around the baseline's, by key (null is the whole)."""
    b = baseline.select(F.col(key).alias("_key"), F.col("recall").alias("b_recall"), F.col("false_positive_rate").alias("b_rate"))
    joined = candidate.join(b, F.col(key).eqNullSafe(F.col("_key")))
    ok, rate_ok = F.col("recall") >= F.col("b_recall") - recall_band, F.col("false_positive_rate") <= F.col("b_rate") + rate_band
    return joined.select(key, ok.alias("recall_ok"), rate_ok.alias("rate_ok"), (ok & rate_ok).alias("within"))
