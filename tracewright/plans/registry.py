"""Every registered query of the library and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions.text import language_of, normalised, redacted
from tracewright.operators import evaluate, feedback, findings, policy, ranking, retrieve, verify
from tracewright.plans import code
from tracewright.plans import frames as fr
from tracewright.plans.frames import FILES, FINDINGS, LEARNINGS, LINES, MATCHES, POINTS, POLICY_SQL, RANKED, TARGETS

FLAGSHIP = "q03_pattern_findings"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def joined(column: str):
    return F.array_join(column, ",").alias(column)


@query("q01_doc_profile", f"with {TARGETS} select language, count(*) as files, sum(loc)::bigint as loc, sum(n_chars)::bigint as chars, sum(len(tags))::bigint as tags from targets group by language")
def doc_profile(spark, sf):
    t = fr.targets(spark, sf).join(fr.files(spark, sf).select("path", "n_chars"), "path")
    return t.groupBy("language").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), F.sum("n_chars").alias("chars"), F.sum(F.size("tags")).alias("tags"))


@query("q02_tag_matrix", f"with {TARGETS} select language, tag, count(*) as files from (select language, unnest(tags) as tag from targets) group by all")
def tag_matrix(spark, sf):
    return fr.targets(spark, sf).select("language", F.explode("tags").alias("tag")).groupBy("language", "tag").agg(F.count("*").alias("files"))


@query("q03_pattern_findings", f"with {MATCHES} select rule_id, path, line, token from matches")
def pattern_findings(spark, sf):
    return findings.find_matches(fr.files(spark, sf), fr.RULES).select("rule_id", "path", F.col("line").cast("long").alias("line"), "token")


@query("q04_findings_with_policy", FINDINGS + " select finding_id, rule_id, line, token, severity, reachability, function_name, conditions, round(priority, 2) as priority, array_to_string(tags, ',') as tags, status from findings")
def findings_with_policy(spark, sf):
    f = fr.findings(spark, sf)
    return f.select("finding_id", "rule_id", F.col("line").cast("long").alias("line"), "token", "severity", "reachability", "function_name", F.array_join("conditions", ",").alias("conditions"), F.round("priority", 2).alias("priority"), joined("tags"), "status")


_LEDGER = {"text-email": {"status": "shadow"}, "text-licence": {"status": "bogus", "precision_estimate": 0.4}, "text-dotted-quad": {"status": "enabled"}, "text-shouting": {"precision_estimate": 0.2}}


@query("q05_rule_overlay", f"""with {MATCHES}, o as (select *, case rule_id when 'text-email' then 'shadow' when 'text-dotted-quad' then 'enabled' else status end as now, case rule_id when 'text-licence' then 0.4 when 'text-shouting' then 0.2 else 0.0 end as precision from matches)
 select rule_id, now as status, count(*) as findings from o where precision >= 0.0 group by all""")
def rule_overlay(spark, sf):
    rules = findings.overlaid(fr.RULES, _LEDGER)
    return findings.find_matches(fr.files(spark, sf), rules, 0.0).groupBy("rule_id", "status").agg(F.count("*").alias("findings"))


@query("q06_rules_unresolved", f"with {MATCHES}, {POLICY_SQL} select rule_id, cwe, count(*) as findings from matches m where status = 'enabled' and not exists (select 1 from policy p where p.cwe = m.cwe) group by all")
def rules_unresolved(spark, sf):
    return policy.unresolved(findings.find_matches(fr.files(spark, sf), fr.RULES), fr.policy(spark)).groupBy("rule_id", "cwe").agg(F.count("*").alias("findings"))


@query("q07_entry_lines", f"with {LINES} select path, no as line, case when contains(body, 'icense') then 'legal' when contains(body, '@') then 'contact' else 'shout' end as kind, length(body) as size from lines where contains(body, 'icense') or contains(body, '@') or contains(body, '!!')")
def entry_lines(spark, sf):
    rows = fr.files(spark, sf).select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "body"))
    body = F.col("body")
    kind = F.when(body.contains("icense"), "legal").when(body.contains("@"), "contact").when(body.contains("!!"), "shout")
    return rows.select("path", (F.col("pos") + 1).cast("long").alias("line"), kind.alias("kind"), F.length("body").cast("long").alias("size")).where("kind is not null")


@query("q08_hint_attach", f"with {FILES}, {POINTS} select f.path, count(p.path) as hints, coalesce(max(p.line), 0) as last_line from files f left join points p using (path) group by f.path")
def hint_attach(spark, sf):
    t = findings.attach_hints(fr.files(spark, sf).select("path"), fr.entry_points(spark, sf))
    return t.select("path", F.size("hints").cast("long").alias("hints"), F.coalesce(F.array_max(F.transform("hints", lambda h: h["line"])), F.lit(0)).alias("last_line"))


@query("q09_reachability", FINDINGS + " select rule_id, reachability, coalesce(function_name, '') as function_name, conditions, count(*) as findings from findings group by all")
def reachability(spark, sf):
    f = fr.findings(spark, sf).withColumn("conditions", F.array_join("conditions", ",")).withColumn("function_name", F.coalesce("function_name", F.lit("")))
    return f.groupBy("rule_id", "reachability", "function_name", "conditions").agg(F.count("*").alias("findings"))


_RANKS = f"with {TARGETS}, {POINTS}, {RANKED}"


@query("q10_rank_priority", _RANKS + " select path, surface, influence, reachability, priority, array_to_string(boosts, ',') as boosts from rankings")
def rank_priority(spark, sf):
    return fr.rankings(spark, sf).select("path", "surface", "influence", "reachability", "priority", joined("boosts"))


@query("q11_rank_merge", _RANKS + """, m as (select r.path, greatest(surface, coalesce(case when l.toxic = 1 then 5 when l.doc_id is not null then 2 end, 0)) as surface, greatest(influence, coalesce(1 + l.quality, 0)) as influence, reachability,
 case when l.doc_id is null then boosts else list_sort(list_distinct(list_concat(boosts, ['model']))) end as boosts from rankings r left join labels l using (doc_id))
 select path, surface, influence, reachability, round(surface * 0.5 + influence * 0.2 + reachability * 0.3, 2) as priority, array_to_string(boosts, ',') as boosts from m""")
def rank_merge(spark, sf):
    lab = fr.table(spark, sf, "labels").join(fr.files(spark, sf).select("doc_id", "path"), "doc_id")
    other = lab.select("path", F.when(F.col("toxic") == 1, 5).otherwise(2).alias("surface"), (F.col("quality") + 1).alias("influence"), F.lit(1).alias("reachability"), F.array(F.lit("model")).alias("boosts"))
    return ranking.merge_rankings(fr.rankings(spark, sf), other).select("path", "surface", "influence", "reachability", "priority", joined("boosts"))


@query("q12_tier_schedule", _RANKS + """, t as (select path, priority, case when priority >= 3 then 'A' when priority >= 2 then 'B' else 'C' end as tier from rankings), p as (select *, cast(row_number() over (partition by tier order by priority desc, path) as integer) as place from t)
 select path, priority, tier, place from p where place <= case tier when 'A' then 20 when 'B' then 40 else 80 end""")
def tier_schedule(spark, sf):
    return ranking.schedule(fr.rankings(spark, sf), fr.files(spark, sf))


@query("q13_verify", FINDINGS + " select rule_id, verdict, verdict = 'accepted' as is_verified, count(*) as findings from verified group by all")
def verify_counts(spark, sf):
    return fr.verified_findings(spark, sf).groupBy("rule_id", "verdict", "is_verified").agg(F.count("*").alias("findings"))


_TRIGGERED = FINDINGS + """, fired as (select *, list_sort(list_filter([case when severity in ('critical', 'high') then 'severity:' || severity end, case when verdict = 'rejected' and reachability = 'reachable' then 'evidence_conflict' end,
 case when reachability = 'reachable' and severity in ('critical', 'high') then 'gates_risky_fix' end], lambda x: x is not null)) as triggers from verified)"""


@query("q14_fusion_triggers", _TRIGGERED + " select finding_id, token, array_to_string(triggers, ',') as triggers, len(triggers) > 0 as should_fuse from fired")
def fusion_triggers(spark, sf):
    return verify.fusion_triggers(fr.verified_findings(spark, sf)).select("finding_id", "token", joined("triggers"), "should_fuse")


@query("q15_fusion_votes", _TRIGGERED + """, d as (select *, verdict = 'accepted' as ok, reachability = 'reachable' as reached, severity in ('critical', 'high') as high from fired),
 p as (select case when verdict = 'rejected' and not reached then 'rejected' when ok and reached then 'accepted' when reached and high and not ok then 'blocked' else 'deferred' end as decision,
 case when reached and high and not ok then 'blocked' when reached then 'accepted' else 'deferred' end as a, case when verdict = 'rejected' or not reached then 'rejected' when ok then 'accepted' else 'deferred' end as b from d)
 select decision, disposition, count(*) as votes from (select decision, unnest([a, b]) as disposition from p) group by all""")
def fusion_votes(spark, sf):
    return verify.votes(verify.fused(verify.fusion_triggers(fr.verified_findings(spark, sf))))


@query("q16_learnings", LEARNINGS + " select * from learnings")
def learning_rows(spark, sf):
    return feedback.learnings(fr.judged_findings(spark, sf))


@query("q17_calibrate", LEARNINGS + """, sums as (select r.path, count(*) * 0.5 as demotion, count(*) as n from rankings r join learnings l on r.path = l.path or starts_with(r.path, regexp_replace(l.scope, ':[^:]*$', '') || '/') group by r.path)
 select path, priority, coalesce(demotion, 0.0)::double as demotion, greatest(0.1, least(priority, round(priority - coalesce(demotion, 0), 2)))::double as calibrated, coalesce(n, 0) as learnings from rankings left join sums using (path)""")
def calibrate(spark, sf):
    from tracewright.sources.scratch import stored

    # Both are read several times; without this each time would scan the texts.
    ranks = stored(fr.rankings(spark, sf).select("path", "priority"), "rankings")
    ledger = stored(feedback.learnings(fr.judged_findings(spark, sf)), "learnings")
    return feedback.calibrated(ranks, ledger).select("path", "priority", "demotion", "calibrated", "learnings")


@query("q18_fp_override", LEARNINGS + """ select distinct finding_id, round(case reachability when 'reachable' then 1.0 when 'inferred-file-surface' then 0.6 else 0.4 end * 0.4, 3)::double as factor from findings f
 where exists (select 1 from learnings l where l.vulnerability_class = coalesce(f.tags[1], 'unknown') and (f.path = l.path or starts_with(f.path, regexp_replace(l.scope, ':[^:]*$', '') || '/')))""")
def fp_override(spark, sf):
    return feedback.reachability_overrides(fr.findings(spark, sf), feedback.learnings(fr.judged_findings(spark, sf)))


_SCORED = FINDINGS + """, scored as (select *, regexp_extract(path, '^(.*)/[^/]*$', 1) as source, case when static then p_severity else 0 end as level,
 (case when static then case p_severity when 5 then 50.0 when 4 then 25.0 when 3 then 10.0 when 2 then 2.0 when 1 then 1.0 else 0.0 end else 0.0 end * case reachability when 'reachable' then 1.0 when 'inferred-file-surface' then 0.6 else 0.4 end)::double as penalty from findings where status <> 'shadow'),
 scores as (select source, count(*) as findings, round(sum(penalty), 4) as penalty_total, max(level) as max_severity, cast(round(100 * exp(-sum(penalty) / 60)) as integer) as score,
 count(*) filter (where p_severity is not null and not static and dynamic) as dynamic_only, coalesce(string_agg(distinct coalesce(nullif(cwe, ''), 'unknown'), ',' order by coalesce(nullif(cwe, ''), 'unknown')) filter (where p_severity is null), '') as unmapped from scored group by source),
 gated as (select source, coalesce(max(level) filter (where reachability = 'reachable'), 0) as severity from scored group by source)"""


def _scores(spark, sf):
    f = findings.reported(fr.findings(spark, sf)).withColumn("source", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    return policy.project_score(policy.with_penalty(f, fr.policy(spark)), ("source",))


@query("q19_project_score", _SCORED + " select * from scores")
def project_score(spark, sf):
    return _scores(spark, sf).select("source", "findings", F.round("penalty_total", 4).alias("penalty_total"), "max_severity", "score", "dynamic_only", joined("unmapped"))


@query("q20_score_gate", _SCORED + " select source, blocking, score, severity >= 5 as hard_failure, not (severity >= 5 or (blocking and score < 80)) as passed from scores join gated using (source), (values (true), (false)) b(blocking)")
def score_gate(spark, sf):
    """Gates in both modes."""
    scores = _scores(spark, sf)
    modes = [policy.score_gate(scores, blocking=b).withColumn("blocking", F.lit(b)) for b in (True, False)]
    return modes[0].unionByName(modes[1]).select("source", "blocking", "score", "hard_failure", "passed")


_SCALE = """select n_name, count(*) as items, round(sum(w * m) / 1000, 3) as penalty, cast(round(100 * exp(-sum(w * m) / 1000 / 60)) as integer) as score from
 (select n_name, case left(o_orderpriority, 1) when '1' then 50.0 when '2' then 25.0 when '3' then 10.0 when '4' then 2.0 else 0.0 end as w, case l_linestatus when 'O' then 1.0 else 0.4 end as m
 from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey) group by n_name"""


@query("q21_score_scale", _SCALE)
def score_scale(spark, sf):
    t = lambda n: fr.table(spark, sf, n)
    first = F.substring("o_orderpriority", 1, 1)
    w = F.when(first == "1", 50.0).when(first == "2", 25.0).when(first == "3", 10.0).when(first == "4", 2.0).otherwise(0.0)
    m = F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.4)
    owners = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderpriority", "c_nationkey")
    # Lines are summed per nation key before the name is looked up.
    sums = t("lineitem").join(owners, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("c_nationkey").agg(F.count("*").alias("items"), (F.sum(w * m) / 1000).alias("total"))
    named = sums.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select("n_name", "items", F.round("total", 3).alias("penalty"), policy.decayed_score(F.col("total")).alias("score"))


_LABELLED = f"with {MATCHES}, hit as (select distinct path from matches where status = 'enabled'), l as (select f.path, f.language, q.quality, h.path is not null as flagged from labels q join files f on f.doc_id = q.doc_id left join hit h on h.path = f.path)"


def _labelled(spark, sf):
    f = fr.files(spark, sf)
    hit = findings.find_matches(f, fr.RULES).where("status = 'enabled'").select("path", F.lit(True).alias("hit")).distinct()
    rows = fr.table(spark, sf, "labels").join(f.select("doc_id", "path", "language"), "doc_id").join(hit, "path", "left")
    return rows.select("path", "language", "quality", F.coalesce("hit", F.lit(False)).alias("flagged"))


_PAIRS = """with p as (select item_id, doc_id from benchmark b join documents d on contains(d.text, b.text))"""


def _contained(spark, sf):
    return evaluate.contained_items(fr.table(spark, sf, "documents").select("doc_id", "text"), fr.table(spark, sf, "benchmark").select("item_id", "text"))


@query("q22_contained_items", _PAIRS + " select item_id, doc_id from p")
def contained_items(spark, sf):
    return _contained(spark, sf)


_MANIFEST_PAIRS = _PAIRS.replace("with p as", "with recursive c as") + """, pairs as (select source || '/' || (c.doc_id // 100) as key, item_id as e_ord, c.doc_id as f_ord from c join documents d on d.doc_id = c.doc_id), """


@query("q23_greedy_match", _MANIFEST_PAIRS + code.sequence() + " select * from matches")
def greedy_match(spark, sf):
    """Manifests are a source's documents by hundreds, so their number grows with the table."""
    source = fr.table(spark, sf, "documents").select("doc_id", "source")
    pairs = _contained(spark, sf).join(source, "doc_id").select(F.concat_ws("/", "source", F.expr("doc_id div 100").cast("string")).alias("key"), F.col("item_id").alias("e_ord"), F.col("doc_id").alias("f_ord"))
    return evaluate.one_to_one(pairs)


@query("q24_misses_and_fps", _PAIRS + """ select 'missed' as signal, item_id as id from benchmark b where not exists (select 1 from p where p.item_id = b.item_id)
 union all select 'false_positive', doc_id from documents d where contains(text, 'icense') and not exists (select 1 from p where p.doc_id = d.doc_id)""")
def misses_and_fps(spark, sf):
    pairs = _contained(spark, sf)
    missed = fr.table(spark, sf, "benchmark").join(pairs, "item_id", "left_anti").select(F.lit("missed").alias("signal"), F.col("item_id").alias("id"))
    wrong = fr.table(spark, sf, "documents").where(F.col("text").contains("icense")).join(pairs, "doc_id", "left_anti").select(F.lit("false_positive").alias("signal"), F.col("doc_id").alias("id"))
    return missed.unionByName(wrong)


@query("q25_per_rule_metrics", f"""with {MATCHES}, k as (select m.rule_id, case when l.toxic = 1 then 'matched' when l.doc_id is not null then 'false_positive' else 'missed' end as kind from matches m join files f using (path) left join labels l on l.doc_id = f.doc_id),
 c as (select rule_id, count(*) filter (where kind = 'matched') as matched, count(*) filter (where kind = 'false_positive') as false_positives, count(*) filter (where kind = 'missed') as missed from k group by rule_id)
 select *, case when false_positives > 0 then 'shadow' when missed > 0 then 'loosen' else 'keep' end as recommendation from c""")
def per_rule_metrics(spark, sf):
    f = fr.files(spark, sf)
    rows = findings.find_matches(f, fr.RULES).join(f.select("path", "doc_id"), "path").join(fr.table(spark, sf, "labels"), "doc_id", "left")
    return evaluate.rule_metrics(rows.select("rule_id", F.when(F.col("toxic") == 1, "matched").when(F.col("toxic").isNotNull(), "false_positive").otherwise("missed").alias("kind"))).drop("rationale")


@query("q26_detection_rollup", _LABELLED + """, c as (select language, sum((quality = 0)::int) as expected, sum((quality = 0 and flagged)::int) as matched, sum(flagged::int) as actual, sum((flagged and quality = 1)::int) as false_positives from l group by rollup (language)),
 r as (select *, language is null as overall, round(case when expected > 0 then matched / expected else 1.0 end, 6)::double as recall, round(case when actual > 0 then false_positives / actual else 0.0 end, 6)::double as false_positive_rate from c)
 select language, expected::bigint as expected, matched::bigint as matched, actual::bigint as actual, false_positives::bigint as false_positives, overall, recall, false_positive_rate, recall >= 0.9 and false_positive_rate < 0.1 as passed from r""")
def detection_rollup(spark, sf):
    bad, flag = F.col("quality") == 0, F.col("flagged")
    one = lambda c: c.cast("long")
    counts = _labelled(spark, sf).select("language", one(bad).alias("expected"), one(bad & flag).alias("matched"), one(flag).alias("actual"), one(flag & ~bad).alias("false_positives"))
    return evaluate.detection_gate(evaluate.detection_rollup(counts, "language"))


_BASELINES = f"""with recursive {code.CODE}, raw as (select key as manifest, 'alpha' as tool, f_ord, path, line, rule_id, cwe, token from found where doc_id % 2 = 0 union all select key, 'beta', f_ord, path, line, null, null, token from found where doc_id % 3 = 0
 union all select key, 'gamma', f_ord, path, null, rule_id, case when line % 2 = 0 then lower(cwe) else 'CWE-0' end, token from found where doc_id % 5 = 0),
 tools as (select *, {code.norm("token || ' matched'")} as text from raw),
 tool_pairs as (select t.manifest || '|' || t.tool as key, e_ord, f_ord from expected e join tools t on e.key = t.manifest and (e.rule_id is null or t.rule_id is null or e.rule_id = t.rule_id) and (e.line is null or t.line is null or e.line = t.line)
  and contains(t.path, e.path) and (t.cwe is null or lower(t.cwe) = lower(e.cwe)) and (e.sink is null or contains(t.text, lower(e.sink)))), """


@query("q27_baseline_deltas", _BASELINES + code.sequence("tool_pairs") + """, n as (select key, count(*) as matched from matches group by key), w as (select key, count(*) as expected from expected group by key), z as (select manifest, tool, count(*) as found from tools group by all)
 select manifest, tool, coalesce(matched, 0) as matched, coalesce(expected, 0) - coalesce(matched, 0) as missed, found - coalesce(matched, 0) as extra from z left join n on n.key = manifest || '|' || tool left join w on w.key = manifest""")
def baseline_deltas(spark, sf):
    return evaluate.baseline_deltas(code.code_expected(spark, sf), code.code_baselines(spark, sf))


_OUTCOMES = "with e as (select case user_id % 3 when 0 then 'A' when 1 then 'B' else 'C' end as tier, event_type as outcome, value as seconds from events)"


def _outcomes(spark, sf):
    tier = F.when(F.col("user_id") % 3 == 0, "A").when(F.col("user_id") % 3 == 1, "B").otherwise("C")
    return fr.table(spark, sf, "events").select(tier.alias("tier"), F.col("event_type").alias("outcome"), F.col("value").alias("seconds"))


@query("q28_outcome_metrics", _OUTCOMES + " select tier, count(*) as outcomes, count(*) filter (where outcome = 'purchase') as accepted, count(*) filter (where outcome = 'error') as rejected, coalesce(round(avg(seconds), 2), 0.0) as mean_seconds, coalesce(round(sum(seconds), 2), 0.0) as total_seconds from e group by tier")
def outcome_metrics(spark, sf):
    return feedback.outcome_metrics(_outcomes(spark, sf), "purchase", "error")


@query("q29_reason_histogram", _OUTCOMES + " select tier, " + ", ".join(f"count(*) filter (where outcome = '{o}') as {o}" for o in ("click", "error", "purchase", "signup", "view")) + " from e group by tier")
def reason_histogram(spark, sf):
    kinds = ["click", "error", "purchase", "signup", "view"]
    return _outcomes(spark, sf).groupBy("tier").pivot("outcome", kinds).count().na.fill(0, kinds)


@query("q30_ledger_latest", "select user_id, event_type, event_id, round(value, 4) as value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1")
def ledger_latest(spark, sf):
    rows = fr.table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return feedback.latest_per_key(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", F.round("value", 4).alias("value"))


_LEVELS = "case event_type when 'view' then 0 when 'click' then 1 when 'signup' then 2 when 'purchase' then 3 else 4 end"


@query("q31_state_transitions", f"""with e as (select user_id, {_LEVELS} as level, lag({_LEVELS}) over (partition by user_id order by ts, event_id) as previous from events)
 select level, previous, previous is null or level - previous between 0 and 1 as allowed, count(*) as steps from e group by all""")
def state_transitions(spark, sf):
    level = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "purchase", 3).otherwise(4)
    rows = fr.table(spark, sf, "events").select("user_id", F.struct("ts", "event_id").alias("at"), level.alias("level"))
    return verify.transitions(rows, "user_id", "at", "level").groupBy("level", "previous", "allowed").agg(F.count("*").alias("steps"))


@query("q32_chunks", f"""with {FILES}, c as (select path, string_split(text, chr(10)) as l from files), s as (select path, l, unnest(range(0, len(l), 5)) as i from c),
 t as (select path, i + 1 as start_line, least(i + 5, len(l)) as end_line, array_to_string(l[i + 1 : i + 5], chr(10)) as text from s)
 select path, start_line, end_line, length(text) as size, path || ':' || start_line || '-' || end_line || ':' || left(sha256(path || ':' || start_line || ':' || end_line || ':' || text), 16) as chunk_id from t where regexp_matches(text, '\\S')""")
def chunk_rows(spark, sf):
    c = retrieve.chunks(fr.files(spark, sf), 5)
    return c.select("path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.length("text").cast("long").alias("size"), "chunk_id")


_COSINE = "list_cosine_similarity(list_transform(e.embedding, lambda x: x::double), list_transform(q.embedding, lambda x: x::double))"


def _first_vector(spark, sf, on: str):
    """The vector of the smallest id as a query, with a constant column by which the others meet it."""
    return fr.table(spark, sf, "embeddings").orderBy("vec_id").limit(1).select(F.lit(0).alias("query_id"), F.col("embedding").alias("q_embedding"), F.lit(0).alias(on))


@query("q33_cosine_topk", f"with q as (select embedding from embeddings order by vec_id limit 1) select vec_id, round({_COSINE}, 6) as score from embeddings e, q where label % 2 = 0 order by score desc, vec_id limit 10")
def cosine_topk(spark, sf):
    vectors = fr.table(spark, sf, "embeddings").withColumn("parity", F.col("label") % 2)
    return retrieve.top_for_queries(vectors, _first_vector(spark, sf, "parity"), 10, ("parity",)).select("vec_id", "score")


@query("q34_retrieval_budget", f"""with q as (select embedding from embeddings order by vec_id limit 1), s as (select vec_id, label, round({_COSINE}, 6) as score from embeddings e, q), b as (select label, vec_id, score, length(d.text) as size from s join documents d on d.doc_id = s.vec_id),
 r as (select *, sum(size) over (partition by label order by score desc, vec_id rows unbounded preceding) as running from b) select label, vec_id, score, running::bigint as running from r where running <= 6000""")
def retrieval_budget(spark, sf):
    from tracewright.functions.vectors import cosine

    met = fr.table(spark, sf, "embeddings").withColumn("all", F.lit(0)).join(F.broadcast(_first_vector(spark, sf, "all")), "all")  # one row
    scored = met.select("vec_id", "label", F.round(cosine(F.col("embedding"), F.col("q_embedding")), 6).alias("score"))
    blocks = scored.join(fr.table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.length("text").cast("long").alias("size")), "vec_id")
    return retrieve.within_budget(blocks, 6000, F.col("size"), [F.desc("score"), F.col("vec_id")], ("label",)).select("label", "vec_id", "score", "running")


_SKILLS = [("s-auth", "en", ["auth_boundary"], ["access"]), ("s-crypto", None, ["crypto"], ["weak-crypto"]), ("s-files", "de", ["filesystem_entry"], ["traversal"]), ("s-net", "fr", ["network_entry"], ["ssrf"]), ("s-parse", None, ["parser", "deserialization"], ["injection"]), ("s-shell", "es", ["syscall_entry"], ["injection"])]
_CLASSES = {"auth_boundary": "access", "crypto": "weak-crypto", "filesystem_entry": "traversal", "network_entry": "ssrf", "parser": "injection", "syscall_entry": "injection"}


@query("q35_skill_routing", f"""with {TARGETS}, t as (select path, language, tags, list_distinct(list_filter(list_transform(tags, lambda x: case x {" ".join(f"when '{k}' then '{v}'" for k, v in _CLASSES.items())} end), lambda x: x is not null)) as classes from targets),
 s(skill_id, language, tags, classes) as (values {", ".join(f"('{i}', {repr(l) if l else 'null'}, {t}, {c})" for i, l, t, c in _SKILLS)}),
 m as (select path, skill_id, len(list_intersect(t.tags, s.tags)) + 2 * len(list_intersect(t.classes, s.classes)) as signals, t.language = s.language as same from t, s),
 r as (select path, skill_id, signals + case when same then 3 else 0 end as score from m where signals > 0), p as (select *, cast(row_number() over (partition by path order by score desc, skill_id) as integer) as place from r) select * from p where place <= 4""")
def skill_routing(spark, sf):
    return retrieve.routed(retrieve.with_classes(fr.targets(spark, sf), _CLASSES), spark.createDataFrame(_SKILLS, "skill_id string, language string, tags array<string>, classes array<string>"))


_R = "***REDACTED***"
_REDACT_SQL = "text"
for _pattern, _with in ((r"(Bearer\s+)[A-Za-z0-9._\-]{12,}", r"\1" + _R), (r"\bsk-[A-Za-z0-9._\-]{16,}", _R), (r"\bAKIA[0-9A-Z]{16}\b", _R), (r"\bgh[pousr]_[A-Za-z0-9]{20,}", _R), (r"\bxox[baprs]-[A-Za-z0-9-]{10,}", _R), (r"\bAIza[A-Za-z0-9_\-]{20,}", _R), (r"([a-zA-Z][a-zA-Z0-9+.\-]*://[^\s:/@]+:)[^\s:/@]{3,}(@)", r"\1" + _R + r"\2"),
                        *((rf"(?i)\b(api[_-]?key|secret|token|password|passwd|pwd|access[_-]?key)\b(\s*[=:]\s*){q}[A-Za-z0-9/+_\-]{{8,}}{q}", rf"\1\2{q}{_R}{q}") for q in ('"', "''", ""))):
    _REDACT_SQL = f"regexp_replace({_REDACT_SQL}, '{_pattern}', '{_with}', 'g')"


@query("q36_redact", f"select doc_id, md5(r) as digest, r <> text as changed from (select doc_id, text, {_REDACT_SQL} as r from documents)")
def redact(spark, sf):
    d = fr.table(spark, sf, "documents").select("doc_id", "text", redacted(F.col("text")).alias("r"))
    return d.select("doc_id", F.md5("r").alias("digest"), (F.col("r") != F.col("text")).alias("changed"))


@query("q37_normalised_words", r"""with n as (select item_id, trim(regexp_replace(translate(replace(replace(lower(text), 'memcpy', 'memcpy memory copy'), 'copies', 'copy'), '-_', '  '), '\s+', ' ', 'g')) as body from benchmark),
 w as (select item_id, list_filter(string_split(body, ' '), lambda x: length(x) > 2) as words from n) select item_id, len(words) as words, len(list_distinct(words)) as different from w""")
def normalised_words(spark, sf):
    w = fr.table(spark, sf, "benchmark").select("item_id", evaluate.evidence_words(normalised(F.col("text"))).alias("words"))
    return w.select("item_id", F.size("words").cast("long").alias("words"), F.size(F.array_distinct("words")).cast("long").alias("different"))


@query("q38_json_extract", "select k, count(*) as events, round(sum(value), 4) as value from (select cast(json_extract_string(props, '$.k') as integer) as k, value from events) group by k")
def json_extract(spark, sf):
    rows = fr.table(spark, sf, "events").select(F.from_json("props", "k int")["k"].alias("k"), "value")
    return rows.groupBy("k").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"))


@query("q39_sarif_rows", FINDINGS + """ select rule_id as "ruleId", case severity when 'critical' then 'error' when 'high' then 'error' when 'medium' then 'warning' else 'note' end as level, path as uri, line as "startLine", count(*) as results from findings where status <> 'shadow' group by all""")
def sarif_rows(spark, sf):
    from tracewright.sources.sarif import sarif_results

    rows = sarif_results(findings.reported(fr.findings(spark, sf)))
    place = F.col("locations")[0]["physicalLocation"]
    return rows.groupBy("ruleId", "level", place["artifactLocation"]["uri"].alias("uri"), place["region"]["startLine"].cast("long").alias("startLine")).agg(F.count("*").alias("results"))


@query("q40_tumbling_window", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as events, round(sum(value), 4) as value from events group by all")
def tumbling_window(spark, sf):
    w = fr.table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return w.select(F.col("w.start").alias("start"), "event_type", "events", "value")


@query("q41_sliding_window", "select time_bucket(interval '30 minutes', ts) - o * interval '30 minutes' as start, count(*) as events from events, (values (0), (1)) v(o) group by all")
def sliding_window(spark, sf):
    return fr.table(spark, sf, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), "events")


@query("q42_session_window", """with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as fresh from events), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as no from e)
 select user_id, min(ts) as start, count(*) as events from s group by user_id, no""")
def session_window(spark, sf):
    return fr.table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), "events")


@query("q45_star_join_topk", """select c_custkey, n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey
 group by all order by revenue desc, c_custkey limit 20""")
def star_join_topk(spark, sf):
    t = lambda n: fr.table(spark, sf, n)
    lines = t("lineitem").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    sums = lines.groupBy("o_custkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    named = sums.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.select("c_custkey", "n_name", "r_name", "revenue").orderBy(F.desc("revenue"), "c_custkey").limit(20)


@query("q46_set_ops", """(select 'both' as side, k from (select c_nationkey as k from customer where c_acctbal > 5000 intersect select s_nationkey from supplier)) union all (select 'customers', k from (select c_nationkey as k from customer where c_acctbal > 5000 except select s_nationkey from supplier where s_acctbal > 5000))
 union all (select 'any', k from (select c_nationkey as k from customer union select s_nationkey from supplier))""")
def set_ops(spark, sf):
    c, s = fr.table(spark, sf, "customer"), fr.table(spark, sf, "supplier")
    rich, held = c.where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k")), s.select(F.col("s_nationkey").alias("k"))
    named = lambda df, side: df.select(F.lit(side).alias("side"), "k")
    any_ = c.select(F.col("c_nationkey").alias("k")).union(held).distinct()
    return named(rich.intersect(held), "both").union(named(rich.subtract(s.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))), "customers")).union(named(any_, "any"))


@query("q47_semi_anti", """select c_mktsegment, exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000) as large, count(*) as customers, round(sum(c_acctbal), 2) as balance from customer group by all""")
def semi_anti(spark, sf):
    c = fr.table(spark, sf, "customer")
    big = fr.table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    both = c.join(big, "c_custkey", "left_semi").withColumn("large", F.lit(True)).unionByName(c.join(big, "c_custkey", "left_anti").withColumn("large", F.lit(False)))
    return both.groupBy("c_mktsegment", "large").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("q48_trajectories", """with t as (select conv_id, turn, role, length(text) as size, lag(role) over (partition by conv_id order by turn, role, text) as previous from conversations)
 select conv_id, count(*) as turns, sum(size)::bigint as chars, count(*) filter (where role = previous) as repeats, count(distinct role) as roles from t group by conv_id""")
def trajectories(spark, sf):
    previous = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    t = fr.table(spark, sf, "conversations").select("conv_id", "role", F.length("text").alias("size"), previous.alias("previous"))
    return t.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum("size").alias("chars"), F.count_if(F.col("role") == F.col("previous")).alias("repeats"), F.count_distinct("role").alias("roles"))


@query("q49_page_languages", "select 'unknown' as language, count(*) as pages, sum((html is not null)::int)::bigint as stored from pages where not regexp_matches(lower(url), '[^/]\\.(py|js|go|java)$')")
def page_languages(spark, sf):
    p = fr.table(spark, sf, "pages").select(language_of(F.regexp_replace("url", r"[?#].*$", ""), F.col("html")).alias("language"), "html")
    return p.groupBy("language").agg(F.count("*").alias("pages"), F.count("html").alias("stored"))


@query("q43_late_data", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as events from events group by all")
def late_data(spark, sf):
    """Every window with all its events: late ones add to theirs, and the last windows count too."""
    from tracewright.streaming.events import all_windowed_counts, read_events

    return all_windowed_counts(read_events(spark, f"{sf}/events.parquet"))


@query("q44_stream_dedupe", "select distinct event_id, user_id, event_type from events")
def stream_dedupe(spark, sf):
    from tracewright.streaming.events import deduplicated, drained, read_events

    return drained(deduplicated(read_events(spark, f"{sf}/events.parquet"), ["event_id"]).select("event_id", "user_id", "event_type"))


_SEVERITIES = "severities(cwe, severity) as (values " + ", ".join(f"('{c}', '{v}')" for c, v in sorted(code.SEVERITIES.items())) + ")"


@query("q50_rule_scan", f"with {code.CODE}, {_SEVERITIES} select rule_id, path, line, token, severity from found join severities using (cwe)")
def rule_scan(spark, sf):
    from tracewright.rules import shipped_policy

    table = F.broadcast(shipped_policy(spark).where("static").select("cwe", findings.severity_label(F.col("severity")).alias("severity")))  # a fixed list of weaknesses
    return code.code_findings(spark, sf).join(table, "cwe", "left").select("rule_id", "path", "line", "token", F.coalesce("severity", F.lit("info")).alias("severity"))


def _evaluated(spark, sf):
    from tracewright.sources.scratch import stored

    return evaluate.evaluate_manifests(code.code_expected(spark, sf), stored(code.code_findings(spark, sf), "findings"))


_METRICS = """, sizes as (select key, 1 as e, 0 as a, 0 as m from expected union all select key, 0, 1, 0 from found union all select key, 0, 0, 1 from matches),
 metrics as (select key, sum(e)::bigint as expected, sum(a)::bigint as actual, sum(m)::bigint as matched, (sum(e) - sum(m))::bigint as missed, (sum(a) - sum(m))::bigint as false_positives from sizes group by key)"""


@query("q51_manifest_metrics", code.EVALUATED + _METRICS + " select *, round(matched / nullif(expected, 0), 9) as recall, round(matched / nullif(actual, 0), 9) as precision from metrics")
def manifest_metrics(spark, sf):
    return _evaluated(spark, sf).metrics.withColumns({c: F.round(c, 9) for c in ("recall", "precision")})


_RULE_KINDS = """, kinds as (select f.key, f.rule_id, case when m.f_ord is null then 'false_positive' else 'matched' end as kind from found f left join matches m on m.key = f.key and m.f_ord = f.f_ord
 union all select e.key, e.rule_id, 'missed' from expected e left join matches m on m.key = e.key and m.e_ord = e.e_ord where m.e_ord is null and e.rule_id is not null),
 counts as (select key, rule_id, count(*) filter (where kind = 'matched') as matched, count(*) filter (where kind = 'false_positive') as false_positives, count(*) filter (where kind = 'missed') as missed from kinds group by key, rule_id)"""


@query("q52_manifest_rules", code.EVALUATED + _RULE_KINDS + f""" select *, case when false_positives > 0 then 'shadow' when missed > 0 then 'loosen' else 'keep' end as recommendation,
 case when false_positives > 0 then {code._QUOTED(evaluate.ACTIONS[0][1])} when missed > 0 then {code._QUOTED(evaluate.ACTIONS[1][1])} else {code._QUOTED(evaluate.ACTIONS[2][1])} end as rationale from counts""")
def manifest_rules(spark, sf):
    return _evaluated(spark, sf).rules


@query("q53_manifest_misses", code.EVALUATED + f""" select key, 'missed' as kind, e.path || ':' || e_ord as id, case when rule_id is null then 'language_hunter' else 'rule:' || rule_id end as candidate, '{evaluate.MISS_REASON}' as reason from expected e where not exists (select 1 from matches m where m.key = e.key and m.e_ord = e.e_ord)
 union all select key, 'false_positive', finding_id, rule_id, '{evaluate.FALSE_POSITIVE_REASON}' from found f where not exists (select 1 from matches m where m.key = f.key and m.f_ord = f.f_ord)""")
def manifest_misses(spark, sf):
    e = _evaluated(spark, sf)
    plain = F.regexp_replace("path", r"^\*", "")
    missed = e.calibration.select("key", F.lit("missed").alias("kind"), F.concat_ws(":", plain, F.col("e_ord").cast("string")).alias("id"), F.col("next_improvement_candidate").alias("candidate"), "reason")
    return missed.unionByName(e.false_positives.select("key", F.lit("false_positive").alias("kind"), F.col("finding_id").alias("id"), F.col("rule_id").alias("candidate"), "reason"))


_LANGUAGE_RATES = """, sizes as (select language, 1 as e, 0 as a, 0 as m from expected union all select d.language, 0, 1, 0 from found f join docs d using (doc_id) union all select d.language, 0, 0, 1 from matches m join docs d on d.doc_id = m.e_ord // 100),
 rates as (select language, sum(e) as expected, sum(m) as matched, sum(a) as actual, sum(a) - sum(m) as false_positives, language is null as overall from sizes group by rollup (language)),
 said as (select coalesce(language, 'overall') as name, overall, unnest([case when matched / expected < 0.9 then printf('%s recall %.2f%% below 90%% (%d/%d)', coalesce(language, 'overall'), 100 * matched / expected, matched::bigint, expected::bigint) end,
  case when false_positives / actual >= 0.1 then printf('%s FP rate %.2f%% at or above 10%% (%d/%d)', coalesce(language, 'overall'), 100 * false_positives / actual, false_positives::bigint, actual::bigint) end]) as reason, unnest([1, 2]) as no from rates)"""


@query("q54_gate_verdict", code.EVALUATED + _LANGUAGE_RATES + " select count(reason) = 0 as passed, count(reason) = 0 as detection_passed, true as score_passed, string_agg(reason, '; ' order by overall, name, no) as reasons from said")
def gate_verdict(spark, sf):
    e = _evaluated(spark, sf)
    language = code._docs(spark, sf).select("doc_id", "language")
    kinds = code.code_expected(spark, sf).select("language", F.lit("expected").alias("kind")).unionByName(code.code_findings(spark, sf).select("language", F.lit("actual").alias("kind")))
    kinds = kinds.unionByName(e.matches.select(F.expr("e_ord div 100").alias("doc_id")).join(language, "doc_id").select("language", F.lit("matched").alias("kind")))
    one = lambda k: (F.col("kind") == k).cast("long")
    counts = kinds.groupBy("language").agg(*[F.sum(one(k)).alias(k) for k in ("expected", "matched", "actual")]).withColumn("false_positives", F.col("actual") - F.col("matched"))
    return evaluate.gate_verdict(evaluate.detection_rollup(counts, "language"), "language").withColumn("reasons", F.array_join("reasons", "; "))


@query("q55_entry_points", """with d as (select source || '/' || doc_id || '.py' as path, 'v' || (doc_id % 97) as v, doc_id % 3 as g from documents)
 select path, 6 as line, 13 as end_line, v as name, 'route' as kind, ['authenticated', 'role-restricted', 'public'][g + 1] as access_level, 'http_request' as trust_boundary, case g when 0 then 'login_required' when 1 then 'require_role(''admin'')' else 'app.route(''/' || v || ''', methods=[''GET''])' end as evidence, 'feature_' || v || '(a)' as conditions from d
 union all select path, 16, 19, 'run_' || v, 'cli', 'local-only', 'process_invocation', 'cli.command()', 'self.beta and self.x' from d""")
def entry_point_rows(spark, sf):
    from tracewright.operators.entrypoints import entry_points

    e = entry_points(code.route_files(spark, sf))
    return e.select("path", "line", "end_line", "name", "kind", "access_level", "trust_boundary", F.array_join("access_evidence", ";").alias("evidence"), F.array_join("conditions", ";").alias("conditions"))


@query("q56_findings_in_text", r"""with d as (select doc_id::varchar as path, coalesce(text, '') || ' so: [ {"line": ' || doc_id || ', "title": "T' || doc_id || '", "cwe": "CWE-' || (doc_id % 7) || '"}, 5, ' || case when doc_id % 4 = 0 then 'oops' else '' end || ' {"line": "x", "rationale": "r"} ] done' as text from documents),
 x as (select path, regexp_extract(text, '(?s)\[\s*\{.*\}\s*\]') as j from d), v as (select path, cast(j as json) as j from x where json_valid(j)),
 e as (select path, unnest(cast(j as json[])) as o, unnest(range(0, json_array_length(j)::bigint)) as item from v)
 select path, item::int as item, case when json_type(o, '$.line') in ('UBIGINT', 'BIGINT') then (o->>'line')::int end as line, coalesce(o->>'title', 'model finding') as title, o->>'cwe' as cwe, coalesce(o->>'rationale', 'Reported by the model; manual verification required.') as rationale from e where json_type(o) = 'OBJECT'""")
def findings_in_text(spark, sf):
    from tracewright.operators.model_output import findings_in_text

    return findings_in_text(code.model_texts(spark, sf))


@query("q57_ranking_rows", """with d as (select doc_id, doc_id % 7 as surface, doc_id % 13 <> 0 as listed, doc_id % 2 = 1 as two from documents),
 r as (select doc_id as payload_id, 0 as item, 'p' || doc_id as path, case when surface not between 1 and 5 then 'ranking item for p' || doc_id || ' requires integer surface from 1 to 5' when doc_id % 11 = 0 then 'ranking item for p' || doc_id || ' requires integer influence from 1 to 5' end as reason, surface from d where listed)
 select payload_id, path, round(surface * 0.5 + 3 * 0.2 + 2 * 0.3, 2)::double as priority, 'a,b' as boosts, null::int as item, null as reason from r where reason is null
 union all select payload_id, null, null, null, item, reason from r where reason is not null
 union all select doc_id, null, null, null, null, 'ranker response must be a list or object with rankings list' from d where not listed
 union all select doc_id, null, null, null, 1, 'ranking item requires non-empty path' from d where listed and two""")
def ranking_rows(spark, sf):
    from tracewright.operators.model_output import ranking_rows

    good, refused = ranking_rows(code.ranking_payloads(spark, sf))
    none = lambda kind: F.lit(None).cast(kind)
    return good.select("payload_id", "path", "priority", joined("boosts"), none("int").alias("item"), none("string").alias("reason")).unionByName(refused.select("payload_id", none("string").alias("path"), none("double").alias("priority"), none("string").alias("boosts"), "item", "reason"))


_RULE_STATES = "states(no, rule_id, ledger, reverted) as (values " + ", ".join(f"({i}, {code._QUOTED(r.rule_id)}, {repr('shadow') if i % 5 == 0 else 'null'}, {str(i % 7 == 0 and i % 11 != 0).lower()})" for i, r in enumerate(code.shipped_rules())) + ")"


@query("q58_rule_ledger", code.EVALUATED + _RULE_KINDS + f""", {_RULE_STATES}, wrong as (select rule_id, sum(false_positives) as n from counts group by rule_id having sum(false_positives) > 0),
 edits as (select s.rule_id from states s join wrong w using (rule_id) where s.ledger is null and not s.reverted)
 select rule_id, case when e.rule_id is not null then 'shadow' else ledger end as status, case when ledger is not null then 0.5::double end as precision_estimate from states s left join edits e using (rule_id) where ledger is not null or e.rule_id is not null""")
def rule_ledger(spark, sf):
    """From the metrics of all manifests to the next ledger of rules: a fifth of the rules is staged, some edits were reverted before."""
    from tracewright.operators import lifecycle
    from tracewright.rules import shipped_policy
    from tracewright.sources.files import JOURNAL

    rules = code.shipped_rules()
    table = spark.createDataFrame([(r.rule_id, r.status, r.cwe) for r in rules], "rule_id string, status string, cwe string")
    ledger = spark.createDataFrame([(r.rule_id, "shadow", 0.5) for i, r in enumerate(rules) if i % 5 == 0], "rule_id string, status string, precision_estimate double")
    undone = [(f"rule:{r.rule_id}:enabled->shadow", "rule", r.rule_id, "enabled", "shadow", "" if i % 11 else "seen again") for i, r in enumerate(rules) if i % 7 == 0]
    journal = spark.createDataFrame([(1, "reverted", "reverted", undone, *[None] * 6)], JOURNAL)
    edits = lifecycle.proposed_edits(_evaluated(spark, sf).rules, table, ledger, lifecycle.reverted_keys(journal))
    return lifecycle.next_ledger(ledger, lifecycle.checked_edits(edits, table, shipped_policy(spark))).select("rule_id", "status", "precision_estimate")


@query("q59_rounds", """with j as (select user_id, event_id as round, round(value / 100, 4) as r, round((value % 7) / 10, 4) as f, cast(floor(value) as integer) as s from events)
 select user_id, round, round(r - lag(r) over w, 4) as recall_change, round(f - lag(f) over w, 4) as fp_change, s - lag(s) over w as score_change, max(s) over (partition by user_id order by round rows unbounded preceding) as best_score from j window w as (partition by user_id order by round)""")
def round_changes(spark, sf):
    from tracewright.operators.lifecycle import rounds

    e = fr.table(spark, sf, "events").select("user_id", F.col("event_id").alias("round"), F.round(F.col("value") / 100, 4).alias("recall_after"), F.round(F.col("value") % 7 / 10, 4).alias("fp_after"), F.floor("value").cast("int").alias("score_after"))
    return rounds(e, ("user_id",)).select("user_id", "round", F.round("recall_change", 4).alias("recall_change"), F.round("fp_change", 4).alias("fp_change"), "score_change", "best_score")


@query("q60_retrieval_packages", f"""with i as (select vec_id, 'n' || (label % 3) as namespace, embedding, source || '/' || doc_id as path, len(string_split(coalesce(text, ''), chr(10))) as lines, coalesce(text, '') as text from embeddings join documents on doc_id = vec_id),
 q as (select vec_id as query_id, 'n' || (label % 3) as namespace, embedding from embeddings where vec_id % 100 = 0),
 s as (select q.query_id, e.*, round({_COSINE}, 6) as score from i e join q using (namespace)), k as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s qualify rank <= 5),
 b as (select query_id, rank, '[' || namespace || '] ' || path || ':1-' || lines || chr(10) || text as block from k), r as (select *, sum(length(block)) over (partition by query_id order by rank rows unbounded preceding) as running from b)
 select query_id, (count(*) filter (where running <= 4000))::int as hits, md5(coalesce(string_agg(block, chr(10) || chr(10) order by rank) filter (where running <= 4000), '')) as digest, bool_or(running > 4000) as truncated from r group by query_id""")
def retrieval_packages(spark, sf):
    from tracewright.sources.files import read_vectors, write_vectors
    from tracewright.sources.scratch import shared_folder, stored

    space = F.concat(F.lit("n"), (F.col("label") % 3).cast("string")).alias("namespace")
    vectors = fr.table(spark, sf, "embeddings").select("vec_id", "embedding", space)
    chunks = fr.table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.lit(1).alias("start_line"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("end_line"), F.coalesce("text", F.lit("")).alias("text"))
    path = shared_folder(spark, "vectors")
    write_vectors(vectors.join(chunks, "vec_id"), path)
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_embedding"), "namespace")
    asked = stored(queries, "queries")  # its size is known then, so that a few queries are sent to the vectors and not vectors to their namespace
    return retrieve.packages(retrieve.top_for_queries(read_vectors(spark, path), asked, 5)).select("query_id", "hits", F.md5("text").alias("digest"), "truncated")


@query("q61_category_counts", _SCORED + " select source, (select any_value(category) from policy p where p.cwe = s.cwe) as category, count(*) as findings, round(sum(penalty), 4) as penalty_total, max(level) as max_severity from scored s where static group by source, s.cwe")
def category_counts(spark, sf):
    f = findings.reported(fr.findings(spark, sf)).withColumn("source", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    return policy.category_counts(policy.with_penalty(f, fr.policy(spark)), ("source",)).withColumn("penalty_total", F.round("penalty_total", 4))


@query("q62_findings_per_target", FINDINGS + """ select finding_id, path from (select *, row_number() over (partition by path order by case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 4 end, priority desc, line, rule_id) as place from findings) where place = 1""")
def findings_per_target(spark, sf):
    return findings.per_target(fr.findings(spark, sf), 1).select("finding_id", "path")


@query("q63_sarif_document", FINDINGS + """ select path, line::int as line, rule_id, case severity when 'critical' then 'high' when 'high' then 'high' when 'medium' then 'medium' else 'low' end as severity, finding_id as fingerprint from findings where status <> 'shadow'""")
def sarif_document(spark, sf):
    """All findings through one document and back."""
    from tracewright.sources.documents import write_sarif
    from tracewright.sources.sarif import read_hints
    from tracewright.sources.scratch import shared_folder, stored

    path = shared_folder(spark, "report") + ".sarif"
    found = stored(fr.verified_findings(spark, sf), "verified")  # else each use of it, and the sort's sample, scans the texts
    verdicts = found.select("finding_id", F.col("verdict").alias("status"), F.col("ord"))
    write_sarif(findings.reported(found), path, verdicts)
    return read_hints(spark, [path]).select("path", "line", "rule_id", "severity", "fingerprint")
