"""Ranking of targets: heuristic scores, merge with model scores, tiers and their schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.text import chosen

# Admitted targets of each tier.
TIER_CAPS = {"A": 20, "B": 40, "C": 80}
LARGE_FILE = 500


def composite_priority(surface: Column, influence: Column, reachability: Column) -> Column:
    held = lambda c: F.greatest(F.lit(1), F.least(F.lit(5), c))
    return F.round(held(surface) * 0.5 + held(influence) * 0.2 + held(reachability) * 0.3, 2)


def hint_reachability(hints: Column) -> Column:
    """The highest score of a file's entry points by access level and kind; 0 without any."""

    def score(h: Column) -> Column:
        level, kind = h["access_level"], h["kind"]
        return (
            F.when(level == "public", F.when(kind.isin("route", "parser", "fuzz"), 5).otherwise(4))
            .when(level.isin("authenticated", "contract-only/callback"), 4)
            .when(level == "role-restricted", 3)
            .when(level.isin("review-required", "local-only"), 2)
            .otherwise(0)
        )

    return F.coalesce(F.array_max(F.transform(hints, score)), F.lit(0))


def heuristic_rank(targets: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, surface, influence, reachability, priority, boosts, tags, *keep) from tags, loc, has_fuzz and hints (all optional but tags)."""
    has = lambda *names: F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, names))), F.lit(False))
    fuzz = has("fuzzable") | (F.coalesce("has_fuzz", F.lit(False)) if "has_fuzz" in targets.columns else F.lit(False))
    large = F.col("loc") >= LARGE_FILE if "loc" in targets.columns else F.lit(False)
    entry = hint_reachability(F.col("hints")) if "hints" in targets.columns else F.lit(0)
    parser, network, auth, crypto, privileged = has("parser", "deserialization"), has("network_entry"), has("auth_boundary"), has("crypto"), has("syscall_entry", "filesystem_entry")
    at = lambda *pairs: F.greatest(F.lit(1), F.lit(1), *[F.when(c, v).otherwise(1) for c, v in pairs])
    surface = at((has("memory_unsafe"), 3), (parser, 4), (auth, 3), (privileged, 3), (fuzz, 5))
    influence = at((crypto, 4), (large, 3))
    reach = F.greatest(at((parser, 3), (network, 4), (auth, 3), (fuzz, 4)), entry)
    boosts = chosen({"memory_unsafe": has("memory_unsafe"), "input_parser": parser, "network_entry": network, "auth_boundary": auth, "crypto": crypto, "privileged_boundary": privileged, "fuzzable": fuzz, "large_file": large, "entry_point_reachable": entry > 0})
    ranked = targets.select("path", "tags", *keep, surface.alias("surface"), influence.alias("influence"), reach.alias("reachability"), boosts.alias("boosts"))
    return ranked.withColumn("priority", composite_priority(F.col("surface"), F.col("influence"), F.col("reachability")))


def merge_rankings(base: DataFrame, other: DataFrame) -> DataFrame:
    """base with the larger of both sides' scores and the union of boosts per path; other: path, surface, influence, reachability, boosts."""
    o = other.select("path", *[F.col(c).alias(f"o_{c}") for c in ("surface", "influence", "reachability", "boosts")])
    joined = base.join(o, "path", "left")
    larger = {c: F.greatest(c, F.coalesce(f"o_{c}", c)) for c in ("surface", "influence", "reachability")}
    merged = joined.withColumns({**larger, "boosts": F.array_sort(F.array_union("boosts", F.coalesce("o_boosts", F.expr("cast(array() as array<string>)"))))})
    return merged.withColumn("priority", composite_priority(F.col("surface"), F.col("influence"), F.col("reachability"))).drop(*[f"o_{c}" for c in ("surface", "influence", "reachability", "boosts")])


def tier_of(priority: Column) -> Column:
    return F.when(priority >= 3, "A").when(priority >= 2, "B").otherwise("C")


def schedule(rankings: DataFrame, targets: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """The admitted targets of each tier, best priority first: path, priority, tier, place.

    The cap is the feature: row_number <= cap becomes a group limit below the shuffle.
    """
    caps = caps or TIER_CAPS
    rows = rankings.join(targets.select("path").distinct(), "path", "left_semi").withColumn("tier", tier_of(F.col("priority")))
    cap = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])
    place = F.row_number().over(Window.partitionBy("tier").orderBy(F.desc("priority"), "path"))
    return rows.withColumn("place", place).where((F.col("place") <= max(caps.values())) & (F.col("place") <= F.element_at(cap, F.col("tier")))).select("path", "priority", "tier", "place")
