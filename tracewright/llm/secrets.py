"""Secret scans: rule matches, and a randomness test battery with length-aware false-discovery control. DataFrame functions only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import materialize

KINDS = ("assign", "access", "hex", "random")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
LEAST_VALUE = 12
#: What the battery looks at: runs of at least this many characters of any of the encodings.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Encodings in the order in which they're inferred, with their alphabets.
ENCODINGS = (
    ("hex", "[0-9a-f]+", "0123456789abcdef"),
    ("hex_upper", "[0-9A-F]+", "0123456789ABCDEF"),
    ("base32", "[A-Z2-7]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base64", "[A-Za-z0-9+/]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "[A-Za-z0-9_-]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Percentages of the letters a..z in English text.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
#: In words that aren't random: shares of lower-case letters, capitals, digits and other characters.
SHARES = (0.85, 0.08, 0.04, 0.03)
#: Uniformity is given up below this p; false discoveries are held to this rate in each band of lengths.
LEAST_P, RATE = 0.001, 0.01
BANDS = (20, 32, 64)
BUCKETS_A_DECADE = 50


def _natural() -> dict[str, float]:
    total = sum(LETTERS)
    out = {chr(97 + i): SHARES[0] * x / total for i, x in enumerate(LETTERS)} | {chr(65 + i): SHARES[1] * x / total for i, x in enumerate(LETTERS)}
    return out | {str(i): SHARES[2] / 10 for i in range(10)} | {c: SHARES[3] / 5 for c in "+/-_="}


def spans(text: Column, pattern: str, keep: Column | None = None) -> Column:
    """[struct(start, stop)] of a pattern's leftmost non-overlapping matches, in code points, end exclusive.

    The pieces between the matches and the matches' own lengths give the places. `keep` is an
    optional array of booleans, one per match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size")))
    empty = F.expr("cast(array() as array<struct<start:int,stop:int>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        return F.struct((start + x["size"]).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), (start + x["size"]).alias("stop")))).alias("out"))

    out = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    if keep is None:
        return out
    return F.transform(F.filter(F.zip_with(out, keep, lambda s, k: F.struct(s.alias("s"), k.alias("k"))), lambda x: x["k"]), lambda x: x["s"])


def _when(condition: Column, value: Column) -> Column:
    return F.when(condition, value).otherwise(F.expr("cast(array() as array<struct<start:int,stop:int>>)"))


def base_spans(text: Column) -> dict[str, Column]:
    """The rule matches of each kind; texts without a rule's fixed part aren't searched for it."""
    small = F.lower(text)
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1))
    return {
        "assign": _when(reduce(lambda a, b: a | b, (small.contains(k) for k in KEYWORDS)), spans(text, ASSIGN, F.transform(values, lambda v: F.length(v) >= LEAST_VALUE))),
        "access": _when(text.contains("AKIA"), spans(text, ACCESS)),
        "hex": _when(text.rlike(HEX), spans(text, HEX)),
    }


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution, by the rational approximation of the error function to 1.5e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    erfc = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    return F.when(z >= 0, erfc / 2).otherwise(1 - erfc / 2)


def battery(token: Column) -> Column:
    """struct(encoding, n, p_uniform, p_natural) of a candidate.

    Against a uniform alphabet: chi-squared of the symbols' counts, runs above and below the
    alphabet's middle, and correlation of neighbours; p_uniform is the least of the three p-values times
    three. p_natural is the chance that word-like characters score as far towards a uniform
    source as the token's do (log-likelihood ratio, normal approximation).
    """
    body = F.regexp_replace(token, "=+$", "")
    fits = lambda pattern: body.rlike(f"^{pattern}$")
    name, alphabet = F.lit("mixed"), F.lit(ENCODINGS[-1][2] + "+/=")
    for n, pattern, letters in reversed(ENCODINGS):
        name, alphabet = F.when(fits(pattern), n).otherwise(name), F.when(fits(pattern), letters).otherwise(alphabet)
    natural = _natural()
    order = "".join(natural)

    def tested(x: Column) -> Column:
        a, v, n = x["a"].cast("double"), x["v"], x["n"].cast("double")
        squares = F.aggregate(F.array_distinct(v), F.lit(0.0), lambda s, d: s + F.pow(F.size(F.filter(v, lambda y: y == d)).cast("double"), F.lit(2.0)))
        df = a - 1
        chi = squares * a / n - n
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        side = F.transform(v, lambda y: (y * 2 >= a).cast("int"))
        n1 = F.aggregate(side, F.lit(0), lambda s, y: s + y).cast("double")
        n2 = n - n1
        steps = F.zip_with(F.slice(side, 2, F.size(side) - 1), F.slice(side, 1, F.size(side) - 1), lambda p, q: (p != q).cast("int"))
        runs = 1 + F.aggregate(steps, F.lit(0), lambda s, y: s + y).cast("double")
        mean_runs = 1 + 2 * n1 * n2 / n
        var_runs = F.greatest(2 * n1 * n2 * (2 * n1 * n2 - n) / (n * n * (n - 1)), F.lit(1e-9))
        z_runs = F.when((n1 == 0) | (n2 == 0), F.lit(9.0)).otherwise((runs - mean_runs) / F.sqrt(var_runs))
        mean = F.aggregate(v, F.lit(0.0), lambda s, y: s + y) / n
        var = F.aggregate(v, F.lit(0.0), lambda s, y: s + (y - mean) * (y - mean))
        lag = F.aggregate(F.zip_with(F.slice(v, 2, F.size(v) - 1), F.slice(v, 1, F.size(v) - 1), lambda p, q: (p - mean) * (q - mean)), F.lit(0.0), lambda s, y: s + y)
        z_serial = F.when(var > 0, lag / var * F.sqrt(n)).otherwise(F.lit(9.0))
        p = F.least(upper_tail(z_chi), 2 * upper_tail(F.abs(z_runs)), 2 * upper_tail(F.abs(z_serial)))
        return F.least(F.lit(1.0), 3 * p)

    def towards_random(size: int) -> tuple[list[float], float, float]:
        ratio = [math.log(1 / size / natural[c]) for c in order]
        mean = sum(natural[c] * r for c, r in zip(order, ratio))
        return ratio, mean, math.sqrt(sum(natural[c] * (r - mean) ** 2 for c, r in zip(order, ratio)))

    ratio, mean, spread = towards_random(64)
    ratios = F.array(*[F.lit(r) for r in ratio])
    chars = F.split(body, "")
    chars = F.filter(chars, lambda c: c != "")
    n = F.length(body).cast("double")
    score = F.aggregate(F.transform(chars, lambda c: F.call_function("try_element_at", ratios, F.call_function("instr", F.lit(order), c))), F.lit(0.0), lambda s, y: s + F.coalesce(y, F.lit(0.0)))
    p_natural = upper_tail((score - n * mean) / (spread * F.sqrt(n)))
    numbers = F.transform(chars, lambda c: (F.call_function("instr", alphabet, c) - 1).cast("double"))
    held = F.struct(F.length(alphabet).alias("a"), numbers.alias("v"), F.length(body).alias("n"))
    return F.struct(name.alias("encoding"), F.length(body).alias("n"), F.transform(F.array(held), tested)[0].alias("p_uniform"), p_natural.alias("p_natural"))


def _band(n: Column) -> Column:
    return reduce(lambda a, b: a + b, ((n >= b).cast("int") for b in BANDS[1:]), F.lit(0))


def _bucket(p: Column) -> Column:
    return F.floor(-F.log10(F.greatest(p, F.lit(1e-12))) * BUCKETS_A_DECADE).cast("int")


def discovery_buckets(p_values: DataFrame, rate: float = RATE) -> dict[int, int]:
    """Per band of lengths the least bucket of -log10 p that false-discovery control at `rate` admits.

    Step-up rule over a histogram of at most 12 decades: the largest p (a bucket's upper end) with
    p * (all in the band) / (as small or smaller) <= rate. Counts are aggregated; a row per bucket reaches the driver.
    """
    counts = p_values.groupBy(_band(F.col("n")).alias("band"), _bucket(F.col("p")).alias("bucket")).count().collect()  # at most 3 x 601 rows
    out = {}
    for band in {r["band"] for r in counts}:
        own = sorted(((r["bucket"], r["count"]) for r in counts if r["band"] == band), reverse=True)
        total, below = sum(c for _, c in own), 0
        for bucket, count in own:
            below += count
            if 10 ** (-bucket / BUCKETS_A_DECADE) * total / below <= rate:
                out[band] = bucket
    return out


def scan_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) for every row of docs.

    Rule matches always stay. The battery adds runs of 20 or more encoding characters that look
    uniform (p_uniform >= LEAST_P) and are discoveries against word-like text at the false-discovery
    rate of their band of lengths, unless they overlap a rule match. Null and empty texts
    have no spans; rows of equal doc_id stay rows of their own; an empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    base = base_spans(F.col("text"))
    found = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    places = spans(F.col("text"), CANDIDATE)
    tried = F.zip_with(places, found, lambda s, m: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), battery(m).alias("test")))
    none = F.expr("cast(array() as array<struct<start:int,stop:int,test:struct<encoding:string,n:int,p_uniform:double,p_natural:double>>>)")
    facts = rows.select("doc_id", *[c.alias(k) for k, c in base.items()], F.when(F.col("text").rlike(CANDIDATE), tried).otherwise(none).alias("tried"))
    facts = materialize(facts, "secret-facts")
    p_values = facts.select(F.explode("tried.test").alias("t")).select(F.col("t.n").alias("n"), F.col("t.p_natural").alias("p"))
    least = discovery_buckets(p_values, rate)
    admitted = lambda t: (t["p_uniform"] >= LEAST_P) & reduce(lambda a, b: a | b, ((_band(t["n"]) == band) & (_bucket(t["p_natural"]) >= bucket) for band, bucket in least.items()), F.lit(False))
    known = F.concat("assign", "access", "hex")
    free = lambda x: ~F.exists(known, lambda s: (s["start"] < x["stop"]) & (x["start"] < s["stop"]))
    facts = facts.withColumn("random", F.transform(F.filter("tried", lambda x: admitted(x["test"]) & free(x)), lambda x: F.struct(x["start"], x["stop"])))

    def listed(kinds: tuple[str, ...]) -> Column:
        numbered = lambda i: lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["stop"].alias("stop"))
        rows = F.concat(*[F.transform(F.col(k), numbered(i)) for i, k in enumerate(kinds)])
        named = F.transform(F.array_sort(rows), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, kinds)), s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string")))
        return F.array_join(named, ",")

    return facts.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(listed(KINDS[:3]), 256).alias("base_sha256"), listed(KINDS).alias("spans"))
