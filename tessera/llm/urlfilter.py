"""URL filters by Bloom filter cascades, in DataFrame functions only.

A rule is a host with a path; its key is the two joined.  A url's candidate keys are each suffix of its host
(at label bounds) with each prefix of its path of a length that some rule has, so a rule fits a url exactly if its
key is among the candidates.  Level 0 of a cascade encodes the listed keys; level 1 the keys of the corpus that
level 0 holds wrongly; level 2 the listed keys that level 1 holds wrongly, and so on until a level errs on none.
Over the corpus's keys, membership is then exact, with no join when urls are judged.

Level 0 errs on at most about as many corpus keys as there are listed keys (its size follows the logarithm of their
ratio), and later levels err on half, so the whole cascade is bounded by the list's size, not by the corpus.  A level is
one binary literal in the plan, made of bitmaps that are aggregated in the cluster; a list whose cascade would be larger
than ``max_bytes`` is not put into plans, but joined with the candidate keys, with the same result.

Defined results: a null url, or one without ``://``, has empty host and path and no rule; an url that no rule fits
is allowed; of the rules that fit, the longest key wins; a key that is listed with both verdicts blocks; repeated rows
and null ids are judged each; an empty table gives no rows; columns but page_id and url are not read, whatever their
names; a very long url gives as many candidates as it has host labels, times the lengths of rules' paths.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, union

#: (verdict, host, path) of the contract.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: A cascade's first level in a plan is at most this large.
MAX_BYTES = 8 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    pattern = r"://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys that a rule fitting this url could have."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array_compact(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


@dataclass(frozen=True)
class Bloom:
    """bits, seven to a byte, so that each byte is one character to SQL."""

    data: bytes
    bits: int
    hashes: int
    seed: int

    @classmethod
    def of(cls, keys: DataFrame, n: int, rate: float, seed: int) -> Bloom:
        """Of a column ``key``; only bitmaps come to the driver, as many bits as n and rate ask for."""
        bits = max(64, 64 * math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64))
        hashes = min(max(1, round(bits / n * math.log(2))), 16)
        at = keys.select(F.explode(_places(F.col("key"), bits, seed, hashes)).alias("at"))
        found = at.groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bitmap")).collect()
        each = 8 * 4096
        held = np.zeros(math.ceil(bits / each) * each, np.uint8)
        for r in found:
            held[(r.bucket - 1) * each : r.bucket * each] = np.unpackbits(np.frombuffer(r.bitmap, np.uint8), bitorder="little")
        held = np.concatenate([held[:bits], np.zeros(-bits % 7, np.uint8)]).reshape(-1, 7)
        return cls((held << np.arange(7, dtype=np.uint8)).sum(1, dtype=np.uint8).tobytes(), bits, hashes, seed)

    def holds(self, key: Column) -> Column:
        table = F.lit(self.data)

        def set_(at: Column) -> Column:
            byte = F.ascii(F.substring(table, F.floor(at / 7).cast("int") + 1, F.lit(1)).cast("string"))
            return F.call_function("shiftright", byte, (at % 7).cast("int")).bitwiseAND(F.lit(1)) != 0

        return F.forall(_places(key, self.bits, self.seed, self.hashes), lambda at: set_(at))


def _places(key: Column, bits: int, seed: int, hashes: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(F.lit(seed * 64 + i), key), F.lit(bits).cast("long")) for i in range(hashes)])


@dataclass(frozen=True)
class Cascade:
    levels: list[Bloom]

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, max_bytes: int = MAX_BYTES) -> Cascade | None:
        """Of two columns ``key``; universe may hold keys many times over.  None if it would be too large."""
        listed = saved(listed.select("key").distinct(), "listed")
        n = listed.count()
        if not n:
            return cls([])
        seen = universe.count()
        rate = min(0.5, max(1e-9, n / max(1, seen)))
        need = -n * math.log(rate) / math.log(2) ** 2 / 8
        if need > max_bytes:
            return None
        levels = [Bloom.of(listed, n, rate, 0)]
        wrong = saved(universe.filter(levels[0].holds(F.col("key"))).distinct().join(listed, "key", "left_anti"), "wrong")
        inside, outside, count = listed, wrong, wrong.count()
        while count:
            levels.append(Bloom.of(outside, count, 0.5, len(levels)))
            held = saved(inside.filter(levels[-1].holds(F.col("key"))), "held")
            inside, outside, count = outside, held, held.count()
        return cls(levels)

    def contains(self, key: Column) -> Column:
        """True for listed keys; a key that every level holds belongs to what the last one encodes."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(self.levels[i].holds(key), out).otherwise(F.lit(i % 2 == 1))
        return out


def _hits(keys: Column, cascade: Cascade, verdict: str) -> Column:
    # lambdas of one parameter: a second one would be the position
    listed = F.filter(keys, lambda k: cascade.contains(k))
    return F.transform(listed, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"), F.lit(verdict).alias("verdict")))


def _by_join(keyed: DataFrame, listed: DataFrame, verdict: str) -> DataFrame:
    """row, and found (the longest listed candidate): what a cascade tells, for lists that are too long for one."""
    keys = keyed.select("row", F.explode("keys").alias("key")).join(listed.distinct().hint("merge"), "key", "left_semi")
    return keys.groupBy("row").agg(F.max(F.struct(F.length("key").alias("n"), "key", F.lit(verdict).alias("verdict"))).alias("found"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row.  rules: (verdict, host, path), as a list or as a DataFrame of these columns."""
    spark, rules = pages.sparkSession, RULES if rules is None else rules
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "verdict string, host string, path string")
    rules = saved(rules.select("verdict", F.length("path").alias("n"), F.concat("host", "path").alias("key")), "rules")
    lengths = sorted(r.n for r in rules.select("n").distinct().collect())  # of paths, so few
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    if not lengths:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    keyed = parts.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths))
    universe = union([keyed.select(F.explode("keys").alias("key")), rules.select("key")])
    found, far = [], []
    for verdict in ("allow", "block"):
        listed = rules.filter(F.col("verdict") == verdict).select("key")
        cascade = Cascade.build(listed, universe, max_bytes)
        if cascade:
            found.append(_hits(F.col("keys"), cascade, verdict))
        else:
            far.append((verdict, listed))
    if far:
        keyed = saved(keyed.withColumn("row", F.monotonically_increasing_id()), "keyed")
    for i, (verdict, listed) in enumerate(far):
        keyed = keyed.join(_by_join(keyed, listed, verdict).withColumnRenamed("found", f"found{i}"), "row", "left")
        found.append(F.array_compact(F.array(f"found{i}")))
    best = keyed.withColumn("best", F.array_max(F.concat(*found)))
    return best.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit("allow")).alias("verdict"))


ORACLE = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM u
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
