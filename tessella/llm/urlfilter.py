"""URL filters by a cascade of Bloom filters, exact over the corpus's keys and free of joins.

A page's keys are its host and every parent domain, each with every prefix of its path of a length
that some rule has (so a rule `example.org/en/1` is one key). The universe is the distinct keys of
the whole corpus. Level 1 encodes the listed keys; level 2 the keys of the universe that level 1
wrongly passes; level 3 the listed keys that level 2 passes, and so on until none is left. A key of
the universe is listed exactly if the number of levels that it passes in a row is odd.

Lookups are built-in functions over bit arrays. Level 1's error rate is |listed| / |universe|, so each
level is about as large as the listed keys ask for, however large the corpus. A list whose first level
would take more than MAX_BITS is cut into parts by the hash of the key, each with a cascade of its own of
about that size; a frame passes AT_ONCE parts at a time, so what a task holds is bounded at any list size.

A null url, or one without "://", has an empty host and path and fits no rule. Repeated pages give
repeated results; an empty table gives an empty one; other columns are ignored. Equal-length rules
can't both fit one url unless they are equal; of equal rules the first verdict holds (of a table's, the
first in order). Rules and hosts that are null or hold "#" fit nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import storage
from tessella.llm.spans import bound

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Hosts that are blocked where no rule fits.
BLOCKED = tuple(f"{name}.example.{tld}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for tld in ("com", "net", "org"))

#: Bits of a part's first level, about (2 MB); parts whose levels a task holds at once; levels of a part.
MAX_BITS, AT_ONCE, MAX_LEVELS = 1 << 24, 16, 64
#: Ends the key of a whole host; neither a host nor a path holds it.
HOST_MARK = "#"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """Array of the keys of a page, longest domain first."""
    labels = F.split(host, r"\.", -1)
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    return F.when(host != "", F.flatten(F.transform(domains, lambda d: F.transform(prefixes, lambda p: F.concat(d, p))))).otherwise(F.array().cast("array<string>"))


def _bits(key: Column, level: int, m: int, k: int) -> list[Column]:
    a = F.shiftrightunsigned(F.xxhash64(key, F.lit(level)), 33)
    b = F.shiftrightunsigned(F.xxhash64(F.lit(-level), key), 33)
    return [(a + b * i) % m for i in range(k)]


def _shape(n: int, rate: float) -> tuple[int, int]:
    """Bits (a multiple of 64) and hashes of a filter of n keys."""
    bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64) * 64)
    return bits, max(1, round(-math.log2(rate)))


def _passes(key: Column, words: Column, level: int, m: int, k: int) -> Column:
    out = None
    for at in _bits(key, level, m, k):
        bit = F.get(words, F.shiftright(at, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))) != 0
        out = bit if out is None else out & bit
    return out


class Part:
    """A cascade over some of the listed keys and of the universe; name tells its columns from those of others."""

    def __init__(self, listed: DataFrame, universe: DataFrame, name: str = ""):
        self.levels: list[tuple[DataFrame, int, int]] = []
        self.name = name
        n, total = listed.count(), universe.count()
        rate = min(0.5, max(1e-12, n / max(1, total)))
        # What level i encodes, and what it must be told apart from: both shrink from level to level.
        inside, outside = listed, universe.join(listed, "key", "left_anti")
        while n:
            if len(self.levels) == MAX_LEVELS:
                raise RuntimeError(f"{n} keys are left after {MAX_LEVELS} levels")
            m, k = _shape(n, rate)
            self.levels.append((self._encode(inside, m, k), m, k))
            inside, outside = storage.cut(self._survivors(outside), "level"), inside
            n, rate = inside.count(), 0.5

    def _encode(self, keys: DataFrame, m: int, k: int) -> DataFrame:
        """One row: the filter's words. Bits are or-ed word by word in parallel; only the words (bounded) meet."""
        at = keys.select(F.explode(F.array(*_bits(F.col("key"), len(self.levels) + 1, m, k))).alias("at"))
        words = at.groupBy(F.shiftright("at", 6).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("b"))
        return storage.cut(storage.dense_row(words, m // 64), "filter")

    def _survivors(self, keys: DataFrame) -> DataFrame:
        """Keys that pass the newest level (those before were passed to get here)."""
        words, m, k = self.levels[-1]
        return keys.withColumn("words", words.scalar()).where(_passes(F.col("key"), F.col("words"), len(self.levels), m, k)).select("key")

    def with_filters(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"__level{self.name}_{i}": words.scalar() for i, (words, _, _) in enumerate(self.levels)})

    def listed(self, key: Column) -> Column:
        """Whether key, of the part's universe, is listed; over a frame that went through with_filters."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i, (_, m, k) in reversed([*enumerate(self.levels)]):
            out = F.when(_passes(key, F.col(f"__level{self.name}_{i}"), i + 1, m, k), out).otherwise(F.lit(i % 2 == 1))
        return out


class Cascade:
    """Exact membership of `listed` (column key) among the keys of `universe` (column key), both without repeats."""

    def __init__(self, listed: DataFrame, universe: DataFrame, max_bits: int = MAX_BITS):
        listed = storage.cut(listed.select("key").where("key IS NOT NULL").distinct(), "listed")
        n, total = listed.count(), universe.count()
        self.n_parts = max(1, math.ceil(_shape(n, min(0.5, max(1e-12, n / max(1, total))))[0] / max_bits)) if n else 1
        if self.n_parts > 1:  # each part reads its own keys only
            listed, universe = (storage.cut(df.withColumn("part", self._part(F.col("key"))), "parted") for df in (listed, universe))
        mine = lambda df, i: df.where(F.col("part") == i).select("key") if self.n_parts > 1 else df.select("key")
        self.parts = [Part(mine(listed, i), mine(universe, i), str(i)) for i in range(self.n_parts)]

    def _part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(self.n_parts))

    def members(self, df: DataFrame, keys_col: str, out_col: str) -> DataFrame:
        """Adds out_col: the elements of df's array keys_col that are listed, in order."""
        kept = [c for c in df.columns if c != out_col]
        for i in range(0, self.n_parts, AT_ONCE):
            some = [*enumerate(self.parts)][i : i + AT_ONCE]
            before = F.col(out_col) if i else F.array().cast("array<string>")
            frame = df if self.n_parts <= AT_ONCE else storage.cut(df, "passing")
            for _, part in some:
                frame = part.with_filters(frame)

            def here(some: list[tuple[int, Part]], key: Column) -> Column:
                if self.n_parts == 1:
                    return some[0][1].listed(key)
                out = F.lit(False)
                for k, part in some:
                    out = F.when(self._part(key) == k, part.listed(key)).otherwise(out)
                return out

            df = frame.select(*kept, F.concat(before, F.filter(keys_col, bound(here, some))).alias(out_col))
        if self.n_parts <= AT_ONCE:
            return df
        found = F.col(out_col)
        return df.select(*kept, F.filter(keys_col, lambda k: F.array_contains(found, k)).alias(out_col))


def _table(spark, rows, columns: tuple[str, ...]) -> DataFrame:
    """rows, as a table of strings; a DataFrame as it is."""
    if isinstance(rows, DataFrame):
        return rows.select(*columns)
    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))


def judge_urls(pages: DataFrame, rules=RULES, blocked=BLOCKED, default: str = "allow", max_bits: int = MAX_BITS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page: the longest rule that fits, else block for a blocked host, else
    default. rules are (host, path, verdict) with verdicts allow and block, blocked are hosts; each a sequence or a table."""
    spark = pages.sparkSession
    host, path = split_url(F.col("url"))
    rules = _table(spark, rules, ("host", "path", "verdict")).where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").where(~F.contains(F.concat("host", "path"), F.lit(HOST_MARK)))
    rules = rules.withColumn("no", F.monotonically_increasing_id()).groupBy(F.concat("host", "path").alias("key")).agg(F.min_by("verdict", "no").alias("verdict"), F.first(F.length("path")).alias("n"))
    rules = storage.cut(rules, "rules")
    hosts = _table(spark, blocked, ("host",)).where(~F.contains("host", F.lit(HOST_MARK))).select(F.concat("host", F.lit(HOST_MARK)).alias("key"))
    lengths = sorted(r.n for r in rules.select("n").distinct().collect())  # at most as many as a path has characters
    df = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("keys", F.concat(keys_of(F.col("host"), F.col("path"), lengths), keys_of(F.col("host"), F.lit(HOST_MARK), [1])))
    universe = storage.cut(df.select(F.explode(F.array_distinct("keys")).alias("key")).distinct(), "universe")
    found = Cascade(rules.select("key").unionByName(hosts), universe, max_bits).members(df, "keys", "hits")
    of_rule = F.filter("hits", lambda k: ~k.endswith(HOST_MARK))
    longest = F.array_max(F.transform(of_rule, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))["key"]
    fallback = F.when(F.exists("hits", lambda k: k.endswith(HOST_MARK)), "block").otherwise(default)
    found = found.select("page_id", "host", "path", longest.alias("rule"), fallback.alias("fallback")).withColumn("keys", F.array("rule"))
    # A second cascade, over the rules alone, tells those that block.
    found = Cascade(rules.where("verdict = 'block'"), rules.select("key"), max_bits).members(found, "keys", "blocks")
    verdict = F.when(F.col("rule").isNull(), F.col("fallback")).when(F.size("blocks") > 0, "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
