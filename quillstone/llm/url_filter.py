"""URL rules and a Bloom filter cascade for listed hosts, in DataFrame functions.

The cascade's levels are Bloom filters: the first holds the listed keys, the next
those keys of the corpus that pass it unlisted, the next the listed keys that
pass that one, and so on until nothing passes wrongly. Over the key universe it
was built for, membership is then exact. The universe is every host of the table
and every domain above it; only those that pass the first level, some in a thousand
beside the listed ones, are ever compared with the list.

Keys are dealt by hash into shards of about ``SHARD_KEYS`` listed keys, each with a
small filter of its own at every level. Filters are literals of the plan and a lookup
is an expression on their words, without a join; of a list beyond ``PASS_SHARDS``
shards, so many at a time: each pass over the rows answers for the keys of its shards.

Cases: a null url, or one without ``://``, has an empty host and path, fits no
rule and is not listed; a very long url is read whole; repeated rows and ids are
judged alike; null or empty keys are not listed; an empty table gives no rows; an
empty list blocks nothing; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import durable, quoted, sized_broadcast

BITS_PER_KEY = 12
HASHES = 6
#: Listed keys of a shard (its first level has 24,576 words), and shards whose filters
#: are literals at once.
SHARD_KEYS, PASS_SHARDS = 1 << 17, 4

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parse_rules(lines: Sequence[str]) -> list[Rule]:
    """Rules of lines like ``block example.com/en/``, longest first."""
    rules = []
    for line in lines:
        verdict, place = line.split()
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r} in {line!r}")
        host, slash, path = place.partition("/")
        rules.append(Rule(verdict, host, slash + path))
    return sorted(rules, key=lambda r: (-len(r.name), r.name))


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = url.substr(at + 3, F.greatest(F.char_length(url), F.lit(1)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.when(at > 0, host).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = url.substr(at + 3, F.greatest(F.char_length(url), F.lit(1)))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def domains(host: Column) -> Column:
    """The host and every domain above it, without empty ones."""
    parts = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.filter(above, lambda d: d != "")


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def places(key: Column, level: int, words: Column) -> Column:
    """Where a level of so many words has the key's bits."""
    bits = words.cast("long") * 64
    return F.array(*(F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), bits) for j in range(HASHES)))


def passes(key: Column, level: int, words: Column) -> Column:
    """Whether a level's words have all of the key's bits; no words, no. The words are
    named once, as a literal stands in the plan wherever it is named."""

    def test(own: Column) -> Column:
        every = F.forall(places(key, level, F.size(own)), lambda at: F.call_function("getbit", F.get(own, F.shiftright(at, 6).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1)
        return F.when(F.size(own) > 0, every)

    return F.coalesce(F.get(F.transform(F.array(words), test), F.lit(0)), F.lit(False))


def _filters(members: DataFrame, level: int) -> DataFrame:
    """shard and words (64 bits each, at most SHARD_KEYS * BITS_PER_KEY / 64 or so):
    a Bloom filter of each shard's keys."""
    sizes = members.groupBy("shard").agg(F.ceil(F.count("*") * BITS_PER_KEY / 64).cast("int").alias("size"))
    at = members.join(sized_broadcast(durable(sizes, "url-shards")), "shard").select("shard", F.explode(places(F.col("key"), level, F.col("size"))).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))
    some = at.select("shard", F.shiftright("at", 6).cast("int").alias("place"), bit.alias("bits"))
    none = sizes.select("shard", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("place"), F.lit(0).cast("long").alias("bits"))
    words = some.unionByName(none).groupBy("shard", "place").agg(F.bit_or("bits").alias("bits"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "bits")))
    return durable(words.groupBy("shard").agg(F.transform(ordered, lambda w: w["bits"]).alias("words")), "url-filters")


def _literal(level: DataFrame, first: int, last: int, shard: Column) -> Column:
    """The words of a key's shard, for the shards from ``first`` to before ``last``,
    of which there are at most ``PASS_SHARDS``."""
    found = F.lit(None).cast("array<bigint>")
    for row in level.where(F.col("shard").between(first, last - 1)).collect():
        words = F.from_json(F.lit(json.dumps(row.words, separators=(",", ":"))), "array<bigint>")  # folded to a literal
        found = F.when(shard == row.shard, words).otherwise(found)
    return found


@dataclass(frozen=True)
class Cascade:
    """Levels of ``shards`` Bloom filters each."""

    shards: int
    levels: tuple[DataFrame, ...]

    def shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.shards)).cast("int")

    def contains(self, first: int = 0, last: int | None = None) -> Callable[[Column], Column]:
        """Whether a key of the universe is listed, for keys of the shards from ``first``
        to before ``last``; false for others. The first level it fails decides."""
        last = self.shards if last is None else last

        def test(key: Column) -> Column:
            shard = self.shard(key)
            found = F.lit(len(self.levels) % 2 == 1)
            for k, level in reversed(list(enumerate(self.levels))):
                found = F.when(~passes(key, k, _literal(level, first, last, shard)), F.lit(k % 2 == 1)).otherwise(found)
            return found & shard.between(first, last - 1)

        return test


def cascade(universe: DataFrame, listed: DataFrame, shard_keys: int = SHARD_KEYS) -> Cascade:
    """Levels for the ``key`` column of both tables. The first is made of the list
    alone, and what of the universe passes it is all that meets the list."""
    marks = durable(listed.select("key").where("key <> ''").distinct(), "url-list")
    # Under one in a hundred of unlisted keys passes the first level, and so is in the second.
    shards = max(1, -(-max(marks.count(), universe.count() // 100) // shard_keys))
    dealt = lambda df: df.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    marks = dealt(marks)
    if marks.isEmpty():
        return Cascade(shards, ())
    levels = [_filters(marks, 0)]
    suspects = _passing(dealt(universe.select("key")), levels[0], 0, shards)
    told = marks.select("key").join(sized_broadcast(suspects.select("key")), "key", "left_semi").withColumn("listed", F.lit(True))
    known = durable(suspects.join(sized_broadcast(durable(told, "url-told")), "key", "left").select("key", "shard", F.coalesce("listed", F.lit(False)).alias("listed")), "url-suspects")
    inside, outside = known.where(~F.col("listed")), known.where("listed")
    while not inside.isEmpty():
        levels.append(_filters(inside, len(levels)))
        inside, outside = _passing(outside, levels[-1], len(levels) - 1, shards), inside
    return Cascade(shards, tuple(levels))


def _passing(keys: DataFrame, level: DataFrame, number: int, shards: int) -> DataFrame:
    """key and shard of the ``keys`` that pass a level, block of shards by block."""
    out = None
    for first in range(0, shards, PASS_SHARDS):
        last = min(first + PASS_SHARDS, shards)
        part = keys.where(F.col("shard").between(first, last - 1) & passes(F.col("key"), number, _literal(level, first, last, F.col("shard"))))
        part = durable(part, "url-passed")
        out = part if out is None else out.unionByName(part)
    return out


def judge(pages: DataFrame, rules: Sequence[str], listed: DataFrame, id_col: str = "page_id", url_col: str = "url", shard_keys: int = SHARD_KEYS) -> DataFrame:
    """id, host, path, rule, verdict, listed: the longest rule that fits decides,
    else whether the host or a domain above it is in ``listed`` (column key)."""
    parsed = pages.select(quoted(id_col).alias("id"), *(f(F.coalesce(quoted(url_col), F.lit(""))).alias(n) for n, f in (("host", host_of), ("path", path_of))))
    keys = parsed.select("host").distinct().select(F.explode(domains(F.col("host"))).alias("key")).distinct()
    found = cascade(durable(keys, "url-keys"), listed, shard_keys)
    parsed = parsed.withColumn("listed", F.lit(False))
    if found.levels:
        for first in range(0, found.shards, PASS_SHARDS):
            test = found.contains(first, min(first + PASS_SHARDS, found.shards))
            parsed = parsed.withColumn("listed", F.col("listed") | F.exists(domains(F.col("host")), test))
            if first + PASS_SHARDS < found.shards:
                parsed = durable(parsed, "url-judged")
    host, path = F.col("host"), F.col("path")
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    for r in reversed(parse_rules(rules)):
        rule = F.when(fits(r, host, path), F.lit(r.name)).otherwise(rule)
        verdict = F.when(fits(r, host, path), F.lit(r.verdict)).otherwise(verdict)
    return parsed.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"), "listed")
