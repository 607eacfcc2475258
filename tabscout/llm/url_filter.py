"""URL rules as a sort-merge range join.

A host's labels, turned round and each ended by a dot, make a key. All hosts under a
rule's host then form one interval of keys, and the intervals of rules nest or are apart.
Rules and urls are range-partitioned and sorted together, a rule going to every partition
that its interval meets; a sweep keeps the stack of rules whose interval is open.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
#: Keys sampled for each partition to place the bounds between partitions; they decide balance only.
SAMPLED_KEYS = 40
BEYOND = "\U0010ffff"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where no `://` is."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + F.lit(3), F.length(text))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def host_key(host: Column) -> Column:
    """The labels from last to first, each with a dot after it."""
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit("."))


class Level:
    """The rules of one host, by their path."""

    def __init__(self, key: str) -> None:
        self.key, self.paths, self.lengths = key, {}, []

    def add(self, path: str, rule: str, verdict: str) -> None:
        if path not in self.paths or verdict == BLOCK:
            self.paths[path] = (rule, verdict)
            self.lengths = sorted({*self.lengths, len(path)}, reverse=True)

    def longest(self, path: str) -> tuple[str, str] | None:
        for n in self.lengths:
            if n <= len(path) and path[:n] in self.paths:
                return self.paths[path[:n]]
        return None


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk rules and urls in order of part and key; only open rules are kept."""
    part, stack = None, []
    for b in batches:
        rows, rules, verdicts = [], [], []
        columns = [b.column(c).to_pylist() for c in ("part", "key", "kind", "path", "rule", "verdict")]
        for n, (p, key, kind, path, rule, verdict) in enumerate(zip(*columns)):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1].key != key:
                    stack.append(Level(key))
                stack[-1].add(path, rule, verdict)
                continue
            best = None
            for level in reversed(stack):
                got = level.longest(path)
                if got and (best is None or len(got[0]) > len(best[0])):
                    best = got
            rows.append(n)
            rules.append(best and best[0])
            verdicts.append(best[1] if best else verdict)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*[b.column(c).take(at) for c in ("id", "host", "path")], pa.array(rules, pa.string()),
             pa.array(verdicts, pa.string())], ["id", "host", "path", "rule", "verdict"])


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
          default: str = ALLOW) -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict.

    rules has host, path, verdict. A rule fits its host and all hosts below it, if the
    url's path starts with its path; an empty host fits all, a null host or path is
    empty. The longest rule wins, counted in characters of host and path, of equally
    long ones that of the longer host; of rules with the same host and path a block
    wins. Without a rule the verdict is `default` and rule is null. Null urls and urls
    without `://` have an empty host and path. Repeated rows are judged one by one."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(f"`{url_col}`"))
    urls = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"))
    salt = F.xxhash64("path", F.col("id").cast("string"))
    urls = urls.select("id", "host", "path", host_key(F.col("host")).alias("key"), salt.alias("salt"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = urls.count()
    share = min(1.0, SAMPLED_KEYS * parts / max(n, 1))
    keys = sorted((r["key"], r["salt"]) for r in urls.select("key", "salt").sample(share, seed=1).collect())
    bounds = sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []

    def part_of(key: pa.Array, salts: pa.Array) -> pa.Array:
        return pa.array([bisect_right(bounds, k) for k in zip(key.to_pylist(), salts.to_pylist())], pa.int32())

    def parts_met(key: pa.Array) -> pa.Array:
        least, most = -(1 << 63), (1 << 63) - 1
        return pa.array([list(range(bisect_right(bounds, (k, least)), bisect_left(bounds, (k + BEYOND, most)) + 1))
                         for k in key.to_pylist()], pa.list_(pa.int32()))

    kind = urls.schema["id"].dataType.simpleString()
    none = F.lit(None).cast("string")
    events = urls.select(
        F.arrow_udf(part_of, "int")("key", "salt").alias("part"), "key", F.lit(1).alias("kind"), "id", "host", "path",
        none.alias("rule"), F.lit(default).alias("verdict"))
    rule_host = F.coalesce(F.col("host").cast("string"), F.lit(""))
    rule_path = F.coalesce(F.col("path").cast("string"), F.lit(""))
    opened = rules.select(
        F.when(rule_host == "", "").otherwise(host_key(rule_host)).alias("key"), rule_host.alias("host"),
        rule_path.alias("path"), F.concat(rule_host, rule_path).alias("rule"), F.col("verdict"))
    opened = opened.select(
        F.explode(F.arrow_udf(parts_met, "array<int>")("key")).alias("part"), "key", F.lit(0).alias("kind"),
        F.lit(None).cast(kind).alias("id"), "host", "path", "rule", "verdict")
    both = events.unionAll(opened).repartition(parts, "part").sortWithinPartitions("part", "key", "kind")
    return both.mapInArrow(sweep, f"id {kind}, host string, path string, rule string, verdict string")
