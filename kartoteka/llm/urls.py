"""URL filters: rules on hosts and paths, found by one sorted sweep.

A host with its labels reversed and closed by a dot (`org.example.www.`) makes every rule an
interval of keys: a host and all its subdomains lie side by side. Pages and rules are dealt by
ranges of keys; a rule goes to each range that its interval meets, so that ranges are swept
alone. Within a range all rows are sorted by key, rules before pages, and the sweep keeps a
stack of the rules whose interval is open; intervals of hosts are nested or apart, so that a
stack is enough. Rules of the same host share one entry, sorted by path, and the rules that a
path starts with are found by looking up its prefixes of the lengths that occur there.

Keys are followed by the path and a hash of the page, so that a host or url with a third of all
rows is split over many ranges. Cuts come from a bounded sample of keys; they steer the sizes of
ranges and never the result.

Defined results: a url that is null or without `://` has an empty host and path and no rule; of
equal longest rules `block` wins; equal rows get equal verdicts; with no rules every page gets
the default verdict. Columns besides `page_id` and `url` are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 4_000  # keys that the cuts are taken from, at most
ROWS_PER_RANGE = 200_000
MIN_RANGES, MAX_RANGES = 16, 2_000
DEFAULT = "allow"


def lower_ascii(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """What follows the first `://`, up to `/`, `?`, `#` or the end; empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.coalesce(lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse, each followed by a dot."""
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit("."))


def _sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    """Rows arrive by range and key, rules first. The stack holds (end of interval, host, actions by path, lengths of paths)."""
    stack: list[tuple[str, str, dict[str, str], list[int]]] = []
    current = None
    for batch in batches:
        columns = batch.to_pydict()
        out: dict[str, list] = {"page_id": [], "host": [], "path": [], "rule": [], "verdict": []}
        for where, key, until, page, host, path, action in zip(
                columns["part"], columns["key"], columns["until"], columns["page_id"],
                columns["host"], columns["path"], columns["action"], strict=True):
            if where != current:
                stack, current = [], where
            while stack and key >= stack[-1][0]:
                stack.pop()
            if action is not None:
                if not stack or stack[-1][1] != host:
                    stack.append((until, host, {}, []))
                *_, rules, lengths = stack[-1]
                if path not in rules or action == "block":
                    rules[path] = action
                if len(path) not in lengths:
                    lengths.append(len(path))
                continue
            best: tuple[int, bool, str | None, str] = (-1, False, None, default)
            for _, name, rules, lengths in stack:
                for n in lengths:
                    if n <= len(path) and (found := rules.get(path[:n])) is not None:
                        best = max(best, (len(name) + n, found == "block", name + path[:n], found), key=lambda b: b[:2])
            for name, value in zip(out, (page, host, path, best[2], best[3]), strict=True):
                out[name].append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["page_id"], batch.schema.field("page_id").type), *[pa.array(out[c], pa.string()) for c in list(out)[1:]]], list(out))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, the longest rule that fits (else null) and its verdict (else `default`).

    `rules` has host, path (starting with a slash) and action (allow or block).
    """
    split = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    keyed = split.withColumn("key", F.concat(host_key(F.col("host")), F.col("path"), F.lit("\u0000"), F.hex(F.xxhash64("page_id"))))
    rows = keyed.count()
    ranges = min(MAX_RANGES, max(MIN_RANGES, -(-rows // ROWS_PER_RANGE)))
    found = (keyed.select("key").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).orderBy("key").collect()) if rows else []
    keys = [r.key for r in found]
    cuts = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []

    key, until = host_key(lower_ascii(F.col("host"))), F.regexp_replace(host_key(lower_ascii(F.col("host"))), r"\.$", "/")
    intervals = (rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("action").isin("allow", "block"))
                 .select(lower_ascii(F.col("host")).alias("host"), "path", "action", key.alias("key"), until.alias("until")).distinct())
    return sweep_ranges(keyed, intervals, cuts, default)


def _part(cuts: Sequence[str]):
    """Number of the range that a key lies in."""
    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return keys.map(lambda key: bisect_right(cuts, key)).astype("int32")

    return of


def sweep_ranges(keyed: DataFrame, intervals: DataFrame, cuts: Sequence[str], default: str) -> DataFrame:
    """Deal pages by range and rules to all ranges they meet, then sweep each range."""
    part = _part(list(cuts))
    id_type = keyed.schema["page_id"].dataType
    pages = keyed.select(part("key").alias("part"), "key", F.lit(None).cast("string").alias("until"), "page_id", "host", "path",
                         F.lit(None).cast("string").alias("action"))
    opened = (intervals.withColumn("part", F.explode(F.sequence(part("key"), part("until"))))
              .select("part", "key", "until", F.lit(None).cast(id_type).alias("page_id"), "host", "path", "action"))
    dealt = (pages.unionByName(opened).repartition(len(cuts) + 1, "part")
             .sortWithinPartitions("part", "key", F.col("action").isNull(), "host", "path", "action"))
    return dealt.mapInArrow(lambda batches: _sweep(batches, default),
                            f"page_id {id_type.simpleString()}, host string, path string, rule string, verdict string")
