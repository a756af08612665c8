"""URL filters: prefix rules found by a sorted sweep over reversed-host keys.

A host turned round label by label (``net.example.www.``) makes a host and its subdomains one interval of keys. Rows
are range-partitioned and sorted by that key; a sweep goes through rows and rules in step and keeps the rules whose
intervals hold the current key on a stack, outer below inner. The row then takes the longest active rule that its
path starts with.
"""

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import functions as F

#: Rules that one sweep takes along; a longer list is swept in blocks of so many, block by block.
BLOCK_RULES = 100_000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self):
        return self.host + self.path


def host_and_path(url):
    """Columns for host (A-Z lower-cased) and path; both empty without ``://``."""
    value = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.regexp_extract(value, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def host_key(host):
    """``www.example.net`` as ``net.example.www.``: subdomains follow their domain and share its key as prefix."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def reversed_host(host):
    return ".".join(reversed(host.split("."))) + "."


def intervals(rules):
    """Rules by host key, for each key its rules longest first; equal rules: the first verdict in block, allow order."""
    by_key = {}
    for rule in rules:
        by_key.setdefault(reversed_host(rule.host), []).append(rule)
    ranked = {k: sorted(v, key=lambda r: (-len(r.path), r.verdict != "block", r)) for k, v in by_key.items()}
    return sorted((k.encode(), [(r.path, len(r.text), r.text, r.verdict) for r in v]) for k, v in ranked.items())


def sweep(ordered):
    """A function over Arrow batches sorted by the column ``key``; adds rule and verdict, keeps longer earlier finds."""

    def run(batches):
        stack, at = [], 0  # a partition is one sorted run
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            rules, verdicts = columns["rule"].to_pylist(), columns["verdict"].to_pylist()
            for i, (key, path) in enumerate(zip(columns["key"].to_pylist(), columns["path"].to_pylist())):
                key = key.encode()
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                while at < len(ordered) and ordered[at][0] <= key:
                    if key.startswith(ordered[at][0]):
                        stack.append(ordered[at])
                    at += 1
                found = None
                for _, here in stack:  # outer to inner: of equally long rules the inner one stays
                    for rule_path, length, text, verdict in here:
                        if path.startswith(rule_path):
                            if found is None or length >= found[0]:
                                found = (length, text, verdict)
                            break
                if found and (rules[i] is None or found[0] >= len(rules[i])):
                    rules[i], verdicts[i] = found[1], found[2]
            columns["rule"], columns["verdict"] = pa.array(rules, pa.string()), pa.array(verdicts, pa.string())
            yield pa.RecordBatch.from_arrays([columns[n] for n in batch.schema.names], names=batch.schema.names)

    return run


def judge_urls(df, rules, key="page_id", url="url", default="allow"):
    """Rows (key, host, path, rule, verdict) for every row of ``df``.

    ``rules`` are (verdict, host, path) triples. A rule fits its host and all subdomains if the path starts with the
    rule's; the longest (host and path together) wins, of equally long ones the inner host, of equal ones ``block``.
    Without a rule: ``rule`` is null and the verdict ``default``. Null urls and urls without ``://`` have an empty host
    and path, which a rule with a non-empty host never fits. Repeated rows are judged each. An empty table or an empty
    list of rules is fine. Other columns are not looked at. Rules beyond ``BLOCK_RULES`` are swept in blocks; the
    blocks are cut in key order, so each has its own interval of hosts and outer hosts may stand in another block.
    """
    host, path = host_and_path(F.col(f"`{url}`"))
    split = df.select(F.col(f"`{key}`").alias("id"), host.alias("host"), path.alias("path"))
    keyed = split.select(
        "*", host_key(F.col("host")).alias("key"),
        F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"),
    )
    order = ["key", "path", "id"]  # the path and the id split hosts with very many rows
    rows = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = intervals([Rule(*r) for r in rules])
    for lo in range(0, len(ordered), BLOCK_RULES):
        rows = rows.mapInArrow(sweep(ordered[lo : lo + BLOCK_RULES]), keyed.schema)
    return rows.select(F.col("id").alias(key), "host", "path", "rule", "verdict")
