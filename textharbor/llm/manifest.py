"""Merkle manifest of a dataset: digests of rows, joined eight by eight into one root, with a proof for every row.

Rows of a part (here: a language) are leaves, ranked by key. A node is labelled by the interval of leaf ranks it covers
and by its level; ``FANOUT`` consecutive nodes of a level share a parent, whose interval contains theirs. Going up,
every level is one aggregation of what is left, an eighth of the level below. Going down, the nodes of a level find their
parent by a join on part and bucket (where the interval starts, divided by the width of the parent's level) under the
condition that the parent's interval contains theirs; what the parent's interval holds beside a node's own are its
siblings. A row of a level carries the siblings of all its ancestors, so only one eighth of the leaves' number ever
does. Subroots of the parts are leaves of a last tree, built alike.

Neither the number of rows of a part nor that of parts is bounded: ranks come from prefix sums over sorted ranges, no
group has more than ``FANOUT`` members. Texts are read once, to be digested.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textharbor.llm.common import nulls_first, prefix_sums, sorted_ranges
from textharbor.session import write_and_read

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_STEPS = "array<struct<left: string, right: string>>"


def digest(*values):
    """Lower-case hexadecimal SHA-256 of strings put together."""
    return F.sha2(F.concat(*values), 256)


def leaf_digest(values):
    """Digest of a row: of each value its bytes in UTF-8 counted, a colon and the value; ``-`` for a null."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings, level by level, lead to."""
    return F.aggregate(steps, leaf, lambda below, s: digest(s["left"], below, s["right"]))


def proof_digest(steps: Column) -> Column:
    """Digest of all siblings in the order in which they are needed."""
    sides = F.transform(steps, lambda s: F.concat(s["left"], s["right"]))
    return F.sha2(F.array_join(sides, ""), 256)


class Manifest(NamedTuple):
    """Runs of siblings by level, from the leaves up, of the parts and of the tree over their subroots."""

    levels: list
    top: list

    def nodes(self) -> DataFrame:
        """Rows (part, level, lo, hi, digest) of all nodes of the parts, leaves included."""
        tables = [
            runs.select("part", F.lit(level).alias("level"), F.explode("children").alias("c")).select(
                "part", "level", "c.lo", "c.hi", "c.digest"
            )
            for level, runs in enumerate(self.levels)
        ]
        found = tables[0]
        for table in tables[1:]:
            found = found.unionByName(table)
        return found


def _ranked(leaves, label):
    """``leaves`` (part, id, digest, ...) with ``lo`` and ``hi``, the rank within the part counting from 0."""
    order = nulls_first(*[c for c in leaves.columns if c != "part"])
    ranged = sorted_ranges(leaves, [*nulls_first("part"), *order], label)
    summed = prefix_sums(ranged.withColumn("one", F.lit(1).cast("long")), order, ["one"], group=["part"])
    return summed.drop("one", "pid").withColumnRenamed("before_one", "lo").withColumn("hi", F.col("lo"))


def _single(runs):
    """Runs that hold the only node of their part at this level, its subroot: the first run fills before any other."""
    return (F.col("bucket") == 0) & (F.size("children") == 1)


def _grow(leaves, label):
    """A written table of runs (part, bucket, children) for every level."""
    nodes, levels, width = _ranked(leaves, label), [], FANOUT
    while True:
        members = F.struct("lo", *[c for c in nodes.columns if c not in ("part", "lo")])
        grouped = nodes.groupBy("part", F.expr(f"lo div {width}").alias("bucket"))
        runs = write_and_read(grouped.agg(F.sort_array(F.collect_list(members)).alias("children")), f"{label}-runs")
        levels.append(runs)
        rest = runs.filter(~_single(runs))
        if rest.isEmpty():
            return levels
        nodes = rest.select(
            "part",
            F.col("children")[0]["lo"].alias("lo"),
            F.element_at("children", -1)["hi"].alias("hi"),
            F.sha2(F.array_join("children.digest", ""), 256).alias("digest"),
        )
        width *= FANOUT


def _side(children, apart):
    """Digests of those children whose interval lies on one side."""
    return F.array_join(F.transform(F.filter(children, apart), lambda c: c["digest"]), "")


def _descend(levels, tops):
    """Rows (part, child, subroot, root, steps) of the leaves; ``tops`` (part, root, steps) continues at the subroots.

    Without ``tops`` the subroot is the root.
    """
    above = None
    for level in range(len(levels) - 1, -1, -1):
        runs, width = levels[level], FANOUT ** (level + 1)
        done = runs.filter(_single(runs)).select("part", F.col("children")[0].alias("child"))
        if tops is None:
            root, steps = F.col("child.digest"), F.array().cast(_STEPS)
            found = done.select("part", "child", F.col("child.digest").alias("subroot"), root.alias("root"), steps.alias("steps"))
        else:
            on = F.col("d.part").eqNullSafe(F.col("t.part"))
            found = done.alias("d").join(tops.alias("t"), on).select(
                "d.part", "d.child", F.col("d.child.digest").alias("subroot"), "t.root", "t.steps"
            )
        if above is not None:
            run = runs.filter(~_single(runs)).alias("r")
            parent = above.select(
                "part", "child.lo", "child.hi", "subroot", "root", "steps", F.expr(f"child.lo div {width}").alias("bucket")
            ).alias("p")
            contained = (F.col("p.lo") <= F.col("r.children")[0]["lo"]) & (
                F.element_at("r.children", -1)["hi"] <= F.col("p.hi")
            )
            same = F.col("r.part").eqNullSafe(F.col("p.part")) & (F.col("r.bucket") == F.col("p.bucket"))
            inner = run.join(parent, same & contained).select(
                "r.part", "r.children", F.explode("r.children").alias("child"), "p.subroot", "p.root", "p.steps"
            )
            step = F.struct(
                _side(F.col("children"), lambda c: c["hi"] < F.col("child.lo")).alias("left"),
                _side(F.col("children"), lambda c: c["lo"] > F.col("child.hi")).alias("right"),
            )
            inner = inner.select("part", "child", "subroot", "root", F.concat(F.array(step), "steps").alias("steps"))
            found = found.unionByName(inner)
        above = found
    return above


def build(leaves):
    """The manifest of ``leaves``: rows (part, id, digest) and any further columns, which stay with the leaf.

    Leaves of a part are ranked by id (nulls first), equal ids by digest and further columns. A null part is a part,
    before all others.
    """
    leaves = write_and_read(leaves, "manifest-leaves")  # ranges are sampled first: no second pass over the texts
    levels = _grow(leaves, "manifest")
    subroots = None
    for runs in levels:
        table = runs.filter(_single(runs)).select("part", F.col("children")[0]["digest"].alias("digest"))
        subroots = table if subroots is None else subroots.unionByName(table)
    subroots = subroots.select(F.lit(0).alias("part"), F.col("part").alias("id"), "digest")
    return Manifest(levels, _grow(subroots, "manifest-top"))


def proofs(manifest):
    """Rows (part, leaf, subroot, root, steps): ``leaf`` is a struct of the leaf's columns, ``steps`` its siblings."""
    top = _descend(manifest.top, None)
    tops = top.select(F.col("child.id").alias("part"), "root", "steps")
    return _descend(manifest.levels, tops).withColumnRenamed("child", "leaf")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def tamper_report(df, key="doc_id", part="lang", fields=FIELDS, text="text"):
    """Rows (key, leaf, subroot, root, proof_sha256, folded_root, verified): does tampering with texts show?

    The manifest is that of ``df``. Rows whose key has a CRC-32 (of its decimal form) divisible by 3 are then tampered
    with: capital letters A-Z of the text become small. The leaf recomputed from the row as it is then, folded with the
    manifest's siblings, gives ``folded_root``; the row is verified if that is the root.

    A null key is no number and is not tampered with; a null or empty text cannot change. Nulls count as ``-`` in a
    leaf. Repeated rows are leaves each; rows with equal keys are ranked by their digests. A part with one row is its
    own subroot, a table with one part has that part's subroot as root, an empty table gives an empty result. Columns
    beyond ``fields`` are not looked at.
    """
    columns = {name: F.col(f"`{name}`") for name in fields}
    tampered = F.crc32(columns[key].cast("string").cast("binary")) % 3 == 0
    lowered = F.translate(columns[text].cast("string"), _UPPER, _UPPER.lower())
    original = leaf_digest(list(columns.values()))
    changed = leaf_digest([lowered if name == text else value for name, value in columns.items()])
    leaves = df.select(
        F.col(f"`{part}`").alias("part"), columns[key].alias("id"), original.alias("digest"),
        F.when(tampered, changed).alias("changed"),
    )
    proven = proofs(build(leaves))
    result = proven.select(
        F.col("leaf.id").alias(key), F.col("leaf.digest").alias("leaf"), "subroot", "root",
        proof_digest(F.col("steps")).alias("proof_sha256"),
        folded(F.coalesce("leaf.changed", "leaf.digest"), F.col("steps")).alias("folded_root"),
    )
    return result.withColumn("verified", F.col("folded_root") == F.col("root"))
