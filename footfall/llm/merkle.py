"""A Merkle manifest of a dataset: a tree of digests per source and one over all sources, built and proved by slot pivots."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm.common import ascii_lower, stored, table

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """A column as ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*columns: Column) -> Column:
    return digest(*[field(c) for c in columns])


def numbered(rows: DataFrame, order: list[str], carry: list[str]) -> DataFrame:
    """rows (``g``, order and carry columns) with ``idx``, the row's place from 0 in its group ``g`` by ``order``, and ``n``,
    the group's rows.

    Rows are dealt by ranges of (g, order), so a hot group is many parts; each part counts its groups' rows, and a
    running sum over parts gives where it begins. ``g`` is a string and never null.
    """
    sort = ["g", *order]
    names = [*dict.fromkeys([*sort, *carry])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, at = TaskContext.get().partitionId(), None, 0
        kinds = None

        def ended() -> pa.RecordBatch:
            cols = [pa.array([now if name == "g" else None], t) for name, t in kinds]
            return pa.RecordBatch.from_arrays([*cols, pa.array([part], pa.int32()), pa.array([at], pa.int64()), pa.array([True])], [*names, "part", "r", "total"])

        for b in batches:
            kinds = list(zip(names, b.schema.types, strict=True))
            r = []
            for g in b.column(0).to_pylist():
                if g != now:
                    if now is not None:
                        yield ended()
                    now, at = g, 0
                r.append(at)
                at += 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([part] * len(r), pa.int32()), pa.array(r, pa.int64()), pa.array([False] * len(r))], [*names, "part", "r", "total"]
            )
        if now is not None:
            yield ended()

    ranged = rows.select(*names).repartitionByRange(*sort).sortWithinPartitions(*sort)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields) + ", part int, r long, total boolean"
    parts = stored(ranged.mapInArrow(run, schema), "numbered")
    # Few rows a part: one for each group that has rows in it.
    sums = parts.filter("total").select("g", "part", F.col("r").alias("_n"))
    sums = sums.selectExpr("g", "part", "sum(_n) OVER (PARTITION BY g ORDER BY part) - _n AS _base", "sum(_n) OVER (PARTITION BY g) AS n")
    out = parts.filter("not total").join(stored(sums, "bases"), ["g", "part"])
    return out.select(*names, (F.col("_base") + F.col("r")).alias("idx"), "n")


def _slots(fanout: int) -> list[str]:
    return [f"c{k}" for k in range(fanout)]


def build_levels(nodes: DataFrame, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """(levels, tops) of the trees over nodes (``g``, ``idx``, ``n``, ``h``): a level has a row per parent, with ``g``, ``n``
    (nodes of the group on its children's level), ``parent`` and the children's digests in slot columns ``c0``, ``c1``, ...;
    tops has ``g``, ``level`` and ``h`` of every group's last node.

    While a group has more than one node, every ``fanout`` consecutive ones become the digest of their digests.
    Conditional aggregates put the children of a parent into its columns, combined before the shuffle; a level
    is stored once and is a ``fanout``-th of the one below.
    """
    levels, tops, level = [], [], 0
    while True:
        tops.append(nodes.filter("n = 1").select("g", F.lit(level).alias("level"), "h"))
        inner = nodes.filter("n > 1").withColumns({"parent": F.floor(F.col("idx") / fanout).cast("long"), "slot": F.col("idx") % fanout})
        pivot = inner.groupBy("g", "n", "parent").agg(*[F.max(F.when(F.col("slot") == k, F.col("h"))).alias(c) for k, c in enumerate(_slots(fanout))])
        pivot = stored(pivot, f"level-{level}")
        if pivot.isEmpty():
            break
        levels.append(pivot)
        nodes = pivot.select("g", F.ceil(F.col("n") / fanout).cast("long").alias("n"), F.col("parent").alias("idx"), F.sha2(F.concat_ws("", *_slots(fanout)), 256).alias("h"))
        level += 1
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return levels, stored(out, "tops")


def _step(slot: Column, fanout: int) -> Column:
    """The siblings of a slot, those on its left and those on its right: all slot columns but its own."""
    def joined(keep) -> Column:
        return F.concat_ws("", *[F.when(keep(F.lit(k)), F.col(c)) for k, c in enumerate(_slots(fanout))])

    return F.struct(joined(lambda k: k < slot).alias("l"), joined(lambda k: k > slot).alias("r"))


def open_levels(levels: list[DataFrame], tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The parents of the lowest level with the ``path`` above each: (``g``, ``parent``, slot columns, ``path``, ...).

    tops has ``g``, ``level``, ``path`` (siblings from the top on) and further columns, which are handed down. A
    path is an array of (l, r), the siblings left and right of the way, from below to the root. Groups of one node come as a
    row with ``parent`` 0 and null slot columns.
    """
    more = [c for c in tops.columns if c not in ("g", "level", "path")]
    above = tops.filter(F.col("level") == len(levels)).select("g", F.lit(0).cast("long").alias("idx"), "path", *more)
    for level in range(len(levels) - 1, -1, -1):
        rows = levels[level].join(above.withColumnRenamed("idx", "parent"), ["g", "parent"])
        if level == 0:
            lone = tops.filter("level = 0").select("g", F.lit(0).cast("long").alias("parent"), *[F.lit(None).cast("string").alias(c) for c in _slots(fanout)], "path", *more)
            return rows.select("g", "parent", *_slots(fanout), "path", *more).unionByName(lone)
        child = rows.select("*", F.posexplode(F.array(*_slots(fanout))).alias("slot", "h")).filter("h is not null")
        below = child.select(
            "g", (F.col("parent") * fanout + F.col("slot")).alias("idx"), F.concat(F.array(_step(F.col("slot"), fanout)), F.col("path")).alias("path"), *more
        )
        ended = tops.filter(F.col("level") == level).select("g", F.lit(0).cast("long").alias("idx"), "path", *more)
        above = stored(below.unionByName(ended), f"paths-{level}")
    return above.select("g", F.col("idx").alias("parent"), *[F.lit(None).cast("string").alias(c) for c in _slots(fanout)], "path", *more)


def with_paths(nodes: DataFrame, opened: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """nodes (``g``, ``idx``, ...) with ``path`` and what the tops hand down: joined by parent, at most ``fanout`` nodes a key."""
    keep = [c for c in opened.columns if c not in ("g", "parent", "path", *_slots(fanout))]
    rows = nodes.withColumn("parent", F.floor(F.col("idx") / fanout).cast("long")).join(opened, ["g", "parent"])
    own = F.concat(F.array(_step(F.col("idx") % fanout, fanout)), F.col("path"))
    path = F.when(F.col("c0").isNull(), F.col("path")).otherwise(own)
    return rows.select(*nodes.columns, path.alias("path"), *keep)


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its way."""
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(x["l"], acc, x["r"]), 256))


def siblings(path: Column) -> Column:
    """The digests of all siblings on the way, level by level from below, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["l"], x["r"])), "")


def manifest(
    docs: DataFrame, columns: tuple[str, ...] = COLUMNS, key: str = "doc_id", group: str = "source", fanout: int = FANOUT,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per row of docs: ``key``, ``leaf``, ``subroot``, ``root``, ``path`` and the columns of ``extra``.

    The leaf is the digest of ``columns`` (``leaf_digest``). Leaves of a ``group`` ascend by key (nulls first, then by leaf, so
    rows that share a key have a fixed place) and are built up to its subroot; subroots ascend by group (null first, then by
    UTF-8 bytes) and are built up to the root. ``fold(leaf, path)`` gives the root and ``siblings(path)`` the
    proof. Only digests are shuffled: each row once by range and once by parent, each upper level once up and once down.

    Nulls count as ``-`` in a leaf, empty texts as ``0:``; equal rows are leaves of their own; a null group is a group;
    columns not named take no part, whatever they are called; an empty table gives an empty result.
    """
    more = {f"_x{i}": c for i, c in enumerate((extra or {}).values())}
    g = F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit("n"))  # n, the null group, comes before s...
    rows = docs.select(g.alias("g"), F.col(key).alias("k"), leaf_digest(*[F.col(c) for c in columns]).alias("h"), *[c.alias(n) for n, c in more.items()])
    leaves = stored(numbered(rows, ["k", "h"], list(more)), "leaves")
    levels, tops = build_levels(leaves.select("g", "idx", "n", "h"), fanout)
    # The subroots are the leaves of one more tree.
    heads = stored(numbered(tops.select(F.lit("").alias("g"), F.col("g").alias("name"), "level", "h"), ["name"], ["level", "h"]), "heads")
    upper, top = build_levels(heads.select("g", "idx", "n", "h"), fanout)
    none = F.array().cast("array<struct<l:string,r:string>>")
    opened = open_levels(upper, top.select("g", "level", none.alias("path"), F.col("h").alias("root")), fanout)
    named = with_paths(heads, opened, fanout).select(F.col("name").alias("g"), "level", "path", F.col("h").alias("subroot"), "root")
    opened = open_levels(levels, stored(named, "subroots"), fanout)
    out = with_paths(leaves, opened, fanout)
    return out.select(F.col("k").alias(key), F.col("h").alias("leaf"), "subroot", "root", "path", *[F.col(f"_x{i}").alias(n) for i, n in enumerate(extra or {})])


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and the root that a tampered copy of a fifth of them folds to."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    tampered = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, F.lit(False))
    changed = leaf_digest(*[ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in COLUMNS])
    out = manifest(docs, extra={"changed": F.when(tampered, changed)})
    folded = out.withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("path")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _op13_sql(levels: int = 8) -> str:
    """The same in DuckDB, for groups of up to 16 to the power of ``levels`` rows."""
    def item(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(item(text if c == "text" else c) for c in COLUMNS) + ")"

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = (  # a byte is taken in, then shifted out bit by bit
        "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
        "lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), "
        "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295)"
    )
    out = [
        f"d AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS changed FROM documents)",
        "o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM d)",
        "l0 AS (SELECT coalesce('s' || source, 'n') AS g, idx, n, leaf AS h FROM o)",
    ]

    def tree(at: str) -> None:
        for i in range(levels):
            out.append(f"{at}p{i} AS (SELECT g, n, idx // 16 AS idx, list(h ORDER BY idx) AS hs FROM {at}{i} WHERE n > 1 GROUP BY g, n, idx // 16)")
            out.append(f"{at}{i + 1} AS (SELECT g, idx, (n + 15) // 16 AS n, sha256(array_to_string(hs, '')) AS h FROM {at}p{i})")
        out.append(f"{at}top AS (" + " UNION ALL ".join(f"SELECT g, h FROM {at}{i} WHERE n = 1" for i in range(levels + 1)) + ")")

    def climb(at: str, start: str) -> str:
        """Of rows (id, g, i, f, proof): one level up after the other; without a parent nothing changes."""
        for i in range(levels):
            out.append(
                f"{start}{at}{i} AS (SELECT x.id, x.g, x.i // 16 AS i, "
                "CASE WHEN hs IS NULL THEN f ELSE sha256(array_to_string(hs[1:x.i % 16], '') || f || array_to_string(hs[x.i % 16 + 2:], '')) END AS f, "
                "CASE WHEN hs IS NULL THEN proof ELSE proof || array_to_string(hs[1:x.i % 16], '') || array_to_string(hs[x.i % 16 + 2:], '') END AS proof "
                f"FROM {start if i == 0 else f'{start}{at}{i - 1}'} x LEFT JOIN {at}p{i} p ON p.g = x.g AND p.idx = x.i // 16)"
            )
        return f"{start}{at}{levels - 1}"

    tree("l")
    out.append("u0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n, h, g AS name FROM ltop)")
    tree("u")
    out.append("q AS (SELECT row_number() OVER () AS id, coalesce('s' || source, 'n') AS g, idx AS i, changed AS f, '' AS proof, doc_id, leaf FROM o)")
    last = climb("l", "q")
    out.append(f"v AS (SELECT x.id, '' AS g, u0.idx AS i, x.f, x.proof FROM {last} x JOIN u0 ON u0.name = x.g)")
    last = climb("u", "v")
    return "WITH " + ",\n".join(out) + (
        "\nSELECT q.doc_id, q.leaf, t.h AS subroot, r.h AS root, sha256(x.proof) AS proof_sha256, x.f AS folded_root, x.f = r.h AS verified\n"
        f"FROM q JOIN {last} x ON x.id = q.id JOIN ltop t ON t.g = q.g CROSS JOIN utop r"
    )


OP13_SQL = _op13_sql()
