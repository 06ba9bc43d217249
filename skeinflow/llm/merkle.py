"""A Merkle manifest of a dataset: digests of rows, trees by group collapsed in blocks of ordered arrays, proofs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinflow.llm.base import own, quoted, staged

#: Levels that one block collapses: 2**8 nodes are the largest array.
BLOCK_BITS = 8
BLOCK = 1 << BLOCK_BITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(value: Column) -> Column:
    """Lowercase hex sha256."""
    return F.sha2(value, 256)


def leaf_digest(values: list[Column]) -> Column:
    """The digest of a row: each value as '-' if null, else its UTF-8 length, ':' and itself (integers as decimals)."""

    def field(v: Column) -> Column:
        v = v.cast("string")
        return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))

    return digest(F.concat(*map(field, values)))


def collapsed(nodes: Column) -> Column:
    """One level up: the digest of every two consecutive nodes, the last one's alone if their number is odd."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: digest(F.array_join(F.slice(nodes, 2 * i + 1, 2), "")))


def levels_of(nodes: Column, levels: Column) -> Column:
    """The nodes (an ordered array, at least one) and so many levels above them, each an array."""
    turns = F.slice(F.sequence(F.lit(1), F.lit(BLOCK_BITS)), F.lit(1), levels)
    return F.aggregate(turns, F.array(nodes), lambda up, _: F.concat(up, F.array(collapsed(F.element_at(up, -1)))))


def path_in(levels: Column, at: Column) -> Column:
    """What stands beside node at on each level below the last: structs of left and right, null where nothing does."""

    def beside(level: Column) -> Column:
        j = F.call_function("shiftright", at, level)
        nodes = F.get(levels, level)
        return F.struct(F.when(j % 2 == 1, F.get(nodes, j - 1)).alias("left"), F.when(j % 2 == 0, F.get(nodes, j + 1)).alias("right"))

    return F.transform(F.slice(F.sequence(F.lit(0), F.lit(BLOCK_BITS - 1)), F.lit(1), F.size(levels) - 1), beside)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and what stands beside its way up lead to."""
    none = F.lit("")
    return F.aggregate(path, leaf, lambda a, p: digest(F.concat(F.coalesce(p["left"], none), a, F.coalesce(p["right"], none))))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings on the way up."""
    return digest(F.array_join(F.transform(path, lambda p: F.coalesce(p["left"], p["right"], F.lit(""))), ""))


def positions(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with pos, from 0 within the group by order (nulls first), and total, the group's rows.

    Rows are dealt by ranges and sorted there; a row's place is its running number in its range plus the counts of the
    group's ranges before, so that a group of any size is spread over tasks. The order must leave no ties.
    """
    g = F.col(group)
    placed = staged(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("__range", F.shiftright("__at", 33))
    runs = placed.groupBy(g.alias("__g"), F.col("__range").alias("__r")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    w = Window.partitionBy("__g")
    before = F.coalesce(F.sum("__n").over(w.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("__g", "__r", "__first", before.alias("__before"), F.sum("__n").over(w).alias("total"))
    out = placed.join(runs, g.eqNullSafe(F.col("__g")) & (F.col("__range") == F.col("__r")))
    return out.withColumn("pos", F.col("__before") + F.col("__at") - F.col("__first")).drop("__at", "__range", "__g", "__r", "__first", "__before")


def collapse(nodes: DataFrame, group: str, node: str = "node") -> list[DataFrame]:
    """The tree of each group as tables of blocks, from the leaves up; the last has one block for each group.

    nodes: group, pos, total, node (a digest), and columns to carry. A table's rows are (group, block, total, items: the
    nodes' carried columns by pos, levels). Each table is made from the roots of the one below, and has 1/256 of its
    nodes; blocks collapse as many levels in one expression, a group's only block as many as it needs.
    """
    tables, carried = [], [c for c in nodes.columns if c not in (group, "pos", "total")]
    while True:
        items = F.array_sort(F.collect_list(F.struct("pos", *carried)))
        blocks = nodes.groupBy(F.col(group), F.shiftright("pos", BLOCK_BITS).alias("block"), F.col("total")).agg(items.alias("items"))
        need = F.when(F.col("total") > BLOCK, BLOCK_BITS).when(F.col("total") > 1, F.length(F.bin(F.col("total") - 1))).otherwise(0)
        # Written, so that levels are a column: within an expression they would be made again for each item.
        tables.append(staged(blocks.withColumn("levels", levels_of(F.transform("items", lambda x: x[node]), need)), "blocks"))
        if not tables[-1].where(F.col("total") > BLOCK).limit(1).count():
            return tables
        carried = [node]
        nodes = tables[-1].select(group, F.col("block").alias("pos"), F.ceil(F.col("total") / BLOCK).alias("total"), _top().alias(node))


def _top() -> Column:
    return F.element_at(F.element_at("levels", -1), 1)


def subroots(tables: list[DataFrame], group: str, name: str = "subroot") -> DataFrame:
    return tables[-1].select(group, _top().alias(name))


def proofs(tables: list[DataFrame], group: str, above: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(group, what the leaves carry, path) for each leaf, and carry of above.

    above: for each group the path of its root further up, (group, path, carry). Paths go down from table to table: a
    block's path is handed to its at most 256 items, so that no join has a hot key.
    """
    up = above.withColumn("pos", F.lit(0).cast("long")) if above is not None else None
    for table in reversed(tables):
        rows = table.withColumn("__above", F.lit(None).cast("array<struct<left: string, right: string>>"))
        if up is not None:
            over = up.select(F.col(group).alias("__g"), F.col("pos").alias("__pos"), F.col("path").alias("__above"), *carry)
            rows = table.join(over, F.col(group).eqNullSafe(F.col("__g")) & (F.col("block") == F.col("__pos")))
        none = F.array().cast("array<struct<left: string, right: string>>")
        names = [f.name for f in table.schema["items"].dataType.elementType.fields if f.name != "pos"]
        item = lambda x, i: F.struct(x["pos"].alias("pos"), *(x[n].alias(n) for n in names), path_in(F.col("levels"), i).alias("__own"))
        rows = rows.select(group, F.coalesce("__above", none).alias("__above"), *(carry if up is not None else ()), F.inline(F.transform("items", item)))
        up = rows.withColumn("path", F.concat("__own", "__above")).drop("__own", "__above")
    return up.drop("pos")


@dataclass
class Manifest:
    """proofs: group, leaf, carried columns, subroot and path for each row; subroots: (group, subroot); root: null without rows."""

    proofs: DataFrame
    subroots: DataFrame
    root: str | None


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, carry: dict[str, Column] | None = None) -> Manifest:
    """The Merkle manifest of docs: leaves of the fields, a tree for each group by key, a tree over the groups' roots.

    Rows that share group and key stand by their leaves, equal ones anyhow; null keys are first in their group; a null
    group is a group, the first. carry: further columns of the proofs, as expressions over docs; a name that key or group
    has gets a _; other columns, whatever their names, are not looked at. Texts are read once and go no further than their digest.
    """
    carry = carry or {}
    names = {name: f"__c{i}" for i, name in enumerate(carry)}
    leaves = docs.select(F.col(quoted(group)).alias("__group"), F.col(quoted(key)).alias("__key"), leaf_digest([F.col(quoted(f)) for f in fields]).alias("node"), *(c.alias(names[n]) for n, c in carry.items()))
    leaves = staged(leaves.withColumn("__row", F.monotonically_increasing_id()), "leaves")
    trees = collapse(positions(leaves, "__group", ["__key", "node", "__row"]).drop("__row"), "__group")
    subs = staged(subroots(trees, "__group", "node"), "subroots")
    over = collapse(positions(subs.withColumn("__all", F.lit(0)), "__all", ["__group"]), "__all")
    root = next((r.subroot for r in subroots(over, "__all").collect()), None)
    above = proofs(over, "__all").select("__group", "path", F.col("node").alias("subroot"))
    given = dict(zip(("leaf", "subroot", "path", *carry), own(docs.select(quoted(key), quoted(group)), "leaf", "subroot", "path", *carry), strict=True))
    out = proofs(trees, "__group", above, ("subroot",))
    out = out.select(F.col("__key").alias(key), F.col("__group").alias(group), F.col("node").alias(given["leaf"]), F.col("subroot").alias(given["subroot"]), F.col("path").alias(given["path"]), *(F.col(names[n]).alias(given[n]) for n in carry))
    return Manifest(out, subs.select(F.col("__group").alias(group), F.col("node").alias(given["subroot"])), root)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's leaf, its language's root, the root, its proof, and the root that it leads to when some are changed.

    Rows that share language and id are ordered by their leaves; a null id comes first and is never changed; null
    languages are one, the first; null or empty fields have leaves of their own; no documents give no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    other = leaf_digest([F.col("n_chars") + 1 if f == "n_chars" else F.col(f) for f in FIELDS])
    made = manifest(docs, carry={"found": F.when(changed, other)})
    root = F.lit(made.root).cast("string")
    out = made.proofs.select("doc_id", "leaf", "subroot", root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("found", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _leaf_sql(n_chars: str) -> str:
    field = lambda x: f"coalesce(strlen({x}::varchar)::varchar || ':' || {x}::varchar, '-')"
    return "sha256(" + " || ".join(field(n_chars if f == "n_chars" else f) for f in FIELDS) + ")"


#: crc32 of ASCII digits, bit by bit; the reversed polynomial 0xEDB88320.
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: case when v % 2 = 1 then xor(v >> 1, 3988292384) else v >> 1 end)), 4294967295)"""
ORACLE = f"""
with recursive d as (select row_number() over () as rid, doc_id, lang, {_leaf_sql("n_chars")} as leaf, case when {_CRC} % 7 = 0 then {_leaf_sql("(n_chars + 1)")} end as found, n_chars from documents),
p as (select rid, doc_id, lang, leaf, case when n_chars is not null and found is not null then found else leaf end as found, row_number() over (partition by lang order by doc_id nulls first, leaf, rid) - 1 as pos from d),
t(lang, lvl, pos, h) as (select lang, 0, pos, leaf from p union all
  select lang, lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)) from (select *, count(*) over (partition by lang) as c from t) where c > 1 group by lang, lvl, pos // 2),
s as (select lang, max(lvl) as top, arg_max(h, lvl) as subroot from t group by lang),
r as (select lang, top, subroot, row_number() over (order by lang nulls first) - 1 as pos from s),
u(lvl, pos, h) as (select 0, pos, subroot from r union all
  select lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)) from (select *, count(*) over () as c from u) where c > 1 group by lvl, pos // 2),
w as (select max(lvl) as top, arg_max(h, lvl) as root from u),
steps as (select rid, k as lvl, 0 as part, p.lang, (p.pos >> k) as i from p join s on p.lang is not distinct from s.lang, range(64) x(k) where k < s.top),
high as (select r.lang, k as lvl, (r.pos >> k) as i from r, w, range(64) x(k) where k < w.top),
beside as (select rid, 0 as part, steps.lvl, case when i % 2 = 1 then 'L' when h is null then '-' else 'R' end || coalesce(h, '') as x
    from steps left join t on t.lang is not distinct from steps.lang and t.lvl = steps.lvl and t.pos = xor(steps.i, 1)
  union all select rid, 1, high.lvl, case when i % 2 = 1 then 'L' when h is null then '-' else 'R' end || coalesce(h, '')
    from p join high on p.lang is not distinct from high.lang left join u on u.lvl = high.lvl and u.pos = xor(high.i, 1)),
way as (select rid, list(x order by part, lvl) as path from beside group by rid)
select doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda x: x[2:]), ''), '')) as proof_sha256, folded_root, folded_root = root as verified
from (select p.rid, doc_id, leaf, subroot, root, path, list_reduce(list_prepend(found, coalesce(path, [])), lambda a, x: case x[1] when 'L' then sha256(x[2:] || a) when 'R' then sha256(a || x[2:]) else sha256(a) end) as folded_root
  from p join s on p.lang is not distinct from s.lang cross join w left join way using (rid))
"""
