"""Diagrams, complexes, graphs and logs as deterministic functions of the driver's tables, so that work grows with them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.functions.once import tasks

LETTER = "(1 + l_suppkey % 3) * case when l_returnflag = 'N' then -1 else 1 end"
ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's folder, else, on a local master as in tests, one of our own."""
    if not spark.sparkContext.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors share no folder")
        spark.sparkContext.setCheckpointDir(path or tempfile.mkdtemp())


def order_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(diagram, pos, letter): a braid for each order, a letter for each of its lines in a total order."""
    from pyspark.sql import Window

    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", *ORDER.split(", "), "l_returnflag")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER.split(", ")))
    return lines.select(F.col("l_orderkey").alias("diagram"), pos.alias("pos"), F.expr(LETTER).cast("int").alias("letter"))


def order_braids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(diagram, braid array<int>): one shuffle by order, letters sorted within each."""
    lines = read(spark, sf_dir, "lineitem")
    key = F.struct(*ORDER.split(", "), F.expr(LETTER).cast("int").alias("letter"))
    return lines.groupBy(F.col("l_orderkey").alias("diagram")).agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["letter"]).alias("braid"))


LETTERS_SQL = f"""select l_orderkey as diagram, row_number() over (partition by l_orderkey order by {ORDER})::int as pos,
  ((1 + l_suppkey % 3) * case when l_returnflag = 'N' then -1 else 1 end)::int as letter from lineitem"""


def trade_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by segment: (cx, deg, col, row, v): do customers of a nation order with a priority an odd number of times; v counts, signed by price."""
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    both = orders.join(customer, orders.o_custkey == customer.c_custkey)
    row = F.expr("ascii(substring(o_orderpriority, 1, 1)) - 49").cast("long")
    return both.groupBy(F.col("c_mktsegment").alias("cx"), F.lit(0).alias("deg"), F.col("c_nationkey").cast("long").alias("col"), row.alias("row")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("o_totalprice") > 150000, 1).otherwise(-1)).alias("v"))


TRADE_SQL = """select c_mktsegment as cx, 0 as deg, c_nationkey::bigint as col, (ascii(substring(o_orderpriority, 1, 1)) - 49)::bigint as row,
  count(*) as n, sum(case when o_totalprice > 150000 then 1 else -1 end)::bigint as v from orders join customer on o_custkey = c_custkey group by 1, 3, 4"""


#: Vertices of a customer's complex; edges and triangles are numbered by their vertices in a fixed order.
VERTICES = 8


def order_simplices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cx, a, b, c), a < b < c or null: the vertices, edges and triangles of a complex for each customer.

    An order spans the simplex of its suppliers' nations modulo VERTICES; a customer's complex is what its orders span,
    up to triangles. So every face of a simplex is there, and the boundary's square is zero.
    """
    lines, orders, supplier = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier"))
    seen = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(supplier, lines.l_suppkey == supplier.s_suppkey)
    sets = seen.groupBy(F.col("o_custkey").alias("cx"), "o_orderkey").agg(F.array_sort(F.collect_set(F.col("s_nationkey") % VERTICES)).alias("v")).select("cx", "v").distinct()
    a = sets.select("cx", "v", F.explode("v").alias("a"))
    later = lambda x: F.filter("v", lambda y: y > F.col(x))
    b = a.select("cx", "v", "a", F.explode(later("a")).alias("b"))
    c = b.select("cx", "a", "b", F.explode(later("b")).alias("c"))
    none = F.lit(None).cast("int")
    out = a.select("cx", "a", none.alias("b"), none.alias("c")).union(b.select("cx", "a", "b", none)).union(c)
    return out.distinct()


def order_complexes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(gen, bd) of the customers' cochain complexes: vertices in degree 0, edges in 1, triangles in 2, numbered within each."""
    from pyspark.sql import Window

    s = order_simplices(spark, sf_dir)
    deg = F.when(F.col("b").isNull(), 0).when(F.col("c").isNull(), 1).otherwise(2)
    s = s.withColumn("deg", deg).withColumn("n", F.row_number().over(Window.partitionBy("cx", "deg").orderBy("a", "b", "c")).cast("long") - 1)
    gen = s.groupBy("cx", "deg").agg(F.count("*").alias("dim"))
    v = s.where("deg = 0").select("cx", F.col("a").alias("x"), F.col("n").alias("col"))
    e = s.where("deg = 1").select("cx", "a", "b", "n")
    up = e.select("cx", F.col("n").alias("row"), F.explode(F.array(F.struct(F.col("b").alias("x"), F.lit(1).alias("v")), F.struct(F.col("a").alias("x"), F.lit(-1).alias("v")))).alias("s"))
    first = v.join(up.select("cx", "row", "s.*"), ["cx", "x"]).select("cx", F.lit(0).alias("deg"), "col", "row", F.col("v").cast("long").alias("v"))
    t = s.where("deg = 2").select("cx", F.col("n").alias("row"), "a", "b", "c")
    side = lambda x, y, sign: F.struct(F.col(x).alias("a"), F.col(y).alias("b"), F.lit(sign).alias("v"))
    up = t.select("cx", "row", F.explode(F.array(side("b", "c", 1), side("a", "c", -1), side("a", "b", 1))).alias("s")).select("cx", "row", "s.*")
    second = e.withColumnRenamed("n", "col").join(up, ["cx", "a", "b"]).select("cx", F.lit(1).alias("deg"), "col", "row", F.col("v").cast("long").alias("v"))
    return gen, first.union(second)


def order_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cx, sets array<int>): the sets of vertices that a customer's orders span, each once, as bit masks; vertices are remainders, which may be negative.

    Lines meet by order before they meet the order's customer, and a customer's sets are dealt to tasks by number.
    """
    lines, orders, supplier = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier"))
    bit = F.expr(f"shiftleft(1, cast(s_nationkey % {VERTICES} + {VERTICES - 1} as int))")
    masks = lines.join(supplier, lines.l_suppkey == supplier.s_suppkey).groupBy("l_orderkey").agg(F.bit_or(bit).alias("mask")).where("mask is not null")
    sets = orders.select("o_orderkey", F.col("o_custkey").alias("cx")).join(masks, F.col("o_orderkey") == F.col("l_orderkey"))
    return sets.select("cx", "mask").repartition(tasks(sets), "cx").groupBy("cx").agg(F.collect_set("mask").alias("sets"))


#: Tables v, e and t (cx, and the simplex's vertices) as SQL.
SIMPLICES_SQL = f"""o as (select distinct o_custkey as cx, o_orderkey, s_nationkey % {VERTICES} as v from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey),
  v as (select distinct cx, v as a from o), e as (select distinct x.cx, x.v as a, y.v as b from o x join o y on x.o_orderkey = y.o_orderkey and x.v < y.v),
  t as (select distinct x.cx, x.v as a, y.v as b, z.v as c from o x join o y on x.o_orderkey = y.o_orderkey and x.v < y.v join o z on x.o_orderkey = z.o_orderkey and y.v < z.v)"""


def part_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cx, seed, cols, rows, density): a seeded random matrix for each part, its shape by the part's size, its density by the brand."""
    p = read(spark, sf_dir, "part")
    share = (F.expr("ascii(substring(p_brand, -1, 1)) % 8") + 1) / 16
    return p.select(F.col("p_partkey").alias("cx"), F.col("p_partkey").alias("seed"), (10 + F.col("p_size") % 31).alias("cols"), (20 + F.col("p_size")  % 41).alias("rows"), share.alias("density"))


PART_MATRICES_SQL = "select p_partkey as cx, p_partkey as seed, 10 + p_size % 31 as cols, 20 + p_size % 41 as rows, (ascii(p_brand[-1:]) % 8 + 1) / 16.0 as density from part"


# --- published objects dealt to the tables' rows -------------------------------------------------------------------

KEYS = {"supplier": "s_suppkey", "customer": "c_custkey"}


def numbered(names) -> dict[str, int]:
    """Names with the numbers that rows are dealt by: their own, or 0, 1, ... in order."""
    return names if isinstance(names, dict) and all(isinstance(i, int) for i in names.values()) else {n: i for i, n in enumerate(names)}


def dealt(spark: SparkSession, sf_dir: str, rows: DataFrame, names, key: str = "diagram", table: str = "supplier") -> DataFrame:
    """A copy of an object's rows for each row of the table that it falls to by the table's key: named object/key, with turn, the table's key."""
    number = numbered(names)
    each = spark.createDataFrame(list(number.items()), "__name string, __i int")
    ids = read(spark, sf_dir, table).select(F.col(KEYS[table]).alias("turn")).withColumn("__i", (F.col("turn") % (max(number.values()) + 1)).cast("int"))
    out = ids.join(F.broadcast(each), "__i").join(F.broadcast(rows), F.col("__name") == F.col(key))
    return out.select(*(F.concat(key, F.lit("/"), "turn").alias(c) if c == key else F.col(c) for c in rows.columns), "turn")


def dealt_sql(sql: str, names, key: str = "diagram", table: str = "supplier") -> str:
    """What sql says of the objects, for each row of the table that they are dealt to."""
    number = numbered(names)
    rows = ", ".join(f"('{n}', {i})" for n, i in number.items())
    return f"""with given as ({sql}) select given.* replace (given.{key} || '/' || {KEYS[table]} as {key})
  from given join (values {rows}) deal(name, i) on deal.name = given.{key} join {table} on {KEYS[table]} % {max(number.values()) + 1} = deal.i"""


def _rotated(a: str, by: str) -> str:
    return f"concat(slice({a}, 1 + cast({by} as int), size({a})), slice({a}, 1, cast({by} as int)))"


def turned_diagrams(dealt_pds: DataFrame) -> DataFrame:
    """(diagram, pd): the same knot, its crossings listed from another one on, its arcs numbered from another one on."""
    moved = F.expr("transform(pd, c -> transform(c, v -> cast((v - 1 + turn) % (2 * size(pd)) + 1 as int)))")
    return dealt_pds.withColumn("pd", F.when(F.size("pd") > 0, moved).otherwise(F.col("pd"))).select("diagram", F.when(F.size("pd") > 0, F.expr(_rotated("pd", "turn % size(pd)"))).otherwise(F.col("pd")).alias("pd"))


def turned_braids(dealt_braids: DataFrame) -> DataFrame:
    """(diagram, braid): a conjugate, the word from another letter on."""
    return dealt_braids.select("diagram", F.expr(_rotated("braid", "turn % size(braid)")).alias("braid"))


def turned_grids(dealt_grids: DataFrame) -> DataFrame:
    """(diagram, n, o, x): the same knot, the torus cut open at another row and column."""
    columns = lambda c: f"transform({c}, v -> cast((v + turn div 3) % n as int))"
    return dealt_grids.select("diagram", "n", *(F.expr(_rotated(columns(c), "turn % n")).alias(c) for c in ("o", "x")))
