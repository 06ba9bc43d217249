"""Objects that fail by themselves: status rows in place of a failed job, components that are abandoned, a run's report."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinflow.functions.once import once
from skeinflow.plans.placement import lineage_components

#: Characters of an error's text that are kept.
MOST_TEXT = 500


def _invariants() -> dict[str, tuple[str, Callable, str]]:
    """By invariant: the column of its objects, the kernel of one object that gives rows, and their fields."""
    from skeinflow.operators import classical, cube, khovanov, second

    def braid(f):
        def of(word):
            if not word:
                raise ValueError("a braid is not empty")
            return f(classical.seifert_of(word))

        return of

    def form(v):
        return [[v[i][j] + v[j][i] for j in range(len(v))] for i in range(len(v))]

    def checked(f):
        def of(code):
            labels = sorted(x for c in code for x in c)
            n2, low = 2 * len(code), min(labels, default=0)
            if any(len(c) != 4 for c in code) or low not in (0, 1) and code or labels != sorted(list(range(low, low + n2)) * 2):
                raise ValueError("each of 2n labels occurs twice, without gaps, from 0 or 1")
            if any((c - low) % n2 != (a - low + 1) % n2 or (d - b) % n2 not in (1, n2 - 1) for a, b, c, d in code):
                raise ValueError("labels do not follow one strand")
            enter = {x for a, b, _, d in code for x in (a, b if (d - b) % n2 == 1 else d)}
            if len(code) > 1 and len(enter) != n2:
                raise ValueError("labels do not follow one strand")
            return f(code)

        return of

    return {
        "determinant": ("braid", braid(lambda v: [(str(abs(classical.determinant_of(form(v)))),)]), "determinant string"),
        "signature": ("braid", braid(lambda v: [(classical.signature_of(form(v)),)]), "signature int"),
        "alexander_polynomial": ("braid", braid(lambda v: [(i, str(c)) for i, c in enumerate(classical.alexander_of(v))]), "exp int, coef string"),
        "jones_polynomial": ("pd", checked(lambda code: [(e, str(c)) for e, c in second.jones_by_frontier(code).items()]), "exp int, coef string"),
        "kauffman_bracket": ("pd", checked(lambda code: [(e, str(c)) for e, c in sorted(second.bracket_by_frontier(code).items()) if c]), "exp int, coef string"),
        "jones_by_cube": ("pd", checked(lambda code: [(e, str(c)) for e, c in cube.jones_of(code, False).items()]), "exp int, coef string"),
        "khovanov_homology": ("pd", checked(lambda code: [(*k, n) for k, n in khovanov.khovanov_of(code).items()]), "i int, j int, dim long"),
        "rational_khovanov_homology": ("pd", checked(lambda code: [(*k, n) for k, n in khovanov.khovanov_of(code, "q").items()]), "i int, j int, dim long"),
        "rasmussen_s": ("pd", checked(lambda code: [(khovanov.rasmussen_of(code),)]), "s int"),
    }


def attempted(objects: DataFrame, invariant: str) -> DataFrame:
    """(diagram, the invariant's fields, error): the rows of each object, or one with its error and no values.

    Whatever a kernel raises stays with its object: null and malformed ones, those too large, and ones that turn out not
    to be what the kernel is for. All other objects come out as they would without it; the job does not fail. Equal objects
    are worked out once.
    """
    from skeinflow.operators.second import plain

    table = _invariants()
    if invariant not in table:
        raise ValueError(f"unknown invariant {invariant!r}; there are {', '.join(table)}")
    column, kernel, fields = table[invariant]
    names = [f.split()[0] for f in fields.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for d, x in zip(batch["diagram"], batch[column], strict=True):
                try:
                    rows += [(d, *r, None) for r in kernel(plain(x))]
                except Exception as e:  # noqa: BLE001  an object's failure is its own
                    rows.append((d, *[None] * len(names), f"{type(e).__name__}: {e}"[:MOST_TEXT]))
            yield pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(["diagram", *names, "error"])})

    schema = lambda d: T.StructType([d.schema["diagram"], *T._parse_datatype_string(fields).fields, T.StructField("error", T.StringType())])
    return once(objects, [column], lambda d: d.mapInPandas(work, schema(d)))


def abandoned(needs: DataFrame, failed: DataFrame) -> DataFrame:
    """(job, status): failed, abandoned (linked with a failed job, whichever way, over any number of needs) or open.

    needs: (job, dep); failed: (job). A failed job that has no needs and that nothing needs stands alone. Jobs of other
    components go on.
    """
    root = lineage_components(needs)
    bad = failed.select("job").where("job is not null").distinct()
    lost = root.join(bad, F.col("node") == F.col("job"), "left_semi").select(F.col("root").alias("lost")).distinct()
    jobs = root.select(F.col("node").alias("job"), "root").union(bad.join(root.select(F.col("node").alias("job")), "job", "left_anti").select("job", F.col("job").alias("root")))
    marked = jobs.join(lost, F.col("root") == F.col("lost"), "left").join(bad.withColumn("failed", F.lit(True)), "job", "left")
    return marked.select("job", F.when(F.col("failed"), "failed").when(F.col("lost").isNotNull(), "abandoned").otherwise("open").alias("status"))


def runnable(objects: DataFrame, needs: DataFrame, failed: DataFrame) -> DataFrame:
    """Objects (with a column job) whose component no failed job is in; those that no need names are runnable unless they failed."""
    out = abandoned(needs, failed).where("status <> 'open'").select("job")
    return objects.join(out, "job", "left_anti")


@dataclass
class RunReport:
    """What a plan's run counted while it ran: read counts() after the first action on its DataFrame."""

    rows: DataFrame
    _seen: Observation

    def counts(self) -> dict[str, int]:
        return {k: int(v or 0) for k, v in self._seen.get.items()}

    def as_table(self) -> DataFrame:
        """(metric, value) of the run; waits for the first action."""
        return self.rows.sparkSession.createDataFrame(sorted(self.counts().items()), "metric string, value long")


def reported(rows: DataFrame, error: str = "error", refused: tuple[str, ...] = ("ValueError",)) -> RunReport:
    """rows with an observation of them, on their way to whatever uses them: no second pass.

    rows: all of them; results: those without an error; failures: those with one; refused: failures whose error begins
    with one of the kinds given, of objects that are not valid; broken: the rest; error_chars: the errors' length.
    """
    seen, failed = Observation(), F.col(error).isNotNull()
    kinds = F.lit(False)
    for kind in refused:
        kinds = kinds | F.col(error).startswith(f"{kind}:")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    watched = rows.observe(seen, F.count(F.lit(1)).alias("rows"), n(~failed)("results"), n(failed)("failures"), n(failed & kinds)("refused"), n(failed & ~kinds)("broken"), F.sum(F.coalesce(F.length(error), F.lit(0))).alias("error_chars"))
    return RunReport(watched, seen)
