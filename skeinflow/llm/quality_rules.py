"""Host-level quality rules, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.llm.base import own, quoted, staged

SPACE = r"[\x20\x09-\x0D]+"
#: Share of failing documents above which a host fails, of any one rule, after shrinking.
HOST_LIMIT = 0.6
#: Bytes of host names up to which host verdicts are broadcast; beyond, they are joined by a shuffle.
MOST_BROADCAST = 16 << 20
#: Rules that count by host beside the base rules; each over the columns of text_counts().
SOFT_RULES = {
    "few_words": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)",
}
BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def text_counts(text: Column) -> dict[str, Column]:
    """n_words, n_lines (with a word), word_chars, n_symbols, n_dup_lines and __hashes (of the words), as expressions over a text."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "__hashes": F.transform(words, lambda w: F.xxhash64(w)),
        "__lines": lines,
        "word_chars": (F.length(text) - F.length(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", ""))).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
    }


def with_counts(docs: DataFrame, text: str = "text", k: int = 5, name: str = "__c") -> DataFrame:
    """docs with one struct, name, of n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words.

    Words in k-word windows that a text holds twice or more: sorting finds the repeated windows, n log n whatever the
    text repeats. Only texts that repeat some pay for the sort of windows with their places; places back in order, each
    covers k words or those up to the next one. Windows are compared as 64-bit hashes, within one text only.
    What a lambda looks into is a column of its own, or it would be computed for each element.
    """
    hashes, line, chars, symbols, window, place, spot = own(docs, "__hashes", "__lines", "word_chars", "n_symbols", "__windows", "__placed", "__places")
    given = text_counts(F.col(quoted(text)))
    out = docs.withColumns({name: given[key] for name, key in ((hashes, "__hashes"), (line, "__lines"), (chars, "word_chars"), (symbols, "n_symbols"))})
    h, w, lines = F.col(hashes), F.col(window), F.col(line)
    none = F.array().cast("array<bigint>")
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - k, F.lit(0))), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k))))
    out = out.withColumn(window, F.when(F.size(h) < k, none).otherwise(each))
    placed = F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i")))
    out = out.withColumn(place, F.when(F.size(F.array_distinct(w)) == F.size(w), F.slice(placed, 1, 0)).otherwise(F.array_sort(placed)))
    p = F.col(place)
    twice = F.filter(p, lambda x, i: F.coalesce(x["w"] == F.when(i > 0, F.get(p, i - 1)["w"]), F.lit(False)) | F.coalesce(x["w"] == F.get(p, i + 1)["w"], F.lit(False)))
    out = out.withColumn(spot, F.sort_array(F.transform(twice, lambda x: x["i"])))
    at = F.col(spot)
    repeats = F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(k), F.coalesce(F.get(at, i + 1) - x, F.lit(k)))), F.lit(0), lambda a, x: a + x)
    fields = {
        "n_words": F.size(h),
        "word_chars": F.col(chars),
        "n_symbols": F.col(symbols),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeats,
    }
    return out.withColumn(name, F.struct(*(v.cast("long").alias(field) for field, v in fields.items()))).select(*map(quoted, docs.columns), name)


def host_verdicts(counted: DataFrame, source: str = "source", limit: float = HOST_LIMIT, rules: dict[str, str] = SOFT_RULES, counts: str = "__c") -> DataFrame:
    """(__s, __host_ok), source and verdict: per host and rule the failure rate, shrunk to a beta prior fitted by moments over all hosts.

    Hosts count alike in the fit. Where rates don't vary more than chance, the prior is as strong as 1000 documents.
    """
    per = counted.where(F.col(quoted(source)).isNotNull()).select(F.col(quoted(source)).alias("__s"), f"{counts}.*")
    per = per.groupBy("__s").agg(F.count("*").alias("n"), *(F.sum(F.expr(f"cast({r} as int)")).alias(k) for k, r in rules.items()))
    stats = [s for k in rules for s in (F.avg(F.col(k) / F.col("n")).alias(f"m_{k}"), F.var_pop(F.col(k) / F.col("n")).alias(f"v_{k}"), F.avg(F.col(k) / F.col("n") * (1 - F.col(k) / F.col("n")) / F.col("n")).alias(f"e_{k}"))]
    prior = per.agg(*stats)
    worst = []
    for k in rules:
        m = F.least(F.greatest(F.col(f"m_{k}"), F.lit(1e-6)), F.lit(1 - 1e-6))
        between = F.col(f"v_{k}") - F.col(f"e_{k}")
        strength = F.when(between > 1e-12, F.least(F.greatest(m * (1 - m) / between - 1, F.lit(1.0)), F.lit(1000.0))).otherwise(1000.0)
        worst.append((F.col(k) + m * strength) / (F.col("n") + strength))
    # The prior is a single row, by an aggregation without keys; joining it is no join of data with data.
    return per.crossJoin(F.broadcast(prior)).select("__s", (F.greatest(*worst, F.lit(0.0)) <= limit).alias("__host_ok"))


def with_verdicts(counted: DataFrame, source: str = "source", limit: float = HOST_LIMIT, counts: str = "__c", name: str = "__host_ok") -> DataFrame:
    """counted with name, its host's verdict: null for a document without a source. Verdicts are broadcast if their size, measured, allows it."""
    hosts = staged(host_verdicts(counted, source, limit, counts=counts), "hosts")
    size = hosts.agg(F.sum(F.octet_length("__s") + 16)).first()[0] or 0
    other = own(counted, "__s")[0]
    hosts = hosts.select(F.col("__s").alias(other), F.col("__host_ok").alias(name))
    return counted.join(F.broadcast(hosts) if size <= MOST_BROADCAST else hosts, F.col(quoted(source)) == F.col(other), "left").drop(other)


def judge_quality(docs: DataFrame, text: str = "text", source: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept (a taken name gets a _).

    Words are [^\\x20\\x09-\\x0D]+ of whole texts; null has none and so fails. A document is kept unless it fails a base
    rule or its host's shrunk failure rate exceeds the limit for some rule. A document without a source stands for itself.
    Each row of the input is one row of the result; an empty table gives none.
    """
    *names, c, ok = own(docs, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "__c", "__host_ok")
    out = with_verdicts(staged(with_counts(docs, text, name=c), "counts"), source, limit, c, ok)
    failed = F.expr(f"`{c}`.n_words < 10 or 100 * `{c}`.n_repeat_words > 20 * `{c}`.n_words")
    values = [F.col(f"{c}.{n}") for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [failed, ~failed & F.coalesce(ok, F.lit(True))]
    return out.select(*(F.col(quoted(x)) for x in docs.columns), *(v.alias(n) for n, v in zip(names, values, strict=True)))


def op7_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: null texts have no words and fail, null sources are judged by the document alone, repeats each count."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = staged(with_counts(docs.select("doc_id", "text", "source")).drop("text"), "counts")
    failed = F.expr(BASE_FAILED)
    out = with_verdicts(counted).select("doc_id", "__c.*", "__host_ok")
    out = out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.coalesce("__host_ok", F.lit(True)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _rate(k: str) -> str:
    m = f"least(greatest(m_{k}, 1e-6), 1 - 1e-6)"
    s = f"case when v_{k} - e_{k} > 1e-12 then least(greatest({m} * (1 - {m}) / (v_{k} - e_{k}) - 1, 1.0), 1000.0) else 1000.0 end"
    return f"({k} + {m} * ({s})) / (n + ({s}))"


ORACLE = rf"""
with t as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as text from documents),
w as (select rid, doc_id, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from t),
win as (select rid, i, array_to_string(w[i:i+4], ' ') as g from w, range(1, 1000000) r(i) where i <= len(w) - 4),
rep as (select rid, i from win qualify count(*) over (partition by rid, g) > 1),
cov as (select rid, count(distinct i + k) as n_repeat_words from rep, range(5) r(k) group by 1),
c as (select doc_id, source, len(w)::bigint as n_words, (length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]+', '', 'g')))::bigint as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
  coalesce(n_repeat_words, 0)::bigint as n_repeat_words from w left join cov using (rid)),
per as (select source, count(*) as n, {", ".join(f"sum(({r})::int) as {k}" for k, r in SOFT_RULES.items())} from c where source is not null group by 1),
prior as (select {", ".join(f"avg({k} / n) as m_{k}, var_pop({k} / n) as v_{k}, avg({k} / n * (1 - {k} / n) / n) as e_{k}" for k in SOFT_RULES)} from per),
host as (select source, greatest({", ".join(_rate(k) for k in SOFT_RULES)}) <= {HOST_LIMIT} as ok from per, prior)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_FAILED}) as base_failed,
  not ({BASE_FAILED}) and coalesce(ok, true) as kept from c left join host using (source)
"""
