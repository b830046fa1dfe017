"""Quality rules with adaptive thresholds (native: DataFrame operations only).

Each document's counts become integer rates. A log-linear histogram of each rate is kept for every language and
source: it is a quantile sketch of bounded size (relative error 1/32) whose merge is the addition of counts, so
Spark's partial aggregation builds it, one merge gives a language's or the whole corpus's sketch, and reruns
agree. Fences from the sketches' quartiles replace fixed cutoffs and are joined back to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketspark.llm.common import SPACE, let, null_key, stored

#: rate: (numerator, denominator, scale, least spread, lower fence too). The spread of a rate that hardly varies
#: (most documents have no symbol at all) counts as the least spread.
RATES = {
    "symbols": ("n_symbols", "word_chars", 1000, 10, False),
    "word_length": ("word_chars", "n_words", 100, 60, True),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 150, False),
    "repeats": ("n_repeat_words", "n_words", 1000, 90, False),
}
#: Fences lie so many spreads beyond the quartiles.
REACH = 3
#: The quartiles of a language and source count as many as they have documents, those of the language as much as this
#: many; and so the language's against the corpus's. Small groups so lean on large ones, without a step anywhere.
PRIOR = 10
WINDOW_WORDS = 8
#: Parts that the join of fences to documents splits each language and source into.
SALTS = 64


def _repeat_words(h: Column, n: Column) -> Column:
    """Words inside windows of eight that occur twice or more; h: the words' 64-bit hashes. Windows are compared by 64-bit hashes."""
    size = WINDOW_WORDS
    windows = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))

    def covered(w: Column) -> Column:
        ordered = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def sweep(s: Column) -> Column:
            twice = F.filter(s, lambda e, i: F.coalesce(e["x"] == F.get(s, i - 1)["x"], F.lit(False)) | F.coalesce(e["x"] == F.get(s, i + 1)["x"], F.lit(False)))
            starts = F.array_sort(F.transform(twice, lambda e: e["i"]))
            total = F.aggregate(
                starts,
                F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                lambda acc, i: F.struct((acc["n"] + i + size - F.greatest(acc["end"], i)).alias("n"), (i + size).alias("end")),
                lambda acc: acc["n"],
            )
            return total

        return F.when(F.size(F.array_distinct(w)) < F.size(w), let(ordered, sweep)).otherwise(F.lit(0))

    return F.when(n >= size, let(windows, covered)).otherwise(F.lit(0))


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words for every row; a null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    body = F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")
    words = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, f"{SPACE}+"))
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"[^\x20\x09-\x0D]"))
    counted = docs.select(
        "doc_id",
        "lang",
        "source",
        let(hashes, lambda h: F.struct(F.size(h).alias("n"), _repeat_words(h, F.size(h)).alias("r"))).alias("_q_w"),
        (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))).alias("_q_l"),
    )
    of = lambda name, alias: F.col(name).cast("long").alias(alias)
    return counted.select("doc_id", "lang", "source", of("_q_w.n", "n_words"), "word_chars", "n_symbols", of("_q_l.n", "n_lines"), of("_q_l.d", "n_dup_lines"), F.col("_q_w.r").cast("long").alias("n_repeat_words"))


def rate(name: str) -> Column:
    top, bottom, scale, _, _ = RATES[name]
    return F.when(F.col(bottom) > 0, F.floor(F.lit(scale) * F.col(top) / F.col(bottom)).cast("long"))


def bucket(v: Column) -> Column:
    """Values below 32 keep their own bucket; above, each doubling has 32."""
    e = F.length(F.bin(v)) - 6
    return F.when(v < 32, v).otherwise(e * 32 + F.call_function("shiftright", v, e)).cast("long")


def bucket_start(b: Column) -> Column:
    e = F.floor(b / 32).cast("int") - 1
    return F.when(b < 32, b).otherwise(F.call_function("shiftleft", (b - e * 32).cast("long"), e)).cast("long")


def sketches(counts: DataFrame) -> DataFrame:
    """_q_lang, _q_source, rate, bucket, n: a mergeable histogram of each rate for every language and source, of rows that the base rules pass."""
    rates = F.array(*[F.struct(F.lit(k).alias("rate"), rate(k).alias("v")) for k in RATES])
    rows = counts.where(~F.col("base_failed")).select("_q_lang", "_q_source", F.explode(rates).alias("_q_r"))
    rows = rows.select("_q_lang", "_q_source", F.col("_q_r.rate").alias("rate"), bucket(F.col("_q_r.v")).alias("bucket"))
    return rows.where(F.col("bucket").isNotNull()).groupBy("_q_lang", "_q_source", "rate", "bucket").agg(F.count("*").alias("n"))


def quartiles(hist: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rate, group_n, q1, q3 of merged sketches."""
    merged = hist.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "rate")
    merged = merged.withColumn("total", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda q: bucket_start(F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bucket"))))
    return merged.groupBy(*keys, "rate").agg(F.max("total").alias("group_n"), at(1).alias("q1"), at(3).alias("q3"))


def fences(hist: DataFrame, reach: int = REACH, prior: int = PRIOR) -> DataFrame:
    """_q_lang, _q_source and for each rate its upper (and lower) fence, in one row a language and source."""
    levels = [quartiles(hist, k) for k in (["_q_lang", "_q_source"], ["_q_lang"], [])]
    own, by_lang, whole = (x.select(*[c for c in x.columns if c[0] == "_"], "rate", *[F.col(c).alias(f"{c}_{i}") for c in ("group_n", "q1", "q3")]) for i, x in enumerate(levels))
    df = own.join(by_lang, ["_q_lang", "rate"]).join(whole, "rate")
    weighed = lambda q, n, above: F.call_function("div", n * q + prior * above, n + prior)
    pick = lambda c: weighed(F.col(f"{c}_0"), F.col("group_n_0"), weighed(F.col(f"{c}_1"), F.col("group_n_1"), F.col(f"{c}_2")))
    least = F.create_map(*[x for k, v in RATES.items() for x in (F.lit(k), F.lit(v[3]))])
    df = df.select("_q_lang", "_q_source", "rate", pick("q1").alias("q1"), pick("q3").alias("q3"), least[F.col("rate")].alias("least"))
    spread = F.greatest(F.col("q3") - F.col("q1"), F.col("least").cast("long"))
    df = df.withColumn("upper", F.col("q3") + reach * spread).withColumn("lower", F.col("q1") - reach * spread)
    cols = [F.max(F.when(F.col("rate") == k, F.col("upper"))).alias(f"_q_{k}_upper") for k in RATES]
    cols += [F.max(F.when(F.col("rate") == k, F.col("lower"))).alias(f"_q_{k}_lower") for k, v in RATES.items() if v[4]]
    return df.groupBy("_q_lang", "_q_source").agg(*cols)


def adaptive_rules(docs: DataFrame, reach: int = REACH, prior: int = PRIOR) -> DataFrame:
    """doc_id, lang, source, the six counts, base_failed, kept and the fences held against each row of docs.

    Base rules: fewer than 20 words, or more than 30 % of them in repeated windows, fail. Other rows are kept if
    every rate lies within its fences. Null and empty texts have 0 words and fail; null languages and sources
    are groups of their own; repeated rows count as rows; an empty table gives an empty result. Extra input
    columns don't matter.
    """
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    counts = document_counts(docs).withColumn("base_failed", failed)
    counts = stored(counts.withColumns({"_q_lang": null_key("lang"), "_q_source": null_key("source")}), "quality-counts")
    limits = fences(sketches(counts), reach, prior)
    salted = limits.withColumn("_q_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = counts.withColumn("_q_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["_q_lang", "_q_source", "_q_salt"], "left")
    within = ~F.col("base_failed")
    for k, v in RATES.items():
        within &= rate(k) <= F.col(f"_q_{k}_upper")
        if v[4]:
            within &= rate(k) >= F.col(f"_q_{k}_lower")
    out = joined.withColumn("kept", F.coalesce(within, F.lit(False)))
    named = [F.col(c).alias(c[3:]) for c in limits.columns[2:]]
    return out.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *named)
