"""Personal data by bootstrapped contextual extraction (native: DataFrame operations only).

Seed entities are what fixed patterns find. The words before and after them are lexical patterns; candidates are
identifier-like texts that the fixed patterns refuse (a card that fails its check digit, an e-mail written with
"(at)", a phone number without a plus, an IPv6 address). Patterns and instances score each other round by round: a
pattern by the scores of its instances over all occurrences of its word in the corpus, an instance by the noisy-or
of its patterns. Instances that confident patterns support become spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketspark.llm.common import SPACE, forget, let, stored

KINDS = ("email", "ip", "card", "phone")
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Fixed patterns. Possessive and anchored to the start of a run where that changes no match, so that no text takes quadratic time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Candidates of each kind.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,}+(?:@|\(at\)|\[at\])[A-Za-z0-9.-]{2,}+",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z-])",
}
#: What a text must have for a kind's patterns to be tried.
HINT = {"email": r"@|[(\[]at[)\]]", "ip": r"[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]", "card": r"[0-9][0-9 -]{11}", "phone": r"[0-9][0-9 ().-]{5}"}
HITS = "array<struct<kind:string,start:int,end:int,value:string,before:string,after:string>>"
#: A pattern needs so many distinct instances, and an instance such a score, to count.
LEAST_SUPPORT, CONFIDENT, ROUNDS = 3, 0.5, 3
#: Parts that the join of discovered spans to documents splits each text's copies into.
SALTS = 16
#: Matches whose lengths are summed at once.
STRIDE = 128


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(acc, i):
        d = F.substring(back, i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"\A{_BYTE}(?:\.{_BYTE}){{3}}\z")
    if kind == "card":
        return let(_digits(value), _luhn)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda hit: _valid(kind, hit["value"])


def _sums_before(n: Column) -> Column:
    """Of each number of an array, the sum of those before it. Sums of runs of STRIDE first, so that many take little more than linear time."""
    part = lambda x, begin, size: F.aggregate(F.slice(x, begin + 1, size), F.lit(0), lambda a, v: a + v)
    heads = F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / STRIDE).cast("int")), lambda j: part(n, j * STRIDE, F.lit(STRIDE)))
    upto = lambda x: let(heads, lambda h: F.transform(x, lambda _, k: part(h, F.lit(0), F.floor(k / STRIDE).cast("int")) + part(x, F.floor(k / STRIDE).cast("int") * STRIDE, k % STRIDE)))
    return upto(n)


def _hits(kind: str, text: Column, pattern: str) -> Column:
    """All matches with their places in code points and the white-space separated words beside them, in whole."""
    last = rf"\A{SPACE}+([^\x20\x09-\x0D]+)"  # of the text before, turned round
    next_ = rf"\A{SPACE}+([^\x20\x09-\x0D]+)(?:{SPACE}|\z)"

    def placed(x):
        def hit(value, k):
            left, right = F.get(x["p"], k), F.get(x["p"], k + 1)
            start = F.get(x["n"], k) + F.length(left)
            before = F.reverse(F.regexp_extract(F.reverse(left), last, 1))
            after = F.regexp_extract(right, next_, 1)
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), F.lower(before).alias("before"), F.lower(after).alias("after"))

        return F.transform(x["h"], hit)

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("h"), F.split(text, pattern, -1).alias("p"))

    def summed(x):
        lengths = F.transform(x["h"], lambda v, k: F.length(v) + F.length(F.get(x["p"], k)))
        return let(F.struct(x["h"].alias("h"), x["p"].alias("p"), let(lengths, _sums_before).alias("n")), placed)

    return F.when(text.rlike(HINT[kind]), let(both, summed)).otherwise(F.array().cast(HITS))


def found(docs: DataFrame) -> DataFrame:
    """doc_id, the text's digest _p_t, base (all kinds' valid matches) and loose (candidates apart from them)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    some = text.rlike("[0-9@]|[(\\[]at[)\\]]")
    none = F.array().cast(HITS)
    base = F.concat(*[F.filter(_hits(k, text, BASE[k]), _check(k)) for k in KINDS])
    rows = docs.select("doc_id", text.alias("_p_text"), F.when(some, base).otherwise(none).alias("base"))
    text = F.col("_p_text")
    some = text.rlike("[0-9@]|[(\\[]at[)\\]]")
    loose = F.when(some, F.concat(*[_hits(k, text, LOOSE[k]) for k in KINDS])).otherwise(none)
    rows = rows.select("doc_id", F.md5(F.col("_p_text").cast("binary")).alias("_p_t"), "base", loose.alias("loose"))
    apart = F.filter("loose", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return rows.select("doc_id", "_p_t", "base", apart.alias("loose"))


def _edges(rows: DataFrame) -> DataFrame:
    """kind, value, seed, side, word, n: how often each instance stands beside each word, copies of a text included, as in word_totals."""
    hits = F.concat(
        F.transform("base", lambda h: F.struct(h.alias("h"), F.lit(True).alias("seed"))),
        F.transform("loose", lambda h: F.struct(h.alias("h"), F.lit(False).alias("seed"))),
    )
    one = rows.where((F.size("base") > 0) | (F.size("loose") > 0)).select("_p_t", F.explode(hits).alias("x"))
    one = one.select("_p_t", "x.h.kind", "x.h.value", "x.h.start", "x.h.before", "x.h.after", "x.seed").dropDuplicates(["_p_t", "kind", "start"])
    copies = rows.groupBy("_p_t").agg(F.count("*").alias("copies"))
    one = one.join(copies, "_p_t")
    sides = F.array(F.struct(F.lit("before").alias("side"), F.col("before").alias("word")), F.struct(F.lit("after").alias("side"), F.col("after").alias("word")))
    out = one.select("kind", "value", "seed", "copies", F.explode(sides).alias("s")).select("kind", "value", "seed", "copies", "s.side", "s.word")
    return out.where("word != ''").groupBy("kind", "value", "seed", "side", "word").agg(F.sum("copies").alias("n"))


def word_totals(docs: DataFrame, words: DataFrame) -> DataFrame:
    """word, total: how often each of words stands in docs, copies included. Tasks count before anything moves: Spark would put a semi join below the counting."""
    every = docs.select(F.explode(F.split(F.lower("text"), f"{SPACE}+")).alias("word")).groupBy("word").agg(F.count("*").alias("total"))
    return every.join(words.select("word").distinct(), "word")


def scored_instances(edges: DataFrame, totals: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """kind, value, score of the candidates, after so many rounds over the graph of patterns and instances."""
    graph = stored(edges.join(totals, "word", "left"), "pii-graph")
    instances, before = graph.groupBy("kind", "value").agg(F.max(F.col("seed").cast("double")).alias("score")), None
    pattern = ["kind", "side", "word"]
    for _ in range(rounds):
        lit = graph.join(instances, ["kind", "value"])
        support = F.sum((F.col("score") >= CONFIDENT).cast("long"))
        patterns = lit.groupBy(*pattern).agg((F.sum(F.col("n") * F.col("score")) / F.greatest(F.max("total"), F.sum("n"))).alias("p"), support.alias("support"))
        patterns = patterns.where(F.col("support") >= LEAST_SUPPORT)
        miss = F.sum(F.log(1 - F.least(F.coalesce("p", F.lit(0.0)), F.lit(0.999))))
        new = graph.join(patterns, pattern, "left").groupBy("kind", "value").agg(F.max(F.col("seed").cast("double")).alias("seed"), (1 - F.exp(miss)).alias("q"))
        instances = stored(new.select("kind", "value", F.greatest("seed", "q").alias("score")), "pii-scores")
        if before is not None:
            forget(before)
        before = instances
    return instances.join(graph.where("not seed").select("kind", "value").distinct(), ["kind", "value"], "left_semi")


def personal_data(docs: DataFrame, confident: float = CONFIDENT) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end; code points, end exclusive) of every row of docs (doc_id, text).

    base: the fixed patterns' valid matches, kind by kind in the order of KINDS and by start. spans: those and
    the candidates whose instances score `confident` or more, in the same order. Null and empty texts have none;
    equal texts have equal spans; an empty table gives an empty result; other columns don't matter.
    """
    rows = stored(found(docs), "pii-found")
    none = F.array().cast(HITS)
    some = rows.where(F.size("loose") > 0)
    if some.isEmpty():
        out = rows.withColumn("more", none)
    else:
        edges = stored(_edges(rows), "pii-edges")
        # Words without candidates can't lead to any.
        good = scored_instances(edges, word_totals(docs, edges.where("not seed"))).where(F.col("score") >= confident)
        each = some.select("_p_t", F.explode("loose").alias("h")).select("_p_t", "h", F.col("h.kind").alias("kind"), F.col("h.value").alias("value"), F.col("h.start").alias("start"))
        each = each.dropDuplicates(["_p_t", "kind", "start"]).join(good, ["kind", "value"], "left_semi")
        more = each.groupBy("_p_t").agg(F.collect_list("h").alias("more"))  # one text's candidates
        more = more.withColumn("_p_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        some = some.withColumn("_p_s", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(more, ["_p_t", "_p_s"], "left")
        out = some.select("doc_id", "base", F.coalesce("more", none).alias("more")).union(rows.where(F.size("loose") == 0).select("doc_id", "base", none.alias("more")))
    order = F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*map(F.lit, range(len(KINDS)))))
    all_ = F.array_sort(F.transform(F.concat("base", "more"), lambda h: F.struct(order[h["kind"]].alias("o"), h["start"].alias("start"), h["end"].alias("end"), h["kind"].alias("kind"))))
    plain = lambda h: F.struct(h["kind"].alias("kind"), h["start"].alias("start"), h["end"].alias("end"))
    return out.select("doc_id", F.transform("base", plain).alias("base"), F.transform(all_, plain).alias("spans"))
