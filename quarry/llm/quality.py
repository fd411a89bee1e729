"""Quality rules whose cut-offs come from mergeable quantile sketches per language and source.

Native: only DataFrame functions. The sketch of a metric is a table of counts by bucket;
a bucket keeps the six leading bits of a value, so two sketches merge by adding counts,
quantiles are within 1/32 of the value, and the result is the same in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.llm.common import SPACE_CLASS, Scratch, shield

NOT_SPACE = r"[^\x20\x09-\x0D]"
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: metric: (numerator, denominator, scale, lower and upper quantile per mille, fence, whether low values are rejected too).
#: Values are kept up to ``fence`` distances of the two quantiles beyond the upper one (and the lower one).
METRICS = {
    "symbols": ("n_symbols", "word_chars", 1000, 500, 900, 3, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 500, 990, 1, False),
    "word_length": ("word_chars", "n_words", 100, 250, 750, 5, True),
}
#: Groups with fewer documents take the sketch of their language, and such languages that of all documents.
LEAST_DOCS = 100
#: Up to so many groups (about 100 bytes each), cut-offs are broadcast; beyond, rows are salted and shuffled.
BROADCAST_GROUPS = 100_000
SALTS = 16


#: Columns that ``metrics`` adds.
MADE = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed")


def words_col(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_CLASS + "+"), "")


def repeat_words(hashes: Column, width: int = WINDOW) -> Column:
    """Words covered by windows that occur twice or more; ``hashes``: by window, in order."""
    by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    pairs = F.zip_with(by_hash, F.slice(by_hash, 2, F.size(hashes)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    at = F.sort_array(F.array_distinct(F.flatten(pairs)))
    steps = F.zip_with(at, F.slice(at, 2, F.size(hashes)), lambda a, b: F.least(b - a, F.lit(width)))
    covered = F.aggregate(steps, F.lit(0), lambda s, x: s + x)
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered).otherwise(F.lit(0)).cast("long")


def metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = {"_words": words_col(text), "_lines": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NOT_SPACE))}
    out = docs.drop(*MADE, "_words", "_lines", "_h").withColumns(own)
    n = F.size("_words")
    word_hash = F.transform("_words", lambda w: F.xxhash64(w))
    out = out.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
            "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_h": word_hash,
        }
    )
    starts = F.when(F.size("_h") >= WINDOW, F.sequence(F.lit(1), F.size("_h") - WINDOW + 1)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("_h", F.transform(starts, lambda i: F.xxhash64(F.slice(F.col("_h"), i, WINDOW))))
    out = out.withColumn("n_repeat_words", repeat_words(F.col("_h"))).drop("_words", "_lines", "_h")
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def bucket(value: Column) -> Column:
    """Bucket of a non-negative integer: exact below 64, else its six leading bits and how many follow."""
    shift = F.length(F.bin(value)).cast("int") - 6
    return F.when(value < 64, value).otherwise((shift * 64).cast("long") + F.call_function("shiftright", value, F.greatest(shift, F.lit(0))))


def bucket_value(b: Column) -> Column:
    """The smallest value of a bucket."""
    return F.when(b < 64, b).otherwise(F.call_function("shiftleft", b % 64, F.floor(b / 64).cast("int")))


def bucket_end(b: Column) -> Column:
    """The largest value of a bucket."""
    return bucket_value(b) + F.when(b < 64, 0).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(b / 64).cast("int")) - 1)


def _metric(name: str) -> Column:
    num, den, scale, *_ = METRICS[name]
    return F.floor(F.col(num) * scale / F.greatest(F.col(den), F.lit(1))).cast("long")


def sketches(scored: DataFrame) -> DataFrame:
    """Counts by lang, source, metric and bucket over documents that pass the base rules."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(_metric(m)).alias("bucket")) for m in METRICS]))
    return scored.filter(~F.col("base_failed")).select("_lang", "_source", each.alias("x")).groupBy("_lang", "_source", "x.metric", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def cutoffs(sketch: DataFrame) -> DataFrame:
    """Per lang and source: a column ``<metric>_lo`` and ``<metric>_hi`` for each metric."""
    merged = sketch.groupingSets([["_lang", "_source", "metric", "bucket"], ["_lang", "metric", "bucket"], ["metric", "bucket"]], "_lang", "_source", "metric", "bucket").agg(F.grouping_id("_lang", "_source", "metric", "bucket").alias("g"), F.sum("n").alias("n"))
    level = F.when(F.col("g") == 0, 0).when(F.col("g") == 4, 1).otherwise(2)
    merged = merged.select(level.alias("level"), "_lang", "_source", "metric", "bucket", "n")
    w = Window.partitionBy("level", "_lang", "_source", "metric")  # at most some hundred buckets each
    ranked = merged.withColumns({"upto": F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(w)})
    of_metric = lambda k: F.create_map(*[F.lit(x) for m in METRICS for x in (m, METRICS[m][k])])[F.col("metric")]
    quantile = lambda k: F.min(F.when(1000 * F.col("upto") >= of_metric(k) * F.col("total"), F.col("bucket")))
    fences = ranked.groupBy("level", "_lang", "_source", "metric").agg(quantile(3).alias("low"), quantile(4).alias("up"), F.max("total").alias("total"))
    reach = of_metric(5) * (bucket_value(F.col("up")) - bucket_value(F.col("low")))
    fences = fences.select("level", "_lang", "_source", "metric", "total", (bucket_value(F.col("low")) - reach).alias("lo"), (bucket_end(F.col("up")) + reach).alias("hi"))
    wide = fences.groupBy("level", "_lang", "_source").agg(F.max("total").alias("docs"), *[F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{m}_{side}") for m in METRICS for side in ("lo", "hi")])
    names = [f"{m}_{side}" for m in METRICS for side in ("lo", "hi")]
    own = wide.filter("level = 0")
    lang = wide.filter("level = 1").select("_lang", *[F.col(c).alias(f"lang_{c}") for c in ("docs", *names)])
    every = wide.filter("level = 2").first()  # one row of numbers; none without documents
    enough = lambda c: F.coalesce(F.col(c), F.lit(0)) >= LEAST_DOCS
    pick = [F.when(enough("docs"), F.col(c)).when(enough("lang_docs"), F.col(f"lang_{c}")).otherwise(F.lit(every[c] if every else None).cast("long")).alias(c) for c in names]
    return own.join(lang, "_lang", "left").select("_lang", "_source", *pick)


def judge(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the metrics, base_failed and ``kept``.

    ``kept`` is false where a base rule fails or a metric lies beyond the fences of its
    language and source. Null text has no words; null lang or source counts as ''. Input
    columns named like an output column give way to it. Repeated rows count each; an
    empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    docs, back = shield(docs, text_col, lang_col, source_col, *(keep or ()))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    scored = metrics(docs.withColumns({"_lang": blank(lang_col), "_source": blank(source_col)}), text_col)
    if keep is not None:
        scored = scored.select(*keep, *[c for c in scored.columns if c in MADE or c in ("_lang", "_source")])
    # metrics are computed once; sketches then read a few columns of this table, whatever the texts weigh
    scored = scratch.keep(scored.drop("kept", *[f"{m}_{s}" for m in METRICS for s in ("lo", "hi")]), "scored")
    limits = scratch.keep(cutoffs(sketches(scored)), "cutoffs")
    rows = [r for r in limits.limit(BROADCAST_GROUPS + 1).select(F.count(F.lit(1))).collect()]
    if rows[0][0] <= BROADCAST_GROUPS:
        joined = scored.join(F.broadcast(limits), ["_lang", "_source"], "left")
    else:
        salted = limits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = scored.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, ["_lang", "_source", "_salt"], "left").drop("_salt")
    inside = ~F.col("base_failed")
    for m, (*_, both) in METRICS.items():
        inside &= (_metric(m) <= F.col(f"{m}_hi")) & ((_metric(m) >= F.col(f"{m}_lo")) if both else F.lit(True))
    return joined.withColumn("kept", F.coalesce(inside, F.lit(False))).drop("_lang", "_source", *[f"{m}_{s}" for m in METRICS for s in ("lo", "hi")]).withColumnsRenamed(back)
