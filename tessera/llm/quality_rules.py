"""Quality rules whose cutoffs adapt to language and source, by DataFrame operations only.

Each document's measures (symbols, characters, repeats and repeated lines, per thousand) are counted into histograms with
buckets of 1/32 relative width, one for each language and source. Such a histogram is a quantile sketch that merges exactly
by addition: sources merge to languages, languages to all. Quantiles of a group give its fences (quartiles plus a multiple
of their distance plus a least width); groups of fewer than ``MIN_DOCS`` documents use their language's, or else everyone's.
Documents are then joined with their group's fences and kept if every measure lies inside.

Null texts have no words and fail the base rules. A null language or source is a group of its own together with the empty
name. Ties and repeated rows count each time; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tessera.llm.common import load, materialise

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
MIN_DOCS = 100
#: Groups whose fences may be broadcast at most (about 100 bytes each); more are joined by key.
BROADCAST_GROUPS = 50_000
#: Measure: multiple of the quartiles' distance, least width above, and whether low values count too.
MEASURES = {"symbols": (4, 150, False), "chars": (6, 2500, True), "dup_lines": (4, 300, False), "repeats": (4, 120, False)}


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Counts over each whole text: words, their characters, symbols, lines, repeated lines, words in repeated windows."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"), body.alias("body"))
    split = base.select(
        "doc_id", "lang", "source", F.filter(F.split("body", SPACE), lambda w: w != "").alias("words"), F.regexp_count("body", F.lit(SYMBOLS)).alias("n_symbols"),
        F.filter(F.split("body", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"),
    )
    words = F.col("words")
    hashed = F.transform(F.slice(words, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, WINDOW))))
    counted = split.select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), hashed.alias("h"),
    )
    return counted.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.when(F.size(F.array_distinct("h")) == F.size("h"), F.lit(0).cast("long")).otherwise(_covered(F.col("h"))).alias("n_repeat_words"),
    )


def _covered(h: Column) -> Column:
    """Places that lie in a window whose hash occurs again: sort hashes with their places, keep those beside an equal, add up the union of their windows."""
    order = F.sort_array(F.transform(h, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))

    # Runs of equal hashes, by one pass that remembers the hash before and after.
    shifted = F.arrays_zip(order.alias("x"), F.concat(F.array(F.lit(None).cast("bigint")), order["v"]).alias("p"), F.concat(F.slice(order["v"], 2, F.size(h)), F.array(F.lit(None).cast("bigint"))).alias("n"))
    twice = F.filter(shifted, lambda z: z["x"].isNotNull() & (F.coalesce(z["p"] == z["x"]["v"], F.lit(False)) | F.coalesce(z["n"] == z["x"]["v"], F.lit(False))))
    places = F.sort_array(F.transform(twice, lambda z: z["x"]["i"]))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(places, start, lambda a, p: F.struct((a["sum"] + F.least(F.lit(WINDOW), p - a["last"])).alias("sum"), p.alias("last")), lambda a: a["sum"])


def _bucket(v: Column) -> Column:
    """Values up to 63 as they are, then 32 buckets for each power of two. Integer arithmetic only."""
    shift = F.length(F.bin(v)) - 6
    return F.when(v < 64, v).otherwise(shift * 32 + F.expr("shiftright(value, length(bin(value)) - 6)"))


def _low(bucket: Column) -> Column:
    """The least value of a bucket."""
    shift = F.floor(bucket / 32) - 1
    return F.when(bucket < 64, bucket).otherwise((F.pmod(bucket, F.lit(32)) + 32) * F.pow(F.lit(2), shift)).cast("long")


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: the histograms of all groups."""
    w = F.greatest(F.col("n_words"), F.lit(1))
    per = {"symbols": F.col("n_symbols"), "chars": F.col("word_chars"), "repeats": F.col("n_repeat_words")}
    values = [F.struct(F.lit(k).alias("measure"), F.floor(v * 1000 / w).cast("long").alias("value")) for k, v in per.items()]
    values.append(F.struct(F.lit("dup_lines").alias("measure"), F.floor(F.col("n_dup_lines") * 1000 / F.greatest(F.col("n_lines"), F.lit(1))).cast("long").alias("value")))
    rows = measured.where("n_words > 0").select("lang", "source", F.inline(F.array(*values)))
    return rows.withColumn("bucket", _bucket(F.col("value")).cast("long")).groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def _fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Quartiles of each group's merged sketch, and the fences they give."""
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*by, "measure")
    run = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(group))
    cut = lambda share: _low(F.min(F.when(F.col("upto") * 4 >= F.col("total") * share, F.col("bucket"))))
    quartiles = run.groupBy(*by, "measure").agg(F.max("total").alias("total"), cut(1).alias("q1"), cut(3).alias("q3"))
    times = F.create_map(*(F.lit(x) for k, (t, _, _) in MEASURES.items() for x in (k, t)))[F.col("measure")]
    least = F.create_map(*(F.lit(x) for k, (_, w, _) in MEASURES.items() for x in (k, w)))[F.col("measure")]
    width = times * (F.col("q3") - F.col("q1")) + least
    fenced = quartiles.select(*by, "measure", "total", (F.col("q3") + width).alias("hi"), (F.col("q1") - width).alias("lo"))
    wide = fenced.groupBy(*by).agg(F.max("total").alias("total"), *(f(F.when(F.col("measure") == k, F.col(c))).alias(f"{k}_{c}") for k in MEASURES for c, f in (("hi", F.max), ("lo", F.max))))
    return wide


def thresholds(sketch: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Fences of every language and source, from its own sketch or a merged one."""
    names = [f"{k}_{c}" for k in MEASURES for c in ("hi", "lo")]
    own, byl, every = (_fences(sketch, by) for by in (["lang", "source"], ["lang"], []))
    byl = byl.select("lang", F.struct("total", *names).alias("l"))
    every = every.select(F.struct(*names).alias("e"))  # one row
    joined = own.join(byl, "lang").join(F.broadcast(every))
    pick = lambda c: F.when(F.col("total") >= min_docs, F.col(c)).when(F.col("l.total") >= min_docs, F.col("l")[c]).otherwise(F.col("e")[c])
    return joined.select("lang", "source", F.col("total").alias("group_docs"), *(pick(c).alias(c) for c in names))


def apply_rules(measured: DataFrame, fences: DataFrame) -> DataFrame:
    """Joins documents with their group's fences: base_failed and kept."""
    small = fences.count() <= BROADCAST_GROUPS
    rows = measured.join(F.broadcast(fences) if small else fences, ["lang", "source"], "left")
    w = F.greatest(F.col("n_words"), F.lit(1))
    value = {
        "symbols": F.col("n_symbols") * 1000 / w, "chars": F.col("word_chars") * 1000 / w, "repeats": F.col("n_repeat_words") * 1000 / w,
        "dup_lines": F.col("n_dup_lines") * 1000 / F.greatest(F.col("n_lines"), F.lit(1)),
    }
    inside = F.lit(True)
    for k, (_, _, both) in MEASURES.items():
        v = F.floor(value[k])
        inside = inside & (v <= F.col(f"{k}_hi"))
        if both:
            inside = inside & (v >= F.col(f"{k}_lo"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.coalesce(inside, F.lit(True))).alias("kept"))


def filter_documents(docs: DataFrame, **columns: str) -> DataFrame:
    """The measures and verdict of every document."""
    measured = materialise(measure(docs, **columns), "measures")
    return apply_rules(measured, materialise(thresholds(materialise(sketches(measured), "sketches")), "fences"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_documents(load(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same rows in SQL, for tables whose ids are unique."""
    values = {"symbols": "n_symbols * 1000 // greatest(n_words, 1)", "chars": "word_chars * 1000 // greatest(n_words, 1)", "dup_lines": "n_dup_lines * 1000 // greatest(n_lines, 1)", "repeats": "n_repeat_words * 1000 // greatest(n_words, 1)"}
    long = " union all ".join(f"select lang, source, '{k}' measure, {v} v from m where n_words > 0" for k, v in values.items())
    low = lambda share: f"min(bucket) filter (upto * 4 >= total * {share})"
    least = lambda b: f"case when {b} < 64 then {b} else ({b} % 32 + 32) << ({b} // 32 - 1) end"
    times = "case measure " + " ".join(f"when '{k}' then {t}" for k, (t, _, _) in MEASURES.items()) + " end"
    width = "case measure " + " ".join(f"when '{k}' then {w}" for k, (_, w, _) in MEASURES.items()) + " end"

    def fences(name: str, by: str) -> str:
        keys = by + ", " if by else ""
        return f"""{name}_r as (select {keys}measure, bucket, sum(sum(n)) over (partition by {keys}measure order by bucket) upto, sum(sum(n)) over (partition by {keys}measure) total from s group by {keys}measure, bucket),
{name}_q as (select {keys}measure, max(total) total, {low(1)} b1, {low(3)} b3 from {name}_r group by {keys}measure),
{name}_f as (select {keys}measure, total, {least('b1')} q1, {least('b3')} q3 from {name}_q),
{name} as (select {keys}measure, total, q3 + ({times}) * (q3 - q1) + {width} hi, q1 - ({times}) * (q3 - q1) - {width} lo from {name}_f)"""

    inside = " and ".join(f"{v} <= t.{k}_hi" + (f" and {v} >= t.{k}_lo" if MEASURES[k][2] else "") for k, v in values.items())
    wide = ", ".join(f"max({c}) filter (measure = '{k}') {k}_{c}" for k in MEASURES for c in ("hi", "lo"))
    return rf"""with d as (select doc_id, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') body from documents),
w as (select *, list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') words, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) lines from d),
g as (select doc_id, i, words[i:i + 4] win from w, unnest(range(1, len(words) - 3)) t(i)),
c as (select doc_id, i, count(*) over (partition by doc_id, win) n from g),
r as (select doc_id, count(distinct i + k) n_repeat_words from c, range(0, 5) t(k) where n > 1 group by doc_id),
m as (select w.doc_id, lang, source, len(words)::bigint n_words, length(array_to_string(words, ''))::bigint word_chars, (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
  len(lines)::bigint n_lines, (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines, coalesce(n_repeat_words, 0)::bigint n_repeat_words from w left join r on w.doc_id = r.doc_id),
l as ({long}),
s as (select lang, source, measure, case when v < 64 then v else (length(bin(v)) - 6) * 32 + (v >> (length(bin(v)) - 6)) end bucket, count(*) n from l group by all),
{fences("own", "lang, source")}, {fences("byl", "lang")}, {fences("every", "")},
p as (select own.lang, own.source, measure, case when own.total >= {MIN_DOCS} then own.hi when byl.total >= {MIN_DOCS} then byl.hi else every.hi end hi, case when own.total >= {MIN_DOCS} then own.lo when byl.total >= {MIN_DOCS} then byl.lo else every.lo end lo from own join byl using (lang, measure) join every using (measure)),
t as (select lang, source, {wide} from p group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and coalesce({inside}, true) kept from m left join t using (lang, source)"""


SQL = _sql()
