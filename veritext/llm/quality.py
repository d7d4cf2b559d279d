"""Quality rules with adaptive thresholds.

Each document's measures are counted into mergeable quantile sketches: histograms whose buckets keep
the two leading digits of a value (so every quantile is known to a tenth of its value or better), one
per language, source and measure. Sketches merge by adding counts, so a (language, source) with few
documents uses its language's sketch, and a small language the whole corpus's. The upper and lower
fence of each measure follow from two of the sketch's quantiles alone (``FENCES``), with no fixed width or
floor: where nearly all documents of a group have no symbols, few symbols are too many. The fences are joined
back to the documents, and a document beyond any fence goes. A fixed base rule (too few words, or too
repetitive) applies too.

Defined results: a null or empty text has no words and fails the base rule; null languages and sources
are groups of their own; repeated rows count as often as they occur and are judged alike; an empty table
gives an empty result; long texts are judged whole; other columns may have any name, only the named ones are
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritext.llm.common import WORD_SEPARATORS, let, words, written

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Documents that a group's own sketch needs; below, the next wider sketch is used.
MIN_GROUP = 200
#: Per measure: two quantiles of the sketch, in percent, and how many times their distance the fences lie
#: beyond them. Word lengths spread on both sides; symbols and repeated lines are absent from most documents,
#: so their fences start further out.
FENCES = {"word_len": (25, 75, 8), "symbols": (50, 90, 4), "dup_lines": (50, 99, 1)}


def _repeat_words(w: Column) -> Column:
    """Words covered by the 5-word windows that occur twice or more in the text."""
    last = F.size(w) - WINDOW  # 0-based start of the last window
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(
        F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))
    windows = F.transform(starts, lambda i: F.struct(
        F.concat_ws(" ", *(F.get(w, i + k) for k in range(WINDOW))).alias("s"), i.alias("i")))

    def covered(ordered: Column) -> Column:  # windows in order of their words
        n = F.size(ordered)
        twice = F.filter(ordered, lambda x, j:
                         ((j > 0) & (F.get(ordered, j - 1)["s"] == x["s"]))
                         | ((j + 1 < n) & (F.get(ordered, j + 1)["s"] == x["s"])))
        return let(F.array_sort(F.transform(twice, lambda x: x["i"])), spans)

    def spans(at: Column) -> Column:  # each start covers up to the next one, five words at most
        return F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(at) - 1, F.lit(0))), F.lit(0), lambda total, j:
                           total + F.when(F.size(at) == 0, 0).when(j + 1 < F.size(at), F.least(
                               F.lit(WINDOW), F.get(at, j + 1) - F.get(at, j))).otherwise(WINDOW))

    # most texts repeat no window: distinct hashes prove it, the words themselves decide the others
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
        let(F.array_sort(windows), covered)))


def measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` without its text, with n_words, word_chars, n_symbols, n_dup_lines, n_lines,
    n_repeat_words (long)."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")
    others = [c for c in df.columns if c not in (*names, text_col)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = df.select(*others, text.alias("_text"), words(F.col(text_col)).alias("_w"), lines.alias("_lines"))
    bare = F.regexp_replace("_text", WORD_SEPARATORS, "")
    return base.select(
        *others, F.size("_w").cast("long").alias("n_words"), F.char_length(bare).cast("long").alias("word_chars"),
        (F.char_length("_text") - F.char_length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        let(F.col("_w"), _repeat_words).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return ((F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def ratios() -> dict[str, Column]:
    """The measures that get fences, as whole numbers per thousand."""
    def per(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.expr(f"(1000 * {a}) div {b}")).otherwise(F.lit(0).cast("long"))

    return {"word_len": per("word_chars", "n_words"), "symbols": per("n_symbols", "word_chars"),
            "dup_lines": per("n_dup_lines", "n_lines")}


def bucket(value: Column) -> Column:
    """Keeps the two leading digits of a whole number."""
    unit = F.pow(F.lit(10), F.greatest(F.length(value.cast("string")) - 2, F.lit(0))).cast("long")
    return value - value % unit


def sketches(measured: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, measure, bucket, n) of the documents that pass the base rule."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), bucket(v).alias("bucket"))
                                for k, v in ratios().items()))).alias("m")
    return (measured.filter(~base_failed())
            .select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), pairs)
            .groupBy("lang", "source", "m.measure", "m.bucket").agg(F.count(F.lit(1)).alias("n")))


def fences(sketch: DataFrame) -> DataFrame:
    """(lang, source, <measure>_low, <measure>_high) for each (lang, source) of the sketches."""
    by_lang = sketch.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    whole = by_lang.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))

    def spec(i: int) -> Column:
        return F.element_at(F.create_map(*(F.lit(x) for m, f in FENCES.items() for x in (m, f[i]))), F.col("measure"))

    def quantiles(s: DataFrame, keys: list[str]) -> DataFrame:
        # a sketch has about 90 buckets per power of ten: these windows hold buckets, not documents
        upto = Window.partitionBy(*keys, "measure").orderBy("bucket")
        every = Window.partitionBy(*keys, "measure")
        ranked = s.select(*keys, "measure", "bucket", F.sum("n").over(upto).alias("_upto"),
                          F.sum("n").over(every).alias("docs"))
        return ranked.groupBy(*keys, "measure").agg(
            F.max("docs").alias("docs"),
            *(F.min(F.when(100 * F.col("_upto") >= spec(i) * F.col("docs"), F.col("bucket"))).alias(q)
              for i, q in enumerate(("q1", "q3"))))

    own = quantiles(sketch, ["lang", "source"])
    lang = quantiles(by_lang, ["lang"]).select(
        F.col("lang").alias("l_lang"), F.col("measure").alias("l_measure"),
        *(F.col(c).alias(f"l_{c}") for c in ("docs", "q1", "q3")))
    every = quantiles(whole, []).select(F.col("measure").alias("a_measure"),
                                        *(F.col(c).alias(f"a_{c}") for c in ("q1", "q3")))
    j = (own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("measure") == F.col("l_measure")))
         .join(every, F.col("measure") == F.col("a_measure")))

    def pick(q: str) -> Column:
        return (F.when(F.col("docs") >= MIN_GROUP, F.col(q))
                .when(F.col("l_docs") >= MIN_GROUP, F.col(f"l_{q}")).otherwise(F.col(f"a_{q}")))

    reach = spec(2) * (pick("q3") - pick("q1"))
    fence = j.select("lang", "source", "measure", (pick("q1") - reach).alias("low"), (pick("q3") + reach).alias("high"))
    return fence.groupBy("lang", "source").agg(
        *(F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}")
          for m in FENCES for side in ("low", "high")))


def judge(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
          keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the measures, ``base_failed`` and ``kept`` per row of ``df``."""
    m = measures(df.select(*(F.col(c).alias(f"_k_{c}") for c in keep), F.col(lang_col).alias("_lang"),
                           F.col(source_col).alias("_source"), F.col(text_col).alias("_body")), "_body")
    m = written(m, "quality-measures")  # narrow; the texts are read once
    limits = fences(sketches(m, "_lang", "_source"))
    inside = F.lit(True)
    for name, value in ratios().items():
        inside = inside & F.coalesce(value.between(F.col(f"{name}_low"), F.col(f"{name}_high")), F.lit(True))
    out = m.withColumn("base_failed", base_failed()).join(
        limits, F.col("_lang").eqNullSafe(F.col("lang")) & F.col("_source").eqNullSafe(F.col("source")), "left")
    return out.withColumn("kept", ~F.col("base_failed") & inside).select(
        *(F.col(f"_k_{c}").alias(c) for c in keep), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept")


def accepted(df: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source",
             text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that pass. Rows are matched by id and hash of the text."""
    row = F.col("row")
    rows = df.select(F.struct(*(F.col(c) for c in df.columns)).alias("row"))  # no name of the input is in the way
    version = F.xxhash64(row[lang_col], row[source_col], row[text_col])
    rows = rows.select("row", row[id_col].alias("id"), version.alias("version"), row[lang_col].alias("lang"),
                       row[source_col].alias("source"), row[text_col].alias("text"))
    good = judge(rows, "lang", "source", "text", keep=("id", "version")).filter("kept").select(
        F.col("id").alias("_id"), F.col("version").alias("_v"))
    kept = rows.select("row", "id", "version").join(
        good, F.col("id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_v")), "left_semi")
    return kept.select(*(row[c].alias(c) for c in df.columns))
