"""Line dedup by a log-template tree.

A line's words with digits are variable fields. The tree has a fixed depth: the number of words, then the
first ``DEPTH`` words. Two lines of a leaf that agree at ``SIMILAR`` percent of their places or more share a
template, with the other places generalised. A line whose template occurs in an earlier document (by id) is
dropped; so a recurring template's lines stay in the first document that has it.

The first document of each line's templates is found without comparing all pairs. Lines are counted into
leaves by hash, pre-aggregated before any shuffle, so a line that is in every document costs one row per
task, and the text of a line moves only if its leaf holds another one. A leaf of up to ``SMALL`` different
lines is compared within one row. In a larger one, all lines are compared with the ``SMALL`` of the earliest
documents, which settles the families of near copies. Lines that are like none of these are compared with all
lines of their node, ``SMALL`` per row, if there are up to ``MEDIUM`` of them. A larger node grows, one place
at a time, at the place with the most different words: a line goes to the node of its word there, and to the
node "any word", which takes one of the places that may differ. Alike lines always meet in a node, since they
go to the same one wherever they agree and to "any word" where they differ; a node out of places that may
differ has no "any word", and one where no line is left to settle ends. So the number of rounds depends on
the words of a line, not on the number of lines.

Defined results: a null text stays null; lines without a word are kept; rows with one id are one document,
so copies of a row drop nothing from each other; null ids come after all others and are one document; an
empty table gives an empty result; long texts and long lines are handled whole, in time proportional to
their length; all other columns pass through unchanged, whatever their names (``count_col`` replaces a
column of its name).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritext.llm.common import WORD_SEPARATORS, broadcast_if_small, let, written

DEPTH = 3
SIMILAR = 70
#: Different lines of a node that are compared within one row.
SMALL = 64
#: Different lines of a node up to which its unsettled lines are compared with all of them.
MEDIUM = 4096
FIELD = "<*>"
_DIGITS = "0123456789"
_LAST = (1 << 63) - 1


def masked(df: DataFrame, line_col: str) -> DataFrame:
    """Adds ``m``: the line with variable fields generalised and words joined by one space. Byte searches let
    most lines pass as they are; the work on the others is linear in their length."""
    line = F.col(line_col)
    uneven = line.contains("  ")
    for blank in "\t\x0b\x0c\r":
        uneven = uneven | line.contains(blank)
    df = df.withColumn("_even", F.when(uneven, F.regexp_replace(line, WORD_SEPARATORS, " ")).otherwise(line))
    df = df.withColumn("_even", F.btrim("_even", F.lit(" ")))
    even = F.col("_even")
    fields = F.transform(F.split(even, " "), lambda w: F.when(F.translate(w, _DIGITS, "") == w, w).otherwise(FIELD))
    return df.withColumn("m", F.when(F.translate(even, _DIGITS, "") != even, F.array_join(fields, " "))
                         .otherwise(even)).drop("_even")


def _leaf(m: Column) -> Column:
    """Number of words and first words of a masked line."""
    return F.xxhash64(F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit(""))), F.substring_index(m, " ", DEPTH))


def _lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, version, pos, m): the masked lines that have a word."""
    keyed = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"),
                      F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    # the keys come first: beside the explode they would be taken from the whole text once per line
    return (keyed.select("doc", "version", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
            .transform(masked, "line").drop("line").filter("m <> ''"))


def _first_alike(x: Column, members: Column) -> Column:
    """The least ``lo`` of the members (words, lo) that differ from ``x`` (words, may) at no more places than
    may differ; null without such."""
    def differ(y: Column) -> Column:
        unlike = F.zip_with(x["words"], y["words"], lambda a, b: (~a.eqNullSafe(b)).cast("int"))
        return F.aggregate(unlike, F.lit(0), lambda n, one: n + one)

    return F.array_min(F.transform(F.filter(members, lambda y: differ(y) <= x["may"]), lambda y: y["lo"]))


def _firsts(candidates: DataFrame, small: int, medium: int) -> DataFrame:
    """(own, first): the first document of any alike line, for the lines (node, own, words, may, lo) of a leaf.
    ``may``: places at which alike lines of the node may differ; a place of value null is done with."""
    found, state = [], written(candidates.withColumn("seeks", F.lit(True)), "line-nodes")
    while True:
        counts = state.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("seeks").alias("sought"))
        large = written(counts.filter(F.col("n") > small).select(F.col("node").alias("_large"), "sought", "n"), "line-large")
        at_large = F.col("node") == F.col("_large")
        rest = state.join(broadcast_if_small(large, 17), at_large, "left_anti")
        nodes = rest.groupBy("node").agg(F.collect_list(F.struct("own", "words", "may", "lo", "seeks")).alias("members"))
        compared = nodes.filter(F.size("members") > 1).select(F.explode(F.transform(  # at most ``small`` members each
            F.filter("members", lambda x: x["seeks"]),
            lambda x: F.struct(x["own"].alias("own"), _first_alike(x, F.col("members")).alias("first")))).alias("r"))
        found.append(written(compared.select("r.own", "r.first"), "line-firsts"))
        live = large.filter("sought").select("_large", "n")
        if live.isEmpty():
            break
        full = written(state.join(broadcast_if_small(live, 24), at_large).drop("_large"), "line-full")
        rank = F.row_number().over(Window.partitionBy("node").orderBy("lo", "own"))
        ranked = full.select("node", "words", "lo", "n", rank.alias("rank"))
        member = F.collect_list(F.struct("words", "lo"))
        heads = ranked.filter(F.col("rank") <= small).groupBy(F.col("node").alias("_node")).agg(member.alias("heads"))
        tried = full.filter("seeks").join(heads, F.col("node") == F.col("_node")).select("node", "own", _first_alike(
            F.struct("words", "may"), F.col("heads")).alias("first"))
        tried = written(tried, "line-tried")
        found.append(tried.filter("first IS NOT NULL").select("own", "first"))
        still = tried.filter("first IS NULL").select(F.col("node").alias("_n"), F.col("own").alias("_o"))
        left = written(full.join(still, (F.col("node") == F.col("_n")) & (F.col("own") == F.col("_o")), "left_semi"), "line-left")
        if left.isEmpty():
            break
        pieces = ranked.filter(F.col("n") <= medium).groupBy(
            F.col("node").alias("_node"), F.floor(F.col("rank") / small).alias("_piece")).agg(member.alias("members"))
        found.append(written(left.join(pieces, F.col("node") == F.col("_node")).select("own", _first_alike(
            F.struct("words", "may"), F.col("members")).alias("first")).filter("first IS NOT NULL"), "line-pieces"))
        open_ = written(left.filter(F.col("n") > medium).groupBy(F.col("node").alias("_open")).agg(
            F.count(F.lit(1)).alias("_lines")), "line-open")
        if open_.isEmpty():
            break
        full = full.drop("seeks", "n").join(broadcast_if_small(open_, 24), F.col("node") == F.col("_open"))
        places = (full.select("node", F.posexplode("words").alias("place", "word")).groupBy("node", "place")
                  .agg((F.min("word") < F.max("word")).alias("varies"), F.approx_count_distinct("word").alias("kinds")))
        split = written(places.filter("varies").groupBy(F.col("node").alias("_node")).agg(
            F.max_by("place", F.struct("kinds", -F.col("place"))).alias("place")), "line-places")
        at = full.join(broadcast_if_small(split, 24), F.col("node") == F.col("_node")).join(
            still, (F.col("node") == F.col("_n")) & (F.col("own") == F.col("_o")), "left")
        done_with = F.transform("words", lambda w, i: F.when(i != F.col("place"), w))
        exact = F.struct(F.xxhash64("node", "place", F.get("words", F.col("place"))).alias("node"), F.col("words").alias("words"),
                         F.col("may").alias("may"))
        either = F.struct(F.xxhash64("node", F.lit(-1), F.col("place")).alias("node"), done_with.alias("words"),
                          (F.col("may") - 1).alias("may"))
        grown = F.when(F.col("may") > 0, F.array(exact, either)).otherwise(F.array(exact))
        state = written(at.select("own", "lo", F.col("_o").isNotNull().alias("seeks"), F.explode(grown).alias("g")).select(
            "g.node", "own", "g.words", "g.may", "lo", "seeks"), "line-nodes")
    return reduce(DataFrame.unionByName, found).groupBy("own").agg(F.min("first").alias("first"))


def templates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL,
              medium: int = MEDIUM) -> DataFrame:
    """(doc, version, pos, first): each line of a recurring template, and the first document that has it."""
    own = F.xxhash64("m", F.lit(1))
    lines = written(_lines(df, id_col, text_col).select("doc", "version", "pos", _leaf(F.col("m")).alias("leaf"),
                                                       own.alias("own"), "m"), "lines")  # the texts are read once
    kinds = written(lines.groupBy("leaf", "own").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")), "line-kinds")

    # only leaves of two or more different lines, from two or more documents, can generalise
    shared = kinds.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    shared = written(shared.filter("n > 1 AND lo < hi").select(F.col("leaf").alias("_leaf")), "line-leaves")
    texts = (lines.select("leaf", "own", "m", "doc").join(broadcast_if_small(shared, 8), F.col("leaf") == F.col("_leaf"), "left_semi")
             .groupBy("leaf", "own", "m").agg(F.min("doc").alias("lo")))
    words = F.split("m", " ")
    firsts = _firsts(texts.select(F.col("leaf").alias("node"), "own", words.alias("words"),
                                  F.floor(F.size(words) * (100 - SIMILAR) / 100).cast("int").alias("may"), "lo"), small, medium)

    placed = kinds.join(firsts.withColumnRenamed("own", "_own"), F.col("own") == F.col("_own"), "left")
    recurring = placed.select(F.col("own").alias("_o"), "hi", F.least("lo", F.col("first")).alias("first"))
    recurring = recurring.filter("first < hi").drop("hi")
    return lines.select("doc", "version", "pos", "own").join(recurring, F.col("own") == F.col("_o")).select(
        "doc", "version", "pos", "first")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          count_col: str | None = "dropped_lines", small: int = SMALL, medium: int = MEDIUM) -> DataFrame:
    """``df`` with recurring lines dropped from the text, and their number (int) in ``count_col``."""
    gone = (templates(df.select(id_col, text_col), id_col, text_col, small, medium).filter(F.col("first") < F.col("doc"))
            .groupBy("doc", "version").agg(F.collect_set("pos").alias("gone")))  # at most a document's lines
    gone = written(gone, "line-dropped")
    row = F.col("row")
    keyed = df.select(F.struct(*(F.col(c) for c in df.columns)).alias("row"))  # no name of the input is in the way
    keyed = keyed.select("row", F.coalesce(row[id_col].cast("long"), F.lit(_LAST)).alias("of"),
                         F.xxhash64(row[text_col]).alias("text_hash"))
    out = keyed.join(gone, (F.col("of") == F.col("doc")) & (F.col("text_hash") == F.col("version")), "left")

    def left_over(pieces: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col("gone"))
        return F.array_join(F.transform(kept, lambda i: F.get(pieces, i)), "\n")

    text = F.when(F.col("gone").isNull(), row[text_col]).otherwise(let(F.split(row[text_col], "\n"), left_over))
    count = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    out = out.select("row", text.alias("left_text"), count.alias("left_count"))  # before names of the input come back
    return out.select(*(row[c].alias(c) for c in df.columns if c not in (text_col, count_col)),
                      F.col("left_text").alias(text_col), *([F.col("left_count").alias(count_col)] if count_col else []))
