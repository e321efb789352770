"""An index of pieces of texts: built once, probed by any number of needles, without going through the texts again.

A text's pieces are its distinct substrings of one, two and three characters. They lie in a table bucketed by piece, with a
second one of how many texts hold each, so a probe moves needles to the buckets and never the postings of pieces
that nobody asks for. A needle of up to three characters is a piece itself; a longer one is looked up by its two
rarest pieces, whose postings are intersected, and only the texts that remain are read. A needle with a piece that no text
has is done without a posting. Texts that many rows share are cut once: postings name the first row of each text.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.sources.scratch import scratch, written

LENGTHS = (1, 2, 3)


@dataclass(frozen=True)
class PieceIndex:
    texts: DataFrame  #: (pos, _text): each distinct text and the first row that has it
    rows: DataFrame  #: (pos, first): each row and the first one with its text
    postings: DataFrame  #: (piece, pos) of distinct texts, bucketed by piece
    counts: DataFrame  #: (piece, n), bucketed by piece


def _cut(text: str, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(starts, lambda i: F.call_function("substring", F.col(text), i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def _bucketed(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """df as a table bucketed by piece, one file a bucket, in the shared folder."""
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, "piece").write.bucketBy(buckets, "piece").sortBy("piece").option("path", scratch(df.sparkSession, name)).saveAsTable(table)
    return df.sparkSession.table(table)


def index_texts(texts: DataFrame, buckets: int | None = None) -> PieceIndex:
    """The index of texts(pos, _text); buckets default to the number of shuffle partitions."""
    buckets = buckets or int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = written(texts.select("pos", "_text"), "rows")
    kept = written(told.groupBy("_text").agg(F.min("pos").alias("pos")), "texts")
    rows = written(told.join(kept.withColumnRenamed("pos", "first").hint("merge"), "_text").select("pos", "first"), "first_rows")
    postings = _bucketed(kept.select(F.explode(F.concat(*[_cut("_text", n) for n in LENGTHS])).alias("piece"), "pos"), "pieces", buckets)
    return PieceIndex(kept, rows, postings, _bucketed(postings.groupBy("piece").agg(F.count("*").alias("n")), "piece_counts", buckets))


def holding(index: PieceIndex, needles: DataFrame) -> DataFrame:
    """(_needle, pos): for each distinct _needle of needles the rows whose texts hold it."""
    return rows_with(index, holding_texts(index, needles).withColumnRenamed("pos", "first")).select("_needle", "pos")


def rows_with(index: PieceIndex, found: DataFrame) -> DataFrame:
    """found(..., first) with the `pos` of all rows that have the text of the row `first`."""
    return index.rows.join(found.hint("merge"), "first").drop("first")


def holding_texts(index: PieceIndex, needles: DataFrame) -> DataFrame:
    """(_needle, pos): as `holding`, with the first row of each text only."""
    asked = needles.select("_needle").where("_needle <> ''").distinct()
    longest = max(LENGTHS)
    pieces = F.when(F.length("_needle") <= longest, F.array("_needle")).otherwise(_cut("_needle", longest))
    each = asked.select("_needle", F.size(pieces).alias("m"), F.explode(pieces).alias("piece"))
    known = each.join(index.counts, "piece").groupBy("_needle", "m").agg(F.array_sort(F.collect_list(F.struct("n", "piece"))).alias("p")).where(F.size("p") == F.col("m"))
    probes = written(known.select("_needle", F.col("p")[0]["piece"].alias("piece"), F.when(F.length("_needle") > longest, F.coalesce(F.get("p", F.lit(1)), F.col("p")[0])["piece"]).alias("second")), "probes")
    first = probes.join(index.postings, "piece")
    done = first.where("second is null").select("_needle", "pos")
    both = first.where("second is not null").select("_needle", "pos", F.col("second").alias("piece")).join(index.postings, ["piece", "pos"])
    found = both.select("_needle", "pos").join(index.texts, "pos").where(F.contains("_text", "_needle"))
    return done.unionByName(found.select("_needle", "pos"))
