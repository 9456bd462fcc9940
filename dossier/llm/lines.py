"""Substring deduplication by hashes of lines and the sentences in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dossier.llm.common import numbered, save, with_first

#: Where a unit ends: behind a line feed, or behind the white space after a full stop, exclamation or question mark.
ENDS = r"(?<=[.!?]\s)|(?<=\n)"
#: Words that a run of repeated units needs to be removed: single short lines that many texts share stay.
LEAST = 20
#: Units of fewer words aren't compared; they go where the units on both sides of them go.
SHORT = 4


def units(text: Column) -> Column:
    """The text's units, which joined give the text again."""
    return F.split(text, ENDS, -1)


def normalised(unit: Column) -> Column:
    """The form that is compared: ASCII white space collapsed and trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(unit, r"[ \t\n\x0B\f\r]+", " ")))


def repeated_units(rows: DataFrame, least: int = LEAST, short: int = SHORT) -> DataFrame:
    """For those of rows (_rid, doc_id, text) that have units of `short` words or more: _rid, n_units (how many), runs and n_removed.

    runs (null if nothing goes) are the runs of units that go, as sorted array of struct (first, last) of unit numbers; n_removed is how many of those
    units they hold. A unit is repeated if one of the same normalised form comes earlier by (doc_id, row,
    number). Repeated units that follow each other, but for shorter ones between them, form a run; it goes if they have `least`
    words or more. Units meet by two 64-bit hashes of their form.

    First the hashes alone are counted, so that only units that have an equal go on to be ranked.
    """
    each = rows.select("_rid", "doc_id", F.transform(units(F.col("text")), lambda u, i: F.struct(i.alias("at"), normalised(u).alias("form"))).alias("u"))
    each = each.select("_rid", "doc_id", F.posexplode(F.filter("u", lambda u: n_words(u["form"]) >= short)).alias("k", "u"))
    each = save(each.select("_rid", "doc_id", "k", "u.at", n_words(F.col("u.form")).alias("words"), F.xxhash64("u.form").alias("h"), F.xxhash64(F.lit(short), "u.form").alias("g")), "units")
    often = save(each.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1").select("h", "g"), "often")
    again = save(each.join(often, ["h", "g"]), "again")
    place = F.struct("doc_id", "_rid", "at")
    gone = with_first(again.withColumn("key", F.struct("h", "g")), "key", place, F.col("_rid")).where(place != F.col("first")).select("_rid", "k", "at", "words")
    row = F.row_number().over(W.partitionBy("_rid").orderBy("k"))
    runs = gone.withColumn("run", F.col("k") - row).groupBy("_rid", "run").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"), F.sum("words").alias("words"))
    gone = runs.where(F.col("words") >= least).groupBy("_rid").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"), F.sum("n").alias("n_removed"))
    return each.groupBy("_rid").agg(F.count("*").alias("n_units")).join(gone, "_rid", "left")


def n_words(form: Column) -> Column:
    return F.when(form == "", 0).otherwise(F.size(F.split(form, " ")))


def drop_repeated_lines(docs: DataFrame, least: int = LEAST, short: int = SHORT, stable: bool = False) -> DataFrame:
    """docs (doc_id, text) with text replaced by what stays, and n_units, n_removed and spans.

    spans are the removed runs' offsets in the original text in code points, as sorted array of struct (start, end); n_units
    and n_removed count units of `short` words or more. Null text stays null and has no units, null doc_ids rank first. Columns of docs
    with one of the three names are replaced. A long line is cut into sentences, since repeated passages stand inside lines as
    well. See repeated_units for the rules and numbered for stable.
    """
    rows = numbered(docs, stable)
    found = repeated_units(rows.select("_rid", "row.doc_id", "row.text"), least, short)
    joined = rows.join(found, "_rid", "left")

    def cut(u: Column) -> Column:
        kept = F.filter(u, lambda x, i: ~F.exists("runs", lambda r: i.between(r["first"], r["last"])))
        upto = lambda n: F.aggregate(F.slice(u, 1, n), F.lit(0).cast("long"), lambda acc, x: acc + F.length(x))
        spans = F.transform("runs", lambda r: F.struct(upto(r["first"]).alias("start"), upto(r["last"] + 1).alias("end")))
        return F.struct(F.array_join(kept, "").alias("text"), spans.alias("spans"))

    # Only a text that loses something is split again, and once.
    done = F.when(F.col("runs").isNotNull(), F.get(F.transform(F.array(units(F.col("row.text"))), cut), F.lit(0)))
    joined = joined.select("row", "n_units", "n_removed", done.alias("done"))
    own = {
        "text": F.when(F.col("done").isNull(), F.col("row.text")).otherwise(F.col("done.text")),
        "n_units": F.coalesce("n_units", F.lit(0)).cast("long"),
        "n_removed": F.coalesce("n_removed", F.lit(0)).cast("long"),
        "spans": F.coalesce("done.spans", F.array().cast("array<struct<start:bigint,end:bigint>>")),
    }
    same = {k: None for k in own} | {c: None for c in docs.columns if c.lower() in own}
    return joined.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in same], *[x.alias(k) for k, x in own.items()])
