"""Document fingerprints: a Merkle tree over paragraphs and sections, in
DataFrame functions only.

Leaves are paragraphs: the text is cut after every line break and, so that a
text of one long line still has branches, after every sentence end. A section
closes after each leaf whose hash has three certain bits unset, so sections
are about eight leaves long and an edit moves the borders of its own section
only. A leaf's hash covers its text, a section's the hashes of its leaves, the
root those of the sections in their order. Printed form:

    root|section:leaf.length,leaf.length;section:...

(root 32 hex digits, sections 12, leaves 12, lengths in code points); parents
hash the whole hashes of their children. Equal texts have equal fingerprints;
roots of different texts differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unused

#: Cuts after a line break or after a sentence end and its spaces.
CUT = r"(?<=\n)|(?<=[.!?][\x20\x09])(?=[^\x20\x09\n])"


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the fingerprint of a text column (null: empty). The empty text
    has one empty leaf. Long texts have as many leaves as they have. An empty
    table gives no rows; equal rows get equal fingerprints."""
    full, sections = unused(df, "full"), unused(df, "sections")
    leaf = lambda x: F.concat(F.sha2(x.cast("binary"), 256), F.lit("."), F.length(x))
    leaves = F.array_join(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), CUT), leaf), ",")
    # a leaf whose twelfth digit is 0 or 8 ends its section
    df = df.withColumn(full, F.split(F.regexp_replace(leaves, r"([0-9a-f]{11}[08][0-9a-f]{52}\.\d+),", "$1;"), ";"))
    df = df.withColumn(sections, F.transform(full, lambda s: F.sha2(s.cast("binary"), 256)))
    root = F.substring(F.sha2(F.array_join(sections, "").cast("binary"), 256), 1, 32)
    short = F.regexp_replace(F.array_join(full, ";"), r"([0-9a-f]{12})[0-9a-f]{52}\.", "$1.")
    shown = F.zip_with(sections, F.split(short, ";"), lambda s, own: F.concat(F.substring(s, 1, 12), F.lit(":"), own))
    return df.withColumn(name, F.concat(root, F.lit("|"), F.array_join(shown, ";"))).drop(full, sections)


def _weight(leaves: Column) -> Column:
    return F.aggregate(leaves, F.lit(0).cast("long"), lambda total, x: total + F.substring_index(x, ".", -1).cast("long"))


def with_likeness(df: DataFrame, one: str, other: str, name: str) -> DataFrame:
    """The share, 0 to 1, of the code points of both trees that stand in leaves
    which the other tree has too (repeated leaves count once). Equal roots: 1. Sections that both have are taken whole;
    only the leaves of differing sections are compared. Null if either is."""
    parts = lambda c: F.split(F.substring_index(F.col(c), "|", -1), ";")
    leaves = lambda s: F.array_distinct(F.flatten(F.transform(s, lambda x: F.split(F.substring_index(x, ":", -1), ","))))
    a, b, c, same, both, everything = (unused(df, x) for x in ("a", "b", "c", "same", "both", "everything"))
    df = df.withColumns({a: F.array_distinct(parts(one)), b: F.array_distinct(parts(other))})
    df = df.withColumn(same, F.array_intersect(a, b))
    df = df.withColumns({c: leaves(F.col(same)), a: leaves(F.array_except(a, same)), b: leaves(F.array_except(b, same))})
    df = df.withColumns({a: F.array_except(a, c), b: F.array_except(b, c)})
    df = df.withColumn(both, _weight(F.col(c)) + _weight(F.array_intersect(a, b)))
    df = df.withColumn(everything, _weight(F.col(c)) + _weight(F.array_union(a, b)))
    root = lambda x: F.substring_index(F.col(x), "|", 1)
    likeness = F.when(root(one) == root(other), 1.0).when(F.col(everything) == 0, 0.0).otherwise(2 * F.col(both) / (F.col(both) + F.col(everything)))
    return df.withColumn(name, F.when(F.col(one).isNull() | F.col(other).isNull(), F.lit(None)).otherwise(likeness)).drop(a, b, c, same, both, everything)


def differing_sections(df: DataFrame, one: str, other: str) -> DataFrame:
    """df with `changed`, the sections of `one` that `other` does not have:
    the branches in which an edit lies."""
    parts = lambda c: F.split(F.substring_index(F.col(c), "|", -1), ";")
    return df.withColumn("changed", F.array_except(parts(one), parts(other)))


def with_next(df: DataFrame, key: str, columns: list[str], rows_a_range: int = 2000) -> DataFrame:
    """df with next_<column>: the values of the row that follows in descending
    order of key (after the last: the first). Rows are dealt to ranges of the
    key, so there is no global window: each range also gets a copy of the
    first row of the range after it, and the last range one of the very first
    row. Rows of equal key follow each other in the order of `columns`; null
    keys come last."""
    spark = df.sparkSession
    df = df.withColumn("_order", F.coalesce(-F.col(key).cast("decimal(20,0)"), F.lit("99999999999999999999").cast("decimal(20,0)")))
    keys = df.select(F.col("_order").cast("double").alias("o"))
    total = keys.count()
    if not total:
        return df.withColumns({f"next_{c}": F.col(c) for c in columns}).drop("_order")
    cuts = max(1, min(20_000, total // rows_a_range))
    edges = keys.select(F.explode(F.percentile_approx("o", [k / cuts for k in range(1, cuts)], 100 * cuts)).alias("edge")).distinct() if cuts > 1 else None
    bounds = sorted(r.edge for r in edges.collect()) if edges is not None else []  # cuts at most
    place = F.col("_order").cast("double")
    if bounds:
        sorted_edges = F.broadcast(spark.createDataFrame([(bounds,)], "bounds array<double>"))
        df = df.crossJoin(sorted_edges)  # one row
        # binary search: fifteen halvings reach 20,000 edges
        df = df.withColumn("_range", F.expr(f"""aggregate(sequence(1, {len(bounds).bit_length() + 1}), struct(0 AS lo, {len(bounds)} AS hi),
            (s, i) -> if(s.lo < s.hi, if(bounds[cast((s.lo + s.hi) / 2 as int)] < cast(_order as double),
                struct(cast((s.lo + s.hi) / 2 as int) + 1 AS lo, s.hi AS hi), struct(s.lo AS lo, cast((s.lo + s.hi) / 2 as int) AS hi)), s)).lo""")).drop("bounds")
    else:
        df = df.withColumn("_range", F.lit(0))
    tie = F.xxhash64(*columns)
    df = df.withColumn("_tie", tie)
    # the first row of each range: as many rows as ranges, by an aggregate
    heads = df.groupBy("_range").agg(F.min(F.struct("_order", "_tie")).alias("h")).collect()
    ranges = sorted(r._range for r in heads)
    before = {r: ranges[i - 1] for i, r in enumerate(ranges)}  # the first range's goes to the last one
    first = {r._range: r.h for r in heads}
    info = F.broadcast(spark.createDataFrame([(r, first[r]._order, first[r]._tie, before[r], i == 0) for i, r in enumerate(ranges)], "_range int, _ho decimal(20,0), _ht long, _before int, _wrap boolean"))
    df = df.join(info, "_range")
    is_head = (F.col("_order") == F.col("_ho")) & (F.col("_tie") == F.col("_ht"))
    own = F.struct(F.col("_range").alias("r"), F.lit(0).alias("copy"))
    copy = F.struct(F.col("_before").alias("r"), F.lit(1).alias("copy"))
    df = df.withColumn("_to", F.explode(F.when(is_head, F.array(own, copy)).otherwise(F.array(own)))).drop("_range", "_ho", "_ht", "_before", "_wrap")
    window = Window.partitionBy("_to.r").orderBy("_to.copy", "_order", "_tie")
    df = df.withColumns({f"next_{c}": F.lead(c).over(window) for c in columns} | {"_more": F.lead("_order").over(window).isNotNull()})
    return df.filter("_to.copy = 0").drop("_to", "_order", "_tie", "_more")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its fingerprint, that of its edited text (the last third
    replaced by the start of the next document's), and how like its own are
    the edited text's and the next document's. Null texts count as empty; a
    single document is its own next."""
    docs = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = with_fingerprint(docs, "text", "fingerprint")
    near = with_next(docs, "doc_id", ["text", "fingerprint"])
    near = near.withColumn("n_chars", F.length("text").cast("long")).withColumn("_cut", F.floor(F.col("n_chars") / 3).cast("int"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("_cut")).cast("int")), F.substring("next_text", F.lit(1), F.col("_cut")))
    near = near.withColumn("_edited", edited).drop("text", "next_text", "_cut")
    near = near.withColumn("edited_sha256", F.sha2(F.col("_edited").cast("binary"), 256))
    near = with_fingerprint(near, "_edited", "edited_fingerprint").drop("_edited")
    near = with_likeness(near, "fingerprint", "edited_fingerprint", "near_edited")
    near = with_likeness(near, "fingerprint", "next_fingerprint", "near_next")
    return near.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
