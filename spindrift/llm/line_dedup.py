"""Line dedup with DataFrame functions only.

Keys of at least ``min_chars`` code points that stand in at least ``min_docs``
documents lose all their lines but those of the largest id.

Plan: lines are split and hashed once; a document's lines of one key meet as one
row with their positions, and this one exchange feeds both of what follows. On
one side partial counts under a salt, so that no key brings more than ``SALTS``
rows to a task, are range-partitioned by hash and sorted by hash, document
(newest first) and position: the first row of each hash in that stream is the
occurrence that stays. On the other side the verdicts meet the (hash, document)
rows in a sort-merge join that holds one verdict a key in memory; a key in a
large share of the documents is split by Spark's skew join. What comes back is a
keep bitmap per text, run-length-compressed; texts move once.

Hashes are 128 bits wide (two seeded XXH64), so texts of lines never move.
Null or empty text: one empty line. Rows of one id count as one document, and
each such row gets its own bitmap. An empty table gives no rows. The input may
have columns of any name: inside they go by number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.shared import text_or_empty

SALTS = 32
#: The white space stripped from a line's ends; the letters lower-cased.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_keys(lines: Column) -> Column:
    """The key of each line of an array of lines."""
    return F.transform(lines, lambda x: F.translate(F.btrim(x, F.lit(SPACE)), UPPER, LOWER))


#: Length of a bitmap's last run, which goes to the end of the text (Spark adds it to the start in 32 bits).
OPEN = 1 << 30


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per text that loses lines: (id, text_hash, keep binary, n_dropped).

    ``keep`` is the compressed bitmap: for each run of lines that stay its first
    line and its length, as big-endian 32-bit numbers; the last run is open.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.posexplode(line_keys(F.split(text, "\n"))).alias("pos", "key"))
    held = rows.where(F.char_length("key") >= min_chars).select("id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), F.col("key")).alias("h2"))
    per_doc = held.groupBy("h1", "h2", "id").agg(F.collect_set(F.struct("pos", "text_hash")).alias("at"))
    # both uses read the lists, so that they share one exchange
    newest = F.max(F.struct(F.col("id").isNotNull().alias("real"), "id", (-F.array_min("at")["pos"]).alias("place")))
    part = per_doc.groupBy("h1", "h2", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")).agg(F.sum((F.size("at") > 0).cast("long")).alias("n"), newest.alias("last"))
    part = part.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", F.col("last").desc())
    stream = Window.partitionBy("h1", "h2").orderBy(F.col("last").desc())
    whole = stream.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = part.select("h1", "h2", "last", F.row_number().over(stream).alias("nth"), F.sum("n").over(whole).alias("docs"))
    first = first.where((F.col("nth") == 1) & (F.col("docs") >= min_docs)).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("last.id").alias("stays"))
    gone = per_doc.join(first.hint("merge"), (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & ~F.col("id").eqNullSafe(F.col("stays")))
    gone = gone.select("id", F.explode("at").alias("at")).groupBy("id", F.col("at.text_hash").alias("text_hash")).agg(F.sort_array(F.collect_set("at.pos")).alias("p"))
    number = lambda c: F.lpad(F.hex(c.cast("long")), 8, "0")
    # runs that stay: from the line after each dropped run to the next one
    ends = F.concat(F.filter("p", lambda x, i: (i == 0) | (F.get("p", i - 1) != x - 1)), F.array(F.lit(OPEN)))
    starts = F.concat(F.array(F.lit(0)), F.transform(F.filter("p", lambda x, i: F.coalesce(F.get("p", i + 1) != x + 1, F.lit(True))), lambda x: x + 1))
    runs = F.filter(F.arrays_zip("starts", "ends"), lambda r: r["ends"] > r["starts"])
    keep = F.unhex(F.array_join(F.transform(runs, lambda r: F.concat(number(r["starts"]), number(F.when(r["ends"] == OPEN, OPEN).otherwise(r["ends"] - r["starts"])))), ""))
    return gone.withColumns({"starts": starts, "ends": ends}).select("id", "text_hash", keep.alias("keep"), F.size("p").cast("long").alias("n_dropped"))


def kept_lines(lines: Column, keep: Column) -> Column:
    """The lines that a bitmap keeps; all of them without one."""
    number = lambda i: F.conv(F.hex(F.substring(keep, i, 4)), 16, 10).cast("int")
    runs = F.sequence(F.lit(0), (F.octet_length(keep) / 8).cast("int") - 1)
    return F.when(keep.isNull(), lines).otherwise(F.flatten(F.transform(runs, lambda i: F.slice(lines, number(i * 8 + 1) + 1, number(i * 8 + 5)))))


def _cleaned(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """The columns of ``docs`` as c0, c1, ... with ``all_lines``, ``left`` (the lines that stay) and ``lost``."""
    at, of = (f"c{docs.columns.index(c)}" for c in (text_col, id_col))
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    bitmaps = keep_bitmaps(plain.select(of, at) if of != at else plain.select(of), of, at, min_chars, min_docs)
    keyed = plain.withColumn("own_hash", F.xxhash64(text_or_empty(at)))
    both = keyed.join(bitmaps, keyed[of].eqNullSafe(bitmaps["id"]) & (keyed["own_hash"] == bitmaps["text_hash"]), "left").withColumn("all_lines", F.split(text_or_empty(at), "\n"))
    return both.select(*plain.columns, "all_lines", kept_lines(F.col("all_lines"), F.col("keep")).alias("left"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("lost"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Columns ``id_col``, text (what stays), n_lines, n_dropped."""
    out = _cleaned(docs.select(id_col, text_col), id_col, text_col, min_chars, min_docs)
    return out.select(F.col("c0").alias(id_col), F.array_join("left", "\n").alias("text"), F.size("all_lines").cast("long").alias("n_lines"), F.col("lost").alias("n_dropped"))


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with its columns, dropped lines taken out of the text; texts that lose none are as they were."""
    out, at = _cleaned(docs, id_col, text_col, min_chars, min_docs), docs.columns.index(text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = F.when(F.col("lost") > 0, F.array_join("left", "\n")).otherwise(F.col(names[at]))
    return out.select(*names[:at], text.alias(names[at]), *names[at + 1 :]).toDF(*docs.columns)
