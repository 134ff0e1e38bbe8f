"""Around retrieval: texts as models want them, pooled vectors, documents by rank, results as text and as a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What goes before a query and a passage for a family of models.
PREFIXES = {"e5": ("query: ", "passage: "), "bge": ("Represent this sentence for searching relevant passages: ", "")}
#: Statuses of a search and what a failed one answers; the line between queries' results.
STATUSES = ("api_error", "unknown_api_state", "no_results", "success")
BETWEEN, NOTHING, UNKNOWN, FAILED = "\n---\n", "No search results found.", "Unknown API state (no response and no error message).", "Search error: "


def prefixed(model: str, text: Column, query: bool = True) -> Column:
    """The text with what its model wants before it, by the model's name; every family in a name adds its own."""
    out = text
    for family, both in PREFIXES.items():
        if family in model.lower():
            out = F.concat(F.lit(both[0 if query else 1]), out)
    return out


def pooled(tokens: DataFrame, how: str, model: str, by: str = "seq", pos: str = "pos", vector: str = "v", mask: str = "mask", pooler: DataFrame | None = None) -> DataFrame:
    """(by, i, x): a sequence's vector from token vectors: the mean over set places, the first place, or the pooler's own vector.

    Vectors get length 1, but for DPR models. A sequence without a set place has no mean. The pooler's rows are (by, vector).
    """
    each = lambda df: df.select(by, F.col(pos).alias("_p"), F.col(mask).alias("_m"), F.posexplode(vector).alias("i", "_v")).withColumn("_v", F.col("_v").cast("double"))
    if how == "mean":
        out = each(tokens).groupBy(by, "i").agg(F.try_divide(F.sum(F.when(F.col("_m") > 0, F.col("_v")).otherwise(0.0)), F.sum((F.col("_m") > 0).cast("int"))).alias("x"))
    elif how == "cls":
        out = each(tokens).groupBy(by, "i").agg(F.min_by("_v", "_p").alias("x"))
    elif how == "pooler":
        if pooler is None:
            raise ValueError("no output of a pooler")
        out = pooler.select(by, F.posexplode(vector).alias("i", "_v")).select(by, "i", F.col("_v").cast("double").alias("x"))
    else:
        raise NotImplementedError(how)
    if "dpr" not in model.lower():
        out = out.withColumn("x", F.col("x") / F.greatest(F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(by))), F.lit(1e-12)))
    return out


def documents_of(lists: DataFrame, docs: DataFrame, key: str, ids: str, doc_id: str, columns: list[str]) -> DataFrame:
    """(key, found): for each list of ids its documents as structs of ``columns`` in the order of the list; an id without a document is an error."""
    at = lists.select(key, F.posexplode(ids).alias("_rank", "_id"))
    held = docs.select(F.col(doc_id).alias("_doc"), F.struct(*columns).alias("_row"))
    joined = at.join(held, F.col("_id") == F.col("_doc"), "left")
    lost = F.raise_error(F.concat(F.lit("no document "), F.col("_id").cast("string"))).cast(held.schema["_row"].dataType)
    row = F.when(F.col("_doc").isNull(), lost).otherwise(F.col("_row"))
    return joined.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_rank", row.alias("row")))), lambda x: x["row"]).alias("found"))


def passages_text(passages: Column) -> Column:
    """Numbered passages, the first line of each as its title; white space at the ends goes."""
    title = lambda x: F.substring_index(x, "\n", 1)
    one = lambda x, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), title(x), F.lit(")\n"), F.substring(x, F.char_length(title(x)) + 2, F.char_length(x)), F.lit("\n\n"))
    return F.regexp_replace(F.array_join(F.transform(passages, one), ""), r"^\s+|\s+$", "")


def search_record(queries: Column, error: Column, results: Column) -> dict[str, Column]:
    """What a batch of searches leaves: counts, status, the results as one text, and the answer as JSON.

    ``results`` has an array of passages for each query; null is no response at all. An error wins over results.
    """
    found = F.array_join(F.transform(results, passages_text), BETWEEN)
    status = F.when(error.isNotNull(), STATUSES[0]).when(results.isNull(), STATUSES[1]).when(F.size(results) == 0, STATUSES[2]).otherwise(STATUSES[3])
    good = status == STATUSES[3]
    text = F.when(error.isNotNull(), F.concat(F.lit(FAILED), error)).when(results.isNull(), UNKNOWN).when(good, found).otherwise(NOTHING)
    total = F.when(good, F.aggregate(results, F.lit(0), lambda n, r: n + F.size(r))).otherwise(0)
    return {"query_count": F.size(queries), "status": status, "total_results": total, "formatted_result": F.when(good, found), "result_text": F.to_json(F.struct(text.alias("result")))}
