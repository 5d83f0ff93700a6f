"""What is shown of results: how many sections, which part of a text, and the sections of an answer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shown_sections(rows: DataFrame, precise: Column, punishes: Column, asks: Column, hinted: Column, prefer_hints: Column, most: int = 3) -> DataFrame:
    """(query_id, id, place, exit): the rows that are shown, of each query's first `most` sections (filename, root) the first row each.

    rows: query_id, id, rank, filename, root. The first rule that applies decides: a single section is shown (single); where hints are
    preferred and two of the sections or more are hinted, those (hints); where a punishment is asked for and the first section is what is
    meant and states one, it alone (punishment); where the first two are what is meant, these (two); else all (all).
    """
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "filename", "root").orderBy("rank", "id"))).where("_n = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id"))
    flags = {"precise": precise, "punishes": punishes, "asks": asks, "hinted": hinted & prefer_hints}
    some = first.withColumn("place", place).where(F.col("place") <= most).withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    query = Window.partitionBy("query_id")
    at = lambda n, *names: F.max(F.when(F.col("place") == n, F.expr(" and ".join(names)))).over(query)
    some = some.withColumns({"_count": F.count("*").over(query), "_hinted": F.count_if("hinted").over(query), "_first": at(1, "precise"), "_punished": at(1, "precise", "asks", "punishes"), "_second": at(2, "precise")})
    exit_ = F.when(F.col("_count") == 1, "single").when(F.col("_hinted") >= 2, "hints").when(F.col("_punished"), "punishment").when(F.col("_first") & F.col("_second"), "two").otherwise("all")
    stays = F.when(F.col("exit") == "hints", F.col("hinted")).when(F.col("exit") == "punishment", F.col("place") == 1).when(F.col("exit") == "two", F.col("place") <= 2).otherwise(True)
    return some.withColumn("exit", exit_).where(stays).select("query_id", "id", F.row_number().over(query.orderBy("place")).alias("place"), "exit")


def excerpt_words(query: Column) -> Column:
    """The words of two characters and more that an excerpt is looked for by, repeats included."""
    return F.filter(F.split(query, r"[\s,।.?!;:]+"), lambda w: F.length(w) > 1)


def occurrences(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, no, n, pos): where each word (no, of n characters) of rows (keys, content, words) begins, from 0, overlaps included: the content is cut before each of them."""
    quoted = F.concat(F.lit(r"(?=\Q"), F.replace("word", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    each = rows.select(*keys, "content", F.posexplode("words").alias("no", "word"))
    cut = each.select(*keys, "no", F.length("word").alias("n"), F.startswith("content", "word").alias("begins"), F.posexplode(F.transform(F.split("content", quoted), F.length)).alias("i", "size"))
    before = Window.partitionBy(*keys, "no").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("pos", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("int")).where("i > 0 or begins").select(*keys, "no", "n", "pos")


def best_excerpts(rows: DataFrame, keys: Sequence[str], most: int = 500, reach: int = 200) -> DataFrame:
    """(keys, at, words, excerpt) of rows (keys, content, words: array): the part of a content around the place with the most words within `reach` characters.

    Every occurrence of a word is such a place; a window over the occurrences, by their place, counts the words that lie whole within its
    reach. Of equal places the one of the earlier word, then the earlier one. The excerpt has `most` characters and begins half of them
    before the place, with an ellipsis where the content goes on.
    """
    found = occurrences(rows, keys)
    around = Window.partitionBy(*keys).orderBy("pos").rangeBetween(-reach, reach)
    within = F.collect_set(F.struct("no", "pos", "n")).over(around)
    words = F.size(F.array_distinct(F.transform(F.filter(within, lambda x: x["pos"] + x["n"] <= F.col("pos") + reach), lambda x: x["no"])))
    best = found.withColumn("words", words).groupBy(*keys).agg(F.max_by(F.struct("pos", "words"), F.struct("words", -F.col("no"), -F.col("pos"))).alias("b"))
    out = rows.select(*keys, "content").join(best, list(keys), "left").withColumn("at", F.coalesce("b.pos", F.lit(0)))
    start = F.greatest(F.lit(0), F.col("at") - most // 2)
    text = F.trim(F.substring(F.col("content"), start + 1, F.lit(most)))
    more = F.concat(F.when(start > 0, "…").otherwise(""), text, F.when(start + most < F.length("content"), "…").otherwise(""))
    return out.select(*keys, "at", F.coalesce("b.words", F.lit(0)).alias("words"), more.alias("excerpt"))


def answer_sections(text: Column, headings: Sequence[str], first: str) -> Column:
    """The sections of an answer, an array of (heading, body), cut at lines that are a heading in two stars on either side; null unless it has the first heading."""
    line = rf"(?m)^[ \t]*\*\*({'|'.join(headings)})\*\*[ \t]*$"
    names = F.regexp_extract_all(text, F.lit(line), F.lit(1))
    bodies = F.split(text, line.replace("(" + "|".join(headings), "(?:" + "|".join(headings)))
    cut = F.zip_with(names, F.slice(bodies, 2, F.greatest(F.size(bodies) - 1, F.lit(0))), lambda h, b: F.struct(h.alias("heading"), F.trim(F.regexp_replace(b, r"^\s+|\s+$", "")).alias("body")))
    return F.when(F.contains(text, F.lit(f"**{first}**")) & (F.size(names) > 0), cut)
