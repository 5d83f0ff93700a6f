"""A section's parts as a tree: parents by their marks, misplaced clauses where they belong, read depth first.

Parts are rows (query_id, filename, root, id, path, text); path is an array of marks, outermost first, as digits of any script or
letters, with or without parentheses; empty for what stands under no mark. All parts of a section are one group: as many as its law has.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clause_order, to_ascii_digits

SECTION = ("query_id", "filename", "root")
#: A bare word that only names a subsection, the tail of a reference, what a list of punishments begins with, and a proviso.
STUB, TAIL, MARKED_TAIL, PROVISO = r"^उपदफा\s*$", "^बमोजिम", r"^\([0-9०-९]+\)\s*बमोजिम", r"^तर\s"
PUNISHES = r"देहाय\s+बमोजिम|बमोजिम\s+सजाय|सजाय\s+हुनेछ"
#: Tails that speak of harm belong to the third subsection, others to the second.
HARM = "क्षतिपूर्ति|पीडित|हानि|नोक्सानी"
#: The clauses under which a list of punishments has those of each subsection.
CLAUSE_OF = {"1": "क", "2": "ख", "3": "ग"}


def marks(path: Column) -> Column:
    return F.transform(path, lambda m: to_ascii_digits(F.regexp_replace(m, r"[()\s]", "")))


def like(s: Column, pattern: str) -> Column:
    return F.regexp_like(s, F.lit(pattern))


def is_number(mark: Column) -> Column:
    return F.coalesce(like(mark, "^[0-9]+$"), F.lit(False))


def restructured(parts: DataFrame, list_mark: str = "4", clause_of: Mapping[str, str] = CLAUSE_OF, harm: str = HARM) -> DataFrame:
    """parts with misplaced ones moved.

    Where a section has a list of punishments (under list_mark), what says "as by" under another subsection is a clause of that list (of
    several of a subsection the last), named by its subsection; parts that only name a subsection go. In other sections a tail under the
    first subsection goes on with the second one, or the third if it speaks of harm: its text is appended, or stands there by itself if
    there is none; a bare word is filled by the first tail of its subsection.
    """
    first = F.get("path", F.lit(0))
    rows = parts.select(*SECTION, "id", marks(F.col("path")).alias("path"), F.trim("text").alias("text"))
    single = (F.size("path") == 1) & is_number(first)
    listing = (F.size("path") == 1) & (first == list_mark) & ~like(F.col("text"), TAIL) & like(F.col("text"), PUNISHES)
    rows = rows.withColumn("_list", F.max(listing.cast("int")).over(Window.partitionBy(*SECTION)) == 1)
    names = like(F.col("text"), STUB) | (F.size("path") == 2) & (first != list_mark) & like(F.col("text"), "^उपदफा")
    role = (
        F.when(F.col("_list") & names, "gone").when(F.col("_list") & single & (first != list_mark) & like(F.col("text"), TAIL), "moved").when(F.col("_list"), "kept")
        .when(single & like(F.col("text"), STUB), "stub").when((F.size("path") == 1) & (first == "1") & (like(F.col("text"), TAIL) | like(F.col("text"), MARKED_TAIL)), "tail").otherwise("kept")
    )
    rows = rows.withColumn("_role", role).drop("_list")
    columns = [*SECTION, "id", "path", "text"]
    return listed(rows.where("_role = 'moved'"), list_mark, clause_of).select(columns).unionByName(appended(rows.where("_role in ('kept', 'stub', 'tail')"), harm).select(columns))


def listed(rows: DataFrame, list_mark: str, clause_of: Mapping[str, str]) -> DataFrame:
    """Tails as clauses of the list."""
    letters = F.create_map(*(F.lit(x) for pair in clause_of.items() for x in pair)).cast("map<string,string>")
    mark = F.get("path", F.lit(0))
    last = Window.partitionBy(*SECTION, mark).orderBy(F.desc("id"))
    some = rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").withColumn("_letter", letters[mark]).where("_letter is not null")
    text = F.concat(F.lit("उपदफा ("), F.translate(mark, "0123456789", "०१२३४५६७८९"), F.lit(") "), F.regexp_replace("text", r",\s*$", ""))
    return some.withColumns({"text": text, "path": F.array(F.lit(list_mark), F.col("_letter"))})


def appended(rows: DataFrame, harm: str) -> DataFrame:
    """Tails joined to the subsections that they go on with."""
    own = F.get("path", F.lit(0))
    kept = rows.where("_role = 'kept'")
    said = F.when(like(F.col("text"), TAIL), F.concat(F.lit("उपदफा (१) "), F.col("text"))).otherwise(F.concat(F.lit("उपदफा "), F.col("text")))
    tails = rows.where("_role = 'tail'").select(*SECTION, F.when(like(F.col("text"), harm), "3").otherwise("2").alias("mark"), "id", said.alias("said"))
    tails = tails.groupBy(*SECTION, "mark").agg(F.array_sort(F.collect_list(F.struct("id", "said"))).alias("tails"))
    stubs = rows.where("_role = 'stub'").groupBy(*SECTION, own.alias("mark")).agg(F.max("id").alias("stub"))
    at = Window.partitionBy(*SECTION, own).orderBy("id")
    targets = kept.where((F.size("path") == 1) & is_number(own)).withColumn("_n", F.row_number().over(at)).where("_n = 1").select(*SECTION, own.alias("mark"), F.col("id").alias("target"))
    more = tails.join(stubs, [*SECTION, "mark"], "full").join(targets, [*SECTION, "mark"], "left")
    texts = F.coalesce(F.transform("tails", lambda t: t["said"]), F.array(F.lit("उपदफा")))
    joined = more.where("target is not null").select(*SECTION, F.col("target").alias("id"), F.array_join(texts, " ").alias("_more"))
    filled = kept.join(joined, [*SECTION, "id"], "left").withColumn("text", F.when(F.col("_more").isNull(), F.col("text")).otherwise(F.regexp_replace(F.concat_ws(" ", "text", "_more"), r"\s+", " "))).drop("_more")
    by_itself = F.coalesce(F.transform("tails", lambda t, i: F.struct(F.when(i == 0, F.coalesce("stub", t["id"])).otherwise(t["id"]).alias("id"), t["said"].alias("text"))), F.array(F.struct(F.col("stub").alias("id"), F.lit("उपदफा").alias("text"))))
    alone = more.where("target is null").select(*SECTION, F.array("mark").alias("path"), F.explode(by_itself).alias("x")).select(*SECTION, "x.id", "path", "x.text")
    return filled.select(*SECTION, "id", "path", "text").unionByName(alone)


def place_of(mark: Column) -> Column:
    """A mark's place among its siblings: numbers by value, letters in their order."""
    return F.coalesce(mark.try_cast("int"), clause_order(mark).cast("int"), F.lit(9999))


def tree(parts: DataFrame) -> DataFrame:
    """(query_id, filename, root, id, parent, depth, place, path, text): each part below the one with the longest beginning of its path (of equal paths the first by id), in the order in which a tree is read.

    A proviso under no mark stands behind the last subsection but one with its clauses, behind the fifth where there is a sixth. depth is
    the number of parts above; the section's introduction, the first part under no mark, is above all.
    """
    own = F.get("path", F.lit(0))
    numbers = F.array_distinct(F.collect_list(F.when((F.size("path") == 1) & is_number(own), own.cast("int"))).over(Window.partitionBy(*SECTION)))
    before = F.when(F.array_contains(numbers, 6), 5).otherwise(F.greatest(F.lit(1), F.array_max(numbers) - 1))
    proviso = (F.size("path") == 0) & like(F.col("text"), PROVISO)
    key = F.when(proviso & (F.size(numbers) > 0), F.array(before, F.lit(10_000))).otherwise(F.transform("path", place_of))
    rows = parts.select(*SECTION, "id", marks(F.col("path")).alias("path"), F.trim("text").alias("text"))
    rows = rows.withColumns({"key": key, "proviso": proviso})
    names = F.array_join("path", ".")
    nodes = rows.where("not proviso").groupBy(*SECTION, names.alias("name")).agg(F.min("id").alias("above"))
    prefixes = F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("path", 1, n), ".").alias("name")))
    up = rows.select(*SECTION, "id", F.explode(prefixes).alias("p")).select(*SECTION, "id", "p.n", "p.name").join(nodes, [*SECTION, "name"]).where("above <> id")
    up = up.groupBy(*SECTION, "id").agg(F.max_by("above", "n").alias("parent"), F.count("*").cast("int").alias("depth"))
    full = rows.join(up, [*SECTION, "id"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    return full.withColumn("place", F.row_number().over(Window.partitionBy(*SECTION).orderBy("key", "id"))).select(*SECTION, "id", "parent", "depth", "place", "path", "text")


def displayed(nodes: DataFrame) -> DataFrame:
    """(query_id, filename, root, text): a tree's parts as lines, each with its last mark and indented by its marks; parts without text left out."""
    last = F.get("path", F.size("path") - 1)
    mark = F.when(F.size("path") > 0, F.concat(F.repeat(F.lit("    "), F.size("path") - 1), F.lit("("), F.translate(last, "0123456789", "०१२३४५६७८९"), F.lit(") "))).otherwise("")
    lines = F.array_sort(F.collect_list(F.struct("place", F.concat(mark, F.col("text")).alias("line"))))
    return nodes.where("text <> ''").groupBy(*SECTION).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))
