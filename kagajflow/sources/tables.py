"""Tables in Parquet, and the statute relations projected from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import exists, new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def legal_texts(documents: DataFrame) -> DataFrame:
    """Chunks with their place in a book (book, chapter, section, part), without embeddings."""
    return documents.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("content"),
        F.col("source").alias("filename"),
        F.col("lang").alias("book_id"),
        (F.col("doc_id") % 10 + 1).cast("int").alias("parichhed_no"),
        F.concat(F.lit("Chapter "), (F.col("doc_id") % 10 + 1).cast("string"), F.lit(" — "), F.col("source")).alias("chapter"),
        F.concat_ws(".", F.floor(F.col("doc_id") / 10).cast("string"), (F.col("doc_id") % 10).cast("string")).alias("section_label"),
        F.floor(F.col("doc_id") / 10).cast("int").alias("root"),
        F.substring("text", 1, 60).alias("section_title"),
    )


def legal_chunks(documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks with their place in a book and an embedding where there is one."""
    vectors = embeddings.select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("dafa_no"))
    return legal_texts(documents).join(vectors, "id", "left")


def chunks_of(chunks: DataFrame, documents: DataFrame, rules: Sequence[str], key: str = "filename") -> DataFrame:
    """The chunks of documents (key, rule, ...) that one of the rules has loaded, with the documents' fields: the filter reaches the documents' scan, chunks of no such document go."""
    return chunks.join(documents.where(F.col("rule").isin(list(rules))), key)


def fixture_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legal_chunks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings"))


def fixture_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks without embeddings, for what needs none: their contents aren't shuffled to meet the vectors."""
    return legal_texts(table(spark, sf_dir, "documents"))


LATIN, LETTERS = "abcdefghijklmnopqrstuvwxyz", "कखगघचछजझटठडढणतथदधनपफबभमयरल"
#: Beginnings of bodies by which statute_chunks differ: plain, definitions, clauses, what forms and scanning noise look like.
BODIES = (
    "सामान्य व्यवस्था: ", "“नागरिक” भन्नाले ", "(ङ) पहिलो कुरा, (च) दोस्रो कुरा। ", "सो म्झनु पर्छ। ", "नाम .... उमेर ", "तपाईँको उमेर ", "abc ", "Latin ", "फिराद पत्र ... ", "[PAGE:7] उपदफा (१) बमोजिम सजाय हुनेछ। ",
)


def statute_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks dressed as statutes: their texts in Devanagari letters behind one of BODIES, two in three below a head that names chapter and section; and a page."""
    chunks = fixture_chunks(spark, sf_dir)
    number = F.translate("section_label", "0123456789", "०१२३४५६७८९")
    shown = F.when(F.col("id") % 2 == 0, F.substring_index(number, ".", 1)).otherwise(number)
    chapter = F.when(F.col("id") % 4 == 0, F.concat(F.lit("परिच्छेद: "), F.col("chapter"), F.lit("\n"))).otherwise("")
    head = F.concat(chapter, F.lit("दफा: "), shown, F.lit(" — व्यवस्था\nप्रकार: dafa\n\n"))
    body = F.concat(F.get(F.array(*map(F.lit, BODIES)), (F.col("id") % len(BODIES)).cast("int")), F.when(F.col("id") % 7 == 0, "\nप्रकार : upadafa\n").otherwise(""), F.translate(F.lower("content"), LATIN, LETTERS))
    label = F.when(F.col("id") % 5 > 0, F.when(F.col("id") % 3 == 0, F.col("root").cast("string")).otherwise(F.col("section_label")))
    return chunks.withColumns({"content": F.concat(F.when(F.col("id") % 3 < 2, head).otherwise("शीर्षक\n"), body), "section_label": label, "page": (F.col("id") % 60).cast("int")})


STATUTES_SQL = f"""statutes AS (
  SELECT * REPLACE (
    CASE WHEN id % 3 < 2 THEN CASE WHEN id % 4 = 0 THEN 'परिच्छेद: ' || chapter || chr(10) ELSE '' END || 'दफा: ' || translate(CASE WHEN id % 2 = 0 THEN root::VARCHAR ELSE section_label END, '0123456789', '०१२३४५६७८९')
      || ' — व्यवस्था' || chr(10) || 'प्रकार: dafa' || chr(10) || chr(10) ELSE 'शीर्षक' || chr(10) END || {list(BODIES)}[id % {len(BODIES)} + 1]
      || CASE WHEN id % 7 = 0 THEN chr(10) || 'प्रकार : upadafa' || chr(10) ELSE '' END || translate(lower(content), '{LATIN}', '{LETTERS}') AS content,
    CASE WHEN id % 5 > 0 THEN CASE WHEN id % 3 = 0 THEN root::VARCHAR ELSE section_label END END AS section_label
  ), (id % 60)::INT AS page FROM chunks)"""


#: The folders of the word indexes that this process has built, by application, folder of tables and their files.
INDEXES: dict[tuple[str, ...], str] = {}


def chunk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings of the chunks' contents: an index in the shared folder, built when it is first asked for."""
    from ..operators import postings

    documents = table(spark, sf_dir, "documents")
    key = (spark.sparkContext.applicationId, sf_dir, *sorted(documents.inputFiles()))
    if key not in INDEXES or not exists(spark, f"{INDEXES[key]}/rows"):  # the shared folder may have been cleared
        path = new_path(spark, "words")
        postings.write_batch(path, 0, documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content")))
        INDEXES[key] = path
    return postings.read(spark, INDEXES[key])


#: The same relation for DuckDB, as the first of a query's WITH clauses.
CHUNKS_SQL = """chunks AS (
  SELECT doc_id AS id, text AS content, source AS filename, lang AS book_id, (doc_id % 10 + 1)::INT AS parichhed_no,
    'Chapter ' || (doc_id % 10 + 1) || ' — ' || source AS chapter, (doc_id // 10) || '.' || (doc_id % 10) AS section_label,
    (doc_id // 10)::INT AS root, substring(text, 1, 60) AS section_title, embedding::DOUBLE[] AS embedding, label AS dafa_no
  FROM documents LEFT JOIN embeddings ON vec_id = doc_id)"""

PAGE_MAP = T.StructType(
    [T.StructField("bookId", T.StringType()), T.StructField("totalPages", T.IntegerType()), T.StructField("dafaCount", T.IntegerType()), T.StructField("map", T.MapType(T.StringType(), T.IntegerType()))]
)


def page_map(spark: SparkSession, path: str, overrides: str | None = None) -> DataFrame:
    """(book_id, root, page) of JSON page maps; pages of the overrides win."""
    maps = spark.read.schema(PAGE_MAP).json(path, multiLine=True).select(F.col("bookId").alias("book_id"), F.explode("map").alias("root", "page"))
    if overrides is None:
        return maps
    better = spark.read.schema(PAGE_MAP).json(overrides, multiLine=True).select(F.col("bookId").alias("book_id"), F.explode("map").alias("root", "better"))
    return maps.join(better, ["book_id", "root"], "full").select("book_id", "root", F.coalesce("better", "page").alias("page"))


def glossary_file(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a glossary file: term, roman, english, meaning, and category where there is one."""
    entry = "struct<term:string,`Roman Transliteration`:string,english:string,meaning:string,meaningNe:string,meaningEn:string,category:string,number:int>"
    entries = spark.read.schema(f"entries array<{entry}>").json(path, multiLine=True).select(F.explode("entries").alias("e"))
    return entries.select("e.term", F.col("e.`Roman Transliteration`").alias("roman"), "e.english", F.coalesce("e.meaning", "e.meaningNe", "e.meaningEn").alias("meaning"), "e.category", "e.number")


def question_bank(spark: SparkSession, path: str) -> DataFrame:
    """Lines `<n>. <question> -> (<book>, <references>)` in file order: num, question, book, references, and the batch (it begins anew at number 1)."""
    from pyspark.sql import Window

    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("seq", "line"))  # one file, a few hundred lines
    pattern = r"^\s*([0-9०-९]+)\s*\.\s*(.+?)\s*->\s*\(([^,]+),\s*(.+)\)\s*$"
    num = F.translate(F.regexp_extract("line", pattern, 1), "०१२३४५६७८९", "0123456789").cast("int")
    rows = lines.where(F.col("line").rlike(pattern)).select("seq", num.alias("num"), *(F.regexp_extract("line", pattern, k).alias(c) for k, c in ((2, "question"), (3, "book"), (4, "references"))))
    return rows.withColumn("batch", F.sum((F.col("num") == 1).cast("int")).over(Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))


def section_pages(spark: SparkSession, path: str) -> DataFrame:
    """(file, page, text) of text sidecars, one file per page, named by the page's number; blank pages are left out."""
    pages = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    page = F.regexp_extract("file", r"(\d+)\.[a-z]+$", 1).cast("int")
    return pages.where(F.trim("value") != "").select("file", page.alias("page"), F.col("value").alias("text"))


def law_texts(spark: SparkSession, raw: str, structured: str | None = None) -> DataFrame:
    """(file, text, format) of law texts, one file each: the structured version (indented) where there is one, else the raw one (markers)."""

    def read(path: str) -> DataFrame:
        found = spark.read.text(path, wholetext=True).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.structured)?\.txt$", 1))
        return found.select("file", F.col("value").alias("text"))

    plain = read(raw).withColumn("format", F.lit("markers"))
    if structured is None:
        return plain
    better = read(structured).withColumn("format", F.lit("indented"))
    return better.unionByName(plain.join(better.select("file"), "file", "left_anti"))


def taxonomy_file(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, root, title) of JSON taxonomies: a book and its list of sections."""
    kind = "bookId string, items array<struct<label:string,title:string,sectionRoot:int>>"
    return spark.read.schema(kind).json(path, multiLine=True).select(F.col("bookId").alias("book_id"), F.explode("items").alias("i")).select("book_id", F.col("i.sectionRoot").alias("root"), "i.title")
