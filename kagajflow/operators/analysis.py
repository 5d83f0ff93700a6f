"""What a query asks for: title phrases and their rank, anchors, vocabulary, sections by name, and how to search for it.

Word lists and rules are parameters. Everything is a column of the query, or an equi-join of its words with what titles have.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import title_match
from ..functions.text import normal_title, shortened, title_tokens, to_ascii_digits
from .routing import gram_keys

TEXTS = "array<string>"


def words_of(s: Column) -> Column:
    return F.filter(F.split(normal_title(s), r"\s+"), lambda w: F.length(w) > 1)


def is_title_query(query: Column) -> Column:
    """Whether a query may be a provision's title: six Devanagari characters, two words or ten characters, no section number, no chunk id."""
    deva = F.regexp_count(query, F.lit(r"[ऀ-ॿ]"))
    words = F.size(F.filter(F.split(F.trim(query), r"[\s,।.?!;:ः]+"), lambda w: F.length(w) > 1))
    named = F.regexp_like(query, F.lit(r"(?i)(?<![a-zऀ-ॿ])(?:दफा|dafa|daafa|dapha|section|sec\.?)\s*[0-9०-९]|^(?:dafa|sec)_\w+$"))
    return (deva >= 6) & ((words >= 2) | (deva >= 10)) & ~named


def phrase_rank(phrase: Column, signals: Sequence[str], strong: str) -> Column:
    """A phrase's weight: 0.02 a character, 6 a word that signals a title, 4 for the strong one, 2 for three words and more."""
    tokens = title_tokens(phrase)
    hits = F.size(F.filter(tokens, lambda t: t.isin(*signals) | t.contains(strong) if signals else t.contains(strong)))
    return F.length(phrase) * 0.02 + hits * 6 + F.when(phrase.contains(strong), 4).otherwise(0) + F.when(F.size(tokens) >= 3, 2).otherwise(0)


def ranked_phrases(phrases: Column, signals: Sequence[str], strong: str, least: int = 4) -> Column:
    """Normalised phrases of `least` characters and more, each once, the heaviest first, of equal ones the earlier."""
    shown = F.transform(phrases, lambda p, i: F.struct((-phrase_rank(p, signals, strong)).alias("rank"), i.alias("i"), normal_title(p).alias("phrase")))
    return F.array_distinct(F.transform(F.array_sort(F.filter(shown, lambda s: F.length(s["phrase"]) >= least)), lambda s: s["phrase"]))


def title_phrases(query: Column, signals: Sequence[str], strong: str, canonical: Sequence[tuple[str, str]] = ()) -> Column:
    """Phrases of a long question that may be titles: what it quotes, runs of five to two words with a signal, and the canonical titles whose pattern it has."""
    quoted = F.transform(F.regexp_extract_all(query, F.lit("['\"‘“「『]([^'\"’”」』]+)['\"’”」』]"), F.lit(1)), normal_title)
    words = words_of(F.regexp_replace(query, "['\"‘’“”「」『』]", " "))

    def runs(n: int) -> Column:
        many = F.size(words) - n + 1
        at = F.when(many > 0, F.sequence(F.lit(1), F.greatest(many, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))

    signal = "|".join([strong, *signals])
    grams = F.filter(F.concat(*map(runs, range(5, 1, -1))), lambda p: F.regexp_like(p, F.lit(signal)))
    own = F.filter(F.array(*(F.when(F.regexp_like(query, F.lit(pattern)), title) for pattern, title in canonical)).cast(TEXTS), lambda t: t.isNotNull())
    return ranked_phrases(F.concat(F.filter(quoted, lambda q: F.length(q) >= 3), grams, own), signals, strong)


def first_phrases(canonical: Column, phrases: Column, most: int = 5) -> Column:
    """The canonical titles, then other phrases, each once, at most so many."""
    return F.slice(F.filter(F.array_distinct(F.transform(F.concat(canonical, phrases), normal_title)), lambda p: p != ""), 1, most)


def search_anchors(phrases: Column, most: int = 6) -> Column:
    """What titles are searched by: of the first six phrases those of two to six words, and their first two and three words; the first phrase, then the longest."""

    def of(phrase: Column) -> Column:
        words, tokens = words_of(phrase), title_tokens(phrase)
        head = lambda some, n, least: F.when(F.size(some) >= least, F.array_join(F.slice(some, 1, n), " "))
        return F.array(F.when(F.size(words).between(2, 6), F.array_join(words, " ")), F.when(F.size(words).between(3, 6), head(words, 3, 3)), head(tokens, 2, 2), head(tokens, 3, 3))

    every = F.array_distinct(F.filter(F.flatten(F.transform(F.slice(phrases, 1, 6), of)), lambda a: a.isNotNull()))
    longest = F.transform(F.array_sort(F.transform(every, lambda a, i: F.struct((-F.length(a)).alias("n"), i.alias("i"), a.alias("a")))), lambda s: s["a"])
    primary = F.array_join(words_of(F.get(phrases, F.lit(0))), " ")
    return F.slice(F.when(F.array_contains(every, primary), F.concat(F.array(primary), F.filter(longest, lambda a: a != primary))).otherwise(longest), 1, most)


def phrases_within(phrases: Column, low: int = 4, high: int = 80, most: int = 6) -> Column:
    """Phrases of an allowed length, each once, at most so many."""
    return F.slice(F.array_distinct(F.filter(phrases, lambda p: F.length(p).between(low, high))), 1, most)


def united(*lists: Column, most: int) -> Column:
    """Lists of texts one behind the other, each text once, at most so many."""
    return F.slice(F.array_distinct(F.concat(*lists)), 1, most)


def vocabulary(chunks: DataFrame) -> DataFrame:
    """(term): the different section titles of 4 to 120 characters and chapters of 4 to 80."""
    titles = chunks.select(F.trim("section_title").alias("term")).where(F.length("term").between(4, 120))
    return titles.union(chunks.select(F.trim("chapter").alias("term")).where(F.length("term").between(4, 80))).distinct()


def vocabulary_tokens(query: Column, spellings: Column | None = None) -> Column:
    """Latin words of two letters and more, Devanagari words, and what Latin words are in Devanagari by a map; each once."""
    latin = F.regexp_extract_all(F.lower(query), F.lit("([a-z]{2,})"), F.lit(1))
    deva = F.filter(F.regexp_extract_all(query, F.lit(r"([ऀ-ॿ]+)"), F.lit(1)), lambda w: F.length(w) >= 2)
    spelled = F.array().cast(TEXTS) if spellings is None else F.filter(F.transform(latin, lambda w: spellings[w]), lambda w: w.isNotNull())
    return F.array_distinct(F.concat(latin, deva, spelled))


def term_score(term: Column, tokens: Column) -> Column:
    """Three for each token that holds the term or is held by it, two for each that its lower case holds."""
    low = F.lower(term)
    points = lambda t: F.when(term.contains(t) | t.contains(term), 3).otherwise(0) + F.when(low.contains(F.lower(t)), 2).otherwise(0)
    return F.aggregate(tokens, F.lit(0), lambda n, t: n + points(t))


def vocabulary_hints(queries: DataFrame, terms: DataFrame, most: int = 10, core: Sequence[str] = (), enough: int = 12) -> DataFrame:
    """(query_id, hints): the terms that score best for a query's tokens (query_id, tokens), shorter ones first, filled up with core terms where there are fewer than `enough`.

    Terms meet queries by keys that a term shares with every token that it holds or that holds it.
    """
    words = lambda s: F.filter(F.split(F.lower(s), r"\s+"), lambda w: w != "")  # noqa: E731  a token has no blanks
    known = terms.select("term", F.explode(gram_keys(words(F.col("term")), False)).alias("key"))
    asked = queries.select("query_id", "tokens", F.explode(gram_keys(F.transform("tokens", lambda t: F.lower(t)), True)).alias("key"))
    pairs = asked.join(known, "key").dropDuplicates(["query_id", "term"]).withColumn("score", term_score(F.col("term"), F.col("tokens"))).where("score > 0")
    best = pairs.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.length("term"), "term"))).where(F.col("n") <= most)
    picked = queries.select("query_id").join(best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "term"))).alias("p")), "query_id", "left")
    own = F.coalesce(F.transform("p", lambda p: p["term"]), F.array().cast(TEXTS))
    filler = F.array(*map(F.lit, core)).cast(TEXTS)
    return picked.select("query_id", F.slice(F.when(F.size(own) < enough, F.array_distinct(F.concat(own, filler))).otherwise(own), 1, most).alias("hints"))


def line_parts(line: Column) -> Column:
    """(root, title) of a line `दफा N. title`."""
    pattern = r"^\s*(?:(?:दफा\s*)?([0-9०-९]+)\s*[.।:)]?\s*)?(.*)$"
    return F.struct(to_ascii_digits(F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))).try_cast("int").alias("root"), F.trim(F.regexp_extract(line, pattern, 2)).alias("title"))


def taxonomy_lines(lines: DataFrame, most: int = 117, mark: int = 160) -> DataFrame:
    """(book_id, root, title) of lines `N. title` (book_id, line): the title up to a visarga in its first `mark` characters, else shortened to `most` with the mark of that."""
    top = lines.where(F.regexp_like("line", F.lit(r"^[0-9०-९]+\.\s+\S"))).select("book_id", line_parts(F.col("line")).alias("p")).select("book_id", "p.*")
    at = F.instr("title", "ः")
    cut = F.when((at > 1) & (at < mark), F.substring(F.col("title"), F.lit(1), at)).otherwise(shortened(F.col("title"), most))
    return top.select("book_id", "root", F.trim(cut).alias("title"))


def sections_by_name(names: DataFrame, taxonomy: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, roots): the sections that a query's names (query_id, place, name) are the titles of, in order; a name that isn't a title but begins with a number is that section."""
    key = lambda c: F.lower(normal_title(line_parts(F.col(c))["title"]))
    titles = taxonomy.select(F.lower(normal_title(F.col("title"))).alias("key"), F.col("root").alias("known")).groupBy("key").agg(F.min("known").alias("known"))
    found = names.withColumn("key", key("name")).join(titles, "key", "left").withColumn("root", F.coalesce("known", line_parts(F.col("name"))["root"])).where("root is not null")
    ordered = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "root"))), lambda s: s["root"]))
    return found.groupBy("query_id").agg(F.slice(ordered, 1, most).alias("roots"))


def owning_book(lines: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """lines (query_id, line) with the book of the title that they show; of several the first by name."""
    key = F.lower(normal_title(line_parts(F.col("line"))["title"]))
    titles = taxonomy.groupBy(F.lower(normal_title(F.col("title"))).alias("key")).agg(F.min("book_id").alias("book_id"))
    return lines.withColumn("key", key).join(titles, "key", "left").drop("key")


def owned_sections(guesses: DataFrame, taxonomy: DataFrame, most: int = 3) -> DataFrame:
    """Guessed sections (query_id, place, book_id, root) that their book has, the first `most` of each query."""
    own = guesses.join(taxonomy.select("book_id", "root").distinct(), ["book_id", "root"], "left_semi")
    return own.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "root"))).where(F.col("_n") <= most).drop("_n")


def focus_scope(*candidates: Column) -> Column:
    """The first scope that is known and isn't 'auto'."""
    return F.coalesce(*(F.nullif(c, F.lit("auto")) for c in candidates))


def chapter_title_score(query: Column, chapter: Column, name: Column) -> Column:
    """How well a chapter fits a query: by its whole title, or five hundredths better by its name."""
    return F.greatest(title_match(query, chapter), 1.05 * title_match(query, name))


def section_group_score(query: Column, title: Column, chapter: Column, body: Column) -> Column:
    """How well a section fits a query: by its title, or by 0.35 of its chapter's and 0.45 of its body's beginning."""
    return F.greatest(title_match(query, title), 0.35 * title_match(query, chapter) + 0.45 * title_match(query, F.substring(body, 1, 400)))


def is_precise(query: Column, title: Column, similarity: Column, hinted: Column, punishes: Column, asks: str = "सजाय|कैद|जरिबाना") -> Column:
    """Whether a row is surely what a query asks for: by its title, its similarity, a hint with some of both, or a punishment that is asked for."""
    score = F.coalesce(title_match(query, title), F.lit(0.0))
    return (hinted & ((score >= 0.5) | (similarity >= 0.7))) | (score >= 0.65) | (similarity >= 0.88) | (F.regexp_like(query, F.lit(asks)) & punishes & (score >= 0.45))


def hint_boost(similarity: Column, floor: float, by: float = 0.15) -> Column:
    """What an exactly hinted row gets: at least the floor, and a boost."""
    return F.round(F.greatest(similarity, F.lit(floor)) + by, 6)


def related_enough(similarity: Column, least: int = 70) -> Column:
    """Whether a related source is shown: its similarity in whole hundredths."""
    return F.round(similarity * 100) >= least


def contains_any(words: Column, content: Column, label: Column) -> Column:
    """Whether a content or label has one of the words, whatever their case."""
    return F.exists(words, lambda w: F.lower(content).contains(F.lower(w)) | F.lower(label).contains(F.lower(w)))


def section_keys(hints: Column) -> Column:
    """The keys book|number of section hints (structs act, section) whose act is known."""
    known = F.filter(hints, lambda h: h["act"].isNotNull())
    return F.array_distinct(F.transform(known, lambda h: F.concat_ws("|", h["act"], to_ascii_digits(h["section"].cast("string")))))


def retrieval_policy(scope: Column, sections: Column, chapters: Column, pinned: Column) -> Column:
    """How a query is searched, from its focus scope (null or auto: none), its hints (arrays of structs act, section and act, chapter) and whether a topic pins it.

    chapter_scoped: hints are looked for in chapters only. restrict_multi: no search over all books. strict_keys: the sections that may
    stay in the end; null where anything may.
    """
    focus = focus_scope(scope)
    hinted, acts = F.size(sections) > 0, F.size(F.array_distinct(F.filter(F.transform(sections, lambda h: h["act"]), lambda a: a.isNotNull())))
    return F.struct(
        focus.alias("focus_scope"), (hinted | (F.size(chapters) > 0) | focus.isNotNull()).alias("chapter_scoped"), (pinned | hinted & (acts == 1) & focus.isNotNull()).alias("restrict_multi"),
        F.when(hinted & focus.isNotNull(), section_keys(sections)).alias("strict_keys"),
    )


def heuristic_analysis(query: Column, act: Column, sections: Column, titles: Column, extra: Column) -> Column:
    """An analysis without a model: the query and its topic's extra queries (4 at most), the act, section and title hints."""
    return F.struct(query.alias("question"), query.alias("intent"), F.slice(F.array_distinct(F.concat(F.array(query), extra)), 1, 4).alias("queries"), act.alias("act"), sections.alias("sections"), F.slice(titles, 1, 3).alias("titles"))
