"""Each operator against a plain version of its contract."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from itertools import pairwise

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from compare import duck, same
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kagajflow.llm import blocks, common, near_dedup, op1_fingerprint, op2_packing, op3_language, op4_pii, op5_html, op6_decontamination, op7_warc_fixity, op8_simhash, op9_line_dedup, op10_token_counts, registry, tokens


@pytest.fixture(scope="module")
def texts(spark, data):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.tokenizer_path())


def run(spark, data, n):
    name = next(q for q in registry.queries() if q.startswith(f"op{n}_"))
    return registry.queries()[name](spark, data).collect()


# 1
def test_fingerprints(spark, data, texts):
    ids = sorted(texts)
    piece = re.compile(op1_fingerprint.PIECE)
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    found = {r["doc_id"]: r for r in run(spark, data, 1)}
    for i, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        text, other, r = texts[i], texts[after], found[i]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        own, changed, following = (set(piece.findall(x)) for x in (text, edited, other))
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - alike(own, changed)) < 1e-9 and abs(r["near_next"] - alike(own, following)) < 1e-9
    assert np.mean([r["near_edited"] > r["near_next"] for r in found.values()]) > 0.95


def read_fingerprint(text):
    """The digests that a fingerprint gives back by itself, peeled in plain Python."""
    n, _, shards = text.partition(":")
    found = set()
    for shard in shards.split(";"):
        width, _, cells = shard.partition("=")
        cells = {int(at): int(key, 16) for at, key in (c.split(".") for c in cells.split(",") if c)} if width != "0" else cells
        if width == "0":
            found |= {int(c.split(".")[1], 16) for c in cells.split(",") if c}
            continue
        seen = Counter()
        while cells:
            key = next(c for at, c in cells.items() if plain_check(c) and at in plain_places(c, int(width)))
            found.add(key)
            seen[key] += 1
            for place in plain_places(key, int(width)):
                cells[place] = cells.get(place, 0) ^ key
                if not cells[place]:
                    del cells[place]
        assert max(seen.values(), default=1) == 1
    assert len(found) == int(n)
    return found


def long_hash(value, seed):
    return xxhash.xxh64_intdigest((value & (1 << 64) - 1).to_bytes(8, "little"), seed)


def plain_check(key):
    high = key >> 16 << 16
    return long_hash(high, 42) & 0xFFFF == key & 0xFFFF


def plain_places(key, width):
    """Spark's hash of several columns takes each with the hash so far as its seed; integers count as four bytes."""
    out = []
    for t in range(3):
        h = long_hash(key, 42)
        for number in (width, t):
            h = xxhash.xxh64_intdigest(number.to_bytes(4, "little"), h)
        signed = h - (1 << 64) if h >> 63 else h
        out.append(signed % width + t * width)
    return out


def test_likeness_follows_from_the_strings(spark, data, texts):
    rows = {r["doc_id"]: r for r in run(spark, data, 1)}
    own = {i: read_fingerprint(r["fingerprint"]) for i, r in rows.items()}
    ids = sorted(rows)
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        assert abs(rows[i]["near_edited"] - alike(own[i], read_fingerprint(rows[i]["edited_fingerprint"]))) < 1e-9
        assert abs(rows[i]["near_next"] - alike(own[i], own[after])) < 1e-9


def test_peeling(spark):
    """Sketches of up to what their tables hold, digests that no table tells apart, and one side within the other."""
    from pyspark.sql import functions as F

    checked = op1_fingerprint.checked
    numbers = lambda a, b: F.transform(F.sequence(F.lit(a), F.lit(b)), lambda x: checked(F.xxhash64(x)))
    none = F.array().cast("array<bigint>")
    one = F.array(F.lit(5).cast("bigint"))  # no digest: its check is wrong, so it can never be peeled
    cases = [(numbers(1, 30), none, 30), (numbers(1, 300), numbers(200, 400), 299), (numbers(1, 3), numbers(3, 3), 2), (none, none, 0), (F.concat(numbers(1, 3), one), numbers(3, 3), 3)]
    for left, right, want in cases:
        row = spark.range(1).select(left.alias("left"), right.alias("right")).withColumn("likely", F.greatest(F.size("left"), F.size("right")))
        assert op1_fingerprint.peeled(row).first()["found"] == want
    full = spark.range(1).select(numbers(1, 60).alias("d")).select(F.expr(op1_fingerprint.sketch("d", "8")).alias("c"))
    assert full.select(F.expr(op1_fingerprint.peel("c", "8")).alias("n")).first()["n"] is None
    assert op1_fingerprint.TABLES * op1_fingerprint.WIDEST <= 1 << (64 - op1_fingerprint.BITS)  # no two tables share a place
    wide = spark.range(1).select(numbers(1, 1500).alias("left"), none.alias("right")).withColumn("likely", F.lit(1500))
    assert op1_fingerprint.peeled(wide).select("found", "width").first() == (1500, 0)  # more than the widest tables hold: compared as they are


# 2
def test_packing(spark, data, texts, library):
    rows = run(spark, data, 2)
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}
    total = 0
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] <= 2048 and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        assert r["piece"] == 0 or r["length"] == 2048
        total += r["length"]
    assert total == sum(map(len, ids.values()))
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in pairwise(places)) and sum(n for _, n in places) <= 2048
    assert len(by_sequence) <= -(-total // 2048) + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_recipes_use_every_length(counts):
    used, bins = {}, 0
    for times, lengths in op2_packing.recipes(counts, 64):
        assert sum(lengths) <= 64 and times > 0
        bins += times
        for x in lengths:
            used[x] = used.get(x, 0) + times
    assert used == counts
    assert bins <= 1.25 * -(-sum(k * n for k, n in counts.items()) // 64) + 1 or max(counts) > 32


# 3
def test_language_of_held_out_texts(spark, data, texts):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = op3_language.fit(documents.where("doc_id % 2 = 0"))  # half of the texts, to be tested on the other half
    held_out = documents.where("doc_id % 2 = 1").withColumnRenamed("lang", "truth")
    judged = op3_language.of_documents(held_out, model).join(held_out.select("doc_id", "truth"), "doc_id")
    assert judged.where("text_lang = truth").count() / judged.count() > 0.98
    assert judged.where("accepted").count() / judged.count() > 0.98


def test_evidence_decides_where_the_text_does_not(spark):
    rows = [(i, "the cat and the dog are in the house with the others", "en", "a.org") for i in range(40)] + [(100 + i, "der hund und die katze sind nicht mit dem haus", "de", "b.de") for i in range(40)]
    docs = spark.createDataFrame([*rows, (500, "ok", None, "b.de"), (501, "ok", None, "a.org"), (502, "12 34", "en", "a.org")], "doc_id long, text string, lang string, source string")
    found = {r["doc_id"]: r for r in op3_language.of_documents(docs, op3_language.fit(docs.where("doc_id < 500"))).collect()}
    assert found[500]["lang"] == "de" and found[501]["lang"] == "en" and (found[502]["lang"], found[502]["accepted"]) == ("und", False)


def plain_grams(text):
    raw = [b | 0x20 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()]
    return [((a << 16 | b << 8 | c) * 2654435761 & 0xFFFFFFFF) >> 16 for a, b, c in zip(raw, raw[1:], raw[2:], strict=False)]


def plain_languages(rows, labelled):
    """Language, confidence and acceptance of rows (id, text, declared, suffix, host, domain) in plain Python; labelled: (text, label, held out)."""
    from math import exp, log

    names = sorted(k for k, n in Counter(label for _, label, _ in labelled).items() if n >= 20)
    counts, kept_out = {k: Counter() for k in names}, {k: [] for k in names}
    for text, label, held in labelled:
        if label in names and len(text.encode()) >= 3:
            if held:
                kept_out[label].append(plain_grams(text))
            else:
                counts[label].update(set(plain_grams(text)))
    whole = {k: sum(c.values()) + 0.5 * 65536 for k, c in counts.items()}
    weights = [{g: log((n + 0.5) / whole[k]) for g, n in counts[k].items()} for k in names]
    unseen = [log(0.5 / whole[k]) for k in names]
    total = lambda k, grams: sum(weights[k].get(g, unseen[k]) for g in grams)
    usual, far = [], []
    for k, name in enumerate(names):
        means = [(len(g), total(k, g) / len(g)) for g in kept_out[name]]
        assert len(means) >= 5
        usual.append(np.percentile([m for _, m in means], 50))
        far.append(np.percentile([(usual[k] - m) * n / (n + 20) for n, m in means], 98) + 1.25)
    logs, vote, size = {}, {}, {}
    for i, text, *_ in rows:
        grams = plain_grams(text or "")
        size[i] = min(len(grams), 3000)
        logs[i] = [total(k, grams) * size[i] / max(len(grams), 1) / 3 for k in range(len(names))]
        vote[i] = logs[i].index(max(logs[i])) if any(c.isalpha() for c in text or "") else None
    votes = Counter(v for v in vote.values() if v is not None)
    base = [(votes[k] + 1) / (sum(votes.values()) + len(names)) for k in range(len(names))]
    by = {c: {} for c in (2, 3, 4, 5)}
    for row in rows:
        for c in by:
            if row[c] is not None and vote[row[0]] is not None:
                by[c].setdefault(row[c], Counter())[vote[row[0]]] += 1

    def given(row, column, prior):
        same = by[column].get(row[column], {}) if row[column] is not None else {}
        smooth = [max(0, same.get(k, 0) - (vote[row[0]] == k)) + 4 * prior[k] for k in range(len(names))]
        return [x / sum(smooth) for x in smooth]

    out = {}
    for row in rows:
        i = row[0]
        if vote[i] is None:
            out[i] = ("und", 0.0, False)
            continue
        host = given(row, 4, given(row, 5, base))
        fused = [a + log(p) for a, p in zip(logs[i], host, strict=True)]
        for column in (2, 3):
            fused = [f + log(p / q) for f, p, q in zip(fused, given(row, column, base), base, strict=True)]
        k = fused.index(max(fused))
        confidence = 1 / sum(exp(f - max(fused)) for f in fused)
        sure = usual[k] * size[i] - 3 * logs[i][k] <= far[k] * (size[i] + 20) and confidence >= 0.5
        other = row[2] is not None and row[2] not in names  # a label that nothing is fitted for
        out[i] = (row[2], 0.0, True) if other and not sure else (names[k], confidence, sure)
    return out


def test_fusion_like_brute_force(spark):
    """Counts, priors and likelihoods over hosts, domains, suffixes, declared languages and rows without evidence."""
    rng = random.Random(8)
    vocabulary = {"en": "the house and other words with this".split(), "de": "das haus und andere worte mit diesem".split(), "fr": "la maison et les autres mots avec".split()}
    rows = []
    for i in range(150):
        lang = rng.choice(list(vocabulary))
        text = " ".join(rng.choices(vocabulary[rng.choice([lang] * 9 + list(vocabulary))], k=rng.choice([0, 1, 2, 8, 40])))
        host = rng.choice([None, f"{lang}.a.org", "x.a.org", "b.net"])
        rows.append((i, text, rng.choice([None, lang, "zz"]), rng.choice([None, lang, "org"]), host, host and ".".join(host.split(".")[-2:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string, declared string, suffix string, host string, domain string")
    labelled = spark.createDataFrame([(i, " ".join(rng.choices(words, k=60)), lang) for i, (lang, words) in enumerate((x for x in vocabulary.items() for _ in range(24)))], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in op3_language.identify(docs, op3_language.fit(labelled)).collect()}
    want = plain_languages(rows, [(r["text"], r["lang"], r["held"]) for r in labelled.select("*", op3_language.held_out(labelled["doc_id"]).alias("held")).collect()])
    for i, (lang, confidence, accepted) in want.items():
        assert (found[i]["lang"], found[i]["accepted"]) == (lang, accepted) and abs(found[i]["confidence"] - confidence) < 1e-6


def test_unlabelled_languages_and_noise_are_rejected(spark):
    from pyspark.sql import functions as F

    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = op3_language.fit(documents.where("lang <> 'es'"))
    judged = op3_language.of_documents(documents.withColumn("lang", F.when(F.col("lang") != "es", F.col("lang"))), model).join(documents.select("doc_id", F.col("lang").alias("truth")), "doc_id")
    assert judged.where("truth = 'es' and accepted").count() <= 0.03 * judged.where("truth = 'es'").count()
    assert judged.where("truth <> 'es' and not accepted").count() == 0
    rng = random.Random(2)
    noise = spark.createDataFrame([(i, " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=6)) for _ in range(60))) for i in range(100)], "doc_id long, text string")
    assert op3_language.of_documents(noise, model).where("accepted").isEmpty()


def test_one_repetitive_text_is_no_norm(spark):
    """Twenty labelled texts and one of 1.6 MB that repeats itself: held-out texts of the language are accepted."""
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang = 'en' and length(text) > 20").select("doc_id", "text", "lang").limit(420).collect()
    long = documents[0]["text"][:300] * 5400
    for seed in range(3):
        rows = documents[:]
        random.Random(seed).shuffle(rows)
        labelled = spark.createDataFrame([*rows[:20], (10**6 + seed, long, "en")], "doc_id long, text string, lang string")
        others = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows[20:]], "doc_id long, text string")
        assert op3_language.of_documents(others, op3_language.fit(labelled)).where("not accepted").count() <= 8


def test_junk_labels(spark):
    """A thousand labels of few rows are no languages; what declares one isn't rejected for that. More labels than LANGUAGES leave the most frequent."""
    words = {"a": "kilo", "b": "mesa", "c": "tutu"}
    rows = [(i, f"{w} {w}{w} {w}", k) for i, (k, w) in enumerate(list(words.items()) * 30)] + [(1000 + i, "xylo phon qua", f"junk {i}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = op3_language.fit(docs)
    assert model.languages == ["a", "b", "c"] and model.weights.shape == (3, 1 << 16)
    judged = op3_language.of_documents(docs, model).join(docs.select("doc_id", docs["lang"].alias("truth")), "doc_id").collect()
    assert all(r["accepted"] for r in judged) and all(r["lang"] == r["truth"] for r in judged if r["doc_id"] < 1000)


# 4
PLAIN = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub(r"\D", "", m)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(re.sub(r"\D", "", m)[::-1])) % 10 == 0),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15),
)


def plain_spans(text):
    return [(kind, *m.span()) for kind, pattern, ok in PLAIN for m in re.finditer(pattern, text) if ok(m[0])]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aB0159.+-@ (%_é", max_size=60))
def test_spans_like_plain_patterns(text):
    assert [x[:3] for x in op4_pii.find_spans(text) if x[0] in op4_pii.BASE] == plain_spans(text)


def test_pii(spark, data, texts):
    for r in run(spark, data, 4):
        spans = plain_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in op4_pii.BASE] == [sum(s[0] == k for s in spans) for k in op4_pii.BASE]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_checksums_context_and_redaction():
    text = "my card is 4111 1111 1111 1111, IBAN DE89 3704 0044 0532 0130 00"
    found = op4_pii.find_spans(text)
    assert [(k, s) for k, _, _, s in found] == [("card", 1.0), ("iban", 1.0)]
    assert op4_pii.redact(text, found) == "my card is [card], IBAN [iban]"
    assert op4_pii.find_spans("DE89 3704 0044 0532 0130 01") == []


# 5
def test_html(spark, data):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in run(spark, data, 5):
        import html

        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        parts = (re.sub(r"\s+", " ", html.unescape(t)).strip() for t in re.split(r"<[^>]+>", re.sub(r"</?(?:b|br)>", " ", article)))
        assert r["text"] == "\n".join(filter(None, parts)) and r["n_chars"] == len(r["text"])


def test_line_blocks_without_an_article():
    body = "".join(f"<p>{'words of the story go on ' * 5}{i}</p>" for i in range(5))
    page = f"<html><head><title>t</title><style>p</style></head><body><div id='top-nav'>a b</div><ul class=menu><li><a href=x>one</a><li><a href=y>two</a></ul>{body}<form>mail</form><div class='comment-list'><p>{'I think so too ' * 20}</p></div><footer>c</footer></body>"
    found = op5_html.main_text(page).split("\n")
    assert len(found) == 5 and all(x.startswith("words of the story") for x in found)
    assert op5_html.main_text("<p>short &amp; <b>bo</b>ld<br>line") == "short & bold line"
    assert op5_html.main_text("<article><p>x<p>y<aside>z</aside><div class=ad>buy</div></article>") == "x\ny"


def test_what_stands_between_articles_is_left_out():
    story = [f"Part {k} of the story goes on for some while, and then it ends. " * 3 for k in range(4)]
    page = f"<body><article><p>{story[0]}</p><p>{story[1]}</p></article><p>Related reading today</p><p>Subscribe to our letter</p><article><p>{story[2]}</p><p>{story[3]}</p></article></body>"
    assert op5_html.main_text(page).split("\n") == [s.strip() for s in story]


def test_comments_in_any_language():
    """Known by their structure: a time and an author in each of several blocks alike, or articles within the article."""
    story = "".join(f"<p>{'Die Geschichte geht noch eine Weile so weiter. ' * 4}{k}</p>" for k in range(3))
    said = "".join(f"<div class='beitrag'><a href='/u/{k}'>Leser {k}</a> <time>12:0{k}</time><p>{'Das sehe ich ganz genauso, danke. ' * 6}</p></div>" for k in range(3))
    nested = "".join(f"<article><p>{'Ich auch, und zwar schon lange. ' * 6}</p></article>" for k in range(2))
    for more in (f"<section class='meinungen'>{said}</section>", nested, f"<div class='kommentare'><p>{'Ja. ' * 90}</p></div>"):
        found = op5_html.main_text(f"<body><article><h1>Titel</h1><p>Von <a href='/a'>A</a>, <time>heute</time></p>{story}{more}</article></body>")
        assert found.count("Geschichte") == 12 and "genauso" not in found and "lange" not in found and "Ja." not in found


def test_html_without_marks(spark):
    """Where no article is marked line blocks alone find it."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    plain = [re.sub(r"(</?)article", r"\1div", r["html"]) for r in rows]
    assert [op5_html.main_text(p) for p in plain] == [op5_html.main_text(r["html"]) for r in rows]
    assert all(op5_html.main_text(p) for p in plain)


@pytest.mark.parametrize("part", ["<a", "<a ", "<a b='x>' ", '<a b="x>" ', "<p>", "</p", "<script></script", "<!--", "<a b=", "<div><p>", "<", "<li>", "<b></i>", "<a href='", "a>b\"c'"])
def test_broken_markup_is_read_in_linear_time(part):
    began = time.process_time()
    op5_html.main_text(part * (500_000 // len(part)) + '"')
    assert time.process_time() - began < 5


def test_body_beside_marked_teasers():
    cards = "".join(f"<article><h3><a href=x>card {i}</a></h3><p>read this too</p></article>" for i in range(4))
    body = "".join(f"<p>{'words of the story go on ' * 5}{i}</p>" for i in range(5))
    found = op5_html.main_text(f"<body><div class=body>{body}</div>{'<p><a href=y>more of it</a></p>' * 4}{cards}</body>").split("\n")
    assert [x for x in found if x.startswith("words of the story")] == [f"{'words of the story go on ' * 5}{i}" for i in range(5)]
    assert not any("read this" in x for x in found)
    assert op5_html.main_text(f"<body>{'<p>a short line</p>' * 3}<article>{body}<p>short</p></article></body>").split("\n")[-1] == "short"


# 6
def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=80), st.lists(st.sampled_from("abc"), max_size=80))
def test_bit_parallel_distance(pattern, text):
    assert op6_decontamination.least_distance(pattern, text) == plain_distance(pattern, text)


def test_decontamination_like_brute_force(spark, data, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    rng = random.Random(5)
    planted = {}
    for i in range(12):  # items with one word in six changed, within other text
        words = op6_decontamination.words_of(items[i]).split()
        for k in range(0, len(words), 6):
            words[k] = f"zz{rng.random()}".replace(".", "")
        planted[10_000 + i] = "something before it " + " ".join(words) + " and something behind"
    some = {i: texts[i][:1500] for i in sorted(texts)[:50]} | planted
    docs = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    benchmark = spark.read.parquet(f"{data}/benchmark.parquet")
    whole = {r["doc_id"]: r["item_ids"] for r in op6_decontamination.contamination(docs, benchmark).collect()}
    blocked = {r["doc_id"]: r["item_ids"] for r in op6_decontamination.contamination(docs, benchmark, block_bytes=2000).collect()}
    assert whole == blocked
    for i, text in some.items():
        words = op6_decontamination.words_of(text).split()
        want = []
        for item, other in items.items():
            pattern = op6_decontamination.words_of(other).split()
            if len(pattern) >= 5 and plain_distance(pattern, words) <= int(0.2 * len(pattern)):
                want.append(item)
        assert whole[i] == sorted(want)
    assert all(whole[10_000 + i] for i in range(12))


def test_rows_are_judged_by_themselves(spark):
    of = lambda i: " ".join(f"{w}{i}" for w in "all words of this item end with its number".split())
    items = spark.createDataFrame([(i, of(i)) for i in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(1, of(3)), (1, "a clean text"), (1, "a clean text"), (None, f"before {of(39)} behind")], "doc_id long, text string")
    for block_bytes in (10**6, 300):
        found = op6_decontamination.contamination(docs, items, block_bytes=block_bytes)
        assert sorted((r["doc_id"] or 0, r["contaminated"], tuple(r["item_ids"])) for r in found.collect()) == [(0, True, (39,)), (1, False, ()), (1, False, ()), (1, True, (3,))]


def test_short_items_and_texts_without_blanks(spark):
    items = [(1, "Tie"), (2, "two words"), (3, "今天的天气非常好，我们去公园。"), (4, "วันนี้อากาศดีมาก"), (5, "東京"), (6, "?!"), (7, None)]
    texts = [(1, "a tie."), (2, "ties, two-words"), (3, "two other words"), (4, "他说：今天的天气非常好，我们去公园。好。"), (5, "今天天气非常好我们去公园"), (6, "เธอบอกว่าวันนี้อากาศดีมากจริงๆ"), (7, "新東京駅"), (8, "東西京")]
    found = op6_decontamination.contamination(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"]: r["item_ids"] for r in found.collect()} == {1: [1], 2: [2], 3: [], 4: [3], 5: [3], 6: [4], 7: [5], 8: []}


# 7
def faults(ours, theirs):
    found = op7_warc_fixity.audit(op7_warc_fixity.records(ours), op7_warc_fixity.records(theirs))
    return sorted((r["id"], r["status"]) for r in found.where("status <> 'intact'").collect())


def test_fixity(spark, data):
    from pyspark.sql import functions as F

    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html")
    changed = pages.withColumn("html", F.when(F.col("page_id") == 17, F.concat(F.lit("?"), F.expr("substring(html, 2)"))).otherwise(F.col("html")))
    assert faults(pages, pages) == []
    assert faults(pages, changed.where("page_id <> 49")) == [(17, "damaged"), (49, "lost")]
    assert faults(pages, pages.where("page_id <> 5")) == [(5, "lost")]  # what stands behind it in the file is untouched
    assert faults(pages, pages.unionByName(pages.where("page_id = 3").withColumn("html", F.lit("other")))) == [(3, "added")]
    assert faults(pages.where("page_id <> 0"), pages) == [(0, "added")]
    cut = pages.withColumn("html", F.when(F.col("page_id") == 20, F.expr("substring(html, 1, 50)")).otherwise(F.col("html")))
    assert faults(pages, cut) == [(20, "damaged")]


def test_fixity_of_repeated_and_missing_ids(spark):
    rows = [(1, "u", "a"), (1, "u", "a"), (1, "u", "b"), (None, "v", "c"), (None, "v", "d"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert faults(pages, pages) == []
    assert faults(pages, pages.where("html <> 'd' or html is null")) == [(-1, "lost")]
    assert faults(pages, pages.dropDuplicates()) == [(1, "damaged"), (1, "damaged")]
    assert faults(pages.dropDuplicates(), pages) == [(1, "added")]


def test_places_of_an_id_with_many_records(spark):
    """Records of one id, many of them equal, are placed in slices as in one order."""
    rows = [(k % 3 if k % 2 else 7, "u", f"body {k % 400}" if k % 5 else "same") for k in range(3000)]
    found = op7_warc_fixity.records(spark.createDataFrame(rows, "page_id long, url string, html string"))
    placed = op7_warc_fixity.placed(found, per_file=4).collect()
    at = {}
    for file, order in ((0, (0, 1, 2)), (1, (7,))):
        own = sorted((r for r in found.collect() if r["leaf"] in order), key=lambda r: (r["leaf"], r["digest"]))
        n = 0
        for position, r in enumerate(own):
            at[file, position] = (r["id"], r["digest"], n)
            n += r["length"]
    assert {(r["file"], r["position"]): (r["id"], r["digest"], r["offset"]) for r in placed} == at and len(placed) == 3000


# 8
def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_classes(spark, data, texts):
    found = {r["doc_id"]: r for r in run(spark, data, 8)}
    prints = {i: plain_simhash(t) for i, t in texts.items()}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(prints):
        for b in sorted(prints):
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2 and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in found.items()} == {i: (f"{prints[i]:016x}", find(i)) for i in prints}


def test_large_subtrees_are_sliced(spark, monkeypatch):
    """Fingerprints that share a run, more than a slice holds: the links are those of brute force."""
    monkeypatch.setattr(blocks, "SLICE", 16)
    rng = random.Random(4)
    prints = sorted({rng.getrandbits(20) & 0x1F1F1 | (0xABCDE << 40) for _ in range(400)} | {rng.getrandbits(64) for _ in range(100)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = op8_simhash.classes(spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")).collect()
    root = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    assert {r["doc_id"]: r["component_id"] for r in found} == dict(enumerate(root))


@pytest.mark.parametrize(("words", "budget"), [(1, 2), (2, 9)])
def test_trie_join_finds_all_pairs(words, budget):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (60, words), dtype=np.uint64)
    noisy = base[rng.integers(0, 60, 900)].copy()
    for _ in range(budget):
        noisy[np.arange(900), rng.integers(0, words, 900)] ^= np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64)
    keys = np.unique(noisy, axis=0)
    want = {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if int(np.bitwise_count(keys[i] ^ keys[j]).sum()) <= budget}
    got = [p for a, b in op8_simhash.pairs_within(keys, 0, [(0, len(keys), 0, len(keys))], budget) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(got) == len(set(got)) and {tuple(sorted(p)) for p in got} == want


def test_near_duplicates_of_five_words(spark):
    """The rows that stay are those of brute force over all pairs, also where texts share an id or have none."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    some = [(None if r["doc_id"] % 50 == 0 else r["doc_id"] // 3, r["text"]) for r in rows]
    sets = []
    for _, text in some:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text).split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})
    root = list(range(len(some)))
    for a in range(len(some)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if root[a] != root[b] and shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame(some, "doc_id long, text string")
    hashes = {(r["doc_id"], r["text"]): r["h"] for r in docs.withColumn("h", common.text_hash(docs["text"])).collect()}
    first = {}
    for r, row in zip(root, some, strict=True):
        key = (row[0] is None, row[0] or 0, hashes[row])
        first[r] = min(first.get(r, (key, row)), (key, row))
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()
    assert sorted(((r["doc_id"] or -1, r["text"]) for r in kept)) == sorted((row[0] or -1, row[1]) for _, row in first.values())


def test_unrelated_texts_with_one_id_stay(spark):
    docs = spark.createDataFrame([(7, "one text of its own with some words"), (7, "an unrelated text that has nothing of the other"), (7, "one text of its own with some words"), (8, "a third text"), (None, "a third text")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"][:3]) for r in near_dedup.one_of_each(docs).collect()) == [(7, "an "), (7, "one"), (8, "a t")]


def test_near_duplicates_at_the_threshold(spark):
    """Isolated pairs on either side of 0.8, whole sets and pairs with a repeated passage: each is judged by its sets alone."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9))

    def pair(shared, own):  # `own` words before and behind a common run give each text so many shingles of its own
        middle = [word() for _ in range(shared + 4)]
        return [*(word() for _ in range(own)), *middle], [*middle, *(word() for _ in range(own))]

    rows, one, both = [], set(), set()
    for n in range(300):
        a, b = pair(80, 10)  # 80 of 100
        rows += [(2 * n, " ".join(a)), (2 * n + 1, " ".join(b))]
        one.add(2 * n)
    for n in range(300, 400):
        a, b = pair(79, 11)  # 79 of 101
        rows += [(2 * n, " ".join(a)), (2 * n + 1, " ".join(b))]
        both |= {2 * n, 2 * n + 1}
    for n in range(400, 440):  # one of the two repeats 40 words fourteen times
        a, b = pair(160, 5)
        rows += [(2 * n, " ".join(a)), (2 * n + 1, " ".join([*b, *(b[20:60] * 14)]))]
        one.add(2 * n)
    for n in range(440, 640):  # four of five
        a, b = pair(4, 1)
        rows += [(2 * n, " ".join(a[1:])), (2 * n + 1, " ".join(b))]
        one.add(2 * n)
    kept = {r["doc_id"] for r in near_dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == one | both


# 9
def test_first_occurrences_are_streamed_in_order(spark, data):
    index = common.stored(op9_line_dedup.line_index(common.table(spark, data, "documents"), "doc_id", "text", 40), "index")
    plan = op9_line_dedup.repeated_keys(index, 5)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(h1" in plan and re.search(r"Sort \[h1#\d+L? ASC NULLS FIRST, h2#\d+L? ASC NULLS FIRST, last#\d+L? DESC NULLS LAST, position", plan)


# the stages of the pipeline that are other than their operator's query
def test_stages_like_brute_force(spark, data, library):
    stages = dict(corpus_pipeline.STAGES)
    docs = common.table(spark, data, "documents")
    told = docs.select("*", op3_language.held_out(docs["doc_id"]).alias("held")).collect()
    judged = plain_languages([(r["doc_id"], r["text"], r["lang"], None, r["source"], r["source"]) for r in told], [(r["text"], r["lang"], r["held"]) for r in told if r["text"] is not None and r["lang"] is not None])
    kept = stages["language_id"](spark, docs, data)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, _, accepted) in judged.items() if accepted}
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    holders = {}
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    for i, text in rows.items():
        for line in text.split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(i)
    last = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    want = {i: "\n".join(line for line in text.split("\n") if last.get(key(line), i) == i) for i, text in rows.items()}
    assert {r["doc_id"]: r["text"] for r in stages["line_dedup"](spark, docs, data).collect()} == want
    packed = stages["packing"](spark, docs, data).collect()
    lengths = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows.items()}
    assert {i: sum(r["length"] for r in packed if r["doc_id"] == i) for i in rows} == lengths
    clean = {r["doc_id"] for r in stages["decontamination"](spark, docs, data).collect()}
    patterns = [op6_decontamination.words_of(r["text"] or "").split() for r in common.table(spark, data, "benchmark").collect()]
    holds = lambda words, p: bool(p) and op6_decontamination.least_distance(p, words) <= (int(0.2 * len(p)) if len(p) >= 5 else 0)  # noqa: E731  every item against every text
    assert clean == {i for i, t in rows.items() if not any(holds(op6_decontamination.words_of(t).split(), p) for p in patterns)}


# 7 and 9
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, data, name):
    same(registry.queries()[name](spark, data).toPandas(), duck(data).sql(registry.oracle_sql()[name]).df())


# 10
def test_token_counts(spark, data, texts, library):
    for r in run(spark, data, 10):
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (len(ids), len(texts[r["doc_id"]].encode()), len(ids) > 1024)
        assert r["limit_bytes"] == sum(len(tokens.counter().token_of[x]) for x in ids[:1024])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "'", "s", " ", "\n", "1", "½", "é", "l", "re", "ve", ".", "　", "日", "😀", "<|endoftext|>", "the", "  "]), max_size=24).map("".join))
def test_prefix_table(text):
    library = Tokenizer.from_file(tokens.tokenizer_path()) if not hasattr(test_prefix_table, "library") else test_prefix_table.library
    test_prefix_table.library = library
    assert op10_token_counts.prefix_table(text).tolist() == [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]


def test_stored_prefixes_answer_budgets(spark):
    from pyspark.sql import functions as F

    stored = op10_token_counts.prefix_counts(spark.createDataFrame([(1, "hello brave new world"), (2, None)], "doc_id long, text string"))
    found = stored.select("doc_id", op10_token_counts.tokens_of_prefix(F.col("prefix_tokens"), F.lit(11)).alias("n"), op10_token_counts.longest_prefix(F.col("prefix_tokens"), 2).alias("k")).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == [(1, 2, 11), (2, 0, 0)]
