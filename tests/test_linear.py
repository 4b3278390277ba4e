"""The parse against a plain one on random texts, its time on long texts, and how often plans evaluate it; lexicons of many
phrases; options by row; odd authorities."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from proseloom.functions import patterns as P
from proseloom.functions import text as T
from proseloom.operators import scoring, structure
from proseloom.plans.analyze import Analysis
from proseloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
SPACE = set(P.SPACE)
PIECES = ["#", "# ", "## Top ##", "####### x", "- ", "* item", "+", "1. ", "12) y", "3.5", "> q", ">", "```", "~~~ js", "word", "two words", " ", "\t", "\xa0", "\u2003", "\x1c", "\n", "\n", "\n\n", "\r\n", "\r", ".", "! ", "? ", "...", "Dr. ", "etc.", "U.S. ", "e.g.", "Ph.D. ", "a.b.c.d.", "É", "A", " Next", "http://a.b/c", "HTTPS://x.y/z),", "doi:10.1234/AB.c", "10.99999.1/q]", "\"", "<", "5%"]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def strip(t):
    return t.strip(P.SPACE)


def plain_blocks(text):
    """(kind, start_line, end_line, start, end, heading) by going over lines."""
    text = text.removeprefix("\ufeff")
    lines, at = [], 0
    for raw in text.split("\n"):
        lines.append((raw.removesuffix("\r"), at))
        at += len(raw) + 1
    if lines and lines[-1][1] == len(text):
        lines.pop()
    out, heading, i = [], None, 0

    def kind(line):
        t = line.lstrip(P.SPACE)
        if not t:
            return None
        if t.startswith(("```", "~~~")):
            return "CodeFence"
        n = len(t) - len(t.lstrip("#"))
        if 1 <= n <= 6 and (len(t) == n or t[n] == " "):
            return "Heading"
        if t.startswith(">"):
            return "BlockQuote"
        return "ListItem" if re.match(r"[-*+] |\d+[.)] ", t) else "Paragraph"

    while i < len(lines):
        k, j = kind(lines[i][0]), i
        if k is None:
            i += 1
            continue
        if k == "CodeFence":
            mark = lines[i][0].lstrip(P.SPACE)[:3]
            j += 1
            while j < len(lines) and not lines[j][0].lstrip(P.SPACE).startswith(mark):
                j += 1
            j = min(j, len(lines) - 1)
        elif k in ("Paragraph", "BlockQuote"):
            while j + 1 < len(lines) and kind(lines[j + 1][0]) == k:
                j += 1
        out.append((k, i + 1, j + 1, lines[i][1], lines[j][1] + len(lines[j][0]), heading if k in ("Paragraph", "ListItem", "BlockQuote") else None))
        if k == "Heading":
            heading = strip(lines[i][0].lstrip(P.SPACE).lstrip("#"))
        i = j + 1
    return out


def plain_sentences(text):
    """(text, start, end) of a block by looking at each mark."""
    out, start, i = [], 0, 0

    def put(a, b):
        while a < b and text[a] in SPACE:
            a += 1
        while b > a and text[b - 1] in SPACE:
            b -= 1
        if a < b:
            out.append((text[a:b], a, b))

    while i < len(text):
        if text[i] in ".!?":
            at = i
            while at > 0 and text[at - 1] not in SPACE:
                at -= 1
            token = text[at : i + 1].lower()
            short = text[i] == "." and (token[:-1] in P.ABBREVIATIONS or re.fullmatch(r"(?:[a-z]\.)+", token))
            following = i + 1
            while following < len(text) and text[following] in SPACE:
                following += 1
            if not short and (following == len(text) or text[following].isupper()):
                put(start, i + 1)
                start, i = following, following
                continue
        i += 1
    put(start, len(text))
    return out


def random_texts():
    r = random.Random(9)
    some = ["".join(r.choice(PIECES) for _ in range(r.randint(1, 60))) for _ in range(500)]
    return [*some, "", "\ufeff# T\n\nx", "```\nopen\n\n", "x\n\n```", "a\r\nb\r\n", *("U." * n + "S. Next. Then" for n in (62, 63, 64, 65, 1000)), *("a.b." + "c." * n + " Next" for n in (1, 70))]


def test_parse_against_a_plain_one(spark):
    texts = random_texts()
    found = structure.blocks(docs(spark, *texts)).collect()
    got = sorted((b.doc_id, b.block_index, (b.kind, b.start_line, b.end_line, b.start_char, b.end_char, b.heading)) for b in found)
    want = [(i, n, b) for i, t in enumerate(texts) for n, b in enumerate(plain_blocks(t))]
    for g, w in zip(got, want, strict=False):
        assert g == w, texts[w[0]]
    assert len(got) == len(want)
    where = {(b.doc_id, b.block_index): b for b in found}
    for b in found:
        assert texts[b.doc_id].removeprefix("\ufeff")[b.start_char : b.end_char] == b.text
    said = {}
    for s in structure.sentences(structure.blocks(docs(spark, *texts))).orderBy("doc_id", "block_index", "sent_index").collect():
        said.setdefault((s.doc_id, s.block_index), []).append((s.text, s.start_char, s.end_char))
    for k, b in where.items():
        assert said.get(k, []) == [(t, b.start_char + x, b.start_char + y) for t, x, y in plain_sentences(b.text)], b.text


def test_spans_against_a_plain_one(spark):
    texts = random_texts()
    space = "".join(sorted(SPACE))
    url = re.compile(rf"https?://[^{re.escape(space)}<>()\[\]\"']+", re.I)
    doi = re.compile(rf"(?:https?://(?:dx\.)?doi\.org/|\bdoi:[{re.escape(space)}]*)?(10\.\d{{4,}}(?:\.\d+)*/[^{re.escape(space)}\"<>]+)", re.I)
    blocks = structure.blocks(docs(spark, *texts))
    some = [b for b in blocks.collect() if b.kind != "CodeFence"]
    want = sorted((b.doc_id, b.block_index, (v := m.group().rstrip(".,;:!?'\"")), b.start_char + m.start(), b.start_char + m.start() + len(v)) for b in some for m in url.finditer(b.text))
    assert sorted(map(tuple, structure.citations(blocks).collect())) == want and want
    want = sorted((b.doc_id, b.block_index, (v := m.group(1).rstrip(".,;:!?'\")]}")).lower(), b.start_char + m.start(), b.start_char + m.end() - len(m.group(1)) + len(v)) for b in some for m in doi.finditer(b.text))
    assert sorted(map(tuple, structure.dois(blocks).collect())) == want and want


def timed(df):
    began = time.time()
    rows = df.collect()
    return rows, time.time() - began


def test_long_texts_take_linear_time(spark):
    plain = "word and more words in a long line without any of it " * 20_000
    one = docs(spark, plain)
    structure.citations(structure.blocks(docs(spark, "x"))).collect()
    for found in (structure.citations, structure.dois):
        rows, took = timed(found(structure.blocks(one)))
        assert rows == [] and took < 10
    many = docs(spark, "\n\n".join(f"word{i % 977} and word{i} in block number {i}" for i in range(20_000)))
    for found in (structure.blocks, scoring.density, lambda d: Analysis(d).scores()):
        rows, took = timed(found(many))
        assert took < 10
    assert rows[0].score == pytest.approx(0.6)
    said = docs(spark, "It cost 5 units.\n" * 10_000)
    rows, took = timed(Analysis(said).findings().orderBy("start_char"))
    assert took < 10 and [r.start_line for r in rows] == list(range(1, 10_001)) and [r.end_line for r in rows] == list(range(1, 10_001))
    links = docs(spark, "see http://a.org/x and " * 20_000)
    rows, took = timed(structure.citations(structure.blocks(links)))
    assert took < 10 and len(rows) == 20_000 and rows[-1].start_char == 23 * 19_999 + 4


def test_plans_evaluate_a_parse_once(spark):
    """Each pattern that splits a text is in the optimised plan once in its plain and once in its Unicode form."""
    count = lambda name: QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(")
    assert count("block_spans") == 2
    assert count("density_flags") == 2 + 2  # tokens of the text and of the heading
    assert count("grounding_adjacent") == 2 + 2
    assert count("citations") == 2 + 2
    assert count("findings") == count("doc_scores") == 2 + 2 + 2


def test_first_occurrences(spark):
    r = random.Random(2)
    sets = [[[f"t{x}" for x in r.sample(range(40), r.randint(0, 12))] for _ in range(r.randint(0, 30))] for _ in range(60)]
    got = spark.createDataFrame([(s,) for s in sets], "s array<array<string>>").select("s", scoring.novel_counts(F.col("s")).alias("n")).collect()
    for row in got:
        seen, want = set(), []
        for s in row.s:
            want.append(len(set(s) - seen))
            seen |= set(s)
        assert row.n == want


def test_many_phrases(spark):
    r = random.Random(4)
    letters = "abc 'é.*"
    phrases = ["".join(r.choice(letters) for _ in range(r.randint(1, 5))) for _ in range(300)]
    phrases += [phrases[0], "ab", "abc", "abca", "needless to say", "it's (so)", "ab"]
    texts = ["".join(r.choice(letters) for _ in range(n)) for n in (0, 1, 5, 40, 200)] + ["NEEDLESS to say It's (So)", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.filler_hits(F.col("t"), phrases).alias("h")).collect()
    for row in got:
        assert row.h == (None if row.t is None else [p for p in phrases if p in row.t.lower()])
    with_empty = ["", "b", "", *phrases]
    assert spark.createDataFrame([("ab",), ("",)], "t string").select(T.filler_hits(F.col("t"), with_empty)).collect()[1][0] == ["", ""]


def test_thousands_of_phrases_cost_little(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9)))
    words = [word() for _ in range(3000)]
    text = " ".join(r.choice(words) for _ in range(100_000))
    table = spark.createDataFrame([(1, text)] * 8, "doc_id long, text string").repartition(4).cache()
    table.count()

    def took(count):
        flags = scoring.density(table, P.Options(filler=[" ".join(r.choices(words, k=4)) for _ in range(count)]))
        flags.collect()
        return min(timed(flags)[1] for _ in range(3))

    few, many = took(8), took(5000)
    assert many < 4 * few


def test_options_by_row(spark):
    strict, other = '{"bands": {"Slop": 0.3}, "density": {"minFillerHits": 1}, "FILLER": ["Synergy"]}', '{"weights": {"grounding": 1, "density": 0.1}, "bands": null}'
    texts = ["Synergy grows, needless to say.", "We grew 5%. It cost 7 units. Synergy.", "calm words", "# H\n\nIt is important to note, needless to say.", None]
    both = spark.createDataFrame([(i, t, o) for i, (t, o) in enumerate((t, o) for t in texts for o in (strict, other, None, "null"))], "doc_id long, text string, options string")
    got = {r.doc_id: tuple(r) for r in Analysis(both, F.col("options")).reports().collect()}
    want = {}
    for o in (strict, other, None, "null"):
        own = both.where(F.col("options").eqNullSafe(F.lit(o)))
        want |= {r.doc_id: tuple(r) for r in Analysis(own, P.Options.from_json(o or "null")).reports().collect()}
    assert got == want and len({r[2] for r in got.values()}) > 1
    with pytest.raises(Exception, match="options must be a JSON object"):
        Analysis(both.withColumn("options", F.lit("[1")), F.col("options")).scores().collect()


@pytest.mark.parametrize(
    "url, expected",
    [
        ("http://127.0.0.1:80:90/", "not an absolute url"), ("http://a.b:99999/", "not an absolute url"), ("http://a.b:65536/", "not an absolute url"), ("http://a.b:x1/", "not an absolute url"), ("http://a.b:8o/", "not an absolute url"),
        ("http://a.b:65535/", None), ("http://a.b:/", None), ("http://a.b:00080/", None), ("http://[::1]:80:90/", "not an absolute url"), ("http://[::1]x/", "not an absolute url"), ("http://a b.c/", "not an absolute url"),
        ("http://a_b.example.org/", None), ("http://münchen.example/", None), ("http://a,b.org/", "not an absolute url"), ("http://a[b].org/", "not an absolute url"), ("http://u@127.0.0.1:80/", "carries credentials"), ("http://@127.0.0.1:80/", "loopback address"),
        ("http://a.b:99999999999999999999/", "not an absolute url"),
    ],
)
def test_odd_authorities(spark, url, expected):
    assert docs(spark, url).select(T.url_refusal(F.col("text"))).first()[0] == expected


def test_large_lexicon_in_the_plan(spark):
    """A lexicon of thousands of phrases flags what the few do."""
    more = P.Options.from_json(json.dumps({"filler": [f"phrase number {i} of many" for i in range(3000)]}))
    text = "Needless to say, phrase number 2999 of many goes without saying."
    assert Analysis(docs(spark, text), more).density.first().filler_hits == ["needless to say", "phrase number 2999 of many"]
