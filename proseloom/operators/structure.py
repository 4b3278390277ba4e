"""Blocks, sentences, citations and DOIs of documents (doc_id, text). Offsets count code points. Null texts have none.

Nothing here looks beyond its own row: each function of a Column turns a text into an array of structs, with running
offsets by ``aggregate``, and the relations below explode those arrays, each computed once. So documents are parsed where
they are read, without a shuffle, and rows with equal or null ids stay apart. All of it is linear in the length of a text:
folds keep numbers only, matches are looked for from the end of the one before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseloom.functions import patterns as P
from proseloom.functions import text as T
from proseloom.functions.text import let, once

BLOCK = "block_index int, kind string, start_line int, end_line int, start_char int, end_char int, text string, heading_level int, heading string, is_prose boolean"
SENTENCE = "sent_index int, text string, start_char int, end_char int, start_line int, end_line int"
SPAN = "value string, start_char int, end_char int"


def feeds(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\n")), F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).otherwise(0)


def _none(schema: str) -> Column:
    return F.array().cast(f"array<struct<{', '.join(c.replace(' ', ': ', 1) for c in schema.split(', '))}>>")


#: Items of one inner fold.
CHUNK = 128


def _running(items: Column, start: dict[str, Column], step: Callable[[Column, Column], dict[str, Column]], make: Callable[[Column, Column, Column], Column], counts: Callable[[Column], Column] | None = None) -> Column:
    """What ``make`` gives of the state before each item, the item, and all items; for those that count. ``step`` is the
    state after an item, a few numbers, which starts as ``start``. A fold copies its state with each step, so no array in
    it may grow with the items: one fold finds the state before each chunk, and one in each chunk those within."""
    after = lambda s, x: F.struct(*[c.alias(n) for n, c in step(s, x).items()])
    first = F.struct(*[c.alias(n) for n, c in start.items()])
    none = F.filter(F.array(first), lambda _: F.lit(False))

    def listed(chunk: Column, at: Column) -> Column:
        """The state before each item of a chunk that is entered with ``at``."""
        return F.aggregate(chunk, F.struct(at.alias("now"), none.alias("out")), lambda s, x: F.struct(after(s["now"], x).alias("now"), F.array_append(s["out"], s["now"]).alias("out")), lambda s: s["out"])

    def entries(chunks: Column) -> Column:
        """The state before each chunk."""
        return F.aggregate(chunks, F.struct(first.alias("now"), none.alias("out")), lambda s, c: F.struct(F.aggregate(c, s["now"], after).alias("now"), F.array_append(s["out"], s["now"]).alias("out")), lambda s: s["out"])

    def over(all_: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size(all_) / CHUNK) - 1), lambda c: F.slice(all_, (c * CHUNK + 1).cast("int"), CHUNK))
        long = let(cut, lambda chunks: let(entries(chunks), lambda at: F.flatten(F.transform(chunks, lambda c, i: listed(c, F.get(at, i))))))
        states = F.when(F.size(all_) > CHUNK, long).otherwise(listed(all_, first))
        one = lambda s, x: make(s, x, all_) if counts is None else F.when(counts(x), make(s, x, all_))
        made = let(states, lambda s: F.transform(all_, lambda x, i: one(F.get(s, i), x)))
        return made if counts is None else F.filter(made, lambda m: m.isNotNull())

    return let(items, over)


def _located(parts: Column, items: Column, at: Callable[[Column, Column], Column], make: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """make(item, i, characters, line feeds) of items, with the size of the parts of a text before part ``at(item, i)``.
    Few parts are joined for each item; of many, a fold finds where each starts."""

    def far(starts: Column) -> Column:
        return F.transform(items, lambda x, i: let(F.get(starts, at(x, i)), lambda s: make(x, i, s["char"], s["line"])))

    def near(x: Column, i: Column) -> Column:
        return let(F.array_join(F.slice(parts, F.lit(1), at(x, i)), ""), lambda before: make(x, i, F.length(before), feeds(before)))

    zero = {"char": F.lit(0), "line": F.lit(0)}
    starts = _running(parts, zero, lambda s, p: {"char": s["char"] + F.length(p), "line": s["line"] + feeds(p)}, lambda s, _, __: F.struct(s["char"].alias("char"), s["line"].alias("line")))
    return F.when(F.size(parts) > CHUNK, let(starts, far)).otherwise(F.transform(items, near))


#: What may start a block other than a paragraph.
_MARKED = r"^(?:```|~~~|[#>*+-]|\d)"


def _kind(flat: Column) -> Column:
    marked = (
        F.when(flat.rlike("^(```|~~~)"), "CodeFence").when(flat.rlike(r"^#{1,6}( |\s*$)"), "Heading").when(flat.startswith(">"), "BlockQuote")
        .when(flat.rlike(r"^([-*+] |\d+[.)] )"), "ListItem").otherwise("Paragraph")
    )
    return F.when(flat.rlike(_MARKED), marked).otherwise("Paragraph")


def _shape(p: Column) -> Column:
    """kind (null: blank) of a piece of the text, and the characters of the blank lines before its block."""

    def shaped(flat: Column) -> Column:
        white = F.left(p, F.length(p) - F.length(flat))
        lead = F.when(F.contains(white, F.lit("\n")), F.length(white) - F.length(F.substring_index(white, "\n", -1))).otherwise(0)
        return F.struct(F.when(flat != "", _kind(flat)).alias("kind"), lead.alias("lead"))

    return let(F.ltrim(p, F.lit(P.SPACE)), shaped)


def _without(text: Column, end: str) -> Column:
    """Without one such character at its end."""
    return F.when(text.endswith(end), F.left(text, F.length(text) - 1)).otherwise(text)


def _is_prose(kind: Column) -> Column:
    """Comparisons: within a fold, ``isin`` of a few values takes many times as long."""
    return (kind == "Paragraph") | (kind == "ListItem")


def _title(p: Column) -> Column:
    return F.ltrim(F.ltrim(p, F.lit(P.SPACE)), F.lit("#"))


def blocks_of(text: Column, bare: bool = False, prose: bool = False) -> Column:
    """array<struct<BLOCK>> of a text; ``bare``: one that can't have a byte-order mark; ``prose``: its prose blocks."""
    plain = text if bare else F.when(text.startswith("\ufeff"), F.substring(text, F.lit(2), F.length(text))).otherwise(text)

    def block(p: Column, i: Column, h: Column, char: Column, line: Column, heading: Column) -> Column:
        own = F.when(h["lead"] == 0, p).otherwise(F.substring(p, h["lead"] + 1, F.length(p)))
        # No phantom last line in an open fence; one carriage return before the line end is not text.
        kept = _without(F.when(h["kind"] == "CodeFence", _without(own, "\n")).otherwise(own), "\r")
        place = F.struct(kept.alias("text"), (char + h["lead"]).alias("char"), (line + 1 + F.when(h["lead"] == 0, 0).otherwise(feeds(F.left(p, h["lead"])))).alias("line"))
        is_prose = _is_prose(h["kind"])
        return let(place, lambda s: F.struct(
            i.alias("block_index"), h["kind"].alias("kind"), s["line"].alias("start_line"), (s["line"] + feeds(s["text"])).alias("end_line"), s["char"].alias("start_char"), (s["char"] + F.length(s["text"])).alias("end_char"), s["text"].alias("text"),
            F.when(h["kind"] == "Heading", F.length(F.ltrim(p, F.lit(P.SPACE))) - F.length(_title(p))).otherwise(0).alias("heading_level"), F.when(is_prose | (h["kind"] == "BlockQuote"), heading).alias("heading"), is_prose.alias("is_prose"),
        ))

    def over(pieces: Column) -> Column:
        def made(shapes: Column) -> Column:
            def under(above: Column) -> Column:
                def one(p: Column, i: Column, char: Column, line: Column) -> Column:
                    h = F.get(shapes, i)
                    return F.when(_is_prose(h["kind"]) if prose else h["kind"].isNotNull(), block(p, i, h, char, line, T.trimmed(_title(F.get(pieces, F.get(above, i))))))

                # Only the last piece may be blank, so places of pieces are those of blocks.
                return F.filter(_located(pieces, pieces, lambda _, i: i, one), lambda m: m.isNotNull())

            marks = F.transform(shapes, lambda h, i: F.when(h["kind"] == "Heading", i))
            far = lambda m: _running(m, {"at": F.lit(None).cast("int")}, lambda s, x: {"at": F.coalesce(x, s["at"])}, lambda s, _, __: s["at"])
            return let(let(marks, lambda m: F.when(F.size(m) > CHUNK, far(m)).otherwise(F.transform(m, lambda _, i: F.array_max(F.slice(m, F.lit(1), i))))), under)

        return let(F.transform(pieces, _shape), made)

    return let(let(plain, lambda t: T.either(t, lambda form: F.regexp_extract_all(t, F.lit(form(P.PIECES)), 0))), over)


def parts_of(text: Column) -> Column:
    """A block cut into sentences with the white space around them; only the last may be nothing but that."""
    return T.either(text, lambda form: F.regexp_extract_all(text, F.lit(form(P.SENTENCES)), 0))


def span_of(part: Column, char: Column, line: Column) -> dict[str, Column]:
    """Where the sentence of a part is, which starts at an offset in a line."""
    own = F.ltrim(part, F.lit(P.SPACE))
    text = F.rtrim(own, F.lit(P.SPACE))
    at, first = char + F.length(part) - F.length(own), line + feeds(part) - feeds(own)
    return {"start_char": at, "end_char": at + F.length(text), "start_line": first, "end_line": first + feeds(text)}


def sentences_of(text: Column, base: Column, line: Column) -> Column:
    """array<struct<SENTENCE>> of a block that starts at offset ``base`` in ``line``."""

    def sentence(part: Column, i: Column, char: Column, feeds_: Column) -> Column:
        at = span_of(part, base.cast("int") + char, line.cast("int") + feeds_)
        return F.struct(i.alias("sent_index"), T.trimmed(part).alias("text"), *[at[c].alias(c) for c in ("start_char", "end_char", "start_line", "end_line")])

    return F.filter(let(parts_of(text), lambda parts: _located(parts, parts, lambda _, i: i, sentence)), lambda s: s["text"] != "")


def spans_of(text: Column, base: Column, pattern: str, group: int, trim: str, sure: str) -> Column:
    """array<struct<SPAN>> of the matches in a block; each match contains the text ``sure``. A match is taken with the gap
    before it and starts where the one before ended (\\G), so the text after the last match is looked at once."""
    gap = lambda form: form(pattern.replace("(?Ui)", r"(?sUi)\G.*?(?:", 1) + ")")

    def shaped(form: Callable[[str], str]) -> Column:
        cut = F.regexp_extract_all(text, F.lit(gap(form)), 0)
        return F.transform(cut, lambda p: F.struct(F.length(p).alias("size"), F.regexp_extract(p, form(pattern), 0).alias("all"), F.regexp_extract(p, form(pattern), group).alias("value")))

    def span(s: Column, m: Column, _: Column) -> Column:
        end, cut = s["char"] + m["size"], F.rtrim(m["value"], F.lit(trim))
        return F.struct(cut.alias("value"), (end - F.length(m["all"])).alias("start_char"), (end - F.length(m["value"]) + F.length(cut)).alias("end_char"))

    found = _running(T.either(text, shaped), {"char": base.cast("int")}, lambda s, m: {"char": s["char"] + m["size"]}, span)
    return F.when(text.contains(sure), found).otherwise(_none(SPAN))


def line_of(text: Column, offset: Column) -> Column:
    """1 + line feeds before an offset of a text."""
    return 1 + feeds(F.substring(text, F.lit(1), offset))


def rows(df: DataFrame, column: Column, *keep: str) -> DataFrame:
    """The structs of an array column as rows, after the columns to keep. The generator is an outer one, for which the
    optimizer doesn't repeat the array in a filter below it."""
    return df.select(*keep, F.explode_outer(column).alias("one_")).where("one_ is not null").select(*keep, "one_.*")


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, block_index, kind, start_line, end_line, start_char, end_char, text, heading_level, heading, is_prose."""
    return rows(docs, parsed(), "doc_id")


def parsed() -> Column:
    """`blocks_of` the column text."""
    return once("blocks", lambda: blocks_of(F.col("text")))


def prose_parsed() -> Column:
    """The prose blocks of the column text."""
    return once("prose blocks", lambda: blocks_of(F.col("text"), prose=True))


def prose(block_rows: DataFrame) -> DataFrame:
    return block_rows.where("is_prose")


def sentences(block_rows: DataFrame) -> DataFrame:
    """Of the given blocks: doc_id, block_index, sent_index, text, start_char, end_char (in the document)."""
    each = rows(block_rows, once("sentences", lambda: sentences_of(F.col("text"), F.col("start_char"), F.col("start_line"))), "doc_id", "block_index")
    return each.select("doc_id", "block_index", "sent_index", "text", "start_char", "end_char")


URLS = (P.URL, 0, ".,;:!?'\"", "://")
DOIS = (P.DOI, 1, ".,;:!?'\")]}", "10.")


def found(kind: tuple) -> Column:
    """`spans_of` the columns text and start_char."""
    return once(kind, lambda: spans_of(F.col("text"), F.col("start_char"), *kind))


def _found(block_rows: DataFrame, name: str, kind: tuple) -> DataFrame:
    return rows(block_rows.where("kind <> 'CodeFence'"), found(kind), "doc_id", "block_index").withColumnRenamed("value", name)


def citations(block_rows: DataFrame) -> DataFrame:
    """doc_id, block_index, url, start_char, end_char; repeats kept."""
    return _found(block_rows, "url", URLS)


def dois(block_rows: DataFrame) -> DataFrame:
    """doc_id, block_index, doi (lower-cased), start_char, end_char; the span includes a resolver or doi: prefix."""
    return _found(block_rows, "doi", DOIS).withColumn("doi", F.lower("doi"))


def distinct_dois_of(blocks_: Column) -> Column:
    """array<struct<doi, place>> of a document's blocks: each once, in order of first appearance."""
    each = F.flatten(F.transform(F.filter(blocks_, lambda b: b["kind"] != "CodeFence"), lambda b: F.transform(spans_of(b["text"], b["start_char"], *DOIS), lambda s: F.lower(s["value"]))))
    return F.transform(F.array_distinct(each), lambda d, i: F.struct(d.alias("doi"), (i + 1).alias("place")))


def distinct_dois(docs: DataFrame) -> DataFrame:
    """doc_id, doi, place of documents."""
    return rows(docs.select("doc_id", parsed().alias("blocks")), once("distinct dois", lambda: distinct_dois_of(F.col("blocks"))), "doc_id")
