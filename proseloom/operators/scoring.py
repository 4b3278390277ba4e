"""Grounding, density, findings, scores and bands, each of one row's blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseloom.functions import text as T
from proseloom.functions.patterns import Options
from proseloom.functions.text import let, once
from proseloom.operators import structure

CLAIM = ["block_index", "sent_index", "text", "start_char", "end_char", "kinds", "grounded", "reason"]


def claims_of(block: Column) -> Column:
    """Claims of a block with grounded and reason: own source signal, else the preceding, else the following sentence."""

    def judged(parts: Column, texts: Column) -> Column:
        near = lambda j, words: F.concat(F.lit(words), T.source_signal(F.get(texts, j)))
        every = F.transform(texts, lambda t, i: F.struct(i.alias("i"), T.claim_kinds(t).alias("kinds")))
        some = F.filter(every, lambda c: (F.size(c["kinds"]) > 0) & ~T.self_reported(F.get(texts, c["i"])))
        # Signals are looked for only beside claims, and no further than the first.
        why = lambda i: F.coalesce(T.source_signal(F.get(texts, i)), near(i - 1, "preceding sentence "), near(i + 1, "following sentence "))
        told = F.transform(some, lambda c: let(why(c["i"]), lambda w: F.struct(c["i"].alias("i"), c["kinds"].alias("kinds"), w.isNotNull().alias("grounded"), F.coalesce(w, F.lit("no source signal near the claim")).alias("reason"))))

        def one(c: Column, _: Column, char: Column, feeds: Column) -> Column:
            at = structure.span_of(F.get(parts, c["i"]), block["start_char"].cast("int") + char, block["start_line"].cast("int") + feeds)
            return F.struct(
                block["block_index"].alias("block_index"), c["i"].alias("sent_index"), F.get(texts, c["i"]).alias("text"), *[at[n].alias(n) for n in ("start_char", "end_char", "start_line", "end_line")],
                c["kinds"].alias("kinds"), c["grounded"].alias("grounded"), c["reason"].alias("reason"),
            )

        return let(told, lambda t: structure._located(parts, t, lambda c, _: c["i"], one))

    return let(structure.parts_of(block["text"]), lambda parts: let(F.transform(parts, T.trimmed), lambda texts: judged(parts, texts)))


def bare_of(block: Column, make: Callable[[Column, dict[str, Column]], Column] | None = None) -> Column:
    """struct<total, bare>: how many claims `claims_of` has, and those not grounded, as make(block, where it is), else as
    places among the block's sentences. What grounds the others is not told."""

    def judged(parts: Column, texts: Column) -> Column:
        near = lambda i: T.sourced(F.get(texts, i))
        grounded = lambda t, i: T.sourced(t) | near(i - 1) | near(i + 1)
        verdict = lambda t, i: F.when(T.makes_claim(t) & ~T.self_reported(t), F.when(grounded(t, i), -1).otherwise(i))

        def counted(all_: Column) -> Column:
            bare = F.filter(all_, lambda i: i >= 0)
            one = lambda i, _, char, feeds: make(block, structure.span_of(F.get(parts, i), block["start_char"].cast("int") + char, block["start_line"].cast("int") + feeds))
            placed = bare if make is None else let(bare, lambda b: structure._located(parts, b, lambda i, _: i, one))
            return F.struct(F.size(all_).alias("total"), placed.alias("bare"))

        return let(F.array_compact(F.transform(texts, verdict)), counted)

    return let(structure.parts_of(block["text"]), lambda parts: let(F.transform(parts, T.trimmed), lambda texts: judged(parts, texts)))


def grounding(prose_rows: DataFrame) -> DataFrame:
    """doc_id and CLAIM of prose blocks."""
    claims = once("claims of a block", lambda: claims_of(F.struct("block_index", "text", "start_char", "start_line")))
    return structure.rows(prose_rows, claims, "doc_id").select("doc_id", *CLAIM)


def grounding_gap(claims: DataFrame, docs: DataFrame, keys: list[str], min_claims: int = 3) -> DataFrame:
    """Per key of docs: total, ungrounded, gap, low_reliability; keys without claims count 0, 0, 0.0, true."""
    sums = claims.groupBy(*keys).agg(F.count("*").alias("total"), F.sum((~F.col("grounded")).cast("long")).alias("ungrounded"))
    every = docs.select(*keys).distinct().join(sums, keys, "left").fillna(0, ["total", "ungrounded"])
    return every.select(*keys, "total", "ungrounded", F.when(F.col("total") == 0, 0.0).otherwise(F.col("ungrounded") / F.col("total")).alias("gap"), (F.col("total") < min_claims).alias("low_reliability"))


#: Up to so many sets, each is held against all before it.
FEW_SETS = 16


def novel_counts(sets: Column) -> Column:
    """array<int>: how many tokens of each set no set before it has. Of many sets, one sorted array of (token, set): the
    first of a run of equal tokens is where a token is new. Those places, sorted among one mark for each set, are runs whose
    lengths count."""

    def firsts(pairs: Column) -> Column:
        new = F.filter(pairs, lambda e, j: (j == 0) | (F.get(pairs, j - 1)["token"] != e["token"]))
        return F.sort_array(F.concat(F.transform(new, lambda e: e["at"]), F.transform(sets, lambda _, i: i)))

    def counts(places: Column) -> Column:
        edges = F.filter(F.transform(places, lambda p, j: F.when((j == 0) | (F.get(places, j - 1) != p), j)), lambda j: j.isNotNull())
        return let(edges, lambda e: F.transform(e, lambda start, i: F.coalesce(F.get(e, i + 1), F.size(places)) - start - 1))

    pairs = F.flatten(F.transform(sets, lambda tokens, i: F.transform(tokens, lambda t: F.struct(t.alias("token"), i.alias("at")))))
    few = F.transform(sets, lambda tokens, i: F.when(i == 0, F.size(tokens)).otherwise(F.size(F.array_except(tokens, F.flatten(F.slice(sets, F.lit(1), i))))))
    return F.when(F.size(sets) <= FEW_SETS, few).otherwise(let(let(F.sort_array(pairs), firsts), counts))


def density_of(prose: Column, options: Options) -> Column:
    """Of a document's prose blocks: where they are, heading_overlap, prev_overlap, novel_ratio, filler_hits, flagged,
    fact_override. novel_ratio is the share of a block's distinct tokens that no earlier prose block has."""

    def one(b: Column, own: Column, before: Column, ratio: Column) -> Column:
        def flags(h: Column) -> Column:
            padded = _restates(h["ratio"], h["heading"], h["before"], options) | (F.size(h["hits"]) >= options.min_filler_hits)
            return let(F.struct(padded.alias("padded"), (padded & T.concrete_fact(b["text"])).alias("fact")), lambda f: F.struct(
                *[b[c].alias(c) for c in ("block_index", "start_line", "end_line", "start_char", "end_char", "text")], h["heading"].alias("heading_overlap"), h["before"].alias("prev_overlap"),
                h["ratio"].alias("novel_ratio"), h["hits"].alias("filler_hits"), f["fact"].alias("fact_override"), (f["padded"] & ~f["fact"]).alias("flagged"),
            ))

        return let(F.struct(_of_heading(b, own).alias("heading"), T.jaccard(own, before).alias("before"), ratio.alias("ratio"), T.filler_hits(b["text"], options.filler).alias("hits")), flags)

    return _by_block(prose, one)


def _words(text: Column) -> Column:
    return F.array_distinct(T.tokens(text))


def _of_heading(b: Column, own: Column) -> Column:
    return let(_words(F.coalesce(b["heading"], F.lit(""))), lambda head: T.jaccard(own, head))


def _restates(ratio: Column, heading: Column, before: Column, o: Options) -> Column:
    return (ratio <= o.low_novelty) & ((heading >= o.high_overlap) | (before >= o.high_overlap))


def _by_block(prose: Column, one: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """one(block, its tokens, those of the block before it (null: none), novel_ratio) of prose blocks."""

    def scored(s: Column) -> Column:
        ratio = lambda own, new: F.when(F.size(own) == 0, 0.0).otherwise(new / F.size(own))
        return let(novel_counts(s), lambda n: F.transform(prose, lambda b, i: one(b, F.get(s, i), F.get(s, i - 1), ratio(F.get(s, i), F.get(n, i)))))

    return let(F.transform(prose, lambda b: _words(b["text"])), scored)


def flagged_of(prose: Column, options: Options, make: Callable[[Column, Column], Column]) -> Column:
    """make(block, filler hits) of those prose blocks that `density_of` flags. Overlaps and facts are looked at only where
    they decide."""

    def one(b: Column, own: Column, before: Column, ratio: Column) -> Column:
        def made(hits: Column) -> Column:
            padded = (F.size(hits) >= options.min_filler_hits) | _restates(ratio, _of_heading(b, own), T.jaccard(own, before), options)
            return F.when(padded & ~T.concrete_fact(b["text"]), make(b, hits))

        return let(T.filler_hits(b["text"], options.filler), made)

    return F.filter(_by_block(prose, one), lambda f: f.isNotNull())


def densities(options: Options) -> Column:
    """`density_of` the column prose."""
    make = lambda: density_of(F.col("prose"), options)
    return make() if isinstance(options.high_overlap, Column) else once(("density", repr(options)), make)


def density(docs: DataFrame, options: Options | None = None) -> DataFrame:
    """doc_id and `density_of` of documents, a row for each prose block."""
    found = docs.select("doc_id", structure.prose_parsed().alias("prose"))
    return structure.rows(found, densities(options or Options()), "doc_id")
