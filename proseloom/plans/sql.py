"""The engine as Spark SQL functions: after `register`, SQL text alone parses, scores and extracts.

Functions take a text (or a URL). Those that give rows give an array of structs; Spark wants it named before a generator:
``SELECT doc_id, b.* FROM (SELECT doc_id, prose_blocks(text) AS a FROM documents) LATERAL VIEW OUTER explode(a) AS b``.
`prose_score` gives one struct: ``SELECT doc_id, s.* FROM (SELECT doc_id, prose_score(text) AS s FROM documents)``.
Their bodies are the SQL of the expressions that the plans use: no Python, no shuffle."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from proseloom.functions import text as T
from proseloom.functions.patterns import Options
from proseloom.operators import scoring, structure
from proseloom.plans import analyze

_LITERAL = re.compile(r"('(?:[^'\\]|\\.)*')", re.S)
_OPERATOR = re.compile(r"(?<![\w`.'])(and|or|not|in|[!=<>+\-*/%&|^~]+)\(")


def sql_of(column: Column) -> str:
    """The SQL text of a column. Operators come as functions of that name, which SQL wants quoted."""
    said = repr(column).removeprefix("Column<'").removesuffix("'>")
    return "".join(part if i % 2 else _OPERATOR.sub(r"`\1`(", part) for i, part in enumerate(_LITERAL.split(said)))


def _with(name: str, value: str, body: str) -> str:
    """body, in which ``name`` is the value, computed once: SQL's lambdas are the only names within an expression."""
    return f"aggregate(CAST(array() AS ARRAY<INT>), {value}, (same, _) -> same, {name} -> {body})"


def _only(structs: str, names: list[str]) -> str:
    """The structs of an array with some of their fields."""
    fields = ", ".join(f"'{n}', x.{n}" for n in names)
    return f"transform({structs}, x -> named_struct({fields}))"


def _spans(blocks: str, kind: tuple, name: str, value: str) -> str:
    """What is found in blocks other than fences: block_index, the value under a name, start_char, end_char."""
    each = f"transform({sql_of(structure.found(kind))}, s -> named_struct('block_index', b.block_index, '{name}', {value}, 'start_char', s.start_char, 'end_char', s.end_char))"
    return f"flatten(transform(filter({blocks}, b -> b.kind <> 'CodeFence'), b -> {_with('text', 'b.text', _with('start_char', 'b.start_char', each))}))"


def expressions(options: Options) -> dict[str, tuple[str, str]]:
    """name: parameter, SQL expression of it."""
    t, u = F.col("text"), F.col("url")
    blocks, density = sql_of(structure.parsed()), sql_of(scoring.densities(options))
    of_prose = lambda body: _with("prose", sql_of(structure.prose_parsed()), body)
    judged = lambda places: (analyze.judged(places), analyze.padded(options, places))
    score = sql_of(F.lit(options.grounding_weight) * F.col("gap") + F.lit(options.density_weight) * F.col("rate"))
    band = sql_of(T.band(F.col("score"), options))
    bare, flagged = judged(False)
    summed = _with("gap", sql_of(analyze.gap(bare)), _with("rate", sql_of(analyze.rate(flagged)), _with("score", score, f"named_struct('gap', gap, 'rate', rate, 'score', score, 'band', {band})")))
    found, claims = _only(sql_of(analyze.sorted_findings(*judged(True))), analyze.FINDING), _only(sql_of(analyze.every_claim()), scoring.CLAIM)
    return {
        "prose_tokens": ("text", sql_of(T.tokens(t))), "claim_kinds": ("text", sql_of(T.claim_kinds(t))), "source_signal": ("text", sql_of(T.source_signal(t))), "self_reported": ("text", sql_of(T.self_reported(t))),
        "concrete_fact": ("text", sql_of(T.concrete_fact(t))), "filler_hits": ("text", sql_of(T.filler_hits(t, options.filler))), "url_refusal": ("url", sql_of(T.url_refusal(u))),
        "prose_blocks": ("text", blocks), "prose_claims": ("text", of_prose(claims)), "prose_density": ("text", of_prose(density)), "prose_findings": ("text", of_prose(found)), "prose_score": ("text", of_prose(summed)),
        "prose_citations": ("text", _spans(blocks, structure.URLS, "url", "s.value")), "prose_dois": ("text", _spans(blocks, structure.DOIS, "doi", "lower(s.value)")),
    }


def register(spark: SparkSession, options: Options | None = None, prefix: str = "", names: list[str] | None = None) -> list[str]:
    """Creates the functions (those named, else all), with the given options, for the session; their names, each with the
    prefix."""
    made = expressions(options or Options())
    for name in names or made:
        parameter, body = made[name]
        kind = spark.sql(f"SELECT {body} AS made FROM (SELECT CAST(NULL AS STRING) AS {parameter})").schema["made"].dataType.simpleString()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameter} STRING) RETURNS {kind} RETURN {body}")
    return [prefix + n for n in names or made]
