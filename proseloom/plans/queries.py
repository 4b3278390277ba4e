"""The registered queries of the prose-integrity engine, each with SQL for its result.

``notes`` are markdown documents derived from every order: a heading, a paragraph of two sentences, a second paragraph
that pads, restates or reports, a list item, a quote and a fence. Their texts are built by the same expressions in both
engines; the SQL takes blocks and sentences from the construction. ``document_scores`` and ``conversation_reports`` run
over whole texts of the tables, where the SQL splits lines and sentences itself. Patterns that decide results are those
of `functions.patterns`, rewritten for an engine without look-arounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseloom.functions import patterns as P
from proseloom.functions import text as T
from proseloom.operators import scoring, segments, structure
from proseloom.plans import sql
from proseloom.plans.analyze import Analysis, evaluation, outcomes

_PARTS = {
    "title": "'Order ' || CAST(k AS STRING) || ' notes'",
    "s1": "CASE k % 6 WHEN 0 THEN 'Sales increased by ' || CAST(k % 90 + 10 AS STRING) || '% this year.' WHEN 1 THEN 'The total was 1200 units because demand rose.' "
    "WHEN 2 THEN 'Teams were faster than before.' WHEN 3 THEN 'Studies show the plan works.' WHEN 4 THEN 'The deploy ran at 14:08.' ELSE 'We met the crew.' END",
    "s2": "CASE CAST(floor(k / 6) AS BIGINT) % 6 WHEN 0 THEN 'See https://example.com/r/' || CAST(k % 7 AS STRING) || ' for details.' WHEN 1 THEN 'According to the dashboard it held.' "
    "WHEN 2 THEN 'It was noted[^1] in doi:10.1234/AB' || CAST(k % 5 AS STRING) || '.' WHEN 3 THEN 'Per the research it held.' WHEN 4 THEN 'The data is in the handover document.' ELSE 'Nothing else happened here.' END",
    "s3": "CASE CAST(floor(k / 36) AS BIGINT) % 4 WHEN 0 THEN 'Needless to say, it is important to note this.' WHEN 1 THEN 'Teams were faster than before.' WHEN 2 THEN 'Later Maria Lopez approved the plan.' ELSE 'Order notes again.' END",
}
_TEXT = "'# ' || title || chr(10) || chr(10) || s1 || ' ' || s2 || chr(10) || chr(10) || s3 || chr(10) || chr(10) || '- item ' || CAST(k AS STRING) || chr(10) || '> quoted 5% http://q.example.org/a' || chr(10) || chr(10) || '```' || chr(10) || 'code 7% http://x.example.org' || chr(10) || '```' || chr(10)"


def dealt(df: DataFrame) -> DataFrame:
    """df over all cores: a table of fewer partitions than that is small, and its parse takes longer than a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(2 * cores)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = dealt(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k")))
    return k.select("k", *[F.expr(e).alias(n) for n, e in _PARTS.items()]).select(F.col("k").alias("doc_id"), F.expr(_TEXT).alias("text"))


def _sql(text: str) -> str:
    return text.replace("STRING", "VARCHAR")


_VAGUE = r"[^.]{0,24}\b(experts?|studies|research|scientists?|sources?|analysts?|literature)\b"
_ATTRIBUTION = P.ATTRIBUTION.removeprefix("(?Ui)").removesuffix(P.VAGUE)
_re = lambda p: p.replace("(?Ui)", "(?i)").replace("(?U)", "").replace("'", "''")


def _plain(t: str) -> str:
    """Letters beyond ASCII as z: RE2 knows word bounds of ASCII only."""
    return f"regexp_replace({t}, '[À-ÖØ-öø-ɏ]', 'z', 'g')"


def _kinds(t: str) -> str:
    t = _plain(t)
    return "[x FOR x IN [" + ", ".join(f"CASE WHEN regexp_matches({t}, '{_re(p)}') THEN '{k}' END" for k, p in T.KINDS) + "] IF x IS NOT NULL]"


def _signal(t: str) -> str:
    t = _plain(t)
    m = lambda p: f"regexp_matches({t}, '{_re(p)}')"
    without = lambda head, tail: f"(regexp_matches({t}, '(?i){_re(head)}{_re(tail)}') AND NOT regexp_matches({t}, '(?i){_re(head)}{_VAGUE}'))"
    attributed = without(_ATTRIBUTION, "") + " OR " + without(*P.WITNESS.removeprefix("(?Ui)").split(P.VAGUE))
    return (
        f"CASE WHEN {m(P.LINK)} THEN 'carries a link or URL' WHEN {m(P.FOOTNOTE)} THEN 'carries a footnote marker' WHEN {m(P.INLINE_CITE)} THEN 'carries an inline citation' "
        f"WHEN {m(P.AUTHORITY)} THEN 'names an authority or study' WHEN {attributed} THEN 'attributes the claim to a named record' WHEN {m(P.LOCATION)} THEN 'says where the record can be found' END"
    )


_STOP = ", ".join(f"'{w}'" for w in P.STOPWORDS)
_FILLER = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in P.FILLER) + "]"


def _tokens(t: str) -> str:
    return f"list_transform(list_filter(regexp_extract_all(lower({t}), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP})), lambda w: regexp_replace(w, '^(.{{3,}}?)(?:ing|ed|es|s)$', '\\1'))"


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN coalesce(len({a}), 0) = 0 OR coalesce(len({b}), 0) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


def _proper(t: str) -> str:
    words = f"list_filter(string_split_regex({t}, '\\s+'), lambda x: x <> '')"
    return f"len(list_filter(range(2, len({words}) + 1), lambda i: regexp_matches(trim({words}[i], '.,;:!?()\"' || chr(39)), '^[A-Z][a-z]+') AND NOT regexp_matches({words}[i - 1], '[.!?]$'))) > 0"


_NOTES = _sql(
    "WITH base AS (SELECT o_orderkey AS k, " + ", ".join(f"{e} AS {n}" for n, e in _PARTS.items()).replace("k ", "o_orderkey ").replace("(k ", "(o_orderkey ") + " FROM orders), "
) + rf"""
cuts AS (SELECT *, length('# ' || title) AS a, length(s1 || ' ' || s2) AS b, length(s3) AS c, length('- item ' || k) AS d FROM base),
blocks AS (
  SELECT k AS doc_id, 0 AS block_index, 'Heading' AS kind, 1 AS start_line, 0 AS start_char, '# ' || title AS text, 1 AS heading_level, NULL AS heading FROM cuts
  UNION ALL SELECT k, 1, 'Paragraph', 3, a + 2, s1 || ' ' || s2, 0, title FROM cuts
  UNION ALL SELECT k, 2, 'Paragraph', 5, a + b + 4, s3, 0, title FROM cuts
  UNION ALL SELECT k, 3, 'ListItem', 7, a + b + c + 6, '- item ' || k, 0, title FROM cuts
  UNION ALL SELECT k, 4, 'BlockQuote', 8, a + b + c + d + 7, '> quoted 5% http://q.example.org/a', 0, title FROM cuts
  UNION ALL SELECT k, 5, 'CodeFence', 10, a + b + c + d + 43, '```' || chr(10) || 'code 7% http://x.example.org' || chr(10) || '```', 0, NULL FROM cuts),
sents AS (
  SELECT k AS doc_id, 1 AS block_index, 0 AS sent_index, s1 AS text, a + 2 AS start_char, 3 AS line FROM cuts
  UNION ALL SELECT k, 1, 1, s2, a + 3 + length(s1), 3 FROM cuts
  UNION ALL SELECT k, 2, 0, s3, a + b + 4, 5 FROM cuts
  UNION ALL SELECT k, 3, 0, '- item ' || k, a + b + c + 6, 7 FROM cuts),"""
_TAIL = rf"""
signals AS (SELECT *, {_signal('text')} AS own, {_kinds('text')} AS kinds FROM sents),
near AS (SELECT *, coalesce(own, 'preceding sentence ' || lag(own) OVER w, 'following sentence ' || lead(own) OVER w) AS why FROM signals WINDOW w AS (PARTITION BY doc_id, block_index ORDER BY sent_index)),
claims AS (
  SELECT doc_id, block_index, sent_index, text, start_char, start_char + length(text) AS end_char, line, kinds, why IS NOT NULL AS grounded, coalesce(why, 'no source signal near the claim') AS reason
  FROM near WHERE len(kinds) > 0 AND NOT (regexp_matches(text, '{_re(P.CLOCK)}') AND len({_kinds("regexp_replace(text, '" + _re(P.CLOCK) + "', ' ', 'g')")}) = 0)),
sets AS (SELECT *, list_distinct({_tokens('text')}) AS own, list_distinct({_tokens("heading")}) AS head FROM blocks WHERE kind IN ('Paragraph', 'ListItem')),
words AS (SELECT doc_id, block_index, unnest(own) AS token FROM sets),
novel AS (SELECT doc_id, block_index, avg(CASE WHEN f = block_index THEN 1.0 ELSE 0.0 END) AS novel_ratio FROM (SELECT *, min(block_index) OVER (PARTITION BY doc_id, token) AS f FROM words) GROUP BY ALL),
dens AS (
  SELECT s.*, {_jaccard('own', 'head')} AS heading_overlap, {_jaccard('own', 'prev')} AS prev_overlap, coalesce(novel_ratio, 0.0) AS novel_ratio, list_filter({_FILLER}, lambda p: contains(lower(text), p)) AS hits
  FROM (SELECT *, lag(own) OVER (PARTITION BY doc_id ORDER BY block_index) AS prev FROM sets) s LEFT JOIN novel USING (doc_id, block_index)),
padded AS (SELECT *, (greatest(heading_overlap, prev_overlap) >= 0.5 AND novel_ratio <= 0.35) OR len(hits) >= 2 AS pad,
  regexp_matches(text, '{_re(P.NUMBER)}') OR regexp_matches(text, '{_re(P.DATE)}') OR {_proper('text')} AS fact FROM dens),
flags AS (SELECT *, pad AND NOT fact AS flagged, pad AND fact AS fact_override FROM padded),
findings AS (
  SELECT doc_id, 'GROUND001' AS rule_id, 'Warning' AS severity, block_index, line AS start_line, line AS end_line, start_char, end_char, 'specific claim: ' || reason AS message FROM claims WHERE NOT grounded
  UNION ALL SELECT doc_id, CASE WHEN len(hits) > 0 THEN 'FILLER001' ELSE 'DENSITY001' END, 'Info', block_index, start_line, start_line, start_char, start_char + length(text),
    CASE WHEN len(hits) > 0 THEN 'filler phrasing: ' || array_to_string(hits, ', ') ELSE 'restates prior content with little novel detail' END FROM flags WHERE flagged),
scores AS (
  SELECT k AS doc_id, coalesce(gap, 0.0) AS gap, coalesce(rate, 0.0) AS rate, 0.6 * coalesce(gap, 0.0) + 0.4 * coalesce(rate, 0.0) AS score
  FROM base LEFT JOIN (SELECT doc_id AS k, avg(CASE WHEN grounded THEN 0.0 ELSE 1.0 END) AS gap FROM claims GROUP BY 1) USING (k)
  LEFT JOIN (SELECT doc_id AS k, avg(CASE WHEN flagged THEN 1.0 ELSE 0.0 END) AS rate FROM flags GROUP BY 1) USING (k)),
banded AS (SELECT doc_id, round(gap, 6) AS gap, round(rate, 6) AS rate, round(score, 6) AS score, CASE WHEN score >= 0.5 THEN 'Slop' WHEN score >= 0.2 THEN 'Watch' ELSE 'Clean' END AS band FROM scores)"""
_LABELS = """,
cases AS (SELECT doc_id, ['Clean', 'Watch', 'Slop'][CAST(doc_id % 3 AS INTEGER) + 1] AS want_band, CASE doc_id % 4 WHEN 0 THEN ['GROUND001'] WHEN 1 THEN ['FILLER001'] ELSE [] END AS rules FROM banded),
fired AS (SELECT DISTINCT doc_id, rule_id FROM findings),
grid AS (SELECT c.doc_id, r.rule, list_contains(c.rules, r.rule) AS want, f.rule_id IS NOT NULL AS got FROM cases c CROSS JOIN (SELECT unnest(['GROUND001', 'DENSITY001', 'FILLER001']) AS rule) r LEFT JOIN fired f ON f.doc_id = c.doc_id AND f.rule_id = r.rule)
"""

_CTE = _NOTES + _TAIL + _LABELS

# Documents whose lines are paragraphs. Dots that end no sentence are hidden (\x02) one level of an acronym at a time, then
# the ends of sentences are marked (\x01) and texts are split there.
_HIDDEN = "regexp_replace(text, '(^|\\s)((?i:" + "|".join(P.ABBREVIATIONS) + "))\\.', '\\1\\2' || chr(2), 'g')"
for _ in range(6):
    _HIDDEN = f"regexp_replace({_HIDDEN}, '(^|\\s)((?:[a-zA-Z]\\x02)*[a-zA-Z])\\.', '\\1\\2' || chr(2), 'g')"
_LINES = f"""WITH base AS (SELECT doc_id AS k, coalesce(text, '') AS text FROM documents),
lines AS (SELECT k AS doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM base),
blocks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS block_index, 'Paragraph' AS kind, 2 * line + 1 AS start_line, 0 AS start_char, text, 0 AS heading_level, NULL::VARCHAR AS heading FROM lines WHERE regexp_matches(text, '\\S')),
marked AS (SELECT doc_id, block_index, start_line, string_split(regexp_replace({_HIDDEN}, '([.!?])(\\s*)(\\p{{Lu}})', '\\1' || chr(1) || '\\2\\3', 'g'), chr(1)) AS parts FROM blocks),
sents AS (SELECT doc_id, block_index, sent_index, trim(replace(part, chr(2), '.')) AS text, 0 AS start_char, start_line AS line FROM (SELECT *, unnest(parts) AS part, unnest(range(0, len(parts))) AS sent_index FROM marked)),
"""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None, cte: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (_CTE if cte else "") + sql
        return f

    return add


@query("SELECT doc_id, gap, rate, score, band FROM banded")
def doc_scores(spark, sf_dir):
    s = Analysis(notes(spark, sf_dir)).scores()
    return s.select("doc_id", *[F.round(c, 6).alias(c) for c in ("gap", "rate", "score")], "band")


@query("SELECT band, count(*) AS n FROM banded GROUP BY band")
def band_histogram(spark, sf_dir):
    return Analysis(notes(spark, sf_dir)).scores().groupBy("band").agg(F.count("*").alias("n"))


@query("SELECT * FROM findings")
def findings(spark, sf_dir):
    return Analysis(notes(spark, sf_dir)).findings()


@query("SELECT doc_id, block_index, kind, start_line, start_line + len(text) - len(replace(text, chr(10), '')) AS end_line, start_char, start_char + length(text) AS end_char, text, heading_level, heading, kind IN ('Paragraph', 'ListItem') AS is_prose FROM blocks")
def block_spans(spark, sf_dir):
    return structure.blocks(notes(spark, sf_dir))


@query("SELECT kind, count(*) AS n FROM blocks GROUP BY kind")
def block_kinds(spark, sf_dir):
    return structure.blocks(notes(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT doc_id, block_index, sent_index, text, start_char, start_char + length(text) AS end_char FROM sents")
def sentence_spans(spark, sf_dir):
    return Analysis(notes(spark, sf_dir)).sentences


@query("SELECT doc_id, block_index, sent_index, array_to_string(kinds, ',') AS kinds, own AS signal FROM signals")
def claim_kinds_and_signals(spark, sf_dir):
    s = Analysis(notes(spark, sf_dir)).sentences
    return s.select("doc_id", "block_index", "sent_index", F.array_join(T.claim_kinds(F.col("text")), ",").alias("kinds"), T.source_signal(F.col("text")).alias("signal"))


@query("SELECT doc_id, block_index, sent_index, array_to_string(kinds, ',') AS kinds, grounded, reason FROM claims")
def grounding_adjacent(spark, sf_dir):
    c = Analysis(notes(spark, sf_dir)).claims
    return c.select("doc_id", "block_index", "sent_index", F.array_join("kinds", ",").alias("kinds"), "grounded", "reason")


@query("SELECT k AS doc_id, coalesce(t, 0) AS total, CAST(coalesce(u, 0) AS BIGINT) AS ungrounded, round(coalesce(u / t, 0.0), 6) AS gap, coalesce(t, 0) < 3 AS low_reliability FROM base LEFT JOIN (SELECT doc_id AS k, count(*) AS t, sum(CASE WHEN grounded THEN 0 ELSE 1 END) AS u FROM claims GROUP BY 1) USING (k)")
def grounding_gap(spark, sf_dir):
    docs = notes(spark, sf_dir)
    return scoring.grounding_gap(Analysis(docs).claims, docs, ["doc_id"]).withColumn("gap", F.round("gap", 6))


@query("SELECT doc_id, block_index, round(heading_overlap, 6) AS heading_overlap, round(prev_overlap, 6) AS prev_overlap, round(novel_ratio, 6) AS novel_ratio, array_to_string(hits, ',') AS filler_hits, flagged, fact_override FROM flags")
def density_flags(spark, sf_dir):
    d = Analysis(notes(spark, sf_dir)).density
    return d.select("doc_id", "block_index", *[F.round(c, 6).alias(c) for c in ("heading_overlap", "prev_overlap", "novel_ratio")], F.array_join("filler_hits", ",").alias("filler_hits"), "flagged", "fact_override")


@query("""SELECT k AS doc_id, 1 AS block_index, 'https://example.com/r/' || (k % 7) AS url, a + 3 + length(s1) + 4 AS start_char, a + 3 + length(s1) + 4 + length('https://example.com/r/' || (k % 7)) AS end_char FROM cuts WHERE s2 LIKE 'See %'
UNION ALL SELECT k, 4, 'http://q.example.org/a', a + b + c + d + 19, a + b + c + d + 41 FROM cuts""")
def citations(spark, sf_dir):
    return structure.citations(structure.blocks(notes(spark, sf_dir)))


@query("SELECT k AS doc_id, 1 AS block_index, '10.1234/ab' || (k % 5) AS doi, a + 3 + length(s1) + 20 AS start_char, a + 3 + length(s1) + 35 AS end_char FROM cuts WHERE s2 LIKE 'It was noted%'")
def dois(spark, sf_dir):
    return structure.dois(structure.blocks(notes(spark, sf_dir)))


@query("SELECT k AS doc_id, '10.1234/ab' || (k % 5) AS doi, 1 AS place FROM cuts WHERE s2 LIKE 'It was noted%'")
def doi_distinct(spark, sf_dir):
    return structure.distinct_dois(notes(spark, sf_dir))


def _results(spark, sf_dir, gaps: bool = False) -> DataFrame:
    scores = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("file"))
    rule = F.when(F.col("file") % 4 == 0, F.array(F.lit("GROUND001"))).when(F.col("file") % 4 == 1, F.array(F.lit("FILLER001"))).otherwise(F.array().cast("array<string>"))
    cases = scores.select("file", F.element_at(F.array(F.lit("Clean"), F.lit("Watch"), F.lit("Slop")), (F.col("file") % 3 + 1).cast("int")).alias("band"), rule.alias("rules"), F.when(F.lit(gaps) & (F.col("file") % 7 == 0), "later").alias("known_gap"), F.when(F.lit(gaps) & (F.col("file") % 5 == 0), F.array(F.lit("DENSITY001"), F.lit("GROUND001"))).alias("known_false_positives"))
    return outcomes(cases, Analysis(notes(spark, sf_dir)).fired())


@query("""SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(fp / (fp + tn), 6) AS fpr, (SELECT count(*) FROM cases JOIN banded USING (doc_id) WHERE want_band = band) AS bands_matched
FROM (SELECT count(*) FILTER (WHERE want AND got) AS tp, count(*) FILTER (WHERE NOT want AND got) AS fp, count(*) FILTER (WHERE want AND NOT got) AS fn, count(*) FILTER (WHERE NOT want AND NOT got) AS tn FROM grid)""")
def bench_metrics(spark, sf_dir):
    e = evaluation(_results(spark, sf_dir))
    return e.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "fpr")], "bands_matched")


@query("""SELECT c.doc_id AS file, want_band = band AS band_matched, array_to_string(list_sort([r FOR r IN coalesce(got, []) IF NOT list_contains(rules, r)]), ',') AS false_positives,
array_to_string(list_sort([r FOR r IN rules IF NOT list_contains(coalesce(got, []), r)]), ',') AS missed FROM cases c JOIN banded USING (doc_id) LEFT JOIN (SELECT doc_id, list(rule_id) AS got FROM fired GROUP BY 1) USING (doc_id)""")
def bench_outcomes(spark, sf_dir):
    r = _results(spark, sf_dir)
    return r.select("file", "band_matched", F.array_join("false_positives", ",").alias("false_positives"), F.array_join("missed", ",").alias("missed"))


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest({_tokens('text')}) AS token FROM documents) GROUP BY token", cte=False)
def token_freq(spark, sf_dir):
    docs = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text"))
    return docs.select(F.explode_outer(T.tokens(F.col("text"))).alias("token")).where("token is not null").groupBy("token").agg(F.count("*").alias("n"))


@query(_LINES + _TAIL + " SELECT doc_id, gap, rate, score, band FROM banded", cte=False)
def document_scores(spark, sf_dir):
    """The flagship over the raw documents, each line a paragraph."""
    docs = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return Analysis(docs).scores().select("doc_id", *[F.round(c, 6).alias(c) for c in ("gap", "rate", "score")], "band")


_REPORT = """,
listed AS (SELECT *, lag(block_index) OVER (PARTITION BY doc_id ORDER BY block_index, start_char, rule_id) AS above FROM findings),
told AS (SELECT doc_id, count(*) AS n, string_agg(CASE WHEN above = block_index THEN '' ELSE '  block ' || block_index || chr(10) END || '    ' || doc_id || ':' || start_line || '  ' || lower(severity) || '  ' || rule_id || '  ' || message || chr(10), '' ORDER BY block_index, start_char, rule_id) AS body FROM listed GROUP BY 1)
SELECT doc_id, score, band, doc_id || '  -  ' || band || ' (score ' || printf('%.2f', score) || ')' || chr(10) || chr(10) || coalesce(body || chr(10), '  no findings' || chr(10) || chr(10)) || coalesce(n, 0) || ' finding(s), band ' || band || chr(10) AS report
FROM banded LEFT JOIN told USING (doc_id)"""
_TURNS = (
    _LINES.replace("SELECT doc_id AS k, coalesce(text, '') AS text FROM documents", "SELECT coalesce(CAST(conv_id AS VARCHAR), '') || ':' || coalesce(CAST(turn AS VARCHAR), '') AS k, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations")
    .replace("row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS block_index", "row_number() OVER (PARTITION BY doc_id ORDER BY line) AS block_index").replace("2 * line + 1 AS start_line", "2 * line + 3 AS start_line")
    .replace("NULL::VARCHAR AS heading FROM lines", "role AS heading FROM lines JOIN base ON k = doc_id").replace("0 AS start_char, text, 0 AS heading_level", "0 AS start_char, lines.text, 0 AS heading_level")
    .replace("WHERE regexp_matches(text, '\\S')", "WHERE regexp_matches(lines.text, '\\S')").replace("AS text, 0 AS start_char, start_line AS line", "AS text, sent_index AS start_char, start_line AS line")
)


@query(_TURNS + _TAIL + _REPORT, cte=False)
def conversation_reports(spark, sf_dir):
    """Console reports of turns, each a markdown document of its own: a heading for the role, each line a paragraph. A
    null in the conversation or turn is empty in the name; repeated turns are reported again."""
    turns = dealt(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    text = F.concat(F.lit("## "), said("role"), F.lit("\n\n"), F.replace(said("text"), F.lit("\n"), F.lit("\n\n")))
    docs = turns.select(F.concat(said("conv_id"), F.lit(":"), said("turn")).alias("doc_id"), text.alias("text"))
    return Analysis(docs).reports().select("doc_id", F.round("score", 6).alias("score"), "band", "report")


_REFUSED = {
    "localhost": "loopback address", "10.1.2.3": "private address", "172.20.0.1": "private address", "192.168.1.9": "private address", "169.254.1.1": "link-local address", "0.0.0.0": "unspecified address", "127.0.0.5": "loopback address",
    "printer.local": "private network name", "intranet": "not a public hostname", "8.8.8.8": None, "www.example.org": None, "[::1]": "loopback address", "[0::1]": "loopback address", "[::ffff:7f00:1]": "loopback address", "[::ffff:10.0.0.1]": "private address",
    "[fe80::9]": "link-local address", "[fd12::1]": "private address", "[2001:db8::1]": None, "127.1": "loopback address", "0x7f.0.0.1": "loopback address", "0177.0.0.1": "loopback address", "2130706433": "loopback address", "300.1.1.1": "not a public hostname",
}
_host_case = f"CASE page_id % {len(_REFUSED)} " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(_REFUSED)) + " END"
_why_case = f"CASE page_id % {len(_REFUSED)} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_REFUSED.values()) if w) + " END"


#: Authorities that are no host with at most one port, beside some that are.
_ODD = {
    "127.0.0.1:80:90": "not an absolute url", "a.example:99999": "not an absolute url", "a.example:65536": "not an absolute url", "a.example:8o": "not an absolute url", "a.example:65535": None, "a.example:": None, "a,b.example": "not an absolute url",
    "[::1]:1:2": "not an absolute url", "[::1]x": "not an absolute url", "a_b.example.org:80": None, "u@127.0.0.1:80": "carries credentials", "@127.0.0.1:80": "loopback address",
}
_odd_case = f"CASE page_id % {len(_ODD)} " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(_ODD)) + " END"
_odd_why = f"CASE page_id % {len(_ODD)} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_ODD.values()) if w) + " END"


@query(f"SELECT page_id, 'f' AS form, {_odd_why} AS refusal FROM pages UNION ALL SELECT page_id, 'a', {_why_case} FROM pages UNION ALL SELECT page_id, 'b', 'carries credentials' FROM pages UNION ALL SELECT page_id, 'c', 'ftp is not a fetchable scheme' FROM pages UNION ALL SELECT page_id, 'd', 'not an absolute url' FROM pages UNION ALL SELECT page_id, 'e', CASE WHEN regexp_matches(url, '^https?://[^/]*\\.') THEN NULL ELSE 'not a public hostname' END FROM pages", cte=False)
def url_policy(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host, path = F.expr(_host_case), F.concat(F.lit("/p/"), F.col("page_id").cast("string"))
    forms = {"f": F.concat(F.lit("http://"), F.expr(_odd_case), path), "a": F.concat(F.lit("http://"), host, path), "b": F.concat(F.lit("https://u:p@"), host, path), "c": F.concat(F.lit("ftp://"), host, path), "d": path, "e": F.col("url")}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("form"), v.alias("u")) for k, v in forms.items()])).alias("f")
    return pages.select("page_id", each).select("page_id", "f.form", T.url_refusal(F.col("f.u")).alias("refusal"))


@query("SELECT event_id, CASE WHEN c BETWEEN 200 AND 299 THEN 'Resolves' WHEN c IN (404, 410) THEN 'Dead' ELSE 'Unreachable' END AS status, CASE WHEN c BETWEEN 200 AND 299 THEN 'resolves' WHEN c IN (404, 410) THEN 'the server says there is nothing there' ELSE 'no usable answer' END || ' (http ' || c || ')' AS reason FROM (SELECT event_id, 200 + event_id % 301 AS c FROM events)", cte=False)
def status_classify(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("c", 200 + F.col("event_id") % 301)
    return e.select("event_id", T.status_class(F.col("c")).alias("status"), T.status_text(F.col("c")).alias("reason"))


@query("SELECT doc_id, gap, rate, score, band FROM banded")
def sql_scores(spark, sf_dir):
    """The flagship by SQL text alone, over the functions that `plans.sql` registers."""
    sql.register(spark, names=["prose_score"])
    scored = spark.sql("SELECT doc_id, s.* FROM (SELECT doc_id, prose_score(text) AS s FROM {notes})", notes=notes(spark, sf_dir))
    return scored.select("doc_id", *[F.round(c, 6).alias(c) for c in ("gap", "rate", "score")], "band")


@query(SQL["block_spans"].removeprefix(_CTE))
def segmented_blocks(spark, sf_dir):
    """Blocks of the notes in pieces of 40 characters, parsed apart."""
    return segments.blocks(segments.cut(notes(spark, sf_dir), 40))


#: Phrases of two frequent words each, thousands of them.
_PAIRS = [f"{a} {b}" for a in P.STOPWORDS[:72] for b in P.STOPWORDS[:72]]


@query(f"""SELECT doc_id, len(hits) AS n_hits, array_to_string(hits, ',') AS hits FROM (SELECT doc_id, list_filter(lexicon, lambda p: contains(low, p)) AS hits FROM
(SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents), (SELECT list(a || ' ' || b ORDER BY i, j) AS lexicon FROM (SELECT unnest([{_STOP}][:72]) AS a, unnest(range(72)) AS i), (SELECT unnest([{_STOP}][:72]) AS b, unnest(range(72)) AS j)))""", cte=False)
def lexicon_hits(spark, sf_dir):
    """Of a lexicon of thousands of phrases, those that each whole text contains."""
    docs = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    hits = docs.select("doc_id", T.filler_hits(F.coalesce("text", F.lit("")), _PAIRS).alias("hits"))
    return hits.select("doc_id", F.size("hits").cast("long").alias("n_hits"), F.array_join("hits", ",").alias("hits"))


_VARIANT = {
    "b0": "'### ' || r || ' ##'", "b1": "chr(9) || '* item ' || n", "b2": "n || ') second'", "b3": "'> q' || chr(10) || '>r'", "b4": "'~~~ x' || chr(10) || '```' || chr(10) || '# no' || chr(10) || '~~~'", "b5": "'tail ' || n", "b6": "'```' || chr(10) || 'open ' || n",
}
_CRLF = "chr(13) || chr(10)"
_VARIANT_TEXT = f"b0 || {_CRLF} || {_CRLF} || b1 || {_CRLF} || b2 || {_CRLF} || b3 || chr(10) || chr(10) || b4 || chr(10) || b5 || chr(10) || b6"
_VARIANT_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS block_index, '{kind}' AS kind, {first} AS start_line, {last} AS end_line, CAST({at} AS INTEGER) AS start_char, CAST({at} + length(b{i}) AS INTEGER) AS end_char, b{i} AS text, {level} AS heading_level, {heading} AS heading, {prose} AS is_prose FROM v"
    for i, (kind, first, last, at, level, heading, prose) in enumerate([
        ("Heading", 1, 1, "0", 3, "NULL", "false"), ("ListItem", 3, 3, "length(b0) + 4", 0, "r || ' ##'", "true"), ("ListItem", 4, 4, "length(b0) + length(b1) + 6", 0, "r || ' ##'", "true"),
        ("BlockQuote", 5, 6, "length(b0) + length(b1) + length(b2) + 8", 0, "r || ' ##'", "false"), ("CodeFence", 8, 11, "length(b0) + length(b1) + length(b2) + length(b3) + 10", 0, "NULL", "false"),
        ("Paragraph", 12, 12, "length(b0) + length(b1) + length(b2) + length(b3) + length(b4) + 11", 0, "r || ' ##'", "true"), ("CodeFence", 13, 14, "length(b0) + length(b1) + length(b2) + length(b3) + length(b4) + length(b5) + 12", 0, "NULL", "false"),
    ])
)


@query(_sql(f"WITH k AS (SELECT coalesce(conv_id, -1) * 1000 + coalesce(turn, -1) AS doc_id, coalesce(role, 'none') AS r, CAST(coalesce(turn, 0) + 7 AS STRING) AS n FROM conversations), v AS (SELECT *, {', '.join(f'{e} AS {b}' for b, e in _VARIANT.items())} FROM k) {_VARIANT_ROWS}"), cte=False)
def markdown_variants(spark, sf_dir):
    """Blocks of turns written with CRLF, tabs, numbered items, quotes without spaces, tilde fences that hold others, and a
    fence that is left open."""
    turns = dealt(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role"))
    k = turns.selectExpr("coalesce(conv_id, -1) * 1000 + coalesce(turn, -1) AS doc_id", "coalesce(role, 'none') AS r", "CAST(coalesce(turn, 0) + 7 AS STRING) AS n")
    v = k.selectExpr("doc_id", *[f"{e} AS {b}" for b, e in _VARIANT.items()])
    return structure.blocks(v.selectExpr("doc_id", f"{_VARIANT_TEXT} AS text"))


#: Sentences about a number n, the kinds of claim they make and why they count as sourced.
_SAID = [
    ("'The WHO counted ' || n || ' cases.'", "Number", "names an authority or study"), ("'As the counter in the hall shows, ' || n || ' came.'", "Number", "attributes the claim to a named record"), ("'As per the log, ' || n || ' came.'", "Number", "attributes the claim to a named record"),
    ("'The logs are under the stairs, ' || n || ' of them.'", "Number", "says where the record can be found"), ("'It was ' || n || ' (Lee, 2020).'", "Number,Date", "carries an inline citation"), ("'It was ' || n || ' [7].'", "Number", "carries an inline citation"),
    ("'It was ' || n || '[^a].'", "Number", "carries a footnote marker"), ("'See [it](' || n || ').'", "Number", "carries a link or URL"), ("'Per the experts it was ' || n || '.'", "Number", None), ("'It was ' || n || ' here.'", "Number", None),
    ("'Smith et al said ' || n || '.'", "Number", "names an authority or study"), ("'Published in Nature, ' || n || '.'", "Number", "names an authority or study"), ("'Élodie était là, la WHOLE ' || n || '.'", "Number", None), ("'Über dem Haus: nach 5 jours, ' || n || ' in the NIH.'", "Number", "names an authority or study"),
]
_said = lambda part: f"CASE event_id % {len(_SAID)} " + " ".join(f"WHEN {i} THEN " + (x if part == 0 else "NULL" if x is None else f"'{x}'") for i, x in enumerate(s[part] for s in _SAID)) + " END"


@query(f"SELECT event_id, {_said(1)} AS kinds, {_said(2)} AS signal FROM events", cte=False)
def signal_forms(spark, sf_dir):
    """Each rule of claims and sources, on sentences whose outcome is known."""
    e = dealt(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")).selectExpr("event_id", "CAST(100 + event_id % 90 AS STRING) AS n")
    said = e.selectExpr("event_id", f"{_said(0)} AS text")
    return said.select("event_id", F.array_join(T.claim_kinds(F.col("text")), ",").alias("kinds"), T.source_signal(F.col("text")).alias("signal"))


@query("""SELECT count(*) AS n_cases, count(*) FILTER (WHERE known) AS known_gaps, count(*) FILTER (WHERE want_band = band) AS bands_matched, count(*) FILTER (WHERE (want_band <> band AND NOT known) OR unexpected > 0 OR missed > 0) AS regressions,
(SELECT round(2.0 * tp / (2 * tp + fp + fn), 6) FROM (SELECT count(*) FILTER (WHERE want AND got) AS tp, count(*) FILTER (WHERE NOT want AND got) AS fp, count(*) FILTER (WHERE want AND NOT got) AS fn FROM grid)) AS f1
FROM (SELECT c.doc_id, c.doc_id % 7 = 0 AS known, want_band, count(*) FILTER (WHERE got AND NOT want AND NOT (c.doc_id % 5 = 0 AND rule IN ('DENSITY001', 'GROUND001'))) AS unexpected, count(*) FILTER (WHERE want AND NOT got) AS missed FROM cases c JOIN grid USING (doc_id) GROUP BY ALL) JOIN banded USING (doc_id)""")
def bench_totals(spark, sf_dir):
    """Known gaps, known false positives and regressions of labelled notes."""
    e = evaluation(_results(spark, sf_dir, gaps=True)).select("cases", "known_gaps", "bands_matched", "regressions", F.round("f1", 6).alias("f1"))
    return e.withColumnRenamed("cases", "n_cases")
