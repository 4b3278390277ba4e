"""The flagship plan: documents to findings, score and band; reports; evaluation against labels.

A document's blocks, claims and densities are arrays of its own row, parsed once; relations are exploded from them and
scores are computed beside them. Nothing is shuffled before labels are joined."""

from __future__ import annotations

from dataclasses import fields
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseloom.functions import text as T
from proseloom.functions.patterns import RULES, Options
from proseloom.operators import scoring, structure

FINDING = ["rule_id", "severity", "block_index", "start_line", "end_line", "start_char", "end_char", "message"]


def _bare(b: Column, at: dict[str, Column]) -> Column:
    """An ungrounded claim of a block as a finding."""
    return F.struct(
        F.lit("GROUND001").alias("rule_id"), F.lit("Warning").alias("severity"), b["block_index"].alias("block_index"), *[at[c].alias(c) for c in ("start_line", "end_line", "start_char", "end_char")],
        F.lit("specific claim: no source signal near the claim").alias("message"),
    )


def _rule(hits: Column) -> Column:
    return F.when(F.size(hits) > 0, "FILLER001").otherwise("DENSITY001")


def _padded(b: Column, hits: Column) -> Column:
    """A flagged block as a finding."""
    message = F.when(F.size(hits) > 0, F.concat(F.lit("filler phrasing: "), F.array_join(hits, ", "))).otherwise("restates prior content with little novel detail")
    return F.struct(_rule(hits).alias("rule_id"), F.lit("Info").alias("severity"), *[b[c].alias(c) for c in ("block_index", "start_line", "end_line", "start_char", "end_char")], message.alias("message"))


def every_claim() -> Column:
    """The claims of the column prose."""
    return T.once("claims", lambda: F.flatten(F.transform("prose", scoring.claims_of)))


def judged(places: bool) -> Column:
    """`scoring.bare_of` each block of the column prose, with findings if they are to have places."""
    return T.once(("judged", places), lambda: F.transform("prose", lambda b: scoring.bare_of(b, _bare if places else None)))


def padded(options: Options, places: bool) -> Column:
    """Findings of flagged blocks of the column prose; their rules only, if they need no places."""
    make = lambda: scoring.flagged_of(F.col("prose"), options, _padded if places else lambda _, hits: _rule(hits))
    return make() if isinstance(options.high_overlap, Column) else T.once(("padded", places, repr(options)), make)


def gap(judged_: Column) -> Column:
    """The share of ungrounded claims among those that `judged` counts."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("bare"))
    more = lambda s, x: F.struct((s["n"] + x["total"]).alias("n"), (s["bare"] + F.size(x["bare"])).alias("bare"))
    return F.aggregate(judged_, zero, more, lambda s: F.when(s["n"] == 0, 0.0).otherwise(s["bare"] / s["n"]))


def rate(padded_: Column) -> Column:
    """The share of flagged blocks in the column prose."""
    return F.when(F.size("prose") == 0, 0.0).otherwise(F.size(padded_) / F.size("prose"))


def every_finding(judged_: Column, padded_: Column) -> Column:
    return F.concat(F.flatten(F.transform(judged_, lambda x: x["bare"])), padded_)


def sorted_findings(judged_: Column, padded_: Column) -> Column:
    """`every_finding` by block, start and rule."""
    place = ("block_index", "start_char", "rule_id", "severity", "start_line", "end_line", "end_char", "message")
    return F.sort_array(F.transform(every_finding(judged_, padded_), lambda f: F.struct(*[f[c].alias(c) for c in place])))


class Analysis:
    """The relations of one collection of documents (doc_id, text), all lazy and derived from one parse. A null text has
    no blocks and scores 0; rows with equal or null ids are documents of their own. ``options`` may be a Column of docs
    with a JSON text: then each document is judged by its own thresholds and lexicon."""

    def __init__(self, docs: DataFrame, options: Options | Column | None = None):
        own = []
        if isinstance(options, Column):
            each = T.options_of(options)
            own = [F.struct(*[getattr(each, f.name).alias(f.name) for f in fields(Options)]).alias("options_")]
            options = Options(*[F.col("options_")[f.name] for f in fields(Options)])
        o = self.options = options or Options()
        self.own = ["options_"] if own else []
        self.docs = docs
        empty = structure._none(structure.BLOCK)
        self.parsed = docs.select("doc_id", F.coalesce(structure.parsed(), empty).alias("blocks"))
        self.prosed = docs.select("doc_id", *own, F.coalesce(structure.prose_parsed(), empty).alias("prose"))

    def _judged(self, places: bool) -> DataFrame:
        """doc_id, prose, judged, padded."""
        return self.prosed.select("doc_id", *self.own, "prose", judged(places).alias("judged"), padded(self.options, places).alias("padded"))

    def _scored(self, places: bool) -> DataFrame:
        """doc_id, gap, rate, score, band, judged, padded."""
        o = self.options
        both = self._judged(places).select("doc_id", *self.own, gap(F.col("judged")).alias("gap"), rate(F.col("padded")).alias("rate"), "judged", "padded")
        score = F.lit(o.grounding_weight) * F.col("gap") + F.lit(o.density_weight) * F.col("rate")
        return both.withColumn("score", score).withColumn("band", T.band(F.col("score"), o))

    @cached_property
    def blocks(self) -> DataFrame:
        return structure.rows(self.parsed, F.col("blocks"), "doc_id")

    @cached_property
    def prose(self) -> DataFrame:
        return structure.rows(self.prosed, F.col("prose"), "doc_id")

    @cached_property
    def sentences(self) -> DataFrame:
        return structure.sentences(self.prose)

    @cached_property
    def claims(self) -> DataFrame:
        return structure.rows(self.prosed, every_claim(), "doc_id").select("doc_id", *scoring.CLAIM)

    @cached_property
    def density(self) -> DataFrame:
        return structure.rows(self.prosed, scoring.densities(self.options), "doc_id")

    def summary(self) -> DataFrame:
        """doc_id, gap, rate, score, band, findings (sorted by block, start, rule); documents without prose score 0."""
        return self._scored(True).select("doc_id", "gap", "rate", "score", "band", sorted_findings(F.col("judged"), F.col("padded")).alias("findings"))

    def findings(self) -> DataFrame:
        """Ungrounded claims (Warning) and flagged blocks (Info), one row each."""
        return structure.rows(self._judged(True), every_finding(F.col("judged"), F.col("padded")), "doc_id").select("doc_id", *FINDING)

    def scores(self) -> DataFrame:
        """doc_id, gap, rate, score, band. No finding is placed."""
        return self._scored(False).select("doc_id", "gap", "rate", "score", "band")

    def fired(self) -> DataFrame:
        """What `fired` gives of the summary; no finding is placed."""
        ground = F.when(F.exists("judged", lambda x: F.size(x["bare"]) > 0), F.array(F.lit("GROUND001"))).otherwise(F.array().cast("array<string>"))
        return self._scored(False).select(F.col("doc_id").alias("file"), "band", "score", F.array_distinct(F.concat(ground, F.col("padded"))).alias("fired"))

    def reports(self) -> DataFrame:
        """doc_id, score, band, findings (sorted by block, start, rule), report (text), json."""
        full = self.summary()
        name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
        line = lambda f: F.concat(F.lit("    "), name, F.lit(":"), f["start_line"], F.lit("  "), F.lower(f["severity"]), F.lit("  "), f["rule_id"], F.lit("  "), f["message"], F.lit("\n"))
        body = F.transform("findings", lambda f, i: F.concat(F.when((i == 0) | (F.get("findings", i - 1)["block_index"] != f["block_index"]), F.concat(F.lit("  block "), f["block_index"], F.lit("\n"))).otherwise(""), line(f)))
        text = F.concat(
            name, F.lit("  -  "), F.col("band"), F.lit(" (score "), F.format_string("%.2f", "score"), F.lit(")\n\n"),
            F.when(F.size("findings") == 0, "  no findings\n\n").otherwise(F.concat(F.array_join(body, ""), F.lit("\n"))), F.size("findings"), F.lit(" finding(s), band "), F.col("band"), F.lit("\n"),
        )
        camel = F.transform("findings", lambda f: F.struct(f["rule_id"].alias("ruleId"), f["severity"].alias("severity"), f["block_index"].alias("blockIndex"), f["start_line"].alias("startLine"), f["end_line"].alias("endLine"), f["start_char"].alias("startChar"), f["end_char"].alias("endChar"), f["message"].alias("message")))
        return full.select("doc_id", "score", "band", "findings", text.alias("report"), F.to_json(F.struct("score", "band", camel.alias("findings"))).alias("json"))


def outcomes(cases: DataFrame, results: DataFrame) -> DataFrame:
    """cases (file, band, rules, known_gap, known_false_positives) against results (file, band, score, fired):
    band_matched, false_positives, missed, regressed. A case without a result, or a result without a case, raises when
    the rows are read. Both are one row a file; a null file is a file of its own name."""
    none = F.array().cast("array<string>")
    own = results.select(F.col("file").alias("of"), F.col("band").alias("actual"), "score", F.array_distinct("fired").alias("fired"), F.lit(True).alias("scored"))
    both = cases.withColumn("labelled", F.lit(True)).join(own, F.col("file").eqNullSafe(F.col("of")), "full")
    alone = F.when(F.col("scored").isNull(), F.raise_error(F.concat(F.lit("no result for the case "), F.coalesce("file", F.lit("null"))))).when(F.col("labelled").isNull(), F.raise_error(F.concat(F.lit("no case for the result "), F.coalesce(F.col("of").cast("string"), F.lit("null")))))
    both = both.withColumn("file", F.coalesce(alone.cast(cases.schema["file"].dataType), "file")).withColumn("fired", F.coalesce("fired", none)).withColumn("rules", F.coalesce("rules", none)).withColumn("known", F.coalesce("known_false_positives", none))
    place = ["position"] if "position" in cases.columns else []
    out = both.select(
        *place, "file", "band", "actual", "score", "rules", "fired", "known_gap", "known", (F.col("band") == F.col("actual")).alias("band_matched"),
        F.array_sort(F.array_except("fired", "rules")).alias("false_positives"), F.array_sort(F.array_except("rules", "fired")).alias("missed"),
    )
    unexpected = F.size(F.array_except("false_positives", "known")) > 0
    return out.withColumn("regressed", (~F.col("band_matched") & F.col("known_gap").isNull()) | unexpected | (F.size("missed") > 0))


def evaluation(results: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, tn over cases and rules, precision, recall, fpr, f1, bands_matched, known_gaps, regressions."""
    each = results.select("*", F.posexplode(F.array(*map(F.lit, RULES))).alias("place", "rule"))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    want, got, once = F.array_contains("rules", F.col("rule")), F.array_contains("fired", F.col("rule")), F.col("place") == 0
    m = each.agg(
        count(want & got).alias("tp"), count(~want & got).alias("fp"), count(want & ~got).alias("fn"), count(~want & ~got).alias("tn"),
        count(once & F.col("band_matched")).alias("bands_matched"), count(once & F.col("known_gap").isNotNull()).alias("known_gaps"), count(once & F.col("regressed")).alias("regressions"), count(once).alias("cases"),
    )
    m = m.withColumn("precision", T.ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", T.ratio(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("fpr", T.ratio(F.col("fp"), F.col("fp") + F.col("tn")))
    s = F.col("precision") + F.col("recall")
    return m.withColumn("f1", F.when(s == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / s))


def fired(summary: DataFrame) -> DataFrame:
    """file, band, score, fired of `Analysis.summary`: what `outcomes` takes as results."""
    return summary.select(F.col("doc_id").alias("file"), "band", "score", F.array_distinct(F.transform("findings", lambda f: f["rule_id"])).alias("fired"))


def bench_report(results: DataFrame) -> str:
    """The evaluation as text: ratios, bands, known gaps, regressions. Reads one row of totals, and of the labelled
    cases those that are gaps or regressions."""
    e = evaluation(results).first()
    told = results.where("known_gap is not null or regressed").orderBy(*(["position"] if "position" in results.columns else []), "file").collect()
    share = lambda x: f"{x * 100:5.1f}%"
    said = lambda r: f"labeled {r['band']}, scored {r['actual']} ({r['score']:.2f})"
    lines = [
        f"corpus: {e['cases']} cases, {len(RULES)} rules", "", f"  precision  {share(e['precision'])}   ({e['tp']} hit, {e['fp']} false)", f"  recall     {share(e['recall'])}   ({e['fn']} missed)",
        f"  fp rate    {share(e['fpr'])}   (of {e['fp'] + e['tn']} that should stay quiet)", f"  f1         {share(e['f1'])}", f"  bands      {e['bands_matched']}/{e['cases']}",
    ]
    gaps, bad = [r for r in told if r["known_gap"] is not None], [r for r in told if r["regressed"]]
    if gaps:
        lines += ["", "known gaps (not counted against the run)", *[f"  {r['file']}  {said(r)}" for r in gaps]]
    lines += ["", f"{len(bad)} regression(s)" if bad else "no regressions"]
    for r in bad:
        lines.append(f"  {r['file']}")
        if not r["band_matched"] and r["known_gap"] is None:
            lines.append(f"    band      {said(r)}")
        if r["false_positives"]:
            lines.append(f"    fired     {', '.join(r['false_positives'])} - not labeled")
        if r["missed"]:
            lines.append(f"    silent    {', '.join(r['missed'])} - labeled but never fired")
    return "\n".join(lines) + "\n"
