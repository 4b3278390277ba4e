"""Column functions: all of them built-in expressions, evaluated on the JVM."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import patterns as P


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: a fold over nothing, since ``transform`` would copy what use returns."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, use)


_made: dict = {}


def once(key: object, make: Callable[[], Column]) -> Column:
    """make(), kept for the application: a Column belongs to no plan, and thousands of calls to the JVM make a large one."""
    application = SparkSession.active().sparkContext.applicationId
    if _made.get("application") != application:
        _made.clear()
        _made["application"] = application
    if key not in _made:
        _made[key] = make()
    return _made[key]


def trimmed(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(text, F.lit(P.SPACE))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def either(text: Column, use: Callable[[Callable[[str], str]], Column]) -> Column:
    """use(f), where f gives each pattern in the form that fits the text: the plain one for a text of ASCII."""
    return F.when(is_ascii(text), use(P.for_ascii)).otherwise(use(lambda p: p))


def tokens(text: Column) -> Column:
    """Lower-cased ASCII words of two letters and more, no stopwords, stemmed; repeats kept."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), 0)
    return F.transform(F.filter(words, lambda w: ~w.isin(P.STOPWORDS)), stem)


def stem(word: Column) -> Column:
    some = F.lit(False)
    for suffix in P.SUFFIXES:
        some = some | word.endswith(suffix)
    return F.when(some, F.regexp_replace(word, r"^(.{3,}?)(?:" + "|".join(P.SUFFIXES) + ")$", "$1")).otherwise(word)


KINDS = [("Number", P.NUMBER), ("Date", P.DATE), ("Causal", P.CAUSAL), ("Comparative", P.COMPARATIVE), ("Authority", P.APPEAL)]


def claim_kinds(text: Column) -> Column:
    """Kinds of claim a sentence makes, in a fixed order."""
    return either(text, lambda form: F.array_compact(F.array(*[F.when(text.rlike(form(p)), F.lit(k)) for k, p in KINDS])))


def makes_claim(text: Column) -> Column:
    """Whether `claim_kinds` has any."""
    return either(text, lambda form: text.rlike(form(P.NUMBER)) | text.rlike(form(P.any_of(P.DATE, P.CAUSAL, P.COMPARATIVE, P.APPEAL))))


def _links(text: Column, form: Callable[[str], str]) -> Column:
    return (text.contains("](") | text.contains("://")) & text.rlike(form(P.LINK))


def _marks(text: Column, form: Callable[[str], str]) -> Column:
    return text.contains("[^") & text.rlike(form(P.FOOTNOTE))


def _cites(text: Column, form: Callable[[str], str]) -> Column:
    return (text.contains("[") | text.contains("(")) & text.rlike(form(P.INLINE_CITE))


def sourced(text: Column) -> Column:
    """Whether `source_signal` has one."""
    return either(text, lambda form: _links(text, form) | _marks(text, form) | _cites(text, form) | text.rlike(form(P.any_of(P.AUTHORITY, P.ATTRIBUTION, P.WITNESS, P.LOCATION))))


def source_signal(text: Column) -> Column:
    """Why a text counts as sourced; null if it doesn't. The first rule that fires decides."""
    return either(text, lambda form: (
        F.when(_links(text, form), "carries a link or URL").when(_marks(text, form), "carries a footnote marker").when(_cites(text, form), "carries an inline citation")
        .when(text.rlike(form(P.AUTHORITY)), "names an authority or study")
        .when(text.rlike(form(P.ATTRIBUTION)) | text.rlike(form(P.WITNESS)), "attributes the claim to a named record")
        .when(text.rlike(form(P.LOCATION)), "says where the record can be found")
    ))


def self_reported(text: Column) -> Column:
    """A clock time, and no claim once clock times are blanked."""
    return text.contains(":") & text.rlike(P.CLOCK) & ~makes_claim(F.regexp_replace(text, P.CLOCK, " "))


def proper_noun(text: Column) -> Column:
    """A capitalised word that doesn't start a sentence."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")

    def inner(ws: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(ws) - 1)
        capital = lambda i: F.btrim(F.get(ws, i), F.lit(".,;:!?()\"'")).rlike(P.PROPER_NOUN)
        return F.when(F.size(ws) > 1, F.exists(places, lambda i: capital(i) & ~F.get(ws, i - 1).rlike(r"[.!?]$"))).otherwise(F.lit(False))

    return let(words, inner)


def concrete_fact(text: Column) -> Column:
    return either(text, lambda form: text.rlike(form(P.NUMBER)) | text.rlike(form(P.DATE))) | proper_noun(text)


#: So many phrases are looked for one by one; more are found in one pass over the text.
FEW_PHRASES = 16


def filler_hits(text: Column, phrases: list[str] | Column) -> Column:
    """Phrases of the list that the lower-cased text contains, in the list's order, repeats kept."""
    if isinstance(phrases, Column) or len(phrases) <= FEW_PHRASES or not any(phrases):
        listed = phrases if isinstance(phrases, Column) else F.array(*map(F.lit, phrases))
        return let(F.lower(text), lambda low: F.filter(listed, lambda p: F.contains(low, p)))
    return phrases_in(F.lower(text), phrases)


def phrases_in(text: Column, phrases: list[str]) -> Column:
    """As `filler_hits`, of a lexicon of any size: the text is read once by an automaton of all phrases, which gives the
    longest one at each place; the phrases that start a longer one are looked up for those found."""
    places: dict[str, list[int]] = {}
    for i, p in enumerate(phrases):
        places.setdefault(p, []).append(i)
    starts = {p: sorted(i for n in range(len(p) + 1) for i in places.get(p[:n], ())) for p in places if p}
    table = F.from_json(F.lit(json.dumps(starts)), "map<string,array<int>>")
    every = F.from_json(F.lit(json.dumps(phrases)), "array<string>")
    always = F.array(*map(F.lit, places.get("", []))).cast("array<int>")
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(P.phrase_pattern(phrases)), 1))

    def listed(some: Column) -> Column:
        hits = F.array_sort(F.array_distinct(F.concat(always, F.flatten(F.transform(some, lambda p: F.try_element_at(table, p))))))
        return F.when((F.size(some) == 0) & (F.size(always) == 0), F.array().cast("array<string>")).otherwise(F.transform(hits, lambda i: F.get(every, i)))

    return let(found, listed)


def jaccard(a: Column, b: Column) -> Column:
    """Over distinct elements; 0 if either is empty or null."""
    empty = a.isNull() | b.isNull() | (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def band(score: Column, options: P.Options) -> Column:
    return F.when(score >= options.slop_at, "Slop").when(score >= options.watch_at, "Watch").otherwise("Clean")


def options_of(raw: Column) -> P.Options:
    """The options that each row's JSON gives (null: defaults), as columns: missing fields keep their defaults, filler
    extends the list, names count in any case; what isn't a JSON object raises when the row is read."""
    low = lambda c: F.transform_keys(c, lambda k, _: F.lower(k))
    parsed = let(F.from_json(raw, "map<string,string>"), lambda m: F.when(raw.isNull() | (F.trim(raw) == "null") | m.isNotNull(), low(m)).otherwise(F.raise_error(F.lit("options must be a JSON object")).cast("map<string,string>")))

    def number(group: str, name: str, default: float | int) -> Column:
        inner = low(F.from_json(F.try_element_at(parsed, F.lit(group)), "map<string,string>"))
        return F.coalesce(F.try_element_at(inner, F.lit(name)).cast("int" if isinstance(default, int) else "double"), F.lit(default))

    o = P.Options()
    more = F.transform(F.from_json(F.try_element_at(parsed, F.lit("filler")), "array<string>"), F.lower)
    return P.Options(
        number("weights", "grounding", o.grounding_weight), number("weights", "density", o.density_weight), number("bands", "watch", o.watch_at), number("bands", "slop", o.slop_at), number("density", "highoverlap", o.high_overlap),
        number("density", "lownovelty", o.low_novelty), number("density", "minfillerhits", o.min_filler_hits), number("grounding", "minclaims", o.min_claims), F.coalesce(F.concat(F.array(*map(F.lit, o.filler)), more), F.array(*map(F.lit, o.filler))),
    )


def ratio(n: Column, d: Column) -> Column:
    """1 where there is nothing to count."""
    return F.when(d == 0, F.lit(1.0)).otherwise(n / d)


def v4_number(host: Column) -> Column:
    """The 32-bit number of an IPv4 host in any spelling that URLs know: one to four numbers, decimal, octal (0...) or
    hexadecimal (0x...), the last of which fills what is left. Null if it is none."""

    def whole(x: Column) -> Column:
        hexa, octal = F.conv(F.concat(F.lit("0"), F.substring(x, 3, 99)), 16, 10), F.conv(x, 8, 10)
        return F.when(x.rlike("^0x[0-9a-f]{0,15}$"), hexa).when(x.rlike("^0[0-7]{0,20}$"), octal).when(x.rlike("^[1-9][0-9]*$"), x).try_cast("bigint")

    def joined(n: Column) -> Column:
        count, last = F.size(n), F.element_at(n, -1)
        head = F.slice(n, F.lit(1), count - 1)
        fits = ~F.exists(n, lambda x: x.isNull()) & F.forall(head, lambda x: x <= 255) & (last < F.pow(F.lit(256), 5 - count).cast("bigint"))
        moved = F.transform(head, lambda x, i: x * F.pow(F.lit(256), 3 - i).cast("bigint"))
        return F.when(count.between(1, 4) & fits, F.aggregate(moved, F.lit(0).cast("bigint"), lambda t, x: t + x) + last)

    return let(F.transform(F.split(host, r"\."), whole), joined)


def v6_groups(host: Column) -> Column:
    """The eight numbers of an IPv6 address in any spelling, without brackets; null if it is none."""
    tail = F.regexp_extract(host, r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})$", 1)

    def spelt(v4: Column) -> Column:
        pair = F.concat(F.hex(F.floor(v4 / 65536)), F.lit(":"), F.hex(v4 % 65536))
        return F.when(tail == "", host).when(v4.isNotNull(), F.concat(F.substring(host, F.lit(1), F.length(host) - F.length(tail)), pair))

    def groups(text: Column) -> Column:
        listed = lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ":"))

        def padded(sides: Column) -> Column:
            left, right = listed(F.get(sides, F.lit(0))), listed(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
            missing = 8 - F.size(left) - F.size(right)
            full = F.when((F.size(sides) == 2) & (missing > 0), F.concat(left, F.array_repeat(F.lit("0"), missing), right)).when((F.size(sides) == 1) & (missing == 0), left)
            return F.when(F.forall(full, lambda g: g.rlike("^[0-9a-fA-F]{1,4}$")), F.transform(full, lambda g: F.conv(g, 16, 10).cast("int")))

        return let(F.split(text, "::"), padded)

    return let(spelt(F.when(tail != "", v4_number(tail))), groups)


def _v4_refusal(n: Column) -> Column:
    first, second = F.floor(n / 2**24), F.floor(n / 2**16) % 256
    return (
        F.when(first == 127, "loopback address").when(first == 0, "unspecified address").when((first == 169) & (second == 254), "link-local address")
        .when((first == 10) | ((first == 172) & second.between(16, 31)) | ((first == 192) & (second == 168)), "private address")
    )


def _v6_refusal(g: Column) -> Column:
    zero = lambda n: F.forall(F.slice(g, 1, n), lambda x: x == 0)
    at = lambda i: F.get(g, F.lit(i))
    return (
        F.when(g.isNull(), "not an absolute url").when(zero(5) & (at(5) == 0xFFFF), _v4_refusal(at(6).cast("bigint") * 65536 + at(7))).when(zero(7) & (at(7) == 1), "loopback address")
        .when(at(0).bitwiseAND(0xFFC0) == 0xFE80, "link-local address").when(at(0).bitwiseAND(0xFE00) == 0xFC00, "private address").when(zero(8), "unspecified address")
    )


def _name_refusal(host: Column) -> Column:
    """Of a name. A trailing dot is no part of it; a name that ends like a number but is no address, or hides letters or
    dots in other characters, is refused too. Other characters than letters, digits, - and _ make no name."""
    suffix = F.lit(False)
    for s in P.PRIVATE_SUFFIXES:
        suffix = suffix | host.endswith(s)
    return (
        F.when(host.rlike(P.NO_NAME), "not an absolute url").when(host == "localhost", "loopback address").when(suffix, "private network name")
        .when(~host.contains(".") | host.rlike(r"(^|\.)(0x[0-9a-f]*|[0-9]+)$") | host.rlike(P.DISGUISED), "not a public hostname")
    )


def url_refusal(url: Column) -> Column:
    """Why a URL must not be fetched; null if it may be. The authority is one host and at most one port up to 65535."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*:[/\\]{2}([^/\\?#]*)", 1)

    def judged(p: Column) -> Column:
        host = F.lower(F.regexp_replace(F.regexp_replace(p["authority"], "^[^@]*@", ""), r":\d*$", ""))
        http = p["scheme"].isin("http", "https")
        port = F.regexp_extract(p["authority"], r":(\d+)$", 1)
        malformed = ~p["authority"].rlike(r"^([^@]*@)?(\[[^\[\]@]*\]|[^:\[\]@]*)(:[0-9]*)?$") | (F.ltrim(port, F.lit("0")).try_cast("bigint") > 65535) | (F.length(F.ltrim(port, F.lit("0"))) > 5)

        def of_host(h: Column) -> Column:
            plain = F.regexp_replace(h, r"\.$", "")
            inner = F.regexp_replace(F.regexp_replace(h, r"^\[|\]$", ""), "%.*$", "")
            address = F.when(h.startswith("["), let(v6_groups(inner), _v6_refusal)).otherwise(let(v4_number(plain), lambda n: F.when(n.isNotNull(), _v4_refusal(n)).otherwise(_name_refusal(plain))))
            broken = (p["scheme"] == "") | (http & ((h == "") | malformed)) | F.trim(url).rlike(r"[\s\x00-\x20]")
            return F.when(broken, "not an absolute url").when(~http, F.concat(p["scheme"], F.lit(" is not a fetchable scheme"))).when(p["authority"].rlike("^[^@]+@"), "carries credentials").otherwise(address)

        return let(host, of_host)

    return F.when(url.isNull(), "not an absolute url").otherwise(let(F.struct(scheme.alias("scheme"), authority.alias("authority")), judged))


def status_class(status: Column) -> Column:
    return F.when(status.between(200, 299), "Resolves").when(status.isin(404, 410), "Dead").otherwise("Unreachable")


def status_text(status: Column, registry: bool = False, retry_after: Column | None = None) -> Column:
    """The sentence for a server's (or the registry's) answer."""
    said = lambda words: F.concat(F.lit(words + " (http "), status.cast("string"), F.lit(")"))
    yes, no = ("the registry has this work", "the registry has no such work") if registry else ("resolves", "the server says there is nothing there")
    usual = F.when(status.between(200, 299), said(yes)).when(status.isin(404, 410), said(no)).otherwise(said("no usable answer"))
    if not registry:
        return usual
    after = F.lit(None).cast("string") if retry_after is None else retry_after
    limited = F.when(after.isNull(), "rate limited by the registry, so this says nothing about the work").otherwise(F.concat(F.lit("rate limited by the registry, which asked for "), after, F.lit("s")))
    return F.when(status == 429, limited).otherwise(usual)
