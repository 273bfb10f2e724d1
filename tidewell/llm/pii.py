"""Personal data by weak supervision.

Strict patterns give the base spans. Loose patterns propose more candidates;
labelers (company, regex, gazetteer, context, boundary, shape) vote on base spans and
candidates alike, expectation-maximisation over the counts of vote patterns
estimates their reliabilities, and a logistic span classifier trained on the
posteriors decides which candidates join the base spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import materialise, table
from tidewell.llm.weak import Rates, fit_logistic, fit_votes, logistic

KINDS = ("email", "ip", "card", "phone")

#: Base patterns. A match can only start where a run of its first characters
#: starts (or where the match before ended), which keeps long runs linear.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidate patterns: written-out or spaced addresses, numbers without +, other separators.
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:[\[(]at[\])]|@)\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]{1,63}+){1,6}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\x20?\[?\.\]?\x20?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20./_-]{0,2}[0-9]{4}){2,3}[0-9]{0,3}(?![0-9])",
    "phone": r"(?<![0-9])(?:00[1-9][0-9]{0,2}[\x20.-]?(?:\([0-9]{1,5}\)|[0-9]{1,5})(?:[\x20./-][0-9]{2,8}){1,3}|(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\x20./-][0-9]{2,5}){2,4})(?![0-9])",
}
#: Texts without it have no match of the kind's loose pattern.
HINT = {"email": r"@|(?i)[\[(]at[\])]", "ip": r"[0-9]\x20?\[?\.", "card": r"[0-9]{4}", "phone": r"[0-9][0-9)][\x20./-]"}
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

# Gazetteers and cue words of the labelers.
#: Names of top-level domains; any two letters count as a country's.
TOP_LEVEL = "com|org|net|edu|gov|mil|int|info|biz|name|app|dev|example|[a-z]{2}"
#: Issuers' first digits, with the numbers of digits that they give out.
ISSUERS = "(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}|3[47][0-9]{13}|3(?:0[0-5]|[689][0-9])[0-9]{11}|(?:6011|65[0-9]{2}|64[4-9][0-9])[0-9]{12}|35[0-9]{14,17}|62[0-9]{14,17})"
#: Country calling codes that are given out.
CALLING = "(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[789][0-9]|8[05678][0-9]|9[679][0-9])"
CUES = {
    "email": "e-?mail|mail|mailto|contact|correo|courriel|kontakt|write to",
    "ip": "ip|host|server|address|adresse|login from|connected",
    "card": "card|visa|mastercard|amex|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|telephone|call|mobile|fax|telefon|teléfono|téléphone|whatsapp",
}
OTHER_CUES = "isbn|issn|doi|version|order|invoice|serial|model|part no|section|§|hash|id|sku|page|figure"

#: Labelers in the order of their votes, and first guesses of their rates.
LABELERS = ("company", "regex", "gazetteer", "context", "boundary", "shape")
START = (Rates(0.5, 0.3, 0.5, 0.7), Rates(0.9, 0.3, 0.03, 0.6), Rates(0.7, 0.3, 0.1, 0.4), Rates(0.4, 0.05, 0.02, 0.25), Rates(0.9, 0.6, 0.03, 0.4), Rates(0.8, 0.3, 0.05, 0.5))
#: Characters within which a base span is company.
COMPANY = 80

_SPAN = "array<struct<start:int,end:int,match:string,before:string,after:string>>"
_CHUNK = 256


def _let(value: Column, then) -> Column:
    """then(value), with value evaluated once a row."""
    return F.transform(F.array(value), then)[0]


def _located(parts: Column, matches: Column) -> Column:
    """Spans from the texts between matches and the matches, in order.

    Positions are summed up chunk by chunk, so that a text of very many
    matches doesn't copy one growing array for each.
    """
    steps = F.transform(matches, lambda m, k: F.struct(F.length(F.get(parts, k)).alias("gap"), m.alias("match"), F.right(F.get(parts, k), F.lit(30)).alias("before"), F.left(F.get(parts, k + 1), F.lit(1)).alias("after")))

    def chunk(rows: Column) -> Column:
        def add(state: Column, x: Column) -> Column:
            start = state["at"] + x["gap"]
            end = start + F.length(x["match"])
            span = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"), x["before"].alias("before"), x["after"].alias("after"))
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

        return F.aggregate(rows, F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out")), add)

    def shifted(chunks: Column) -> Column:
        def move(c: Column, k: Column) -> Column:
            base = F.aggregate(F.slice(chunks, F.lit(1), k), F.lit(0), lambda a, x: a + x["at"])
            return _let(base, lambda b: F.transform(c["out"], lambda x: F.struct((x["start"] + b).alias("start"), (x["end"] + b).alias("end"), x["match"].alias("match"), x["before"].alias("before"), x["after"].alias("after"))))

        return F.flatten(F.transform(chunks, move))

    def chunked(rows: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / _CHUNK).cast("int")), lambda k: chunk(F.slice(rows, k * _CHUNK + 1, F.lit(_CHUNK))))

    return _let(steps, lambda rows: _let(chunked(rows), shifted))


def _located_in(parts: Column, matches: Column) -> Column:
    return _let(parts, lambda p: _located(p, matches))


def _luhn(digits: Column) -> Column:
    def value(k: Column) -> Column:
        d = F.substring(digits, F.length(digits) - k, F.lit(1)).cast("int")
        return F.when(k % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]+", "")


def passes(kind: str, match: Column) -> Column:
    """Whether a match of the strict pattern is a base span."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(f"^{OCTET}(?:\\.{OCTET}){{3}}$")
    digits = _digits(match)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(9, 15)


def _passing(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda x: passes(kind, x["match"]))


def _votes(kind: str, x: Column) -> list[Column]:
    """The votes of all labelers but company on a span, as 1, 0 or -1."""
    match, before, after = x["match"], x["before"], x["after"]
    digits = _digits(match)
    vote = lambda yes, no: F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))
    regex = {
        "email": lambda: vote(match.rlike(r"[A-Za-z]{2,}$"), match.rlike(r"[0-9]$")),
        "ip": lambda: vote(F.regexp_replace(match, r"[^0-9.]+", "").rlike(f"^{OCTET}(?:\\.{OCTET}){{3}}$"), F.lit(True)),
        "card": lambda: vote(F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False)), F.lit(True)),
        "phone": lambda: vote(F.length(digits).between(9, 15), ~F.length(digits).between(7, 15)),
    }[kind]()
    gazetteer = {
        "email": lambda: vote(match.rlike(f"(?i)(?:{TOP_LEVEL})$"), F.lit(False)),
        "ip": lambda: vote(match.rlike(r"^(?:[1-9][0-9]|1[013-9][0-9]|12[0-689]|2[01][0-9]|22[0-3])[^0-9]"), match.rlike(r"^0*(?:0|127|22[4-9]|2[3-9][0-9]|[3-9][0-9]{2})[^0-9]")),
        "card": lambda: vote(digits.rlike(f"^{ISSUERS}$"), F.lit(True)),
        "phone": lambda: vote(match.rlike(r"^(?:\+|00)") & digits.rlike(f"^(?:00)?{CALLING}"), match.rlike(r"^(?:\+|00)") | digits.rlike(r"^([0-9])\1+$")),
    }[kind]()
    context = vote(before.rlike(rf"(?i)\b(?:{CUES[kind]})\b[^.!?]*$"), before.rlike(rf"(?i)(?:\b(?:{OTHER_CUES})\b|[#=])[^.!?]{{0,12}}$"))
    inside = before.rlike(r"[\p{L}0-9@_=/-]$") | after.rlike(r"^[\p{L}0-9@_=/-]")
    date = r"^(?:[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:[0-9]{2}){1,2})(?![0-9])"
    shape = {
        # a point before a space ends a sentence or numbers a list
        "email": lambda: vote(~match.rlike(r"\x20") | match.rlike(r"(?i)[\[(]at[\])].*[\[(]dot[\])]"), match.rlike(r"[^\x20]\.\x20|\x20@|@\x20")),
        # parts are written alike
        "ip": lambda: vote(match.rlike(r"^[0-9]+([^0-9]+)[0-9]+\1[0-9]+\1[0-9]+$") & ~match.rlike(r"(?:^|[^0-9])0[0-9]|[0-9]\.\x20"), F.lit(True)),
        "card": lambda: vote(match.rlike(r"^[0-9]+$|^[0-9]+([^0-9]+)(?:[0-9]+\1)*[0-9]+$"), F.lit(True)),
        "phone": lambda: vote(match.rlike(r"^(?:\+|00|\()|[0-9]{4}$") & ~match.rlike(date), match.rlike(date) | digits.rlike(r"([0-9])\1{5}")),
    }[kind]()
    return [regex, gazetteer, context, vote(~inside, inside), shape]


def _coded(kind: str, spans: Column, base: bool) -> Column:
    """Spans as (start, kind, end, code, base); the code holds the votes and the number of digits in four steps."""

    def one(x: Column) -> Column:
        votes = F.concat(*[F.when(v == 1, F.lit("y")).when(v == -1, F.lit("n")).otherwise(F.lit("-")) for v in _votes(kind, x)])
        size = F.least(F.lit(3), F.floor(F.length(_digits(x["match"])) / 5).cast("int")).cast("string")
        return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"), F.concat(votes, size).alias("code"), F.lit(base).alias("base"))

    return F.transform(spans, one)


def _running_max(values: Column) -> Column:
    """The greatest value up to each place of an array of integers, chunk by chunk."""

    def chunked(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / 64).cast("int")), lambda k: F.slice(v, k * 64 + 1, F.lit(64)))

    def carried(chunks: Column) -> Column:
        # the greatest value before each chunk, carried on from one to the next
        heads = F.aggregate(chunks, F.array(F.lit(-(1 << 31)).cast("int")), lambda a, c: F.concat(a, F.array(F.greatest(F.element_at(a, -1), F.array_max(c)))))
        within = lambda h: lambda c, k: F.transform(c, lambda x, i: F.greatest(F.get(h, k), F.array_max(F.slice(c, F.lit(1), i + 1))))
        return _let(heads, lambda h: F.flatten(F.transform(chunks, within(h))))

    return _let(values, lambda v: _let(chunked(v), carried))


def _judged(x: Column, near: Column) -> Column:
    """A span with the vote of company put before the others."""
    code = F.concat(F.when(near, F.lit("y")).otherwise(F.lit("n")), x["code"])
    return F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), code.alias("code"), x["base"].alias("base"))


def _apart(spans: Column) -> Column:
    """The base spans of the sorted spans, and the candidates that neither touch one nor start inside a span before them.

    Another base span within COMPANY characters is company.
    """
    far = F.lit((1 << 31) - 1)
    ends = _running_max(F.transform(spans, lambda x: x["end"]))
    bases = _running_max(F.transform(spans, lambda x: F.when(x["base"], x["end"]).otherwise(F.lit(-COMPANY - 1))))
    starts = F.reverse(_running_max(F.reverse(F.transform(spans, lambda x: -F.when(x["base"], x["start"]).otherwise(far)))))

    def keep(e: Column, s: Column, b: Column) -> Column:
        def one(x: Column, k: Column) -> Column:
            before, after = F.coalesce(F.get(b, k - 1), F.lit(-COMPANY - 1)), F.coalesce(-F.get(s, k + 1), far)
            free = (F.coalesce(F.get(e, k - 1), F.lit(-1)) <= x["start"]) & (after >= x["end"])
            near = (x["start"] - before <= COMPANY) | (after - x["end"] <= COMPANY)
            return F.when(x["base"] | free, _judged(x, near))

        return F.filter(F.transform(spans, one), lambda x: x.isNotNull())

    return _let(ends, lambda e: _let(starts, lambda s: _let(bases, lambda b: keep(e, s, b))))


def candidates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and spans (start, kind, end, code, base) of each row: base spans and the loose candidates that touch none.

    Spans are sorted by start and kind. Of candidates that overlap, the one
    that starts first counts. A null text is empty.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    none = F.array().cast("array<string>")
    for tag, patterns in (("s", STRICT), ("l", LOOSE)):
        hints = {k: F.col("t").rlike(HINT[k]) if tag == "l" else F.col("t").contains({"email": "@", "phone": "+"}.get(k, "")) for k in KINDS}
        rows = rows.withColumns({f"{tag}m_{k}": F.when(hints[k], F.regexp_extract_all("t", F.lit(p), F.lit(0))).otherwise(none) for k, p in patterns.items()})
        rows = rows.withColumns({f"{tag}_{k}": F.when(F.size(f"{tag}m_{k}") > 0, _located_in(F.split("t", p, -1), F.col(f"{tag}m_{k}"))).otherwise(F.array().cast(_SPAN)) for k, p in patterns.items()})
    strict = [_coded(k, _passing(k, F.col(f"s_{k}")), True) for k in KINDS]
    loose = [_coded(k, F.col(f"l_{k}"), False) for k in KINDS]
    rows = rows.select("doc_id", F.array_sort(F.concat(*strict, *loose)).alias("all"))

    return rows.select("doc_id", F.when(F.size("all") < 2, F.transform("all", lambda x: _judged(x, F.lit(False)))).otherwise(_apart(F.col("all"))).alias("spans"))


def _features(kind: int, code: str) -> tuple[float, ...]:
    votes = [1.0 if c == v else 0.0 for c in code[:-1] for v in "yn"]
    return (*votes, *[1.0 if k == kind else 0.0 for k in range(len(KINDS))], *[1.0 if int(code[-1]) == n else 0.0 for n in range(4)])


def accepted(found: DataFrame, threshold: float = 0.9) -> list[tuple[int, str]]:
    """The (kind, code) pairs that the span classifier accepts.

    Learned from the counts of codes, of which there are at most 4 * 2 * 3^5 * 4.
    Base spans are personal data for certain: they show how labelers vote on
    it, and how common it is among candidates follows from the candidates alone.
    """
    counted = found.select(F.explode("spans").alias("x")).groupBy("x.kind", "x.code", "x.base").count().collect()
    rows = []
    for kind in range(len(KINDS)):
        codes = {(r["code"], r["base"]): r["count"] for r in counted if r["kind"] == kind}
        patterns: dict[bool, dict[tuple[int, ...], int]] = {True: {}, False: {}}
        vote = lambda code: tuple({"y": 1, "n": -1, "-": 0}[c] for c in code[:-1])
        for (code, base), n in codes.items():
            patterns[base][vote(code)] = patterns[base].get(vote(code), 0) + n
        model = fit_votes(patterns[False], START, known=patterns[True])
        rows += [(_features(kind, code), 1.0 if base else model.posterior(vote(code)), float(n)) for (code, base), n in sorted(codes.items())]
    weights = fit_logistic(rows)
    return [(r["kind"], r["code"]) for r in counted if not r["base"] and logistic(weights, _features(r["kind"], r["code"])) >= threshold]


def personal_data(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the spans array of each row: base spans, and the candidates that the classifier accepts.

    Positions are code points, ends exclusive. Each row is searched whole and
    on its own; nothing but code counts is shuffled. Null and empty texts have
    no spans; on an empty table the result is empty.
    """
    found = materialise(candidates(docs, key=key, text=text))
    good = [f"{kind}{code}" for kind, code in accepted(found)]
    names = F.array(*[F.lit(g) for g in good]) if good else F.array().cast("array<string>")
    return found.select("doc_id", F.filter("spans", lambda x: x["base"] | F.array_contains(names, F.concat(x["kind"].cast("string"), x["code"]))).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data."""
    found = personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    counts = [_count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
