"""Personal data in text, by DataFrame functions alone.

Regular expressions propose spans; checks (parts of an address, Luhn, modulo 97, digit counts)
confirm them; words near a span adjust its score, and kinds without a check of their own
count only when such words stand near.

Kinds in order of ties: email, ip, card, phone (the base kinds, each leftmost and
non-overlapping, dropped without a retry when the check fails), then iban, ssn, local_phone,
which need their check, or their context, or both.  Spans are (kind, start, end, score) in code
points, end exclusive.  A null text is empty; empty tables, repeated rows and other columns pass
through.  The patterns begin runs only at their first character or where the last match ended
(\\G), and use loops that need no stack, so very long words and numbers are scanned in linear time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL = r"[A-Za-z0-9._%+\-]"
LABEL = r"[A-Za-z0-9\-]"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: Only texts that contain this are searched.
    needs: str
    #: Score of a confirmed span alone, and what a context word adds.
    score: float
    context: str
    context_score: float


KINDS = (
    Kind("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++\.{LABEL}(?:[A-Za-z0-9.\-](?<={LABEL}|\.(?={LABEL})))*+", "@", 0.9, r"(?i)mail|contact|write|address|kontakt|correo|courriel", 0.1),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.7, r"(?i)\bip\b|server|host|address|login|adresse", 0.2),
    Kind("card", r"[0-9](?:[0-9 \-](?<=[0-9]|[0-9][ \-](?=[0-9])))++", "", 0.8, r"(?i)card|visa|master|amex|credit|payment|karte|carte|tarjeta", 0.2),
    Kind("phone", r"\+[0-9][ ().0-9\-]+[0-9]", "+", 0.7, r"(?i)phone|tel|call|fax|mobile|cell|anruf|appel|llam", 0.2),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", 0.8, r"(?i)iban|bank|account|konto|compte|cuenta|transfer", 0.2),
    Kind("ssn", r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])", "-", 0.4, r"(?i)ssn|social security|tax id|taxpayer", 0.5),
    Kind("local_phone", r"(?<![0-9+)\-.])\(?[0-9]{3}\)?[ .\-][0-9]{3}[ .\-][0-9]{4}(?![0-9\-])", "", 0.4, r"(?i)phone|\btel\b|\bcall\b|\bfax\b|mobile", 0.4),
)
BASE = ("email", "ip", "card", "phone")
#: Additional kinds count from this score on.
ENOUGH = 0.6
#: Code points before and after a span that count as near.
NEAR = 40


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def value(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without blanks passes the modulo 97 check (country and check digits last, A=10)."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _confirmed(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        d = _digits(x)
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(x)).between(10, 15)
    if kind == "iban":
        plain = F.replace(x, F.lit(" "))
        return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(False)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """body(value), the value being computed once however often it is used."""
    return F.transform(F.array(value), body)[0]


def _running(lengths: Column) -> Column:
    """Sums up to each item, in runs of the square root of their number, so that no array grows for long."""
    n = F.size(lengths)

    def runs(size: Column) -> Column:
        part = lambda c: F.slice(lengths, c * size + 1, size)
        total = lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y)
        numbers = F.sequence(F.lit(0), F.ceil(n / size).cast("int") - 1)

        def summed(c: Column, before: Column) -> Column:
            none = F.struct(before.alias("pos"), F.array().cast("array<int>").alias("out"))
            return F.aggregate(part(c), none, lambda a, y: F.struct((a["pos"] + y).alias("pos"), F.concat(a["out"], F.array(a["pos"] + y)).alias("out")), lambda a: a["out"])

        return _let(F.transform(numbers, lambda c: total(part(c))), lambda sums: F.flatten(F.transform(numbers, lambda c: summed(c, total(F.slice(sums, F.lit(1), c))))))

    return F.when(n > 0, _let(F.ceil(F.sqrt(F.greatest(n, F.lit(1)))).cast("int"), runs)).otherwise(F.array().cast("array<int>"))


#: So many pieces of a text on either side of a match hold all that is NEAR it, a match being two characters at least.
_AROUND = NEAR // 2


def _found(kind: Kind, text: str, hits: str) -> Column:
    """Spans of one kind: matches are laid between the parts that splitting by the same pattern leaves.

    Places come from running sums of lengths and context from the neighbouring parts; nothing is looked up from the text's start.
    """
    here = "array<struct<kind:string,rank:int,start:int,end:int,score:double>>"
    rank = [k.name for k in KINDS].index(kind.name)

    def scored(x: Column, pairs: Column, last: Column) -> Column:
        joined = lambda p: F.array_join(F.flatten(F.transform(p, lambda y: F.array(y["gap"], y["hit"]))), "")
        i = x["i"]
        first = F.greatest(i - _AROUND, F.lit(0))
        before = F.concat(joined(F.slice(pairs, first + 1, i - first)), F.get(pairs, i)["gap"])
        behind = F.concat(joined(F.slice(pairs, i + 2, F.lit(_AROUND + 1))), F.when(i + _AROUND + 2 > F.size(pairs), last).otherwise(""))
        near = F.concat(F.right(before, F.lit(NEAR)), F.lit("\n"), F.left(behind, F.lit(NEAR)))
        score = F.lit(kind.score) + F.when(near.rlike(kind.context), kind.context_score).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), F.lit(rank).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), score.alias("score"))

    def spans(both: Column) -> Column:
        pairs, ends, last = both["pairs"], both["ends"], both["last"]
        every = F.zip_with(F.transform(pairs, lambda p, i: F.struct(p["hit"].alias("hit"), i.alias("i"))), ends, lambda h, e: F.struct(h["hit"].alias("hit"), h["i"].alias("i"), (e - F.length(h["hit"])).alias("start"), e.alias("end")))
        found = F.transform(F.filter(every, lambda x: _confirmed(kind.name, x["hit"])), lambda x: scored(x, pairs, last))
        return found if kind.name in BASE else F.filter(found, lambda x: x["score"] >= ENOUGH)

    def laid(gaps: Column) -> Column:
        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), F.col(hits), lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
        return _let(pairs, lambda p: _let(F.struct(p.alias("pairs"), _running(F.transform(p, lambda y: F.length(y["gap"]) + F.length(y["hit"]))).alias("ends"), F.element_at(gaps, -1).alias("last")), spans))

    return F.when(F.size(hits) > 0, _let(F.split(F.col(text), kind.pattern, -1), laid)).otherwise(F.array()).cast(here)


def find_spans(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """Add the sorted spans of column `text` as column `into`; all other columns stay, whatever their names."""
    mark = "__pii_"
    df = docs.withColumn(f"{mark}text", F.coalesce(F.col(text), F.lit("")))
    for k in KINDS:
        hits = F.regexp_extract_all(F.col(f"{mark}text"), F.lit(k.pattern), F.lit(0))
        maybe = F.col(f"{mark}text").contains(k.needs) if k.needs else F.lit(True)
        df = df.withColumn(f"{mark}h_{k.name}", F.when(maybe, hits).otherwise(F.array().cast("array<string>")))
    for k in KINDS:
        df = df.withColumn(f"{mark}s_{k.name}", _found(k, f"{mark}text", f"{mark}h_{k.name}"))

    def order(a: Column, b: Column) -> Column:
        key = lambda x: x["start"].cast("long") * F.lit(16) + x["rank"]
        return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)

    every = F.flatten(F.array(*[F.col(f"{mark}s_{k.name}") for k in KINDS]))
    df = df.withColumn(into, F.array_sort(every, order))
    return df.drop(f"{mark}text", *(f"{mark}{x}_{k.name}" for x in "hs" for k in KINDS))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span by its kind in brackets; overlapping spans are replaced once, by the earlier kind."""
    spans, mark = "__spans_found", F.col("__spans_found")

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["pos"]
        out = F.concat(acc["out"], F.substr(F.col(text), acc["pos"] + 1, s["start"] - acc["pos"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(fresh, out).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(mark, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substr(F.col(text), a["pos"] + 1)))
    return find_spans(docs, text, spans).withColumn(text, F.when(F.size(mark) > 0, done).otherwise(F.col(text))).drop(spans)
