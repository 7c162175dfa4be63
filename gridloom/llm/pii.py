"""Personal data in texts, with DataFrame functions only: patterns propose, checksums confirm, context adjusts.

Four kinds are always reported when pattern and digits hold: e-mail addresses, IPv4 addresses, card numbers
(Luhn) and telephone numbers. Account numbers (IBAN, modulo 97), long hexadecimal secrets and national
numbers are added when their score reaches ``LEAST``; a score starts from the kind, rises with a passed
checksum and with a context word in the 40 characters before the span.

Matches are leftmost and do not overlap within a kind; a match that fails its check is dropped and not tried
again. Places count code points, ends are exclusive. Null and empty texts have no spans; rows without id or
with the id of another row are rows like all others. A place is found by adding up the lengths of what lies
between the matches, so no pattern runs more than twice. Running sums and cuts go by blocks of ``BLOCK``
matches, so a text with 100,000 matches is a matter of seconds. :func:`find` replaces a column of the name it
is given, :func:`redact` leaves all columns but the text and n_chars alone, whatever their names.

Possessive loops and the look-behinds before runs keep every pattern linear on long texts; they don't change
what matches.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.7
#: Matches of a text that are added up, or cut out of it, together.
BLOCK = 512
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str
    base: float
    needs: str = ""
    check: str = ""
    always: bool = False


#: In the order of reports.
KINDS = (
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", "mail|contact|write", 0.9, "@", always=True),
    Kind("ip", r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}", r"\bip\b|address|host|server", 0.6, ".", "octets", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "card|visa|payment|credit", 0.4, "", "luhn", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "phone|call|tel|mobile", 0.5, "+", "phone", True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "iban|account|bank", 0.4, "", "mod97"),
    Kind("secret", r"(?<![A-Za-z0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])", "token|secret|passw|api.?key|credential", 0.4),
    Kind("national", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "ssn|social|national", 0.4),
)
_CHECKED, _NEAR = 0.35, 0.3


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    """From the right every second digit doubled, 9 taken off above 9; the sum ends in 0."""
    n = F.split(F.reverse(_digits(match)), "")
    value = F.transform(F.filter(n, lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(value, F.lit(0), lambda a, b: a + b) % 10 == 0


def _mod97(match: Column) -> Column:
    """The first four characters go to the end, letters count from 10; the rest of 97 is 1."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    code = F.filter(F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), ""), lambda c: c != "")
    return F.aggregate(code, F.lit(0), lambda a, c: F.when(F.ascii(c) < 58, a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97) == 1


def _passes(check: str, match: Column) -> Column:
    if check == "octets":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))
    if check == "luhn":
        return F.when(F.length(_digits(match)).between(13, 19), _luhn(match)).otherwise(False)
    if check == "phone":
        return F.length(_digits(match)).between(9, 15)
    if check == "mod97":
        return F.when(F.length(F.replace(match, F.lit(" "), F.lit(""))).between(15, 34), _mod97(match)).otherwise(False)
    return F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(values: Column) -> Column:
    """An array (not empty) as an array of runs of ``BLOCK`` elements."""
    return _let(values, lambda v: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))


def _before(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Per element of an integer array (not empty) all earlier ones joined, 0 before the first. Whole blocks are
    joined first, then the elements of each."""

    def scan(part, start):
        return F.aggregate(part, F.array(start), lambda acc, x: F.concat(acc, F.array(join(F.element_at(acc, -1), x))), lambda acc: F.slice(acc, F.lit(1), F.size(acc) - 1))

    def inside(blocks):
        starts = scan(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), join)), F.lit(0))
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), starts.alias("at")), lambda z: scan(z["b"], z["at"])))

    return _let(_blocks(values), inside)


_SPAN = "struct<kind:string,start:int,end:int,score:double>"


def _spans(text: Column, kind: Kind) -> Column:
    """array<struct<kind,start,end,score>> of one kind."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pairs = F.arrays_zip(found.alias("m"), F.split(text, kind.pattern, -1).alias("gap"))

    def place(pairs):
        lengths = F.transform(pairs, lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["m"]), F.lit(0)))
        both = F.filter(F.arrays_zip(pairs.alias("p"), _before(lengths, lambda a, b: a + b).alias("at")), lambda z: z["p"]["m"].isNotNull())

        def row(z):
            start = z["at"] + F.length(z["p"]["gap"])
            return F.struct(z["p"]["m"].alias("m"), F.lower(F.right(z["p"]["gap"], F.lit(40))).alias("near"), start.alias("start"), (start + F.length(z["p"]["m"])).alias("end"))

        return F.transform(both, row)

    placed = _let(pairs, place)
    passed = F.filter(placed, lambda s: _passes(kind.check, s["m"]))
    scored = F.transform(passed, lambda s: F.struct(
        F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        F.least(F.lit(1.0), F.lit(kind.base + (_CHECKED if kind.check else 0)) + F.when(s["near"].rlike(kind.hint), _NEAR).otherwise(0.0)).alias("score")))
    kept = scored if kind.always else F.filter(scored, lambda s: s["score"] >= LEAST)
    guard = text.contains(kind.needs) if kind.needs else text.rlike("[0-9]")
    return F.when(guard & F.regexp_like(text, F.lit(kind.pattern)), kept).otherwise(F.array().cast(f"array<{_SPAN}>"))


def find(docs: DataFrame, name: str = "findings", text: str = "text") -> DataFrame:
    """``docs`` and an array of spans (kind, start, end, score), by kind as in KINDS, then by start."""
    return docs.withColumn(name, F.concat(*[_spans(F.coalesce(F.col(text), F.lit("")), k) for k in KINDS]))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, numbers of the four base kinds, SHA-256 of their spans, all spans as text."""
    found = find(docs.select("doc_id", "text")).drop("text")
    base = [k.name for k in KINDS if k.always]

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    spans = F.col("findings")
    return found.select(
        "doc_id", *[number(b).alias(f"n_{b}") for b in base],
        F.sha2(listed(F.filter(spans, lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), listed(spans).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span, overlapping ones as one, replaced by its first kind in brackets; n_chars,
    if there is such a column, follows. Same columns."""
    from gridloom.llm.flat import fresh

    name = fresh(docs, "_findings")
    whole = F.coalesce(F.col(text), F.lit(""))
    ordered = F.array_sort(F.transform(F.col(name), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def cut(spans):
        reached = _before(F.transform(spans, lambda s: -s["back"]), lambda a, b: F.greatest(a, b))
        heads = F.filter(F.arrays_zip(spans.alias("s"), reached.alias("at")), lambda z: z["s"]["start"] >= z["at"])

        def pieces(block):
            first = F.get(block, F.lit(0))["at"]
            part = F.substring(whole, first + 1, F.element_at(block, -1)["s"]["start"] - first)
            return _let(F.struct(part.alias("text"), first.alias("at")), lambda c: F.transform(block, lambda z: F.concat(
                F.substring(c["text"], z["at"] - c["at"] + 1, z["s"]["start"] - z["at"]), F.lit("["), F.upper(z["s"]["kind"]), F.lit("]"))))

        last = F.array_max(F.transform(spans, lambda s: -s["back"]))
        return F.concat(F.array_join(F.flatten(F.transform(_blocks(heads), pieces)), ""), F.substring(whole, last + 1, F.length(whole)))

    clean = _let(ordered, cut)
    out = find(docs, name, text).withColumn(text, F.when(F.size(name) > 0, clean).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(name) > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
