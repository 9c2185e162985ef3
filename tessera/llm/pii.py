"""Personal data: regular expressions propose spans, validators confirm them, words nearby adjust their scores.

All of it is built-in column functions over one row at a time, so a text never leaves the JVM and nothing is shuffled.
Spark has no function that returns the offsets of matches, so they come from the text's pieces: splitting at a pattern
gives the gaps between its matches, and a running sum of the lengths of gaps and matches gives every start and end. The
patterns start only where a run of their first characters starts or the last match ended, and their loops never give
back, so that a long run without a match costs one pass.

An account number may be followed, or preceded, by groups that look like more of it. So its pattern finds every place
where one may start and looks ahead for the longest run of groups; the longest part of these groups that mod-97 confirms
is the span, from left to right and without overlaps.

Words on either side raise or lower a span's score. The kinds of the contract don't depend on it; the kinds added here
do, and a run of letters and digits is a secret, or three groups of digits a social security number, only by such a word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL = "A-Za-z0-9._%+-"
#: How many characters on either side of a span may hold a word that adjusts its score; what such a word adds or takes;
#: and the least score of a span of the kinds that the method adds.
NEAR, RAISED, LOWERED, LEAST = 48, 30, 30, 40
#: Characters at the start of an account number that its pattern takes, and the fewest it has without spaces.
HEAD, SHORTEST = 4, 15
#: Words near a span that lower any score, as in a version, a digest or an example.
AGAINST = "version|ver|build|release|isbn|sku|example|order|invoice|commit|checksum|digest|sha1|sha256|md5"
#: Forms of access keys that say themselves what they are.
KEY_FORMS = r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|AIza[A-Za-z0-9_-]{35}|xox[abprs]-[A-Za-z0-9-]{10,}"


#: Words before or after a run of letters and digits that make it a secret.
SECRET_WORDS = "password|passwd|pwd|passphrase|secret|token|api_key|api-key|apikey|api key|bearer|credential|credentials"


@dataclass(frozen=True)
class Kind:
    """What is looked for, what any text with a match holds, the score of a match in per cent and words for it.

    Spans of base kinds stay whatever their score; others need ``LEAST``, so a kind of a lower score needs one of its words.
    """

    name: str
    pattern: str
    sign: str
    score: int
    words: str
    base: bool = True
    group: int = 0


KINDS = (
    Kind("email", rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 90, "mail|email|e-mail|contact|write|reply"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+", "[.]", 60, "ip|host|server|address|addr|login|client"),
    Kind("card", r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?+[0-9])++", "", 80, "card|visa|mastercard|amex|credit|debit|pay|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "[+]", 60, "phone|tel|telephone|call|mobile|fax|sms|whatsapp"),
    Kind("iban", r"(?<![A-Za-z0-9_])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9_])))[A-Z]{2}[0-9]{2}", "", 80, "iban|account|bank|konto|compte|cuenta|transfer", base=False, group=1),
    Kind("key", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{15,}+", "AKIA|ASIA|gh[pousr]_|AIza|xox[abprs]-", 80, "key|token|aws|access|credential|credentials", base=False),
    Kind("secret", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{15,}+", f"(?i){SECRET_WORDS}", 20, SECRET_WORDS, base=False),
    Kind("ssn", r"(?:(?<![0-9-])|\G)[0-9-]{11,}+", "[0-9]{3}-[0-9]{2}-[0-9]{4}", 20, "ssn|social security|social security number", base=False),
)


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def mod_97(match: Column) -> Column:
    """ISO 7064: the first four characters go last, letters count from 10, and the number's remainder is 1."""
    compact = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(compact, F.lit(5)), F.left(compact, F.lit(4)))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda r, c: (r * F.when(c.between("0", "9"), F.lit(10)).otherwise(F.lit(100)) + value(c)) % 97
    return F.aggregate(F.split(turned, "(?!^)(?!$)"), F.lit(0), step) == 1


def confirmed(kind: Kind, match: Column) -> Column:
    if kind.name == "ip":
        return F.forall(F.split(match, r"\."), lambda part: part.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind.name == "card":
        digits = digits_of(match)
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind.name == "phone":
        return F.length(digits_of(match)).between(8, 15)
    if kind.name == "key":
        return match.rlike(f"^(?:{KEY_FORMS})$")
    if kind.name == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    if kind.name == "ssn":
        return match.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
    return F.lit(True)


def score_of(kind: Kind, before: Column, after: Column) -> Column:
    """A kind's score, raised by a word for it on either side, up to 100, and lowered by one against it."""
    sides = F.lower(F.concat(before, F.lit("\n"), after))
    says = lambda words: sides.rlike(rf"(^|[^a-z0-9])({words})([^a-z0-9]|$)")
    return F.least(F.lit(100), F.lit(kind.score) + F.when(says(kind.words), RAISED).otherwise(0)) - F.when(says(AGAINST), LOWERED).otherwise(0)


def proposed(docs: DataFrame, text: Column, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with a column _m_<kind> of what each pattern matches, left to right; a null text has no match."""
    none = F.array().cast("array<string>")
    found = {f"_m_{k.name}": F.when(text.rlike(k.sign) if k.sign else text.isNotNull(), F.regexp_extract_all(text, F.lit(k.pattern), F.lit(k.group))).otherwise(none) for k in kinds}
    return docs.withColumns(found)


def pieces(kind: Kind, text: Column) -> Column:
    """gap, match, after: each match of a kind with the gaps before and after it, and last the rest of the text with no match."""
    gaps = F.split(text, kind.pattern, -1)
    each = F.zip_with(gaps, F.col(f"_m_{kind.name}"), lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")))
    return F.zip_with(each, F.slice(gaps, F.lit(2), F.size(gaps)), lambda p, after: F.struct(p["gap"].alias("gap"), p["match"].alias("match"), F.left(after, F.lit(NEAR)).alias("after")))


SPAN = "array<struct<kind:string,start:long,end:long,match:string,score:long>>"


def longest(match: Column) -> Column:
    """The most of a match's groups, from its first, that mod-97 confirms; null: none."""
    groups = F.split(match, " ")
    parts = F.transform(F.sequence(F.lit(1), F.size(groups)), lambda n: F.array_join(F.slice(groups, F.lit(1), n), " "))
    return F.try_element_at(F.filter(parts, lambda p: (F.length(F.replace(p, F.lit(" "), F.lit(""))) >= SHORTEST) & mod_97(p)), F.lit(-1))


def account_spans(kind: Kind, text: Column) -> Column:
    """As ``spans_of``, of a kind whose pattern takes only the start of what it looks ahead for."""
    heads = F.transform(F.filter(pieces(kind, text), lambda p: p["match"].isNotNull()), lambda p: F.struct(F.length(p["gap"]).alias("gap"), longest(p["match"]).alias("match")))
    state = f"struct<at:int,end:int,spans:{SPAN}>"

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + F.length(p["match"])
        before = F.substring(text, F.greatest(start - NEAR, F.lit(0)) + 1, F.least(start, F.lit(NEAR)))
        score = score_of(kind, before, F.substring(text, end + 1, F.lit(NEAR)))
        span = F.struct(F.lit(kind.name).alias("kind"), start.cast("long").alias("start"), end.cast("long").alias("end"), p["match"].alias("match"), score.cast("long").alias("score"))
        taken = p["match"].isNotNull() & (start >= acc["end"])
        return F.struct((start + HEAD).alias("at"), F.when(taken, end).otherwise(acc["end"]).alias("end"), F.when(taken, F.concat(acc["spans"], F.array(span).cast(SPAN))).otherwise(acc["spans"]).alias("spans")).cast(state)

    none = F.struct(F.lit(0).alias("at"), F.lit(0).alias("end"), F.array().cast(SPAN).alias("spans")).cast(state)
    found = F.aggregate(heads, none, step, lambda acc: acc["spans"])
    return F.when(F.size(f"_m_{kind.name}") > 0, F.filter(found, lambda s: F.lit(kind.base) | (s["score"] >= LEAST))).otherwise(F.array().cast(SPAN))


def scored(kind: Kind, piece: Column) -> Column:
    """``score_of`` by what stands around a match, no further than the next match of its kind on either side."""
    return score_of(kind, F.right(piece["gap"], F.lit(NEAR)), F.coalesce(piece["after"], F.lit("")))


def spans_of(kind: Kind, text: Column) -> Column:
    """The confirmed spans of a kind in code points; ``proposed`` was applied before."""
    if kind.group:
        return account_spans(kind, text)
    start = lambda acc, p: F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0).cast("long")) + F.length(p["gap"])

    def step(acc: Column, p: Column) -> Column:
        at = start(acc, p)
        span = F.struct(F.lit(kind.name).alias("kind"), at.cast("long").alias("start"), (at + F.length(p["match"])).cast("long").alias("end"), p["match"].alias("match"), scored(kind, p).cast("long").alias("score"))
        return F.concat(acc, F.array(span).cast(SPAN))

    ends = F.aggregate(F.filter(pieces(kind, text), lambda p: p["match"].isNotNull()), F.array().cast(SPAN), step)
    keep = lambda s: confirmed(kind, s["match"]) & (F.lit(kind.base) | (s["score"] >= LEAST))
    return F.when(F.size(f"_m_{kind.name}") > 0, F.filter(ends, keep)).otherwise(F.array().cast(SPAN))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, and a column <kind> of the spans of each kind, by start: kind, start, end (code points), match, score.

    Spans of one kind don't overlap. A null or empty text has none; repeated rows give repeated results; other columns
    are ignored, whatever their names; an empty table gives an empty one. The length of a text and the number of its spans
    aren't bounded. Scores are per cent: a kind's own, raised or lowered by words within ``NEAR`` characters of the span.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return proposed(rows, F.col("text")).select("doc_id", *(spans_of(k, F.col("text")).alias(k.name) for k in KINDS))


def span_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_<base kind>, base_sha256, spans (kind:start:end by kind, then start) and top_score, the greatest of all (null: none)."""
    found = find_spans(docs)
    base = [k for k in KINDS if k.base]
    text = lambda kinds: F.array_join(F.transform(F.concat(*(F.col(k.name) for k in kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    top = F.array_max(F.transform(F.concat(*(F.col(k.name) for k in KINDS)), lambda s: s["score"]))
    return found.select("doc_id", *(F.size(k.name).cast("long").alias(f"n_{k.name}") for k in base), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(KINDS).alias("spans"), top.alias("top_score"))


#: Code points of the parts in which a text is cut before spans are taken out, so that no cut reads more than its own parts.
PART = 1024


def replaced(text: Column, spans: Column) -> tuple[Column, Column]:
    """The parts of a text, to be held as _parts, and the text with its ``spans`` of all kinds replaced by their kinds.

    What overlapping spans cover is one, of the first of them.
    """
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
    state = "struct<at:long,out:array<string>>"

    def between(a: Column, b: Column) -> Column:
        first = F.floor(a / PART)
        joined = F.array_join(F.slice("_parts", (first + 1).cast("int"), (F.floor((b - 1) / PART) - first + 1).cast("int")), "")
        return F.when(b > a, F.substring(joined, (a - first * PART + 1).cast("int"), (b - a).cast("int"))).otherwise(F.lit(""))

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        tag = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        out = F.when(new, F.concat(acc["out"], F.array(between(acc["at"], s["start"]), tag))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out")).cast(state)

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"), s["end"].alias("end"))))
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")).cast(state)
    whole = F.aggregate(ordered, none, step, lambda acc: F.array_join(F.concat(acc["out"], F.array(between(acc["at"], F.length(text).cast("long")))), ""))
    return parts, whole


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every confirmed span of ``text_col``, those of ``find_spans``, replaced by its kind in brackets.

    Spans are all found in the text as it is. Where spans of several kinds overlap, what they cover together is replaced by
    the kind of the one that starts first, of several the longest, then the first by name. Null texts stay null; columns
    and their order stay, an empty table too.
    """
    columns, text = docs.columns, F.col("text")
    rows = docs.select(F.struct(*columns).alias("row"), F.col(text_col).cast("string").alias("text"))
    found = proposed(rows, text).select("row", "text", F.concat(*(spans_of(k, text) for k in KINDS)).alias("_spans"))
    parts, whole = replaced(text, F.col("_spans"))
    out = found.withColumn("_parts", F.when(F.size("_spans") > 0, parts)).select("row", F.when(F.size("_spans") > 0, whole).otherwise(text).alias("text"))
    return out.select(*(text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in columns))
