"""Personal data in texts, with DataFrame operations only.

Method: regular expressions propose spans; validators confirm them (Luhn for cards, part values for addresses, digit
counts for phone numbers, mod-97 for IBANs, group values for social security numbers); words nearby move a span's
score. E-mail, ip, card and phone spans that their validator confirms are always reported. IBANs need their checksum,
social security numbers a score of at least ``THRESHOLD``, which takes a word nearby.

The patterns below are written so that each scan of a text takes linear time: runs are consumed possessively and a
match starts at the beginning of a run or where the match before it ended. They match what the plain forms in the
comments match.

Defined results: a null text counts as empty and has no spans; positions are code points, ends exclusive; spans of
different kinds may overlap and are all reported; repeated rows give repeated results; an empty table gives an empty
table; other columns stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.5
#: Characters before and after a span in which context words count.
BEFORE, AFTER = 48, 24


@dataclass(frozen=True)
class Kind:
    name: str
    #: A text without a match of this has no span; cheaper than the pattern.
    hint: str
    pattern: str
    #: Words nearby that raise the score.
    words: str
    score: float


KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind(
        "email", "@",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "mail|contact|write", 0.8,
    ),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind(
        "ip", r"[0-9]\.[0-9]++\.[0-9]",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        "address|server|host|client|login", 0.6,
    ),
    # [0-9]([\x20-]?[0-9])+ of 14 digits and more
    Kind(
        "card", r"[0-9](?:[ -]?[0-9]){13}",
        r"[0-9](?:[ -]?[0-9]){13,}+",
        "card|credit|visa|payment|account", 0.6,
    ),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", "phone|call|tel|mobile|fax", 0.6),
    Kind(
        "iban", r"[A-Z]{2}[0-9]{2}",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        "iban|bank|account|transfer", 0.7,
    ),
    Kind(
        "ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        r"ssn|social security", 0.3,
    ),
)
BASE = ("email", "ip", "card", "phone")
#: The characters of an IBAN by its country code.
IBAN_LENGTHS = {
    code: n
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL SO", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV NI",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for code in codes.split()
}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _small_part(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) <= 3) & (F.coalesce(F.try_to_number(bare, F.lit("999")), F.lit(0)) <= 255)


def _mod97(value: Column) -> Column:
    bare = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))

    def add(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        letter = code >= F.lit(65)
        return (rest * F.when(letter, 100).otherwise(10) + code - F.when(letter, 55).otherwise(48)) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), add) == 1


def _confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), _small_part)
    if kind == "card":
        digits = _digits(value)
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(value, " ", "")).between(15, 34) & _mod97(value)
    if kind == "ssn":
        area = F.substr(value, F.lit(1), F.lit(3))
        return ~area.isin("000", "666") & (area < "900") & ~F.contains(value, F.lit("-00-")) & ~F.endswith(value, F.lit("-0000"))
    return F.lit(True)


SPAN = "array<struct<start: int, kind_order: int, end: int, kind: string, value: string, score: double>>"


def _iban(run: Column) -> Column:
    """The IBAN a run of groups begins with, else null: of its country's length, else the whole run; of a country not
    listed, the longest part up to a group's end that its checksum confirms."""
    lengths = F.create_map(*(F.lit(x) for item in IBAN_LENGTHS.items() for x in item))
    length = F.try_element_at(lengths, F.substr(run, F.lit(1), F.lit(2)))
    own = F.regexp_substr(run, F.concat(F.lit("^(?: ?[A-Z0-9]){"), length.cast("string"), F.lit("}(?![A-Za-z0-9])")))
    groups = F.split(run, " ")
    heads = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(groups, F.lit(1), n), " "))
    tried = F.when(length.isNull(), heads).otherwise(F.array(own, run))
    return F.try_element_at(F.filter(tried, lambda v: _confirmed("iban", v)), F.lit(1))


def _iban_places(kind: Kind, text: Column) -> Column:
    """Confirmed IBANs: a run is looked at from every place where one can begin, as the groups behind an IBAN may belong to
    the next; of overlapping ones the first stays."""
    first = kind.pattern.replace("[A-Z]{2}", "[A-Z](?=[A-Z]", 1) + ")"
    gaps = F.split(text, first, -1)
    # a match is one character, so each gap begins one behind the end of the gap before it
    ends = F.aggregate(F.slice(gaps, F.lit(1), F.size(gaps) - 1), F.array(F.lit(0)), lambda done, g: F.array_append(done, F.element_at(done, -1) + F.length(g) + 1))
    runs = F.transform(F.slice(ends, F.lit(2), F.size(ends)), lambda e: F.struct(
        e.alias("begin"), _iban(F.regexp_extract(F.substr(text, e, F.lit(64)), "^" + kind.pattern, 0)).alias("value")
    ))
    placed = F.transform(F.filter(runs, lambda s: s["value"].isNotNull()), lambda s: F.struct(
        s["value"].alias("value"), (s["begin"] - 1 + F.length(s["value"])).alias("end")
    ))
    none = F.array().cast("array<struct<value: string, end: int>>")
    return F.aggregate(placed, none, lambda done, s: F.when(
        (F.size(done) == 0) | (s["end"] - F.length(s["value"]) >= F.try_element_at(done, F.lit(-1))["end"]), F.array_append(done, s)
    ).otherwise(done))


def _spans(kind: Kind, order: int, text: Column) -> Column:
    """Confirmed spans of one kind: texts between the matches give the positions."""
    values = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    sizes = F.zip_with(gaps, values, lambda g, v: F.struct(F.length(g).alias("gap"), F.coalesce(F.length(v), F.lit(0)).alias("own")))
    # ends of the matches; the entry behind the last gap has no match and is cut off
    ends = F.aggregate(
        sizes, F.array(F.lit(0)),
        lambda done, s: F.array_append(done, F.element_at(done, -1) + s["gap"] + s["own"]),
    )
    placed = F.zip_with(values, F.slice(ends, F.lit(2), F.size(values)), lambda v, e: F.struct(v.alias("value"), e.alias("end")))
    placed = _iban_places(kind, text) if kind.name == "iban" else F.filter(placed, lambda s: _confirmed(kind.name, s["value"]))

    def judged(s: Column) -> Column:
        start = s["end"] - F.length(s["value"])
        begin = F.greatest(start - BEFORE, F.lit(0))
        near = F.lower(F.substr(text, begin + 1, s["end"] - begin + AFTER))
        score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(F.rlike(near, F.lit(rf"\b(?:{kind.words})")), 0.3).otherwise(0.0))
        return F.struct(
            start.alias("start"), F.lit(order).alias("kind_order"), s["end"].alias("end"), F.lit(kind.name).alias("kind"),
            s["value"].alias("value"), score.alias("score"),
        )

    found = F.transform(placed, judged)
    if kind.name not in BASE:
        found = F.filter(found, lambda s: s["score"] >= THRESHOLD)
    return F.when(F.rlike(text, F.lit(kind.hint)), found.cast(SPAN)).otherwise(F.array().cast(SPAN))


def find(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with the spans of its text in column ``out``, by start, then kind; it replaces a column of that name."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    kinds = [_spans(kind, i, whole) for i, kind in enumerate(KINDS)]
    return docs.withColumn(out, F.array_sort(F.concat(*kinds)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of personal data in its text replaced by its kind in brackets.

    Of overlapping spans the first is replaced as one with what overlaps it. Null texts stay null.
    """
    found = find(docs, text, "__pii")
    whole = F.col(text).cast("string")

    def add(done: Column, s: Column) -> Column:
        fresh = s["start"] >= done["at"]
        return F.struct(
            F.when(fresh, F.array_append(
                done["parts"], F.concat(F.substr(whole, done["at"] + 1, s["start"] - done["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
            )).otherwise(done["parts"]).alias("parts"),
            F.greatest(done["at"], s["end"]).alias("at"),
        )

    begin = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))
    clean = F.aggregate(
        "__pii", begin, add,
        lambda done: F.concat(F.concat_ws("", done["parts"]), F.substr(whole, done["at"] + 1)),
    )
    changed = F.when(F.size("__pii") > 0, clean).otherwise(whole)
    return found.withColumn(text, changed).drop("__pii")


def redact_documents(docs: DataFrame) -> DataFrame:
    """``redact`` on a table of documents; ``n_chars`` becomes the length of texts that changed."""
    before = docs.withColumn("__before", F.col("text"))
    after = redact(before)
    changed = ~F.col("text").eqNullSafe(F.col("__before"))
    size = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return after.withColumn("n_chars", size).drop("__before")
