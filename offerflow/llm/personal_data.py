"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

SQL functions only. A text is cut at the matches of each kind; the lengths of what lies between
give the places of the matches in code points, and the ends of the pieces beside a match are
where context words are looked for. Patterns never go back over what they have taken, so a
text of one long run of digits or letters costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerflow.llm.common import KEY, row_key, text_of

#: Characters looked at before and after a match for context words.
BEFORE, AFTER = 40, 20
#: What a word that speaks for or against a kind adds to a score or takes from it.
WORD_SCORE = 35
#: Proposed spans beyond the base kinds are kept from this score on.
MIN_SCORE = 50
#: Matches summed at once for their places.
RUN = 512

# Lengths of account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18,
    "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23,
    "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15,
    "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26}

_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_NUMBER = r"[+(]?[0-9]++(?:\)?[\x20.-]?\(?[0-9]++)*+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def weighed(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(F.transform(places, weighed), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod_97(account: Column) -> Column:
    """Whether capital letters and digits, the first four moved to the end, leave 1 by 97."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))

    def more(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(code <= 57, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(account)), F.lit(0), more) == 1


def _is_card(m: Column) -> Column:
    return let(F.when(F.length(m) <= 37, _digits(m)).otherwise(""),
               lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))


def _iban_width(m: Column) -> Column:
    """Characters of the match that its country's account numbers have; 0 for no country."""
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    n = F.coalesce(F.try_element_at(lengths, F.substr(m, F.lit(1), F.lit(2))), F.lit(0))
    return F.when(F.substr(m, F.lit(5), F.lit(1)) == " ", n + F.floor((n - 1) / 4)).otherwise(n).cast("int")


def _is_iban(m: Column) -> Column:
    width = _iban_width(m)
    return let(F.replace(F.substr(m, F.lit(1), width), F.lit(" "), F.lit("")),
               lambda a: F.when((width > 0) & (F.length(m) >= width), mod_97(a)).otherwise(False))


@dataclass(frozen=True)
class Kind:
    """A pattern, what confirms a match, the score it then has, and the words that raise or
    lower it; ``width`` is the length of the span where it is not the whole match. A kind that is not
    ``base`` is kept by its score only, and where no letter or digit stands before it."""

    name: str
    pattern: str
    confirms: Callable[[Column], Column]
    score: int
    up: str
    down: str = "version|release|isbn|order|invoice|figure"
    base: bool = True
    width: Callable[[Column], Column] = F.length


# The base patterns are fixed values; possessive forms of them find the same matches.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda m: F.lit(True), 80, "e-?mail|mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
         lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), 50, "ip|address|host|server|login|client"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _is_card, 70, "card|visa|mastercard|amex|credit|debit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]",
         lambda m: F.length(_digits(m)).between(9, 15), 60, "phone|tel|telephone|call|mobile|cell|fax"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})",
         _is_iban, 85, "iban|account|konto|compte|cuenta|bank", base=False, width=_iban_width),
    Kind("ssn", _NUMBER, lambda m: m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), 25,
         "ssn|social security(?: number| no)?", base=False),
    Kind("local_phone", _NUMBER, lambda m: m.rlike(r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$"), 25,
         "phone|tel|telephone|call|mobile|cell|fax", base=False),
)
SPAN = "struct<kind:string,start:long,end:long,score:int>"


def _said(words: str, near: Column) -> Column:
    return near.rlike(f"(?i)(?:^|[^a-z])(?:{words})(?:[^a-z]|$)")


def _total(part: Column) -> Column:
    return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)


def _before_runs(steps: Column) -> Column:
    """What all runs of :data:`RUN` steps before each run add up to."""
    runs = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / RUN).cast("int"))
    sums = F.transform(runs, lambda r: _total(F.slice(steps, r * RUN + 1, F.lit(RUN))))
    return let(sums, lambda s: F.transform(runs, lambda r: _total(F.slice(s, F.lit(1), r))))


def spans_of(text: Column, kind: Kind, min_score: int = MIN_SCORE) -> Column:
    """The spans of one kind, in order, as an array of :data:`SPAN`."""
    def located(found: Column, gaps: Column) -> Column:
        steps = F.transform(found, lambda m, i: (F.length(F.get(gaps, i)) + F.length(m)).cast("long"))

        def spans(lengths: Column, runs: Column) -> Column:
            def span(m: Column, i: Column) -> Column:
                near = F.concat(F.right(F.get(gaps, i), F.lit(BEFORE)), F.lit(" | "),
                                F.left(F.get(gaps, i + 1), F.lit(AFTER)))
                # only confirmed matches are placed
                start = (F.get(runs, F.floor(i / RUN).cast("int")) + _total(F.slice(lengths, i - i % RUN + 1, i % RUN))
                         + F.length(F.get(gaps, i)))
                ok = kind.confirms(m)
                if not kind.base:
                    ok = ok & ~F.get(gaps, i).rlike("[A-Za-z0-9]$") & ((i == 0) | (F.length(F.get(gaps, i)) > 0))

                def scored(by: Column) -> Column:
                    score = F.greatest(F.lit(0), F.least(F.lit(100), F.lit(kind.score) + by))
                    found_at = let(start, lambda at: F.struct(
                        F.lit(kind.name).alias("kind"), at.alias("start"), (at + kind.width(m)).alias("end"), score.alias("score")))
                    return found_at if kind.base else F.when(score >= min_score, found_at)

                def words(n: Column) -> Column:
                    return (F.when(_said(kind.up, n), WORD_SCORE).otherwise(0)
                            - F.when(_said(kind.down, n), WORD_SCORE).otherwise(0))

                return F.when(ok, let(let(near, words), scored))

            return F.filter(F.transform(found, span), lambda s: s.isNotNull())

        return let(steps, lambda lengths: let(_before_runs(lengths), lambda runs: spans(lengths, runs)))

    def cut(found: Column) -> Column:
        return F.when(F.size(found) > 0, let(F.split(text, kind.pattern, -1), lambda gaps: located(found, gaps)))

    none = F.array().cast(f"array<{SPAN}>")
    return F.coalesce(let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), cut), none)


def personal_spans(docs: DataFrame, min_score: int = MIN_SCORE, doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """One row per document: the row key, doc_id, one array of spans per kind, ``base`` (the spans of
    the base kinds) and ``spans`` (all), by kind and then start, each with its score of 0 to 100.

    Base kinds are kept whatever their score; account numbers (mod 97), social security and local phone
    numbers come by score. Spans of different kinds may overlap. Null text is empty; repeated rows are
    scanned each; other columns are not read, so their names cannot clash; an empty table gives
    no rows. Nothing is shuffled: a hot group is no group here."""
    rows = docs.select(*row_key(docs, doc_id), F.col(f"`{doc_id}`").alias("doc_id"),
                       text_of(f"`{text}`").alias("_text"))
    found = rows.select(*KEY, "doc_id", *[
        spans_of(F.col("_text"), kind, min_score).alias(kind.name) for kind in KINDS])
    return found.select("*", F.concat(*[F.col(k.name) for k in KINDS if k.base]).alias("base"),
                        F.concat(*[F.col(k.name) for k in KINDS]).alias("spans"))


def span_text(spans: str) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
