"""Personal data in whole texts, with built-in functions only.

Regular expressions propose spans, checksum validators confirm them (Luhn for cards, mod 97 for
account numbers), and words close before a span raise its score. The base kinds (email, ip, card,
phone) stay whatever their score; the kinds that this method adds (iban, ssn) need a score of
``LEAST_SCORE``: an account number reaches it by its checksum, a social security number only beside a
word that names it.

A text is marked with one private character around each match and cut there, so that the lengths of the
pieces give the places. Patterns use possessive quantifiers and start at the beginning of a run only,
which finds the same leftmost matches in time linear in the text, without deep recursion.

Defined results: a null or empty text has no spans. Places count code points, the end is exclusive.
Kinds may overlap each other. Equal texts get equal spans; other columns stay as they are,
one named as the result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import unused_name

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]
LEAST_SCORE = 0.5
#: Characters before a span in which context words count.
CONTEXT = 40
#: Pieces of a text between marks that are worked on at once; an even number.
CHUNK = 256
_MARK, _OTHER = "\ue000", "\ue001"
#: Score of a confirmed span, what a context word adds, and the words.
SCORES = {
    "email": (0.9, 0.05, "mail|contact|write"),
    "ip": (0.6, 0.2, "ip|host|server|address"),
    "card": (0.8, 0.15, "card|visa|credit|pay"),
    "phone": (0.7, 0.2, "phone|tel|call|mobile|fax"),
    "iban": (0.7, 0.2, "iban|account|bank"),
    "ssn": (0.3, 0.4, "ssn|social security"),
}
#: A start that cannot lie inside an earlier run is left out: such a match would have started earlier.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
#: A text without this character has no span of the kind.
_NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True for a run of digits whose Luhn sum is a multiple of ten."""

    def added(total: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        double = (F.char_length(digits) - i) % 2 == 1
        return total + F.when(double, digit * 2 - F.when(digit > 4, 9).otherwise(0)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), added) % 10 == 0


def mod97(account: Column) -> Column:
    """True for an account number (letters and digits) whose rearranged value leaves 1."""
    turned = F.concat(F.substring(account, 5, 100), F.substring(account, 1, 4))

    def added(rest: Column, char: Column) -> Column:
        letter = F.ascii(char) >= 65
        return (rest * F.when(letter, 100).otherwise(10) + F.ascii(char) - F.when(letter, 55).otherwise(48)) % 97

    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), added) == 1


def _standalone(before: Column, after: Column, inside: str) -> Column:
    return ~before.rlike(f"{inside}$") & ~after.rlike(f"^{inside}")


def _confirmed(kind: str, found: Column, before: Column, after: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return found.rlike(rf"^(?:{part}\.){{3}}{part}$")
    if kind == "card":
        return luhn(_digits(found))
    if kind == "phone":
        return F.char_length(_digits(found)).between(8, 15)
    if kind == "iban":
        return _standalone(before, after, "[A-Za-z0-9]") & mod97(F.replace(found, F.lit(" "), F.lit("")))
    if kind == "ssn":
        return _standalone(before, after, "[0-9-]") & ~found.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _places(text: Column, kind: str) -> Column:
    """Array of (kind, start, end, found, score) of the confirmed spans of one kind.

    Pieces of the text stand in turn outside and inside of matches. They are worked on in chunks, so that
    the cost of appending spans does not grow with the square of their number.
    """
    base, more, words = SCORES[kind]
    marked = F.split(F.regexp_replace(text, PATTERNS[kind], f"{_MARK}$0{_MARK}"), _MARK, -1)
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,found:string,score:double>>")
    last = lambda text: F.right(text, F.lit(CONTEXT))

    def step(state: Column, piece: Column) -> Column:
        """A match waits for the piece behind it, which tells the character after it."""
        start, match, before = state["at"], state["match"], state["before"]
        end = start + F.char_length(match)
        near = F.lower(before).rlike(f"(?:^|[^a-z])(?:{words})")
        score = F.lit(base) + F.when(near, F.lit(more)).otherwise(F.lit(0.0))
        good = _confirmed(kind, match, before, F.left(piece, F.lit(1)))
        if kind not in BASE_KINDS:
            good = good & (score >= LEAST_SCORE)
        span = F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), match.alias("found"), score.alias("score")
        )
        waits = F.struct(
            start.alias("at"), before.alias("before"), piece.alias("match"), F.lit(False).alias("inside"), state["spans"].alias("spans")
        )
        goes_on = F.struct(
            (end + F.char_length(piece)).alias("at"),
            last(F.concat(before, match, piece)).alias("before"),
            F.lit("").alias("match"),
            F.lit(True).alias("inside"),
            F.when((match != "") & good, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )
        return F.when(state["inside"], waits).otherwise(goes_on)

    def chunk(pieces: Column, starts: Column, i: Column) -> Column:
        # Every other piece is a match of a character at least, so these many hold the context.
        from_ = F.greatest(i * CHUNK - 2 * CONTEXT, F.lit(0))
        before = last(F.array_join(F.slice(pieces, from_ + 1, i * CHUNK - from_), ""))
        state = F.struct(
            F.get(starts, i).alias("at"), before.alias("before"), F.lit("").alias("match"), F.lit(False).alias("inside"), empty.alias("spans")
        )
        return F.aggregate(F.slice(pieces, i * CHUNK + 1, F.lit(CHUNK + 1)), state, step, lambda state: state["spans"])

    def spans(pieces: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(pieces) - 2) / CHUNK).cast("int"))
        size = lambda i: F.aggregate(
            F.slice(pieces, i * CHUNK + 1, F.lit(CHUNK)), F.lit(0), lambda total, piece: total + F.char_length(piece)
        )
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        add = lambda state, n: F.struct(
            (state["at"] + n).alias("at"), F.concat(state["starts"], F.array(state["at"])).alias("starts")
        )
        starts = F.aggregate(F.transform(chunks, size), none, add, lambda state: state["starts"])
        found = _bound(starts, lambda at: F.flatten(F.transform(chunks, lambda i: chunk(pieces, at, i))))
        # A text of one piece has no match: most texts end here.
        return F.when(F.size(pieces) > 1, found).otherwise(empty)

    found = _bound(marked, spans)
    return F.when(F.contains(text, F.lit(_NEEDS[kind])), found).otherwise(empty) if kind in _NEEDS else found


def with_personal_data(documents: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Documents with column ``spans``: kind, start, end, found text and score, by kind and then start."""
    documents = documents.drop(spans)
    # The mark is a private character; where a text has it, another one of the same length stands in.
    clean = F.coalesce(F.translate(F.col(text).cast("string"), _MARK, _OTHER), F.lit(""))
    return documents.withColumn(spans, F.concat(*[_places(clean, kind) for kind in KINDS]))


def redacted(documents: DataFrame, text: str = "text", least_score: float = 0.0) -> DataFrame:
    """Documents whose spans of at least ``least_score`` are replaced by ``[KIND]``, overlaps by the first."""
    spans = unused_name(documents, "spans")
    rows = with_personal_data(documents, text, spans)
    chosen = F.filter(spans, lambda s: s["score"] >= least_score)
    order: Callable[[Column], Column] = lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind")
    )
    step = lambda state, s: F.when(
        s["start"] >= state["at"],
        F.struct(
            F.concat(
                state["out"],
                F.substring(F.col(text), state["at"] + 1, s["start"] - state["at"]),
                F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")),
            ).alias("out"),
            (-s["back"]).alias("at"),
        ),
    ).otherwise(state)
    end = lambda state: F.concat(state["out"], F.substring(F.col(text), state["at"] + 1, F.char_length(text)))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    cut = F.aggregate(F.array_sort(F.transform(chosen, order)), start, step, end)
    return rows.withColumn(text, F.when(F.size(chosen) > 0, cut).otherwise(F.col(text))).drop(spans)


def digests(found: DataFrame, spans: str = "spans") -> DataFrame:
    """Digest columns: counts of base kinds, SHA-256 of the base spans as kind:start:end, and all spans."""
    text = lambda kinds: F.array_join(
        F.transform(
            F.filter(spans, lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
        ),
        ",",
    )
    of_kind = lambda kind: F.filter(spans, lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(text(BASE_KINDS).cast("binary"), 256).alias("base_sha256"), text(KINDS).alias("spans")
    )
