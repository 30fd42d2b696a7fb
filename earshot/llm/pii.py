"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust the score.

DataFrame functions only. A pattern's matches come from ``regexp_extract_all`` and their places from the pieces that
``split`` leaves between them, so both see the same leftmost, non-overlapping matches. The patterns are written with
possessive repeats and run-start conditions: they match what the plain forms in ``PLAIN`` match, in linear time and
without deep recursion on long runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the base kinds mean, in their usual notation.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Characters read on either side of a span for context words.
CONTEXT = 40
KEEP_FROM = 0.8


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. ``valid`` is SQL on the match ``m``; a base kind keeps every valid match."""

    name: str
    pattern: str
    valid: str
    hint: str
    base: bool
    score: float
    context: str


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def luhn(digits: str) -> str:
    """SQL: the digit string passes the Luhn check."""
    doubled = f"int(substr({digits}, length({digits}) - i + 1, 1)) * if(i % 2 = 0, 2, 1)"
    return f"aggregate(sequence(1, length({digits})), 0, (s, i) -> int(s + ({doubled}) div 10 + ({doubled}) % 10)) % 10 = 0"


def mod_97(code: str) -> str:
    """SQL: the account number, first four characters moved behind, is 1 modulo 97."""
    moved = f"concat(substr({code}, 5), left({code}, 4))"
    value = f"(ascii(substr({moved}, i, 1)) - if(substr({moved}, i, 1) between '0' and '9', 48, 55))"
    return f"aggregate(sequence(1, length({moved})), 0, (s, i) -> int((s * if({value} > 9, 100, 10) + {value}) % 97)) = 1"


_PART = "coalesce(try_cast(nullif(ltrim('0', p), '') as int), if(ltrim('0', p) = '', 0, 256)) <= 255"

KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true", "@", True, 0.9,
         "mail|contact|write|address|adresse|correo"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", f"forall(split(m, '[.]'), p -> {_PART})", ".", True, 0.8,
         "ip|host|server|address|client|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", f"length({_digits('m')}) between 12 and 19 and {luhn(_digits('m'))}", "", True, 0.9,
         "card|visa|mastercard|amex|credit|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_digits('m')}) between 9 and 15", "+", True, 0.8,
         "phone|tel|call|fax|mobile|telefon"),
    # kinds that only the method adds: the checksum or the words nearby have to carry them
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
         f"length(replace(m, ' ', '')) between 15 and 34 and {mod_97("replace(m, ' ', '')")}", "", False, 0.9,
         "iban|account|konto|compte|cuenta|bank"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
         "left(m, 3) not in ('000', '666') and left(m, 1) <> '9' and substr(m, 5, 2) <> '00' and right(m, 4) <> '0000'", "-", False, 0.5,
         "ssn|social security|insurance number|taxpayer"),
    Kind("local_phone", r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", "true", "", False, 0.5,
         "phone|tel|call|fax|mobile|telefon"),
)
#: A span is worth this much more with one of its kind's words nearby, and less next to the words of other numbers.
GAIN, LOSS = 0.3, 0.2
OTHER_NUMBERS = "invoice|order no|isbn|version|serial|part number"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _starts(df: DataFrame, kind: Kind, order: int) -> DataFrame:
    """Adds ``spans_<order>``: the kind's valid matches with place and score, or null where there are none."""
    m, pieces, lens, sums, before = (f"_{x}_{order}" for x in ("m", "p", "l", "s", "b"))
    pattern, hint = _literal(kind.pattern), f"contains(_text, '{kind.hint}')" if kind.hint else "true"
    df = df.withColumn(m, F.expr(f"if({hint}, regexp_extract_all(_text, {pattern}, 0), array())"))
    df = df.withColumn(pieces, F.expr(f"if(size({m}) > 0, split(_text, {pattern}, -1), null)"))
    # lengths of a piece and the match behind it; running sums in blocks of about the root of their number
    df = df.withColumn(lens, F.expr(f"transform({m}, (x, i) -> length({pieces}[i]) + length(x))"))
    block = f"int(ceil(sqrt(size({lens}))))"
    df = df.withColumn(
        sums, F.expr(f"transform(sequence(0, {block}), b -> aggregate(slice({lens}, b * {block} + 1, {block}), 0, (s, x) -> s + x))")
    )
    df = df.withColumn(before, F.expr(f"transform({sums}, (x, b) -> aggregate(slice({sums}, 1, b), 0, (s, y) -> s + y))"))
    start = (
        f"{before}[i div {block}] + aggregate(slice({lens}, int(i div {block}) * {block} + 1, i % {block}), 0, (s, y) -> s + y) + length({pieces}[i])"
    )
    listed = f"filter(transform({m}, (m, i) -> named_struct('m', m, 'start', {start}, 'ok', {kind.valid})), x -> x.ok)"
    around = f"lower(substr(_text, greatest(x.start - {CONTEXT}, 0) + 1, length(x.m) + {2 * CONTEXT}))"
    score = (
        f"{kind.score}D + if(regexp_like({around}, {_literal(r'\b(' + kind.context + r')\b')}), {GAIN}D, 0D)"
        f" - if(regexp_like({around}, {_literal(OTHER_NUMBERS)}), {LOSS}D, 0D)"
    )
    shown = (
        f"transform({listed}, x -> named_struct('start', x.start, 'order', {order}, 'end', x.start + length(x.m), "
        f"'kind', '{kind.name}', 'score', round({score}, 2), 'base', {str(kind.base).lower()}))"
    )
    df = df.withColumn(f"spans_{order}", F.expr(f"if(size({m}) > 0, {shown}, null)"))
    return df.drop(m, pieces, lens, sums, before)


def personal_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``spans``: structs of start, order, end, kind, score and base, by start and kind.

    Places are code points, the end exclusive. Base kinds (email, ip, card, phone) keep every match that passes its
    check, whatever its score; other kinds need ``KEEP_FROM`` and no overlap with a base span. Null and empty texts
    have no spans. Other columns stay, but for any named like a column of this function.
    """
    own = [f"spans_{i}" for i in range(len(KINDS))]
    df = docs.drop(*(c for c in docs.columns if c.lower() in ("spans", "_text", "_base", "_more", "_runs", *own))).withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    for order, kind in enumerate(KINDS):
        df = _starts(df, kind, order)
    none = "cast(array() as array<struct<start: int, order: int, end: int, kind: string, score: double, base: boolean>>)"
    base = ", ".join(f"coalesce(spans_{i}, {none})" for i, k in enumerate(KINDS) if k.base)
    more = ", ".join(f"coalesce(spans_{i}, {none})" for i, k in enumerate(KINDS) if not k.base)
    df = df.withColumn("_base", F.expr(f"concat({base})")).withColumn("_more", F.expr(f"concat({more})"))
    fits = f"x.score >= {KEEP_FROM} and not exists(_base, y -> x.start < y.end and y.start < x.end)"
    df = df.withColumn("spans", F.expr(f"array_sort(concat(_base, filter(_more, x -> {fits})))"))
    return df.drop("_text", "_base", "_more", *own)


def joined(spans: str) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined in its order."""
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def masked(df: DataFrame, text: str = "text") -> DataFrame:
    """Replaces the text under every span by its kind in angle brackets; overlapping spans become one mark."""
    last = "element_at(out, -1)"
    df = df.withColumn(
        "_runs",
        F.expr(
            "aggregate(spans, cast(array() as array<struct<start: int, end: int, kind: string>>), (out, s) -> "
            f"if(size(out) > 0 and s.start < {last}.end, "
            f"concat(slice(out, 1, size(out) - 1), array(named_struct('start', {last}.start, 'end', greatest({last}.end, s.end), 'kind', {last}.kind))), "
            "concat(out, array(named_struct('start', s.start, 'end', s.end, 'kind', s.kind)))))"
        ),
    )
    gap = f"substr({text}, if(i = 0, 0, _runs[i - 1].end) + 1, r.start - if(i = 0, 0, _runs[i - 1].end))"
    marked = f"concat(array_join(transform(_runs, (r, i) -> concat({gap}, '<', r.kind, '>')), ''), substr({text}, element_at(_runs, -1).end + 1))"
    return df.withColumn(text, F.expr(f"if(size(spans) > 0, {marked}, {text})")).drop("_runs")
