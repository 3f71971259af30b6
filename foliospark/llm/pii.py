"""Personal data by regular expressions, checksums and context, in SQL functions alone.

Patterns propose spans, validators (Luhn, modulo 97, ranges and digit counts) confirm them, and words near a span move its
score. Where a span stands follows from the pieces that the same pattern splits the text into.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Kind:
    """``pattern`` in Java's dialect, without backtracking over long runs; ``hint``: a cheap test that must hold before; ``check``: SQL over m, the match."""

    name: str
    pattern: str
    hint: str
    check: str
    score: float
    context: str
    base: bool = True


def _digits(m: str = "m") -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def luhn(digits: str) -> str:
    """SQL: whether a string of digits passes Luhn's test."""
    d = f"cast(substring({digits}, i, 1) as int)"
    return f"aggregate(sequence(1, length({digits})), 0, (acc, i) -> acc + if((length({digits}) - i) % 2 = 1, 2 * {d} - if({d} > 4, 9, 0), {d})) % 10 = 0"


def mod97(code: str) -> str:
    """SQL: whether a code of letters and digits, its first four signs moved to the end, leaves 1 modulo 97."""
    moved = f"concat(substring({code}, 5), substring({code}, 1, 4))"
    return f"aggregate(split({moved}, ''), 0, (acc, c) -> if(c = '', acc, if(c >= 'A', (acc * 100 + ascii(c) - 55) % 97, (acc * 10 + cast(c as int)) % 97))) = 1"


LOCAL = "[A-Za-z0-9._%+-]"
#: The first four are the base kinds. A match starts where a run starts or the last match ended, which is where the plain
#: pattern's leftmost match starts; possessive repeats keep long runs linear and give the same ends.
KINDS = (
    Kind("email", rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "true", 0.9, "e-?mail|contact|kontakt|correo|courriel|write to"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "forall(split(m, '[.]'), p -> length(regexp_replace(p, '^0+', '')) <= 3 and cast(concat('0', right(regexp_replace(p, '^0+', ''), 3)) as int) <= 255)", 0.6, "ip|host|server|address|addr|client|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){11,}+", r"[0-9](?:[\x20-]?[0-9]){11}", f"length({_digits()}) between 12 and 19 and {luhn(_digits())}", 0.8, "card|visa|master|credit|debit|karte|carte|tarjeta|cvv|exp"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]", f"length({_digits()}) between 9 and 15", 0.7, "phone|tel|call|mobile|fax|telefon|móvil|portable|sms"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", f"length(replace(m, ' ', '')) between 15 and 34 and {mod97("replace(m, ' ', '')")}", 0.8, "iban|bank|account|konto|compte|cuenta|bic", False),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "true", 0.3, "ssn|social|security|tax|taxpayer", False),
)


def _quoted(pattern: str) -> str:
    return "r'" + pattern + "'"


#: Sums along a text's matches are made in blocks of so many: within a block, and over blocks.
BLOCK = 64
#: A context of 40 characters holds no more matches than this, for the shortest has five.
BEFORE = 8


def _sums(lengths: str) -> str:
    """SQL: for every item of an array of numbers the sum of those before it; linear but for one item a block."""
    ints = "cast(array() as array<int>)"
    running = "aggregate({0}, named_struct('out', {1}, 'at', {2}), (s, x) -> named_struct('out', array_append(s.out, s.at), 'at', s.at + x)).out"
    blocks = f"transform(sequence(0, (size({lengths}) - 1) div {BLOCK}), b -> slice({lengths}, b * {BLOCK} + 1, {BLOCK}))"
    starts = running.format("transform(blocks, b -> aggregate(b, 0, (a, x) -> a + x))", ints, "0")
    return f"flatten(flatten(transform(array({blocks}), blocks -> zip_with(blocks, {starts}, (b, o) -> {running.format('b', ints, 'o')}))))"


def _spans(kind: Kind, number: int, near: int, text: str = "text") -> str:
    """SQL: the confirmed spans of a kind, as an array of structs by start.

    Places are sums of the lengths of matches and of the gaps between them. Context comes from the matches and the ends of
    gaps around a span, so no text is walked through once more for each span.
    """
    p = _quoted(kind.pattern)
    # m: a match, g: the gap before it, t: the gap after it
    items = f"zip_with(hits, slice(gaps, 1, size(hits)), (m, g) -> named_struct('m', m, 'g', length(g), 'n', length(m)))"
    around = f"flatten(transform(gaps, (g, i) -> array(concat(left(g, {near}), if(length(g) > {near}, right(g, {near}), '')), coalesce(get(hits, i), ''))))"
    before = f"right(array_join(slice(around, greatest(2 * i + 1 - {2 * BEFORE}, 1), least(2 * i, {2 * BEFORE}) + 1), ''), {near})"
    after = f"left(array_join(slice(around, 2 * i + 3, {2 * BEFORE} + 1), ''), {near})"
    context = f"lower(concat({before}, x.m, {after}))"
    score = f"least(1.0D, {kind.score}D + if({context} rlike {_quoted('(?<![a-z])(?:' + kind.context + ')(?![a-z])')}, 0.25D, 0.0D))"
    span = f"named_struct('start', at[i] + x.g, 'kind_no', {number}, 'stop', at[i] + x.g + x.n, 'kind', '{kind.name}', 'score', {score}, 'ok', exists(array(x.m), m -> {kind.check}))"
    sums = _sums("transform(items, x -> x.g + x.n)")
    spans = f"flatten(transform(array({around}), around -> flatten(transform(array({items}), items -> flatten(transform(array({sums}), at -> transform(items, (x, i) -> {span})))))))"
    spans = f"flatten(transform(array(split({text}, {p}, -1)), gaps -> flatten(transform(array(regexp_extract_all({text}, {p}, 0)), hits -> if(size(hits) = 0, {EMPTY_OK}, {spans})))))"
    made = f"transform(filter({spans}, x -> x.ok), x -> named_struct('start', x.start, 'kind_no', x.kind_no, 'stop', x.stop, 'kind', x.kind, 'score', x.score))"
    hint = f"contains({text}, '@')" if kind.hint == "@" else f"{text} rlike {_quoted(kind.hint)}"
    return f"if({hint}, {made}, {EMPTY})"


EMPTY = "cast(array() as array<struct<start:int,kind_no:int,stop:int,kind:string,score:double>>)"
EMPTY_OK = "cast(array() as array<struct<start:int,kind_no:int,stop:int,kind:string,score:double,ok:boolean>>)"


def found(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, near: int = 40, least: float = 0.5) -> DataFrame:
    """``doc_id, text, found`` for every row of ``docs(doc_id, text)``: spans in code points, end exclusive, by start and kind, with their scores.

    Null counts as empty; a text without matches has an empty array. Spans of base kinds stay whatever their score, others from ``least`` on.
    Context: ``near`` characters (40 at most) on both sides. Very long texts take time in proportion to their length and matches. Spans of one
    start go by kind, as listed. Repeated rows are answered each; no rows give none; other columns, whatever their names, are ignored.
    """
    base = docs.select("doc_id", common.text_of().alias("text"))
    each = base.select("doc_id", "text", *[F.expr(_spans(k, i, near)).alias(f"k{i}") for i, k in enumerate(kinds)])
    kept = [f"k{i}" if k.base else f"filter(k{i}, x -> x.score >= {least})" for i, k in enumerate(kinds)]
    return each.select("doc_id", "text", F.expr(f"array_sort(concat({', '.join(kept)}))").alias("found"))


def _listed(array: str) -> str:
    return f"array_join(transform({array}, x -> concat(x.kind, ':', x.start, ':', x.stop)), ',')"


def op4_pii(spark, sf_dir):
    base = "('email', 'ip', 'card', 'phone')"
    counts = [F.expr(f"cast(size(filter(found, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return found(common.documents(spark, sf_dir)).select(
        "doc_id",
        *counts,
        F.sha2(F.expr(_listed(f"filter(found, x -> x.kind in {base})")), 256).alias("base_sha256"),
        F.expr(_listed("found")).alias("spans"),
        F.expr("array_join(transform(found, x -> cast(round(x.score, 2) as string)), ',')").alias("scores"),
    )
