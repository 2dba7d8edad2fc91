"""Loading delimited lines strictly, with the lines that do not load set apart (problem 1).

Strict load plus anti-join: every line keeps its offset (``line_id``); one pattern recognises conforming lines, and only these are loaded into
typed rows; the loaded offsets are subtracted from the raw ones; what remains is written out and diagnosed. Only the remainder is ever
parsed: the checkpoint between subtraction and diagnosis keeps the optimizer from moving the diagnosis below the join.

The pattern has no repeated group, so long lines cannot exhaust the stack of the matcher. A line in which a quoted field holds a doubled quote is
left to the parser of the diagnosis, which cuts a line at every double quote: pieces at even places lie outside quotes, the others
inside. The line is well quoted if the number of quotes is even and each outside piece is empty, or meets a quote only through a
comma. Commas inside quotes are masked, so one split gives the fields. All of it runs as built-in expressions, each step once a line.

Defined cases: a null line has no fields and fails with ``columns``; a blank line has one field and fails with ``columns``;
an empty c2 is a null rating; c0 and c1 that are no INT come out null and never fail a line; line_id is assumed unique and
not null; other columns, whatever their names, are unused; an empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockframe.plans.runtime import durable

#: The accepted range of c2 and of c3.
RATING = (1, 5)
TIME = (946684800, 1893455999)
N_FIELDS = 4
_MASK = "\u0001"


#: A field of any content, without doubled quotes; a rating; a time of nine or ten digits. Spaces may surround the latter two.
_ANY = r'("[^"]*+"|[^",]*+)'
_BLANK = r"[ \t\r]*+"
_C2 = rf'("?+){_BLANK}(?:0*+([1-5]))?+{_BLANK}\3'
_C3 = rf'("?+){_BLANK}0*+([1-9][0-9]{{8,9}}){_BLANK}\5'
#: Groups 1, 2, 4 and 6 are the fields.
STRICT = rf"\A{_ANY},{_ANY},{_C2},{_C3}\z"


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def well_quoted(line: Column) -> Column:
    """Whether each field has no quote, or is enclosed in quotes with every inner quote doubled."""

    def pieces(parts: Column) -> Column:
        last = F.size(parts) - 1

        def outside(x: Column, i: Column) -> Column:
            before = (i == 0) | x.startswith(",")
            after = (i == last) | x.endswith(",")
            return (i % 2 == 1) | (x == "") | (before & after)

        return (last % 2 == 0) & F.forall(F.transform(parts, outside), lambda ok: ok)

    return _once(F.split(line, '"', -1), pieces)


def fields(line: Column) -> Column:
    """Fields of a well quoted line, still enclosed, with masked inner commas."""

    def mask(x: Column, i: Column) -> Column:
        escaped = F.replace(x, F.lit(_MASK), F.lit(_MASK + "a"))
        return F.when(i % 2 == 1, F.replace(escaped, F.lit(","), F.lit(_MASK + "b"))).otherwise(escaped)

    quoted = F.array_join(F.transform(F.split(line, '"', -1), mask), '"')
    return F.when(F.contains(line, F.lit('"')) | F.contains(line, F.lit(_MASK)), F.split(quoted, ",", -1)).otherwise(F.split(line, ",", -1))


def plain(field: Column) -> Column:
    """A field without enclosing quotes, then without spaces, tabs and carriage returns at its ends."""
    inner = F.when(
        field.startswith('"'), F.replace(F.substr(field, F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))
    ).otherwise(field)
    unmasked = F.replace(F.replace(inner, F.lit(_MASK + "b"), F.lit(",")), F.lit(_MASK + "a"), F.lit(_MASK))
    return F.btrim(unmasked, F.lit(" \t\r"))


def _number(x: Column) -> Column:
    """Value of a text of ASCII digits, null if it is none or has over 18 digits beyond leading zeros."""
    digits = F.regexp_extract(x, r"\A0*([0-9]+)\z", 1)
    return F.when(F.length(digits).between(1, 18), digits.cast("bigint"))


def _int(x: Column) -> Column:
    return F.when(x.rlike(r"\A-?[0-9]+\z"), x.try_cast("int"))


def parsed(line: Column) -> Column:
    """Struct (reasons ARRAY, c0, c1, c2, c3) of a line: why it does not load, and its values if it does."""

    def judge(t: Column) -> Column:
        c2, c3 = _number(t[2]), _number(t[3])
        bad2 = F.when((t[2] != "") & ~F.coalesce(c2.between(*RATING), F.lit(False)), F.lit("c2"))
        bad3 = F.when(~F.coalesce(c3.between(*TIME), F.lit(False)), F.lit("c3"))
        return _outcome(F.array_compact(F.array(bad2, bad3)), _int(t[0]), _int(t[1]), c2.cast("int"), c3)

    def cut(f: Column) -> Column:
        return F.when(F.size(f) == N_FIELDS, _once(F.transform(f, plain), judge)).otherwise(_outcome(F.array(F.lit("columns"))))

    whole = F.when(F.coalesce(well_quoted(line), F.lit(True)), _once(F.coalesce(fields(line), F.array().cast("array<string>")), cut))
    return whole.otherwise(_outcome(F.array(F.lit("quoting"))))


def _outcome(reasons: Column, *values: Column) -> Column:
    kinds = ("int", "int", "int", "bigint")
    values = values or tuple(F.lit(None) for _ in kinds)
    return F.struct(reasons.alias("reasons"), *[v.cast(k).alias(f"c{i}") for i, (v, k) in enumerate(zip(values, kinds, strict=True))])


def conforms(line: Column) -> Column:
    """Whether a line loads: by the pattern, or by the parser where a doubled quote keeps the pattern from matching."""
    time = F.regexp_extract(line, STRICT, 6)
    full = _once(line, lambda x: F.size(parsed(x)["reasons"]) == 0)
    return F.coalesce(F.when(time != "", time.cast("bigint").between(*TIME)).when(F.contains(line, F.lit('""')), full), F.lit(False))


def strict_load(lines: DataFrame) -> DataFrame:
    """Typed rows of the conforming lines only: line_id, file_name, c0 INT, c1 INT, c2 INT, c3 BIGINT."""
    good = lines.select("line_id", "file_name", "line").filter(conforms(F.col("line")))
    group = [F.regexp_extract("line", STRICT, k) for k in (1, 2, 4, 6)]
    users = [_int(F.btrim(F.regexp_replace(g, r'\A"|"\z', ""), F.lit(" \t\r"))) for g in group[:2]]
    matched = _outcome(F.array().cast("array<string>"), *users, F.when(group[2] != "", group[2]), group[3])
    value = F.when(F.col("line").rlike(STRICT), matched).otherwise(_once(F.col("line"), parsed))
    return good.select("line_id", "file_name", value.alias("v")).select("line_id", "file_name", *[F.col(f"v.c{i}") for i in range(N_FIELDS)])


def remainder(lines: DataFrame) -> DataFrame:
    """Lines whose offset was not loaded."""
    return lines.select("line_id", "file_name", "line").join(strict_load(lines).select("line_id"), "line_id", "left_anti")


def diagnose(rest: DataFrame) -> DataFrame:
    """Each line of ``rest`` with ``reasons``, an array of ``quoting``, ``columns``, ``c2``, ``c3``."""
    return rest.select("line_id", "file_name", "line", parsed(F.col("line"))["reasons"].alias("reasons"))


def rejects(lines: DataFrame) -> DataFrame:
    """The lines that do not load, each with the reasons."""
    return diagnose(durable(remainder(lines)))
