"""Text functions. All are built-in expressions except `nfkc`, which needs one Arrow UDF."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from unicodedata import normalize

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- Fixed values -----------------------------------------------------------------------------
# Whitespace as the published lookup defines it (ASCII controls, Unicode space separators, BOM).
WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
# Units whose gap to the number before them is closed, and the surface format of a code.
ASCII_GAP_UNITS = ("mg", "mcg", "gm", "ml", "iu", "g")
CJK_GAP_UNITS = ("毫克", "公絲")
CODE_PATTERN = r"^[A-Z0-9]{10}\z"
# Punctuation that carries its own visual space.
FULL_WIDTH_PUNCTUATION = "：，、。；（）〔〕「」『』？！·—…"
# Numeral words one to ten.
NUMERALS = ("一", "二", "三", "四", "五", "六", "七", "八", "九", "十")
# ----------------------------------------------------------------------------------------------

ORDINAL = r"[(（][" + "".join(NUMERALS) + r"][)）]|\d+\."
NON_ASCII = r"[^\x00-\x7F]"


# Texts that are held as Python strings at once; a batch may hold ten thousand long ones.
FOLDED_AT_ONCE = 64


@F.arrow_udf(StringType())
def _nfkc_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        parts = (texts.slice(i, FOLDED_AT_ONCE).to_pylist() for i in range(0, max(1, len(texts)), FOLDED_AT_ONCE))
        folded = [pa.array([None if t is None else normalize("NFKC", t) for t in part], pa.string()) for part in parts]
        yield pa.concat_arrays(folded)


def nfkc(col: Column) -> Column:
    """Unicode compatibility fold. ASCII rows, already folded, reach Python only as nulls."""
    return F.coalesce(_nfkc_udf(F.when(col.rlike(NON_ASCII), col)), col)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once a row, however often `use` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(col: Column) -> Column:
    return F.regexp_replace(col, f"^{WS}+|{WS}+$", "")


def collapse(col: Column) -> Column:
    """Runs of whitespace become one space, none at the ends."""
    return F.trim(F.regexp_replace(col, f"{WS}+", " "))


def norm_code(col: Column, fold=nfkc) -> Column:
    """Fold, upper-case, and drop whitespace and hyphens."""
    return F.regexp_replace(F.upper(fold(col)), f"{WS}|-", "")


def norm_name(col: Column, fold=nfkc) -> Column:
    """Fold, lower-case and collapse whitespace."""
    return collapse(F.lower(fold(col)))


def close_gap(col: Column, gap_mode: str = "reference") -> Column:
    """`20 mg` becomes `20mg`.

    In mode "reference" an ASCII unit must not run on into a word, and a CJK unit must be followed
    by a word character. In mode "unicode" a CJK unit only has to end its word.
    """
    ascii_units, cjk_units = "|".join(ASCII_GAP_UNITS), "|".join(CJK_GAP_UNITS)
    after_cjk = {"reference": "(?=[0-9A-Za-z_])", "unicode": r"(?![\p{L}\p{N}_])"}[gap_mode]
    pattern = rf"(\d){WS}+(?:({ascii_units})(?![0-9A-Za-z_])|({cjk_units}){after_cjk})"
    return F.regexp_replace(col, pattern, "$1$2$3")


def search_text(col: Column, gap_mode: str = "reference", fold=nfkc) -> Column:
    """The form in which names and queries of the master lookup are compared."""
    return close_gap(norm_name(col, fold), gap_mode)


def terms(normalised: Column) -> Column:
    """The words of an already normalised query."""
    return F.filter(F.split(normalised, " "), lambda t: t != "")


def is_code(col: Column, pattern: str = CODE_PATTERN) -> Column:
    return F.coalesce(col.rlike(pattern), F.lit(False))


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def or_missing(col: Column, text: str) -> Column:
    return F.coalesce(blank_to_null(col), F.lit(text))


def join_nonblank(cols: Sequence[Column], sep: str = " ") -> Column:
    return F.concat_ws(sep, *[blank_to_null(c) for c in cols])


def without_ws(col: Column) -> Column:
    return F.regexp_replace(col, f"{WS}+", "")


def same_without_ws(text: Column, lines: Column) -> Column:
    """Does the joined text hold exactly the characters of its lines?"""
    return without_ws(text).eqNullSafe(without_ws(F.array_join(lines, "")))


def classify(col: Column, labels: dict[str, str], other: str) -> Column:
    """All labels whose upper-case substring occurs; `other` if none does."""
    upper = F.upper(col)
    found = F.filter(
        F.array(*[F.when(F.contains(upper, F.lit(s)), F.lit(label)) for label, s in labels.items()]),
        lambda x: x.isNotNull(),
    )
    return F.when(F.size(found) == 0, F.array(F.lit(other))).otherwise(found)


def generics(col: Column, pattern: str) -> Column:
    """Distinct names of the given pattern, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.upper(col), F.lit(pattern), 0))


def split_steps(col: Column, markers: str = f"[{''.join(NUMERALS)}]、") -> Column:
    """Split a text before each of its own markers; the marker stays with its step."""
    steps = F.transform(F.split(col, f"(?={markers})"), strip)
    return F.filter(steps, lambda s: s != "")


_LATIN, _TIGHT = "[A-Za-z0-9]", f"[-{FULL_WIDTH_PUNCTUATION}]"


def _spaced(before: Column, line: Column) -> Column:
    """Does the seam between two texts take a space? An empty line has no side of its own."""
    return (before.rlike(rf"{_LATIN}\z") | line.rlike(f"^{_LATIN}")) & ~(before.rlike(rf"{_TIGHT}\z") | line.rlike(f"^{_TIGHT}"))


def seam_exceptions(lines: Column, exceptions: Sequence[tuple[str, str]]) -> Column:
    """Per line, the first exception (tail of the text so far, head of the line) that its seam matches; else -1.

    The text so far is carried only as far back as the longest tail reaches, so an exception may reach over
    several short lines.
    """
    reach = max([1, *(len(after) for after, _ in exceptions)])

    def step(done: Column, line: Column) -> Column:
        tail, which = done["tail"], F.lit(-1)
        for i, (after, head) in reversed(list(enumerate(exceptions))):
            which = F.when(tail.endswith(after) & line.startswith(head), i).otherwise(which)
        which = F.when(tail == "", -1).otherwise(which)
        space = F.when((tail != "") & (which == -1) & _spaced(tail, line), " ").otherwise("")
        return F.struct(F.concat(done["found"], F.array(which)).alias("found"), F.right(F.concat(tail, space, line), F.lit(reach)).alias("tail"))

    def start(tail: Column, kind: str) -> Column:
        return F.struct(F.array().cast(kind).alias("found"), tail.alias("tail"))

    def row(done: Column, part: Column) -> Column:
        inner = F.aggregate(part, start(done["tail"], "array<int>"), step)
        return bound(inner, lambda r: F.struct(F.concat(done["found"], F.array(r["found"])).alias("found"), r["tail"].alias("tail")))

    # The fold appends to what it found, so it runs in rows of about the root of the number of lines.
    def fold(lines: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(lines))), F.lit(1)).cast("int")
        places = F.sequence(F.lit(0), F.floor(F.greatest(F.size(lines) - 1, F.lit(0)) / width).cast("int"))
        rows = F.transform(places, lambda i: F.slice(lines, i * width + 1, width))
        return F.flatten(F.aggregate(rows, start(F.lit(""), "array<array<int>>"), row)["found"])

    return bound(lines, fold)


def rejoin(lines: Column, exceptions: Sequence[tuple[str, str]] = ()) -> Column:
    """Join hard-wrapped lines into one text.

    A seam takes one space if either side is an ASCII letter or digit, unless a side is a hyphen or
    full-width punctuation, or the seam is listed as (tail of the text so far, head of the line) in
    `exceptions`. Blank lines at the start vanish; of others the first leaves a space behind a letter or digit.
    Without exceptions every seam is judged on its own, so the work is linear in the text.
    """
    # Arrays that a step looks into are bound first: an expression in their place is computed anew for every line.
    # A text of one line, as most are, is that line.
    return bound(lines, lambda held: F.when(F.size(held) == 1, F.coalesce(F.get(held, F.lit(0)), F.lit(""))).otherwise(_joined(held, exceptions)))


def _joined(lines: Column, exceptions: Sequence[tuple[str, str]]) -> Column:
    places = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i) != "")
    places = F.when(F.size(lines) > 0, places).otherwise(F.array().cast("array<int>"))

    def join(found: Column) -> Column:
        places, excepted = found["places"], found["excepted"] if exceptions else None

        def piece(i: Column, n: Column) -> Column:
            line, above = F.get(lines, i), F.get(places, n - 1)
            before = F.get(lines, above)
            spaced = _spaced(before, line)
            if excepted is not None:
                spaced = spaced & (F.get(excepted, i) == -1)
            # A blank line between takes the space of a seam, and the next line sees that space.
            parted = (i - above > 1) & before.rlike(rf"{_LATIN}\z")
            apart = F.concat(F.lit(" "), F.when(line.rlike(f"^{_LATIN}"), " ").otherwise(""))
            space = F.when(n == 0, "").when(parted, apart).when(spaced, " ").otherwise("")
            return F.concat(space, line)

        last = F.try_element_at(places, F.lit(-1))
        open_end = (last < F.size(lines) - 1) & F.get(lines, last).rlike(rf"{_LATIN}\z")
        return F.concat(F.array_join(F.transform(places, piece), ""), F.when(open_end, " ").otherwise(""))

    fields = [places.alias("places")] + ([seam_exceptions(lines, exceptions).alias("excepted")] if exceptions else [])
    return bound(F.struct(*fields), join)


def strip_suffix(col: Column, suffixes: Sequence[str]) -> Column:
    """The text before a known suffix; NULL, to be reported, if no suffix fits."""
    out = F.lit(None).cast("string")
    for suffix in reversed(suffixes):
        cut = F.substring(col, F.lit(1), F.length(col) - len(suffix))
        out = F.when(col.endswith(suffix), cut).otherwise(out)
    return out


def split_ordinal(col: Column, ordinal: str = ORDINAL) -> Column:
    """`(一)text` or `1. text` as STRUCT<ordinal, body>; NULL if the text opens with no ordinal."""
    # As in the published format, a body is one line of text.
    pattern = rf"^({ordinal}){WS}*([^\n]+)$"
    parts = F.struct(
        F.regexp_extract(col, pattern, 1).alias("ordinal"),
        F.regexp_extract(col, pattern, 2).alias("body"),
    )
    return F.when(col.rlike(pattern), parts)


def numeral(col: Column, digits: Sequence[str] = NUMERALS) -> Column:
    """Position of a numeral word, counted from one; NULL if it is none."""
    position = F.array_position(F.array(*[F.lit(d) for d in digits]), col)
    return F.nullif(position, F.lit(0).cast("bigint"))


def required_count(col: Column, before: str = "符合以下至少", after: str = "項", digits: Sequence[str] = NUMERALS) -> Column:
    """The N of an "at least N of the following" wording; NULL if the text has none."""
    alternatives = "|".join(sorted(digits, key=len, reverse=True))
    return numeral(F.regexp_extract(col, f"{before}({alternatives}){after}", 1), digits)


def threshold(col: Column, pattern: str) -> Column:
    """The number a threshold text states, as a whole decimal; NULL if it states none."""
    return F.regexp_extract(col, pattern, 1).try_cast("decimal(38,0)")


def stated_numbers(col: Column, pattern: str) -> Column:
    """All numbers a source window states, first mention first, as text."""
    return F.array_distinct(F.regexp_extract_all(col, F.lit(pattern), 1))


def insert_at(line: Column, glyph: Column, column: Column) -> Column:
    """Put a displaced character back at its column, counted from zero; NULL if beyond the line."""
    return F.when(column <= F.length(line), F.overlay(line, glyph, column + 1, F.lit(0)))


def cells(line: Column) -> Column:
    """Cells of a fixed-layout line, which two or more spaces separate."""
    return F.filter(F.split(strip(line), f"{WS}{{2,}}"), lambda c: c != "")
