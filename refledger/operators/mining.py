"""Typed facets out of free-text request lines, with offsets, losing no character.

All steps are row-local expressions: no shuffle, and the same on a streaming DataFrame. Detectors are a
list in order of priority. A hit that overlaps an accepted hit is dropped whole, and a hit without a
valid value is not accepted, so its text stays in the search text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refledger.functions.dates import era_date, month_day, strict_date
from refledger.functions.mentions import mention_of, mention_pattern
from refledger.functions.text import WS, collapse
from refledger.operators.stage import computed

# --- Fixed values: what the detectors look for, negated wordings before plain ones ---------------
QUERY_UNITS = {
    "MCG": "mcg", "MG": "mg", "GM": "g", "ML": "ml", "IU": "IU", "G": "g",
    "毫克": "mg", "公絲": "mg", "公克": "g",
}
QUERY_PER_UNITS = ("MCG", "MG", "GM", "ML", "G", "毫克", "公絲", "公克")
ISO_DATE = r"(?<![\d-])(\d{4})-(\d{2})-(\d{2})(?![\d-])"
ERA_DATE = r"(?<![\d/.-])(\d{2,3})[/.-](\d{1,2})[/.-](\d{1,2})(?![\d/.-])"
MONTH_DAY = r"(?<![\d/.-])(\d{1,2})[/.](\d{1,2})(?![\d/.-])"
TODAY_WORDS = ("今天", "今日", "本日", "today")
ANNOUNCEMENT_WORDS = ("新制生效日", "新制", "生效日", "announcement")
UNCHANGED_WORDS = (
    "未調價", "沒調價", "沒有調價", "未受影響", "不受影響", "沒有動到", "沒動到", "未變動",
    "price not changed", "not changed", "unchanged",
)
CHANGED_WORDS = (
    "本次調價", "這次調價", "有調價", "調價", "漲價", "降價", "受影響", "有動到", "已變動",
    "price changed", "repriced",
)
FILLER_WORDS = (
    "有沒有", "有哪些", "請問", "幫我", "給我", "我要", "列出", "查詢", "哪些", "請", "查", "找", "看",
    "要", "的話", "的", "了", "嗎", "呢", "吧", "啊", "是", "跟", "與", "及", "全部",
)
# -------------------------------------------------------------------------------------------------

DOSE = mention_pattern(list(QUERY_UNITS), QUERY_PER_UNITS, not_before="a-z")
NO_UNIT = rf"(?!{WS}*(?:{'|'.join(QUERY_UNITS)}))"

# From (matched text, today, announcement date) to STRUCT<value, label>; NULL rejects the hit.
ToFacet = Callable[[Column, Column, Column], Column]


class Detector(NamedTuple):
    kind: str
    pattern: str
    facet: ToFacet


def _plain(value: Column, label: Column | None = None) -> Column:
    fields = F.struct(value.alias("value"), (value if label is None else label).alias("label"))
    return F.when(value.isNotNull(), fields)


def _iso(day: Column) -> Column:
    return _plain(F.date_format(day, "yyyy-MM-dd"))


def _dose(raw: Column, *_: Column) -> Column:
    dose = mention_of(raw, DOSE, QUERY_UNITS)
    return _plain(dose["key"], dose["label"])


def _words(words: Sequence[str]) -> str:
    return "(?i)" + "|".join(words)


DETECTORS: tuple[Detector, ...] = (
    Detector("date", ISO_DATE, lambda raw, today, ann: _iso(strict_date(raw))),
    Detector("date", ERA_DATE, lambda raw, today, ann: _iso(era_date(raw))),
    Detector("date", _words(TODAY_WORDS), lambda raw, today, ann: _plain(today)),
    Detector("date", _words(ANNOUNCEMENT_WORDS), lambda raw, today, ann: _plain(ann)),
    Detector("dose", DOSE, _dose),
    Detector("date", "(?i)" + MONTH_DAY + NO_UNIT, lambda raw, today, ann: _iso(month_day(raw, today))),
    Detector("announcement", _words(UNCHANGED_WORDS), lambda raw, today, ann: _plain(F.lit("priceUnchanged"))),
    Detector("announcement", _words(CHANGED_WORDS), lambda raw, today, ann: _plain(F.lit("priceChanged"))),
    Detector("ignored", "|".join(FILLER_WORDS), lambda raw, today, ann: _plain(raw)),
)


def sums_before(values: Column) -> Column:
    """Per element of an array of lengths, the sum of those before it.

    The array is folded in rows of about its root, so a long one costs little more than its length.
    """

    def run(part: Column, start: Column) -> Column:
        first = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(part, first, step)["out"]

    width = F.ceil(F.sqrt(F.size(values))).cast("int")
    places = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / width).cast("int"))
    rows = F.transform(places, lambda i: F.slice(values, i * width + 1, width))
    totals = F.transform(rows, lambda row: F.aggregate(row, F.lit(0), lambda acc, v: acc + v))
    blocked = F.flatten(F.zip_with(rows, run(totals, F.lit(0)), run))
    return F.when(F.size(values) < 2, F.transform(values, lambda v: F.lit(0))).otherwise(blocked)


def detect(
    requests: DataFrame,
    text: str,
    today: str,
    announced: str,
    detectors: Sequence[Detector] = DETECTORS,
) -> DataFrame:
    """Add `hits`, all detectors' spans in order of priority, valid or not, each detector's in text order."""
    here = range(len(detectors))

    def length_of(i: int) -> Column:
        """Lengths of a detector's hits, each with the gap before it."""
        return F.transform(f"__hit{i}", lambda raw, n: F.length(F.get(f"__gap{i}", n)) + F.length(raw))

    def spans(i: int) -> Column:
        d = detectors[i]

        def span(raw: Column, n: Column) -> Column:
            end = F.get(F.col("__at")[i], n) + F.get(F.col("__len")[i], n)
            facet = d.facet(raw, F.col(today), F.col(announced))
            return F.struct(
                (end - F.length(raw)).alias("start"),
                end.alias("end"),
                F.lit(d.kind).alias("kind"),
                raw.alias("raw"),
                facet["value"].alias("value"),
                facet["label"].alias("label"),
                F.lit(i).alias("rank"),
            )

        return F.transform(f"__hit{i}", span)

    found = requests.withColumns({f"__hit{i}": F.regexp_extract_all(F.col(text), F.lit(detectors[i].pattern), 0) for i in here})
    # Most detectors find nothing in a line, and then need no gaps.
    found = computed(found).withColumns({f"__gap{i}": F.when(F.size(f"__hit{i}") > 0, F.split(F.col(text), detectors[i].pattern, -1)) for i in here})
    found = computed(found).withColumn("__len", F.array(*map(length_of, here)))
    found = computed(computed(found).withColumn("__at", F.transform("__len", sums_before)))
    return computed(found.select(*requests.columns, F.concat(*map(spans, here)).alias("hits")))


def drop_invalid(hits: Column) -> Column:
    return F.filter(hits, lambda s: s["value"].isNotNull())


def _held(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once: each mention of a binary column within a lambda would copy it."""
    return F.transform(F.array(value), use)[0]


def resolve_spans(hits: Column, text: Column, ranks: int = len(DETECTORS)) -> Column:
    """Keep each hit that overlaps none kept before it; the result is in text order. `hits` is a computed column.

    Hits of one rank, that is of one detector, never overlap each other. So ranks are swept one after another over a
    cover, a text of one byte a character that marks what earlier ranks hold: a hit reads and paints its own stretch only,
    and a line costs its length and its hits for every rank.
    """

    def painted(cover: Column, own: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            since = F.coalesce(F.get(own, i - 1)["end"], F.lit(0))
            return F.concat(F.substring(cover, since + 1, s["start"] - since).cast("string"), F.repeat(F.lit("1"), s["end"] - s["start"]))

        since = F.try_element_at(own, F.lit(-1))["end"]
        tail = F.substring(cover, since + 1, F.octet_length(cover)).cast("string")
        whole = F.concat(F.array_join(F.transform(own, piece), ""), tail).cast("binary")
        return F.when(F.size(own) > 0, whole).otherwise(cover)

    def sweep(acc: Column, r: Column) -> Column:
        def free(s: Column) -> Column:
            return F.instr(F.substring(acc["cover"], s["start"] + 1, s["end"] - s["start"]).cast("string"), "1") == 0

        def kept(own: Column) -> Column:
            return F.struct(F.concat(acc["kept"], own).alias("kept"), painted(acc["cover"], own).alias("cover"))

        return _held(F.filter(hits, lambda s: (s["rank"] == r) & free(s)), kept)

    cover = F.repeat(F.lit("0"), F.length(text)).cast("binary")
    start = F.struct(F.filter(hits, lambda s: F.lit(False)).alias("kept"), cover.alias("cover"))
    swept = F.aggregate(F.array(*map(F.lit, range(ranks))), start, sweep)["kept"]
    return F.when(F.size(hits) > 1, F.array_sort(swept)).otherwise(hits)


def residual(text: Column, wide: Column, spans: Column) -> Column:
    """The text less its spans, each replaced by a space, whitespace collapsed.

    Pieces are cut from `wide`, a computed column with the text at four bytes a character (UTF-32), where a place is found
    without counting up to it.
    """

    def pieces(held: Column) -> Column:
        def cut_at(since: Column, length: Column) -> Column:
            return F.decode(F.substring(held, 4 * since + 1, 4 * length), "UTF-32")

        def piece(s: Column, i: Column) -> Column:
            since = F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
            return cut_at(since, s["start"] - since)

        since = F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0))
        return F.concat(F.transform(spans, piece), F.array(cut_at(since, F.length(text) - since)))

    return F.when(F.size(spans) > 0, collapse(F.array_join(_held(wide, pieces), " "))).otherwise(collapse(text))


def last_of(spans: Column, kind: str) -> Column:
    """The last facet of a kind in text order; NULL if there is none."""
    return F.try_element_at(F.filter(spans, lambda s: s["kind"] == kind), F.lit(-1))


def facet_rows(mined: DataFrame, key: str) -> DataFrame:
    """Accepted facets in text order, with the exact characters they quote."""
    return mined.select(key, F.posexplode("spans").alias("pos", "span")).select(key, "pos", "span.*")


def mine(
    requests: DataFrame,
    text: str,
    today: str,
    announced: str,
    detectors: Sequence[Detector] = DETECTORS,
) -> DataFrame:
    """Requests with `spans`, the residual `search_text`, and the controls the line implies."""
    hits = detect(requests, text, today, announced, detectors).withColumn("hits", drop_invalid(F.col("hits")))
    spans = computed(hits).withColumn("spans", resolve_spans(F.col("hits"), F.col(text), len(detectors))).drop("hits")
    mined = computed(spans.withColumn("__wide", F.encode(F.col(text), "UTF-32")))
    return mined.withColumns(
        {
            "search_text": residual(F.col(text), F.col("__wide"), F.col("spans")),
            "dose_key": last_of(F.col("spans"), "dose")["value"],
            "dose_label": last_of(F.col("spans"), "dose")["label"],
            "filter": last_of(F.col("spans"), "announcement")["value"],
            "mined_as_of": last_of(F.col("spans"), "date")["value"],
        }
    ).drop("__wide")


def plain_lines(requests: DataFrame, text: str, detectors: Sequence[Detector] = DETECTORS) -> DataFrame:
    """Lines on which no detector fires; they reach the search unchanged."""
    fires = reduce(lambda a, b: a | b, [F.col(text).rlike(d.pattern) for d in detectors])
    return requests.where(~fires)
