"""Benchmark decontamination by templates.

Tokens become codes: numbers, names and units turn into typed placeholders, all else stays as it is in lower
case. Windows of codes of the benchmark's items are looked up in the documents; a window with few literal words
is widened until it holds enough of them. Hits on one diagonal (the same offset between document and item)
belong to one alignment. An alignment whose slots are filled consistently,
each value of the item by one value of the document and the other way round, is the item with new parameters.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from refledger.llm.common import by_ids, free_name, quoted
from refledger.llm.near_dup import _U64, _mixed, _powers
from refledger.sources.workspace import cut

NUMBER, NAME, UNIT, UNKNOWN, NOTHING = 1, 2, 3, 0, (1 << 24) - 1
FIRST_WORD = 8
MEMO = 50_000  # raw tokens whose codes a worker keeps at hand
LEAST = 3  # literal words that the template of a whole item needs, where the item has fewer than a window asks for

_IS_NUMBER, _IS_NAME, _IS_UNIT, _ENDS, _GLUED = 1, 2, 4, 8, 16

UNITS = frozenset(
    "% ° °c °f $ € £ mm cm m km in ft yd mi miles mile inches inch feet foot yards yard meters meter metres metre kilometers kilometer"
    " kilometres kilometre mg g kg t lb lbs oz ounces ounce pounds pound grams gram kilograms kilogram tons ton ml cl l liters liter litres"
    " litre gallons gallon s sec secs seconds second min mins minutes minute h hr hrs hours hour days day weeks week months month years year"
    " kmh mph hz khz mhz ghz w kw mw v kv a ma kb mb gb tb cents cent dollars dollar euros euro percent degrees degree".split()
)

_EDGE = re.compile(r"^[^\w%°$€£]+|[^\w%°$€£]+$")
_NUMBER = re.compile(r"[+-]?\d+(?:[.,:/]\d+)*")
_GLUE = re.compile(r"([$€£]?)(\d+(?:[.,:/]\d+)*)([^\W\d_]+|[%°$€£]\w?)?")
_SPLIT_GLUE = re.compile(r"(?<=\d)(?=[^\W\d_]|[%°$€£])|(?<=[$€£])(?=\d)")
_WORD = re.compile(r"\S+")


def _core(token: str) -> str:
    return _EDGE.sub("", token).replace("_", "")


@dataclass
class Coder:
    """Codes of raw tokens. Words that the benchmark never uses share one code that matches nothing."""

    words: dict[str, int] = field(default_factory=dict)
    learning: bool = True
    memo: dict[str, int] = field(default_factory=dict)

    def of(self, token: str) -> int:
        """Code in the low 24 bits, then five flags, then 34 bits that tell raw values apart."""
        # Letters and digits alone have no edge to cut off and end no sentence.
        bare = token.isalnum()
        core = token if bare else _core(token)
        low = core.lower()
        if not core:
            # Marks alone are no token, but a full stop among them still ends the sentence.
            return NOTHING | (_ENDS if token[-1] in ".!?:" else 0) << 24
        flags = 0
        if low[0].isalpha():
            pass  # neither a number nor an amount with its unit
        elif _NUMBER.fullmatch(low):
            flags |= _IS_NUMBER
        elif low[0] in "$€£" or low[0].isdigit():
            made = _GLUE.fullmatch(low)
            if made and (made[1] or made[3]) and (not made[3] or made[3] in UNITS):
                flags |= _GLUED
        if low in UNITS:
            flags |= _IS_UNIT
        if core[0].isupper() and core[1:].islower():
            flags |= _IS_NAME
        if not bare and token.rstrip("\"')]}»”’")[-1:] in (".", "!", "?", ":"):
            flags |= _ENDS
        code = self.words.get(low, UNKNOWN)
        if not code and self.learning:
            code = self.words[low] = FIRST_WORD + len(self.words)
        raw = xxhash.xxh64_intdigest(low) & ((1 << 34) - 1)
        return raw << 29 | flags << 24 | code

    def tokens(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Tokens that count, their template codes and their raw codes."""
        memo, tokens, starts = self.memo, [], []
        if len(memo) > MEMO:
            memo.clear()
        for line in text.split("\n"):
            starts.append(len(tokens))
            tokens += line.split()
        for t in set(tokens):
            if t not in memo:
                memo[t] = self.of(t)
        packed = np.fromiter(map(memo.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        flags = packed >> 24 & 31
        if (flags & _GLUED).any():
            return self.tokens(_SPLIT_GLUE.sub(" ", text))
        first = np.zeros(len(tokens) + 1, dtype=bool)
        first[np.array(starts)] = True
        first = first[:-1]
        first[1:] |= (flags[:-1] & _ENDS) != 0
        code = packed & 0xFFFFFF
        there = code != NOTHING
        if not there.all():
            tokens = [t for t, k in zip(tokens, there) if k]
            packed, flags, code, first = packed[there], flags[there], code[there], first[there]
        number = (flags & _IS_NUMBER) != 0
        beside = np.zeros(len(code), dtype=bool)
        beside[1:] |= number[:-1]
        beside[:-1] |= number[1:]
        code = np.where((flags & _IS_NAME != 0) & ~first, NAME, code)
        code = np.where((flags & _IS_UNIT != 0) & beside, UNIT, code)
        code = np.where(number, NUMBER, code)
        return tokens, code, packed >> 29


def _windows(code: np.ndarray, raw: np.ndarray, width: int, literals: int) -> Iterator[tuple[int, tuple]]:
    """Position and key of every window whose tokens the benchmark may know.

    A window with too few literal words would match anything of its shape, so its raw values are its key; its
    template is looked up within a stretch of `_stretches`.
    """
    if len(code) < width:
        return
    known = np.concatenate(([0], np.cumsum(code != UNKNOWN)))
    plain = np.concatenate(([0], np.cumsum(code >= FIRST_WORD)))
    n = len(code) - width + 1
    enough = plain[width:] - plain[:n] >= literals
    for i in np.flatnonzero(known[width:] - known[:n] == width):
        if enough[i]:
            yield int(i), tuple(code[i : i + width].tolist())
        else:
            yield int(i), (-1, *raw[i : i + width].tolist())


def _stretches(code: np.ndarray, width: int, literals: int, whole: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and hash of all stretches that stand for windows with too few literal words.

    From each such window's begin onwards, and from its end backwards, a stretch reaches just as far as it takes to
    hold `literals` literal words; where it ends follows from the codes alone. Besides, stretches of the lengths
    `whole` are those of items that have too few literal words in all. Only stretches of up to `longest` tokens that
    the benchmark may know are returned.
    """
    none = np.empty(0, np.int64)
    known = np.concatenate(([0], np.cumsum(code != UNKNOWN)))
    n = len(code) - width + 1
    wide = n > 0 and longest > width and bool((known[width:] - known[:n] == width).any())
    whole = whole[whole <= len(code)]
    if not wide and not len(whole):
        return none, none, none
    plain = np.concatenate(([0], np.cumsum(code >= FIRST_WORD)))
    begins, ends = [none], [none]
    if wide:
        few = np.flatnonzero((plain[width:] - plain[:n] < literals) & (known[width:] - known[:n] == width))
        # The first end with enough literal words behind a begin, and the last begin with enough before an end.
        end = np.searchsorted(plain, plain[few] + literals, side="left")
        begin = np.searchsorted(plain, plain[few + width] - literals, side="right") - 1
        begins += [few[end <= len(code)], begin[begin >= 0]]
        ends += [end[end <= len(code)], few[begin >= 0] + width]
    for w in whole:
        n = len(code) - w + 1
        begins.append(np.flatnonzero((plain[w:] - plain[:n] >= LEAST) & (plain[w:] - plain[:n] < literals)))
        ends.append(begins[-1] + w)
    begin, end = np.concatenate(begins), np.concatenate(ends)
    fits = (known[end] - known[begin] == end - begin) & (end - begin <= longest)
    begin, end = begin[fits], end[fits]
    if not len(begin):
        return none, none, none
    up, down = _powers(len(code))
    sums = np.concatenate((np.zeros(1, _U64), np.cumsum(_mixed(code.astype(_U64) + _U64(1)) * up[: len(code)], dtype=_U64)))
    return begin, end, _mixed((sums[end] - sums[begin]) * down[begin]).view(np.int64)


@dataclass
class Index:
    """Windows of a bounded part of the benchmark."""

    coder: Coder
    items: list[tuple[object, list[str], np.ndarray, np.ndarray]]
    windows: dict[int, dict[tuple, list[tuple[int, int]]]]
    stretches: dict[tuple[int, int], list[tuple[int, int]]]
    whole: np.ndarray
    longest: int
    width: int
    literals: int

    @staticmethod
    def of(rows: list[tuple[object, str]], width: int, literals: int) -> Index:
        coder, items, windows, stretches, whole, longest = Coder(), [], defaultdict(lambda: defaultdict(list)), defaultdict(list), set(), 0
        for key, text in rows:
            tokens, code, raw = coder.tokens(text)
            if tokens:
                w = min(width, len(tokens))
                for i, k in _windows(code, raw, w, min(literals, w)):
                    windows[w][k].append((len(items), i))
                n_plain = int((code >= FIRST_WORD).sum())
                own = {len(tokens)} if LEAST <= n_plain < min(literals, len(tokens)) else set()
                for i, end, h in set(zip(*(x.tolist() for x in _stretches(code, width, literals, np.array([*own], np.int64), 1 << 62)))):
                    stretches[end - i, h].append((len(items), i))
                    longest = max(longest, end - i)
                whole |= own
                items.append((key, tokens, code, raw))
        coder.learning = False
        coder.memo.clear()
        return Index(coder, items, {w: dict(found) for w, found in windows.items()}, dict(stretches), np.array(sorted(whole), np.int64), longest, width, literals)

    def matches(self, text: str) -> Iterator[dict]:
        """The leaked items of a text, each with its best alignment and the characters that it covers."""
        if not self.windows:
            return
        tokens, code, raw = self.coder.tokens(text)
        covered: dict[tuple[int, int], set[tuple[int, int]]] = defaultdict(set)
        for w, index in self.windows.items():
            for at, key in _windows(code, raw, w, min(self.literals, w)):
                for item, i in index.get(key, ()):
                    covered[item, at - i].add((i, i + w))
        if self.stretches:
            for at, end, h in zip(*(x.tolist() for x in _stretches(code, self.width, self.literals, self.whole, self.longest))):
                for item, i in self.stretches.get((end - at, h), ()):
                    if (self.items[item][2][i : i + end - at] == code[at:end]).all():
                        covered[item, at - i].add((i, i + end - at))
        best: dict[int, tuple] = {}
        for (item, shift), ranges in covered.items():
            places, reached = set(), 0
            for lo, hi in sorted(ranges):
                places.update(range(max(lo, reached), hi))
                reached = max(reached, hi)
            _, words, codes, raws = self.items[item]
            enough = max(min(self.width, len(words)), min(20, -(-3 * len(words) // 5)))
            same = {i for i in places if raws[i] == raw[i + shift]}
            there, back, consistent = {}, {}, True
            for i in places - same if len(places) >= enough else ():
                # Placeholders that differ: the same value must always stand for the same value.
                a, b = int(raws[i]), int(raw[i + shift])
                consistent &= there.setdefault(a, b) == b and back.setdefault(b, a) == a
            for i in same if there else ():
                a = int(raws[i])
                if codes[i] < FIRST_WORD:
                    consistent &= there.setdefault(a, a) == a and back.setdefault(a, a) == a
            kept = places if consistent else same
            if len(kept) < enough:
                continue
            changed = len(kept - same)
            found = (len(kept), -changed, -shift, min(kept) + shift, max(kept) + shift, len(words))
            if item not in best or found > best[item]:
                best[item] = found
        if not best:
            return
        spans = self._spans(text)
        for item, (n, changed, _, lo, hi, size) in sorted(best.items()):
            yield {
                "item": self.items[item][0],
                "kind": "reparameterised" if changed else "exact",
                "matched": n,
                "coverage": n / size,
                "changed": -changed,
                "start": spans[lo][0],
                "end": spans[hi][1],
            }

    @staticmethod
    def _spans(text: str) -> list[tuple[int, int]]:
        """Character positions of the tokens, those that were split from a unit included."""
        spans = []
        for m in _WORD.finditer(text):
            cuts = [m.start(), *(m.start() + c.start() for c in _SPLIT_GLUE.finditer(m[0])), m.end()]
            parts = [(a, b) for a, b in zip(cuts, cuts[1:]) if _core(text[a:b])]
            made = _GLUE.fullmatch(_core(m[0]).lower())
            split = made and (made[1] or made[3]) and (not made[3] or made[3] in UNITS)
            if split:
                spans += parts
            elif parts:
                spans.append((m.start(), m.end()))
        return spans


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    *,
    width: int = 8,
    literals: int = 4,
    part_chars: int = 16_000_000,
) -> DataFrame:
    """Leaked items: key, item, `kind`, `matched` and `changed` tokens, `coverage`, `start` and `end` characters.

    One row per document row and leaked item, of the item's best alignment. An item leaks if aligned tokens
    reach three fifths of it, or 20 tokens, and never fewer than a window; an item shorter than a window must
    appear whole. With other parameters, aligned stretches hold `literals` literal words each; an item that has
    only three in all must appear whole, and one that has fewer beside its slots is found with its own values only:
    its template would match anything of its shape. `kind` is `exact` or `reparameterised`. Documents without a leak have no row. Null and
    empty texts of either table match nothing; repeated rows are judged each; an empty table gives no rows.

    The benchmark is dealt to parts of about `part_chars` characters and each part's windows travel with the
    task, so memory is bounded whatever the benchmark's size; documents are scanned once per part.
    """
    items = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text")).where("text IS NOT NULL AND text <> ''")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // part_chars))
    named = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).where("text IS NOT NULL AND text <> ''")
    schema = T.StructType(
        [
            T.StructField("doc", named.schema["doc"].dataType),
            T.StructField("item", items.schema["item"].dataType),
            *T.StructType.fromDDL("kind string, matched int, coverage double, changed int, start int, end int").fields,
        ]
    )
    wire_schema = to_arrow_schema(schema)
    found = None
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).orderBy("item", "text").collect()
        index = Index.of([(r["item"], r["text"]) for r in own], width, literals)
        wire = named.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], wire=wire) -> Iterator[pa.RecordBatch]:
            index = wire.value
            for batch in batches:
                # One text at a time becomes a Python string.
                rows = zip(batch.column(0), batch.column(1))
                yield pa.RecordBatch.from_pylist([{"doc": d.as_py(), **m} for d, t in rows for m in index.matches(t.as_py())], wire_schema)

        rows = named.mapInArrow(run, schema)
        found = rows if found is None else found.unionByName(rows)
    return found.select(F.col("doc").alias(key), F.col("item").alias(item), "kind", "matched", "coverage", "changed", "start", "end")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without a leaked item, with their own columns only.

    Leaked texts are told by their hash, whatever their id: rows without an id go as well, and other rows of an id stay.
    """
    name = free_name("__text", docs.columns)
    named = docs.withColumn(name, F.unhex(F.md5(F.col(text))))
    leaked = cut(find_leaks(named, benchmark, name, text, **options).select(name).distinct(), "leaked-texts")
    return by_ids(named, leaked, name, "left_anti").select(*quoted(docs.columns))
