"""Words of a table found in texts: forbidden words, class names, any list that is data and not part of a plan.

A list of up to a million code points is sent to the tasks, where one automaton finds all of its words in one pass
over a text. The size is summed first. A longer list stays a table: texts and words meet on windows of code points,
each word on the window of its own that the fewest texts hold, and what meets is verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refledger.sources.workspace import cut

# Code points of words in one automaton, and of a window.
AT_ONCE, WINDOW = 1 << 20, 12


@lru_cache(maxsize=4)
def _automaton(sent: Broadcast) -> ahocorasick.Automaton | None:
    names: dict[str, list[str]] = {}
    for word, name in sent.value:
        names.setdefault(word, []).append(name)
    out = ahocorasick.Automaton()
    for word, own in names.items():
        out.add_word(word, own)
    if not names:
        return None
    out.make_automaton()
    return out


def _finder(sent: Broadcast) -> Callable:
    """Column function: the distinct names of all words that a text holds, in code-point order."""

    @F.arrow_udf("array<string>")
    def find(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = _automaton(sent)
        for batch in texts:
            found = []
            for text in batch:
                hits: set[str] = set()
                if automaton is not None and text.is_valid:
                    for _, own in automaton.iter(text.as_py()):
                        hits.update(own)
                found.append(sorted(hits))
            yield pa.array(found, pa.list_(pa.string()))

    return find


def _windows():
    """Batches (id, text, lengths) to the distinct windows of each text: (id, length, hash)."""

    def told(held: list[tuple]) -> pa.RecordBatch:
        ids = pa.concat_arrays([pa.array([key.as_py()] * len(seen), key.type) for key, _, seen in held])
        lengths = np.concatenate([np.full(len(seen), length, dtype=np.int32) for _, length, seen in held])
        return pa.RecordBatch.from_arrays([ids, pa.array(lengths), pa.array(np.concatenate([seen for *_, seen in held]))], ["id", "length", "hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, load = [], 0
        for batch in batches:
            for key, text, lengths in zip(batch.column(0), batch.column(1), batch.column(2)):
                codes = np.frombuffer(text.as_py().encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
                for length in lengths.as_py():
                    if len(codes) < length:
                        continue
                    at = np.zeros(len(codes) - length + 1, dtype=np.uint64)
                    for i in range(length):
                        at = (at + codes[i : len(codes) - length + 1 + i] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                        at ^= at >> np.uint64(29)
                    held.append((key, length, np.unique(at).view(np.int64)))
                    load += len(held[-1][2])
                    if load > 1 << 16:
                        yield told(held)
                        held, load = [], 0
        if held:
            yield told(held)

    return run


def _pairs(texts: DataFrame, words: DataFrame, size: int) -> DataFrame:
    """(id, word) of texts (id, text) and the words they hold, without a list in any task."""
    lengths = [r[0] for r in words.select(F.least(F.length("word"), F.lit(size)).alias("l")).distinct().orderBy("l").collect()]
    every = F.array(*map(F.lit, lengths)).cast("array<int>")
    held = cut(texts.where("text IS NOT NULL").select("id", "text", every).mapInArrow(_windows(), "id long, length int, hash long").distinct(), "text-windows")
    own = F.array(F.least(F.length("word"), F.lit(size)).cast("int"))
    asked = cut(words.select(F.col("word").alias("id"), F.col("word").alias("text"), own).mapInArrow(_windows(), "id string, length int, hash long"), "word-windows")
    at = ["length", "hash"]
    known = held.join(asked.select(*at).distinct(), at, "left_semi").groupBy(*at).agg(F.count("*").alias("n"))
    # A word with a window that no text holds is in none; of the others' windows the rarest asks.
    rarest = asked.join(known, at, "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), *at)).alias("w")).where("w.n > 0")
    rarest = rarest.select(F.col("id").alias("word"), "w.length", "w.hash")
    met = cut(held.join(rarest, at).select("id", "word").distinct(), "window-matches")
    return met.join(texts, "id").where(F.contains("text", "word")).select("id", "word").distinct()


def held_words(
    rows: DataFrame, cols: Sequence[str], words: DataFrame, *, word: str = "word", name: str | None = None, into: str = "held",
    at_once: int = AT_ONCE, window: int = WINDOW,
) -> DataFrame:
    """Add `into`: the distinct names of all words that any of the columns holds, sorted; letter case counts.

    `words` has a row per `word`, with the `name` to report for it, which is the word itself by default. Several words may
    have one name, and one word several. Null words and null texts hold nothing; the empty word is in every text that is
    not null. Repeated rows keep their place; an empty list leaves empty arrays.
    """
    listed = words.select(F.col(word).alias("word"), F.col(name or word).alias("name")).where("word IS NOT NULL").distinct()
    size = listed.agg(F.sum(F.length("word") + F.length("name")).alias("n"), F.count_if(F.col("word") == "").alias("empty")).first()
    full = listed.where("word <> ''")
    there = F.coalesce(*[F.col(f"`{c}`") for c in cols]).isNotNull()
    always = F.when(there, F.array(*[F.lit(r[0]) for r in listed.where("word = ''").select("name").collect()]) if size.empty else F.array().cast("array<string>"))
    if (size.n or 0) <= at_once:
        sent = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in full.collect()])
        find = _finder(sent)
        found = F.array_union(find(F.col(f"`{cols[0]}`")), F.coalesce(always, F.array().cast("array<string>")))
        for c in cols[1:]:
            found = F.array_union(found, find(F.col(f"`{c}`")))
        return rows.withColumn(into, F.array_sort(found))
    placed = cut(rows.withColumn("__id", F.monotonically_increasing_id()), "rows-with-places")
    texts = placed.select(F.col("__id").alias("id"), F.explode(F.array(*[F.col(f"`{c}`") for c in cols])).alias("text"))
    # One text a column; windows of a row's columns are told apart so that none runs across.
    texts = cut(texts.where("text IS NOT NULL").withColumn("own", F.col("id")).withColumn("id", F.monotonically_increasing_id()), "texts-with-places")
    pairs = _pairs(texts.select("id", "text"), full.select("word").distinct(), window)
    named = pairs.join(texts.select("id", "own"), "id").join(full, "word").groupBy(F.col("own").alias("__id")).agg(F.collect_set("name").alias("__found"))
    both = F.array_union(F.coalesce("__found", F.array().cast("array<string>")), F.coalesce(always, F.array().cast("array<string>")))
    return placed.join(named, "__id", "left").withColumn(into, F.array_sort(both)).select(*[F.col(f"`{c}`") for c in rows.columns], into)


def label_rows(rows: DataFrame, text: str, labels: DataFrame, other: str, *, at_once: int = AT_ONCE) -> DataFrame:
    """Rows with `label`, one row for each label of which a word is in the upper-cased text; `other` where there is none.

    `labels` has rows (label, word). A null text is `other`.
    """
    upper = rows.withColumn("__upper", F.upper(F.col(f"`{text}`")))
    found = held_words(upper, ["__upper"], labels, name="label", into="__labels", at_once=at_once)
    named = F.when(F.size("__labels") > 0, F.col("__labels")).otherwise(F.array(F.lit(other)))
    return found.withColumn("label", F.explode(named)).drop("__upper", "__labels")
