"""Language identification by compression.

Each language has zstandard dictionaries of raw content: plain text of that language. A text is compressed
piece by piece with every language's dictionaries, and the language whose output is smallest wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refledger.llm.common import free_name, quoted

UNKNOWN = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Model:
    """Languages with their dictionaries, the most frequent language first."""

    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]
    level: int
    piece: int


def letters(text: str) -> bytes:
    """The text's words in lower case; everything that is no letter becomes one space."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf8", "replace")


def shares(texts: Sequence[bytes], total: int) -> bytes:
    """One text of at most `total` bytes from equal shares of all texts; what short ones leave goes to the longer ones.

    A share is taken from the middle of its text, where headings and closing lines are not.
    """
    given, left = {}, total
    for done, i in enumerate(sorted(range(len(texts)), key=lambda i: (len(texts[i]), i))):
        given[i] = max(0, min(len(texts[i]), left // (len(texts) - done) - 1))
        left -= given[i] + 1
    parts = []
    for i, text in enumerate(texts):
        at = (len(text) - given[i]) // 2
        # Bytes of a letter that the cut has split are left out.
        parts.append(text[at : at + given[i]].decode("utf8", "ignore").encode("utf8"))
    return b" ".join(p for p in parts if p)


def fit(
    rows: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    *,
    docs_per_language: int = 400,
    longest: int = 20_000,
    dictionary_bytes: int = 32 << 10,
    level: int = 6,
    piece: int = 1024,
) -> Model:
    """Dictionaries from a bounded sample of labelled rows.

    The sample holds at most `docs_per_language` texts per language, chosen by a hash of their key and text, and of
    each one, whatever its length, the first `longest` characters of its words: that bound, times the number of
    languages, is all that reaches the driver. A language is learned from `dictionary_bytes` of them, 32 KiB by
    default, in equal shares of all its sampled texts. Null texts, null languages and texts without letters teach nothing. Of an empty table comes a model that
    calls every text unknown. A tie between languages goes to the one with more labelled rows.
    """
    labelled = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("h"))
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    order = sorted(counts, key=lambda g: (-counts[g], g))
    if not order:
        return Model((), (), level, piece)
    # About four times as many rows as are wanted pass a threshold on the hash; the rest never leaves the scan.
    share = F.create_map(*[F.lit(x) for g in order for x in (g, min(1.0, 4.0 * docs_per_language / counts[g]))])
    near = labelled.where(F.pmod("h", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    # What is no letter goes before the cut, so that every excerpt has letters.
    near = near.withColumn("text", F.left(F.trim(F.regexp_replace("text", r"[^\p{L}\p{Nl}\p{No}]+", " ")), F.lit(longest)))
    w = Window.partitionBy("lang").orderBy("h", "text")
    sample = near.withColumn("i", F.row_number().over(w)).where(F.col("i") <= docs_per_language).select("lang", "i", "text").collect()
    texts: dict[str, list[tuple[int, bytes]]] = {g: [] for g in order}
    for r in sample:
        texts[r["lang"]].append((r["i"], letters(r["text"])))
    learned = [(g, shares([t for _, t in sorted(texts[g])], dictionary_bytes)) for g in order]
    # Content of under eight bytes cannot serve as a dictionary.
    learned = [(g, content) for g, content in learned if len(content) >= 8]
    return Model(tuple(g for g, _ in learned), tuple(content for _, content in learned), level, piece)


def _compressors(model: Model) -> list[zstandard.ZstdCompressor]:
    made = []
    for content in model.dictionaries:
        shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        options = zstandard.ZstdCompressionParameters.from_level(
            model.level, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS
        )
        made.append(zstandard.ZstdCompressor(dict_data=shared, compression_params=options))
    return made


def judge(text: str | None, model: Model, compressors: Sequence[zstandard.ZstdCompressor]) -> tuple[str, float, int]:
    """Language, margin to the runner-up as a share of its size, and number of bytes of evidence."""
    plain = letters(text) if text is not None else b""
    if not plain or not compressors:
        return UNKNOWN, 0.0, len(plain)
    pieces = [plain[i : i + model.piece] for i in range(0, len(plain), model.piece)]
    sizes = [sum(len(c.compress(p)) for p in pieces) for c in compressors]
    best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
    others = [s for i, s in enumerate(sizes) if i != best]
    margin = 1.0 - sizes[best] / min(others) if others else 1.0
    return model.languages[best], min(1.0, max(0.0, margin)), len(plain)


def identify(text: Column, model: Model, min_margin: float = 0.01, min_evidence: int = 500) -> Column:
    """Struct of `lang`, `score` (the margin, from 0 to 1), `evidence` (bytes) and `rejected` for a text.

    Rejected are texts without a letter, and texts with at least `min_evidence` bytes of letters whose margin
    stays under `min_margin`: so much text of one language would have told. Short texts are not rejected for
    a narrow margin, since ties are what few bytes give. Null and empty texts are `und`, with score 0.
    """

    @F.pandas_udf("lang string, score double, evidence long, rejected boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressors = _compressors(model)
        for batch in batches:
            found = [judge(t, model, compressors) for t in batch]
            out = pd.DataFrame(found, columns=["lang", "score", "evidence"])
            out["rejected"] = [g == UNKNOWN or (n >= min_evidence and s < min_margin) for g, s, n in found]
            yield out

    return run(text)


def drop_rejected(docs: DataFrame, model: Model, text: str = "text", **limits) -> DataFrame:
    """The documents that are not rejected, with their own columns only."""
    found = free_name("__language", docs.columns)
    marked = docs.select("*", identify(F.col(text), model, **limits).alias(found))
    return marked.where(~F.col(f"{found}.rejected")).select(*quoted(docs.columns))
