"""Language identification by compression.

Each language has a raw-content zstandard dictionary of its own text.  A text is cut into
pieces; every piece is compressed with each dictionary, and the language whose dictionary
makes the whole text smallest is its prediction.  The margin, one minus the smallest total
over the next, is the score, and a prediction with a narrow margin is marked as rejected.

The dictionaries are learned from a bounded sample: lines of each language, long ones in
pieces, are chosen by a hash of their text and place, about ``SAMPLE_BYTES`` for a language
and one at least, and put in hash order until the dictionary is full.  Everything else
covers whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DICT_BYTES = 64 << 10         # content of one language's dictionary
TOTAL_BYTES = 64 << 20        # of all dictionaries; with very many languages each gets less
SAMPLE_BYTES = 512 << 10      # sampled text of one language, expected
SAMPLE_CHARS = 4096           # longest piece of a line that is sampled as one
PIECE_CHARS = 8192
LEVEL = 6
MIN_MATCH = 4         # words are short; the level's own minimum would miss them
MIN_MARGIN = 0.01
UNKNOWN = "und"
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def letters(text: str | None) -> str:
    """Lower-case words of letters and their marks with one space between; empty if there is no letter.

    Marks are the vowel signs of many scripts.  Superscripts, fractions and circled digits are no letters.
    """
    words = _OTHER.sub(" ", (text or "").lower()).strip()
    return words if _LETTER.search(words) else ""


def pieces(text: str, size: int = PIECE_CHARS) -> list[bytes]:
    """The whole text in pieces of nearly equal length, none longer than ``size``."""
    n = max(1, -(-len(text) // size))
    cuts = [len(text) * i // n for i in range(n + 1)]
    return [text[a:b].encode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]


def learn(docs: DataFrame, text_col: str, lang_col: str, order: Column) -> dict[str, bytes]:
    """Dictionary content of each language; ``order`` is a 64-bit hash that chooses the sample."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), order.alias("h"))
    # one row for each language
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect() if r["n"]}
    if not sizes:
        return {}
    own = min(DICT_BYTES, TOTAL_BYTES // len(sizes))
    sample = min(SAMPLE_BYTES, own * 12)
    # lines, long ones in pieces, so that a long document is spread over the sample
    parts = labelled.select("lang", "h", F.posexplode(F.regexp_extract_all("text", F.lit(f"[^\n]{{1,{SAMPLE_CHARS}}}"), F.lit(0))).alias("n", "piece")).select(
        "lang", F.pmod(F.xxhash64("h", "n"), F.lit(1 << 30)).alias("h"), "piece")
    shares = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, float(min(1.0, sample / n)))])
    chosen = parts.where(F.col("h") < F.element_at(shares, F.col("lang")) * (1 << 30)).where(F.col("piece").rlike(r"\p{L}"))
    # the sample is bounded: sample bytes for each language
    held: dict[str, list[tuple[int, str]]] = {}
    for row in chosen.select("lang", F.xxhash64("piece").alias("h"), "piece").distinct().toLocalIterator():
        held.setdefault(row["lang"], []).append((row["h"], row["piece"]))
    missed = sorted(set(sizes) - set(held))
    if missed:
        # the piece of least hash, so that every language with a letter has a dictionary
        rest = parts.where(F.col("lang").isin(missed) & F.col("piece").rlike(r"\p{L}"))
        for row in rest.groupBy("lang").agg(F.min(F.struct("h", "piece")).alias("b")).select("lang", "b.*").collect():
            held[row["lang"]] = [(row["h"], row["piece"])]
    return {lang: " ".join(letters(x) for _, x in sorted(rows)).encode("utf-8", "replace")[:own] for lang, rows in held.items()}


class Classifier:
    """Compressors of all languages; made once in each worker."""

    def __init__(self, content: dict[str, bytes]):
        self.langs = sorted(content)
        self.compress = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, source_size=PIECE_CHARS, dict_size=len(content[lang]), min_match=MIN_MATCH,
                write_content_size=0, write_checksum=0, write_dict_id=0)
            self.compress.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its margin over the next; without a letter, unknown and 0."""
        words = letters(text)
        if not words or not self.langs:
            return UNKNOWN, 0.0
        parts = pieces(words)
        sizes = [sum(len(compress(p)) for p in parts) for compress in self.compress]
        best, *others = sorted(range(len(sizes)), key=lambda i: (sizes[i], self.langs[i]))
        if not others:
            return self.langs[best], 1.0
        return self.langs[best], 1.0 - sizes[best] / sizes[others[0]]


def _predict(shared, margin: float, types: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(shared.value)
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([
                *batch.columns[1:], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()),
                pa.array([s < margin for _, s in found], pa.bool_())], schema=types)

    return run


def language_id(
    docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    carry: tuple[str, ...] = (), margin: float = MIN_MARGIN,
) -> DataFrame:
    """One row for each input row: id, carried columns, lang_pred, score and rejected.

    ``training`` gives text and language; rows without either are not learned from.  Only
    the text is an input of the prediction.  ``und`` with score 0, rejected, for a text that is
    null or has no letter, and for every text if nothing was learned.  Equal sizes go to the
    first language by name, with score 0, rejected.  Repeated rows give equal rows; other
    columns are not read.  An empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    content = learn(training, text_col, lang_col, F.xxhash64(F.col(text_col)))
    shared = docs.sparkSession.sparkContext.broadcast(content)
    own = docs.select(F.col(text_col).alias("text"), *[F.col(c).alias(f"c{n}") for n, c in enumerate((id_col, *carry))])
    kept = own.schema.fields[1:]
    types = pa.schema([*[(f.name, to_arrow_type(f.dataType)) for f in kept], ("lang_pred", pa.string()), ("score", pa.float64()),
                       ("rejected", pa.bool_())])
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in kept], "lang_pred string, score double, rejected boolean"])
    return own.mapInArrow(_predict(shared, margin, types), schema).toDF(id_col, *carry, "lang_pred", "score", "rejected")
