"""Language identification by compression.

For each language, texts of a bounded sample make a raw-content dictionary. A text, lower-cased and
reduced to its letters, is cut into blocks, each block is compressed with every dictionary, and the language whose total is smallest is
chosen: the better a dictionary foretells the text, the fewer bytes are left. Where the two smallest
totals are nearly equal, the choice is rejected.

The sample is SAMPLE_DOCS texts of each of the MOST_LANGS languages of most distinct texts (ties by name),
those of the smallest hashes of their content, so that copies count once; PIECE characters of each,
DICTIONARY bytes in all. It reaches the driver, which MOST_LANGS x SAMPLE_DOCS x PIECE bounds. No language
is gathered in one task: hashes beyond SPARE times the share that the sample needs are left out before
they meet (that fewer are left than needed has no chance that counts). Prediction compresses whole texts,
in one narrow pass.

A null text, or one without a letter, is `und`, with score 0, and rejected. If no text has a language,
all are `und`. Ties go to the language first in order. Repeated rows give repeated results; an empty
table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.llm import storage

UNKNOWN = "und"
SAMPLE_DOCS, PIECE, DICTIONARY = 64, 2000, 64 << 10
#: Languages that are learned at most; hashes kept for each hash that is sampled.
MOST_LANGS, SPARE = 128, 16
#: Block of a text compressed at once: short enough that the dictionary, not the text itself, foretells it.
BLOCK, LEVEL = 4096, 6
#: Least lead of the smallest total over the next, as a share of it.
MARGIN = 0.005
#: Scores: 1 - exp(-lead / SCALE).
SCALE = 0.1


#: ASCII signs other than letters become blanks, so that case, digits and punctuation tell nothing.
LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def letters(text: str) -> bytes:
    """Lower-cased text, in UTF-8, with single blanks between runs of letters."""
    return b" ".join(text.lower().encode().translate(LETTERS).split())


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """Documents that models may learn from; the rest are held out."""
    return F.crc32(F.col(id_col).cast("string")) % 4 != 2


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Language -> dictionary, from the rows of docs that have a text with a letter and a language."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"), F.substring(text_col, 1, PIECE).alias("piece"))
    # Copies meet as one hash, by partial sums.
    each = storage.cut(rows.select("lang", "h").distinct(), "hashes")
    known = each.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()
    if not known:
        return {}
    # A language's smallest hashes lie below a bound that its number of texts tells (as a share of 2^63 on each side).
    bound = F.create_map(*[F.lit(x) for k in known for x in (k.lang, min(1.0, SPARE * SAMPLE_DOCS / k.n))])
    low = each.where(F.col("h") / float(1 << 64) + 0.5 <= F.try_element_at(bound, F.col("lang")))
    picked = low.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= SAMPLE_DOCS)
    picked = storage.cut(picked.select(F.col("lang").alias("l"), F.col("h").alias("k")), "picked")
    sample = rows.join(F.broadcast(picked), (F.col("lang") == F.col("l")) & (F.col("h") == F.col("k")), "left_semi").dropDuplicates(["lang", "h"])
    by: dict[str, list[tuple[int, str]]] = {}
    for x in sample.select("lang", "h", "piece").toLocalIterator():
        by.setdefault(x.lang, []).append((x.h, x.piece))
    return {lang: b" ".join(letters(p) for _, p in sorted(pieces))[-DICTIONARY:] for lang, pieces in sorted(by.items())}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        self.packers = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def sizes(self, text: bytes) -> list[int]:
        blocks = [text] if len(text) <= BLOCK else [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
        return [sum([len(pack(b)) for b in blocks]) for pack in self.packers]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, and whether it is rejected."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(letters(text))
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = [s for i, s in enumerate(sizes) if i != best]
        lead = (min(rest) - sizes[best]) / sizes[best] if rest else 1.0
        return self.langs[best], round(1 - math.exp(-lead / SCALE), 6), lead < MARGIN


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected added (columns of those names are replaced)."""
    storage.small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "rejected")
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(sent.value)
        for batch in batches:
            got = [model.predict(t) for t in batch.column(at).to_pylist()]
            added = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(run, schema)


def language_predictions(docs: DataFrame) -> DataFrame:
    """The query's columns: learned from the rows that aren't held out, predicted for all."""
    model = fit(docs.where(training_rows(docs)))
    held = (~training_rows(docs)).alias("held_out")
    return identify(docs.select("doc_id", held, "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
