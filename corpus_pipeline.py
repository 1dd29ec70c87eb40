"""The corpus pipeline: documents in, packed training sequences out.

Of ``documents`` the columns doc_id, text, lang, source and n_chars go from stage to
stage (n_chars is counted anew); any others are left behind.  Nulls: a null text is scored as
empty by the classifier, which decides whether it stays, has no lines and no personal data, is alike to other
wordless texts, and gives its end id alone; a null id is kept as it is.  Repeated rows go through
each, but for near-dedup, which leaves one of them.  Ties for a group's document go to the least hash
of the text.  An empty table gives no rows at any stage.

Each stage works on all that its predecessor kept; between stages the rows are
written as Parquet in the session's shared checkpoint folder, so that a lost executor costs one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinforge.llm import line_winnow, packing, pii_crf, queries, simhash, simhash_similarity, zdict_quality
from basinforge.llm.textcols import checkpointed, forget

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars anew."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the compression classifier rejects."""
    model = zdict_quality.fit(docs, queries.table(spark, sf_dir, "labels"))
    scored = zdict_quality.score(docs, model, keep=COLUMNS[1:])
    return scored.where("predicted = 1").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts runs of lines that stand earlier; drops documents of which no word is left."""
    cut = line_winnow.drop_repeated_lines(docs, least_words=50)
    return _with_text(cut.where((F.col("n_deleted_lines") == 0) | F.col("text").rlike(line_winnow.WORD)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by SimHash fingerprints of two differing bits or fewer (as op1), or by five-word shingles that are 0.8 alike."""
    return simhash_similarity.drop_near_duplicates(docs, similarity=0.8, shingle=5, bits=simhash.MAX_BITS).select(*COLUMNS)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    found = pii_crf.find_documents(docs, pii_crf.fit(docs), ("redacted",), keep=("lang", "source"))
    return _with_text(found.withColumnRenamed("redacted", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens."""
    return packing.pack(docs, packing.PackingSpec(queries.vocabulary("byte_bpe_50k.json")))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("pii", private_data),
    ("packing", pack),
]

#: No SQL states the classifier, the field and the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, before = queries.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
        if before is not None:
            forget(before)  # nothing reads it any more
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
