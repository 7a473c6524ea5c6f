"""Token counts with a digest cache.

Every text is normalised (null becomes empty; nothing else, since any other change could change
a count) and known by the SHA-256 of its UTF-8 bytes; a tokenizer's version is the SHA-256 of
its file.  The cache is a Parquet table (content, tokenizer, n_tokens).  Digests that it lacks
are encoded, each once however many documents have the text, and appended to it; then all
documents take their count from it by joining both digests.

Counts are what the library gives for the file: ``tokenizers`` for ``.json``, ``sentencepiece``
for ``.model``, without begin, end or added special tokens, special strings inside a text
handled as its default, neither truncated nor padded.  A byte-level ``.json`` whose vocabulary
also lies beside it as ranks is encoded by the ranks, which give the same ids several times
faster; texts that hold an added token's string go to the library itself.

Scale: texts are reduced to one per digest inside each task before they are shuffled, so a text
that a third of all documents share moves once a task; texts that are stored already do not
move at all where the list of misses is small enough for Spark's own broadcast bound.  Misses
are spread by digest.  The join back moves only digests and counts, from two written tables, so
a hot digest is split by the adaptive join.

Recovery: an append is one Spark write, committed as a whole.  Two jobs that count the same
text at the same time both append it; readers take one row a digest.  A job that is lost before
its append leaves the cache as it was.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows and repeated or
null doc_ids each give their own row; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import os

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import chunks, fresh, prepare, settle
from .packing import encoder

CACHE = "content binary, tokenizer string, n_tokens long"


def version(path: str) -> str:
    """Digest of a tokenizer's file."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


@functools.lru_cache(2)
def counter(path: str):
    """Text -> number of tokens, as the library for the file gives it."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text))
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    library = lambda text: len(own.encode(text, add_special_tokens=False).ids)
    if not os.path.exists(path.removesuffix(".json") + ".tiktoken"):
        return library
    ranks, added = encoder(path), [t.content for t in own.get_added_tokens_decoder().values()]
    return lambda text: library(text) if any(t in text for t in added) else len(ranks(text))


def _count(path: str, digest: str):
    def run(batches):
        count = counter(path)
        for b in chunks(batches):
            n = [count(t) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("content"), pa.array([digest] * len(n), pa.string()), pa.array(n, pa.int64())], names=["content", "tokenizer", "n_tokens"])

    return run


def stored(spark: SparkSession, cache: str) -> DataFrame:
    """The cache, empty if it was never written; one row a pair of digests."""
    try:
        rows = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)
    return rows.groupBy("content", "tokenizer").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, cache: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens): one row a document.

    ``path``: the tokenizer's file, on every node.  ``cache``: folder of the cache, which all
    executors share; without one, a new folder below ``spark.checkpoint.dir`` is begun.
    """
    spark, n = prepare(docs.sparkSession), F.col
    cache, tokenizer = cache or fresh(spark, "token-counts"), version(path)
    text = F.coalesce(n("text").cast("string"), F.lit(""))
    texts = docs.select(n("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("content"))
    content = settle(texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content"), "content")
    have = stored(spark, cache).where(n("tokenizer") == tokenizer).select("content")
    misses = settle(content.select("content").distinct().join(have, "content", "left_anti"), "misses")
    # first one text a digest (map-side), then the misses: no hot digest meets the join
    once = texts.groupBy("content").agg(F.first("text").alias("text"))
    new = once.join(misses, "content", "left_semi").mapInArrow(_count(path, tokenizer), CACHE)
    new.write.mode("append").option("compression", "zstd").parquet(cache)
    counts = settle(stored(spark, cache).where(n("tokenizer") == tokenizer).select("content", "n_tokens"), "counts")
    out = content.join(counts, "content")
    return out.select("doc_id", "n_bytes", "n_tokens", (n("n_tokens") > limit).alias("over_limit"))
