"""Operator 12: token counts with a cache by digest.

A text's count depends on the text and the tokenizer only. Both have a digest;
the cache is a table of (digest of the text, tokens) in a folder of its own
for each digest of a tokenizer. Counting joins the texts' digests with the
cache; of those that it lacks, one text each is encoded and appended. Texts
move in a shuffle only where they are missing, once per task that holds them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Steps, _folder, join_groups, small_batches

PIECES = "piece_bpe_32k.model"
#: Tokens beyond which a text is over the limit.
LIMIT = 4096
#: Up to so many missing digests (32 bytes each) are broadcast, so that only their texts are shuffled; beyond, all are.
FEW = 100_000
CACHED = "digest binary, n_tokens long"
_LOADED: dict[str, object] = {}


@dataclass(frozen=True)
class Tokenizer:
    """A tokenizer's file as bytes, so that executors need no file; kind: sentencepiece or tokenizers."""

    kind: str
    data: bytes

    @property
    def version(self) -> str:
        """Digest of the library, its version and the file."""
        library = __import__(self.kind)
        return hashlib.sha256(f"{self.kind} {library.__version__} ".encode() + self.data).hexdigest()

    def counter(self):
        """A function from a list of texts to their numbers of tokens, without begin, end or added special tokens."""
        if self.kind == "sentencepiece":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=self.data)
            return lambda texts: [len(model.encode(t)) for t in texts]
        from tokenizers import Tokenizer as Fast

        fast = Fast.from_str(self.data.decode())
        fast.no_truncation()
        fast.no_padding()
        return lambda texts: [len(fast.encode(t, add_special_tokens=False).ids) for t in texts]


def load(path: str | None = None) -> Tokenizer:
    """The tokenizer in a file, .model or .json; without a path the public one of 32,000 pieces."""
    path = path or public_tokenizers.path(PIECES)
    with open(path, "rb") as f:
        return Tokenizer("tokenizers" if path.endswith(".json") else "sentencepiece", f.read())


def _encoded(tokenizer: Tokenizer, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if version not in _LOADED:
            _LOADED.clear()
            _LOADED[version] = tokenizer.counter()
        count = _LOADED[version]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count(batch.column(1).to_pylist()), pa.int64())], ["digest", "n_tokens"])

    return run


def counted(df: DataFrame, tokenizer: Tokenizer | None = None, cache: str | None = None, key: str = "doc_id", text: str = "text", limit: int = LIMIT, few: int = FEW) -> DataFrame:
    """One row per row of df: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    cache: a shared folder; what is missing there is encoded and added, and
    what is there is not encoded again, for the same tokenizer only. Without
    one, a new folder in spark.checkpoint.dir. Texts are normalised in that
    null is the empty text, and in nothing else, as anything more could change
    a count. Rows are told apart by nothing: repeated and null keys each get
    their count. Other columns are not read. An empty table gives none.
    A run that breaks off before its append is whole leaves the cache as it
    was; two at once may add a text twice, which counts once.
    """
    spark, steps = df.sparkSession, Steps()
    small_batches(spark)
    tokenizer = tokenizer or load()
    at = f"{(cache or _folder(spark)).rstrip('/')}/{tokenizer.version}"
    spark.createDataFrame([], CACHED).write.mode("append").parquet(at)
    stored = lambda: spark.read.schema(CACHED).parquet(at).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    texts = df.select(F.col(f"`{key}`").alias("k"), whole.alias("t"), F.unhex(F.sha2(whole, 256)).alias("digest"))
    rows = steps.staged(texts.select("k", F.octet_length("t").cast("long").alias("n_bytes"), "digest"))
    groups = steps.staged(rows.groupBy("digest").agg(F.count("*").alias("members")))
    missing = steps.staged(groups.join(stored(), "digest", "left_anti").select("digest"))
    n = missing.count()
    if n:
        lacking = texts.join(F.broadcast(missing), "digest", "left_semi") if n <= few else texts
        once = lacking.groupBy("digest").agg(F.any_value("t").alias("t"))
        once = once if n <= few else once.join(missing, "digest", "left_semi")
        once.mapInArrow(_encoded(tokenizer, tokenizer.version), CACHED).write.mode("append").parquet(at)
    counts = steps.staged(groups.join(stored(), "digest"))
    out = join_groups(rows, counts, ["digest"], "members").select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    steps.drop_but(rows, counts)
    return out
