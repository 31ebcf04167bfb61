"""Token counts through a digest cache: only texts that no earlier run has counted are encoded."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from importlib.metadata import version

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contigua.llm.bpe import codec
from contigua.llm.common import id_and_text, lean, text_digest
from contigua.runtime import materialize

#: Characters encoded at once; bounds what the library holds besides the texts.
_BATCH = 1 << 18
_CACHE_SCHEMA = "version binary, digest binary, n_tokens long"


def tokenizer_version(path: str) -> bytes:
    """Digest of the tokenizer file, and of the name and version of the library whose counts are stored."""
    name = "sentencepiece" if path.endswith(".model") else "tokenizers"
    return hashlib.sha256(f"{name} {version(name)}".encode() + b"\0" + open(path, "rb").read()).digest()


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of texts as the file's library gives them: no added begin, end or special tokens, nothing cut or padded."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    try:  # a byte-level merge list: the transducer gives the library's ids, and remembers pre-tokens
        encode = codec(path).encode
        return lambda texts: [sum(map(len, encode(t))) // 4 for t in texts]
    except ValueError:
        pass
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return lambda texts: [len(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


_COUNTERS: dict[str, Callable[[list[str]], list[int]]] = {}


def _batches(texts: list[str]) -> Iterator[list[str]]:
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t)
        if held >= _BATCH:
            yield part
            part, held = [], 0
    if part:
        yield part


def _cached(spark, cache_path: str, version: bytes) -> DataFrame:
    """Counts of this tokenizer version in the cache, one row a digest; none yet: empty."""
    try:
        found = spark.read.schema(_CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], _CACHE_SCHEMA)
    return found.filter(F.col("version") == F.lit(version)).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


#: Rows (id and digest) that a task remembers to pass over repeats before the shuffle.
_SEEN = 500_000


def _first_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without those that repeat id and digest within a task, so that a hot one costs a row a task."""
    seen: set = set()
    for b in batches:
        keep = []
        for key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            keep.append(key not in seen)
            seen.add(key)
        if len(seen) > _SEEN:
            seen.clear()
        yield b.filter(pa.array(keep, pa.bool_()))


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] = lambda c: c, max_tokens: int = 512) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` of every document.

    ``cache_path`` (Parquet, appended to, shared by runs) holds counts by tokenizer version and digest of the
    normalised text. ``normalise`` must keep counts; the default takes texts as they are. Null counts as empty (no
    tokens). Equal texts are encoded once, whatever their number and ids, null ones too; repeated rows come out repeated; an empty table gives
    an empty one; other columns are ignored.
    """
    spark, mine = docs.sparkSession, tokenizer_version(tokenizer_path)
    text = F.coalesce(normalise(F.col("_text")), F.lit(""))
    slim = id_and_text(docs, id_col, text_col).select("_id", F.octet_length(F.coalesce("_text", F.lit(""))).cast("long").alias("n_bytes"), text.alias("_text"))
    slim = slim.withColumn("digest", text_digest(F.col("_text")))
    keyed = materialize(slim.select("_id", "n_bytes", "digest"), "token-keys")
    need = keyed.groupBy("digest").agg(F.min("_id").alias("_rep")).join(_cached(spark, cache_path, mine), "digest", "left_anti")
    # one holder of each digest hands over its text; both keys, so that copies of one text don't meet in one task
    want = need.withColumnRenamed("digest", "_want")
    kind = slim.schema["_id"].dataType.simpleString()
    once = slim.select("_id", "digest", "_text").mapInArrow(lean(_first_in_task), f"_id {kind}, digest binary, _text string")
    misses = once.join(want.hint("merge"), (F.col("digest") == F.col("_want")) & F.col("_id").eqNullSafe(F.col("_rep"))).select("digest", "_text").sortWithinPartitions("digest")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _COUNTERS:
            _COUNTERS[tokenizer_path] = counter(tokenizer_path)
        count = _COUNTERS[tokenizer_path]
        last = None
        for b in batches:
            # rows of several tasks that repeat id and text have come together
            digests = b.column(0).to_pylist()
            new = [d != e for d, e in zip(digests, [last, *digests], strict=False)]
            b, last = b.filter(pa.array(new, pa.bool_())), digests[-1] if digests else last
            n = [x for part in _batches(b.column(1).to_pylist()) for x in count(part)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    fresh = misses.mapInArrow(lean(encode), "digest binary, n_tokens long")
    fresh.select(F.lit(mine).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    counts = materialize(_cached(spark, cache_path, mine), "token-counts")
    return keyed.join(counts, "digest").select(F.col("_id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit"))
