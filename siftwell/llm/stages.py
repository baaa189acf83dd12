"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir), applies one operator and returns documents.

All but the last return the columns that came in, whatever they are beside doc_id, text, source and n_chars;
n_chars, if there, follows the text.  Empty tables give empty results.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm import toxicity
from siftwell.llm.mixing import mix_sources
from siftwell.llm.near_dedup import grouped
from siftwell.llm.packing import pack
from siftwell.llm.pii import find, redact
from siftwell.llm.shared import fresh, slices, text_buffers, words


def _with_text(part: pa.RecordBatch, texts: list) -> pa.RecordBatch:
    """The batch with new texts, and n_chars to match."""
    columns = list(part.columns)
    for i, field in enumerate(part.schema):
        if field.name == "text":
            columns[i] = pa.array(texts, field.type)
        elif field.name == "n_chars":
            columns[i] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(field.type)
    return pa.RecordBatch.from_arrays(columns, schema=part.schema)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on the labelled ones, does not reject."""
    chain = spark.sparkContext.broadcast(toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))

    def run(batches):
        chain_ = chain.value
        for part in slices(batches, "text"):
            yield part.filter(pa.array(~toxicity.rejected(chain_, *text_buffers(part.column(part.schema.get_field_index("text"))))))

    return docs.mapInArrow(run, docs.schema)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.8): its smallest doc_id.

    If several rows of the group have that doc_id, one of them stays; null doc_ids stay.
    """
    found = grouped(docs, percent=80).filter("kept AND doc_id IS NOT NULL").groupBy("doc_id", "group", "text_key").agg(F.count("*").alias("copies"))
    alone = F.when(F.col("group").isNull(), F.col("text_key"))
    kept = found.groupBy("doc_id", "group", alone.alias("alone")).agg(F.min(F.struct("text_key", "copies")).alias("one"))
    key, text, rank = (fresh(docs, x) for x in ("__kept", "__text", "__rank"))
    kept = kept.select(F.col("doc_id").alias(key), F.col("one.text_key").alias(text), F.col("one.copies").alias(rank))
    one = docs.filter("doc_id IS NOT NULL").join(kept, (docs.doc_id == kept[key]) & (F.xxhash64(docs.text) == kept[text]))
    single = one.filter(F.col(rank) == 1).select(docs.columns)
    many = one.filter(F.col(rank) > 1).dropDuplicates(["doc_id", "text"]).select(docs.columns)
    return single.union(many).union(docs.filter("doc_id IS NULL"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, disguised or not, replaced by its kind."""

    def run(batches):
        for part in slices(batches, "text"):
            texts = part.column(part.schema.get_field_index("text")).to_pylist()
            yield _with_text(part, [None if t is None else redact(t, [s for side in find(t) for s in side]) for t in texts])

    return docs.mapInArrow(run, docs.schema)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's documents: a row for each time that a text is taken whole, and one for the part taken once more."""
    plan = mix_sources(docs).groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text")).agg(F.collect_list(F.struct("passes", "ranges")).alias("__plans"))
    w = Window.partitionBy("__id", "__text").orderBy(F.lit(0))
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names).withColumn("__id", F.col(names[docs.columns.index("doc_id")])).withColumn("__text", F.xxhash64(F.col(names[docs.columns.index("text")])))
    plain = plain.withColumn("__n", F.row_number().over(w))
    plan = plan.withColumnRenamed("__id", "__pid").withColumnRenamed("__text", "__ptext")
    both = plain.join(plan, F.col("__id").eqNullSafe(F.col("__pid")) & (F.col("__text") == F.col("__ptext"))).withColumn("__p", F.get("__plans", F.col("__n") - 1))
    both = both.select(*names, F.col("__p.passes").alias("passes"), F.col("__p.ranges").alias("ranges")).filter("passes > 0 OR size(ranges) > 0")
    at, n, schema = docs.columns.index("text"), len(names), docs.schema
    width = [f.name for f in schema]

    def run(batches):
        for part in slices(batches, names[at]):
            rows = pa.RecordBatch.from_arrays(part.columns[:n], width)
            texts, passes, ranges = part.column(at).to_pylist(), part.column(n).to_pylist(), part.column(n + 1).to_pylist()
            take, out = [], []
            for i, (t, k, r) in enumerate(zip(texts, passes, ranges, strict=True)):
                take += [i] * k
                out += [t] * k
                if r:
                    take.append(i)
                    out.append(_spans(t, r))
            for a in range(0, len(take), 512):
                yield _with_text(rows.take(pa.array(take[a : a + 512], pa.int64())), out[a : a + 512])

    return both.mapInArrow(run, schema)


def _spans(text: str, ranges: list[int]) -> str:
    """The text's spans of words [from, to), as they stand, joined by a line feed."""
    data, off = text_buffers(pa.array([text], pa.string()))
    starts, ends, _ = words(data, off)
    raw = data.tobytes()
    return "\n".join(raw[starts[a] : ends[b - 1]].decode() for a, b in zip(ranges[::2], ranges[1::2], strict=True))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of 1024 tokens: see packing.pack."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
