"""One query for every operator, over its whole table, with the digests its contract asks for."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cosine, exact, extraction, imatch, merkle, packing, quality, repeats, search, secrets, sharding, simhash
from .common import slices
from .oracles import ORACLE, op8_sql

BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")
SHARDS = [f"shard-{k:03d}" for k in range(96)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark, sf_dir):
    """Ids of every document and their decoded text, as digests."""
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), BPE_FILE)
    shared = spark.sparkContext.broadcast(bpe.read_vocabulary(BPE_FILE))

    def run(batches):
        v = bpe.vocabulary(shared.value)
        for batch in slices(batches, "ids"):
            ids = [x.values.to_numpy(zero_copy_only=False).astype("<u4") for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(v.decode(x).encode("utf-8")).hexdigest() for x in ids]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_secrets(spark, sf_dir):
    """Strong secrets and linked weak parts of every document."""
    return secrets.describe(secrets.find_secrets(_table(spark, sf_dir, "documents")))


def op3_cosine_groups(spark, sf_dir):
    """Links and components of all vectors."""
    return cosine.near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op4_resample(spark, sf_dir):
    """Which documents importance resampling keeps."""
    return quality.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_main_text(spark, sf_dir):
    """Main text of every page."""
    return extraction.extract(_table(spark, sf_dir, "pages"))


def op6_simhash(spark, sf_dir):
    """Near-duplicate groups of all documents."""
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"), words=4, distance=4).select(
        "doc_id", "fingerprint", "component_id"
    )


def op7_repeats(spark, sf_dir):
    """What is left of every document without the word windows that start earlier elsewhere."""
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"), window=20).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op8_slots(spark, sf_dir):
    """Slot and shard of every document."""
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), "doc_id", SHARDS).select("doc_id", "slot", "shard")


def op9_imatch(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts."""
    found = imatch.fingerprint_edits(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.array_join("parts", "").alias("fingerprint"),
        F.array_join("edited_parts", "").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op10_packing(spark, sf_dir):
    """Where every piece of every document lies."""
    return packing.pack(_table(spark, sf_dir, "documents"), BPE_FILE, capacity=2048, end_id=1)


def op11_merkle(spark, sf_dir):
    """Leaf, proof and folded root of every document."""
    return merkle.manifest(merkle.document_leaves(_table(spark, sf_dir, "documents")))


def op12_exact(spark, sf_dir):
    """Group of equal texts of every document."""
    return exact.duplicates(_table(spark, sf_dir, "documents"))


def op13_search(spark, sf_dir):
    """The twenty best documents for every benchmark item."""
    return search.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe, op2_secrets, op3_cosine_groups, op4_resample, op5_main_text, op6_simhash, op7_repeats, op8_slots,
        op9_imatch, op10_packing, op11_merkle, op12_exact, op13_search,
    )
}
ORACLE = ORACLE | {"op8_slots": op8_sql(SHARDS)}
