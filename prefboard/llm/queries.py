"""Registered queries of the operators for training data, and SQL where it can say them."""

import public_tokenizers
from pyspark.sql import functions as F

from prefboard.llm import chunk_bpe, collocations, ctw, decontaminate, license_scan, metric_join, minhash, oracles, packing, quality, secret_scan, sharding, spelling, warc

QUERIES = {}
ORACLE = {}


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def _table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _joined(values):
    return F.array_join(values, ",")


@query("op1_secret_scan")
def op1_secret_scan(spark, folder):
    """Secrets in every whole text, as counts, a digest of the base spans, and all spans."""
    found = secret_scan.scan_secrets(_table(spark, folder, "documents"))
    spans = F.col("secrets")
    return found.select(
        "doc_id",
        *[F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in secret_scan.KINDS[:3]],
        F.sha2(secret_scan.joined_spans(spans, secret_scan.KINDS[:3]), 256).alias("base_sha256"),
        secret_scan.joined_spans(spans).alias("spans"),
    )


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark, folder):
    """All documents packed into sequences of at most 2048 tokens."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(_table(spark, folder, "documents"), tokenizer)


@query("op8_histogram_sort")
def op8_histogram_sort(spark, folder):
    """All documents in 40 shards of near-equal bytes."""
    sharded = sharding.shard_documents(_table(spark, folder, "documents"), 40)
    return sharded.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op9_license_scan", oracles.LICENSES)
def op9_license_scan(spark, folder):
    """Licence phrases and notices in every whole text."""
    found = license_scan.find_licenses(_table(spark, folder, "documents"))
    matches = F.col("licenses.matches")
    base = F.filter(matches, lambda m: m["base"])
    labels = lambda ms: _joined(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))))
    starts = F.transform(base, lambda m: m["start"])
    return found.select(
        "doc_id",
        F.col("licenses.n_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(matches).alias("labels"),
        F.coalesce(F.array_max(F.transform(matches, lambda m: m["containment"])), F.lit(0.0)).alias("score"),
    )


@query("op10_benchmark_decontamination", oracles.DECONTAMINATION)
def op10_benchmark_decontamination(spark, folder):
    """Words of every document that stand in a 13-word window of a benchmark item."""
    found = decontaminate.find_overlaps(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    overlap = F.col("overlap")
    items = F.array_sort(F.transform(overlap["items"], lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        overlap["n_words"].alias("n_words"),
        decontaminate.n_hit(overlap["spans"]).alias("n_hit"),
        F.size(overlap["items"]).cast("long").alias("n_items"),
        F.sha2(_joined(items), 256).alias("items_sha256"),
        decontaminate.is_contaminated(overlap).alias("contaminated"),
    )


@query("op3_minhash_near_dedup", oracles.NEAR_DUPLICATES)
def op3_minhash_near_dedup(spark, folder):
    """Near-duplicate components of all documents."""
    return minhash.near_duplicates(_table(spark, folder, "documents"))


@query("op5_embedding_near_dedup", oracles.NEAR_VECTORS)
def op5_embedding_near_dedup(spark, folder):
    """Links and components of all vectors with equal labels."""
    return metric_join.near_vectors(_table(spark, folder, "embeddings"))


@query("op4_context_tree_score")
def op4_context_tree_score(spark, folder):
    """Log10 probability of every whole text, with the unigram score beside it."""
    return ctw.score_texts(_table(spark, folder, "documents"))


@query("op6_quality_classifier")
def op6_quality_classifier(spark, folder):
    """Probability that a document is labelled as good, for every whole text."""
    return quality.quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@query("op2_warc", oracles.WARC)
def op2_warc(spark, folder):
    """All pages written as WARC records and read back from the archives."""
    path = warc.write_pages(_table(spark, folder, "pages"))
    return warc.archived_pages(spark, path)


@query("op12_spelling_variants", oracles.SPELLING)
def op12_spelling_variants(spark, folder):
    """Frequent words of all documents with their more frequent spelling."""
    return spelling.spelling_variants(spelling.count_words(_table(spark, folder, "documents")))


@query("op11_chunk_bpe")
def op11_chunk_bpe(spark, folder):
    """Token ids of every whole text and the text decoded from them, as counts and digests."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    told = chunk_bpe.encode_texts(documents, tokenizer, into="digests", of_ids=chunk_bpe.digests_of(tokenizer), keep_text=False)
    return told.select(
        "doc_id",
        F.col("digests.n").alias("n_tokens"),
        F.col("digests.ids").alias("ids_sha256"),
        F.col("digests.decoded").alias("decoded_sha256"),
    )


@query("op13_phrase_collocations", oracles.COLLOCATIONS)
def op13_phrase_collocations(spark, folder):
    """The 2,000 best phrases of every language."""
    return collocations.collocations(_table(spark, folder, "documents"))
