"""Five cleaning stages over a collection of documents, each written before the next begins."""

import uuid

from marketlens.llm import decontamination, jaccard_join, packing, pii, toxicity
from marketlens.llm.common import checkpoint_folder, table


def toxic_documents(spark, docs, sf_dir):
    """Drop documents whose toxicity score reaches the threshold."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark, docs, sf_dir):
    """Keep one document of each group that the n-gram Jaccard join links."""
    return jaccard_join.keep_first(docs)


def benchmark_passages(spark, docs, sf_dir):
    """Drop documents that share a window of words with a benchmark item."""
    return decontamination.remove(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark, docs, sf_dir):
    """Replace personal data in the texts by its kind."""
    return pii.redact(docs)


def packed_sequences(spark, docs, sf_dir):
    """Tokenise and pack into sequences; one row per piece."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("toxicity", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_passages),
    ("personal_data", personal_data),
    ("packing", packed_sequences),
]

# Tokens, learned scores and tree thresholds have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows over documents; each stage reads its predecessor's Parquet files."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
