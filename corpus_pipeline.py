"""The corpus pipeline: five stages over the table of documents.

Each stage works on all that the one before kept, and returns the columns of
documents; the last one adds shard and slot. ``run`` writes the result of every
stage to the folder that the cluster names in spark.checkpoint.dir and reads it
again, so a lost executor costs one stage at most.
"""

from pyspark.sql import functions as F

from sparkelt.llm import decontaminate, language, mixing, resharding, simhash
from sparkelt.sources.paths import remove, shared_dir

#: Share of the tokens that mixing keeps at least.
LEAST_KEPT = 0.5


def identify_language(spark, docs, sf_dir):
    """Drops documents whose language is not settled; ``lang`` is what they declare, ``source`` their host."""
    return language.keep_identified(docs, declared=F.col("lang"), host=F.col("source"))


def drop_near_copies(spark, docs, sf_dir):
    """Keeps one document of each group of near copies."""
    return simhash.drop_near_copies(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Drops documents that hold a benchmark passage."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark, docs, sf_dir):
    """Samples documents so that sources, languages and topics get their token shares; ``LEAST_KEPT`` of the tokens stay."""
    return mixing.mix(docs, least=LEAST_KEPT)


def reshard(spark, docs, sf_dir):
    """Places documents into 16 shards of near equal size."""
    return resharding.reshard(docs).documents(docs)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("reshard", reshard),
]

#: XXH64 and the suffix arrays have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages in a row, over the table of documents; a stage's folder goes when the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
