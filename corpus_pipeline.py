"""The corpus pipeline: STAGES applied in turn to `documents`.

toxicity        rejects documents that the factorization machine scores as toxic
exact dedup     keeps one document of those with equal text, white space apart
SimHash         keeps one document of each component of shingle similarity 0.8 or more
mixing          repeats or leaves out documents to meet the sources' target weights
pieces          encodes the texts with seeded merge-dropout

All stages but the last return the columns of documents; mixing adds the number of each copy,
which the encoder's dropout takes in. The first and the last decide row
by row where the texts lie; the others work out their decisions on ids, digests and
fingerprints, and join those to the texts.

Defined results: null texts count as empty ones, which are copies of each other; of rows that
are alike in all columns one stays; null ids lose ties; without labels nothing is rejected;
an empty table gives no rows; extra columns go through to the end, whatever their names,
but for `variant`, `piece_ids` and `n_pieces`, which the encoder makes anew, and the text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.llm import common, exact_dedup, mixing, near as near_rows, pieces, toxicity

#: SQL has no factorization machine and no merge agenda; the stages are tested apart.
ORACLE_SQL = None

#: Words in a shingle of the near-duplicate stage.
SHINGLE = 5


def reject_toxic(spark, docs, sf_dir):
    common.small_batches(spark)
    model = toxicity.train(docs, common.read(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def exact(spark, docs, sf_dir):
    common.small_batches(spark)
    return exact_dedup.drop_copies(docs)


def near(spark, docs, sf_dir):
    common.small_batches(spark)
    return near_rows.drop_near_copies(docs, SHINGLE)


def mix(spark, docs, sf_dir):
    return mixing.mix(docs, copy=pieces.COPY)


def encode(spark, docs, sf_dir):
    common.small_batches(spark)
    return pieces.encode(docs).withColumn("n_pieces", F.size("piece_ids"))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing sources", mix),
    ("SentencePiece", encode),
]


def run(spark, sf_dir):
    """All stages over documents; each stage's rows are written and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs, f"stage-{k}")
            common.release_shuffles(spark)
    return docs
