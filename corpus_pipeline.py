"""The corpus pipeline: documents in, packed sequences out.

``STAGES`` lists its stages. Each takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``. All but the last return the columns of documents.

Edge cases: an empty table goes through every stage as one; null and empty texts stay (scored by the bias
alone, linked with nothing, without passages, one end id when packed; the mix takes them as it takes
others of size 0); repeated rows are near-duplicates of each other, so one of them stays; further columns
of documents, clashing names among them, end at the first stage.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hdulake.llm._common import read, stored, unpacked
from hdulake.llm.minhash import near_duplicates_of
from hdulake.llm.mixing import mix_sources
from hdulake.llm.packing import pack
from hdulake.llm.suffixes import WORDS, remove_repeats
from hdulake.llm.toxicity import THRESHOLD, score_documents, train

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
CARRIED = tuple(c for c in COLUMNS if c != "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at the threshold or above go; the classifier learns from ``labels``."""
    model = train(docs, read(spark, sf_dir, "labels"))
    return score_documents(docs, model, carry=("text", "lang", "source", "n_chars")).filter(F.col("score") < THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    kept = stored(docs, CARRIED)
    gone = near_duplicates_of(kept).filter("not stays").select("rid")
    return unpacked(kept.join(gone, "rid", "left_anti")).select("carried.*", "text").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of at least 50 words that also stand elsewhere go; every document stays, if with less text. A null text stays null."""
    marked = docs.select("doc_id", "text", "lang", "source", F.col("text").isNull().alias("none"))
    kept = remove_repeats(marked, carry=("doc_id", "lang", "source", "none"), as_text=True, units=(WORDS,))
    text = F.when(~F.col("none"), F.col("kept"))
    return kept.select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    kept = stored(docs, CARRIED)
    taken = mix_sources(unpacked(kept).select("rid", "carried.*", "text"), rid="rid").filter("copies > 0").select("rid", "copies")
    joined = unpacked(kept.join(taken, "rid")).select("carried.*", "text", "copies")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack(docs, with_ids=False)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeats),
    ("mixing", mix),
    ("packing", pack_documents),
]
#: SQL cannot express the stages; tests/llm hold each one, on the rows that the one before it kept, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again.

    A stage's rows are removed once the next one's are written, the last stage's when the session ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="hdulake-pipeline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    base = f"{folder}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.deleteOnExit(path)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{k - 1}"), True)
    return docs
