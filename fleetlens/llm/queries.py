"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.llm import fill_middle, langid, licences, passage_quality, quality, url_filter, vector_codes
from fleetlens.llm.exact_dedup import exact_dedup
from fleetlens.llm.jaccard_join import Similar, near_groups
from fleetlens.llm.mixing import mix
from fleetlens.llm.packing import pack
from fleetlens.llm.scratch import Scratch
from fleetlens.llm.substring_dedup import substring_dedup
from fleetlens.llm.token_shards import write_shards

#: tokenizer file; set ``spark.llm.tokenizer`` where the package of public tokenizers is not installed
TOKENIZER = "word_bpe_49k.json"
#: least score of a document that is predicted good
GOOD_SCORE = 0.3
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
             ("block", "net/es/"), ("block", "net/fr/")]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(spark: SparkSession) -> str:
    path = spark.conf.get("spark.llm.tokenizer", None)
    if not path:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return str(path)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by a 50-word window that also starts in a document with a smaller doc_id are removed."""
    scratch = Scratch(spark, "op1")
    out = substring_dedup(_docs(spark, sf_dir), scratch)
    return scratch.finish(out.select("doc_id", "n_words", "n_removed", "kept_sha256"))


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as shards of 2048-token sequences in keyed order; the rows are the manifest."""
    scratch = Scratch(spark, "op2")
    return scratch.finish(write_shards(_docs(spark, sf_dir), scratch, scratch.path("shards"), tokenizer_path(spark)))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all pages under URL_RULES; aliases come from the pages' canonical links and redirects."""
    scratch = Scratch(spark, "op3")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return scratch.finish(url_filter.filter_urls(pages, URL_RULES, url_filter.html_links(pages), scratch))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base features, base verdict and the posterior verdict of all documents."""
    scratch = Scratch(spark, "op4")
    return scratch.finish(quality.score(_docs(spark, sf_dir), scratch).drop("votes"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences of every whole text and of its lines."""
    return licences.scan(_docs(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 5, 2, 1 in turn over the sources; targets stop at three times a source."""
    scratch = Scratch(spark, "op6")
    return scratch.finish(mix(_docs(spark, sf_dir), scratch).select("doc_id", "size", "source_size", "target", "taken"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    scratch = Scratch(spark, "op7")
    docs = _docs(spark, sf_dir)
    out = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~out), scratch)
    return scratch.finish(langid.predict(docs, model, {"doc_id": F.col("doc_id"), "held_out": out}))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, each document ended by id 0, packed into few sequences."""
    scratch = Scratch(spark, "op8")
    packed = pack(_docs(spark, sf_dir), scratch, tokenizer_path(spark))
    digests = packed.pieces.select("uid", F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return scratch.finish(digests.join(packed.places, "uid").drop("uid"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of identical texts; the largest doc_id stays."""
    scratch = Scratch(spark, "op9")
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    return scratch.finish(exact_dedup(docs, scratch).decisions.select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components over links of 3-word shingle sets with Jaccard similarity of at least 0.9."""
    scratch = Scratch(spark, "op10")
    return scratch.finish(near_groups(_docs(spark, sf_dir), scratch, how=Similar(3, 90, 100)))


def op11_passage_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from the labels of those that are not held out."""
    scratch = Scratch(spark, "op11")
    docs = _docs(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = langid.held_out(F.col("doc_id"))
    model = passage_quality.fit(docs.where(~out), labels.where(~out))
    scored = passage_quality.score(docs, model, {"doc_id": F.col("doc_id"), "held_out": out})
    return scratch.finish(scored.withColumn("predicted", (F.col("score") >= GOOD_SCORE).cast("int")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings: 16 parts, 64 entries each, two rounds."""
    scratch = Scratch(spark, "op12")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    codes = vector_codes.encode(vectors, {"vec_id": F.col("vec_id"), "label": F.col("label")})
    rows = vector_codes.label_errors(scratch.write(codes.rows, "codes"))
    return scratch.finish(rows.select("vec_id", "code", "error", "label_error", F.lit(codes.sha256).alias("codebooks_sha256")))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle outputs of all documents and their round trip, as digests."""
    scratch = Scratch(spark, "op13")
    cut = fill_middle.transform(_docs(spark, sf_dir), {"doc_id": F.col("doc_id")})
    kept = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    carried = {c: F.col(c) for c in kept} | {"output_sha256": F.sha2("output", 256)}
    back = fill_middle.restore(cut, carried)
    return scratch.finish(back.select(*carried, F.sha2("restored", 256).alias("restored_sha256")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_shards": op2_token_shards,
    "op3_url_filter": op3_url_filter,
    "op4_quality": op4_quality,
    "op5_licences": op5_licences,
    "op6_mixing": op6_mixing,
    "op7_langid": op7_langid,
    "op8_packing": op8_packing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_passage_quality": op11_passage_quality,
    "op12_vector_codes": op12_vector_codes,
    "op13_fill_middle": op13_fill_middle,
}
