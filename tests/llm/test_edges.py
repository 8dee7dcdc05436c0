"""Empty tables, odd vectors, and texts longer than what operators take at once."""

import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from kinweave.llm import language, packing, pieces, records, tokens, vectors

VECTORS = "vec_id long, embedding array<float>, label int, part string, cluster int"


def test_odd_vectors(spark):
    """No rows; null and repeated ids; lengths that differ; numbers whose squares overflow; extra columns."""
    assert vectors.near(spark.createDataFrame([], VECTORS)).count() == 0
    x, huge = [1.0, 2.0, 3.0], [3e38, 3e38, 3e38]
    rows = [(1, x), (1, x), (None, x), (2, [1.0, 2.0]), (3, []), (4, huge), (5, [1.0, 1.0, 1.0]), (6, None), (None, None), (7, [1e-30, 2e-30, 3e-30])]
    got = vectors.near(spark.createDataFrame([(k, v, 0, "p", 1) for k, v in rows], VECTORS)).collect()
    told = sorted(((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id) for r in got), key=repr)
    # x, x and its multiple with id 7 and the one without an id; (1, 1, 1) is within the threshold of x (0.926), and so is its multiple.
    group = [(1, 5), (1, 5), (None, 5), (7, 5), (5, 5), (4, 5)]
    wanted = [(k is None, k or 0, n, 1) for k, n in group] + [(False, 2, 0, 2), (False, 3, 0, 3), (False, 6, 0, 6), (True, 0, 0, None)]
    assert told == sorted(wanted, key=repr)


def test_pipeline_on_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_texts_beyond_a_slice(spark, tmp_path):
    """One text of over two million characters: ids, pieces and packing are those of the libraries, its language that of its parts."""
    random = np.random.default_rng(17)
    words = ["alpha", "beta's", "Gamma", "naïve", "日本", "42", "\n", "  ", "delta,"]
    text = " ".join(random.choice(words, 500_000))
    assert len(text) > tokens.SLICE_CHARS and len(text) > language.SLICE_BYTES
    table = spark.createDataFrame([(1, "short one", "en"), (2, text, "xx")], "doc_id long, text string, lang string").withColumn("n_tokens", F.lit("clash"))
    ids = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids
    crc = lambda part: zlib.crc32(np.array(part, "<u4").tobytes())
    records.write(table, f"{tmp_path}/r")
    got = {r.doc_id: r for r in records.read(spark, f"{tmp_path}/r").collect()}
    assert (got[2].n_tokens, got[2].ids_crc32) == (len(ids) + 1, crc([*ids, 2]))
    packed = sorted((r.piece, r.length, r.ids_crc32) for r in packing.pack(table).where("doc_id = 2").collect())
    whole = [*ids, 0]
    assert packed == [(k, len(p), crc(p)) for k, p in ((k, whole[2048 * k : 2048 * k + 2048]) for k in range(-(-len(whole) // 2048)))]
    coder = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    assert {r.doc_id: r.n_tokens for r in pieces.encode(table).collect()}[2] == len(coder.encode(text))
    learned = language.train(spark.createDataFrame([(10 + k, " ".join(random.choice(words, 60)) if k % 2 else "wholly other english prose without those " * 8, "xx" if k % 2 else "en") for k in range(80)], "doc_id long, text string, lang string"))
    assert {r.doc_id: r.lang_pred for r in language.predict(table, learned).collect()}[2] == "xx"
