"""Registered queries of the training-data operators."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from geoq.llm.common import scratch_path, table

QUERIES: dict = {}

#: Vocabulary files; every function takes the path as a parameter.
BYTE_VOCABULARY, WORD_VOCABULARY = "byte_bpe_50k.json", "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def query(name: str):
    def register(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            return fn(spark, sf_dir)
        QUERIES[name] = run
        return run
    return register


@query("op6_token_files")
def op6_token_files(spark, sf_dir, path: str | None = None):
    from geoq.llm.token_files import id_checksums, read_token_files, with_starts, write_token_files
    path = path or scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, vocabulary(BYTE_VOCABULARY))
    tokens = read_token_files(spark, path)
    return with_starts(id_checksums(tokens), tokens).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op8_top_k_inner_product")
def op8_top_k_inner_product(spark, sf_dir):
    from geoq.llm.topk import top_k_inner_product
    return top_k_inner_product(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark, sf_dir):
    from geoq.llm.packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY))


@query("op1_url_filter")
def op1_url_filter(spark, sf_dir):
    from geoq.llm.url_filter import judge_urls
    return judge_urls(table(spark, sf_dir, "pages")).drop("score")


@query("op2_secret_scan")
def op2_secret_scan(spark, sf_dir):
    from geoq.llm.secret_scan import fit_secret_model, sample_credentials, scan_secrets, span_digest
    model = fit_secret_model(spark.createDataFrame(sample_credentials(), "value string, kind string"))
    return span_digest(scan_secrets(table(spark, sf_dir, "documents"), model))


#: Documents whose remainder is 1 are held out of what toxicity learns.
TOXICITY_FOLDS, TOXICITY_THRESHOLD = 3, 0.7


def toxicity_model(spark, docs, sf_dir):
    from geoq.llm.common import id_remainder
    from geoq.llm.toxicity import fit_toxicity
    return fit_toxicity(docs, table(spark, sf_dir, "labels"), id_remainder("doc_id", TOXICITY_FOLDS) != 1)


@query("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    from geoq.llm.common import id_remainder
    from geoq.llm.toxicity import score_toxicity
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", (id_remainder("doc_id", TOXICITY_FOLDS) == 1).alias("held_out"), "score",
                         (F.col("score") >= TOXICITY_THRESHOLD).cast("int").alias("predicted"))


@query("op4_decontamination")
def op4_decontamination(spark, sf_dir):
    from geoq.llm.decontaminate import contained_items
    found = contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "shared", "containment")


@query("op3_line_dedup")
def op3_line_dedup(spark, sf_dir):
    from geoq.llm.line_dedup import remove_repeated_lines
    cut = remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "text", F.size("removed").alias("removed_passages"), F.expr(
        "aggregate(removed, 0L, (s, r) -> s + r.end - r.start)").alias("removed_bytes"))


@query("op7_jaccard_join")
def op7_jaccard_join(spark, sf_dir):
    from geoq.llm.jaccard_join import jaccard_classes
    return jaccard_classes(table(spark, sf_dir, "documents"))


@query("op5_suffix_tree_scores")
def op5_suffix_tree_scores(spark, sf_dir):
    from geoq.llm.common import id_remainder
    from geoq.llm.lm_score import score_texts
    return score_texts(table(spark, sf_dir, "documents"), id_remainder("doc_id", 10) == 0)


@query("op11_spelling_forms")
def op11_spelling_forms(spark, sf_dir):
    from geoq.llm.spelling import spelling_forms
    return spelling_forms(table(spark, sf_dir, "documents"))


@query("op12_lexical_search")
def op12_lexical_search(spark, sf_dir):
    from geoq.llm.lexical_search import search_documents
    return search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


@query("op13_edit_fingerprints")
def op13_edit_fingerprints(spark, sf_dir):
    from geoq.llm.edit_fingerprint import fingerprint_neighbours
    return fingerprint_neighbours(table(spark, sf_dir, "documents"))
