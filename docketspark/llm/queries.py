"""The numbered queries: thin contracts over the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketspark.llm.common import spans_text, table


def op1_quality_scores(spark, sf_dir):
    from docketspark.llm.quality import score_quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op2_best_fit_packing(spark, sf_dir):
    from docketspark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op3_chroma_alignment(spark, sf_dir):
    """The tables hold no audio, so every vector of embeddings is played as a tune first."""
    from docketspark.llm.media import align_recordings, rendered

    return align_recordings(rendered(table(spark, sf_dir, "embeddings")))


def op4_repair_tokens(spark, sf_dir):
    import public_tokenizers

    from docketspark.llm.common import shared_path
    from docketspark.llm.tokens import read_digests, write_tokens

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    path = shared_path(spark, "token-blocks")
    write_tokens(table(spark, sf_dir, "documents"), tokenizer, path)
    return read_digests(spark, path)


def op5_adaptive_rules(spark, sf_dir):
    from docketspark.llm.thresholds import adaptive_rules

    out = adaptive_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_source_mix(spark, sf_dir):
    from docketspark.llm.mixing import mix_sources

    out = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op8_warc_revisits(spark, sf_dir):
    from docketspark.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op9_contextual_pii(spark, sf_dir):
    from docketspark.llm.pii import KINDS, personal_data

    out = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.filter("base", lambda f: f["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def op10_secret_ledger(spark, sf_dir):
    """Two scans of one ledger: an eighth of the blobs, as of an earlier day, and then all, of which the ledger knows those."""
    from docketspark.llm.common import shared_path
    from docketspark.llm.secrets import KINDS, digest, scan_secrets, update_ledger

    docs, ledger = table(spark, sf_dir, "documents").select("doc_id", "text"), shared_path(spark, "secret-ledger")
    update_ledger(docs.where(F.substring(F.hex(digest()), 1, 1) < "2"), ledger)
    out = scan_secrets(docs, ledger)
    of = lambda *kinds: F.filter("findings", lambda f: f["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(spans_text(of(*KINDS)).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("findings")).alias("spans"))


def op6_near_duplicates(spark, sf_dir):
    from docketspark.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op11_anchor_simhash(spark, sf_dir):
    from docketspark.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"), size=4, distance=4).select("doc_id", "fingerprint", "component_id")


def op12_token_alignment(spark, sf_dir):
    import public_tokenizers

    from docketspark.llm.alignment import align_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as g:
        return align_tokenizers(table(spark, sf_dir, "documents"), f.read(), g.read())


def op13_ranked_search(spark, sf_dir):
    from docketspark.llm.ranking import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


QUERIES = {
    "op1_quality_scores": op1_quality_scores,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_chroma_alignment": op3_chroma_alignment,
    "op4_repair_tokens": op4_repair_tokens,
    "op5_adaptive_rules": op5_adaptive_rules,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_source_mix": op7_source_mix,
    "op8_warc_revisits": op8_warc_revisits,
    "op9_contextual_pii": op9_contextual_pii,
    "op10_secret_ledger": op10_secret_ledger,
    "op11_anchor_simhash": op11_anchor_simhash,
    "op12_token_alignment": op12_token_alignment,
    "op13_ranked_search": op13_ranked_search,
}
