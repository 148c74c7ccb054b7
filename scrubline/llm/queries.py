"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from scrubline.llm import chat_format, embed_caps, exact_dedup, language_id, minhash_odd, mixing, page_diff, piece_wfst, quality, resample, secret_layers, suffix_repeats, token_align
from scrubline.llm.common import small_batches, table


def op1_suffix_repeats(spark, sf_dir):
    """Bytes of documents covered by 400-byte strings that occur twice, removed."""
    r = suffix_repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return r.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_source_mixing(spark, sf_dir):
    """Documents repeated so that sources reach shares ~ size^0.5, in global random order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs).select("doc_id", "source", "copy_no", "shuffle_key")


def op3_embedding_caps(spark, sf_dir):
    """Near-duplicate vectors of a label at a cosine of at least 0.93."""
    r = embed_caps.near_duplicates(table(spark, sf_dir, "embeddings"))
    return r.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op4_language_id(spark, sf_dir):
    """Language of every document: text, declared language and source prior."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return language_id.identify_language(docs, keep=["doc_id"])


def page_evidence(pages):
    """(page_id, text, declared, host, suffix): the text of a page without its
    markup, the language its html element declares, its host and what the
    address says of a language (top-level domain, two-letter first folder).
    A null page is empty; a null or other address gives no host or suffix."""
    small_batches(pages.sparkSession)

    def run(batches):
        for t in batches:
            texts = ["\n".join(page_diff.page_lines(p)[0]) for p in t.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([t.column(0), pa.array(texts, pa.string()), *t.columns[2:]], ["page_id", "text", "declared", "url"])

    kind = pages.schema["page_id"].dataType.simpleString()
    url, html = F.col("url").cast("string"), F.col("html").cast("string")
    d = pages.select("page_id", html.alias("html"), F.nullif(F.regexp_extract(html, r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z][A-Za-z0-9_-]*)", 1), F.lit("")).alias("declared"), url.alias("url"))
    d = d.mapInArrow(run, f"page_id {kind}, text string, declared string, url string")
    host = F.nullif(F.lower(F.regexp_extract("url", r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    folder = F.lower(F.regexp_extract("url", r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]+/([a-z]{2})(?:[/?#]|$)", 1))
    return d.select("page_id", "text", "declared", host.alias("host"), F.when(host.isNotNull(), F.concat_ws("/", F.substring_index(host, ".", -1), folder)).alias("suffix"))


def llm_language_id_pages(spark, sf_dir):
    """Language of every page: markup text, html lang attribute, address suffix and host prior."""
    pages = page_evidence(table(spark, sf_dir, "pages"))
    return language_id.identify_language(pages, "text", "declared", "host", "suffix", keep=["page_id"])


def op5_exact_dedup(spark, sf_dir):
    """Exact duplicates of whole texts (A-Z lower-cased), largest doc_id stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(exact_dedup.normalised(F.col("text")), 256))
    return exact_dedup.exact_dedup(docs, keep=["doc_id", "text_sha256"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g USING (t)
"""


def op6_page_diff(spark, sf_dir):
    """Main text of every page."""
    return page_diff.extract_pages(table(spark, sf_dir, "pages"))


def op7_quality(spark, sf_dir):
    """Quality of every document, learned from labels that are not held out."""
    return quality.score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op8_minhash_odd(spark, sf_dir):
    """Near-duplicates of whole texts: 3-word shingles, similarity of at least 0.85."""
    r = minhash_odd.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, num=85, den=100)
    return r.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


OP8_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, hash(sh) AS sh FROM (SELECT DISTINCT doc_id, sh FROM (
       SELECT doc_id, array_to_string(w[i:i + 2], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)))),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
v AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS c FROM d UNION SELECT v.b, r.c FROM r JOIN v ON v.a = r.id),
c AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.id = d.doc_id
"""


def op9_chat_formatting(spark, sf_dir):
    """Maximal conversations, rendered."""
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op10_piece_encoding(spark, sf_dir):
    """Piece ids of every whole document, and whether decoding gives it back."""
    return piece_wfst.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids", "n_tokens", "round_trip")


def op11_secret_layers(spark, sf_dir):
    """Secrets of every document, in the text and in the layers encoded in it."""
    r = secret_layers.scan_secrets(table(spark, sf_dir, "documents"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["layers"] == "")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return r.select(F.col("id").alias("doc_id"), *map(count, secret_layers.KINDS), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op12_token_alignment(spark, sf_dir):
    """Two tokenizations of every document, aligned, with corpus-wide link counts."""
    r = token_align.link_counts(table(spark, sf_dir, "documents"))
    return r.withColumnRenamed("id", "doc_id")


def op13_importance_resample(spark, sf_dir):
    """Documents drawn by importance towards the hashed unigrams of benchmark."""
    r = resample.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), max_n=resample.MAX_N)
    return r.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def registry():
    g = globals()
    sql = {"op2_source_mixing": mixing.ORACLE_SQL, "op3_embedding_caps": embed_caps.ORACLE_SQL, "op5_exact_dedup": OP5_SQL, "op8_minhash_odd": OP8_SQL, "op9_chat_formatting": chat_format.ORACLE_SQL,
           "op13_importance_resample": resample.ORACLE_SQL}
    return {name: (g[name], sql.get(name)) for name in (
        "op1_suffix_repeats", "op2_source_mixing", "op3_embedding_caps", "op4_language_id", "op5_exact_dedup", "op6_page_diff", "op7_quality", "op8_minhash_odd", "op9_chat_formatting", "op10_piece_encoding",
        "op11_secret_layers", "op12_token_alignment", "op13_importance_resample",
        "llm_language_id_pages")}
