"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisig.cluster import ship

from . import caps, chat, mixing, packing, pages, quality, simhash, toxicity, urls, warc
from .common import scratch_dir


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(_table(spark, sf_dir, "documents"), simhash.STRICT)
    return found.select(F.col("id").alias("doc_id"), simhash.hex_digits("v0").alias("fingerprint"), "component_id")


def op2_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.main_text(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), _tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


URL_RULES = urls.Rules((("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")))


def op4_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urls.train(urls.example_table(spark))
    return urls.judge(_table(spark, sf_dir, "pages"), URL_RULES, model).select("page_id", "host", "path", "rule", "verdict")


def op5_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = caps.join(_table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: Target weights of the sources in the test tables: src0 to src19, from one to four parts.
TARGETS = {f"src{i}": 1.0 + i % 4 for i in range(20)}


def op8_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), TARGETS, default=1.0)
    return mixed.select("doc_id", "source", "mix_block", "mix_slot", "mix_place")


def op9_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(_table(spark, sf_dir, "conversations"))


def op10_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return docs.select("doc_id", toxicity.severity(model, F.col("text")).alias("s")).select("doc_id", "s.severity", "s.toxic")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_wrapper_text": op2_wrapper_text,
    "op3_packing": op3_packing,
    "op4_url_trees": op4_url_trees,
    "op5_cap_filters": op5_cap_filters,
    "op6_warc_revisits": op6_warc_revisits,
    "op7_host_rules": op7_host_rules,
    "op8_pfair_mix": op8_pfair_mix,
    "op9_quote_links": op9_quote_links,
    "op10_ordinal_toxicity": op10_ordinal_toxicity,
}

_RATE = "CASE WHEN n >= 2 THEN {0} / n END"
_SOFT = {
    "symbols": "200 * n_symbols > {0} * 6 * word_chars",
    "lines": "n_dup_lines >= 3 AND 200 * n_dup_lines > {0} * 30 * n_lines",
    "stutter": "200 * n_stutter > {0} * 30 * n_words",
}


def _posterior(rule: str) -> str:
    """DuckDB SQL of a host's posterior mean and deviation, from its sums and the prior's mean m and variance v."""
    k = f"least(CASE WHEN v_{rule} > 0 AND m_{rule} * (1 - m_{rule}) / v_{rule} > 2 THEN m_{rule} * (1 - m_{rule}) / v_{rule} - 1 ELSE 1 END, 10000)"
    p = f"(({rule} + m_{rule} * {k}) / (n + {k}))"
    return f"{p} AS p_{rule}, sqrt({p} * (1 - {p}) / (n + {k} + 1)) AS sd_{rule}, m_{rule}"


def _soft(rule: str) -> str:
    """DuckDB SQL: whether a document breaks a soft rule at the limit that its host's posterior sets."""
    half, more = _SOFT[rule].format(1), _SOFT[rule].format(3)
    return f"CASE WHEN p_{rule} - 2 * m_{rule} > 2.326 * sd_{rule} THEN {half} WHEN m_{rule} / 2 - p_{rule} > 2.326 * sd_{rule} THEN {more} ELSE f_{rule} END"


_HOST_RULES = f"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
    starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w),
    windows AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS s FROM starts),
    twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
    covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(0, 8) r(j) GROUP BY doc_id),
    c AS (SELECT w.doc_id, host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
      len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(l) AS n_lines,
      len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter FROM w LEFT JOIN covered USING (doc_id)),
    f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS f_base, {", ".join(f"{x.format(2)} AS f_{r}" for r, x in _SOFT.items())} FROM c),
    hosts AS (SELECT host, count(*) AS n, sum(f_symbols::INT) AS symbols, sum(f_lines::INT) AS lines, sum(f_stutter::INT) AS stutter,
      sum((f_base OR f_symbols OR f_lines OR f_stutter)::INT) AS anyrule FROM f GROUP BY host),
    prior AS (SELECT {", ".join(f"sum({r}) / sum(n) AS m_{r}, coalesce(var_samp({_RATE.format(r)}), 0) AS v_{r}" for r in (*_SOFT, "anyrule"))} FROM hosts),
    rates AS (SELECT host, {", ".join(_posterior(r) for r in (*_SOFT, "anyrule"))} FROM hosts, prior)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f_base AS base_failed,
      NOT (f_base OR p_anyrule - 0.5 > 2.326 * sd_anyrule OR {" OR ".join(f"({_soft(r)})" for r in _SOFT)}) AS kept
    FROM f JOIN rates USING (host)"""

_CAP_LINKS = """
    WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x <> 0)) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
    reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
    n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low.b, vec_id)) AS kept
    FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN low ON low.a = vec_id"""

ORACLES: dict[str, str] = {
    "op5_cap_filters": _CAP_LINKS,
    "op7_host_rules": _HOST_RULES,
    "op6_warc_revisits": """
    WITH p AS (SELECT page_id, COALESCE(html, '') AS t FROM pages),
    h AS (SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS payload_digest FROM p),
    m AS (SELECT *, MAX(page_id) OVER (PARTITION BY payload_digest) AS top FROM h)
    SELECT page_id, payload_bytes, payload_digest,
      CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
    FROM m""",
    "op8_pfair_mix": mixing.mix_sql("documents", TARGETS, "doc_id, source", default=1.0),
}
