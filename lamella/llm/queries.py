"""The numbered queries, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, manifest, minhash, ngram, packing, periodic, pii, quality, rules, simhash, suffix, warc
from .common import fold, stored, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(fold("doc_id", 5) != 0))
    out = quality.score(docs, model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.deduplicate(table(spark, sf_dir, "documents"), length=400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path())
    return packing.pack(cut, packing.Limits(4096))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ngram.train(docs.where(fold("doc_id", 5) != 1))
    out = ngram.score(docs, model)
    return out.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold("doc_id", 4) != 2))
    out = langid.predict(docs, model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_warc_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.payloads(table(spark, sf_dir, "pages"))
    # digests and places are kept, not payloads; each replica's bytes are read and hashed by themselves
    primary, replica = stored(warc.records(found), "warc"), stored(warc.damaged(found), "warc")
    return warc.audit(primary, replica).select("file", "offset", "record_id", "status", "expected", "actual")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.detect(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = stored(rules.ledger(table(spark, sf_dir, "documents")), "ledger")
    base = rules.rejected(rules.BASE)
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & ~rules.rejected(rules.STANDARD)).alias("kept"), "fail_bits",
    )


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the standard policy contributes, from the ledger."""
    return rules.ablations(stored(rules.ledger(table(spark, sf_dir, "documents")), "ledger"), rules.STANDARD)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.runs(periodic.periodic_copy(table(spark, sf_dir, "documents")), min_length=24, min_exponent=3)
    written = "sha2(array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), ''), 256)"
    out = found.withColumn("best", periodic.strongest("runs"))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.expr(written).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(f) for f in manifest.FIELDS]
    tampered = [F.replace(f, F.lit("\n"), F.lit("")) if name == "text" else f for name, f in zip(manifest.FIELDS, fields, strict=True)]
    claim = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, manifest.leaf(*tampered))
    out = manifest.manifest(docs.select("doc_id", "source", manifest.leaf(*fields).alias("leaf"), claim.alias("claim")), claim="claim", proofs=False)
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(table(spark, sf_dir, "documents"), similarity=0.85)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The vocabulary file; it stays where the library keeps it."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_language_id": op7_language_id,
    "op8_warc_merkle_audit": op8_warc_merkle_audit,
    "op9_pii": op9_pii,
    "op10_quality_rules": op10_quality_rules,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_minhash_near_dedup": op13_minhash_near_dedup,
    "rule_ablations": rule_ablations,
}
_LEDGER = """
        WITH w AS (
            SELECT doc_id, coalesce(text, '') AS text,
                   list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
            FROM documents),
        g AS (SELECT doc_id, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS gram FROM w, unnest(range(1, len(words) - 1)) AS t(i)),
        twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
        r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest([0, 1, 2]) AS t(k) GROUP BY doc_id),
        top AS (SELECT doc_id, max(n) AS top FROM (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM w) GROUP BY doc_id, word) GROUP BY doc_id),
        m AS (
            SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                   CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                   CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
                   length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS up, length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS low,
                   length(text) - length(replace(text, '|', '')) AS pipes, coalesce(top.top, 0) AS top
            FROM w LEFT JOIN r USING (doc_id) LEFT JOIN top USING (doc_id)),
        f AS (
            SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                   CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > 2 * n_words AND n_words > 0)::INT
                   + 8 * (100 * n_dup_lines > 50 * n_lines)::INT + 16 * (100 * up > 40 * (up + low))::INT + 32 * (100 * top > 25 * n_words AND n_words >= 20)::INT
                   + 64 * (word_chars > 15 * n_words)::INT + 128 * (10 * pipes > 2 * n_words AND n_words > 0)::INT AS BIGINT) AS fail_bits
            FROM m)"""
#: crc32 of ``doc_id`` as text, bit by bit.
_CRC = """xor(list_reduce([4294967295] || list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda j: CAST(ascii(CAST(doc_id AS VARCHAR)[j]) AS BIGINT)),
            lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295)"""
_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = " || ".join(_FIELD.format(f) for f in ("doc_id", "source", "lang", "n_chars"))
_TREE = """SELECT g, level + 1, list_transform(range(0, (len(h) + 2) // 3), lambda i: sha256(array_to_string(h[3 * i + 1:3 * i + 3], ''))) FROM {0} WHERE len(h) > 1"""
_PATH = """SELECT {2}, coalesce(list({{'a': array_to_string(h[pos // 3 * 3 + 1:pos], ''), 'b': array_to_string(h[pos + 2:pos // 3 * 3 + 3], '')}} ORDER BY level)
                FILTER (len(h) > 1), []) AS path, max_by(h[1], level) AS top
            FROM (SELECT {0}.*, level, h, i // CAST(pow(3, level) AS BIGINT) AS pos FROM {0} JOIN {1} USING (g)) GROUP BY {2}"""
ORACLE: dict[str, str] = {
    "op8_warc_merkle_audit": """
        WITH body AS (
            SELECT page_id, page_id // 256 AS file,
                   'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>'
                   || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))
                   || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS payload
            FROM pages),
        placed AS (
            SELECT file, page_id, payload, sha256(payload) AS digest,
                   CAST(sum(strlen(payload)) OVER (PARTITION BY file ORDER BY page_id, sha256(payload) ROWS UNBOUNDED PRECEDING) - strlen(payload) AS BIGINT) AS "offset"
            FROM body)
        SELECT file, "offset", page_id AS record_id, 'altered' AS status, digest AS expected, sha256(payload[:-2] || '!') AS actual FROM placed WHERE page_id % 97 = 5
        UNION ALL SELECT file, "offset", page_id, 'missing', digest, NULL FROM placed WHERE page_id % 97 = 11
        UNION ALL SELECT file, "offset" + 1, page_id, 'extra', NULL, sha256('added') FROM placed WHERE page_id % 97 = 17
    """,
    "op12_merkle_manifest": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce('s' || source, '') AS g, sha256({_LEAF} || {_FIELD.format('text')}) AS leaf,
                   CASE WHEN {_CRC} % 2 = 0 THEN sha256({_LEAF} || {_FIELD.format("replace(text, chr(10), '')")}) END AS claim
            FROM documents),
        placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST) - 1 AS i FROM d),
        lower AS (SELECT g, 0 AS level, list(leaf ORDER BY i) AS h FROM placed GROUP BY g UNION ALL {_TREE.format("lower")}),
        subroots AS (SELECT g AS name, h[1] AS subroot, '' AS g, row_number() OVER (ORDER BY g) - 1 AS i FROM lower WHERE len(h) = 1),
        upper AS (SELECT '' AS g, 0 AS level, list(subroot ORDER BY i) AS h FROM subroots UNION ALL {_TREE.format("upper")}),
        low AS ({_PATH.format("placed", "lower", "doc_id, leaf, claim, g, i")}),
        high AS ({_PATH.format("subroots", "upper", "name")}),
        whole AS (SELECT doc_id, leaf, low.top AS subroot, high.top AS root, coalesce(claim, leaf) AS said, low.path || high.path AS path FROM low JOIN high ON low.g = high.name),
        f AS (
            SELECT *, sha256(array_to_string(list_transform(path, lambda p: p.a || p.b), '')) AS proof_sha256,
                   list_reduce([{{'a': said, 'b': ''}}] || path, lambda x, p: {{'a': sha256(p.a || x.a || p.b), 'b': ''}}).a AS folded_root
            FROM whole)
        SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f
    """,
    "op10_quality_rules": _LEDGER
    + """
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, fail_bits = 0 AS kept, fail_bits FROM f
    """,
    "rule_ablations": _LEDGER
    + """,
        named AS (SELECT * FROM (VALUES ('too_few_words', 1), ('repeated_trigrams', 2), ('symbols', 4), ('duplicate_lines', 8), ('shouting', 16), ('one_word', 32), ('long_words', 64), ('table_debris', 128)) AS t(rule, bit))
        SELECT rule, CAST(count(*) FILTER (fail_bits & bit <> 0) AS BIGINT) AS n_failed, CAST(count(*) FILTER (fail_bits = bit) AS BIGINT) AS n_failed_alone,
               CAST(count(*) FILTER (fail_bits IN (0, bit)) AS BIGINT) AS n_kept_without, 'standard-1' AS policy FROM f, named GROUP BY rule
    """,
}
