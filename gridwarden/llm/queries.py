"""The registered queries of the operators, with the SQL that DuckDB runs beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from gridwarden.llm import byte_bpe, chat_format, decontaminate, exact_dedup, html_text, jaccard_join, license_scan
from gridwarden.llm import lm_score, phrases, spelling, token_files, toxicity, warc
from gridwarden.llm.common import table
from gridwarden.session import scratch_path, written


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_tokens(
        table(spark, sf_dir, "documents", "doc_id", "text"), path,
        public_tokenizers.path("word_bpe_49k.json"), end_id=2,
    )
    return token_files.read_checksums(spark, path)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(
        "doc_id", F.col("digest").alias("text_sha256"), "whole_license",
        F.array_join("notices", ",").alias("notices"), F.col("n_notices").cast("long").alias("n_notices"),
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.rotate(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return jaccard_join.shingle_classes(docs).select("doc_id", "n_shingles", "component_id")


def fold(divisor: int) -> Column:
    """crc32 of the id as text, modulo a number."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(divisor))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(fold(5) != 0)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select(
        "doc_id", (fold(5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return exact_dedup.exact_duplicates(docs).select(
        "doc_id", "keep_id", "group_size", "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip_digests(docs, ranks, public_tokenizers.PATTERN)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    found = decontaminate.contamination(docs, items)
    return (
        found.select("doc_id", "n_words", F.expr(decontaminate.N_HIT).alias("n_hit"),
                     F.expr(decontaminate.ITEMS).alias("items"))
        .select(
            "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
        )
    )


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents", "lang", "text"))


def with_slips(words: DataFrame, one_in: int) -> DataFrame:
    """Every so manieth pair of document and word, by checksum, loses one code point."""
    h = F.crc32(F.concat("doc_id", F.lit(":"), "word"))
    at = F.pmod(h, F.length("word")).cast("int")
    cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return words.select(F.when(h % one_in == 0, cut).otherwise(F.col("word")).alias("word"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.runs(table(spark, sf_dir, "documents", "doc_id", "text"), "[A-Za-z\u00C0-\u00FF]+")
    return spelling.variants(spelling.vocabulary(with_slips(found, 97), least_length=5, least_count=3))


def capture_rows(spark: SparkSession, path: str) -> DataFrame:
    """The pages of archives that `warc.write_archives` wrote."""
    captures = warc.assemble(warc.read_records(spark, path)).select(
        "record_id", "record_type", "refers_to", "payload_bytes", "payload_digest",
        F.element_at("metadata.fields", "page-id").cast("long").alias("page_id"),
    )
    resolved = warc.resolve(written(captures, "captures"), "page_id")
    revisit = F.col("record_type") == "revisit"
    return resolved.select(
        "page_id",
        F.when(revisit, F.col("original.payload_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("original.payload_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.col("original.page_id").alias("refers_to"),
    )


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    return capture_rows(spark, path)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_decontamination": op2_decontamination,
    "op3_token_files": op3_token_files,
    "op4_license_scan": op4_license_scan,
    "op5_chat_format": op5_chat_format,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_toxicity": op7_toxicity,
    "op8_lm_score": op8_lm_score,
    "op9_html_text": op9_html_text,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_phrases": op11_phrases,
    "op12_spelling": op12_spelling,
    "op13_warc": op13_warc,
}

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '{u}', '{l}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
WORDS = WORDS.format(u=UPPER, l=LOWER)



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_lines_sql(text: str) -> str:
    line = f"' ' || regexp_replace(line, '{license_scan.NO_WORD}', '  ', 'g') || ' '"
    for other, used in license_scan.spaced(license_scan.SPELLINGS):
        line = f"replace({line}, '{other}', '{used}')"
    line = f"trim(replace({line}, '  ', ' '))"
    kept = (
        f"list_filter(string_split(lower(coalesce({text}, '')), chr(10)), "
        f"lambda line: NOT regexp_matches(line, '{license_scan.COPYRIGHT}'))"
    )
    return f"list_filter(list_transform({kept}, lambda line: {line}), lambda line: line <> '')"


KNOWN_SQL = ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in license_scan.KNOWN)

CRC_TABLE_SQL = """list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""

ORACLE = {
    "op11_phrases": f"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        f AS (
            SELECT lang, k, phrase, count(*) AS n FROM (
                SELECT lang, k, array_to_string(w[s : s + k - 1], ' ') AS phrase
                FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s
                      FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)))
            GROUP BY ALL),
        c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 30),
        cuts AS (
            SELECT lang, phrase, a, i, array_to_string(w[: i], ' ') AS first, array_to_string(w[i + 1 :], ' ') AS rest
            FROM (SELECT *, unnest(range(1, k)) AS i FROM c)),
        scored AS (
            SELECT cuts.lang, cuts.phrase, a, i, x.n AS l, y.n AS r,
                   CAST(CAST(2000000 AS HUGEINT) * a // (CAST(x.n AS HUGEINT) + y.n) AS BIGINT) AS score
            FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first
                      JOIN f y ON y.lang = cuts.lang AND y.phrase = rest),
        best AS (
            SELECT lang, phrase, a, first(l ORDER BY score, i) AS l, first(r ORDER BY score, i) AS r, min(score) AS score
            FROM scored GROUP BY ALL),
        around AS (
            SELECT DISTINCT c.lang, c.phrase FROM c JOIN c AS b ON c.lang = b.lang AND b.k > c.k
                AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * b.a >= 80 * c.a),
        totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
            FROM best ANTI JOIN around USING (lang, phrase))
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
    "op12_spelling": f"""
        WITH RECURSIVE crc AS (SELECT {CRC_TABLE_SQL} AS t),
        found AS (
            SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS d, translate(w, '{UPPER}', '{LOWER}') AS w,
                   count(*) AS times
            FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS w FROM documents)
            GROUP BY 1, 2),
        coded AS (SELECT *, hex(encode(d || w)) AS x FROM found),
        summed AS (
            SELECT w, times, xor(4294967295, list_reduce(
                list_prepend(4294967295, list_transform(range(len(x) // 2),
                    lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
            FROM coded, crc),
        slipped AS (
            SELECT times, CASE WHEN h % 97 = 0
                THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word
            FROM summed),
        v AS (
            SELECT word, CAST(sum(times) AS BIGINT) AS n FROM slipped
            WHERE length(word) >= 5 GROUP BY 1 HAVING sum(times) >= 3),
        cuts AS (
            SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS less
            FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v)),
        near AS (
            SELECT a.word, b.word AS other, b.n AS other_n
            FROM cuts a JOIN cuts b ON a.less = b.less AND a.p = b.p AND a.word <> b.word
            UNION SELECT a.word, v.word, v.n FROM cuts a JOIN v ON a.less = v.word
            UNION SELECT v.word, a.word, a.n FROM cuts a JOIN v ON a.less = v.word),
        best AS (
            SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n
            FROM near GROUP BY 1),
        f AS (
            SELECT word, n, coalesce(n_near, 0) AS n_near,
                   CASE WHEN other_n >= 2 * n THEN other END AS form,
                   CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
            FROM v LEFT JOIN best USING (word)),
        chain AS (
            SELECT word, word AS root, form AS onward FROM f
            UNION ALL SELECT chain.word, f.word, f.form FROM chain JOIN f ON chain.onward = f.word)
        SELECT word, form, root, n, n_near, form_n
        FROM f JOIN (SELECT word, root FROM chain WHERE onward IS NULL) USING (word)""",
    "op13_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                   sha256(coalesce(html, '')) AS payload_digest
            FROM pages),
        f AS (
            SELECT *, CASE WHEN payload_bytes >= 100
                THEN coalesce(min(page_id) OVER (PARTITION BY payload_digest), page_id)
                ELSE page_id END AS kept
            FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id IS NOT DISTINCT FROM kept THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM kept THEN kept END AS refers_to
        FROM f""",
    "op4_license_scan": f"""
        WITH known AS (
            SELECT DISTINCT license, sha256(array_to_string(lines, ' ')) AS digest
            FROM (SELECT license, {_canonical_lines_sql('t')} AS lines
                  FROM (VALUES {KNOWN_SQL}) AS k(license, t))),
        d AS (
            SELECT row_number() OVER () AS r, doc_id, lines,
                   sha256(array_to_string(lines, ' ')) AS text_sha256
            FROM (SELECT doc_id, {_canonical_lines_sql('text')} AS lines FROM documents)),
        notices AS (
            SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices,
                   count(DISTINCT digest) AS n_notices
            FROM (SELECT r, sha256(unnest(lines)) AS digest FROM d) JOIN known USING (digest)
            GROUP BY r),
        whole AS (SELECT digest AS text_sha256, min(license) AS whole_license FROM known GROUP BY 1)
        SELECT doc_id, text_sha256, whole_license, coalesce(notices, '') AS notices,
               coalesce(n_notices, 0) AS n_notices
        FROM d LEFT JOIN notices USING (r) LEFT JOIN whole USING (text_sha256)""",
    "op2_decontamination": f"""
        WITH i AS (
            SELECT item_id, w, least(10, len(w)) AS k
            FROM (SELECT item_id, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL)
            WHERE len(w) > 0),
        windows AS (
            SELECT DISTINCT item_id, k, list_aggregate(w[s : s + k - 1], 'string_agg', ' ') AS phrase
            FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM i)),
        d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
        places AS (
            SELECT r, k, s, list_aggregate(w[s : s + k - 1], 'string_agg', ' ') AS phrase
            FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s
                  FROM d, (SELECT DISTINCT k FROM windows))),
        hits AS (SELECT r, item_id, s, k FROM places JOIN windows USING (k, phrase)),
        words AS (
            SELECT r, count(DISTINCT p) AS n_hit
            FROM (SELECT r, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT r, s, k FROM hits))
            GROUP BY r),
        items AS (
            SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
            FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
               CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op5_chat_format": """
        WITH t AS (
            SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, 'unknown') AS speaker,
                   coalesce(text, '') AS text
            FROM conversations),
        people AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM t),
        heads AS (
            SELECT *, CASE WHEN speaker = perspective THEN '<|im_start|>assistant' || chr(10)
                ELSE '<|im_start|>user name=' || regexp_replace(speaker, '[^A-Za-z0-9_-]', '_', 'g')
                     || chr(10) END AS head
            FROM t JOIN people ON conv_id IS NOT DISTINCT FROM c),
        pieces AS (
            SELECT *, head || replace(text, '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS piece
            FROM heads),
        placed AS (
            SELECT *, CAST(sum(length(piece)) OVER (
                PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text, r
                ROWS UNBOUNDED PRECEDING) AS BIGINT) AS char_end
            FROM pieces)
        SELECT conv_id, perspective, turn, speaker, piece,
               char_end - length(piece) AS char_start, char_end,
               CASE WHEN speaker = perspective THEN char_end - length(piece) + length(head) END
                   AS train_start,
               CASE WHEN speaker = perspective THEN char_end - 1 END AS train_end
        FROM placed""",
    "op10_exact_dedup": f"""
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256
            FROM documents)
        SELECT doc_id,
               max(doc_id) OVER w AS keep_id,
               count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
               text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
}
