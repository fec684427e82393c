"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import byte_bpe, fingerprints, license_scan, merkle, ngram_join, packing, quality, sentence_piece, spelling_variants
from ledgerlens.llm import token_counts, toxicity, url_filter
from ledgerlens.llm.exact_dedup import exact_groups
from ledgerlens.llm.tables import in_fold, ready, table


#: Scores from which a document counts as toxic, as good.
TOXIC_FROM, GOOD_FROM = 0.3, 0.5

#: (verdict, host, path)
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def vocabulary_file(name: str) -> str:
    """Where the installed public tokenizer files are."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    ready(spark)
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the unigram reading of a 32k-piece vocabulary."""
    ready(spark)
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary_file("piece_bpe_32k.model"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of equal text; the row with the largest id stays."""
    ready(spark)
    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def _judged(scored: DataFrame, parts: int, part: int, threshold: float) -> DataFrame:
    return scored.select("doc_id", in_fold(F.col("doc_id"), parts, part).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of the held-out quarter are not learnt from."""
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=lambda i: ~in_fold(i, 4, 2))
    return _judged(toxicity.score(docs, model), 4, 2, TOXIC_FROM)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of the held-out third are not learnt from."""
    ready(spark)
    scored = quality.fit_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                               learn=lambda i: ~in_fold(i, 3, 1))
    return _judged(scored, 3, 1, GOOD_FROM)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule or link-graph verdict of every page."""
    ready(spark)
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, taken as a file in its source's and language's directories."""
    ready(spark)
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    return license_scan.licenses(docs)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document, as digests."""
    ready(spark)
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.tiktoken"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of at most 2048."""
    ready(spark)
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_file("word_bpe_49k.json"), capacity=2048, end_id=0,
                        added_tokens=True)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets are similar by 0.9 or more."""
    ready(spark)
    return ngram_join.join_components(table(spark, sf_dir, "documents"), k=3, num=9, den=10)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle proof of every document, and whether it holds after some texts are tampered with."""
    ready(spark)
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the more frequent words they are variants of."""
    ready(spark)
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


def op13_sentence_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests; ``agrees``: the library gives the same."""
    ready(spark)
    return sentence_piece.round_trip(table(spark, sf_dir, "documents"), vocabulary_file("piece_bpe_32k.model"), checked=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_token_counts": op2_token_counts,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_url_filter": op5_url_filter,
    "op6_license_scan": op6_license_scan,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_sentence_piece": op13_sentence_piece,
}


def _crc32(text: str) -> str:
    """DuckDB: the unsigned CRC-32 of an expression's UTF-8 bytes, a bit at a time, low bits first."""
    bits = f"list_transform(range(0, 8 * strlen({text})), lambda k: get_bit(encode({text})::BIT, (8 * (k // 8) + 7 - k % 8)::INT)::BIGINT)"
    return (f"xor(list_reduce(list_prepend(4294967295, {bits}), "
            "lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)")


def _field(text: str) -> str:
    return f"coalesce(strlen({text}::VARCHAR)::VARCHAR || ':' || {text}::VARCHAR, '-')"


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FIELDS = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))

ORACLE_SQL: dict[str, str] = {
    "op1_fingerprints": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        n AS (
            SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text
            FROM t WINDOW w AS (ORDER BY doc_id DESC, text)),
        e AS (
            SELECT *, left(text, length(text) - length(text) // 2) || left(next_text, length(text) // 2) AS edited FROM n),
        s AS (
            SELECT x, list_filter(regexp_split_to_array(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                        '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
            FROM (SELECT text AS x FROM e UNION SELECT edited FROM e)),
        h AS (
            SELECT x, CASE WHEN len(words) = 0 THEN [] ELSE list_transform(range(1, greatest(len(words) - 3, 2)),
                          lambda i: left(md5(array_to_string(words[i:i + 4], ' ')), 16)) END AS hashes
            FROM s),
        f AS (
            SELECT x, CASE WHEN len(list_filter(hashes, lambda v: v < '2000000000000000')) > 0
                           THEN list_sort(list_distinct(list_filter(hashes, lambda v: v < '2000000000000000')))
                           WHEN len(hashes) > 0 THEN [list_min(hashes)] ELSE [] END AS kept
            FROM h),
        r AS (
            SELECT e.doc_id, length(e.text) AS n_chars, sha256(e.edited) AS edited_sha256, a.kept AS a, b.kept AS b, c.kept AS c
            FROM e JOIN f a ON a.x = e.text JOIN f b ON b.x = e.edited JOIN f c ON c.x = e.next_text)
        SELECT doc_id, n_chars, edited_sha256, array_to_string(a, ',') AS fingerprint, array_to_string(b, ',') AS edited_fingerprint,
               CASE WHEN a = b THEN 1.0::DOUBLE WHEN least(len(a), len(b)) = 0 THEN 0.0::DOUBLE
                    ELSE len(list_intersect(a, b))::DOUBLE / least(len(a), len(b)) END AS near_edited,
               CASE WHEN a = c THEN 1.0::DOUBLE WHEN least(len(a), len(c)) = 0 THEN 0.0::DOUBLE
                    ELSE len(list_intersect(a, c))::DOUBLE / least(len(a), len(c)) END AS near_next,
               CASE WHEN a = b THEN 1.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(a || b)) END AS jaccard_edited,
               CASE WHEN a = c THEN 1.0::DOUBLE ELSE len(list_intersect(a, c))::DOUBLE / len(list_distinct(a || c)) END AS jaccard_next
        FROM r
    """,
    # Rules as a table, the longest that fits first; ranks by recursion over the host links.
    "op5_url_filter": r"""
        WITH RECURSIVE u AS (
            SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest
            FROM pages),
        p AS (
            SELECT row_number() OVER () AS row, page_id, html,
                   translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
            FROM u),
        r(what, rhost, rpath) AS (
            VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                   ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        m AS (
            SELECT p.*, r.what, r.rhost || r.rpath AS rule,
                   row_number() OVER (PARTITION BY p.row ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS best
            FROM p LEFT JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)),
        j AS (SELECT * FROM m WHERE best = 1),
        l AS (
            SELECT host AS src, dst, count(*) AS n
            FROM (SELECT host, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(html, ''),
                         '(?i)href\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"''\s<>]+)', 1),
                         lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) AS dst FROM j WHERE host <> '')
            WHERE host <> dst GROUP BY ALL),
        e AS (
            SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM l),
        s AS (
            SELECT host, sum(t) AS t, sum(d) AS d FROM (
                SELECT host, avg((what IS NOT DISTINCT FROM 'allow')::INT) AS t, avg((what IS NOT DISTINCT FROM 'block')::INT) AS d
                FROM j WHERE host <> '' GROUP BY host
                UNION ALL SELECT src, 0, 0 FROM e UNION ALL SELECT dst, 0, 0 FROM e)
            GROUP BY host),
        k AS (
            SELECT 0 AS i, host, 0.15 * t AS trust, 0.15 * d AS distrust FROM s
            UNION ALL
            SELECT any_value(f.i) + 1, s.host, 0.15 * any_value(s.t) + 0.85 * sum(f.t), 0.15 * any_value(s.d) + 0.85 * sum(f.d)
            FROM s JOIN (
                SELECT i, host, 0.0 AS t, 0.0 AS d FROM k
                UNION ALL SELECT k.i, e.dst, k.trust * e.share, 0.0 FROM k JOIN e ON e.src = k.host
                UNION ALL SELECT k.i, e.src, 0.0, k.distrust * e.share FROM k JOIN e ON e.dst = k.host) f ON f.host = s.host
            WHERE f.i < 20 GROUP BY s.host)
        SELECT j.page_id, j.host, j.path, j.rule,
               coalesce(j.what, CASE WHEN k.distrust - k.trust > 0.075 + 1e-9 THEN 'block' ELSE 'allow' END) AS verdict
        FROM j LEFT JOIN k ON k.host = j.host AND k.i = 20
    """,
    "op7_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
             g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
        SELECT t.doc_id, g.keep_id, g.group_size,
               t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.text) AS text_sha256
        FROM t JOIN g ON t.text = g.text
    """,
    "op10_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(words) - 1, 2)),
                       lambda i: array_to_string(words[i:i + 2], ' '))) AS shingle
            FROM w WHERE len(words) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
            FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (
            SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
        FROM w LEFT JOIN n ON n.doc_id = w.doc_id
        JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) m ON m.doc_id = w.doc_id
    """,
    # Every tree level by recursion, then every row's way up, first in its source's tree, then in the upper one.
    "op11_merkle_manifest": f"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, source, lang, n_chars, text FROM documents),
        l AS (
            SELECT row, doc_id, source, sha256({_FIELDS} || {_field("text")}) AS leaf,
                   sha256({_FIELDS} || {_field(_LOWER.format("text"))}) AS lowered,
                   coalesce({_crc32("doc_id::VARCHAR")} % 5 = 0, false) AS tampered
            FROM d),
        o AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS i,
                   count(*) OVER (PARTITION BY source) AS n
            FROM l),
        t AS (
            SELECT source, 0 AS level, i, n, leaf AS h FROM o
            UNION ALL
            SELECT source, level + 1, i // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY i))
            FROM t WHERE n > 1 GROUP BY source, level, i // 16),
        s AS (
            SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n
            FROM t WHERE n = 1),
        u AS (
            SELECT 0 AS level, i, n, subroot AS h FROM s
            UNION ALL
            SELECT level + 1, i // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY i))
            FROM u WHERE n > 1 GROUP BY level, i // 16),
        p AS (
            SELECT row, source, 0 AS level, i, n, CASE WHEN tampered THEN lowered ELSE leaf END AS node, '' AS proof FROM o
            UNION ALL
            SELECT p.row, p.source, p.level + 1, p.i // 16, (any_value(p.n) + 15) // 16,
                   sha256(string_agg(CASE WHEN t.i = p.i THEN p.node ELSE t.h END, '' ORDER BY t.i)),
                   any_value(p.proof) || coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (WHERE t.i <> p.i), '')
            FROM p JOIN t ON t.source IS NOT DISTINCT FROM p.source AND t.level = p.level AND t.i // 16 = p.i // 16
            WHERE p.n > 1 GROUP BY p.row, p.source, p.level, p.i),
        q AS (
            SELECT p.row, 0 AS level, s.i, s.n, p.node, p.proof
            FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source WHERE p.n = 1
            UNION ALL
            SELECT q.row, q.level + 1, q.i // 16, (any_value(q.n) + 15) // 16,
                   sha256(string_agg(CASE WHEN u.i = q.i THEN q.node ELSE u.h END, '' ORDER BY u.i)),
                   any_value(q.proof) || coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (WHERE u.i <> q.i), '')
            FROM q JOIN u ON u.level = q.level AND u.i // 16 = q.i // 16
            WHERE q.n > 1 GROUP BY q.row, q.level, q.i)
        SELECT o.doc_id, o.leaf, s.subroot, r.h AS root, sha256(q.proof) AS proof_sha256, q.node AS folded_root,
               q.node = r.h AS verified
        FROM o JOIN s ON s.source IS NOT DISTINCT FROM o.source JOIN q ON q.row = o.row AND q.n = 1 JOIN u r ON r.n = 1
    """,
    # Pairs one replacement apart are equal without the same letter; one insertion apart, without one letter of the longer.
    "op12_spelling_variants": f"""
        WITH RECURSIVE r AS (
            SELECT doc_id, run, count(*) AS n
            FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
        k AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS key, run, n FROM r),
        h AS (SELECT run, n, {_crc32("key")} AS h FROM k),
        o AS (
            SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
            FROM h),
        w AS (SELECT word, sum(n)::BIGINT AS n FROM o WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        c AS (SELECT word, p, left(word, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM w)),
        m AS (
            SELECT a.word, b.word AS near FROM c a JOIN c b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT c.word, w.word FROM c JOIN w ON w.word = c.rest
            UNION SELECT w.word, c.word FROM c JOIN w ON w.word = c.rest),
        b AS (
            SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
                   row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place
            FROM (SELECT m.word, m.near, w.n AS near_n FROM m JOIN w ON w.word = m.near)),
        f AS (
            SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 2 * w.n THEN b.near END AS form,
                   CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n
            FROM w LEFT JOIN b ON b.word = w.word AND b.place = 1),
        g AS (SELECT word, word AS root FROM f UNION ALL SELECT g.word, f.form FROM g JOIN f ON f.word = g.root WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, g.root, f.n, f.n_near, f.form_n
        FROM f JOIN g ON g.word = f.word JOIN f e ON e.word = g.root AND e.form IS NULL
    """,
}
