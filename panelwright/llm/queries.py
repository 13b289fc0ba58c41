"""Queries of the training-data operators, one per operator, over whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.decontamination import overlaps
from panelwright.llm.exact_dedup import exact_groups
from panelwright.llm.filter_audit import filter_audit
from panelwright.llm.language_id import identified, learned
from panelwright.llm.licences import licences
from panelwright.llm.line_dedup import without_repeated_lines
from panelwright.llm.lm_scoring import lm_scores
from panelwright.llm.manifest import manifest
from panelwright.llm.packing import packed
from panelwright.llm.personal_data import fit as fit_personal_data
from panelwright.llm.personal_data import personal_data
from panelwright.llm.secrets import fit as fit_secrets
from panelwright.llm.secrets import secrets
from panelwright.llm.simhash_dedup import near_groups
from panelwright.llm.url_filter import judged_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(
    "op8_exact_dedup",
    r"""
    WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
           doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
    FROM n
    """,
)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(table(spark, folder, "documents"))


@query("op9_packing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"))


@query("op6_simhash_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = near_groups(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query(
    "op7_decontamination",
    r"""
    WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS t FROM documents),
    b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS t FROM benchmark),
    dw AS (SELECT doc_id, unnest(t) AS w, unnest(range(len(t))) AS p FROM d),
    bw AS (SELECT item_id, len(t) AS n, unnest(t) AS w, unnest(range(len(t))) AS p FROM b WHERE len(t) >= 5),
    shifts AS (SELECT doc_id, item_id, dw.p - bw.p AS shift FROM dw JOIN bw USING (w) GROUP BY 1, 2, 3 HAVING count(*) >= ceil(least(13, any_value(n)) * 0.8 - 1e-9)),
    same AS (
        SELECT s.doc_id, s.item_id, s.shift, least(13, len(b.t)) AS l,
               list_transform(range(len(b.t)), lambda i: CASE WHEN i + s.shift >= 0 AND d.t[i + s.shift + 1] = b.t[i + 1] THEN 1 ELSE 0 END) AS m
        FROM shifts s JOIN d USING (doc_id) JOIN b ON s.item_id = b.item_id
    ),
    w AS (SELECT doc_id, item_id, shift, l, m, unnest(range(len(m) - l + 1)) AS f FROM same),
    c AS (SELECT doc_id, item_id, shift, l, f, list_sum(m[f + 1 : f + l]) AS matched FROM w)
    SELECT doc_id, item_id, CAST(min(f + shift) AS BIGINT) AS first_word, CAST(max(f + shift + l - 1) AS BIGINT) AS last_word,
           CAST(max(matched) AS BIGINT) AS matched, count(*) AS windows
    FROM c WHERE matched >= ceil(l * 0.8 - 1e-9) GROUP BY doc_id, item_id
    """,
)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op5_language_id")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return identified(docs, learned(docs))


@query("op3_personal_data")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return personal_data(docs, fit_personal_data(docs))


@query("op4_secrets")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return secrets(docs, fit_secrets(docs))


@query("op1_line_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return without_repeated_lines(table(spark, folder, "documents")).select("doc_id", "text", F.col("_n_removed").alias("n_removed"))


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


@query("op2_lm_scoring")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scores(table(spark, folder, "documents"))


@query("op10_licences")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return licences(table(spark, folder, "documents"))


@query(
    "op11_filter_audit",
    r"""
    WITH d AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
               min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents
    ),
    f AS (
        SELECT part, CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INT)
                     + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(least < doc_id, false) AS INT) AS fails,
               doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic
        FROM d
    ),
    s AS (SELECT part, s, count(*) FILTER (WHERE fails & s = 0) AS n, count(*) FILTER (WHERE fails & s = 0 AND good) AS g, count(*) FILTER (WHERE fails & s = 0 AND toxic) AS x FROM f, (SELECT unnest(range(32)) AS s) GROUP BY part, s),
    parts AS (SELECT part, list(n ORDER BY s) AS n, list(g ORDER BY s) AS g, list(x ORDER BY s) AS x FROM s GROUP BY part),
    l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
    orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
    steps AS (
        SELECT o, i, 1 << (ascii(o[i]) - 65) AS own, list_sum(list_transform(range(1, i), lambda j: 1 << (ascii(o[j]) - 65))) AS before
        FROM orders, (SELECT unnest(range(1, 6)) AS i)
    ),
    r AS (
        SELECT part, o, i, own, n[(b | own) + 1] AS kept, n[b + 1] - n[(b | own) + 1] AS removed, n[1] - n[own + 1] AS failing, n[xor(31, own) + 1] - n[32] AS alone,
               g[b + 1] - g[(b | own) + 1] AS gl, x[b + 1] - x[(b | own) + 1] AS tl
        FROM parts, (SELECT o, i, own, CAST(coalesce(before, 0) AS BIGINT) AS b FROM steps)
    ),
    shares AS (SELECT part, own, sum(removed) AS total FROM r GROUP BY part, own)
    SELECT part, o AS filter_order, CAST(i AS INT) AS step, kept, removed, failing - removed AS redundant, alone AS unique_fails, gl AS good_lost, tl AS toxic_lost, CAST(total AS BIGINT) AS shapley
    FROM r JOIN shares USING (part, own)
    """,
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query(
    "op12_merkle_manifest",
    r"""
    WITH RECURSIVE d AS (
        SELECT row_number() OVER () AS row, doc_id, coalesce('+' || source, '') AS k,
               list_reduce([4294967295::UBIGINT] || flatten(list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda i: [CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS UBIGINT), 0, 0, 0, 0, 0, 0, 0])),
                           lambda c, y: xor(xor(c, y) >> 1, 3988292384::UBIGINT * (xor(c, y) & 1::UBIGINT))) AS crc,
               list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text], lambda v: coalesce(strlen(v) || ':' || v, '-')) AS v,
               coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS low FROM documents
    ),
    h AS (SELECT row, doc_id, k, sha256(array_to_string(v, '')) AS h, CASE WHEN xor(crc, 4294967295::UBIGINT) % 5 = 0 THEN sha256(array_to_string(v[:4], '') || low) END AS changed FROM d),
    leaves AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM h),
    up AS (
        SELECT 0 AS lv, k, pos, n, h FROM leaves
        UNION ALL
        SELECT lv + 1, k, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY lv, k, pos // 16
    ),
    sub AS (SELECT k, h, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
    top AS (
        SELECT 0 AS lv, pos, n, h FROM sub
        UNION ALL
        SELECT lv + 1, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lv, pos // 16
    ),
    nodes AS (SELECT lv, k, pos, n, h FROM up WHERE n > 1 UNION ALL SELECT 100 + lv, '', pos, n, h FROM top WHERE n > 1),
    runs AS (SELECT lv, k, pos // 16 AS run, list(h ORDER BY pos) AS hs FROM nodes GROUP BY lv, k, pos // 16),
    walk AS (
        SELECT row, 0 AS lv, k, pos, coalesce(changed, h) AS h, '' AS proof FROM leaves
        UNION ALL
        SELECT w.row, w.lv + 1, w.k, w.pos // 16, sha256(array_to_string(r.hs[:w.pos % 16], '') || w.h || array_to_string(r.hs[w.pos % 16 + 2:], '')),
               w.proof || array_to_string(r.hs[:w.pos % 16], '') || array_to_string(r.hs[w.pos % 16 + 2:], '')
        FROM walk w JOIN runs r ON r.lv = w.lv AND r.k = w.k AND r.run = w.pos // 16
    ),
    low AS (SELECT row, arg_max(h, lv) AS h, arg_max(proof, lv) AS proof, any_value(k) AS k FROM walk GROUP BY row),
    climb AS (
        SELECT low.row, 100 AS lv, sub.pos, low.h, low.proof FROM low JOIN sub USING (k)
        UNION ALL
        SELECT w.row, w.lv + 1, w.pos // 16, sha256(array_to_string(r.hs[:w.pos % 16], '') || w.h || array_to_string(r.hs[w.pos % 16 + 2:], '')),
               w.proof || array_to_string(r.hs[:w.pos % 16], '') || array_to_string(r.hs[w.pos % 16 + 2:], '')
        FROM climb w JOIN runs r ON r.lv = w.lv AND r.k = '' AND r.run = w.pos // 16
    ),
    ends AS (SELECT row, arg_max(h, lv) AS h, arg_max(proof, lv) AS proof FROM climb GROUP BY row),
    root AS (SELECT h FROM top WHERE n = 1)
    SELECT l.doc_id, l.h AS leaf, sub.h AS subroot, root.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = root.h AS verified
    FROM leaves l JOIN sub ON l.k = sub.k JOIN ends e ON e.row = l.row, root
    """,
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return manifest(table(spark, folder, "documents"))


def _url_levels(order: int) -> str:
    """The chain of model levels of op13's SQL, one for each context length."""
    out = []
    for n in range(2, order + 2):
        out.append(f"""
    c{n} AS (SELECT s, a, r, substr(s, 1, {n - 1}) AS x, substr(s, 2) AS y, sum(a) OVER k AS na, sum(r) OVER k AS nr, count(*) FILTER (WHERE a > 0) OVER k AS ta, count(*) FILTER (WHERE r > 0) OVER k AS tr
             FROM counts WHERE length(s) = {n} WINDOW k AS (PARTITION BY substr(s, 1, {n - 1}))),
    p{n} AS (SELECT c.*, p.pa AS qa, p.pr AS qr, CASE WHEN na > 0 THEN (c.a + ta * p.pa) / (na + ta) ELSE p.pa END AS pa, CASE WHEN nr > 0 THEN (c.r + tr * p.pr) / (nr + tr) ELSE p.pr END AS pr,
                    CASE WHEN na > 0 THEN ln(ta / (na + ta)) ELSE 0 END AS la, CASE WHEN nr > 0 THEN ln(tr / (nr + tr)) ELSE 0 END AS lr FROM c{n} c JOIN (SELECT s AS ps, pa, pr FROM p{n - 1}) p ON c.y = p.ps),
    w{n} AS (SELECT s, CASE WHEN a > 0 THEN ln(pa) - la - ln(qa) ELSE 0 END - CASE WHEN r > 0 THEN ln(pr) - lr - ln(qr) ELSE 0 END AS w FROM p{n}
             UNION ALL SELECT x, max(la - lr) FROM p{n} GROUP BY x),""")
    return "".join(out)


@query(
    "op13_url_filter",
    r"""
    WITH u AS (
        SELECT row_number() OVER () AS row, page_id, coalesce(url, '') AS url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
               chr(2) || translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(2) || chr(3), 'abcdefghijklmnopqrstuvwxyz' || chr(1) || chr(1)) || chr(3) AS t,
               list_reduce([4294967295::UBIGINT] || flatten(list_transform(range(0, octet_length(encode(coalesce(url, '')))), lambda i: [CAST('0x' || hex(encode(coalesce(url, '')))[2 * i + 1 : 2 * i + 2] AS UBIGINT), 0, 0, 0, 0, 0, 0, 0])),
                           lambda c, y: xor(xor(c, y) >> 1, 3988292384::UBIGINT * (xor(c, y) & 1::UBIGINT))) AS crc FROM pages
    ),
    rules AS (SELECT * FROM (VALUES ('allow', 'com/'), ('block', 'example.com/en/'), ('allow', 'www.example.com/en/'), ('block', 'net/es/'), ('block', 'net/fr/')) v(verdict, rule)),
    fits AS (
        SELECT row, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM u, rules
        WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, rule[strpos(rule, '/') :]) GROUP BY row
    ),
    j AS (SELECT u.*, rule, verdict, xor(crc, 4294967295::UBIGINT) % 5 = 0 AS held FROM u LEFT JOIN fits USING (row)),
    places AS (SELECT row, verdict, held, unnest(flatten(list_transform([1, 2, 3, 4, 5], lambda n: list_transform(range(1, length(t) - n + 2), lambda i: substr(t, i, n))))) AS s FROM j),
    counts AS (SELECT s, count(*) FILTER (WHERE verdict = 'allow') AS a, count(*) FILTER (WHERE verdict = 'block') AS r FROM places WHERE verdict IS NOT NULL AND NOT held AND s <> chr(2) GROUP BY s),
    n AS (SELECT CAST(coalesce(sum(a), 0) + count(*) + 1 AS DOUBLE) AS ba, CAST(coalesce(sum(r), 0) + count(*) + 1 AS DOUBLE) AS br FROM counts WHERE length(s) = 1),
    p1 AS (SELECT s, (a + 1) / ba AS pa, (r + 1) / br AS pr FROM counts, n WHERE length(s) = 1),
    w1 AS (SELECT s, ln(pa) - ln(pr) AS w FROM p1),"""
    + _url_levels(4)
    + r"""
    weights AS (SELECT s, floor(sum(w) * 1000000 + 0.5) AS w FROM (FROM w1 UNION ALL FROM w2 UNION ALL FROM w3 UNION ALL FROM w4 UNION ALL FROM w5) GROUP BY s),
    scores AS (
        SELECT row, CAST(floor(sum(coalesce(w.w, CASE WHEN length(p.s) = 1 THEN (SELECT floor((ln(1 / ba) - ln(1 / br)) * 1000000 + 0.5) FROM n) ELSE 0 END)) * 1000 / ((any_value(length(t)) - 1) * 1000000)) AS INT) AS score
        FROM places p JOIN j USING (row) LEFT JOIN weights w USING (s) GROUP BY row
    ),
    hist AS (SELECT score, count(*) FILTER (WHERE verdict = 'allow') AS a, count(*) FILTER (WHERE verdict = 'block') AS r FROM j JOIN scores USING (row) WHERE verdict IS NOT NULL AND held GROUP BY score),
    cuts AS (SELECT score, lag(score) OVER (ORDER BY score) AS last, coalesce(sum(r) OVER b, 0) * (SELECT sum(a) FROM hist) - coalesce(sum(a) OVER b, 0) * (SELECT sum(r) FROM hist) AS gain FROM hist WINDOW b AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    least AS (SELECT CASE WHEN (SELECT coalesce(least(sum(a), sum(r)), 0) FROM hist) = 0 THEN 0 ELSE (SELECT coalesce(floor((last + 1 + score) / 2), score) FROM cuts ORDER BY gain DESC, score LIMIT 1) END AS cut)
    SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN score >= cut THEN 'allow' ELSE 'block' END) AS verdict, CASE WHEN verdict IS NULL THEN score END AS score
    FROM j JOIN scores USING (row), least
    """,
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return judged_urls(table(spark, folder, "pages"))
