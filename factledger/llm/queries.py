"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.llm import (
    divergence,
    exact_dedup,
    fingerprints,
    line_dedup,
    mixing,
    packing,
    periodic,
    pii,
    positional,
    quality,
    records,
    simhash,
    url_rules,
)
from factledger.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Rules of the URL query: host, path prefix, verdict.
URL_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def tokenizer(name: str) -> str:
    """Where a public vocabulary lies; the same place on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(name: str, sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


@query("op1_simhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


@query("op2_token_records")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("byte_bpe_50k.json")
    return records.record_digests(records.write_records(read(spark, sf_dir, "documents"), path), path)


@query(
    "op3_imatch",
    r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM documents),
    e AS (
      SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text,
             coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id
      FROM d WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    x AS (
      SELECT doc_id, next_id, n_chars, text,
             left(text, n_chars - n_chars // 2) || left(next_text, n_chars // 2) AS edited
      FROM e),
    s AS (SELECT doc_id, 0 AS side, text FROM x UNION ALL SELECT doc_id, 1, edited FROM x),
    t AS (
      SELECT DISTINCT doc_id, side,
             unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM s),
    n AS (SELECT count(*) AS n FROM d),
    lex AS (
      SELECT term FROM t, n WHERE side = 0 GROUP BY term, n
      HAVING count(*) >= greatest(2, n / 1024) AND count(*) <= n / 8),
    k AS (
      SELECT range AS k, CASE WHEN range < 8 THEN '200' WHEN range < 32 THEN '040' ELSE '010' END AS below
      FROM range(48)),
    m AS (SELECT term, k FROM lex, k WHERE substr(md5(k || ':' || term), 1, 3) < below),
    b AS (
      SELECT doc_id, side, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 16) AS h
      FROM t JOIN lex USING (term) GROUP BY doc_id, side),
    g AS (
      SELECT doc_id, side, k, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 4) AS h
      FROM t JOIN m USING (term) GROUP BY doc_id, side, k),
    f AS (
      SELECT s.doc_id, s.side, coalesce(any_value(b.h), substr(md5(any_value(s.text)), 1, 16)) AS h,
             string_agg(coalesce(g.h, 'none'), ':' ORDER BY k.k) AS parts
      FROM s CROSS JOIN k
      LEFT JOIN g ON g.doc_id = s.doc_id AND g.side = s.side AND g.k = k.k
      LEFT JOIN b ON b.doc_id = s.doc_id AND b.side = s.side
      GROUP BY s.doc_id, s.side),
    p AS (
      SELECT a.doc_id AS a_id, a.side AS a_side, c.doc_id AS c_id, c.side AS c_side, a.h = c.h AS same,
             list_zip(string_split(a.parts, ':'), string_split(c.parts, ':')) AS z
      FROM x JOIN f a ON a.doc_id = x.doc_id AND a.side = 0
      JOIN f c ON (c.doc_id = x.doc_id AND c.side = 1) OR (c.doc_id = x.next_id AND c.side = 0)),
    q AS (
      SELECT a_id, c_id, c_side,
             CASE WHEN len(list_filter(z, lambda v: v[1] <> 'none' OR v[2] <> 'none')) > 0
                  THEN len(list_filter(z, lambda v: v[1] <> 'none' AND v[1] = v[2]))
                       / len(list_filter(z, lambda v: v[1] <> 'none' OR v[2] <> 'none'))
                  ELSE same::DOUBLE END AS near
      FROM p)
    SELECT x.doc_id, x.n_chars, sha256(x.edited) AS edited_sha256, o.h || ':' || o.parts AS fingerprint,
           w.h || ':' || w.parts AS edited_fingerprint, qe.near AS near_edited, qn.near AS near_next
    FROM x JOIN f o ON o.doc_id = x.doc_id AND o.side = 0 JOIN f w ON w.doc_id = x.doc_id AND w.side = 1
    JOIN q qe ON qe.a_id = x.doc_id AND qe.c_side = 1
    JOIN q qn ON qn.a_id = x.doc_id AND qn.c_id = x.next_id AND qn.c_side = 0
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.compare_edited(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.array_join("print", ":").alias("fingerprint"),
        F.array_join("edited_print", ":").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = quality.learning_labels(read(spark, sf_dir, "labels"))
    found = quality.classify(read(spark, sf_dir, "documents"), labels)
    return found.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


@query(
    "op5_exact_dedup",
    r"""
    WITH d AS (
      SELECT doc_id, length(coalesce(text, '')) AS n,
             sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
      FROM documents),
    k AS (SELECT h, arg_max(doc_id, (n, -doc_id)) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
    SELECT d.doc_id, k.keep_id, k.group_size, d.doc_id = k.keep_id AS kept, d.h AS text_sha256
    FROM d JOIN k ON d.h = k.h
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = exact_dedup.fresh_index(spark).add(docs)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query("op6_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(read(spark, sf_dir, "documents"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return found.select("doc_id", "size", "source_size", "target", taken, "source", "copies")


@query("op7_personal_data")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents"))

    def joined(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans")
    )


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pieces(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), with_ids=False)
    return found.drop("ids")


@query("op9_fuzzy_lines")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(read(spark, sf_dir, "documents"))


@query(
    "op10_url_rules",
    r"""
    WITH p AS (
      SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
      FROM pages),
    q AS (
      SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(h) + 1), '^[^?#]*', 0) AS path
      FROM (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) AS h FROM p)),
    r(h, t, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                          ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
    f AS (
      SELECT q.page_id, max_by(r.h || r.t, length(r.h || r.t)) AS rule, max_by(r.v, length(r.h || r.t)) AS verdict
      FROM q JOIN r ON (q.host = r.h OR ends_with(q.host, '.' || r.h)) AND starts_with(q.path, r.t)
      GROUP BY q.page_id)
    SELECT q.page_id, q.host, q.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
    FROM q LEFT JOIN f ON q.page_id = f.page_id
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_rules.judge(pages, url_rules.build(rules)).drop("url")


@query(
    "op11_periodic_runs",
    r"""
    WITH t AS (
      SELECT row_number() OVER () AS r, doc_id,
             list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS o,
             -- crc32 of the decimal id: each byte is followed by seven empty steps
             xor(list_reduce(list_prepend(4294967295::BIGINT,
                   flatten(list_transform(string_split(doc_id::VARCHAR, ''),
                                          lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                   lambda c, e: xor(xor(c, e) >> 1, (xor(c, e) & 1) * 3988292384)), 4294967295) AS h
      FROM documents),
    g AS (SELECT *, len(o) AS n, h // 10 AS g FROM t),
    a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM g),
    p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
    e AS (
      SELECT r, doc_id, n, CASE WHEN a IS NULL THEN o
             ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN o[i + 1] ELSE o[1 + a + (i - a) % p] END)
             END AS words
      FROM p),
    w AS (SELECT r, n, unnest(range(n)) AS i, unnest(words) AS term FROM e),
    s AS (
      SELECT x.r, y.i - x.i AS q, x.i FROM w x JOIN w y
      ON x.r = y.r AND x.term = y.term AND y.i > x.i AND (y.i - x.i) * 3 <= x.n),
    k AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM s),
    l AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM k GROUP BY r, q, island),
    f AS (
      SELECT r, start, length, min(q) AS period FROM l WHERE length >= greatest(24, 3 * q) GROUP BY r, start, length),
    c AS (
      SELECT r, count(*) AS n_runs,
             first(struct_pack(start, length, period) ORDER BY length / period DESC, start, period) AS top,
             string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said
      FROM f GROUP BY r),
    gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM f),
    m AS (
      SELECT w.r, string_agg(w.term, ' ' ORDER BY w.i) AS collapsed
      FROM w LEFT JOIN gone ON gone.r = w.r AND gone.i = w.i WHERE gone.r IS NULL GROUP BY w.r)
    SELECT e.doc_id, coalesce(c.n_runs, 0) AS n_runs, c.top.start AS start, c.top.length AS length,
           c.top.period AS period, 1000 * c.top.length // c.top.period AS exponent_milli,
           sha256(coalesce(c.said, '')) AS runs_sha256, sha256(coalesce(m.collapsed, '')) AS collapsed_sha256
    FROM e LEFT JOIN c ON c.r = e.r LEFT JOIN m ON m.r = e.r
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(periodic.with_planted_runs(read(spark, sf_dir, "documents")))
    said = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    top = periodic.foremost(F.col("runs"))
    return found.withColumn("top", top).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(said, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query(
    "op12_source_audit",
    r"""
    WITH d AS (
      SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
      FROM documents),
    t AS (
      SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
    v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT t.lang, source, t.term, count(*) AS n FROM t JOIN k ON k.lang = t.lang AND k.term = t.term GROUP BY ALL),
    x AS (
      SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n
      FROM g JOIN k ON g.lang = k.lang
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    s AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM x GROUP BY lang, source),
    p AS (
      SELECT x.*, 1 + (1000000000 * (x.n + 2)) // (s.total + 2 * v.v) AS p
      FROM x JOIN s ON s.lang = x.lang AND s.source = x.source JOIN v ON v.lang = x.lang),
    l AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM x GROUP BY lang, term),
    lt AS (SELECT lang, sum(n)::HUGEINT AS total FROM l GROUP BY lang),
    q AS (
      SELECT l.lang, l.term, 1 + (1000000000 * (l.n + 2)) // (lt.total + 2 * v.v) AS q
      FROM l JOIN lt ON lt.lang = l.lang JOIN v ON v.lang = l.lang),
    f AS (
      SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    e AS (
      SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g JOIN g h ON h.lang = g.lang AND h.source <> g.source
      LEFT JOIN f ON f.lang = g.lang AND f.source = g.source AND f.item = h.source
      UNION ALL
      SELECT p.lang, p.source, 'term', p.term, ((p - q) * (p - q) // (p + q))::BIGINT
      FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q),
    o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM e)
    SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM o WHERE part = 'pair' OR rank <= 10
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


@query(
    "op13_decontaminate",
    r"""
    WITH t AS (
      SELECT row_number() OVER () AS r, doc_id,
             list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
      FROM documents),
    b AS (
      SELECT item_id,
             list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
      FROM benchmark),
    w AS (
      SELECT DISTINCT item_id, least(10, len(words)) AS width,
             array_to_string(words[s : s + least(10, len(words)) - 1], ' ') AS said
      FROM (SELECT item_id, words, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS s FROM b WHERE len(words) > 0)),
    g AS (
      SELECT r, s, width, array_to_string(words[s : s + width - 1], ' ') AS said
      FROM (SELECT r, words, width, unnest(range(1, len(words) - width + 2)) AS s
            FROM t, (SELECT DISTINCT width FROM w) WHERE len(words) >= width)),
    o AS (SELECT g.r, g.s, g.width, w.item_id FROM g JOIN w ON w.width = g.width AND w.said = g.said),
    h AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(s, s + width)) AS place FROM o) GROUP BY r),
    i AS (
      SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM o WHERE item_id IS NOT NULL) GROUP BY r)
    SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM t LEFT JOIN h ON h.r = t.r LEFT JOIN i ON i.r = t.r
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = positional.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
