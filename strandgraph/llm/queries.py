"""The registered queries over the operators of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, line_dedup, lm_score, mixing, quality, simhash, suffix_dedup, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id, remainder: int):
    return F.crc32(doc_id.cast("string")) % 5 == remainder


def op1_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The tree of the mixing query: weights of its nodes, by path; 1 where none is given.
LEVELS = ("domain", "lang", "source")
WEIGHTS = {("crawl",): 4, ("reference",): 3, ("forum",): 2, **{(d, lang): w for d in ("crawl", "reference", "forum") for lang, w in (("en", 5), ("de", 2), ("fr", 2))}}
_DOMAIN = "CASE WHEN source = 'src0' THEN 'crawl' WHEN source IN ('src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8', 'src9') THEN 'reference' ELSE 'forum' END"


def mixed(docs: DataFrame) -> DataFrame:
    """Six tenths of the tokens of `docs` by the weights above, in at most three epochs."""
    levels = {"domain": F.expr(_DOMAIN), "lang": F.col("lang"), "source": F.col("source")}
    return mixing.mix(docs, levels, WEIGHTS, F.expr("coalesce(sum(tokens), 0) * 6 div 10"), max_epochs=3, seed=7)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *(F.col(f"level_{x}").alias(f"level_{x}") for x in LEVELS), "n_tokens", "epoch", "leaf_budget")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    scored = quality.quality_scores(docs, model)
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{_SAID}'), (-7L, 1L, 'assistant', '{_SAID}') AS t(conv_id, turn, role, text)")
    examples = chat.format_chats(rows.unionByName(planted))
    # The loss text of each example, and the last example, which holds every turn. Without a conv_id, an example is a whole conversation.
    loss = F.struct("example", chat.read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("t"))
    got = examples.where("conv_id IS NOT NULL").groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("last"),
        F.sort_array(F.collect_list(loss)).alias("losses"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_examples"),
    )
    alone = examples.where("conv_id IS NULL")
    got = got.unionByName(alone.select("conv_id", F.col("formatted").alias("last"), F.array(loss).alias("losses"), F.length("formatted").cast("long").alias("formatted_chars"), F.lit(1).cast("long").alias("n_examples")))
    turns, loss = chat.read_turns(F.col("last")), F.array_join(F.col("losses.t"), "")
    return got.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"), "n_examples",
    )


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(_table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 1))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derivatives(warc.responses(_table(spark, sf_dir, "pages")))
    return records.select(
        "page_id", "record_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", F.length("block").cast("long").alias("content_length"), "block_digest", "payload_digest",
        F.col("source_headers")["status"].alias("source_status"), F.col("source_headers")["content-type"].alias("source_content_type"), F.col("source_headers")["content-length"].cast("long").alias("source_content_length"),
    )


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_lines(_table(spark, sf_dir, "documents")).select("doc_id", "line_no", "keep_doc_id", "keep_line_no", "edits")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_key")


QUERIES = {f.__name__: f for f in (op1_suffix, op2_mixing, op3_quality, op4_chat, op5_lm, op6_simhash, op7_warc, op8_lines, op9_ann, op10_decontam)}


def _weight_sql(depth: int) -> str:
    cases = " ".join("WHEN " + " AND ".join(f"{c} = '{k}'" for c, k in zip(LEVELS, key)) + f" THEN {w}" for key, w in WEIGHTS.items() if len(key) == depth)
    return f"CASE {cases} ELSE 1 END" if cases else "1"


def _fill_sql(name: str, source: str, depth: int) -> str:
    """CTEs that hand the budgets in `source` (the parents' `budget`) down to the nodes of one level."""
    path, parent = ", ".join(LEVELS[:depth]), ", ".join(LEVELS[: depth - 1]) or "0"
    join = "CROSS JOIN root" if depth == 1 else f"JOIN (SELECT {parent}, budget FROM {source}) USING ({parent})"
    return f"""
{name}_n AS (SELECT {path}, cap, tokens, w, budget FROM (SELECT {path}, CAST(sum(tokens) * 3 AS BIGINT) AS cap, CAST(sum(tokens) AS BIGINT) AS tokens, {_weight_sql(depth)} AS w FROM leaves GROUP BY {path}) {join}),
{name}_s AS (SELECT *, CAST(coalesce(sum(cap) OVER b, 0) AS BIGINT) AS _c, CAST(coalesce(sum(w) OVER b, 0) AS BIGINT) AS _v, CAST(sum(w) OVER (PARTITION BY {parent}) AS BIGINT) AS _w FROM {name}_n
  WINDOW b AS (PARTITION BY {parent} ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), {LEVELS[depth - 1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_f AS (SELECT *, _c * w + cap * (_w - _v) <= budget * w AS _full FROM {name}_s),
{name}_r AS (SELECT *, CAST(sum(CASE WHEN _full THEN cap ELSE 0 END) OVER (PARTITION BY {parent}) AS BIGINT) AS _s, CAST(sum(CASE WHEN _full THEN 0 ELSE w END) OVER (PARTITION BY {parent}) AS BIGINT) AS _r FROM {name}_f),
{name} AS (SELECT {path}, tokens, CASE WHEN _full THEN cap ELSE (budget - _s) * w // _r END AS budget FROM {name}_r)"""


_SAID = "</s>[INST] ok [/INST]"


def _escaped(x: str) -> str:
    """The length of an escaped text: a code point more for each tilde and each control string."""
    each = " + ".join(f"(length({x}) - length(replace({x}, '{c}', ''))) // {len(c)}" for c in ("~", "<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"))
    return f"(length({x}) + {each})"


SQL: dict[str, str] = {
    "op1_suffix": """
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT r, b, unnest(range(0, octet_length(b) - 399)) AS s FROM docs WHERE octet_length(b) >= 400),
hashed AS MATERIALIZED (SELECT r, s, md5(array_slice(b, s + 1, s + 400)) AS h FROM starts),
twice AS (SELECT h FROM hashed GROUP BY h HAVING count(*) > 1),
hit AS (SELECT r, s FROM hashed WHERE h IN (SELECT h FROM twice)),
marked AS (SELECT r, s, CASE WHEN s > lag(s) OVER (PARTITION BY r ORDER BY s) + 400 OR lag(s) OVER (PARTITION BY r ORDER BY s) IS NULL THEN 1 ELSE 0 END AS new FROM hit),
runs AS (SELECT r, k, min(s) AS a, max(s) + 400 AS z FROM (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY s) AS k FROM marked) GROUP BY r, k),
gaps AS (SELECT r, z AS a, coalesce(lead(a) OVER (PARTITION BY r ORDER BY a), -1) AS z FROM runs UNION ALL SELECT r, 0, min(a) FROM runs GROUP BY r),
kept AS (SELECT g.r, string_agg(hex(array_slice(b, a + 1, CASE WHEN z < 0 THEN octet_length(b) ELSE z END)), '' ORDER BY a) AS x FROM gaps g JOIN docs d ON d.r = g.r WHERE z <> a GROUP BY g.r),
sums AS (SELECT r, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN n_spans IS NULL THEN b ELSE unhex(coalesce(x, '')) END) AS kept_sha256
FROM docs LEFT JOIN sums ON sums.r = docs.r LEFT JOIN kept ON kept.r = docs.r""",
    "op10_decontam": r"""
WITH bench AS MATERIALIZED (SELECT *, least(13, len(tok)) AS w, CAST(least(13, len(tok)) - ceil(0.8 * least(13, len(tok)) - 1e-9) AS BIGINT) AS t FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS tok FROM benchmark WHERE item_id IS NOT NULL) WHERE len(tok) >= 5),
docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS tok FROM documents),
sizes AS (SELECT DISTINCT w // (t + 1) AS g FROM bench),
items AS (SELECT item_id, g, j, list_aggregate(tok[j + 1:j + g], 'string_agg', ' ') AS gram FROM (SELECT item_id, tok, w // (t + 1) AS g, unnest(range(0, len(tok) - w // (t + 1) + 1)) AS j FROM bench)),
grams AS (SELECT r, g, p, list_aggregate(tok[p + 1:p + g], 'string_agg', ' ') AS gram FROM (SELECT r, tok, g, unnest(range(0, len(tok) - g + 1)) AS p FROM docs, sizes WHERE len(tok) >= g)),
diagonals AS MATERIALIZED (SELECT DISTINCT r, item_id, p - j AS d FROM grams JOIN items USING (g, gram)),
flags AS (SELECT c.r, c.item_id, d, w, t, greatest(0, -d) AS lo, list_transform(range(greatest(0, -d), least(len(b.tok), len(x.tok) - d)), lambda j: CASE WHEN x.tok[j + d + 1] = b.tok[j + 1] THEN 1 ELSE 0 END) AS m FROM diagonals c JOIN bench b ON b.item_id = c.item_id JOIN docs x ON x.r = c.r),
windows AS (SELECT *, list_filter(range(0, len(m) - w + 1), lambda q: list_sum(m[q + 1:q + w]) >= w - t) AS qs FROM flags WHERE len(m) >= w),
found AS (SELECT r, item_id, d, len(list_distinct(flatten(list_transform(qs, lambda q: range(q, q + w))))) AS matched, list_min(qs) + lo + d AS first, list_max(qs) + w - 1 + lo + d AS last, w - list_max(list_transform(qs, lambda q: list_sum(m[q + 1:q + w]))) AS subs FROM windows WHERE len(qs) > 0)
SELECT doc_id, item_id, matched::INTEGER AS matched_tokens, first::INTEGER AS first_token, last::INTEGER AS last_token, subs::INTEGER AS substitutions FROM (SELECT *, row_number() OVER (PARTITION BY r, item_id ORDER BY matched DESC, d) AS rn FROM found) JOIN docs USING (r) WHERE rn = 1""",
    "op2_mixing": f"""
WITH base AS (SELECT doc_id, {_DOMAIN} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n_tokens, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) AS own FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM base GROUP BY domain, lang, source HAVING sum(n_tokens) > 0),
root AS (SELECT CAST(coalesce(sum(tokens), 0) AS BIGINT) * 6 // 10 AS budget FROM leaves),{_fill_sql("one", "root", 1)},{_fill_sql("two", "one", 2)},{_fill_sql("three", "two", 3)},
plan AS (SELECT domain, lang, source, budget AS leaf_budget, budget // tokens AS whole, budget % tokens AS rest FROM three),
keyed AS (SELECT b.*, leaf_budget, whole, rest, md5('7:' || CAST(whole AS VARCHAR) || ':' || own) AS k FROM base b JOIN plan USING (domain, lang, source)),
ranked AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k) AS upto FROM keyed),
counted AS (SELECT *, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS n FROM ranked)
SELECT doc_id, domain AS level_domain, lang AS level_lang, source AS level_source, CAST(n_tokens AS BIGINT) AS n_tokens, e AS epoch, CAST(leaf_budget AS BIGINT) AS leaf_budget
FROM counted JOIN (SELECT CAST(0 AS BIGINT) AS e UNION ALL SELECT 1 UNION ALL SELECT 2) ON e < n""",
    "op4_chat": f"""
WITH rows AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () ELSE 0 END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT conv_id, 0, turn, role, text FROM (VALUES (-7, 0, 'user', '{_SAID}'), (-7, 1, 'assistant', '{_SAID}')) t(conv_id, turn, role, text)),
sized AS (SELECT *, {len(chat.OPEN) + 1 + len(chat.CLOSE)} + {_escaped("role")} + length(role) - length(replace(role, chr(10), '')) + {_escaped("text")} AS size, row_number() OVER o AS n, count(*) OVER (PARTITION BY conv_id, alone) AS turns FROM rows
  WINDOW o AS (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text)),
ends AS (SELECT *, sum(size) OVER (PARTITION BY conv_id, alone ORDER BY n) AS upto, role = 'assistant' OR n = turns AS target FROM sized)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256, coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(upto) FILTER (WHERE target)::BIGINT AS formatted_chars, count(*) FILTER (WHERE target) AS n_examples FROM ends GROUP BY conv_id, alone""",
    "op8_lines": """
WITH parts AS MATERIALIZED (SELECT DISTINCT doc_id, CAST(n - 1 AS INTEGER) AS line_no, l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE doc_id IS NOT NULL) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
firsts AS MATERIALIZED (SELECT l, length(l) AS n, doc_id AS d, line_no AS p FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY doc_id, line_no) AS rn FROM parts) WHERE rn = 1),
halves AS (SELECT l, n, d, p, h, left(l, h) AS half, 0 AS side FROM (SELECT *, unnest(list_distinct([n // 2, (n - 1) // 2])) AS h FROM firsts WHERE n >= 20) UNION ALL SELECT l, n, d, p, h, right(l, h), 1 FROM (SELECT *, unnest(list_distinct([n // 2, (n - 1) // 2])) AS h FROM firsts WHERE n >= 20)),
pairs AS MATERIALIZED (SELECT DISTINCT a.l AS x, b.l AS y, a.n AS xn, b.n AS yn, b.d, b.p FROM halves a JOIN halves b ON a.side = b.side AND a.h = b.h AND a.half = b.half WHERE a.l <> b.l AND abs(a.n - b.n) <= 1 AND (b.d < a.d OR b.d = a.d AND b.p < a.p)),
near AS (SELECT x, d, p FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY d, p) AS rn FROM pairs WHERE CASE WHEN xn = yn THEN len(list_filter(range(1, xn + 1), lambda i: substr(x, i, 1) <> substr(y, i, 1))) <= 1
  WHEN xn < yn THEN len(list_filter(range(0, yn), lambda i: left(y, i) || substr(y, i + 2) = x)) > 0 ELSE len(list_filter(range(0, xn), lambda i: left(x, i) || substr(x, i + 2) = y)) > 0 END) WHERE rn = 1)
SELECT o.doc_id, o.line_no, coalesce(k.d, f.d) AS keep_doc_id, coalesce(k.p, f.p) AS keep_line_no, CAST(k.x IS NOT NULL AS INTEGER) AS edits FROM parts o JOIN firsts f ON f.l = o.l LEFT JOIN near k ON k.x = o.l
WHERE o.doc_id > coalesce(k.d, f.d) OR o.doc_id = coalesce(k.d, f.d) AND o.line_no > coalesce(k.p, f.p)""",
    "op9_ann": """
WITH v AS MATERIALIZED (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = (SELECT len(embedding) FROM embeddings WHERE len(embedding) > 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, q.e AS q, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND (q.vec_id <> c.vec_id OR q.e <> c.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, q ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10""",
}
