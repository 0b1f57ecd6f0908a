"""One query per operator over its whole table, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopflow.llm import best_fit, embedding_join, host_reputation, jaccard_join, katz, language_mixture, merkle, permuterm, pfair_mix, quality_attention, quality_rules, records, run_index
from stopflow.llm.frames import fold_of, table
from stopflow.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql.strip()
        return fn

    return add


@_query()
def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; the model learns from folds 1 to 4."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold_of() == 0)
    model = language_mixture.fit(docs.where("NOT held_out"))
    return language_mixture.predict(docs, model, keep=("doc_id", "held_out"))


@_query()
def op2_embedding_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.link(table(spark, sf_dir, "embeddings"))


@_query()
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents"))


def bad_pages(labels: DataFrame) -> DataFrame:
    """Outcomes of pages: the labels of their ids; low quality or toxic is bad."""
    return labels.select(F.col("doc_id").alias("page_id"), F.when(F.col("quality").isNull() & F.col("toxic").isNull(), None).otherwise(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))


_SUFFIXES = ", ".join(f"'{s}'" for s in host_reputation.SUFFIXES)
_FIT = """SELECT CASE WHEN rho <= 1 / 1001.0::double THEN 1000.0::double WHEN rho >= 0.5 THEN 1.0::double ELSE (1 - rho) / rho END FROM (
    SELECT coalesce(CASE WHEN sum((n - 1) * m * (1 - m)) > 0 THEN (sum(n * (bad::double / n - m) * (bad::double / n - m)) - sum(m * (1 - m))) / sum((n - 1) * m * (1 - m)) ELSE 0.0 END, 0.0) AS rho FROM {} WHERE n > 0)"""


@_query(f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
l AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END)::double AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
x AS (SELECT DISTINCT host, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS labels FROM p),
y AS (SELECT *, CASE WHEN array_to_string(list_slice(labels, -2, -1), '.') IN ({_SUFFIXES}) THEN 2 ELSE 1 END AS k FROM x),
h AS (SELECT host, array_to_string(list_slice(labels, -1 - k, -1), '.') AS domain, array_to_string(list_slice(labels, -k, -1), '.') AS suffix, sum(coalesce(n, 0))::double AS n, sum(coalesce(bad, 0)) AS bad
      FROM p JOIN y USING (host) LEFT JOIN l ON l.doc_id = p.page_id GROUP BY ALL),
top AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS m FROM h),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(m) AS m FROM h, top GROUP BY suffix),
s AS (SELECT suffix, (m * w + bad) / (w + n) AS m FROM s0, ({_FIT.format("s0")}) f(w)),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, any_value(m) AS m FROM h JOIN s USING (suffix) GROUP BY domain, suffix),
d AS (SELECT domain, (m * w + bad) / (w + n) AS m FROM d0, ({_FIT.format("d0")}) f(w)),
h0 AS (SELECT host, n, bad, m FROM h JOIN d USING (domain)),
r AS (SELECT host, m * w + bad AS a, (1 - m) * w + n - bad AS b FROM h0, ({_FIT.format("h0")}) f(w)),
v AS (SELECT host, CASE WHEN a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM r),
q AS (SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' ELSE verdict END AS verdict FROM q JOIN v USING (host)
""")
def op4_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_reputation.judge(table(spark, sf_dir, "pages"), bad_pages(table(spark, sf_dir, "labels")))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@_query()
def op5_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return pfair_mix.mix(docs)


@_query()
def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"))


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in quality_rules.STOP_WORDS)


@_query(f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, i, words[i:i + 4] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(5, coalesce(next - i, 5)))::bigint AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM twice) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::bigint AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint AS word_chars,
      len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint AS n_symbols, (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines, len(lines) AS n_lines, coalesce(rep.n, 0)::bigint AS n_repeat_words,
      len(list_filter(words, lambda x: x IN ({_STOP}))) AS n_stop FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words >= 2 AND word_chars / n_words <= 15 AND n_symbols / n_words <= 0.2 AND n_stop / n_words >= 0.02 AND n_dup_lines / n_lines <= 0.3 AS kept FROM b
""")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *[F.col(f"_q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept")


@_query()
def op8_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; the model learns from folds 1 to 4."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold_of() == 0)
    model = quality_attention.fit(docs.where("NOT held_out"), table(spark, sf_dir, "labels").where(fold_of() != 0))
    return quality_attention.score(docs, model, keep=["doc_id", "held_out"])


@_query()
def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = records.write(table(spark, sf_dir, "documents"), scratch_path(spark, "records"))
    return records.read(manifest, keep_ids=False)


@_query()
def op10_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents").withColumn("held_out", fold_of() == 1))


# CRC-32 of the text {}: bit by bit over its UTF-8 bytes, given as hexadecimal digits
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(1, (length(hex(encode({0}))) // 2 + 1)::bigint), lambda i: [
    (instr('0123456789ABCDEF', substr(hex(encode({0})), 2 * i - 1, 1)) * 16 + instr('0123456789ABCDEF', substr(hex(encode({0})), 2 * i, 1)) - 17)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"""


@_query(f"""
WITH RECURSIVE r AS MATERIALIZED (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
u AS MATERIALIZED (SELECT run, coalesce(doc_id::varchar, '') || ':' || run AS s, count(*) AS c FROM r GROUP BY ALL),
h AS MATERIALIZED (SELECT run, c, {_CRC.format("s")} AS h FROM u),
w AS MATERIALIZED (SELECT word, sum(c)::bigint AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run) + 2)::bigint) ELSE run END AS word, c FROM h) WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT a.word, b.word AS other, b.n FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
    UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.less = w.word UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.less = w.word),
b AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, encode(other)) AS other, max(n) AS other_n FROM near GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::bigint AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n FROM w LEFT JOIN b USING (word)),
t AS (SELECT word, coalesce(form, word) AS root, form IS NULL AS ended FROM f UNION ALL SELECT t.word, coalesce(f.form, t.root), f.form IS NULL FROM t JOIN f ON f.word = t.root WHERE NOT t.ended)
SELECT f.word, n, n_near, form, form_n, root FROM f JOIN t USING (word) WHERE ended
""")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, the near words of each, and the form they vary."""
    return permuterm.group(permuterm.vocabulary(table(spark, sf_dir, "documents")))


@_query("""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, i, coalesce(doc_id, -1)::hugeint * 4294967296 + i AS pos, md5(substr(x, 2 * i + 1, 200)) AS k FROM (SELECT *, unnest(range(0, length(x) // 2 - 99)) AS i FROM t)),
m AS (SELECT r, i FROM (SELECT r, i, pos, min(pos) OVER (PARTITION BY k) AS least FROM w) WHERE pos > least),
g AS (SELECT r, i, sum(CASE WHEN i > coalesce(prev, -101) + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS prev FROM m)),
s AS (SELECT r, min(i) AS s, max(i) + 100 AS e FROM g GROUP BY r, g),
p AS (SELECT r, s, e, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY s) AS prev FROM s),
k AS (SELECT r, sum(e - s) AS removed, count(*) AS spans, string_agg(substr(x, 2 * prev + 1, 2 * (s - prev)), '' ORDER BY s) || substr(any_value(x), 2 * max(e) + 1) AS kept FROM p JOIN t USING (r) GROUP BY r)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(removed, 0)::bigint AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM t LEFT JOIN k USING (r)
""")
def op12_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without long strings that start earlier."""
    left = run_index.remove(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def _merkle_sql(levels: int = 5, fanout: int = 16) -> str:
    """Trees of at most `fanout` ** `levels` leaves, one CTE a level."""
    value = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::varchar) || ':' || {c}::varchar END"
    kept = " || ".join(value(c) for c in merkle.COLUMNS)
    changed = f"CASE WHEN doc_id IS NOT NULL AND {_CRC.format('doc_id::varchar')} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
    after = " || ".join(value(c) if c != "text" else value("changed") for c in merkle.COLUMNS)
    ctes = [f"""docs AS MATERIALIZED (SELECT doc_id, source, sha256({kept}) AS leaf, sha256({after}) AS given FROM (SELECT *, {changed} AS changed FROM documents))""",
            "l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM docs)"]

    def tree(name: str, leaves: str) -> None:
        ctes.append(f"{name}0 AS MATERIALIZED ({leaves})")
        for k in range(1, levels + 1):
            # a tree of one node goes up unchanged and has no siblings
            ctes.append(f"""{name}{k} AS MATERIALIZED (SELECT tree, rank // {fanout} AS rank, CASE WHEN any_value(size) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY rank)) END AS d, (any_value(size) + {fanout - 1}) // {fanout} AS size,
                CASE WHEN any_value(size) > 1 THEN list(d ORDER BY rank) ELSE [] END AS family FROM {name}{k - 1} GROUP BY tree, rank // {fanout})""")

    tree("n", "SELECT coalesce('s' || source, '') AS tree, rank, leaf AS d, count(*) OVER (PARTITION BY source) AS size FROM l")
    ctes.append(f"s AS MATERIALIZED (SELECT tree AS source, d AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS rank FROM n{levels})")
    tree("m", "SELECT 0 AS tree, rank, subroot AS d, count(*) OVER () AS size FROM s")
    joins = "".join(f" JOIN n{k} AS a{k} ON a{k}.tree = s.source AND a{k}.rank = l.rank // {fanout ** k}" for k in range(1, levels + 1))
    joins += "".join(f" JOIN m{k} AS b{k} ON b{k}.rank = s.rank // {fanout ** k}" for k in range(1, levels + 1))
    ways = [(f"a{k}", "l.rank", k) for k in range(1, levels + 1)] + [(f"b{k}", "s.rank", k) for k in range(1, levels + 1)]
    at = {(a, r, k): f"({r} // {fanout ** (k - 1)} % {fanout})::bigint" for a, r, k in ways}
    text = lambda part: f"coalesce(array_to_string({part}, ''), '')"
    left = {w: text(f"list_slice({w[0]}.family, 1, {at[w]})") for w in ways}
    right = {w: text(f"list_slice({w[0]}.family, {at[w]} + 2, len({w[0]}.family))") for w in ways}
    proof = " || ".join(f"{left[w]} || {right[w]}" for w in ways)
    steps = ", ".join(f"CASE WHEN len({w[0]}.family) > 0 THEN [{left[w]}, {right[w]}] END" for w in ways)
    folded = "list_reduce(list_prepend([given], path), lambda x, p: CASE WHEN p IS NULL THEN x ELSE [sha256(p[1] || x[1] || p[2])] END)[1]"
    return f"""WITH {", ".join(ctes)}, p AS (SELECT l.doc_id, l.source, leaf, given, s.subroot, b{levels}.d AS root, sha256({proof}) AS proof_sha256, [{steps}] AS path FROM l JOIN s ON s.source = coalesce('s' || l.source, ''){joins}),
    q AS (SELECT *, {folded} AS folded_root FROM p) SELECT doc_id, source, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM q"""


@_query(_merkle_sql())
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and check of every document."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline
