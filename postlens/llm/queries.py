"""The queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm import bpe, decontaminate, fingerprints, html_layout, quality, quotes, repair, secrets, sharding, simhash, spelling, token_files, urls
from postlens.session import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query("op1_byte_bpe")
def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bpe.encode(docs, ranks, pattern, bytes_col="decoded").select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(
    "op2_quality_cascade",
    r"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
                 [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
    runs AS (SELECT rid, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 8),
    twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, list_slice(ws, i, i + 7)) AS n FROM runs),
    gaps AS (SELECT rid, least(8, i - lag(i, 1, -8) OVER (PARTITION BY rid ORDER BY i)) AS g FROM twice WHERE n > 1),
    rep AS (SELECT rid, sum(g) AS r FROM gaps GROUP BY rid),
    one AS (SELECT rid, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
    two AS (SELECT rid, x, x = lag(x) OVER (PARTITION BY rid ORDER BY i) AS same FROM one),
    by_word AS (SELECT rid, count(*) FILTER (WHERE regexp_matches(x, '\p{L}')) AS letters, count(*) FILTER (WHERE same) AS stutter
                FROM two GROUP BY rid),
    m AS (SELECT w.rid, doc_id, t, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars,
                 len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                 (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words,
                 coalesce(letters, 0) AS letters, coalesce(stutter, 0) AS stutter, len(string_split(t, chr(10))) AS n_lines
          FROM w LEFT JOIN rep USING (rid) LEFT JOIN by_word USING (rid)),
    b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 10 * n_words
                OR 2 * n_dup_lines > n_lines OR 10 * letters < 6 * n_words OR 10 * stutter > 3 * n_words) AS kept
    FROM b
    """,
)
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    df = quality.quality_metrics(table(spark, folder, "documents").select("doc_id", "text"))
    return df.select("doc_id", *quality.METRICS, "base_failed", F.col("failed_rule").isNull().alias("kept"))


#: Places of the matches of a pattern in DuckDB: rows of (rid, start, end, value) from the gaps between matches.
PLACES = r"""
    {name}_m AS (SELECT rid, regexp_extract_all(t, $p${pattern}$p$) AS ms, regexp_extract_all(t, $p${pattern}$p$, {group}) AS vs,
                        regexp_split_to_array(t, $p${pattern}$p$) AS gs FROM d WHERE regexp_matches(t, $p${pattern}$p$)),
    {name}_u AS (SELECT rid, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM {name}_m),
    {name} AS (SELECT rid, v, (sum(len(g) + len(m)) OVER w - len(m))::BIGINT AS s, (sum(len(g) + len(m)) OVER w)::BIGINT AS e
               FROM {name}_u WINDOW w AS (PARTITION BY rid ORDER BY i))"""


def plain(pattern: str) -> str:
    """The pattern without its look-behind, which only saves steps."""
    return re.sub(r"^\(\?<!.*?\)", "", pattern)


SECRETS_SQL = f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    last AS (SELECT max(doc_id) AS id FROM (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL ORDER BY 1 LIMIT {secrets.SAMPLE_DOCS})),
    cut AS (SELECT regexp_replace(regexp_replace(regexp_replace(text, $p${secrets.ASSIGN}$p$, ' ', 'g'), $p${secrets.ACCESS}$p$, ' ', 'g'),
                                  $p${plain(secrets.HEX)}$p$, ' ', 'g') AS t FROM documents, last WHERE doc_id <= id),
    words AS (SELECT unnest(regexp_extract_all(t, $p${plain(secrets.WORD)}$p$)) AS w FROM cut),
    parts AS (SELECT w, d, rtrim(translate(to_base64(unhex(d)), '+/=', '-_')) AS key, translate(d, 'abcdef', '012345') AS n,
                     concat_ws('-', substr(d, 1, 8), substr(d, 9, 4), substr(d, 13, 4), substr(d, 17, 4), substr(d, 21, 12)) AS uuid
              FROM (SELECT w, sha256(w) AS d FROM words)),
    labelled AS (SELECT unnest([w, upper(w), w || '_' || w || '-' || w, {secrets.REPEATS}[('0x' || substr(d, 1, 8))::BIGINT % {len(secrets.REPEATS)} + 1].repeat(20),
                                concat_ws('-', substr(n, 1, 4), substr(n, 5, 2), substr(n, 7, 2)) || '_' || concat_ws('-', substr(n, 9, 2), substr(n, 11, 2), substr(n, 13, 2)) || '_' || w,
                                w || '/' || w, uuid, upper(uuid)]) AS value, 0 AS r FROM parts
                 UNION ALL
                 SELECT unnest([to_base64(unhex(d)), d, key, substr(key, 1, 20) || '-' || substr(key, 21, 23), substr(key, 24, 20) || '_' || substr(key, 1, 20)]), 1 FROM parts),
    pairs AS (SELECT r, substr(value, i::INT, 1) AS a, substr(value, i::INT + 1, 1) AS b
              FROM (SELECT r, value, unnest(generate_series(1, len(value) - 1)) AS i FROM labelled)),
    counts AS (SELECT r, a, b, count(*) AS n FROM pairs GROUP BY ALL),
    sums AS (SELECT r, a, sum(n) AS n FROM counts GROUP BY ALL),
    letters AS (SELECT unnest(string_split('{secrets.ALPHABET}', '')) AS c),
    grid AS (SELECT x.c AS a, y.c AS b FROM letters x, letters y),
    ratios AS (SELECT g.a, g.b, round(100 * log2(((coalesce(c1.n, 0) + 1) * (coalesce(s0.n, 0) + {len(secrets.ALPHABET)}))::DOUBLE
                      / ((coalesce(s1.n, 0) + {len(secrets.ALPHABET)}) * (coalesce(c0.n, 0) + 1))::DOUBLE))::BIGINT AS llr
               FROM grid g LEFT JOIN counts c1 ON c1.r = 1 AND c1.a = g.a AND c1.b = g.b LEFT JOIN counts c0 ON c0.r = 0 AND c0.a = g.a AND c0.b = g.b
               LEFT JOIN sums s1 ON s1.r = 1 AND s1.a = g.a LEFT JOIN sums s0 ON s0.r = 0 AND s0.a = g.a),
    {PLACES.format(name="assign", pattern=secrets.ASSIGN, group=2)},
    {PLACES.format(name="access", pattern=secrets.ACCESS, group=0)},
    {PLACES.format(name="hexes", pattern=plain(secrets.HEX), group=0)},
    {PLACES.format(name="runs", pattern=plain(secrets.CANDIDATE), group=0)},
    base AS (SELECT rid, 0 AS k, s, e FROM assign WHERE len(v) >= 8 UNION ALL SELECT rid, 1, s, e FROM access UNION ALL SELECT rid, 2, s, e FROM hexes),
    met AS (SELECT r.rid, r.s, r.e, r.v, b.s AS till, b.e AS past, b.k FROM runs r JOIN base b ON b.rid = r.rid AND b.s < r.e AND r.s < b.e),
    outside AS (SELECT rid, v, s, coalesce(max(past) OVER (PARTITION BY rid, s ORDER BY till, k, past ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s) AS a, till AS z FROM met
                UNION ALL SELECT rid, any_value(v), s, max(past), any_value(e) FROM met GROUP BY rid, s
                UNION ALL SELECT rid, v, s, s, e FROM runs r WHERE NOT EXISTS (SELECT 1 FROM met WHERE met.rid = r.rid AND met.s = r.s)),
    pieces AS (SELECT rid, a AS s, z AS e, substr(v, (a - s + 1)::INT, (z - a)::INT) AS v FROM outside WHERE z - a >= {secrets.SHORTEST}),
    steps AS (SELECT rid, s, e, substr(v, i::INT, 1) AS a, substr(v, i::INT + 1, 1) AS b
              FROM (SELECT *, unnest(generate_series(1, len(v) - 1)) AS i FROM pieces)),
    spans AS (SELECT * FROM base UNION ALL SELECT rid, 3, s, e FROM steps JOIN ratios USING (a, b) GROUP BY ALL HAVING sum(llr) >= {secrets.THRESHOLD}),
    named AS (SELECT *, ['assign', 'access', 'hex', 'random'][k + 1] || ':' || s || ':' || e AS one FROM spans),
    by_doc AS (SELECT rid, count(*) FILTER (WHERE k = 0) AS n0, count(*) FILTER (WHERE k = 1) AS n1, count(*) FILTER (WHERE k = 2) AS n2,
                      string_agg(one, ',' ORDER BY s, k) FILTER (WHERE k < 3) AS base, string_agg(one, ',' ORDER BY s, k) AS spans
               FROM named GROUP BY rid)
    SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN by_doc USING (rid)
"""


@query("op3_markov_secrets", SECRETS_SQL)
def markov_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = secrets.train(secrets.labelled_sample(docs, separators=True))
    found = secrets.find_secrets(docs, model, parts=True).drop("text")
    spans = F.col("secret_spans")
    of_kind = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        of_kind(0).alias("n_assign"),
        of_kind(1).alias("n_access"),
        of_kind(2).alias("n_hex"),
        F.sha2(secrets.spans_text(F.filter(spans, lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        secrets.spans_text(spans).alias("spans"),
    )


@query("op5_simhash_balls")
def simhash_balls(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


DECONTAMINATE_SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{word}') AS ws FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{word}') AS ws FROM benchmark),
    grams AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(list_slice(ws, i, i + 9), ' ') AS gram
              FROM (SELECT *, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i FROM b WHERE len(ws) > 0)),
    sizes AS (SELECT DISTINCT n FROM grams),
    runs AS (SELECT rid, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS gram
           FROM (SELECT rid, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d, sizes WHERE len(ws) >= n)),
    hits AS (SELECT rid, i, a.n, item_id FROM runs a JOIN grams USING (gram)),
    places AS (SELECT DISTINCT rid, unnest(generate_series(i, i + n - 1)) AS p FROM hits),
    words AS (SELECT rid, count(*) AS n_hit FROM places GROUP BY rid),
    items AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM hits) GROUP BY rid)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
""".format(upper=decontaminate.UPPER, lower=decontaminate.LOWER, word=r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@query("op9_ngram_decontamination", DECONTAMINATE_SQL)
def ngram_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    names = F.sort_array(F.transform("items", lambda item: item.cast("string")))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op8_token_files")
def token_file_rows(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_dir(spark, "tokens")
    token_files.write_token_files(table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), special=True)
    rows = token_files.read_token_files(spark, path)
    rows = rows.select("doc_id", "place", "n_tokens", token_files.crc32_of_ids(F.col("ids")).alias("ids_crc32"))
    found = token_files.with_starts(spark, path, rows)
    return found.select("doc_id", F.col("start").cast("long").alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")


@query("op10_two_pass_shuffle")
def two_pass_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    shards, seed, path = 16, 42, scratch_dir(spark, "shards")
    schema = sharding.write_shards(table(spark, folder, "documents"), path, shards, seed)
    rows = sharding.read_shards(spark, path, schema)
    return rows.select(
        "doc_id",
        sharding.text_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        sharding.shard_of(F.col("doc_id"), shards + 1, seed).cast("int").alias("grown_shard"),
    )


@query("op4_html_layout")
def html_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = html_layout.extract_text(table(spark, folder, "pages"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


def replies(conversations: DataFrame) -> DataFrame:
    """Each turn as a mail that quotes the turn before it, and that one's quote of the turn before."""
    turns = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    before = turns.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    earlier = lambda k: before.select(F.col("conv_id").alias(f"c{k}"), (F.col("turn") + k).alias(f"t{k}"), F.regexp_replace("text", "(?m)^", "> " * k).alias(f"q{k}"))
    at = lambda k: (F.col("conv_id") == F.col(f"c{k}")) & (F.col("turn") == F.col(f"t{k}"))
    mails = turns.join(earlier(1), at(1), "left").join(earlier(2), at(2), "left")
    return mails.select("conv_id", "turn", "role", F.concat_ws("\n", "q2", "q1", "text").alias("text"))


@query("op6_quotation_links")
def quotation_links(spark: SparkSession, folder: str) -> DataFrame:
    return quotes.link_quotes(replies(table(spark, folder, "conversations")))


@query(
    "op7_dated_url_lists",
    r"""
    WITH captures AS (SELECT page_id, url, (DATE '2023-01-01' + CAST(page_id * 37 % 900 AS INT))::DATE AS fetched,
                             regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.|\.$', '', 'g') AS host,
                             row_number() OVER () AS rid FROM pages),
    parts AS (SELECT rid, page_id, url, fetched, host, string_split(host, '.') AS p FROM captures WHERE host <> ''),
    keys AS (SELECT DISTINCT rid, fetched, unnest(list_distinct(list_append([array_to_string(p[len(p) - n + 1:], '.')
                    FOR n IN generate_series(2, len(p))], host))) AS key FROM parts),
    names AS (SELECT DISTINCT key AS entry, ('0x' || substr(md5(key), 1, 4))::INT AS h FROM keys),
    events AS (SELECT entry, CASE WHEN h % 2 = 0 THEN 'ads' ELSE 'spam' END AS list, k % 2 = 0 AS listed,
                      (DATE '2023-01-01' + CAST((h % 211) + k * (60 + h % 97) AS INT))::DATE AS day
               FROM names, unnest([0, 1, 2, 3, 4]) AS u(k) WHERE h % 3 <> 0),
    ordered AS (SELECT *, lead(day) OVER (PARTITION BY entry, list ORDER BY day) AS until FROM events),
    hits AS (SELECT DISTINCT rid, list || ':' || entry AS x FROM keys JOIN ordered ON entry = key AND listed AND day <= fetched AND (until IS NULL OR fetched < until)),
    by_page AS (SELECT rid, string_agg(x, ',' ORDER BY x) AS active FROM hits GROUP BY rid)
    SELECT page_id, fetched, host, coalesce(active, '') AS active, active IS NOT NULL AS blocked FROM captures LEFT JOIN by_page USING (rid)
    """,
)
def dated_url_lists(spark: SparkSession, folder: str) -> DataFrame:
    day = lambda n: F.date_add(F.lit("2023-01-01").cast("date"), n.cast("int"))
    captures = table(spark, folder, "pages").select("page_id", "url", day(F.col("page_id") * 37 % 900).alias("fetched"))
    names = captures.select(F.explode(urls.keys_of(urls.host_of(F.col("url")), 2)).alias("entry")).distinct()
    h = F.conv(F.substring(F.md5("entry"), 1, 4), 16, 10).cast("int")
    dated = names.withColumn("h", h).where("h % 3 <> 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    entries = dated.select(
        "entry",
        F.when(F.col("h") % 2 == 0, "ads").otherwise("spam").alias("list"),
        (F.col("k") % 2 == 0).alias("listed"),
        day(F.col("h") % 211 + F.col("k") * (60 + F.col("h") % 97)).alias("day"),
    )
    judged = urls.judge(captures, entries)
    return judged.select("page_id", "fetched", "host", F.array_join("active", ",").alias("active"), "blocked")


@query("op11_one_permutation_minhash")
def one_permutation_minhash(spark: SparkSession, folder: str) -> DataFrame:
    found = fingerprints.against_edits(table(spark, folder, "documents"))
    hexed = {c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")}
    return found.withColumns(hexed).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query("op12_spelling_variants")
def spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    words = spelling.count_words(table(spark, folder, "documents"), r"[A-Za-z\u00C0-\u00FF]+", damage=97, least_chars=5, least=3)
    return spelling.variant_forms(words).select("word", "form", "root", "n", "n_near", "form_n")


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns of which some are dropped, emptied, without full stops, repeated, or the user's, by a hash of their place."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(one("text"), "[.!?]", "")).otherwise(one("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(one("role"))
    times = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    made = conversations.withColumn("kind", kind).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.array_repeat(F.lit(0), times).alias("copies"))
    return made.select("conv_id", "turn", "role", "text", F.explode("copies")).drop("col")


@query("op13_conversation_repair")
def conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    whole, repaired = repair.repair(damaged(conversations))
    every = conversations.select(F.col("conv_id").alias("id")).distinct()
    same = lambda df: F.col("id").eqNullSafe(df["conv_id"])
    hashes = repair.digests(repaired)
    found = every.join(whole, same(whole), "left").drop("conv_id")
    found = found.join(hashes, same(hashes), "left").drop("conv_id")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
