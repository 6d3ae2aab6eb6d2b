"""The registered queries of this subpackage, with DuckDB SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.llm import content_sort, divergence, langid, mixing, packing, randomness, redirects, repetition, simhash, simple8b, substrings, surrogates, trie
from visitloom.llm.common import table
from visitloom.session import fresh_path, materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# A user passes a secret of their own; the query only has to be repeatable.
SURROGATE_KEY = "a key for the registered query"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


@query(
    "op4_content_sort",
    """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return content_sort.content_groups(docs, keep="max", carry=["doc_id"])


@query(
    "op8_systematic_mix",
    r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
per AS (
  SELECT source, cast(sum(size) AS bigint) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
           WHEN 0 THEN 5.0::double WHEN 1 THEN 2.0::double ELSE 1.0::double END AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, source_size * 2.0::double AS cap,
         (sum(source_size) OVER () * 1.5::double
          - coalesce(sum(source_size * 2.0::double) OVER (
              ORDER BY source_size * 2.0::double / weight, source NULLS LAST
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (
              ORDER BY source_size * 2.0::double / weight, source NULLS LAST
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM per),
targets AS (
  SELECT source, source_size,
         CASE WHEN cap <= weight * level THEN cap
              ELSE weight * (SELECT max(level) FROM levels WHERE cap > weight * level) END AS target
  FROM levels),
steps AS (
  SELECT doc_id, s.source, size, source_size, target,
         CASE WHEN source_size > 0
              THEN cast(floor(target / source_size * 1000000000.0::double) AS bigint) ELSE 0 END AS units,
         cast(concat('0x', substr(md5('mix:' || coalesce(s.source, '')), 1, 7)) AS bigint)
           * 1000000000 // 268435456 AS off
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
sums AS (
  SELECT *, off + sum(units) OVER (PARTITION BY source ORDER BY size, doc_id
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM steps)
SELECT doc_id, size, source_size, target,
       cast((upto // 1000000000 - (upto - units) // 1000000000) * size AS bigint) AS taken
FROM sums
""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    done = mixing.mix(docs, mixing.n_words(F.col("text")), carry=["doc_id"])
    return done.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


@query("op7_pigeonring")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, shingle=3, distance=2, carry=["doc_id"])


@query("op1_suffix_repeats")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repetition.judged(docs, carry=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "covered_words", "longest_repeat",
    )


@query("op3_best_fit_pack")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(docs, path, spaced=False, end_id=1, capacity=4096, carry=["doc_id"])


@query("op10_simple8b")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = fresh_path(spark, "ids")
    path = public_tokenizers.path("byte_bpe_50k.json")
    simple8b.write(docs, folder, path, spaced=True, end_id=0)
    return simple8b.documents(spark, folder)


# The rules that the query applies, as given.
URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

_ADDRESS = r"""CASE WHEN contains({u}, '://') THEN
    regexp_replace(regexp_replace(translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ':(80|443)$', ''), '\.$', '')
    || regexp_replace(regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '/+$', '')
    || CASE WHEN len(list_filter(string_split(regexp_extract({u}, '(?s)^[^#]*?\?([^#]*)', 1), '&'),
                                 lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|gclid|fbclid)(=|$)'))) > 0
       THEN '?' || array_to_string(list_filter(string_split(regexp_extract({u}, '(?s)^[^#]*?\?([^#]*)', 1), '&'),
                                 lambda p: NOT regexp_matches(p, '^(utm_[^=]*|gclid|fbclid)(=|$)')), '&') ELSE '' END END"""


@query(
    "op2_redirect_rules",
    r"""
WITH RECURSIVE targets AS (
  SELECT page_id, url, CASE WHEN starts_with(t, '//') THEN 'http:' || t
    WHEN starts_with(t, '/') THEN 'http://' || regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) || t ELSE t END AS target
  FROM (SELECT page_id, url, replace(regexp_extract(unnest(regexp_extract_all(
          html, '(?is)<(?:link|meta)\b[^>]*\b(?:canonical|refresh)\b[^>]*>')),
          '(?is)\b(?:href|url)\s*=\s*["'']?([^"''>\s]+)', 1), '&amp;', '&') AS t FROM pages)),
urls AS (
  SELECT page_id, url FROM pages
  UNION ALL SELECT NULL, target FROM targets WHERE contains(target, '://')),
parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         ADDRESS_OF_URL AS address
  FROM urls),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parts),
edges AS (
  SELECT ADDRESS_OF_URL AS a, ADDRESS_OF_TARGET AS b FROM targets WHERE contains(target, '://')
  UNION SELECT ADDRESS_OF_TARGET, ADDRESS_OF_URL FROM targets WHERE contains(target, '://')),
blocked AS (
  SELECT address FROM ruled WHERE rule IN ('example.com/en/', 'net/es/', 'net/fr/') AND address IS NOT NULL
  UNION
  SELECT e.b FROM blocked k JOIN edges e ON e.a = k.address WHERE e.b IS NOT NULL)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN address IN (SELECT address FROM blocked) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled WHERE page_id IS NOT NULL
""".replace("ADDRESS_OF_URL", _ADDRESS.replace("{u}", "url")).replace(
        "ADDRESS_OF_TARGET", _ADDRESS.replace("{u}", "target")
    ),
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return redirects.judged(pages, URL_RULES, carry=["page_id"]).drop("by")


@query("op5_randomness_tests")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = randomness.secrets(docs, carry=["doc_id"])

    def count(kind: int):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("found", lambda s: s["kind"] < randomness.KINDS.index("random"))
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{kind}") for i, kind in enumerate(randomness.KINDS)],
        F.sha2(randomness.listed(base), 256).alias("base_sha256"),
        randomness.listed(F.col("found")).alias("spans"),
    )


@query("op6_family_then_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(langid.learnable()).select("lang", "text"))
    found = langid.identify(docs, model, carry=["doc_id"])
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query("op9_surrogates")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = surrogates.replaced(docs, SURROGATE_KEY, carry=["doc_id"])
    shown = F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["surrogate"]))
    return done.select(
        "doc_id", "text", F.size("entities").cast("long").alias("n_entities"), F.array_join(shown, ",").alias("surrogates")
    )


@query("op12_repeated_strings")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = substrings.without_repeats(docs, length=200, carry=["doc_id"])
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select(
        "doc_id", "n_bytes", size.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256"
    )


@query(
    "op13_source_divergence",
    r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
  FROM documents),
occurs AS (
  SELECT doc, lang, source,
         translate(unnest(found), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM docs),
per_doc AS (SELECT doc, lang, source, term, count(*) AS n FROM occurs GROUP BY ALL),
kept AS (
  SELECT lang, term, sum(n) AS lang_n FROM per_doc GROUP BY lang, term HAVING count(*) >= 30),
cells AS (
  SELECT lang, source, term, sum(n) AS n FROM per_doc SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
per_lang AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM kept GROUP BY lang),
per_group AS (SELECT lang, source, sum(n) AS total FROM cells GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         cast(1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * l.v) AS bigint) AS p,
         cast(1 + (1000000000::hugeint * (k.lang_n + 5)) // (l.total + 5 * l.v) AS bigint) AS q
  FROM groups g JOIN kept k USING (lang) JOIN per_lang l USING (lang)
  LEFT JOIN per_group t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, cast(coalesce(x.value, 0) AS bigint) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, cast(p - q AS bigint) AS value
  FROM dense WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value,
       cast(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS int) AS rank
FROM pairs
UNION ALL
SELECT * FROM (
  SELECT lang, source, part, item, value,
         cast(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS int) AS rank
  FROM terms)
WHERE rank <= 50
""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


@query(
    "op11_prefix_trie",
    r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id
           ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS n
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  -- CRC-32 of the decimal id, bit by bit
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce(
           list_prepend(4294967295, flatten(list_transform(string_split(cast(conv_id AS varchar), ''),
             lambda c: list_transform(range(8), lambda b: (ascii(c) >> b) & 1)))),
           lambda crc, bit: xor(crc >> 1, 3988292384 * (xor(crc, bit) & 1))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, t.n, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.n < c.h
  UNION ALL
  SELECT c.conv_id, t.n, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.n >= c.h),
prefixes AS (
  SELECT conv_id, row_number() OVER own AS depth,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         sha256(array_to_string(list(sha256(len(role) || ':' || role || text)) OVER own, ',')) AS node
  FROM rebuilt WINDOW own AS (PARTITION BY conv_id ORDER BY n)),
members AS (
  SELECT conv_id, depth, words, node,
         coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), '') AS parent,
         depth = max(depth) OVER (PARTITION BY conv_id) AS ends
  FROM prefixes
  UNION ALL
  SELECT conv_id, 0, 0, '', NULL, conv_id NOT IN (SELECT conv_id FROM prefixes) FROM convs),
nodes AS (
  SELECT node, min(parent) AS parent, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * max(words) AS saved,
         sha256(coalesce(string_agg(cast(conv_id AS varchar), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY node),
children AS (SELECT parent, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
subtrees AS (
  SELECT m.node, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum(u.saved) AS saved_tokens
  FROM nodes u JOIN members m ON m.conv_id = u.conv_id AND m.depth <= u.depth
  LEFT JOIN children c ON c.parent = u.node
  GROUP BY m.node)
SELECT v.conv_id, cast(v.depth AS bigint) AS depth, p.conv_id AS parent_conv_id, v.n_convs,
       coalesce(c.n, 0) AS n_children, cast(s.n_leaves AS bigint) AS n_leaves,
       cast(s.saved_tokens AS bigint) AS saved_tokens, v.ends_sha256
FROM nodes v JOIN subtrees s USING (node)
LEFT JOIN children c ON c.parent = v.node
LEFT JOIN nodes p ON p.node = v.parent
""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = materialize(trie.numbered_turns(table(spark, sf_dir, "conversations")), "turns")
    return trie.prefix_trie(rebuilt(turns))


def rebuilt(turns: DataFrame) -> DataFrame:
    """The conversations that the query's contract asks for, of ``trie.numbered_turns``.

    The first h turns of the conversation whose id is the next lower multiple of 20,
    then the own turns after the first h, with h from the checksum of the id.
    """
    borrowed = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("n", "turn"))), lambda t: t["turn"])
    heads = (
        turns.where("conv_id % 20 = 0 AND n < 3")
        .groupBy(F.col("conv_id").alias("base")).agg(in_order.alias("head"))
    )
    own = turns.withColumn("n", F.when(F.col("n") >= borrowed, F.col("n")))
    kept = F.filter(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("n", "turn"))), lambda t: t.isNotNull())
    own = own.groupBy("conv_id").agg(F.transform(F.array_sort(kept), lambda t: t["turn"]).alias("tail"))
    nothing = F.array().cast(trie.TURNS)
    return own.withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).join(heads, "base", "left").select(
        "conv_id",
        F.concat(F.slice(F.coalesce("head", nothing), 1, borrowed.cast("int")), F.coalesce("tail", nothing)).alias("turns"),
    )
