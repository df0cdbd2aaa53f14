"""Queries on the made-up firms, whose names, addresses and ids have what checks and profiles look for, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import blocking, contract, decision, diagnostics, features, profile, scoring
from skein.plans import catalog, records
from skein.plans.catalog import C, S1, Query
from skein.plans.records import firms, firms_normal, links
from skein.sources import tables

CHANNELS = blocking.V2


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _firms_sql() -> str:
    pick = lambda words, of, by: f"({_list(words)})[({of} // {by}) % {len(words)} + 1]"
    front, stem = pick(records.FRONT, "f", 1), pick(records.STEM, "f", 11)
    return f"""rec AS (SELECT CASE WHEN k % 97 = 0 THEN '' WHEN k % 101 = 0 THEN 'X-' || k WHEN k % 89 = 0 THEN 'S' || (k % 3 + 1) || '-' || (k - 3)
    WHEN k % 103 = 0 THEN 'S1-' || (k - k % 3) ELSE 'S' || (k % 3 + 1) || '-' || k END AS entity_id, k AS doc_id, CAST(k % 3 + 1 AS INT) AS src,
    concat_ws(' ', {front}, {stem}, {pick(records.FORM, "k", 1)}) AS business_name,
    (f % 997 + 1) || {pick(records.ORDINAL, "f", 1)} || ' ' || {pick(records.STREET, "f", 2)} || ' ' || {pick(records.KIND, "k", 2)} || ', ' || (10000 + f % 90000) AS business_address,
    {pick(records.COUNTRY, "f", 3)} AS country, md5(concat_ws('|', {front}, {stem}, f)) AS digest
  FROM (SELECT c_custkey AS k, c_custkey // 4 AS f FROM customer))"""


_TAIL = catalog.BASE[catalog.BASE.index("n1 AS") : catalog.BASE.index("truth AS")]
_TRUTH = f"""truth AS (SELECT o.owner AS {S1}, r.entity_id AS {C} FROM rec r
  JOIN (SELECT digest, arg_min(entity_id, doc_id) AS owner FROM rec WHERE src = 1 GROUP BY digest) o ON r.digest = o.digest WHERE r.src <> 1)"""
BASE = _firms_sql() + ",\n" + _TAIL + _TRUTH
_CANDS = catalog._cands(CHANNELS)
_IDS = f"s1 AS (SELECT DISTINCT entity_id AS {S1} FROM rec WHERE src = 1)"
_PER = f"""per AS (SELECT s1.{S1}, coalesce(n_true, 0) AS n_true, coalesce(n_found, 0) AS n_found, coalesce(n_both, 0) AS n_both FROM s1 LEFT JOIN (
  SELECT {S1}, count(t) AS n_true, count(f) AS n_found, count(t + f) AS n_both FROM (SELECT DISTINCT *, 1 AS t FROM truth) x
  FULL JOIN (SELECT DISTINCT {S1}, {C}, 1 AS f FROM cands) y USING ({S1}, {C}) GROUP BY {S1}) USING ({S1}))"""


def sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([BASE, *ctes]) + "\n" + body


def _ids(s: SparkSession, d: str) -> DataFrame:
    return firms(s, d).where("src = 1").select(F.col("entity_id").alias(S1)).distinct()


def _cands(s: SparkSession, d: str) -> DataFrame:
    return blocking.retrieve(firms_normal(s, d), CHANNELS)


def _truth(s: SparkSession, d: str) -> DataFrame:
    return links(firms(s, d))


def _sources(s: SparkSession, d: str) -> DataFrame:
    own = firms(s, d)
    return reduce(DataFrame.unionByName, [contract.source(own.where(f"src = {i}"), f"S{i}-").withColumn("source", F.lit(f"S{i}")) for i in (1, 2, 3)])


def _faulty_truth(s: SparkSession, d: str) -> DataFrame:
    """The truth as lists, with planted faults: an id twice in a list, an unknown one, an unknown record and an empty list."""
    rows = _truth(s, d).where(f"{S1} <> '' and {C} <> ''").groupBy(S1).agg(F.array_join(F.array_sort(F.collect_list(C)), ",").alias("matched_entity_ids"))
    more = s.createDataFrame([("S1-none", "S2-1,S2-1, S3-0"), ("", "S9-1"), ("S1-3", "")], f"{S1} string, matched_entity_ids string")
    return rows.unionByName(more)


def _round_trip(s: SparkSession, d: str) -> DataFrame:
    """The firms written as tab-separated text and read back."""
    place = tables.scratch(s.range(1)).inputFiles()[0].rpartition("/")[0] + "-tsv"
    tables.write_tsv(firms(s, d).select(*tables.RECORD), place)
    return tables.read_tsv(s, place)


def _missing(s: SparkSession, d: str) -> DataFrame:
    low = blocking.retrieve(firms_normal(s, d), [blocking.Channel("exact_name", ("country_norm", "name_legal"), 3)])
    own = firms(s, d).groupBy("entity_id").agg(*[F.min_by(c, "doc_id").alias(c) for c in ("business_name", "business_address", "country")])
    return diagnostics.missing_enriched(blocking.missing_pairs(low, _truth(s, d)).distinct(), own)


def _split(s: SparkSession, d: str) -> DataFrame:
    return scoring.split(firms(s, d).where("src = 1 and entity_id <> ''").select("entity_id"))


def _true_names(s: SparkSession, d: str) -> DataFrame:
    own = firms(s, d).groupBy("entity_id").agg(F.min_by("business_name", "doc_id").alias("n"))
    side = lambda k, n: own.select(F.col("entity_id").alias(k), F.col("n").alias(n))
    return _truth(s, d).distinct().join(side(S1, "l_business_name"), S1).join(side(C, "r_business_name"), C)


_SPLIT = "own AS (SELECT entity_id, row_number() OVER (ORDER BY md5('42:' || entity_id), entity_id) <= floor(0.2::DOUBLE * count(*) OVER ()) AS validation FROM (SELECT DISTINCT entity_id FROM rec WHERE src = 1 AND entity_id <> ''))"
_FIRST = "firsts AS (SELECT entity_id, arg_min(business_name, doc_id) AS business_name, arg_min(business_address, doc_id) AS business_address, arg_min(country, doc_id) AS country FROM rec GROUP BY 1)"
_LOW = catalog._channel_cte(blocking.Channel("exact_name", ("country_norm", "name_legal"), 3), 0)
_GONE = f"""gone AS (SELECT DISTINCT t.{S1}, t.{C} FROM truth t ANTI JOIN c0 USING ({S1}, {C})),
rich AS (SELECT g.*, a.business_name, a.business_address, a.country, b.business_name AS business_name_r, b.business_address AS business_address_r, b.country AS country_r
  FROM gone g LEFT JOIN firsts a ON a.entity_id = g.{S1} LEFT JOIN firsts b ON b.entity_id = g.{C})"""
_SIMPLE = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
_CLASS = "CASE WHEN n = 0 THEN '0' WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 10 THEN '6-10' WHEN n <= 25 THEN '11-25' WHEN n <= 50 THEN '26-50' WHEN n <= 100 THEN '51-100' WHEN n <= 500 THEN '101-500' WHEN n <= 1000 THEN '501-1000' ELSE '1000+' END"
_BLANK = "({0} IS NULL OR trim({0}) = '' OR lower({0}) IN ('nan', 'none'))"


def _source_sql() -> str:
    parts = []
    ok = f"NOT {_BLANK.format('entity_id')}"
    for i in (1, 2, 3):
        missing = ", ".join(f"count_if({_BLANK.format(c)}) AS missing_{c}" for c in tables.RECORD)
        parts.append(
            f"SELECT *, missing_entity_id + duplicate_ids + wrong_prefix > 0 AS failed, 'S{i}' AS source FROM (SELECT count(*) AS rows, {missing}, count(*) - count(DISTINCT ({', '.join(tables.RECORD)})) AS duplicate_rows, "
            f"count_if({ok}) - count(DISTINCT CASE WHEN {ok} THEN entity_id END) AS duplicate_ids, count_if({ok} AND NOT starts_with(entity_id, 'S{i}-')) AS wrong_prefix FROM rec WHERE src = {i})"
        )
    return sql(" UNION ALL ".join(parts))


def _separation_sql() -> str:
    both = lambda a, b: f"(SELECT count(*) FROM (SELECT entity_id FROM rec WHERE src = {a} INTERSECT SELECT entity_id FROM rec WHERE src = {b})) AS s{a}_s{b}_overlap"
    return sql(f"SELECT {both(1, 2)}, {both(1, 3)}, {both(2, 3)}")


def _check_truth_sql() -> str:
    ok = f"NOT {_BLANK.format(S1)}"
    return sql(
        f"""SELECT *, missing_ids + duplicate_ids + unknown_ids + duplicate_references_in_row + invalid_references > 0 AS failed FROM (
  SELECT count_if(NOT ok) AS missing_ids, count_if(ok) - count(DISTINCT CASE WHEN ok THEN {S1} END) AS duplicate_ids,
    count_if(ok AND {S1} NOT IN (SELECT entity_id FROM rec WHERE src = 1)) AS unknown_ids, count_if(len(ids) = 0) AS empty_rows, count_if(len(ids) > 0) AS filled_rows,
    count_if(len(ids) <> len(list_distinct(ids))) AS duplicate_references_in_row FROM cut),
  (SELECT count_if(starts_with(id, 'S2-')) AS s2_references, count_if(starts_with(id, 'S3-')) AS s3_references,
    count_if(NOT (id IN (SELECT entity_id FROM rec WHERE src <> 1) AND regexp_matches(id, '^S[23]-'))) AS invalid_references FROM (SELECT unnest(ids) AS id FROM cut))""",
        f"""gt AS (SELECT {S1}, string_agg({C}, ',' ORDER BY {C}) AS m FROM truth WHERE {S1} <> '' AND {C} <> '' GROUP BY 1
  UNION ALL VALUES ('S1-none', 'S2-1,S2-1, S3-0'), ('', 'S9-1'), ('S1-3', '')),
cut AS (SELECT *, {ok} AS ok, list_filter(list_transform(string_split(m, ','), lambda x: trim(x)), lambda x: x <> '') AS ids FROM gt)""",
    )


def _tfidf_sql() -> str:
    pieces = "list_transform(range(1, greatest(2, length(w) + 1)), lambda i: substr(' ' || w || ' ', i, 3))"
    across = "SELECT entity_id, src, country_norm, substr(' ' || name_punct || ' ', CAST(i AS INT), 3) AS gram FROM (SELECT *, unnest(range(1, length(name_punct) + 1)) AS i FROM norm WHERE name_punct <> '')"
    return catalog.sql(
        f"SELECT * FROM (SELECT a.entity_id AS {S1}, b.entity_id AS {C}, round(sum(a.w * b.w), 6) AS cosine FROM pool p JOIN weight a ON a.entity_id = p.{S1} JOIN weight b ON b.entity_id = p.{C} AND a.gram = b.gram GROUP BY 1, 2) WHERE cosine >= 0.25",
        f"across AS MATERIALIZED ({across})",
        f"pool AS (SELECT DISTINCT a.entity_id AS {S1}, b.entity_id AS {C} FROM across a JOIN across b USING (country_norm, gram) JOIN (SELECT country_norm, gram FROM across WHERE src <> 1 GROUP BY ALL HAVING count(*) <= 100) r USING (country_norm, gram) WHERE a.src = 1 AND b.src <> 1)",
        f"""tf AS (SELECT entity_id, src, country_norm, gram, count(*) AS tf FROM (SELECT entity_id, src, country_norm, unnest({pieces}) AS gram FROM (SELECT entity_id, src, country_norm, unnest(string_split(name_punct, ' ')) AS w FROM norm) WHERE w <> '') GROUP BY ALL),
idf AS (SELECT country_norm, gram, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT country_norm, gram, count(*)::DOUBLE AS df FROM tf WHERE src <> 1 GROUP BY ALL HAVING count(*) BETWEEN 2 AND 1000)
  JOIN (SELECT country_norm, count(*)::DOUBLE AS n FROM norm WHERE src <> 1 GROUP BY 1) USING (country_norm)),
raw AS (SELECT entity_id, gram, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (country_norm, gram)),
weight AS MATERIALIZED (SELECT entity_id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY entity_id)) AS w FROM raw)""",
    )


def _registry() -> dict[str, tuple[Query, str | None]]:
    q: dict[str, tuple[Query, str | None]] = {}
    views = [*catalog._VIEWS, "phonetic", "address_punct"]
    q["normalise_firms"] = (lambda s, d: firms_normal(s, d).select("doc_id", *views), sql(f"SELECT doc_id, {', '.join(views)} FROM norm"))
    q["tokens_firms"] = (
        lambda s, d: firms_normal(s, d).select(F.explode("name_tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")),
        sql("SELECT token, count(*) AS n FROM (SELECT unnest(name_tokens) AS token FROM norm) GROUP BY 1"),
    )
    q["address_tokens_firms"] = (
        lambda s, d: firms_normal(s, d).select(F.explode("address_tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")),
        sql("SELECT token, count(*) AS n FROM (SELECT unnest(address_tokens) AS token FROM norm) GROUP BY 1"),
    )
    q["simple_names"] = (lambda s, d: firms(s, d).select("doc_id", profile.simple(F.col("business_name")).alias("name")), sql(f"SELECT doc_id, {_SIMPLE.format('business_name')} AS name FROM rec"))
    for c, patterns, name in (("business_name", profile.NAME_PATTERNS, "profile_names_firms"), ("business_address", profile.ADDRESS_PATTERNS, "profile_addresses_firms")):
        counts = ", ".join(f"count_if(regexp_matches({c}, '{p}')) AS {k}" for k, p in patterns.items())
        q[name] = (lambda s, d, c=c, p=patterns: profile.patterns(firms(s, d), c, p), sql(f"SELECT {counts} FROM rec"))
    cols = ("entity_id", "business_name", "country")
    q["profile_missing_firms"] = (
        lambda s, d: profile.missing(firms(s, d), *cols),
        sql("SELECT " + ", ".join(f"count_if({c} IS NULL) AS {c}_null, count_if({c} = '') AS {c}_empty, count_if({c} <> '' AND trim({c}) = '') AS {c}_blank" for c in cols) + " FROM rec"),
    )
    q["profile_capitals_firms"] = (lambda s, d: profile.capitals(firms(s, d)), catalog.REGISTRY["profile_capitals"][1].replace(catalog.BASE, BASE))
    q["check_sources_firms"] = (_sources, _source_sql())
    q["check_separation_firms"] = (lambda s, d: contract.separation(*[firms(s, d).where(f"src = {i}") for i in (1, 2, 3)]), _separation_sql())
    q["check_truth_firms"] = (lambda s, d: contract.truth(_faulty_truth(s, d), firms(s, d).where("src = 1"), firms(s, d).where("src <> 1")), _check_truth_sql())
    q["retrieve_firms"] = (
        lambda s, d: _cands(s, d).withColumn("channels", F.array_join("channels", "|")),
        sql(f"SELECT {S1}, {C}, array_to_string(channels, '|') AS channels, num_channels FROM cands", _CANDS),
    )
    q["truth_firms"] = (lambda s, d: _truth(s, d), sql("SELECT * FROM truth"))
    q["recall_over_all_firms"] = (
        lambda s, d: diagnostics.recall_over_all(_ids(s, d), _truth(s, d), _cands(s, d)),
        sql("SELECT count(*) AS records, round(sum(n_both)::DOUBLE / sum(n_true), 6) AS pair_recall, round(avg(CAST(n_both = n_true AS INT)), 6) AS entity_recall, round(avg(CAST(n_true = 0 OR n_both > 0 AS INT)), 6) AS any_recall FROM per", _CANDS, _IDS, _PER),
    )
    q["links_by_source_firms"] = (
        lambda s, d: diagnostics.links_by_source(_truth(s, d), _cands(s, d)),
        sql(f"SELECT split_part({C}, '-', 1) AS source, count(*) AS links, count(h) AS found FROM (SELECT DISTINCT * FROM truth) LEFT JOIN (SELECT {S1}, {C}, 1 AS h FROM cands) USING ({S1}, {C}) GROUP BY 1", _CANDS),
    )
    q["size_shares_firms"] = (
        lambda s, d: diagnostics.size_shares(_cands(s, d), _ids(s, d)),
        sql(f"SELECT candidates, count(*) AS records, round(count(*)::DOUBLE / (SELECT count(*) FROM s1), 6) AS share FROM (SELECT {_CLASS} AS candidates FROM (SELECT s1.{S1}, count(c.{C}) AS n FROM s1 LEFT JOIN cands c USING ({S1}) GROUP BY 1)) GROUP BY 1", _CANDS, _IDS),
    )
    q["bottleneck_firms"] = (
        lambda s, d: diagnostics.bottleneck(decision.decomposed(_ids(s, d), _truth(s, d), _cands(s, d), _cands(s, d).where("num_channels >= 2"))),
        sql(f"SELECT retrieval, model, CASE WHEN retrieval > model THEN 'RETRIEVAL' ELSE 'MODELING' END AS bottleneck FROM (SELECT count_if(n_held < n_true AND NOT (n_true = n_both AND n_found = n_both)) AS retrieval, count_if(n_held >= n_true AND NOT (n_true = n_both AND n_found = n_both)) AS model FROM strict)", _CANDS, _IDS, _PER,
            f"strict AS (SELECT per.{S1}, n_true, per.n_both AS n_held, (SELECT count(*) FROM cands c WHERE c.{S1} = per.{S1} AND num_channels >= 2) AS n_found, (SELECT count(*) FROM cands c JOIN (SELECT DISTINCT * FROM truth) t USING ({S1}, {C}) WHERE c.{S1} = per.{S1} AND num_channels >= 2) AS n_both FROM per)"),
    )
    q["macro_lone_firms"] = (
        lambda s, d: decision.macro(decision.outcome(_ids(s, d), _truth(s, d), _cands(s, d)), lone=1.0),
        sql(catalog._macro("per").replace("n_found = 0 THEN 0 ELSE", "n_found = 0 THEN 1 ELSE").replace("n_true = 0 THEN 0 ELSE", "n_true = 0 THEN 1 ELSE"), _CANDS, _IDS, _PER),
    )
    rich = (S1, C, "business_name", "business_address", "country", "business_name_r", "business_address_r", "country_r")
    q["missing_pairs_firms"] = (_missing, sql(f"SELECT {', '.join(rich)} FROM rich", _LOW, _FIRST, _GONE))
    q["missing_by_country_firms"] = (
        lambda s, d: diagnostics.missing_by_country(_missing(s, d)),
        sql(f"SELECT country, count(*) AS pairs, string_agg(p, ',' ORDER BY p) FILTER (pos <= 3) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY p) AS pos FROM (SELECT coalesce(country, '') AS country, {S1} || '>' || {C} AS p FROM rich)) GROUP BY 1", _LOW, _FIRST, _GONE),
    )
    q["match_distribution_firms"] = (
        lambda s, d: diagnostics.match_distribution(_ids(s, d), _truth(s, d)),
        sql(f"SELECT CASE WHEN a + b = 0 THEN 'zero' WHEN a + b = 1 THEN 'single' ELSE 'multiple' END AS matches, CASE WHEN a > 0 AND b > 0 THEN 'both' WHEN a > 0 THEN 'S2' WHEN b > 0 THEN 'S3' ELSE 'none' END AS sources, count(*) AS records FROM (SELECT s1.{S1}, coalesce(count_if(starts_with({C}, 'S2-')), 0) AS a, coalesce(count_if(starts_with({C}, 'S3-')), 0) AS b FROM s1 LEFT JOIN (SELECT DISTINCT * FROM truth) USING ({S1}) GROUP BY 1) GROUP BY 1, 2", _IDS),
    )
    q["rate_by_country_firms"] = (
        lambda s, d: diagnostics.rate_by_country(firms(s, d).where("src = 1"), _truth(s, d)),
        sql(f"SELECT country, count(*) AS records, count_if(entity_id IN (SELECT {S1} FROM truth)) AS matched, round(count_if(entity_id IN (SELECT {S1} FROM truth))::DOUBLE / count(*), 6) AS rate FROM rec WHERE src = 1 GROUP BY 1"),
    )
    q["shared_names_firms"] = (
        lambda s, d: diagnostics.shared_names(firms(s, d), 2),
        sql(f"SELECT name, count(*) AS rows, count(DISTINCT src) AS sources FROM (SELECT {_SIMPLE.format('business_name')} AS name, src FROM rec) WHERE name <> '' GROUP BY 1 HAVING count(*) > 2"),
    )
    q["new_countries_firms"] = (
        lambda s, d: profile.new_values(firms(s, d), firms(s, d).where("doc_id % 21 < 9")),
        sql("SELECT DISTINCT country FROM rec EXCEPT SELECT country FROM rec WHERE doc_id % 21 < 9"),
    )
    q["country_pivot_firms"] = (
        lambda s, d: diagnostics.country_pivot({"train": firms(s, d).where("src = 1"), "test": firms(s, d).where("src = 3 and country <> 'fr'")}),
        sql("SELECT country, count_if(src = 1) AS train, count_if(src = 3 AND country <> 'fr') AS test FROM rec WHERE src = 1 OR (src = 3 AND country <> 'fr') GROUP BY 1"),
    )
    words = lambda c: f"list_filter(string_split({_SIMPLE.format(c)}, ' '), lambda x: x <> '')"
    q["difficulty_firms"] = (
        lambda s, d: profile.difficulty(_true_names(s, d)),
        sql(f"SELECT CASE WHEN o > 0.8::DOUBLE THEN 'easy' WHEN o >= 0.3::DOUBLE THEN 'medium' ELSE 'hard' END AS difficulty, count(*) AS pairs, round(avg(o), 6) AS mean_overlap FROM (SELECT len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) AS o FROM (SELECT {words('a.business_name')} AS x, {words('b.business_name')} AS y FROM (SELECT DISTINCT * FROM truth) t JOIN firsts a ON a.entity_id = t.{S1} JOIN firsts b ON b.entity_id = t.{C})) GROUP BY 1", _FIRST),
    )
    q["split_firms"] = (_split, sql("SELECT entity_id, validation FROM own", _SPLIT))
    q["split_manifest_firms"] = (
        lambda s, d: diagnostics.partition(_truth(s, d), _split(s, d))[2],
        sql(f"SELECT validation, count(*) AS records, CAST(sum((SELECT count(*) FROM truth t WHERE t.{S1} = own.entity_id)) AS BIGINT) AS pairs FROM own GROUP BY 1", _SPLIT),
    )
    q["split_validation_firms"] = (
        lambda s, d: diagnostics.partition(_truth(s, d), _split(s, d))[1],
        sql(f"SELECT {S1}, {C} FROM truth WHERE {S1} IN (SELECT entity_id FROM own WHERE validation)", _SPLIT),
    )
    q["only_ids_firms"] = (
        lambda s, d: diagnostics.only(firms(s, d), _split(s, d).where("validation")).select("doc_id", "entity_id"),
        sql("SELECT doc_id, entity_id FROM rec WHERE entity_id IN (SELECT entity_id FROM own WHERE validation)", _SPLIT),
    )
    q["sample_firms"] = (
        lambda s, d: scoring.sample(firms(s, d).select("entity_id").distinct(), 50),
        sql("SELECT entity_id FROM (SELECT DISTINCT entity_id FROM rec) ORDER BY md5('42:' || entity_id), entity_id LIMIT 50"),
    )
    q["head_firms"] = (lambda s, d: tables.head(firms(s, d).select("doc_id", "business_name"), 20, "doc_id"), sql("SELECT doc_id, business_name FROM rec ORDER BY doc_id LIMIT 20"))
    q["tsv_round_trip"] = (_round_trip, sql(f"SELECT {', '.join(tables.RECORD)} FROM rec"))
    q["repeated_addresses_firms"] = (lambda s, d: profile.repeated(firms_normal(s, d), "address_norm"), sql("SELECT address_norm, count(*) AS rows FROM norm WHERE address_norm <> '' GROUP BY 1 HAVING count(*) >= 2"))
    feats = [c for c in features.CHEAP if c in ("exact_name_match", "exact_legal_match", "sorted_name_match", "addr_nums_match", "addr_shared_tokens", "name_shared_tokens", "retrieved_by_addr", "retrieved_by_token", "retrieved_by_postal")]
    unique = "norm AS (SELECT * FROM norm_all WHERE entity_id <> '' QUALIFY count(*) OVER (PARTITION BY entity_id) = 1)"
    q["features_firms"] = (
        lambda s, d: (lambda n: features.cheap(features.with_records(blocking.retrieve(n, CHANNELS), n)).select(S1, C, *feats))(_unique(firms_normal(s, d))),
        sql(f"SELECT {S1}, {C}, {', '.join(feats)} FROM scored", _CANDS, catalog._SETS).replace("\nnorm AS (", "\nnorm_all AS (").replace("truth AS (", f"{unique},\ntruth AS (", 1),
    )
    q["tfidf_pairs"] = (lambda s, d: scoring.tfidf_pairs(catalog.normal(s, d)), _tfidf_sql())
    return q


def _unique(n: DataFrame) -> DataFrame:
    return n.where("entity_id <> ''").join(n.groupBy("entity_id").agg(F.count("*").alias("k")).where("k = 1").select("entity_id"), "entity_id", "left_semi")


REPORTS = _registry()
