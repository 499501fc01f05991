"""Every query of the library by name, with the SQL it is compared with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldsieve.functions import nulls as N, text as X
from fieldsieve.operators import events as E, ingest as I, joins as J, metrics as M, quality as Q, wrangle as W
from fieldsieve.operators.rowid import with_rowid
from fieldsieve.plans.data import META, SIZES, read, survey, survey_sql
from fieldsieve.sources import catalog as C
from fieldsieve.sources.scratch import scratch_dir
from fieldsieve.sources.store import KeyedStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
RULES = [Q.missing_metadata(META), Q.missing_taxonomic_id(), Q.vertebrate_with_invertebrate_count(), Q.invertebrate_with_sizes(SIZES), Q.total_zero(), Q.fish_over(), Q.inverts_over()]
PREDICATES = {
    1: """diver IS NULL OR diver = 'BLANK' OR site_code IS NULL OR site_code = 'BLANK' OR depth IS NULL OR vis IS NULL OR vis = 'BLANK'""",
    2: "taxonomic_id IS NULL",
    3: "inverts > 0 AND phylum = 'Chordata'",
    4: """phylum <> 'Chordata' AND coalesce("2.5", 0) + coalesce("5", 0) + coalesce("7.5", 0) > 0""",
    5: "total = 0",
    6: "phylum = 'Chordata' AND total > 100",
    7: "phylum <> 'Chordata' AND inverts > 20",
}
FLAGS = " UNION ALL ".join(f"SELECT '{r.name}' AS test_name, {r.id} AS test_id, rowid AS row_num FROM survey WHERE {PREDICATES[r.id]}" for r in RULES)


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def keep(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return keep


def _rule(rule: Q.Rule) -> None:
    QUERIES[f"qc_{rule.name}"] = lambda spark, d: Q.rows_flagged(survey(spark, d), rule)
    ORACLE_SQL[f"qc_{rule.name}"] = survey_sql(f"SELECT rowid FROM survey WHERE {PREDICATES[rule.id]}")


for _r in RULES:
    _rule(_r)


@query(survey_sql(FLAGS))
def qc_flag_table(spark, d):
    return Q.flags(survey(spark, d), RULES)


@query(survey_sql(f"SELECT row_num, min(test_id) AS test_id FROM ({FLAGS}) GROUP BY row_num"))
def qc_flag_priority(spark, d):
    return Q.flag_priority(survey(spark, d), RULES)


@query(survey_sql(f"SELECT * FROM ({FLAGS}) WHERE test_name = 'total_zero'"))
def qc_flag_one_rule(spark, d):
    return Q.one_rule(Q.flags(survey(spark, d), RULES), "total_zero")


@query(survey_sql(f"SELECT s.rowid, s.site_code, s.total, f.test_id FROM survey s JOIN (SELECT row_num, min(test_id) AS test_id FROM ({FLAGS}) GROUP BY row_num) f ON f.row_num = s.rowid"))
def qc_flagged_rows(spark, d):
    rows = survey(spark, d)
    return Q.flagged(rows, RULES, flagged_only=True).select("rowid", "site_code", "total", "test_id")


@query(survey_sql(f"SELECT s.rowid, s.phylum, f.test_id FROM survey s LEFT JOIN (SELECT row_num, min(test_id) AS test_id FROM ({FLAGS}) GROUP BY row_num) f ON f.row_num = s.rowid"))
def qc_rows_with_flags(spark, d):
    return Q.flagged(survey(spark, d), RULES).select("rowid", "phylum", "test_id")


@query(survey_sql(f"SELECT s.rowid, s.method, f.test_id FROM survey s LEFT JOIN (SELECT row_num, min(test_id) AS test_id FROM ({FLAGS}) GROUP BY row_num) f ON f.row_num = s.rowid"))
def qc_attach_flags(spark, d):
    """Flags that were made apart from the rows, as a table, joined with them by row number."""
    rows = survey(spark, d)
    return Q.with_flags(rows, Q.first_flag(Q.flags(rows, RULES))).select("rowid", "method", "test_id")


# joins

IDS = "ids AS (SELECT DISTINCT concat('sp', CAST(p_partkey % 37 AS VARCHAR)) AS scientific_name, CAST(p_partkey % 37 AS BIGINT) AS taxonomic_id FROM part), classes AS (SELECT CAST(n_nationkey AS BIGINT) AS taxonomic_id, n_name AS phylum, CAST(n_regionkey AS VARCHAR) AS \"class\" FROM nation)"


def _ids(spark, d):
    key = F.col("p_partkey") % 37
    return read(spark, d, "part").select(F.concat(F.lit("sp"), key.cast("string")).alias("scientific_name"), key.alias("taxonomic_id")).distinct()


def _classes(spark, d):
    return read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("taxonomic_id"), F.col("n_name").alias("phylum"), F.col("n_regionkey").cast("string").alias("class"))


@query(survey_sql(f", {IDS} SELECT s.rowid, s.species, i.taxonomic_id, c.phylum FROM survey s LEFT JOIN ids i ON s.species = i.scientific_name LEFT JOIN classes c ON c.taxonomic_id = i.taxonomic_id").replace(") , ids", "), ids"))
def tax_left_join(spark, d):
    return J.join_taxonomy(survey(spark, d).select("rowid", "species"), _ids(spark, d), _classes(spark, d), "species", ["phylum"])


@query(survey_sql("SELECT s.rowid, s.taxonomic_id AS \"taxonomic_id.x\", k.taxonomic_id AS \"taxonomic_id.y\", s.diver FROM survey s LEFT JOIN (SELECT diver, min(taxonomic_id) AS taxonomic_id FROM survey GROUP BY diver) k ON s.diver IS NOT DISTINCT FROM k.diver"))
def tax_null_safe_join(spark, d):
    rows = survey(spark, d)
    return J.left_join_suffixed(rows.select("rowid", "taxonomic_id", "diver"), rows.groupBy("diver").agg(F.min("taxonomic_id").alias("taxonomic_id")), "diver")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 3 = 0 THEN NULL WHEN l_linenumber = 1 THEN 1 ELSE l_partkey END AS species, l_quantity AS size FROM lineitem), k AS (SELECT p_partkey AS id, p_name, p_size AS size FROM part UNION ALL SELECT NULL, 'unnamed', 0)
SELECT l_orderkey, l_linenumber, species, l.size AS "size.x", p_name, k.size AS "size.y" FROM l LEFT JOIN k ON species IS NOT DISTINCT FROM id""")
def tax_hot_keys_join(spark, d):
    """A third of all rows has no name, many have one; the lookup grows with the data."""
    species = F.when(F.col("l_suppkey") % 3 == 0, None).when(F.col("l_linenumber") == 1, 1).otherwise(F.col("l_partkey"))
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", species.alias("species"), F.col("l_quantity").alias("size"))
    known = read(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", F.col("p_size").alias("size"))
    return J.left_join_split(rows, known.union(spark.range(1).select(F.lit(None).cast("long"), F.lit("unnamed"), F.lit(0))), "species", "id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 5000)")
def tax_semi(spark, d):
    return J.semi_on(read(spark, d, "orders").select("o_orderkey", "o_custkey"), read(spark, d, "customer").where("c_acctbal > 5000"), "o_custkey", "c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 5000)")
def tax_anti(spark, d):
    return J.anti_on(read(spark, d, "orders").select("o_orderkey", "o_custkey"), read(spark, d, "customer").where("c_acctbal > 5000"), "o_custkey", "c_custkey")


@query("SELECT p.n AS name_to_evaluate, r.id AS taxonomic_id, p.s AS scientific_name FROM (SELECT DISTINCT regexp_replace(s, '\\s+spp?\\.$', '') AS n, s FROM (SELECT concat(p_name, CASE p_size % 3 WHEN 0 THEN ' sp.' WHEN 1 THEN ' spp.' ELSE '' END) AS s FROM part)) p LEFT JOIN (SELECT p_name AS name, min(p_partkey) AS id FROM part WHERE p_brand <> 'Brand#5' AND p_partkey > 60 GROUP BY p_name) r ON r.name = p.n")
def tax_right_join(spark, d):
    part = read(spark, d, "part")
    size = F.col("p_size") % 3
    names = part.select(F.concat("p_name", F.when(size == 0, " sp.").when(size == 1, " spp.").otherwise("")).alias("scientific_name"))
    resolver = part.where("p_brand <> 'Brand#5' AND p_partkey > 60").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").cast("string").alias("id"))
    return J.resolve_names(names, resolver.unionByName(part.where("p_partkey <= 60").select(F.concat("p_name", F.lit("?")).alias("name"), F.lit("Not found").alias("id"))))


@query(f"WITH {IDS}, names AS (SELECT DISTINCT concat('sp', CAST(l_partkey % 40 AS VARCHAR)) AS scientific_name FROM lineitem) SELECT i.scientific_name, i.taxonomic_id, c.\"class\" FROM ids i LEFT JOIN classes c ON c.taxonomic_id = i.taxonomic_id WHERE i.scientific_name IN (SELECT scientific_name FROM names)")
def tax_levels(spark, d):
    names = read(spark, d, "lineitem").select(F.concat(F.lit("sp"), (F.col("l_partkey") % 40).cast("string")).alias("scientific_name")).distinct()
    return J.taxonomy_lookup(names, _ids(spark, d), _classes(spark, d), ["class", "order"])


@query(survey_sql(f", {IDS} SELECT count(*) AS n_unmatched FROM (SELECT DISTINCT species FROM survey) s WHERE NOT EXISTS (SELECT 1 FROM ids WHERE ids.scientific_name = s.species)").replace(") , ids", "), ids"))
def tax_unmatched_count(spark, d):
    names = survey(spark, d, False).select(F.col("species").alias("scientific_name"))
    return J.unmatched(names, _ids(spark, d)).agg(F.count("*").alias("n_unmatched"))


@query("SELECT p_partkey, regexp_replace(concat(p_name, CASE p_size % 4 WHEN 0 THEN ' sp.' WHEN 1 THEN ' spp.' WHEN 2 THEN ' spp' ELSE ' spinosa sp.' END), '\\s+spp?\\.$', '') AS name FROM part")
def name_suffix_strip(spark, d):
    size = F.col("p_size") % 4
    name = F.concat("p_name", F.when(size == 0, " sp.").when(size == 1, " spp.").when(size == 2, " spp").otherwise(" spinosa sp."))
    return read(spark, d, "part").select("p_partkey", X.strip_rank_suffix(name).alias("name"))


@query("WITH n AS (SELECT p_partkey, concat(p_name, CASE p_size % 4 WHEN 0 THEN ' sp.' WHEN 1 THEN ' spp.' WHEN 2 THEN ' spp' ELSE ' spinosa sp.' END) AS s FROM part) SELECT p_partkey, CASE WHEN regexp_matches(s, ' sp.$') THEN regexp_replace(s, ' sp.', '', 'g') WHEN regexp_matches(s, ' spp.$') THEN regexp_replace(s, ' spp.', '', 'g') ELSE s END AS name FROM n")
def name_suffix_strip_legacy(spark, d):
    size = F.col("p_size") % 4
    name = F.concat("p_name", F.when(size == 0, " sp.").when(size == 1, " spp.").when(size == 2, " spp").otherwise(" spinosa sp."))
    return read(spark, d, "part").select("p_partkey", X.strip_rank_suffix(name, legacy=True).alias("name"))


@query("""WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 4 = 0 THEN 'BLANK' WHEN event_id % 4 = 1 THEN NULL ELSE event_type END AS vis, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 5 AS VARCHAR) END AS direction FROM events),
c AS (SELECT event_id, user_id, nullif(vis, 'BLANK') AS vis, nullif(direction, 'BLANK') AS direction FROM e),
p AS (SELECT user_id, vis, direction, row_number() OVER (PARTITION BY user_id ORDER BY vis IS NULL, vis, direction IS NULL, direction) AS k FROM (SELECT DISTINCT user_id, vis, direction FROM c))
SELECT c.event_id, c.user_id, coalesce(c.vis, p.vis) AS vis, coalesce(c.direction, p.direction) AS direction FROM c LEFT JOIN p ON p.user_id = c.user_id AND p.k = 1""")
def patch_nulls(spark, d):
    e = read(spark, d, "events")
    vis = F.when(F.col("event_id") % 4 == 0, "BLANK").when(F.col("event_id") % 4 == 1, None).otherwise(F.col("event_type"))
    e = e.select("event_id", "user_id", vis.alias("vis"), F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 5).cast("string")).alias("direction"))
    return J.fill_metadata(e, e, "user_id", ["vis", "direction"])


@query("""WITH e AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN 'BLANK' WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_orderpriority END AS vis, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 5 AS VARCHAR) END AS direction FROM orders),
c AS (SELECT o_orderkey, o_custkey, o_orderstatus, nullif(vis, 'BLANK') AS vis, direction FROM e),
p AS (SELECT o_custkey, vis, direction, row_number() OVER (PARTITION BY o_custkey ORDER BY vis IS NULL, vis, direction IS NULL, direction) AS k FROM (SELECT DISTINCT o_custkey, vis, direction FROM c WHERE o_orderstatus <> 'P'))
SELECT c.o_orderkey, c.o_custkey, coalesce(c.vis, p.vis) AS vis, coalesce(c.direction, p.direction) AS direction FROM c LEFT JOIN p ON p.o_custkey = c.o_custkey AND p.k = 1 WHERE o_orderstatus = 'P'""")
def patch_from_store(spark, d):
    """Open orders take what they lack from the closed ones of the same customer, which are in a store."""
    key = F.col("o_orderkey")
    vis = F.when(key % 4 == 0, "BLANK").when(key % 4 == 1, None).otherwise(F.col("o_orderpriority"))
    rows = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", vis.alias("vis"), F.when(key % 3 != 0, (key % 5).cast("string")).alias("direction"))
    store = KeyedStore(spark, f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}", "o_custkey")
    store.append(rows.where("o_orderstatus <> 'P'"))
    return J.fill_metadata(rows.where("o_orderstatus = 'P'"), store, "o_custkey", ["vis", "direction"]).drop("o_orderstatus")


@query("SELECT o_orderkey, nullif(CASE WHEN o_orderkey % 3 = 0 THEN 'BLANK' ELSE o_orderstatus END, 'BLANK') AS status, o_totalprice FROM orders")
def blank_to_null(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "BLANK").otherwise(F.col("o_orderstatus")).alias("status"), "o_totalprice")
    return N.nullif_blank(o, ["status", "o_totalprice"])


# events

ANY = "CASE WHEN bool_or({0}) THEN true WHEN count(*) FILTER (WHERE ({0}) IS NULL) > 0 THEN NULL ELSE false END AS method_{1}_block_{2}"
ANYS = ", ".join(ANY.format(f"method = {m} AND block = {b}", m, b) for m in (1, 2) for b in (1, 2))
KEY = "concat_ws('_', coalesce(site_code, 'NA'), 'RLS', coalesce(CAST(date AS VARCHAR), 'NA'), coalesce(printf('%.15g', depth), 'NA'))"


@query(survey_sql(f"SELECT {KEY} AS sample_event_id, site_code, date, depth, {ANYS} FROM survey GROUP BY site_code, date, depth"))
def event_summary(spark, d):
    return E.event_summary(survey(spark, d, False))


@query("""SELECT e.o_custkey, e.o_orderstatus, r.c_mktsegment FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders) e LEFT JOIN (SELECT c_custkey AS o_custkey, 'F' AS o_orderstatus, c_mktsegment FROM customer) r ON e.o_custkey = r.o_custkey AND e.o_orderstatus = r.o_orderstatus""")
def event_roster_join(spark, d):
    roster = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit("F").alias("o_orderstatus"), "c_mktsegment")
    return E.roster_check(read(spark, d, "orders"), roster, ["o_custkey", "o_orderstatus"])


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority, n FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders) LEFT JOIN (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY ALL) USING (o_orderstatus, o_orderpriority)")
def event_natural_join(spark, d):
    o = read(spark, d, "orders")
    counts = o.where("o_orderpriority <> '5-LOW'").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return J.natural_left_join(o.select("o_orderkey", "o_orderstatus", "o_orderpriority"), counts)


@query(survey_sql("""SELECT site_code, string_agg(DISTINCT coalesce(diver, 'NA'), ', ' ORDER BY coalesce(diver, 'NA')) AS diver, string_agg(DISTINCT coalesce(vis, 'NA'), ', ' ORDER BY coalesce(vis, 'NA')) AS vis FROM survey GROUP BY site_code"""))
def event_metadata_variants(spark, d):
    return E.metadata_variants(survey(spark, d, False), "site_code", ["diver", "vis"])


@query(survey_sql("""SELECT s.site_code, s.n, v.diver FROM (SELECT site_code, count(*) AS n FROM survey GROUP BY site_code) s LEFT JOIN (SELECT site_code, string_agg(DISTINCT coalesce(diver, 'NA'), ', ' ORDER BY coalesce(diver, 'NA')) AS diver FROM survey WHERE input_filename <> 'f0.xlsx' OR vis <> 'BLANK' GROUP BY site_code) v ON v.site_code = s.site_code"""))
def events_across_files(spark, d):
    rows = survey(spark, d, False)
    current = rows.where("input_filename = 'f0.xlsx' AND vis <> 'BLANK'").select("site_code", "diver")
    return E.events_across_files(rows, current, "f0.xlsx", "site_code", ["diver"], rows.groupBy("site_code").agg(F.count("*").alias("n")))


@query("SELECT n_name, string_agg(c_name, ', ' ORDER BY c_custkey) AS c_name FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def roster_string_agg(spark, d):
    rows = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return E.joined_text(rows, ["n_name"], "c_name", ["c_custkey"])


@query("WITH e AS (SELECT s_name AS diver, s_nationkey AS site, NULL::VARCHAR AS note FROM supplier UNION ALL SELECT c_name, c_nationkey, c_mktsegment FROM customer) SELECT site, string_agg(diver, ', ' ORDER BY diver) AS diver FROM (SELECT DISTINCT diver, site FROM e) GROUP BY site")
def roster_of_divers(spark, d):
    a = read(spark, d, "supplier").select(F.col("s_name").alias("diver"), F.col("s_nationkey").alias("site"))
    b = read(spark, d, "customer").select(F.col("c_nationkey").alias("site"), F.col("c_name").alias("diver"), F.col("c_mktsegment").alias("note"))
    return E.diver_roster([a, b], "site", "diver", ["diver"], [])


@query("SELECT event_id, CAST(event_id AS VARCHAR) AS label, CAST(user_id AS VARCHAR) AS who FROM events")
def cast_all_text(spark, d):
    e = read(spark, d, "events")
    return e.select("event_id").join(N.all_text(e.select(F.col("event_id").alias("label"), F.col("user_id").alias("who"))), F.col("event_id").cast("string") == F.col("label"))


@query("SELECT CAST(p_size AS VARCHAR) AS size_class, count(*) AS n, count(p_name) AS named FROM part GROUP BY 1")
def factor_counts(spark, d):
    """A number cast to a factor, as a plot's colours need it, and the rows of each level."""
    p = read(spark, d, "part")
    return N.all_text(p.select(F.col("p_size").alias("size_class"), "p_name")).groupBy("size_class").agg(F.count("*").alias("n"), F.count("p_name").alias("named"))


ROSTER = "WITH r AS (SELECT concat('S', CAST(o_orderkey AS VARCHAR)) AS s, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS a, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS b, CAST(o_custkey % 30 AS DOUBLE) / 4 AS d, CAST(year(o_orderdate) AS INT) AS y, CAST(o_orderkey % 14 AS INT) AS m, CAST(o_custkey % 33 AS INT) AS k FROM orders), t AS (SELECT s, 'T1' AS transect, a AS initials, d AS depth, y, m, k FROM r WHERE a IS NOT NULL OR b IS NOT NULL UNION ALL SELECT s, 'T2', b, CASE WHEN b IS NOT NULL THEN d + 1 END, CASE WHEN b IS NOT NULL THEN y END, CASE WHEN b IS NOT NULL THEN m END, CASE WHEN b IS NOT NULL THEN k END FROM r WHERE a IS NOT NULL OR b IS NOT NULL), u AS (SELECT s AS site_code, transect, initials, depth, try_cast(CASE WHEN y IS NOT NULL THEN printf('%04d-%02d-%02d', y, m, k) END AS DATE) AS date FROM t) SELECT *, concat_ws('_', site_code, 'RLS', coalesce(CAST(date AS VARCHAR), 'NA'), coalesce(printf('%.15g', depth), 'NA')) AS sample_event_id FROM u"


@query(ROSTER)
def roster_reshape(spark, d):
    has = F.col("o_orderkey") % 4 != 0
    depth, year, month, day = (F.col("o_custkey") % 30).cast("double") / 4, F.year("o_orderdate"), (F.col("o_orderkey") % 14).cast("int"), (F.col("o_custkey") % 33).cast("int")
    one = {"Initials": F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")), "Depth": depth, "Year": year, "Month": month, "Day": day}
    two = {"Initials": F.when(has, F.col("o_orderpriority")), "Depth": F.when(has, depth + 1), "Year": F.when(has, year), "Month": F.when(has, month), "Day": F.when(has, day)}
    wide = read(spark, d, "orders").select(F.concat(F.lit("S"), F.col("o_orderkey").cast("string")).alias("Site Code"), *[c.alias(f"T1 {n}") for n, c in one.items()], *[c.alias(f"T2 {n}") for n, c in two.items()])
    return E.two_transect_roster(wide)


# sets and shapes


@query("SELECT s_suppkey, s_nationkey AS nation, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT NULL, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def union_by_name(spark, d):
    a = read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    b = read(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def names_difference(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("custkey")).subtract(read(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey"))


@query(survey_sql("""SELECT site_code, method, CAST(coalesce(sum(v), 0) AS DOUBLE) AS abundance, count(DISTINCT species) + max(CASE WHEN species IS NULL THEN 1 ELSE 0 END) AS richness FROM (SELECT site_code, method, species, unnest([inverts, "2.5", "5", "7.5"]) AS v FROM survey) GROUP BY site_code, method"""))
def abundance_richness(spark, d):
    rows = survey(spark, d, False)
    rows = rows.withColumns({c: N.qcol(c).cast("double") for c in SIZES})
    return M.abundance_richness(rows, ["site_code", "method"], M.column_range(rows, "inverts", "7.5"), "species")


@query("SELECT conv_id, min(text) FILTER (WHERE role = 'user') AS \"user\", min(text) FILTER (WHERE role = 'assistant') AS assistant, min(text) FILTER (WHERE role = 'system') AS system FROM conversations GROUP BY conv_id")
def pivot_rank(spark, d):
    return M.wider(read(spark, d, "conversations"), ["conv_id"], "role", "text", ["user", "assistant", "system"])


@query("""WITH r AS (SELECT CAST(conv_id AS VARCHAR) AS id, turn, lower(CASE WHEN turn % 4 = 0 THEN 'KINGDOM' WHEN turn % 4 = 1 THEN 'Phylum' WHEN turn % 4 = 2 THEN 'Class' ELSE 'Order' END) AS rank, role AS name FROM conversations), twice AS (SELECT id FROM r GROUP BY id, rank HAVING count(*) > 1), k AS (SELECT * FROM r WHERE id NOT IN (SELECT id FROM twice))
SELECT CAST(id AS BIGINT) AS taxonomic_id, arg_max(rank, turn) AS level, max(name) FILTER (WHERE rank = 'kingdom') AS kingdom, max(name) FILTER (WHERE rank = 'phylum') AS phylum, max(name) FILTER (WHERE rank = 'class') AS "class", max(name) FILTER (WHERE rank = 'order') AS "order" FROM k GROUP BY id""")
def classification_pivot(spark, d):
    turn = F.col("turn") % 4
    rank = F.when(turn == 0, "KINGDOM").when(turn == 1, "Phylum").when(turn == 2, "Class").otherwise("Order")
    rows = read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("id"), F.col("turn").alias("ordinal"), rank.alias("rank"), F.col("role").alias("scientificname"))
    return J.classification(rows, "ordinal", ["kingdom", "phylum", "class", "order"])


@query("SELECT conv_id, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id")
def last_in_group(spark, d):
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"))


@query("SELECT conv_id, role, text FROM (SELECT conv_id, CASE WHEN turn = 0 AND conv_id % 3 = 0 THEN NULL ELSE role END AS role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k = 1")
def first_in_group(spark, d):
    rows = read(spark, d, "conversations").withColumn("role", F.when((F.col("turn") != 0) | (F.col("conv_id") % 3 != 0), F.col("role")))
    return J.first_by(rows, "conv_id", ["role", "text"], F.col("turn"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_keys(spark, d):
    return M.duplicates(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT user_id AS value, min(event_id) AS first_at FROM events GROUP BY user_id")
def distinct_first_seen(spark, d):
    return M.first_seen(read(spark, d, "events"), "user_id", "event_id")


@query("SELECT user_id AS value, min(event_id) AS first_at, (SELECT count(DISTINCT user_id) FROM events) AS n_unique FROM events GROUP BY user_id ORDER BY first_at LIMIT 10")
def top10_values(spark, d):
    return M.first_values(read(spark, d, "events"), "user_id", "event_id")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def count_by_keys(spark, d):
    return M.counts(read(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


PROFILED = {"event_id": "bigint", "kind": "string", "value": "double"}
EVENTS = "WITH e AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS kind, value FROM events)"


def _events(spark, d):
    return read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("kind"), "value")


@query(EVENTS + " UNION ALL ".join(f" SELECT '{c}' AS column_name, '{t}' AS type, count({c}) AS n_values, count(*) - count({c}) AS n_null, count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END AS n_unique FROM e" for c, t in PROFILED.items()))
def column_profile(spark, d):
    return M.column_profile(_events(spark, d))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS greatest, count(*) - count({c}) AS n_null FROM lineitem" for c in ("l_quantity", "l_linenumber", "l_orderkey")))
def column_minmax(spark, d):
    return M.column_minmax(read(spark, d, "lineitem"), ["l_quantity", "l_linenumber", "l_orderkey"])


@query(EVENTS + """ SELECT * FROM (SELECT 'event_id' AS column_name, 'bigint' AS expected_type, 'bigint' AS found_type, 'ok' AS status, 0 AS n_failing UNION ALL SELECT 'value', 'int', 'double', 'type differs', (SELECT count(*) FROM e WHERE value IS NOT NULL AND (try_cast(trunc(value) AS INTEGER) IS NULL OR trunc(value) <> value))
UNION ALL SELECT 'kind', 'double', 'string', 'type differs', (SELECT count(*) FROM e WHERE kind IS NOT NULL AND try_cast(kind AS DOUBLE) IS NULL) UNION ALL SELECT 'depth', 'double', NULL, 'missing', NULL) AS t""")
def schema_conformance(spark, d):
    return M.conformance(_events(spark, d), [("event_id", "bigint"), ("value", "int"), ("kind", "double"), ("depth", "double")])


@query("SELECT o_orderkey, concat_ws('_', coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END, 'NA'), 'RLS', CAST(CAST(o_orderdate AS DATE) AS VARCHAR), coalesce(printf('%.15g', CASE WHEN o_custkey % 9 <> 0 THEN CAST(o_custkey AS DOUBLE) / 8 END), 'NA')) AS sample_event_id FROM orders")
def composite_key(spark, d):
    site, depth = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")), F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey").cast("double") / 8)
    return read(spark, d, "orders").select("o_orderkey", E.event_id(site, F.col("o_orderdate").cast("date"), depth).alias("sample_event_id"))


TRIM = "WITH e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 WHEN event_id > (SELECT max(event_id) FROM events) - 50 THEN 0 ELSE event_id % 3 END AS total FROM events)"


def _totals(spark, d):
    e = read(spark, d, "events").select("event_id")
    last = e.agg(F.max("event_id").alias("last"))
    total = F.when(F.col("event_id") % 7 == 0, 0).when(F.col("event_id") > F.col("last") - 50, 0).otherwise(F.col("event_id") % 3)
    return e.crossJoin(F.broadcast(last)).select("event_id", total.alias("total"))


@query(TRIM + " SELECT event_id, total FROM e WHERE event_id <= (SELECT max(event_id) FROM e WHERE total <> 0)")
def trim_trailing_zeros(spark, d):
    return I.trim_trailing_zeros(_totals(spark, d), "total", "event_id")


@query("WITH m AS (SELECT user_id, event_id, event_type = 'click' AS value, CASE WHEN (event_type = 'click') IS NOT DISTINCT FROM lag(event_type = 'click') OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM m) SELECT user_id, value, min(event_id) AS run_start, max(event_id) AS run_end, count(*) AS run_length FROM r GROUP BY user_id, run, value")
def rle_runs(spark, d):
    return M.runs(read(spark, d, "events"), F.col("event_type") == "click", "event_id", ["user_id"])


@query("SELECT event_id, event_type FROM events WHERE CASE WHEN event_id % 11 = 0 THEN '0, 1, 2' WHEN event_id % 13 = 0 THEN NULL ELSE CAST(event_id % 3 AS VARCHAR) END <> '0, 1, 2'")
def drop_header_rows(spark, d):
    method = F.when(F.col("event_id") % 11 == 0, I.HEADER_MARK).when(F.col("event_id") % 13 != 0, (F.col("event_id") % 3).cast("string"))
    return I.drop_header_rows(read(spark, d, "events").select("event_id", "event_type", method.alias("Method"))).drop("Method")


@query("SELECT event_id, kind FROM (SELECT CASE WHEN event_id % 6 <> 0 THEN event_id END AS event_id, CASE WHEN event_id % 4 <> 0 THEN event_type END AS kind FROM events) WHERE event_id IS NOT NULL OR kind IS NOT NULL")
def drop_empty_rows(spark, d):
    return I.drop_empty_rows(read(spark, d, "events").select(F.when(F.col("event_id") % 6 != 0, F.col("event_id")).alias("event_id"), F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("kind")))


RELATED = """edges AS (
  SELECT r_name AS i, n_name AS o FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION SELECT n_name, concat(n_name, '/', c_mktsegment) FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION SELECT concat(n_name, '/', c_mktsegment), concat(c_mktsegment, '/', o_orderpriority) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  UNION SELECT concat(c_mktsegment, '/', o_orderpriority), c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey
), structure AS (
  SELECT DISTINCT n_name AS t, p_brand AS c FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  UNION SELECT DISTINCT concat(c_mktsegment, '/', o_orderpriority), o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey
)"""


def _catalog(spark, d) -> C.CatalogTables:
    """The driver's tables as a catalog: regions lead to nations, these to their segments, these to priorities, these to segments again."""
    nation, customer, orders = read(spark, d, "nation"), read(spark, d, "customer"), read(spark, d, "orders")
    customers = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    ordered = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    segment, priority = F.concat_ws("/", "n_name", "c_mktsegment"), F.concat_ws("/", "c_mktsegment", "o_orderpriority")
    edge = lambda df, a, b: df.select(a.alias("table_id_in"), b.alias("table_id_out"))
    regions = nation.join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    relations = edge(regions, F.col("r_name"), F.col("n_name")).union(edge(customers, F.col("n_name"), segment)).union(edge(ordered, segment, priority)).union(edge(ordered, priority, F.col("c_mktsegment")))
    lines = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    column = lambda df, t, c: df.select(t.alias("table_id"), F.col(c).alias("column_name"), F.lit("STRING").alias("data_type")).distinct()
    structure = column(lines, F.col("n_name"), "p_brand").union(column(ordered, priority, "o_orderstatus"))
    return C.CatalogTables(nation.select(F.col("n_name").alias("table_id")), relations, structure)


@query(f"""WITH RECURSIVE {RELATED}, walk(i, o, k) AS (SELECT i, o, 1 FROM edges UNION SELECT w.i, e.o, w.k + 1 FROM walk w JOIN edges e ON e.i = w.o WHERE w.k < 10)
SELECT i AS table_id_in, o AS table_id_out, CAST(min(k) AS INTEGER) AS steps, any_value(coalesce(n, 0)) AS n_columns FROM walk LEFT JOIN (SELECT t, count(*) AS n FROM structure GROUP BY t) ON t = o GROUP BY i, o""")
def catalog_resolve(spark, d):
    return _catalog(spark, d).resolved()


@query(f"WITH {RELATED} SELECT DISTINCT t AS table_id, 'not_in_index' AS gap FROM structure WHERE t NOT IN (SELECT n_name FROM nation) UNION ALL SELECT DISTINCT o, 'without_structure' FROM edges WHERE o NOT IN (SELECT t FROM structure)")
def catalog_gaps(spark, d):
    return _catalog(spark, d).gaps()


@query("SELECT split_part(url, '/', 3) AS folder, string_agg(CAST(page_id AS VARCHAR), ', ' ORDER BY page_id) AS page_id FROM pages GROUP BY 1")
def group_files(spark, d):
    return E.joined_text(read(spark, d, "pages").withColumn("folder", F.split("url", "/")[2]), ["folder"], "page_id", ["page_id"])


CELLS = [(1, "o_orderstatus"), (2, "o_orderstatus"), (1, "o_orderpriority")]


def _selected():
    return {1: {"o_orderstatus": "F", "o_orderpriority": "3-MEDIUM"}, 2: {"o_orderstatus": "O", "o_orderpriority": "1-URGENT"}}


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority = '3-MEDIUM'")
def gen_filter(spark, d):
    return read(spark, d, "orders").where(W.cells_filter(_selected(), CELLS)[0]).select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '3-MEDIUM' THEN 'final' WHEN o_orderstatus = 'O' AND o_orderpriority = '3-MEDIUM' THEN '' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def gen_case_when(spark, d):
    return read(spark, d, "orders").select("o_orderkey", W.cells_case_when(_selected(), CELLS, {"F": "final"})[0].alias("o_orderstatus"))


@query("WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS s, o_orderpriority AS p FROM orders) SELECT o_orderkey, CASE WHEN s IS NULL AND p = '5-LOW' THEN 'none' WHEN s = 'P' AND p = '5-LOW' THEN 'low' ELSE s END AS s FROM o")
def gen_x_for_all_y(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("s"), F.col("o_orderpriority").alias("p"))
    return o.select("o_orderkey", W.x_for_all_y(o, "s", ["p"], {(None, "5-LOW"): "none", ("P", "5-LOW"): "low"})[0].alias("s"))


@query("WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS s, o_orderpriority AS p FROM orders) SELECT o_orderkey, CASE WHEN s IS NULL THEN 'none' WHEN s = 'P' THEN 'partial' ELSE s END AS s FROM o")
def gen_x_for_all_combinations(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("s"), F.col("o_orderpriority").alias("p"))
    return o.select("o_orderkey", W.x_for_values(o, "s", ["p"], {None: "none", "P": "partial"})[0].alias("s"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'F' THEN 'final' WHEN o_orderpriority = '3-MEDIUM' THEN '' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def gen_case_when_every_value(spark, d):
    o = read(spark, d, "orders")
    return o.select("o_orderkey", W.cells_case_when(_selected(), [(1, "o_orderstatus"), (1, "o_orderpriority")], {"F": "final"}, every=o)[0].alias("o_orderstatus"))


@query("SELECT o_orderkey AS rowid, o_orderstatus AS water_present, o_orderpriority AS personnel, CAST(o_totalprice AS VARCHAR) IS NULL AS site_name, 'deployment.xlsx' AS input_filename FROM orders")
def ingest_oyster(spark, d):
    sheet = read(spark, d, "orders").select(F.col("o_orderkey").alias("rowid"), F.col("o_orderstatus").alias("Water Present Y N"), F.col("o_orderpriority").alias("Sampling Personnel"), F.col("o_totalprice").isNull().alias("Site Name"))
    return I.load(sheet, "oyster-2025-reef-metadata-deployment", "/data/deployment.xlsx")


@query("SELECT p_partkey AS rowid, p_name AS site_name, CAST(p_size AS DOUBLE) AS chain_length_m, 'rugosity.xlsx' AS input_filename FROM part")
def ingest_rugosity(spark, d):
    sheet = read(spark, d, "part").select(F.col("p_partkey").alias("rowid"), F.col("p_name").alias("Site Name"), F.col("p_size").cast("double").alias("Chain Length m"))
    return I.load(sheet, "oyster-2025-rugosity", "/data/rugosity.xlsx")


@query(survey_sql(f"SELECT rowid, {KEY} AS sample_event_id, site_code FROM survey"))
def transform_by_name(spark, d):
    return I.select_strict(W.apply(survey(spark, d), "event_id"), ["rowid", "sample_event_id", "site_code"])


@query("SELECT p_partkey AS rowid, CASE WHEN p_size % 4 <> 0 THEN p_name END AS transect, CASE WHEN p_size % 8 <> 0 THEN p_size END AS shoot_count, 'seagrass.xlsx' AS input_filename FROM part WHERE p_size % 8 <> 0")
def ingest_seagrass(spark, d):
    size = F.col("p_size")
    sheet = read(spark, d, "part").select(F.col("p_partkey").alias("rowid"), F.col("p_brand").alias("ID"), F.when(size % 4 != 0, F.col("p_name")).alias("Transect ID"), F.when(size % 8 != 0, size).alias("Shoots Count"))
    return I.load(sheet, "shoot-count-monitoring-v1", "seagrass.xlsx")


@query(f"""WITH {IDS}, s AS (SELECT o_orderkey AS rowid, CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE o_totalprice END AS total, CASE WHEN o_custkey % 50 = 1 THEN '0, 1, 2' WHEN o_custkey % 49 <> 0 THEN CAST(o_custkey % 3 AS VARCHAR) END AS method, concat('S', CAST(o_custkey % 9 AS VARCHAR)) AS site_code, o_orderstatus AS photoquadrats, CASE WHEN o_custkey % 7 = 0 THEN 'x' ELSE CAST(o_custkey % 3 AS VARCHAR) END AS block, concat('sp', CAST(o_custkey % 40 AS VARCHAR)) AS species FROM orders)
SELECT s.rowid, total, CAST(method AS DOUBLE) AS method, site_code, photoquadrats, try_cast(block AS DOUBLE) AS block, species, i.taxonomic_id, c.phylum, 'reef.xlsx' AS input_filename FROM s LEFT JOIN ids i ON i.scientific_name = s.species LEFT JOIN classes c ON c.taxonomic_id = i.taxonomic_id
WHERE method <> '0, 1, 2' AND s.rowid <= (SELECT max(rowid) FROM s WHERE total <> 0 AND method <> '0, 1, 2')""")
def ingest_reef(spark, d):
    key = F.col("o_custkey")
    method = F.when(key % 50 == 1, I.HEADER_MARK).when(key % 49 != 0, (key % 3).cast("string"))
    sheet = read(spark, d, "orders").select(
        F.col("o_orderkey").alias("rowid"), F.when(key % 5 == 0, 0).otherwise(F.col("o_totalprice")).alias("Total"), method.alias("Method"), F.concat(F.lit("S"), (key % 9).cast("string")).alias("Site No."), F.col("o_orderstatus").alias("P-Qs"), F.when(key % 7 == 0, "x").otherwise((key % 3).cast("string")).alias("Block"), F.concat(F.lit("sp"), (key % 40).cast("string")).alias("Species")
    )
    return I.load(sheet, "reef-life-survey-data-v1", "/x/reef.xlsx", _ids(spark, d), _classes(spark, d))


SHEET = """SELECT o_orderkey AS rowid, CASE WHEN o_custkey % 5 = 0 THEN 0 WHEN o_orderkey > (SELECT max(o_orderkey) FROM orders) - 300 THEN 0 ELSE o_totalprice END AS total, CASE WHEN o_custkey % 50 = 1 THEN '0, 1, 2' WHEN o_custkey % 49 <> 0 THEN CAST(o_custkey % 3 AS VARCHAR) END AS method FROM orders"""


@query(f"""WITH s AS ({SHEET}), h AS (SELECT * FROM s WHERE method <> '0, 1, 2')
SELECT 'header_rows' AS step, (SELECT count(*) FROM s) - (SELECT count(*) FROM h) AS removed UNION ALL SELECT 'trailing_zeros', (SELECT count(*) FROM h WHERE rowid > (SELECT max(rowid) FROM h WHERE total <> 0))""")
def ingest_removed_rows(spark, d):
    """What each step of an ingest removed, from the job that writes the table."""
    orders = read(spark, d, "orders")
    last = orders.agg(F.max("o_orderkey").alias("last"))
    key = F.col("o_custkey")
    total = F.when(key % 5 == 0, 0).when(F.col("o_orderkey") > F.col("last") - 300, 0).otherwise(F.col("o_totalprice"))
    method = F.when(key % 50 == 1, I.HEADER_MARK).when(key % 49 != 0, (key % 3).cast("string"))
    sheet = orders.crossJoin(F.broadcast(last)).select(F.col("o_orderkey").alias("rowid"), total.alias("Total"), method.alias("Method"), F.lit("S").alias("Site No."), F.lit(None).cast("string").alias("P-Qs"))
    steps = I.Steps()
    I.ingest(sheet, I.SPECS["reef-survey-plain"], "reef.xlsx", steps=steps).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(steps.removed(), "step string, removed long")


@query("SELECT event_type, event_id, CAST(user_id AS VARCHAR) AS who, 'e.xlsx' AS input_filename FROM events")
def column_plumbing(spark, d):
    e = I.select_strict(read(spark, d, "events"), ["event_id", "user_id", "event_type", "value"])
    e = I.to_front(I.rename_strict(e.drop("value"), {"user_id": "who"}), ["event_type"])
    return I.move_after(e.withColumn("who", F.col("who").cast("string")).withColumn("input_filename", F.lit("e.xlsx")), "who", "event_id")


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) AS rowid FROM events")
def rowid(spark, d):
    return with_rowid(read(spark, d, "events").select("event_id"), ["event_id"])


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) AS rowid FROM part")
def rowid_by_text(spark, d):
    return with_rowid(read(spark, d, "part").select("p_name", "p_partkey"), ["p_name", "p_partkey"]).drop("p_name")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'finished' WHEN o_totalprice > 200000 THEN 'large' ELSE lower(o_orderpriority) END AS label FROM orders")
def case_when_map(spark, d):
    label = F.when(F.col("o_orderstatus") == "F", "finished").when(F.col("o_totalprice") > 200000, "large").otherwise(F.lower("o_orderpriority"))
    return read(spark, d, "orders").select("o_orderkey", label.alias("label"))


@query("SELECT page_id, lower(url) AS lowered, replace(url, '/', '_') AS replaced, substr(url, 1, 12) AS head, strpos(url, '.') AS dot, length(url) AS n, starts_with(url, 'https') AS secure, list_extract(string_split(url, '/'), -1) AS base, regexp_replace(url, 'example', '') AS removed FROM pages")
def string_scalars(spark, d):
    u = F.col("url")
    return read(spark, d, "pages").select("page_id", F.lower(u).alias("lowered"), F.replace(u, F.lit("/"), F.lit("_")).alias("replaced"), F.substring(u, 1, 12).alias("head"), F.instr(u, ".").cast("long").alias("dot"), F.length(u).cast("long").alias("n"), u.startswith("https").alias("secure"), X.base_name(u).alias("base"), X.remove_first(u, "example").alias("removed"))


@query("SELECT conv_id, turn, try_cast(CASE WHEN turn % 2 = 0 THEN CAST(turn AS VARCHAR) ELSE role END AS DOUBLE) AS number, CAST(conv_id AS VARCHAR) AS label FROM conversations")
def safe_cast(spark, d):
    text = F.when(F.col("turn") % 2 == 0, F.col("turn").cast("string")).otherwise(F.col("role"))
    return read(spark, d, "conversations").select("conv_id", "turn", N.to_number(text).alias("number"), F.col("conv_id").cast("string").alias("label"))


@query(survey_sql("SELECT DISTINCT site_code, method FROM survey"))
def distinct_rows(spark, d):
    return survey(spark, d, False).select("site_code", "method").distinct()


@query(survey_sql('SELECT rowid, name, value FROM (SELECT rowid, \'2.5\' AS name, "2.5" AS value FROM survey UNION ALL SELECT rowid, \'5\', "5" FROM survey UNION ALL SELECT rowid, \'7.5\', "7.5" FROM survey)'))
def unpivot_sizes(spark, d):
    return M.longer(survey(spark, d), ["rowid"], SIZES)
