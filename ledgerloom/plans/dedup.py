"""Entity resolution: keys, duplicate groups and tiered matching of deals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import amounts, dates, fixed, keys, names
from ledgerloom.operators.resolve import duplicate_groups, match_tiers, matching_names
from ledgerloom.plans.registry import list_sql, query
from ledgerloom.plans.views import AS_OF, Views

_SUFFIXES = "|".join(s.replace(".", "[.]") for s in fixed.NAME_SUFFIXES)


def norm_sql(name: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(trim(lower({name})), '^the ', ''), '(?:{_SUFFIXES})+$', ''), '[^a-z0-9]', '', 'g')"


_BUCKET = """CASE WHEN amount_usd < 250000 THEN NULL WHEN amount_usd < 1000000 THEN amount_usd // 250000 WHEN amount_usd < 10000000 THEN 4 + amount_usd // 2000000 WHEN amount_usd < 100000000 THEN 9 + amount_usd // 20000000
WHEN amount_usd < 1000000000 THEN 14 + amount_usd // 100000000 ELSE 24 + amount_usd // 500000000 END"""
_UNDATED = (AS_OF.toordinal() - 719163) // 30
_DAY = f"coalesce(CAST((announced_date - DATE '1970-01-01') // 3 AS VARCHAR), 'nodate_{_UNDATED}')"


def keyed(v: Views) -> DataFrame:
    """Deals with their names, normal forms and keys."""
    rows = v.deals.join(v.companies.select("company_id", "name"), "company_id")
    return rows.withColumns({
        "norm": names.normal_form(F.col("name")),
        "dedup_key": keys.dedup_key(F.col("name"), F.col("round_type"), F.col("announced_date"), AS_OF),
        "amount_key": keys.amount_key(F.col("name"), F.col("amount_usd"), F.col("announced_date"), AS_OF),
    })


_KEYED = f"keyed AS (SELECT d.*, c.name, md5({norm_sql('c.name')} || '|' || round_type || '|' || {_DAY}) AS dedup_key, md5({norm_sql('c.name')} || '|amt' || CAST({_BUCKET} AS VARCHAR) || '|' || {_DAY}) AS amount_key FROM deals d JOIN companies c USING (company_id))"


@query(f"WITH {_KEYED} SELECT dedup_key, count(*) AS n, min(deal_id) AS kept, array_to_string(list(deal_id ORDER BY deal_id), ',') AS deal_ids FROM keyed GROUP BY dedup_key HAVING count(*) > 1")
def res03_duplicate_groups(v: Views) -> DataFrame:
    """Groups of deals that share a key, with the one that is kept."""
    return duplicate_groups(keyed(v), "dedup_key").select("dedup_key", "n", "kept", F.array_join(F.transform("deal_ids", lambda x: x.cast("string")), ",").alias("deal_ids"))


@query(f"WITH {_KEYED}, g AS (SELECT amount_key, min(deal_id) AS kept FROM keyed WHERE amount_key IS NOT NULL GROUP BY amount_key HAVING count(*) > 1), m AS (SELECT deal_id, kept FROM keyed JOIN g USING (amount_key) WHERE deal_id <> kept) SELECT a.article_id, coalesce(m.kept, a.deal_id) AS deal_id FROM articles a LEFT JOIN m USING (deal_id)")
def res03_relinked_articles(v: Views) -> DataFrame:
    """Articles of duplicate deals, by amount, move to the deal that is kept."""
    groups = duplicate_groups(keyed(v).where("amount_key IS NOT NULL"), "amount_key")
    moved = groups.select("kept", F.explode("deal_ids").alias("deal_id")).where("deal_id <> kept")
    return v.articles.join(moved, "deal_id", "left").select("article_id", F.coalesce("kept", "deal_id").alias("deal_id"))


@query(f"SELECT company_id, {norm_sql('name')} AS norm FROM companies")
def str01_normal_form(v: Views) -> DataFrame:
    return v.companies.select("company_id", names.normal_form(F.col("name")).alias("norm"))


_VARIANT = "CASE company_id % 5 WHEN 0 THEN 'Nova' || CAST(company_id // 10 AS VARCHAR) WHEN 1 THEN 'nova' || CAST(company_id // 10 AS VARCHAR) || 'labs' WHEN 2 THEN 'The Nova' || CAST(company_id // 10 AS VARCHAR) || ', Inc.' WHEN 3 THEN 'Nova' || CAST(company_id // 10 AS VARCHAR) || 'go' ELSE name END"


@query(f"""WITH n AS (SELECT company_id, {norm_sql(_VARIANT)} AS norm FROM companies), r AS (SELECT norm, min(company_id) AS rep FROM n GROUP BY norm)
SELECT 'same' AS kind, n.company_id AS a_id, r.rep AS b_id FROM n JOIN r USING (norm) WHERE n.company_id <> r.rep UNION ALL
SELECT 'suffix', a.rep, b.rep FROM r a JOIN r b ON length(a.norm) >= 3 AND a.norm <> b.norm AND starts_with(b.norm, a.norm) AND substr(b.norm, length(a.norm) + 1) IN {list_sql(fixed.MATCH_SUFFIXES)}""")
def str02_matching_names(v: Views) -> DataFrame:
    """Companies with the first one of their normal form, and pairs of normal forms that match by a suffix: an equi-join on block keys, then the exact test."""
    k = F.col("company_id")
    stem = F.concat(F.lit("Nova"), F.floor(k / 10).cast("string"))
    named = v.companies.select("company_id", F.when(k % 5 == 0, stem).when(k % 5 == 1, F.concat(F.lower(stem), F.lit("labs"))).when(k % 5 == 2, F.concat(F.lit("The "), stem, F.lit(", Inc."))).when(k % 5 == 3, F.concat(stem, F.lit("go"))).otherwise(F.col("name")).alias("name"))
    return matching_names(named)


@query(f"SELECT deal_id, CAST({_BUCKET} AS BIGINT) AS bucket FROM deals")
def amt07_amount_bucket(v: Views) -> DataFrame:
    return v.deals.select("deal_id", amounts.bucket(F.col("amount_usd")).cast("long").alias("bucket"))


@query(f"WITH {_KEYED} SELECT deal_id, dedup_key, amount_key FROM keyed")
def key01_deal_keys(v: Views) -> DataFrame:
    return keyed(v).select("deal_id", "dedup_key", "amount_key")


@query(f"""WITH b AS (SELECT deal_id, {norm_sql('name')} AS norm, round_type, coalesce(CAST((announced_date - DATE '1970-01-01') // 3 AS BIGINT), {_UNDATED}) AS b, CASE WHEN announced_date IS NULL THEN 'nodate_' ELSE '' END AS p FROM deals JOIN companies USING (company_id))
SELECT deal_id, md5(norm || '|' || round_type || '|' || p || CAST(b - 1 AS VARCHAR)) AS before, md5(norm || '|' || round_type || '|' || p || CAST(b + 1 AS VARCHAR)) AS after FROM b""")
def key03_adjacent_keys(v: Views) -> DataFrame:
    rows = v.deals.join(v.companies, "company_id")
    both = keys.adjacent_keys(F.col("name"), F.col("round_type"), F.col("announced_date"), AS_OF)
    return rows.select("deal_id", both[0].alias("before"), both[1].alias("after"))


@query("SELECT deal_id, day(announced_date) = 1 AND month(announced_date) IN (1, 4, 7, 10) AS placeholder FROM deals WHERE announced_date IS NOT NULL")
def date01_placeholder(v: Views) -> DataFrame:
    return v.deals.where("announced_date IS NOT NULL").select("deal_id", dates.is_placeholder(F.col("announced_date")).alias("placeholder"))


@query(f"""SELECT deal_id, coalesce(amount_usd > CASE round_type WHEN 'pre_seed' THEN 10000000 WHEN 'seed' THEN 50000000 WHEN 'series_a' THEN 200000000 WHEN 'series_b' THEN 500000000 WHEN 'series_c' THEN 1000000000 END, false) AS review FROM deals""")
def cls10_amount_review(v: Views) -> DataFrame:
    return v.deals.select("deal_id", amounts.over_round_limit(F.col("amount_usd"), F.col("round_type")).alias("review"))


@query(f"""WITH n AS (SELECT d.*, lower(trim(c.name)) AS raw, {norm_sql('c.name')} AS norm FROM deals d JOIN companies c USING (company_id)),
s AS (SELECT * FROM n WHERE deal_id % 20 <> 0), i AS (SELECT * FROM n WHERE deal_id % 20 = 0),
m AS (SELECT i.deal_id AS in_id, s.deal_id AS deal_id, i.round_type AS r, s.round_type AS sr, i.raw AS raw, s.raw AS sraw, i.announced_date AS d, s.announced_date AS sd, s.created_date AS sc, i.amount_usd AS n, s.amount_usd AS sn,
 abs(i.announced_date - s.announced_date) AS gap, date '{AS_OF}' - s.created_date AS age, date '{AS_OF}' - s.announced_date AS sage
 FROM i JOIN s ON i.norm = s.norm OR (length(s.norm) >= 3 AND starts_with(i.norm, s.norm) AND substr(i.norm, length(s.norm) + 1) IN {list_sql(fixed.MATCH_SUFFIXES)}) OR (length(i.norm) >= 3 AND starts_with(s.norm, i.norm) AND substr(s.norm, length(i.norm) + 1) IN {list_sql(fixed.MATCH_SUFFIXES)})),
p AS (SELECT i.deal_id AS in_id, s.deal_id FROM i JOIN s ON i.announced_date = s.announced_date AND i.round_type = s.round_type WHERE coalesce(i.amount_usd, 0) <> 0 AND length(i.norm) >= 3 AND length(s.norm) >= 3
 AND s.amount_usd BETWEEN CAST(floor(i.amount_usd * 0.95) AS BIGINT) AND CAST(floor(i.amount_usd * 1.05) AS BIGINT)
 AND substr(i.norm, 1, CAST(greatest(4, floor(0.6 * least(length(i.norm), length(s.norm)))) AS BIGINT)) = substr(s.norm, 1, CAST(greatest(4, floor(0.6 * least(length(i.norm), length(s.norm)))) AS BIGINT))),
k AS (SELECT *, CASE WHEN coalesce(n, 0) = 0 OR coalesce(sn, 0) = 0 THEN true WHEN greatest(n, sn) / greatest(1, least(n, sn)) <= 5 THEN true ELSE greatest(n, sn) / greatest(1, least(n, sn)) BETWEEN 8 AND 12 AND least(n, sn) >= 50000000 AND greatest(n, sn) >= 400000000 END AS ratio_ok FROM m),
t AS (SELECT in_id, deal_id, CASE
 WHEN raw = sraw AND r = sr AND CASE WHEN d IS NOT NULL THEN coalesce(gap <= 5, sd IS NULL AND age <= 10) ELSE (sd IS NULL OR sage <= 21) AND age <= 21 END THEN 1
 WHEN coalesce(n, 0) <> 0 AND sn BETWEEN CAST(floor(n * 0.9) AS BIGINT) AND CAST(floor(n * 1.1) AS BIGINT) AND CASE WHEN d IS NOT NULL THEN coalesce(gap <= 30, sd IS NULL AND age <= 60) ELSE coalesce(sage <= 60, age <= 60) END THEN 3
 WHEN d = sd AND raw = sraw THEN 4
 WHEN d = sd THEN 5
 WHEN r = sr AND ratio_ok AND CASE WHEN d IS NOT NULL THEN coalesce(gap <= 30, false) ELSE age <= 30 END THEN 6
 WHEN r = sr AND ratio_ok AND d IS NOT NULL AND sd IS NULL AND age <= 30 THEN 7
 WHEN r = sr AND CASE WHEN d IS NOT NULL THEN coalesce(gap <= 365, sd IS NULL AND age <= 365) ELSE coalesce(sage <= 365, age <= 365) END AND CASE WHEN coalesce(n, 0) <> 0 AND coalesce(sn, 0) <> 0 THEN abs(n - sn) <= 0.15 * greatest(n, sn) ELSE coalesce(gap <= 60, true) END THEN 8 END AS tier FROM k
 UNION ALL SELECT in_id, deal_id, 2 FROM p)
SELECT in_id, min(tier) AS tier, arg_min(deal_id, tier * 100000000000 + deal_id) AS deal_id FROM t WHERE tier IS NOT NULL GROUP BY in_id""")
def res01_tiers(v: Views) -> DataFrame:
    """The stored deal that each incoming deal duplicates, by the first tier that finds one."""
    rows = keyed(v)
    return match_tiers(rows.where("deal_id % 20 = 0"), rows.where("deal_id % 20 <> 0"), AS_OF)


@query(f"""WITH {_KEYED}, b AS (SELECT deal_id, dedup_key, {norm_sql('name')} AS norm, round_type, coalesce(CAST((announced_date - DATE '1970-01-01') // 3 AS BIGINT), {_UNDATED}) AS b, CASE WHEN announced_date IS NULL THEN 'nodate_' ELSE '' END AS p FROM keyed),
i AS (SELECT deal_id, unnest([md5(norm || '|' || round_type || '|' || p || CAST(b - 1 AS VARCHAR)), md5(norm || '|' || round_type || '|' || p || CAST(b + 1 AS VARCHAR))]) AS k FROM b WHERE deal_id % 10 = 0)
SELECT i.deal_id, min(s.deal_id) AS stored_id FROM i JOIN b s ON s.dedup_key = i.k AND s.deal_id % 10 <> 0 GROUP BY i.deal_id""")
def res02_adjacent_hits(v: Views) -> DataFrame:
    """Incoming deals whose key in a neighbouring date bucket is stored."""
    rows = keyed(v)
    both = keys.adjacent_keys(F.col("name"), F.col("round_type"), F.col("announced_date"), AS_OF)
    incoming = rows.where("deal_id % 10 = 0").select("deal_id", F.explode(both).alias("dedup_key"))
    stored = rows.where("deal_id % 10 <> 0").groupBy("dedup_key").agg(F.min("deal_id").alias("stored_id"))
    return incoming.join(stored, "dedup_key").groupBy("deal_id").agg(F.min("stored_id").alias("stored_id"))


@query(f"WITH {_KEYED} SELECT dedup_key, min(deal_id) AS deal_id FROM keyed WHERE deal_id % 3 = 0 AND dedup_key NOT IN (SELECT dedup_key FROM keyed WHERE deal_id % 3 <> 0) GROUP BY dedup_key")
def snk01_insert_absent(v: Views) -> DataFrame:
    """New deals whose key isn't stored, the least id of each key."""
    rows = keyed(v)
    new = rows.where("deal_id % 3 = 0").join(rows.where("deal_id % 3 <> 0").select("dedup_key"), "dedup_key", "left_anti")
    return new.groupBy("dedup_key").agg(F.min("deal_id").alias("deal_id"))
