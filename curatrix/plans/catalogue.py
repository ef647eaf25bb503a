"""The registry of the library's own queries, each with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions import json_text, values
from curatrix.functions import text as T
from curatrix.operators import audits, dedup, matching, pairing, privacy, sections, selection, statistics
from curatrix.plans import fixtures
from curatrix.session import table
from curatrix.sources.folders import shared_copy, shared_folder
from curatrix.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Words that play the vocabulary, the directions and the page furniture on the general tables.
VOCABULARY = {"function words": ["the", "of"], "conjunctions": ["and", "und"], "articles": ["la", "le", "die"], "none": ["qqq"]}
DIRECTIONS = {"english": "the", "german": "der", "french": "les", "spanish": "los"}
PHRASES = ("Licensed under", "Copyright")


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")


def rate(part: Column, whole: Column) -> Column:
    """A share rounded to four places, 0 of nothing."""
    return F.coalesce(F.round(F.try_divide(part.cast("double"), whole.cast("double")), 4), F.lit(0.0))


BLANK = r"[\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b\x1c-\x1f]"
COMPACT = rf"regexp_replace(lower(coalesce(text, '')), '{BLANK}+', '', 'g')"
SIMILAR = f"regexp_replace({COMPACT}, '[^0-9a-z\\x{{4e00}}-\\x{{9fff}}]+', '', 'g')"
TITLE = "regexp_replace(lower(source), '[（）()\\[\\]【】\\-_/·,.，。:：;；\\s]+', '', 'g')"
LINES = r"regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')"


@query(f"""
with f as (select d.*, sha1({COMPACT}) as fp from documents d),
r as (select *, row_number() over (partition by source, fp order by doc_id) as rn from f)
select r.source, count(*) as n_rows, count(*) filter (rn = 1) as kept, count(*) filter (rn > 1) as dropped,
  round(avg(length(text)), 4) as mean_chars, count(l.doc_id) as n_labelled
from r left join labels l using (doc_id) group by r.source""")
def curation_summary(spark, sf_dir):
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count(F.lit(1)).alias("marks"))
    d = docs(spark, sf_dir).select("doc_id", "source", F.length("text").alias("chars"), T.fingerprint(F.col("text")).alias("fp")).join(marks, "doc_id", "left")
    # By text first, so that texts kept are counted as rows.
    texts = d.groupBy("source", "fp").agg(
        F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.count("chars").alias("with_text"),
        F.sum(F.coalesce("marks", F.lit(0))).alias("marks")
    )
    n, kept = F.sum("n"), F.count(F.lit(1))
    return texts.groupBy("source").agg(
        n.alias("n_rows"), kept.alias("kept"), (n - kept).alias("dropped"), F.round(F.sum("chars") / F.sum("with_text"), 4).alias("mean_chars"),
        F.sum("marks").alias("n_labelled")
    )


@query(
    f"""select doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(replace(text, '　', ' '), '[ \\t\\r\\f\\x0b]+', ' ', 'g'), '\\n|[\\x1c-\\x1e]|\\x{{85}}|\\x{{2028}}|\\x{{2029}}'), lambda x: regexp_replace(x, '^{BLANK}+|{BLANK}+$', '', 'g')), lambda x: x <> ''), chr(10)) as clean from documents"""
)
def q01_normalize_space(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.normalize_space(F.col("text")).alias("clean"))


@query(
    r"""select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(^|[^0-9])1[3-9][0-9]{9}($|[^0-9])', '\1[手机号]\2', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[邮箱]', 'g'), '(微信|VX|WeChat)[:：]?\s*[A-Za-z0-9_-]{5,}', '\1：[已脱敏]', 'gi') as masked from documents"""
)
def q02_mask_private(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.mask_private(F.col("text")).alias("masked"))


@query(
    f"select doc_id, array_to_string(list_filter({LINES}, lambda x: not contains(x, 'Licensed under') and not contains(x, 'Copyright')), chr(10)) as kept from documents"
)
def q03_remove_boilerplate(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.remove_boilerplate(F.col("text"), PHRASES, ()).alias("kept"))


@query(f"""with l as (select doc_id, unnest({LINES}) as x, unnest(range(len({LINES}))) as i from documents),
k as (select *, regexp_replace(lower(x), '{BLANK}+', '', 'g') as k from l),
r as (select *, row_number() over (partition by doc_id, k order by i) as rn from k)
select doc_id, coalesce(string_agg(x, chr(10) order by i) filter (rn = 1 and k <> ''), '') as kept from r group by doc_id""")
def q04_dedup_lines(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.dedup_lines(F.col("text")).alias("kept"))


@query(
    r"select page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g') as plain from pages"
)
def q05_strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("plain"))


@query(
    r"select page_id, case when h <> '' then h else regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) end as title from (select *, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) as h from pages)"
)
def q06_page_title(spark, sf_dir):
    h = F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    return table(spark, sf_dir, "pages").select(
        "page_id", F.when(h != "", h).otherwise(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title")
    )


@query("select lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) as host, count(*) as n from pages group by 1")
def q07_url_host_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(T.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query("select page_id, 'jd_' || substr(sha1(url), 1, 12) as stable_id from pages")
def q08_stable_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.stable_id(F.col("url")).alias("stable_id"))


@query(f"select doc_id, sha1({COMPACT}) as fp from documents")
def q09_fingerprint(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.fingerprint(F.col("text")).alias("fp"))


@query(f"select doc_id, {TITLE} || '|' || substr({SIMILAR}, 1, 32) as bucket from documents")
def q10_bucket_key(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.bucket_key(F.col("source"), F.col("text")).alias("bucket"))


@query(
    f"select doc_id, source, lang from (select *, row_number() over (partition by source, sha1({COMPACT}) order by doc_id) as rn from documents) where rn = 1"
)
def q11_exact_dedup_first_wins(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "source", "lang", T.fingerprint(F.col("text")).alias("fp"))
    return dedup.first_wins(d, ["source", "fp"], ["doc_id"]).select("doc_id", "source", "lang")


@query("select min(doc_id) as doc_id, sha1(lang || '|' || source || '|' || substr(text, 1, 500)) as k from documents group by 2")
def q12_pool_dedup_key_500(spark, sf_dir):
    key = F.sha1(F.concat_ws("|", "lang", "source", F.substring("text", 1, 500)))
    return docs(spark, sf_dir).groupBy(key.alias("k")).agg(F.min("doc_id").alias("doc_id"))


@query(
    f"select cast(sum(c - 1) as bigint) as surplus_rows, count(*) filter (c > 1) as duplicated_keys from (select count(*) as c from documents group by sha1({COMPACT}))"
)
def q13_duplicate_surplus(spark, sf_dir):
    return dedup.surplus(docs(spark, sf_dir).select(T.fingerprint(F.col("text")).alias("fp")), "fp")


@query("select source, count(*) as n, cast(sum(length(text)) as bigint) as chars from documents group by source order by n desc, source limit 10")
def q14_source_distribution_topk(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")
    ).orderBy(F.desc("n"), "source").limit(10)


@query(
    "select lang, source, n from (select lang, source, count(*) as n, row_number() over (partition by lang order by count(*) desc, source) as rn from documents group by lang, source) where rn <= 3"
)
def q15_lang_source_two_level_top(spark, sf_dir):
    counts = docs(spark, sf_dir).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return selection.quota(counts, "lang", 3, [F.desc("n"), "source"])


@query("""select lang, count(*) as n, count(*) filter (length(text) < 200) as n_short, count(*) filter (length(text) > 5000) as n_long,
count(distinct source) as n_sources, count(l.doc_id) as n_labelled, count(*) filter (l.quality = 1) as n_good,
coalesce(round(count(*) filter (l.quality = 1) / nullif(count(l.doc_id), 0), 4), 0) as good_rate, round(avg(length(text)), 4) as mean_chars
from documents d left join labels l using (doc_id) group by lang""")
def q16_corpus_audit(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.length("text") < 200).alias("n_short"), F.count_if(F.length("text") > 5000).alias("n_long"),
        F.countDistinct("source").alias("n_sources"), F.count("quality").alias("n_labelled"), F.count_if(F.col("quality") == 1).alias("n_good"),
        rate(F.count_if(F.col("quality") == 1), F.count("quality")).alias("good_rate"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"))


@query(
    "select event_type, count(*) as n, cast(max(ts) as varchar) as last_ts, cast(sum(length(props)) as bigint) as prop_chars from events group by event_type"
)
def q17_raw_state(spark, sf_dir):
    out = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("m"), F.sum(F.length("props")).alias("prop_chars")
    )
    # A fraction only where there is one, as the other engine prints it.
    return out.select("event_type", "n", F.regexp_replace(F.col("m").cast("string"), r"\.0*$", "").alias("last_ts"), "prop_chars")


@query(
    "select event_id, length(props) as n_props, json_extract_string(props, '$.k') as k, try_cast(json_extract_string(props, '$.v') as bigint) as v, json_valid(props) as ok from events"
)
def q18_meta_json_extract(spark, sf_dir):
    v = F.try_variant_get(F.try_parse_json("props"), "$.v", "string")
    return table(spark, sf_dir, "events").select(
        "event_id", F.length("props").cast("long").alias("n_props"), F.get_json_object("props", "$.k").alias("k"), v.try_cast("bigint").alias("v"),
        F.try_parse_json("props").isNotNull().alias("ok")
    )


SCORE = "(case when length(text) >= 500 then 40 else 10 end + case when coalesce(quality, 0) = 1 then 40 else 0 end + case when coalesce(toxic, 0) = 0 then 15 else 0 end)"


def quality_score() -> Column:
    one = lambda ok, a, b=0: F.when(ok, a).otherwise(b)
    return one(F.length("text") >= 500, 40, 10) + one(F.coalesce("quality", F.lit(0)) == 1, 40) + one(F.coalesce("toxic", F.lit(0)) == 0, 15)


@query(f"select cast(floor({SCORE} / 10) * 10 as bigint) as bucket, count(*) as n from documents left join labels using (doc_id) group by 1")
def q19_quality_score_buckets(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy((F.floor(quality_score() / 10) * 10).cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


REASONS = "list_filter([case when quality = 0 then 'low_quality' end, case when toxic = 1 then 'toxic' end, case when length(text) < 200 then 'short_text' end, case when quality is null then 'unlabelled' end, case when contains(text, '@') then 'contact' end], lambda x: x is not null)"


def reasons() -> Column:
    named = {
        "low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1, "short_text": F.length("text") < 200,
        "unlabelled": F.col("quality").isNull(), "contact": F.contains("text", F.lit("@"))
    }
    return F.array_compact(F.array(*[F.when(ok, name) for name, ok in named.items()]))


@query(f"select reason, count(*) as n from (select unnest({REASONS}) as reason from documents left join labels using (doc_id)) group by reason")
def q20_risk_reason_counts(spark, sf_dir):
    return labelled(spark, sf_dir).select(F.explode(reasons()).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"select source, count(*) as n, count(*) filter (len({REASONS}) >= 2) as n_high, round(count(*) filter (len({REASONS}) >= 2) / count(*), 4) as high_rate from documents left join labels using (doc_id) group by source"
)
def q21_high_risk_rate(spark, sf_dir):
    high = F.size(reasons()) >= 2
    return labelled(spark, sf_dir).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(high).alias("n_high"), rate(F.count_if(high), F.count(F.lit(1))).alias("high_rate")
    )


@query(
    "select case when length(text) < 200 then 'short' when quality = 0 then 'quality' when toxic = 1 then 'toxic' when lang not in ('en', 'de') then 'language' when quality is null then 'unlabelled' else 'kept' end as outcome, count(*) as n from documents left join labels using (doc_id) group by 1"
)
def q22_rejection_waterfall(spark, sf_dir):
    rules = [
        (F.length("text") < 200, "short"), (F.col("quality") == 0, "quality"), (F.col("toxic") == 1, "toxic"),
        (~F.col("lang").isin("en", "de"), "language"), (F.col("quality").isNull(), "unlabelled")
    ]
    return labelled(spark, sf_dir).groupBy(matching.first_rule(rules, "kept").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "select doc_id, source from documents left join labels using (doc_id) where quality = 1 and coalesce(toxic, 0) = 0 and length(text) between 200 and 20000"
)
def q23_strict_tier_filter(spark, sf_dir):
    return labelled(spark, sf_dir).filter(
        (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.length("text").between(200, 20000)
    ).select("doc_id", "source")


@query(f"""with t as (select doc_id, sha1({COMPACT}) as fp, case when quality = 1 then 0 when quality is null then 1 else 2 end as tier from documents left join labels using (doc_id)),
r as (select *, row_number() over (partition by fp order by tier, doc_id) as rn from t) select doc_id, tier from r where rn = 1""")
def q24_tier_priority_union(spark, sf_dir):
    tier = F.when(F.col("quality") == 1, 0).when(F.col("quality").isNull(), 1).otherwise(2)
    t = labelled(spark, sf_dir).select("doc_id", T.fingerprint(F.col("text")).alias("fp"), tier.alias("tier"))
    return dedup.first_wins(t, ["fp"], ["tier", "doc_id"]).select("doc_id", "tier")


@query(
    "select doc_id, source from (select doc_id, source, row_number() over (partition by source order by sha1('42:' || doc_id), doc_id) as rn from documents) where rn <= 5"
)
def q25_family_quota(spark, sf_dir):
    return selection.quota(docs(spark, sf_dir).select("doc_id", "source"), "source", 5, [selection.hash_order("42", F.col("doc_id")), "doc_id"])


@query("""with m as (select doc_id, lang, lang = 'en' as fam from documents), k as (select floor(count(*) * (0.4 / (1 - 0.4))) as most from m where not fam),
r as (select *, row_number() over (order by doc_id) as rn from m where fam) select doc_id, lang from m where not fam union all select doc_id, lang from r, k where rn <= most""")
def q26_family_rate_cap(spark, sf_dir):
    return selection.rate_cap(docs(spark, sf_dir).select("doc_id", "lang"), F.col("lang") == "en", 0.4, ["doc_id"])


@query(
    "select conv_id, turn from (select conv_id, turn, row_number() over (partition by conv_id order by conv_id, turn) as depth from conversations) order by depth, conv_id, turn limit 50"
)
def q27_round_robin_sample(spark, sf_dir):
    return selection.round_robin(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", ["conv_id", "turn"], 50).select("conv_id", "turn")


@query(
    f"select tier, doc_id, score from (select coalesce(cast(quality as varchar), 'none') as tier, doc_id, cast({SCORE} as integer) as score, row_number() over (partition by quality order by {SCORE}, doc_id) as rn from documents left join labels using (doc_id)) where rn <= 4"
)
def q28_per_tier_lowest_score(spark, sf_dir):
    t = labelled(spark, sf_dir).select(F.coalesce(F.col("quality").cast("string"), F.lit("none")).alias("tier"), "doc_id", quality_score().alias("score"))
    return selection.quota(t, "tier", 4, ["score", "doc_id"])


@query("""with r as (select doc_id, row_number() over (order by sha1('7:' || doc_id), doc_id) - 1 as rank, count(*) over () as n from documents),
s as (select *, greatest(1, cast(trunc(n * 0.1) as bigint)) as nv from r), t as (select *, greatest(1, n - cast(trunc(n * 0.8) as bigint) - nv) as nt from s)
select doc_id, case when rank < greatest(1, n - nv - nt) then 'train' when rank < greatest(1, n - nv - nt) + nv then 'valid' else 'test' end as split from t""")
def q29_split_sizes_hash_order(spark, sf_dir):
    return selection.split_sizes(docs(spark, sf_dir).select("doc_id"), "doc_id", "7", 0.8, 0.1)


def document_links(spark, sf_dir) -> DataFrame:
    """Links of documents that share a fingerprint or a similarity text, to the least id with the same key."""
    d = docs(spark, sf_dir)
    keys = d.select("doc_id", T.fingerprint(F.col("text")).alias("k")).unionByName(d.select("doc_id", F.sha1(T.similarity_text(F.col("text"))).alias("k")))
    return keys.join(keys.groupBy("k").agg(F.min("doc_id").alias("a")), "k").select("a", F.col("doc_id").alias("b"))


@query(f"""with recursive k as (select doc_id, sha1({COMPACT}) as k from documents union all select doc_id, sha1({SIMILAR}) from documents),
e as (select distinct a.doc_id as a, b.doc_id as b from k a join k b using (k)),
r as (select a as node, a as root from e union select e.b, r.root from r join e on e.a = r.node where r.root < e.b),
c as (select node as doc_id, min(root) as component from r group by node)
select doc_id, component, case cast('0x' || substr(sha1('c:' || component), 1, 2) as integer) % 10 when 0 then 'valid' when 1 then 'test' else 'train' end as split from c""")
def q30_component_split(spark, sf_dir):
    roots = selection.components(document_links(spark, sf_dir), lambda df: shared_copy(df, "components"))
    bucket = F.conv(F.substring(selection.hash_order("c", F.col("root")), 1, 2), 16, 10).cast("int") % 10
    return roots.select(
        F.col("node").alias("doc_id"), F.col("root").alias("component"),
        F.when(bucket == 0, "valid").when(bucket == 1, "test").otherwise("train").alias("split")
    )


def raw_split() -> Column:
    return F.element_at(F.array(F.lit("train"), F.lit("dev"), F.lit("test"), F.lit("train")), (F.col("doc_id") % 4 + 1).cast("int"))


RAW_SPLIT = "['train', 'dev', 'test', 'train'][doc_id % 4 + 1]"


@query(f"""with m as (select doc_id, sha1({COMPACT}) as g, {RAW_SPLIT} as split from documents),
r as (select *, min(case split when 'test' then 0 when 'dev' then 1 else 2 end) over (partition by g) as first from m)
select doc_id, split from r where first = case split when 'test' then 0 when 'dev' then 1 else 2 end""")
def q31_split_isolation(spark, sf_dir):
    m = docs(spark, sf_dir).select("doc_id", T.fingerprint(F.col("text")).alias("g"), raw_split().alias("split"))
    return selection.isolated(m, "g", "split", ["test", "dev", "train"]).select("doc_id", "split")


@query(f"""with m as (select doc_id, sha1({COMPACT}) as g, {RAW_SPLIT} as split from documents),
f as (select g, arg_min(split, doc_id) as first from m group by g)
select split, count(*) as n, count(*) filter (split <> first) as leaked from m join f using (g) group by split""")
def q32_first_seen_split_leakage(spark, sf_dir):
    m = docs(spark, sf_dir).select("doc_id", T.fingerprint(F.col("text")).alias("g"), raw_split().alias("split"))
    f = m.groupBy("g").agg(F.min_by("split", "doc_id").alias("first"))
    return m.join(f, "g").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") != F.col("first")).alias("leaked"))


@query("""select lang, count(*) as n_held from documents where doc_id in (select doc_id from labels) group by lang""")
def q33_holdout_overlap(spark, sf_dir):
    """Samples whose source is held out; the labelled documents play the holdout."""
    samples = docs(spark, sf_dir).select(F.concat(F.col("doc_id").cast("string"), F.lit("_jd_parse")).alias("id"), "lang")
    held = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return audits.held_out(samples, held).groupBy("lang").agg(F.count(F.lit(1)).alias("n_held"))


SHINGLES = "list_distinct(list_transform(range(1, greatest(2, length(t) - 3)), lambda i: substr(t, i, 5)))"


@query(f"select doc_id, cast(case when t = '' then 0 else len({SHINGLES}) end as bigint) as n_shingles from (select doc_id, {SIMILAR} as t from documents)")
def q34_shingle_counts(spark, sf_dir):
    return dedup.shingle_counts(docs(spark, sf_dir), T.similarity_text(F.col("text")), "doc_id")


@query(f"""with d as (select source as b, {SIMILAR} as t, min(doc_id) as id from documents group by 1, 2), s as (select b, id, {SHINGLES} as s from d where t <> ''),
p as (select a.id as left_id, c.id as right_id, len(list_intersect(a.s, c.s)) as k, len(a.s) as m, len(c.s) as n from s a join s c on a.b = c.b and a.id < c.id and len(c.s) >= 0.9 * len(a.s) and len(a.s) >= 0.9 * len(c.s))
select left_id, right_id, k / (m + n - k) as jaccard from p where k / (m + n - k) >= 0.9""")
def q35_near_dup_pairs_jaccard(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.col("source").alias("bucket"), T.similarity_text(F.col("text")).alias("t"))
    return dedup.jaccard_pairs(d, "doc_id", "bucket", "t")


@query()
def q36_greedy_near_dedup(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", T.bucket_key(F.col("source"), F.col("text")).alias("bucket"), T.similarity_text(F.col("text")).alias("t"))
    once = d.groupBy("bucket", "t").agg(F.min("doc_id").alias("doc_id"))
    return dedup.greedy(once.select("doc_id", "bucket", "t"), "bucket", "doc_id", "t").select("doc_id", "bucket")


def _hits(name: str, aliases: list[str]) -> str:
    return f"case when regexp_matches(lower(text), '(^|[^a-z0-9])({'|'.join(aliases)})([^a-z0-9]|$)') then '{name}' end"


@query(
    "select doc_id, array_to_string(list_filter([" + ", ".join(_hits(n, a) for n, a in VOCABULARY.items()) + "], lambda x: x is not null), ',') as found from documents"
)
def q37_dictionary_match(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(matching.dictionary_hits(F.col("text"), VOCABULARY), ",").alias("found"))


@query("""with c as (select doc_id, """ + ", ".join(f"len(regexp_extract_all(text, ' {w} ')) as {n}" for n, w in DIRECTIONS.items()) + """ from documents),
b as (select *, greatest(english, german, french, spanish) as m from c)
select doc_id, case when m = 0 then '' when english = m then 'english' when german = m then 'german' when french = m then 'french' else 'spanish' end as direction from b""")
def q38_keyword_argmax(spark, sf_dir):
    counts = {n: F.regexp_count("text", F.lit(f" {w} ")) for n, w in DIRECTIONS.items()}
    return docs(spark, sf_dir).select("doc_id", matching.argmax(counts).alias("direction"))


def pairs(spark, sf_dir) -> DataFrame:
    """Each labelled document with the next two of its language and the next one of another, in hash order."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id", "lang", F.length("text").alias("n"), "quality", "toxic"
    )
    side = lambda s: [F.col(f"{s}.{c}").alias(f"{s[0]}{n}") for c, n in (("n", "n"), ("quality", "q"), ("toxic", "t"))]
    return selection.partners(d, "doc_id", "lang", "p", 2, 1).select(
        F.col("left.doc_id").alias("left_id"), F.col("right.doc_id").alias("right_id"), *side("left"), *side("right"), "kind"
    )


PAIRS = """with d as (select doc_id, lang, length(text) as n, quality, toxic, sha1('p:' || doc_id) as h from documents join labels using (doc_id)),
r as (select *, row_number() over (order by lang, h, doc_id) - 1 as place, count(*) over (partition by lang) as c, count(*) over () as total from d),
m as (select *, min(place) over (partition by lang) as beg from r),
o as (select m.*, beg + (place - beg + i) % c as "to", 'positive' as kind from m, range(1, 3) as t(i) where i <= c - 1
union all select m.*, case when (place - beg) % (total - c) < beg then (place - beg) % (total - c) else (place - beg) % (total - c) + c end, 'negative' from m where total > c),
p as (select a.doc_id as left_id, b.doc_id as right_id, a.n as ln, b.n as rn, a.quality as lq, b.quality as rq, a.toxic as lt, b.toxic as rt, a.kind from o a join m b on a."to" = b.place)
"""


@query(PAIRS + "select left_id, right_id, kind from p")
def q39_pair_pos_neg(spark, sf_dir):
    return pairs(spark, sf_dir).select("left_id", "right_id", "kind")


@query(PAIRS + """, s as (select left_id, right_id, kind, cast((case when kind = 'positive' then 20 else 0 end + case when ln % 7 > 0 then round_even(45 * least(ln % 7, rn % 7) / (ln % 7), 0) else 20 end
+ case when lq = rq then 10 else 0 end + case when lt = rt then 15 else 0 end + least(10, (rn % 4) * 5)) as integer) as score from p)
select left_id, right_id, score, case when score >= 85 then '高匹配' when score >= 65 then '较匹配' when score >= 45 then '基本匹配' else '低匹配' end as level from s""")
def q40_pair_rule_score(spark, sf_dir):
    policy = matching.Policy()
    p = pairs(spark, sf_dir)
    required = F.col("ln") % 7
    score = policy.score(
        F.col("kind") == "positive", required, F.least(required, F.col("rn") % 7), F.col("lq") == F.col("rq"), F.col("lt") == F.col("rt"),
        F.col("rn") % 4
    )
    scored = p.select("left_id", "right_id", score.cast("int").alias("score"))
    return scored.withColumn("level", policy.level(F.col("score")))


@query("select conv_id, count(*) as n, string_agg('<' || role || '>' || text, chr(10) order by turn) as chat from conversations group by conv_id")
def q41_render_chat_samples(spark, sf_dir):
    line = F.struct("turn", F.concat(F.lit("<"), "role", F.lit(">"), "text").alias("x"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda s: s["x"]), "\n").alias("chat")
    )


@query("""with c as (select conv_id, arg_min(text, turn) filter (role = 'user') as u, arg_min(text, turn) filter (role = 'assistant') as a from conversations group by conv_id)
select min(conv_id) as conv_id, sha1(coalesce(u, '') || '---' || coalesce(a, '')) as h from c group by 2""")
def q42_content_hash_dedup(spark, sf_dir):
    first = lambda role: F.coalesce(
        F.min_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn"))), F.lit("")
    )
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(first("user").alias("u"), first("assistant").alias("a"))
    return c.groupBy(F.sha1(F.concat("u", F.lit("---"), "a")).alias("h")).agg(F.min("conv_id").alias("conv_id"))


@query(
    "select conv_id, ['drop_field', 'swap_value', 'truncate', 'wrong_type'][cast('0x' || substr(sha1('s:' || conv_id), 1, 7) as bigint) % 4 + 1] as strategy from (select distinct conv_id from conversations)"
)
def q43_preference_strategy_pick(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("drop_field", "swap_value", "truncate", "wrong_type")])
    n = F.conv(F.substring(selection.hash_order("s", F.col("conv_id")), 1, 7), 16, 10).cast("bigint") % 4
    return table(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", F.element_at(names, (n + 1).cast("int")).alias("strategy"))


@query(
    f"select doc_id, unnest(['plain', 'compact', 'ocr']) as variant, unnest([text, regexp_replace(text, '{BLANK}+', '', 'g'), translate(text, 'lO', '10')]) as x from documents"
)
def q44_variant_explode(spark, sf_dir):
    text = F.col("text")
    v = F.array(
        F.struct(F.lit("plain").alias("variant"), text.alias("x")),
        F.struct(F.lit("compact").alias("variant"), F.regexp_replace(text, T.BLANKS, "").alias("x")),
        F.struct(F.lit("ocr").alias("variant"), F.translate(text, "lO", "10").alias("x"))
    )
    return docs(spark, sf_dir).select("doc_id", F.inline(v))


@query("""with p as (select lang, quality = 1 as gold, length(text) >= 800 as pred from documents join labels using (doc_id)),
c as (select lang, count(*) filter (gold and pred) as tp, count(*) filter (pred and not gold) as fp, count(*) filter (gold and not pred) as fn from p group by lang)
select lang, tp, fp, fn, coalesce(round(tp / nullif(tp + fp, 0), 4), 0) as precision, coalesce(round(tp / nullif(tp + fn, 0), 4), 0) as recall, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 4), 0) as f1 from c""")
def q45_set_prf1_by_group(spark, sf_dir):
    p = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").select(
        "lang", (F.col("quality") == 1).alias("gold"), (F.length("text") >= 800).alias("pred")
    )
    c = p.groupBy("lang").agg(
        F.count_if(F.col("gold") & F.col("pred")).alias("tp"), F.count_if(F.col("pred") & ~F.col("gold")).alias("fp"),
        F.count_if(F.col("gold") & ~F.col("pred")).alias("fn")
    )
    return c.select(
        "*", rate(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), rate(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        rate(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1")
    )


@query(
    "select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, max(value) as highest, round(avg(value), 6) as mean from events group by event_type"
)
def q46_latency_percentiles(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "value")
    ranks = statistics.percentiles(events, "event_type", "value", {"p50": 0.5, "p95": 0.95}).drop("n")
    whole = events.groupBy("event_type").agg(F.max("value").alias("highest"), F.round(F.avg("value"), 6).alias("mean"))
    return ranks.join(whole, "event_type")


@query(
    "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1"
)
def q47_upsert_last_write_wins(spark, sf_dir):
    return dedup.latest(
        table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]
    ).select("user_id", "event_id", "event_type")


@query(r"""with m as (select doc_id, unnest(list_concat(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), lambda x: 'email'), list_transform(regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}'), lambda x: 'ip'), list_transform(regexp_extract_all(text, '\+[0-9]+ \([0-9]{3}\) [0-9]{3}-[0-9]{4}'), lambda x: 'phone'))) as kind from documents)
select kind, count(*) as n, count(distinct doc_id) as n_docs from m group by kind""")
def q48_pii_findings_by_kind(spark, sf_dir):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
        "phone": r"\+[0-9]+ \([0-9]{3}\) [0-9]{3}-[0-9]{4}"
    }
    found = F.concat(*[F.array_repeat(F.lit(kind), F.regexp_count("text", F.lit(p))) for kind, p in patterns.items()])
    return docs(spark, sf_dir).select("doc_id", F.explode(found).alias("kind")).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs")
    )


@query("select event_id, false as strict, true as ok, props as json from events")
def q49_json_repair(spark, sf_dir):
    props = F.regexp_replace("props", r"\}$", ",}")
    said = F.concat(F.lit("<think>{</think>answer: "), F.translate(props, '"', "“"), F.lit(" end"))
    return table(spark, sf_dir, "events").select("event_id", json_text.parsed(said).alias("p")).select("event_id", "p.*")


@query(ORACLES["q47_upsert_last_write_wins"])
def q50_streamed_upsert(spark, sf_dir):
    schema, folder = table(spark, sf_dir, "events").schema, shared_folder(spark, "changes")
    stream = changes.follow(spark, f"{sf_dir}/events.parquet", schema)
    changes.log_changes(stream, f"{folder}/log", f"{folder}/state", "user_id", ["ts", "event_id"]).awaitTermination()
    return changes.current(spark, f"{folder}/log", schema, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""select event_type, cast(epoch(h) as bigint) as start, n from (select event_type, date_trunc('hour', ts) as h, count(*) as n from events group by all)
where h + interval 1 hour <= (select max(ts) from events) - interval 1 hour""")
def q51_streamed_windows(spark, sf_dir):
    folder = shared_folder(spark, "windows")
    stream = changes.follow(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema)
    out = changes.windowed(stream, "ts", ["event_type"], width="1 hour", lateness="1 hour").select("event_type", F.unix_timestamp("start").alias("start"), "n")
    changes.write_windows(out, f"{folder}/rows", f"{folder}/state").awaitTermination()
    return spark.read.schema("event_type string, start long, n long").parquet(f"{folder}/rows")


#: Lines that play the headings on the general tables.
HEADINGS = {"short": r"\S{1,12}", "licence": "(?:Licensed under|Copyright).*"}


@query(f"""with l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from (select doc_id, {LINES} as ls from documents)),
s as (select doc_id, pos, regexp_replace(line, '^{BLANK}+|{BLANK}+$', '', 'g') as x from l),
m as (select *, case when regexp_full_match(x, '(?i)\\S{{1,12}}[：:]?') then 'short' when regexp_full_match(x, '(?i)(?:Licensed under|Copyright).*[：:]?') then 'licence' end as h from s where x <> ''),
c as (select *, coalesce(last_value(h ignore nulls) over (partition by doc_id order by pos), 'header') as sec from m)
select d.doc_id, {", ".join(f"coalesce(string_agg(x, chr(10) order by pos) filter (sec = '{n}' and h is null), '') as {n}" for n in ("header", "short", "licence"))}
from documents d left join c using (doc_id) group by d.doc_id""")
def q52_line_sections(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", sections.line_sections(F.col("text"), HEADINGS).alias("s")).select("doc_id", "s.*")


@query()
def q53_private_findings(spark, sf_dir):
    found = docs(spark, sf_dir).select("doc_id", "text", privacy.findings(F.col("text")).alias("found"))
    return found.select(
        "doc_id", F.size("found").alias("n_found"), F.concat_ws(",", F.transform("found", lambda f: f["kind"])).alias("kinds"),
        F.sha2(privacy.for_training(F.col("text")), 256).alias("kept_sha256")
    )


def _skill(name: str, aliases: list[str]) -> str:
    return "case when " + " or ".join(
        f"regexp_matches(coalesce(text, ''), '(^|[^A-Za-z0-9]){a}($|[^A-Za-z0-9-])', 'i')" for a in (name, *aliases)
    ) + f" then '{name}' end"


@query(
    "select doc_id, array_to_string(list_filter([" + ", ".join(_skill(n, a) for n, a in VOCABULARY.items()) + "], lambda x: x is not null), ',') as skills from documents"
)
def q54_known_skills(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(pairing.known_skills(F.col("text"), VOCABULARY), ",").alias("skills"))


@query()
def q55_pair_match(spark, sf_dir):
    """Whole scores of pairs of documents, which play adverts and résumés with their language as direction."""
    d = docs(spark, sf_dir)
    none, words = F.lit(None), F.array(*(F.lit(w) for w in VOCABULARY))
    advert = F.struct(
        F.col("lang").alias("direction"), words.alias("skills"), none.cast("string").alias("education"), none.cast("string").alias("experience"),
        none.cast("array<string>").alias("requirements"), none.cast("array<string>").alias("responsibilities"),
        F.concat(F.lit("任职要求："), F.col("text")).alias("text")
    )
    resume = F.struct(
        F.col("lang").alias("target"), none.cast("array<string>").alias("education"), none.cast("array<string>").alias("skills"),
        none.cast("array<string>").alias("projects"), none.cast("array<string>").alias("internships"), F.col("text").alias("text")
    )
    both = pairs(spark, sf_dir).select("left_id", "right_id").join(d.select(F.col("doc_id").alias("left_id"), advert.alias("advert")), "left_id").join(
        d.select(F.col("doc_id").alias("right_id"), resume.alias("resume")), "right_id"
    )
    out = pairing.score_pairs(both, VOCABULARY).select("left_id", "right_id", "match.*")
    return out.select(
        "left_id", "right_id", "score", "level", "relation", F.array_join("matched", ",").alias("matched"),
        F.array_join("missing", ",").alias("missing")
    )


@query(f"""with t as (select page_id, html, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<title>(.*?)</title>', 1), '^{BLANK}+|{BLANK}+$', '', 'g') as t from pages)
select page_id, case when lower(t) = 'none' then '' else t end as title, not contains(lower(coalesce(html, '')), 'cookie') and (contains(lower(coalesce(html, '')), '<article') or contains(lower(coalesce(html, '')), '<main')) as wanted from t""")
def q56_page_values(spark, sf_dir):
    page = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", values.tagged(page, "title").alias("title"), values.wanted(page, ["<article", "<main"], ["cookie"]).alias("wanted")
    )


@query(
    """select l_returnflag, l_linestatus, cast(sum(l_quantity) as double) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all"""
)
def g01_pricing_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.count(F.lit(1)).alias("n")
    )


@query(
    """select n_name, count(distinct o_orderkey) as n_orders, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name"""
)
def g02_revenue_by_nation(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r")
    ).groupBy("l_orderkey").agg(F.sum("r").alias("r"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("r"), 2).alias("revenue"))


QUERIES.update(fixtures.QUERIES)
ORACLES.update(fixtures.ORACLES)
